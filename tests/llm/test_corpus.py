"""Divergence of sources, toxicity and resampling, against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citeloom.llm import resampling, toxicity
from citeloom.llm.divergence import pair_values, probabilities, source_divergence
from citeloom.llm.resampling import kth_key, resample
from citeloom.llm.toxicity import DECAY, judge, train
from tests.llm.conftest import table

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


# --- divergence ---------------------------------------------------------------


@pytest.mark.parametrize(
    ("rows", "width", "share", "strip"),
    [(20, 300, 0.1, 256), (1, 10, 0.5, 256), (2, 3, 0.9, 256), (23, 57, 0.2, 8), (3, 5, 0.0, 256), (17, 40, 1.0, 4)],
)
def test_quadtree_prices_all_pairs(rows, width, share, strip):
    draw = np.random.default_rng(rows)
    counts = (draw.random((rows, width)) < share) * draw.integers(1, 50, (rows, width))
    totals = counts.sum(1)
    p = probabilities(counts, totals[:, None], width)
    row, column = np.nonzero(counts)
    got = pair_values(row, column, p[row, column], probabilities(np.int64(0), totals, width), width, strip)
    want = [[((p[i] - p[j]) ** 2 // p[j]).sum() for j in range(rows)] for i in range(rows)]
    assert (got == np.array(want)).all()


def _divergence(rows, top):
    """The contract, spelled out over (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.translate(LOWER)) for _, _, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        seen = collections.Counter(w for r, ws in zip(rows, words, strict=True) if r[0] == lang for w in set(ws))
        kept = sorted(w for w, n in seen.items() if n >= 3)
        groups = {s: collections.Counter() for x, s, _ in rows if x == lang}
        for (x, s, _), ws in zip(rows, words, strict=True):
            if x == lang:
                groups[s].update(w for w in ws if seen[w] >= 3)

        def p(count, w):
            return 1 + 10**9 * (count[w] + 1) // (sum(count.values()) + len(kept))

        whole = sum(groups.values(), collections.Counter())
        for s, count in groups.items():
            pairs = [
                (-sum((p(count, w) - p(other, w)) ** 2 // p(other, w) for w in kept), t.encode(), t)
                for t, other in groups.items()
                if t != s
            ]
            terms = [
                (-((p(count, w) - p(whole, w)) ** 2 // p(whole, w)), w.encode(), w)
                for w in kept
                if count[w] and p(count, w) > p(whole, w)
            ]
            for part, found in (("pair", pairs), ("term", terms)):
                for rank, (value, _, item) in enumerate(sorted(found), 1):
                    if part == "pair" or rank <= top:
                        out.append((lang, s, part, item, -value, rank))
    return sorted(out)


def test_divergence_by_brute_force(spark, words):
    draw = random.Random(3)
    rows = []
    for i in range(240):
        source = None if i % 3 else f"s{draw.randint(0, 8)}"
        text = " ".join(draw.choices(words[:200], k=draw.randint(0, 60))) + " Ünd ß É, x9y"
        rows.append((draw.choice(["en", "de", None]), source, None if i % 17 == 0 else text))
    rows += [("one", "alone", "a b c"), ("few", "x", "q"), ("few", "y", None), *[("tie", s, "a b") for s in "wxyz"]]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    got = sorted(tuple(r) for r in source_divergence(docs, top=20).collect())
    assert got == _divergence(rows, 20)
    assert source_divergence(docs, top=20).schema.simpleString() == (
        "struct<lang:string,source:string,part:string,item:string,value:bigint,rank:int>"
    )


def test_divergence_of_odd_tables(odd, none):
    rows = [(r["lang"], r["source"], r["text"]) for r in odd.select("lang", "source", "text").collect()]
    assert sorted(tuple(r) for r in source_divergence(odd).collect()) == _divergence(rows, 200)
    assert source_divergence(none).collect() == []


# --- toxicity -----------------------------------------------------------------


def _kernel(x, y):
    """Common subsequences of three letters, each worth less the wider it is spread."""
    spread = []
    for word in (x, y):
        word = "^" + word + "^"
        count = collections.Counter()
        for i, j, k in itertools.combinations(range(len(word)), 3):
            count[word[i] + word[j] + word[k]] += DECAY ** (k - i + 1)
        spread.append(count)
    return sum(n * spread[1][c] for c, n in spread[0].items())


def test_kernel_by_brute_force():
    names = ["idiot", "idxiot", "banana", "aa", "a", "iditot", "thecatsat"]
    words, _ = toxicity.words_of(pa.array([" . ".join(names)]))
    spread = toxicity.spread_of(words)
    got = toxicity.landmark_kernel(words, spread)
    # Letters alone stand for words; the two of them between blanks do not touch.
    want = [[_kernel(x, y) / math.sqrt(_kernel(x, x) * _kernel(y, y)) for y in names] for x in names]
    assert np.allclose(got, want, atol=1e-5)


def test_words_are_letters_windows_and_spelled_out_words():
    def shown(text):
        rows, _ = toxicity.words_of(pa.array([text]))
        return ["".join(chr(96 + c) for c in r if 0 < c < 27) for r in rows]

    assert shown("The i-d.i*o_t 42 !! x") == ["the", "idiot", "x"]
    assert shown("an i d i o t here") == ["an", "idiot", "here"]
    assert shown("a" * 30) == ["a" * 24, "a" * 18]
    assert shown("") == shown("?! 1") == []


@pytest.fixture(scope="module")
def spoken(words):
    """Texts, and whether they are toxic: a bad word, of a family, or bent, is in them."""
    draw = random.Random(8)
    bad = ["zwodgip", "krumblex", "fnordy"]
    texts, toxic = [], []
    for i in range(700):
        text = draw.choices(words, k=draw.randint(5, 80))
        if i % 3 == 0:
            word = draw.choice(bad)
            if i % 2:
                word = word + draw.choice(["s", "ing", "ish", "est"])
            text.insert(draw.randrange(len(text)), word)
        texts.append(" ".join(text))
        toxic.append(i % 3 == 0)
    return texts, toxic


def test_toxicity_held_out(spark, spoken):
    texts, toxic = spoken
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(x)) for i, x in enumerate(toxic)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(out) == len(texts)
    for i, r in out.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1
    held = [i for i, r in out.items() if r["held_out"]]
    right = [out[i]["predicted"] == toxic[i] for i in held]
    assert np.mean(right) >= 0.97
    # Labels of held-out rows change nothing.
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, other).collect()}
    assert all(again[i] == r["score"] for i, r in out.items())


def test_gaps_and_strange_letters(spoken, words):
    texts, toxic = spoken
    machine = train(pa.array(texts), np.array(toxic))
    clean = " ".join(words[100:140])
    bent = ["krum.blex", "k r u m b l e x", "krumqblex", "zwoodgip", "zw-odg-ip"]
    assert (judge(machine, pa.array([f"{clean} {x} {clean}" for x in bent])) >= 0.5).all()
    assert judge(machine, pa.array([clean]))[0] < 0.5


def test_toxicity_of_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(3, 1), (3, 0), (5, 0), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    out = toxicity.toxicity(odd, labels)
    assert out.count() == odd.count()
    assert out.where("score IS NULL OR held_out IS NULL OR isnan(score)").isEmpty()
    assert [r["score"] for r in toxicity.toxicity(odd, labels.where("false")).collect()] == [0.0] * odd.count()
    assert toxicity.toxicity(none, labels).collect() == []


# --- resampling ---------------------------------------------------------------


def _features(text, order):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    runs = [" ".join(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)]
    return words, [zlib.crc32(x.encode()) % 10000 for x in runs]


def _resampled(docs, target, order, percent=10):
    corpus = collections.Counter(b for _, t in docs for b in _features(t, order)[1])
    wanted = collections.Counter(b for t in target for b in _features(t, order)[1])
    many, most = sum(corpus.values()), sum(wanted.values())
    rows = []
    for i, text in docs:
        words, buckets = _features(text, order)
        weight = sum(
            math.floor(1000 * math.log((wanted[b] + 1) * (many + 10000) / ((corpus[b] + 1) * (most + 10000))))
            for b in buckets
        )
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(buckets), weight, score, len(words)])
    fit = [r for r in rows if r[4] >= 20]
    fit.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    k = len(fit) * percent // 100
    drawn = [(*r[:4], n) for n, r in enumerate(fit[:k], 1)]
    rest = [(*r[:4], None) for r in [r for r in rows if r[4] < 20] + fit[k:]]
    return drawn, collections.Counter(rest)


@pytest.mark.parametrize("order", [1, 2])
def test_resampling_by_brute_force(spark, words, order):
    draw = random.Random(order)
    docs = [(i, " ".join(draw.choices(words, k=draw.randint(0, 60)))) for i in range(300)]
    docs += [(7, docs[7][1])] * 40 + [(None, docs[9][1]), (301, None), (302, "É" * 400 + " Ab"), (303, "x " * 3000)]
    target = [" ".join(draw.choices(words[:50], k=80)) for _ in range(20)] + [None]
    frame = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, score string")
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    out = [tuple(r) for r in resample(frame, wanted, order=order).collect()]
    drawn, rest = _resampled(docs, target, order)
    assert sorted((r for r in out if r[4]), key=lambda r: r[4]) == drawn
    assert collections.Counter(r for r in out if not r[4]) == rest


def test_quickselect_finds_every_place(spark):
    rows = [(-(i * 37 % 50), 1, i % 7, 3) for i in range(200)] + [(-11, 1, 2, 3)] * 100
    frame = spark.createDataFrame(rows, "down long, known long, id long, n_features long").cache()
    order = sorted(rows)
    for k in (1, 2, 57, 150, 299, 300):
        key, ahead, equal = kth_key(frame, k, pivots=5)
        assert key == order[k - 1]
        assert ahead == order.index(key) and equal == order.count(key)


def test_resampling_of_odd_tables(odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    out = [tuple(r) for r in resample(odd, odd, percent=50).collect()]
    drawn, rest = _resampled(rows, [t for _, t in rows], 1, 50)
    assert sorted((r for r in out if r[4]), key=lambda r: r[4]) == drawn
    assert collections.Counter(r for r in out if not r[4]) == rest
    assert resample(none, odd).collect() == []
    assert resample(odd, none, percent=0).where("rank IS NOT NULL").isEmpty()
    assert resampling.gains([0] * 4, [0] * 4).tolist() == [0] * 4
