"""Operators on odd tables, and against brute force on small ones."""

import collections
import hashlib
import math
import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from citeloom.llm import decontaminate as deco
from citeloom.llm import linededup
from citeloom.llm.components import components
from citeloom.llm.embeddings import near_vectors
from citeloom.llm.language import clear_documents, identify
from citeloom.llm.licenses import scan
from citeloom.llm.linededup import dedup_lines
from citeloom.llm.mixing import mix_sources, source_rates
from citeloom.llm.ngrams import STRENGTH, score_texts
from citeloom.llm.pages import extract
from citeloom.llm.setsketch import near_duplicates
from citeloom.llm.shared import stored
from citeloom.llm.substrings import repeated_substrings
from tests.llm.conftest import table

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def _documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] for r in sorted(rows)}


# --- mixing ------------------------------------------------------------------


def test_mix_reaches_the_target_shares(spark):
    docs = spark.range(40_000).select(
        F.col("id").alias("doc_id"),
        F.lit("t").alias("text"),
        F.when(F.col("id") % 10 == 0, "small").when(F.col("id") % 10 == 1, None).otherwise("big").alias("source"),
    )
    mixed = mix_sources(docs, {"small": 3.0, "big": 1.0}, total=50_000)
    counts = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    for source, share in (("small", 0.6), ("big", 0.2), (None, 0.2)):
        assert abs(counts[source] / 50_000 - share) < 0.02
    again = mix_sources(docs, {"small": 3.0, "big": 1.0}, total=50_000)
    assert mixed.exceptAll(again).isEmpty()
    # The number of copies has the mean and the variance of a Poisson distribution (7.5 here).
    n = docs.where("source = 'small'").select("doc_id").join(
        mixed.groupBy("doc_id").count(), "doc_id", "left"
    ).select(F.coalesce("count", F.lit(0)).alias("n"))
    mean, variance = n.agg(F.avg("n"), F.var_samp("n")).first()
    assert abs(mean - 7.5) < 0.2 and abs(variance - 7.5) < 0.6


def test_mix_of_odd_tables(odd, none):
    out = mix_sources(odd, alpha=1.0)
    assert out.columns == [*[c for c in odd.columns if c != "position"], "n_copies", "copy", "position"]
    counts = collections.Counter(r["doc_id"] for r in out.collect() if r["copy"] == 1)
    assert counts[3] in (0, 2)  # both rows of an id get the same draw
    assert mix_sources(none).count() == 0
    assert source_rates(none).count() == 0


# --- language ----------------------------------------------------------------


def test_language_of_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.9 * len(held)


def test_language_of_odd_tables(odd, none):
    rows = identify(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r["doc_id"] in (0, 1, 2, 7):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] is not None:
            assert r["lang_pred"] == "en" and 0 < r["score"] <= 1
    kept = clear_documents(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == [3, 3, 4, 5, 6, 8]
    assert identify(none).count() == clear_documents(none).count() == 0
    nothing = identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


# --- repeated substrings -------------------------------------------------------


def _substrings(texts):
    seen, out = {}, {}
    for doc in sorted(texts):
        data = (texts[doc] or "").encode()
        edge = np.zeros(len(data) + 1, int)
        for i in range(len(data) - 49):
            if seen.setdefault(data[i : i + 50], doc) < doc:
                edge[i] += 1
                edge[i + 50] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[doc] = (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_substrings_equal_brute_force(spark, words):
    draw = random.Random(7)
    shared = [" ".join(draw.choices(words, k=n)) for n in (8, 20, 70, 400)]
    texts = {}
    for i in range(60):
        parts = [" ".join(draw.choices(words, k=draw.randint(0, 40))) for _ in range(3)]
        parts.insert(draw.randint(0, 3), draw.choice(shared)[draw.randint(0, 30) :])
        texts[i] = "é".join(parts)
    texts[60], texts[61], texts[62] = "ab" * 200, "ab" * 150 + "c", "a" * 49
    texts[63], texts[64], texts[65], texts[66] = "a" * 50, "a" * 120, None, ""
    texts[67], texts[68] = texts[5], texts[60]
    want = _substrings(texts)
    for r in repeated_substrings(table(spark, texts)).collect():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want.pop(r["doc_id"])
    assert not want


def test_substrings_of_odd_tables(odd, none):
    rows = repeated_substrings(odd).collect()
    by = collections.Counter(r["doc_id"] for r in rows)
    assert by == {0: 1, 1: 1, 2: 1, 3: 2, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1}
    for r in rows:
        # Rows of one id do not repeat each other; later ids do.
        if r["doc_id"] == 4:
            assert r["n_removed"] == r["n_bytes"] and r["n_spans"] == 1
        if r["doc_id"] in (0, 1, 2, 3, 5, 6, 7):
            assert r["n_removed"] == r["n_spans"] == 0
        if r["doc_id"] == 8:
            assert r["n_bytes"] - r["n_removed"] == len(" more")
    assert repeated_substrings(none).count() == 0


# --- embeddings ------------------------------------------------------------------


def test_near_vectors(spark):
    draw = np.random.default_rng(8)
    middle = draw.normal(size=(30, 24))
    x = np.concatenate([middle[draw.integers(0, 30, 500)] + 0.1 * draw.normal(size=(500, 24)), draw.normal(size=(200, 24))])
    rows = [(int(i), [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(1000 + i, rows[3][1]) for i in range(5)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [None] + [1.0] * 23), (2004, [float("nan")] * 24)]
    rows += [(2005, [float("inf")] * 24), (2006, [v * 1e-200 for v in rows[3][1]]), (2007, [1.0, 2.0]), (2008, [2.0, 4.0])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, id int")
    got = {r["vec_id"]: r for r in near_vectors(frame).collect()}
    good = {i: np.array(v) / np.linalg.norm(v) for i, v in rows[:705]}
    good[2006] = good[3]
    ids = np.array(sorted(good))
    units = np.array([good[i] for i in ids])
    near = units @ units.T >= 0.9
    np.fill_diagonal(near, False)
    low = ids.copy()
    while True:
        new = np.array([min([low[k], *low[near[k]]]) for k in range(len(ids))])
        if (new == low).all():
            break
        low = new
    found = sum(min(got[int(i)]["n_links"], int(near[k].sum())) for k, i in enumerate(ids))
    assert found >= 0.97 * near.sum()
    assert all(got[int(i)]["n_links"] <= near[k].sum() for k, i in enumerate(ids))
    assert sum(got[int(i)]["component_id"] != low[k] for k, i in enumerate(ids)) <= 2
    for i in range(2000, 2006):
        assert got[i]["n_links"] == 0 and got[i]["kept"] and got[i]["component_id"] == i
    assert got[2007]["n_links"] == got[2008]["n_links"] == 1 and got[2008]["component_id"] == 2007
    assert len(got) == len(rows)
    assert near_vectors(frame.limit(0)).count() == 0


def test_audit_sees_that_all_single_links_are_lost(spark):
    from citeloom.llm import embeddings

    eye = np.eye(12)
    group = [(i, eye[0] + 0.01 * i * eye[1]) for i in range(20)]
    single = [(100 + i, eye[2 + i // 2] + 0.01 * (i % 2) * eye[1]) for i in range(20)]
    rows = [(i, 50 if i < 20 else 1, (v / np.linalg.norm(v)).tobytes()) for i, v in group + single]
    heads = spark.createDataFrame(rows, "id long, copies long, unit binary")
    found = spark.createDataFrame([(i, 950, 19, 0) for i in range(20)], embeddings._PART)
    assert embeddings.audited(heads, found) < embeddings.RECALL


def test_large_shards_are_compared_in_tiles(spark, monkeypatch):
    from citeloom.llm import embeddings

    monkeypatch.setattr(embeddings, "LARGEST", 50)
    monkeypatch.setattr(embeddings, "TILE", 40)
    draw = np.random.default_rng(9)
    x = draw.normal(size=12) + 0.05 * draw.normal(size=(150, 12))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert {r["n_links"] for r in near_vectors(frame).collect()} == {149}


# --- language-model scores -----------------------------------------------------


def test_scores_equal_brute_force(spark, sf_dir):
    texts = _documents(spark, sf_dir)
    texts |= {1_000_000: None, 1_000_001: "", 1_000_002: "never Seen words", 1_000_003: texts[0]}
    tokens = {d: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in tokens}
    one, two = collections.Counter(), collections.Counter()
    for d, w in tokens.items():
        if not held[d]:
            one.update(w)
            two.update(zip([None, *w[:-1]], w, strict=True))
    total, different = sum(one.values()), len(one)

    def low(w):
        return (one[w] + 0.1) / (total + 0.1 * (different + 1))

    rows = score_texts(table(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = tokens[r["doc_id"]]
        assert r["held_out"] == held[r["doc_id"]] and r["train_tokens"] == total
        assert r["n_tokens"] == len(w) and r["n_known"] == sum(one[x] > 0 for x in w)
        assert math.isclose(r["base_score"], sum(math.log10(low(x)) for x in w), rel_tol=1e-9)
        exact = sum(
            math.log10((two[v, x] + STRENGTH * low(x)) / (one[v] + STRENGTH))
            for v, x in zip([None, *w[:-1]], w, strict=True)
        )
        assert abs(r["score"] - exact) <= len(w) / 8000
    out = [r for r in rows if r["held_out"] and r["doc_id"] < 1_000_000]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_scores_of_odd_tables(odd, none):
    rows = score_texts(odd).collect()
    assert collections.Counter(r["doc_id"] for r in rows)[3] == 2 and len(rows) == 10
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (0, 1, 2)} == {1}
    assert score_texts(none).count() == 0


# --- decontamination -----------------------------------------------------------


def test_decontamination_rules(spark, words, odd, none):
    item = " ".join(words[:20])
    texts = {
        0: " ".join([*words[100:110], *words[3:18], *words[110:120]]),
        1: " ".join([*words[100:400], *words[3:17]]),
        2: " ".join([*words[100:110], *words[3:15], *words[110:120]]),
        3: f"{words[50]}, {words[51].upper()}!",
        4: None,
        5: " ".join([*words[3:10], "x", *words[10:16]]),
    }
    bench = spark.createDataFrame(
        [("b", item, 1), ("a", item, 1), ("c", f"{words[50]} {words[51]}", 1), ("d", None, 1), ("e", "?", 1), (None, item, 1)],
        "item_id string, text string, doc_id int",
    )
    got = {r["doc_id"]: r for r in deco.decontaminate(table(spark, texts), bench).collect()}
    assert [(got[i]["n_words"], got[i]["n_hit"], got[i]["items"], got[i]["contaminated"]) for i in range(6)] == [
        (35, 15, ["a", "b"], True),
        (314, 14, ["a", "b"], False),
        (32, 0, [], False),
        (2, 2, ["c"], True),
        (0, 0, [], False),
        (14, 0, [], False),
    ]
    near = {r["doc_id"]: r for r in deco.decontaminate(table(spark, texts), bench, proximity=15).collect()}
    assert near[5]["items"] == ["a", "b"] and near[2]["items"] == []
    assert sorted(r["doc_id"] for r in deco.clean_documents(table(spark, texts), bench).collect()) == [1, 2, 4, 5]
    assert deco.decontaminate(odd, bench).count() == 10
    assert deco.clean_documents(odd, bench).count() == odd.count()
    assert deco.decontaminate(none, bench).count() == 0
    assert deco.clean_documents(odd, bench.limit(0)).count() == odd.count()


def test_benchmark_in_several_blocks(spark, words, monkeypatch):
    texts = {0: " ".join(words[:60])}
    bench = spark.createDataFrame([(i, " ".join(words[5 * i : 5 * i + 15])) for i in range(6)], "item_id long, text string")
    whole = deco.decontaminate(table(spark, texts), bench).first()
    monkeypatch.setattr(deco, "BLOCK_WORDS", 30)
    cut = deco.decontaminate(table(spark, texts), bench).first()
    assert whole["n_hit"] == cut["n_hit"] == 40 and whole["items"] == cut["items"]


def test_rows_of_one_id_stay_apart_in_any_number_of_blocks(spark, words, monkeypatch):
    rows = [(1, " ".join(words[:30])), (1, " ".join(words[:15])), (1, "no hit"), (2, " ".join(words[:30])), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(words[5 * i : 5 * i + 15])) for i in range(4)], "item_id long, text string")

    def found():
        out = deco.decontaminate(docs, bench).select("doc_id", "n_words", "n_hit", "items", "contaminated")
        return sorted(tuple(r) for r in out.collect())

    whole = found()
    monkeypatch.setattr(deco, "BLOCK_WORDS", 20)
    assert found() == whole and [r[:3] for r in whole] == [(1, 2, 0), (1, 15, 15), (1, 30, 30), (2, 0, 0), (2, 30, 30)]


# --- pages -------------------------------------------------------------------------


def test_pages_of_odd_tables(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article>a &lt; b</article>"), (3, "u", "<p>" + "word " * 50), (3, "u", "x")]
    frame = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in extract(frame).collect())
    assert got[0] == (0, "a < b", 5) and got[1] == (1, "", 0) and got[2] == (2, "", 0)
    assert (3, ("word " * 50).strip(), 249) in got
    assert extract(frame.limit(0)).count() == 0


# --- lines ---------------------------------------------------------------------------


def test_lines_that_repeat_go(spark, words):
    long = words[:40]
    typo = [*long[:20], "zzz", *long[21:]]
    texts = {
        1: "\n".join([" ".join(long), "", "Short line.", " ".join(words[50:90])]),
        2: "\n".join([" ".join(typo).upper(), "short   LINE", "", "its own"]),
        3: "\n".join([" ".join(words[100:140]), "Short line!", "***", "***"]),
        4: None,
        5: "",
    }
    out = {r["doc_id"]: r for r in dedup_lines(table(spark, texts)).collect()}
    assert out[1]["text"] == texts[1] and out[1]["n_removed"] == 0
    assert out[2]["text"] == "\nits own" and (out[2]["n_lines"], out[2]["n_removed"]) == (4, 2)
    assert out[3]["text"] == "\n".join([" ".join(words[100:140]), "***", "***"])
    assert out[4]["text"] is None and out[5]["text"] == ""


def test_lines_are_compared_by_characters(spark, words):
    """Short lines with a typo, another digit or a plural, and long ones with many typos."""
    long = " ".join(words[:40])
    typos = "".join("q" if i % 20 == 10 else c for i, c in enumerate(long))
    texts = {
        1: "\n".join(["Last updated 3 March, page 2 of 10", "Show comments", long, "one two three"]),
        2: "\n".join(["Last updated 4 March, page 2 of 10", "Show comment", typos, "one six three"]),
    }
    out = {r["doc_id"]: r for r in dedup_lines(table(spark, texts)).collect()}
    assert out[1]["n_removed"] == 0
    assert out[2]["text"] == "one six three" and out[2]["n_removed"] == 3


def test_lines_that_share_a_passage_are_no_rows_by_pairs(spark, monkeypatch):
    """700 lines are alike in two thirds of their text; of each tenth there is a copy with a typo."""
    draw = random.Random(6)
    passage = "".join(draw.choices(string.ascii_lowercase + " ", k=120))
    lines = [passage + "".join(draw.choices(string.ascii_lowercase, k=60)) for _ in range(700)]
    typos = [x[:170] + "0" + x[171:] for x in lines[::10]]
    written = {}

    def counted(df, label):
        out = stored(df, label)
        written[label] = max(written.get(label, 0), out.count())
        return out

    monkeypatch.setattr(linededup, "stored", counted)
    texts = {1: "\n".join(lines), 2: "\n".join(typos)}
    out = {r["doc_id"]: r for r in dedup_lines(table(spark, texts)).collect()}
    assert (out[1]["n_removed"], out[2]["n_removed"], out[2]["text"]) == (0, 70, "")
    assert max(written.values()) <= linededup.KEYS * 770


def test_rows_sent_to_tiles_and_shards_grow_with_the_rows(spark, monkeypatch):
    """A large bucket has a few blocks, and keys shared with lines of other sizes only are not sent again."""
    draw = random.Random(9)
    passage = "".join(draw.choices(string.ascii_lowercase + " ", k=120))
    alike = [passage + "".join(draw.choices(string.ascii_lowercase, k=60)) for _ in range(300)]
    longer = [passage[20:60] + "".join(draw.choices(string.ascii_lowercase, k=int(200 * 1.5**i))) for i in range(9)]
    typos = [x[:170] + "0" + x[171:] for x in alike[::10]]
    blocks, keys = [], []

    def kept(df, label):
        out = stored(df, label)
        if label == "left":
            blocks.extend(r["blocks"] for r in out.collect())
        if label == "shared":
            keys.append(sum(bin(b).count("1") for r in out.collect() for b in r["shared"]))
        return out

    monkeypatch.setattr(linededup, "stored", kept)
    monkeypatch.setattr(linededup, "BLOCK", 16)
    out = {r["doc_id"]: r for r in dedup_lines(table(spark, {1: "\n".join(alike), 2: "\n".join(typos)})).collect()}
    assert (out[1]["n_removed"], out[2]["n_removed"], out[2]["text"]) == (0, 30, "")
    assert 1 < max(blocks) <= 4
    keys.clear()
    assert dedup_lines(table(spark, longer)).agg(F.sum("n_removed")).first()[0] == 0
    assert keys == [0]


def test_lines_of_odd_tables(odd, none):
    out = dedup_lines(odd)
    assert out.columns == [*[c for c in odd.columns if c != "n_removed"], "n_lines", "n_removed"]
    rows = out.collect()
    assert len(rows) == odd.count()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r["text"])
    assert by[4] == [""] and by[3][0] == by[3][1] != "" and by[8] == [""]
    assert all(t for t in by[None] if t is not None) and by[2] == [" \t\n "]
    assert dedup_lines(none).count() == 0


# --- licences ---------------------------------------------------------------------------


def test_licences_of_documents(spark, sf_dir, odd, none):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = {
        "Apache License": "apache-2.0",
        "MIT License": "mit",
        "GNU General Public": "gpl-3.0",
        "CC BY-NC": "cc-by-nc",
        "All rights reserved": "proprietary",
    }
    rows = scan(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    for r in rows:
        want = sorted({f for k, f in names.items() if k in r["text"]})
        assert r["families"] == ",".join(want), r["text"][-100:]
    assert {r["n_notices"] for r in scan(odd).collect()} == {0}
    assert scan(odd).count() == odd.count() and scan(none).count() == 0


# --- near duplicates ---------------------------------------------------------------------


def _near(texts, n, percent):
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    low = {d: d for d in texts}
    links = [
        (a, b)
        for a in texts
        for b in texts
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[b]
    ]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return {d: (len(sets[d]), low[d]) for d in texts}


@pytest.mark.parametrize("n, percent", [(5, 80), (3, 85)])
def test_near_duplicates_equal_brute_force(spark, words, n, percent):
    draw = random.Random(10)
    texts = {}
    for base in range(12):
        plain = draw.choices(words, k=draw.randint(40, 300))
        for _ in range(draw.randint(1, 14)):
            # Chains of small changes, so that the ends of a group are far apart.
            plain = list(plain)
            for _ in range(draw.randint(0, 3)):
                plain[draw.randrange(len(plain))] = draw.choice(words)
            texts[len(texts) * 7 + base] = " ".join(plain)
    texts |= {9000: None, 9001: "", 9002: "  ", 9003: "a B", 9004: "A b", 9005: "a b c"}
    want = _near(texts, n, percent)
    got = {r["doc_id"]: r for r in near_duplicates(table(spark, texts), n, percent).collect()}
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert all(r["kept"] == (d == r["component_id"]) for d, r in got.items())


def test_near_duplicates_of_odd_tables(odd, none):
    rows = near_duplicates(odd).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows) == [
        (0, 0), (1, 1), (2, 2), (3, 3), (3, 3), (4, 3), (5, 5), (6, 6), (7, 7), (8, 3),
    ]
    assert near_duplicates(none).count() == 0


def test_components_of_chains_stars_and_rings(spark):
    draw = random.Random(11)
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 400)]
    links += [(5000 + i, 5000 + (i + 1) % 50) for i in range(50)] + [(7, 7), (9000, 8000), (9000, 8500)]
    draw.shuffle(links)
    frame = spark.createDataFrame([*links, (None, 3)], "a long, b long").repartition(7)
    got = {r["id"]: r["component"] for r in components(frame).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(400))
    assert all(got[5000 + i] == 5000 for i in range(50)) and got[9000] == got[8500] == 8000
    assert components(frame.limit(0)).count() == 0


# --- pipeline ------------------------------------------------------------------------------


def test_pipeline_stages_keep_clean_documents(spark, sf_dir, words):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "lines", "near_duplicates", "decontamination", "mix"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    draw = random.Random(12)
    clean = {10_000 + i: " ".join(draw.choices(words, k=80)) for i in range(20)}
    more = spark.createDataFrame(
        [(i, t, None, "src0", len(t)) for i, t in clean.items()], docs.schema
    )
    docs = docs.unionByName(more)
    columns = docs.columns
    for name in list(stages)[:-1]:
        docs = stages[name](spark, docs, sf_dir).cache()
        assert docs.columns == columns
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert set(clean) <= ids, name
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(texts[i] == t for i, t in clean.items())
    assert stages["mix"](spark, docs, sf_dir).count() > 0


def test_pipeline_runs(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "text", "copy"} <= set(out.columns) and out.count() > 0
