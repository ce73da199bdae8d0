"""Words, hashes, SimHash, registers, code and network: the parts that need no Spark."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citeloom.llm import embeddings, language, licenses, linededup, ngrams, pages, setsketch, substrings
from citeloom.llm.words import ALPHANUMERIC, NOT_SPACE, joined, shingles, spans, words_of

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t.1Zß", max_size=30)), max_size=6))
def test_words_are_those_of_the_patterns(texts):
    column = pa.array(texts, pa.string())
    for kind, pattern in (
        (NOT_SPACE, r"[^\x20\x09-\x0D]+"),
        (ALPHANUMERIC, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"),
    ):
        want = [re.findall(pattern, (t or "").translate(LOWER)) for t in texts]
        body, at = joined(column)
        begin, end, text = spans(body, at, kind)
        data = bytes(body)
        got = [[] for _ in texts]
        for b, e, t in zip(begin, end, text, strict=True):
            got[t].append(data[b:e].decode().translate(LOWER))
        assert got == want
        words, first, _ = words_of(column, kind)
        flat = [w for x in want for w in x]
        assert len(set(flat)) == len(set(words.tolist())) and len(words) == len(flat)
        assert np.diff(first).tolist() == [len(x) for x in want]


def test_hash_of_a_word_does_not_depend_on_its_place():
    one, _, _ = words_of(pa.array(["x " * 70_000 + "same", "same"]), NOT_SPACE)
    assert one[-1] == one[-2] and one[0] == one[1] != one[-1]
    big, _, _ = words_of(pa.array(["y" * 300_000 + " z", "y" * 300_000]), NOT_SPACE)
    assert big[0] == big[2]


def test_short_texts_are_one_shingle():
    words, first, _ = words_of(pa.array(["a b", "", "a b", "b a", "a b c d"]), NOT_SPACE)
    found, owner = shingles(words, first, 3)
    by = [sorted(found[owner == i].tolist()) for i in range(5)]
    assert [len(x) for x in by] == [1, 0, 1, 1, 2]
    assert by[0] == by[2] != by[3]


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edits_by_brute_force():
    draw = random.Random(1)
    for _ in range(1500):
        a = "".join(draw.choices("abcdé ", k=draw.randint(0, 60)))
        b = list(a)
        for _ in range(draw.randint(0, 8)):
            place = draw.randint(0, max(len(b) - 1, 0))
            b[place : place + draw.randint(0, 1)] = draw.choice(["", "z", "a", "bc"])
        b, most = "".join(b), draw.randint(0, 9)
        assert linededup.similar(a, b, most) == (_edits(a, b) <= most)


def test_pairs_are_told_together_as_one_by_one():
    """Of all lengths, of few and of many kinds of letters, with few edits and with too many."""
    draw = random.Random(3)
    x, y = [], []
    for _ in range(900):
        size, letters = draw.choice([0, 3, 30, 90, 400]), draw.choice(["abc", "abcdé 漢😀", "".join(map(chr, range(97, 600)))])
        a = "".join(draw.choices(letters, k=draw.randint(0, size)))
        b = list(a)
        for _ in range(draw.randint(0, 3 + size // 8)):
            place = draw.randint(0, max(len(b) - 1, 0))
            b[place : place + draw.randint(0, 2)] = draw.choice(["", "z", "a", "bc"])
        x.append(a)
        y.append("".join(b) if draw.random() < 0.9 else "".join(draw.choices(letters, k=size)))
    most = np.array([draw.randint(0, 4 + len(a) // 8) for a in x])
    told = [linededup.similar(*pair) for pair in zip(x, y, most.tolist(), strict=True)]
    assert linededup.similar_pairs(x, y, most).tolist() == told and 200 < sum(told) < 800
    assert linededup.similar_pairs(x[:3], y[:3], most[:3]).tolist() == told[:3]
    assert linededup.similar_pairs([], [], np.empty(0, np.int64)).tolist() == []


def test_very_long_lines_are_compared():
    draw = random.Random(2)
    a = "".join(draw.choices("abcdefghij ", k=50_000))
    b = "".join("z" + c if i % 30 == 0 else c for i, c in enumerate(a))
    assert linededup.similar(a, b, 5_000) and not linededup.similar(a, b, 1_600)


def line_sketches(lines):
    data = [x.encode() + b" " for x in lines]
    at = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    return linededup.sketches(np.frombuffer(b"".join(data), np.uint8), at)


@pytest.mark.parametrize("size, changed, share", [(20, 2, 0.98), (10, 1, 0.98), (40, 1, 0.99), (4, 0, 0.98)])
def test_share_of_similar_lines_that_become_candidates(size, changed, share):
    """Words of five letters, some of them changed, or one letter if none is."""
    draw = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def word():
        return "".join(draw.choices(letters, k=5))

    lines, others = [], []
    for _ in range(500):
        words = [word() for _ in range(size)]
        other = list(words)
        for i in draw.sample(range(size), changed or 1):
            other[i] = word() if changed else "-" + other[i][1:]
        lines.append(" ".join(words))
        others.append(" ".join(other))
    keys, line, bits = line_sketches(lines + others)
    held = [set() for _ in range(1000)]
    for k, i in zip(keys.tolist(), line.tolist(), strict=True):
        held[i].add(k)
    chars = np.array([len(x) for x in lines + others])
    left, right = np.arange(500), np.arange(500, 1000)
    near = linededup._close(bits, chars, left, right, 0.9)
    assert np.mean([bool(held[i] & held[i + 500]) and near[i] for i in range(500)]) >= share


def test_long_lines_of_the_same_syllables_are_rarely_candidates():
    """They share many strings, at other places: candidates must not grow with the square of the lines."""
    draw = random.Random(4)
    syllables = ["the ", "tion", "ing ", "er", "an", "re ", "on", "en", "th", "ou", "st ", "ed ", "ha", "in ", "ble ", "at"]
    lines = ["".join(draw.choices(syllables, k=150)) for _ in range(300)]
    _, _, bits = line_sketches(lines)
    left, right = np.triu_indices(300, 1)
    assert linededup._close(bits, np.full(300, 400), left, right, 0.9).mean() < 0.06


def test_keys_of_a_piece_take_little_memory():
    draw = random.Random(5)
    text = "\n".join("".join(draw.choices("abcdefgh ", k=50)) for _ in range(20_000))
    sink = pa.BufferOutputStream()
    part = pa.record_batch({"text": pa.array([text])})
    with pa.ipc.new_stream(sink, part.schema) as out:
        out.write_batch(part)
    wanted = pa.table({"row": np.zeros(20_000, np.int32), "line": np.arange(20_000, dtype=np.int32)})
    tracemalloc.start()
    keys, target, line, *_ = linededup._keyed({"rows": sink.getvalue().to_pybytes()}, wanted, 64, compared=False)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(keys) == len(target) == len(line) >= 20_000 * linededup.KEYS
    assert most < 50 * len(keys)


def test_rows_whose_leader_was_another_are_compared_with_each_other():
    keys, ids = np.array([5, 5, 5, 6, 6, 7]), np.arange(6)
    bits, size = np.zeros((6, 2), np.uint64), np.full(6, 100)
    _, follow, leader = linededup.lead(keys, ids, bits, size)
    assert set(zip(leader.tolist(), follow.tolist(), strict=True)) == {(0, 1), (0, 2), (3, 4)}
    # None of the links held: rows 1 and 2 have not been compared yet.
    found = {(a, b) for x, y in linededup.apart(keys, ids, bits, size, ids) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    assert {tuple(sorted(p)) for p in found} == {(0, 1), (0, 2), (1, 2), (3, 4)}
    # Nothing is left in groups that are connected.
    assert not [1 for x, _ in linededup.apart(keys, ids, bits, size, keys) if len(x)]


def test_lines_of_a_bucket_are_compared_with_those_of_about_their_size(monkeypatch):
    """All pairs that may be similar are found, few others are looked at."""
    draw = np.random.default_rng(7)
    n = 600
    keys, ids, size = draw.integers(0, 2, n), draw.permutation(n), np.exp(draw.uniform(3, 8, n)).astype(np.int64)
    bits = draw.integers(0, 2**63, (40, linededup.WIDTH), dtype=np.uint64)[draw.integers(0, 40, n)]
    group = np.where(draw.random(n) < 0.3, 1000, ids // 2)
    a, b = np.triu_indices(n, 1)
    mine = (keys[a] == keys[b]) & (group[a] != group[b])
    mine[mine] = linededup._close(bits, size, a[mine], b[mine], 0.9)
    looked = []
    close = linededup._close

    def counted(bits, size, a, b, similarity):
        looked.append(len(a))
        return close(bits, size, a, b, similarity)

    monkeypatch.setattr(linededup, "_close", counted)
    found = [p for x, y in linededup.apart(keys, ids, bits, size, group) for p in zip(x.tolist(), y.tolist(), strict=True)]
    assert {tuple(sorted(p)) for p in found} == set(zip(a[mine].tolist(), b[mine].tolist(), strict=True)) != set()
    assert sum(looked) < 0.1 * n * n / 4
    looked.clear()
    _, follow, _ = linededup.lead(linededup._sized(keys, size, 0.9), ids, bits, size)
    assert len(follow) and sum(looked) < 0.35 * n * n / 4


def test_registers_merge_and_tell_the_overlap():
    draw = np.random.default_rng(2)
    base = draw.integers(0, 2**63, 1500, dtype=np.uint64)
    for shared in (500, 850, 950):
        errors = []
        for _ in range(10):
            draw.shuffle(base)
            a, b = np.sort(base[:1000]), np.sort(base[1000 - shared : 2000 - shared])
            both = setsketch.registers(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            union = np.unique(np.concatenate([a, b]))
            whole = setsketch.registers(union, np.array([0, len(union)]))
            assert (setsketch.merge(both[0], both[1]) == whole[0]).all()
            more, less = (both[0] > both[1]).sum(), (both[0] < both[1]).sum()
            sizes = np.array([float(len(a))]), np.array([float(len(b))])
            got = setsketch.estimate(np.array([more]), np.array([less]), *sizes)[0]
            errors.append(got - len(np.intersect1d(a, b)) / len(union))
        assert abs(np.mean(errors)) < 0.05 and max(map(abs, errors)) < setsketch.MARGIN


@pytest.mark.parametrize("values", [[0], [5], [0, 0, 0], [1, 2, 3, 1000], list(range(0, 90_000, 7))])
def test_elias_fano_gives_back_its_values(values, tmp_path):
    code = ngrams.EliasFano.encode(np.array(values), str(tmp_path), "x")
    assert code.decode().tolist() == values
    places = np.arange(len(values))
    assert code.get(places).tolist() == values


def test_trie_finds_all_and_only_its_bigrams(tmp_path):
    draw = np.random.default_rng(3)
    pairs = np.unique(draw.integers(0, 400, (3000, 2)), axis=0)
    score = -draw.random(len(pairs)) * 9
    trie = ngrams.Trie.build(pairs[:, 0], pairs[:, 1], score, str(tmp_path))
    known = {tuple(p): s for p, s in zip(pairs.tolist(), score, strict=True)}
    asked = draw.integers(0, 420, (2000, 2))
    many = trie.find(asked[:, 0], asked[:, 1])
    few = np.concatenate([trie.find(a[:, 0], a[:, 1]) for a in np.array_split(asked, 20)])
    assert (many == few).all()
    for (v, w), code in zip(asked.tolist(), many, strict=True):
        if (v, w) in known:
            assert abs(-int(code) * ngrams.STEP - known[v, w]) <= ngrams.STEP
        else:
            assert code == ngrams.ABSENT


def test_equal_strings_pick_the_same_place():
    draw = np.random.default_rng(4)
    same = draw.integers(97, 123, 200).astype(np.uint8)
    parts = [draw.integers(97, 123, n).astype(np.uint8) for n in (33, 70_000)]
    body = np.concatenate([parts[0], same, parts[1], same])
    at = np.array([0, len(parts[0]) + len(same), len(body)])
    position, name, first, count = substrings.picked(body, at)
    assert count.sum() == sum(n - 49 for n in np.diff(at))
    where = {int(f) + k: (int(p), int(h)) for p, h, f, c in zip(position, name, first, count, strict=True) for k in range(c)}
    a, b = len(parts[0]), len(body) - len(same)
    for k in range(len(same) - 49):
        (p, h), (q, g) = where[a + k], where[b + k]
        assert p - a == q - b and h == g


def test_network_learns_and_is_the_same_each_time():
    draw = np.random.default_rng(5)
    texts = ["".join(draw.choice(list(s), 200)) for _ in range(60) for s in ("abcde ", "cdefg ", "xyzab ")]
    windows = np.zeros((len(texts), language.WINDOW), np.uint8)
    for i, t in enumerate(texts):
        windows[i, : len(t)] = np.frombuffer(t.encode(), np.uint8)
    labels = np.arange(len(texts)) % 3
    net = language.train(windows[:120], labels[:120], ["p", "q", "r"])
    again = language.train(windows[:120], labels[:120], ["p", "q", "r"])
    assert (net.filters == again.filters).all()
    assert (language.log_probabilities(net, windows[120:]).argmax(1) == labels[120:]).mean() > 0.95


def test_windows_cover_every_byte_once():
    body, at = joined(pa.array(["", "a" * 256, "b" * 257, None, "c"]))
    windows, owner, length = language.cut_windows(body, at)
    assert owner.tolist() == [1, 2, 2, 4] and length.tolist() == [256, 256, 1, 1]
    assert bytes(windows[2][:2]) == b"b\0"


PAGE = (
    "<html><head><title>t</title></head><body><header>Site name</header>"
    "<nav><a href=a>Home</a> <a href=b>News</a></nav><div class='cookie-notice'>We use cookies.</div>"
    "<article><h1>A title &amp; more</h1><p>First&nbsp;text,\n with <b>bold</b>.<br>And on.<p>x"
    "<script>var a='<p>no</p>';</script><!-- <p>no</p> --><form>Mail <input></form>"
    "<section id=comments><p>I agree with all of this.</p></section></article>"
    "<aside>See also</aside><footer>&copy; us</footer></body></html>"
)


def test_article_of_a_page():
    got = pages.main_text(PAGE, pages.trained())
    assert got == "A title & more\nFirst text, with bold. And on.\nx"
    plain = "<body><ul><li><a>a</a><li><a>b</a></ul><p>" + "word " * 60 + "</p><p>Short end.</p>"
    assert pages.main_text(plain, pages.trained()) == ("word " * 60).strip() + "\nShort end."
    for nothing in (None, "", "<nav>x</nav>", "<p>", "<!--", "<"):
        assert pages.main_text(nothing, pages.trained()) in ("", "<")


@pytest.mark.parametrize("inside", ["<div>", "<dt>a<dd>b", "<tbody><tr><td><p>x", "<li><p>x"])
def test_containers_end_whatever_is_left_open_in_them(inside):
    text = ("word " * 60).strip()
    page = f"<nav>{inside * 300}</nav><p>{text}</p>"
    assert pages.main_text(page, pages.trained()) == text


@pytest.mark.parametrize(
    "tag", ["main class='content has-sidebar'", "article class='post category-social'", "div class='content no-sidebar'"]
)
def test_side_words_in_names_of_articles(tag):
    text = ("word " * 60).strip()
    assert pages.main_text(f"<{tag}><p>{text}</p></{tag.split()[0]}>", pages.trained()) == text
    beside = f"<main><p>{text}</p></main><div class=comments><article class=comment><p>{text} no</p></article></div>"
    assert pages.main_text(beside, pages.trained()) == text


@pytest.mark.parametrize(
    "page",
    ["<!--" * 250_000, "<a " + "x=1 " * 100_000 + ">y", "<div>" * 100_000, "<a b=\"" * 100_000, "<p>" * 100_000],
)
def test_broken_pages_take_linear_time(page):
    pages.blocks(page)


def test_graph_search_finds_what_brute_force_finds():
    draw = np.random.default_rng(6)
    middle = draw.normal(size=(40, 32))
    x = np.concatenate([middle[draw.integers(0, 40, 600)] + 0.12 * draw.normal(size=(600, 32)), draw.normal(size=(400, 32))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    pairs = embeddings.reach(x, embeddings.pruned(x), 0.85, 24)
    a, b = np.nonzero(x @ x.T >= 0.9)
    want = set((a * len(x) + b).tolist())
    assert len(want & set(pairs.tolist())) >= 0.98 * len(want)


def test_graph_search_leaves_tight_groups():
    draw = np.random.default_rng(7)
    middle = draw.normal(size=(5, 32))
    x = np.repeat(middle, 80, axis=0) + 0.02 * draw.normal(size=(400, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    pairs = embeddings.reach(x, embeddings.pruned(x), 0.85, 24)
    a, b = np.nonzero(x @ x.T >= 0.9)
    want = set((a * len(x) + b).tolist())
    assert len(want & set(pairs.tolist())) >= 0.99 * len(want)


def test_shards_know_all_their_links_without_the_graph():
    draw = np.random.default_rng(7)
    x = np.repeat(draw.normal(size=(5, 32)), 20, axis=0) + 0.02 * draw.normal(size=(100, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    a, b = embeddings._in_shard(x, np.full((100, 1), -1, np.int32), 24)
    p, q = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    assert set(zip(p.tolist(), q.tolist())) <= set(zip(a.tolist(), b.tolist()))


def test_licence_lines_and_others():
    model = licenses.train(["the river runs through a town of stone houses"] * 50)
    lines = {
        "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "Released under the MIT License.": "mit",
        "© 2020 Foo. All rights reserved.": "proprietary",
        "He lost his license in spring": None,
        "the town of stone": None,
    }
    for text, family in lines.items():
        words, line, _, _ = licenses._words(pa.array([text]))
        p = model.probabilities(words, line, 1)[0]
        assert abs(p.sum() - 1) < 1e-5
        best = int(p[:-1].argmax())
        found = p[best] >= licenses.LEAST and model.confirmed(best, words)
        assert (model.families[best] if found else None) == family


_PROSE = [" ".join(f"word{i}{k}" for i in range(60)) for k in "abc"]


@pytest.mark.parametrize(
    "container",
    [
        "<form id=aspnetForm>{}</form>",
        "<div class='page header-fixed'>{}</div>",
        "<div class='post share-enabled'>{}</div>",
        "<div class='entry-content comment-count-3'>{}</div>",
        "<form><div id='wrap-header-on'><div class='share-on'>{}</div></div></form>",
    ],
)
def test_a_container_of_most_prose_is_the_page(container):
    side = '<div class="nav"><a href=x>Home</a> <a href=y>News</a></div>'
    body = "<h1>A title of it</h1>" + "".join(f"<p>{x}</p>" for x in _PROSE)
    end = "<div class='comments'><p>" + " ".join(_PROSE)[:200] + "</p></div><footer>All rights</footer>"
    page = f"<html><body>{container.format(side + body + end)}</body></html>"
    assert pages.main_text(page, pages.trained()) == "\n".join(["A title of it", *_PROSE])


@pytest.mark.parametrize("name", ["sidebar", "side-nav sidebar", "comments", "cookie"])
def test_a_container_named_for_something_else_stays_out(name):
    page = f"<body><div class='{name}'><p>{_PROSE[0]}</p><p>{_PROSE[1]}</p></div></body>"
    assert pages.main_text(page, pages.trained()) == ""
    beside = f"<body><div class='comment-list'><p>{_PROSE[0]}</p></div><article><p>{_PROSE[1]}</p><p>{_PROSE[2]}</p></article></body>"
    assert pages.main_text(beside, pages.trained()) == "\n".join(_PROSE[1:])
