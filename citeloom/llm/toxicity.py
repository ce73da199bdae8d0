"""Toxicity by a subsequence string kernel, a support vector machine and landmarks.

A text is looked at word by word. Two words are as alike as their common
subsequences of three letters, each worth less the farther it is spread, so letters
that are put in between or left out weaken a match but do not break it. The
kernel's Nyström landmarks are words of the labelled texts; on what words share
with them a linear support vector machine is trained. Labels are of texts: of a
toxic one, the word that the machine finds worst is its example, chosen anew in
each round; of others, every word is one, the worst first. A text is as toxic as
its worst word, on a scale calibrated on the labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.language import held_out
from citeloom.llm.words import LOWER, NOT_SPACE, joined, mix, pieces, spans

#: Worth of a subsequence for each place it is spread over; words are seen in windows of so many letters.
DECAY, WINDOW = 0.7, 24
#: Labelled texts learned from, of each label, and the most bytes of one.
SAMPLE, SAMPLE_BYTES = 3000, 20_000
#: Landmarks, rounds of choosing examples, and ordinary words that a round adds to them.
LANDMARKS, ROUNDS, ORDINARY = 256, 5, 2000
#: Examples, the most frequent ones, that are also learned with a letter too many or too few.
BENT = 200
#: Letters a to z, marks of other scripts by the low bits of their bytes, and the rim of a word.
_RIM, _LETTERS = 0, 43
_OTHER = 255
SYMBOL = np.full(256, _OTHER, np.uint8)
SYMBOL[97:123] = np.arange(1, 27)
SYMBOL[128:192] = 27 + np.arange(64) % 16
#: Labelled texts that are looked at together.
_TEXTS = 200
_MIX = mix(np.arange(1, WINDOW + 3, dtype=np.uint64))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of letters and rims, filled up with 255, and the text of each.

    A word is the letters between white space; what else it holds is passed over,
    and words of one letter that follow each other count as one. A long word is
    seen in windows that overlap by half.
    """
    body, at = joined(texts)
    begin, end, text = spans(body, at, NOT_SPACE)
    symbols = SYMBOL[LOWER[body]]
    letter = symbols != _OTHER
    total = np.concatenate([[0], np.cumsum(letter)])
    size = total[end] - total[begin]
    some = size > 0
    size, text, first = size[some], text[some], total[begin[some]]
    symbols = symbols[letter]
    if not len(size):
        return np.empty((0, WINDOW + 2), np.uint8), np.empty(0, np.int64)
    goes_on = np.zeros(len(size), bool)
    goes_on[1:] = (size[1:] == 1) & (size[:-1] == 1) & (text[1:] == text[:-1])
    head = np.flatnonzero(~goes_on)
    size, text, first = np.add.reduceat(size, head), text[head], first[head]
    half = WINDOW // 2
    windows = np.maximum(1, -(-(size - half) // half))
    of = np.repeat(np.arange(len(size)), windows)
    skip = (np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)) * half
    start, long = first[of] + skip, np.minimum(size[of] - skip, WINDOW)
    out = np.full((len(of), WINDOW + 2), _OTHER, np.uint8)
    out[:, 0] = out[np.arange(len(of)), long + 1] = _RIM
    rows = np.arange(len(of))
    for place in range(WINDOW):
        rows = rows[long[rows] > place]
        out[rows, place + 1] = symbols[start[rows] + place]
    return out, text[of]


def different(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows, and which of them each row is."""
    key = np.zeros(len(words), np.uint64)
    for i in range(words.shape[1]):
        key = mix(key ^ (words[:, i].astype(np.uint64) + _MIX[i]))
    _, first, of = np.unique(key, return_index=True, return_inverse=True)
    return words[first], of


def _by_size(words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the same length, in blocks, and their letters."""
    size = (words != _OTHER).sum(1)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        for at in range(0, len(rows), 1 << 14):
            part = rows[at : at + (1 << 14)]
            yield part, words[part, :n]


def subsequences(letters: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """Number of the three letters at each three places of all rows, and their worth."""
    x = letters.astype(np.int32)
    n = x.shape[1]
    for i in range(n):
        for j in range(i + 1, n):
            two = (x[:, i] * _LETTERS + x[:, j]) * _LETTERS
            for k in range(j + 1, n):
                yield two + x[:, k], DECAY ** (k - i + 1)


def norms(letters: np.ndarray) -> np.ndarray:
    """The square root of the kernel of each row with itself."""
    n = letters.shape[1]
    gap = np.arange(n)[:, None] - np.arange(n)
    before = np.where(gap > 0, DECAY ** np.maximum(gap - 1, 0), 0).astype(np.float32)
    same = (letters[:, :, None] == letters[:, None, :]) * np.float32(DECAY**2)
    ends = same
    for _ in range(2):
        # The matrices are their own transposes, so that one product serves both sides.
        ends = same * (before @ (ends @ before.T))
    return np.sqrt(ends.sum((1, 2)))


def landmark_kernel(words: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Normalised kernel of each word with each landmark, whose subsequences are given."""
    out = np.zeros((len(words), spread.shape[1]), np.float32)
    for rows, letters in _by_size(words):
        total = np.zeros((len(rows), spread.shape[1]), np.float32)
        for code, worth in subsequences(letters):
            total += np.float32(worth) * spread[code]
        out[rows] = total / norms(letters)[:, None]
    return out


def spread_of(marks: np.ndarray) -> np.ndarray:
    """Worth of each three letters in each word, of length one."""
    out = np.zeros((_LETTERS**3, len(marks)), np.float32)
    for rows, letters in _by_size(marks):
        long = norms(letters)
        for code, worth in subsequences(letters):
            np.add.at(out, (code, rows), np.float32(worth) / long)
    return out


class Machine(NamedTuple):
    """What each three letters weigh, the offset, and the scale of probabilities."""

    weights: np.ndarray
    offset: float
    slope: float
    shift: float

    def margins(self, words: np.ndarray) -> np.ndarray:
        """Distance of each word from the border.

        The sum over landmarks is taken beforehand: a kernel with a landmark is a
        product over subsequences, so the landmarks' weights add up to one weight
        for each three letters.
        """
        out = np.zeros(len(words), np.float32)
        for rows, letters in _by_size(words):
            total = np.zeros(len(rows), np.float32)
            for code, worth in subsequences(letters):
                total += np.float32(worth) * self.weights[code]
            out[rows] = total / norms(letters)
        return out + np.float32(self.offset)

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -700, 700)))


def _border(x: np.ndarray, y: np.ndarray, weight: np.ndarray, strength: float = 1e-5) -> np.ndarray:
    """A linear machine with squared hinge loss, by Newton steps; the last weight is the offset."""
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    weight = weight / weight.sum()
    keep = strength * np.eye(x.shape[1])
    keep[-1, -1] = 1e-9
    w = np.zeros(x.shape[1])
    for _ in range(30):
        inside = y * (x @ w) < 1
        left = x[inside] * weight[inside, None]
        new = np.linalg.solve(left.T @ x[inside] + keep, left.T @ y[inside])
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return w


def _calibrated(margin: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability of a margin, by logistic regression on smoothed labels."""
    n, m = toxic.sum(), (~toxic).sum()
    want = np.where(toxic, (n + 1) / (n + 2), 1 / (m + 2))
    x = np.column_stack([margin, np.ones(len(margin))]).astype(np.float64)
    weight = np.where(toxic, 0.5 / n, 0.5 / m)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ x + 1e-9 * np.eye(2)
        step = np.linalg.solve(curve, x.T @ (weight * (want - p)))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def _first_guess(words: np.ndarray, of: np.ndarray, text: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """How much oftener than by chance the most telling three neighbours of each word are in toxic texts."""
    x = words.astype(np.int64)
    code = (x[:, :-2] * _LETTERS + x[:, 1:-1]) * _LETTERS + x[:, 2:]
    none = _LETTERS**3
    code = np.where(words[:, 2:] == _OTHER, none, code)
    seen = np.zeros((2, none + 1), np.int64)
    for first in range(0, len(toxic), _TEXTS):
        mine = (text >= first) & (text < first + _TEXTS)
        at = code[of[mine]]
        some = at != none
        pairs = np.unique(np.repeat(text[mine], some.sum(1)) * none + at[some])
        label = toxic[pairs // none]
        for x in (0, 1):
            seen[x] += np.bincount(pairs[label == x] % none, minlength=none + 1)
    expected = (seen[0] + seen[1]) * toxic.mean()
    more = (seen[1] - expected) / np.sqrt(expected + 1)
    return more[code].max(1)


def _telling(of: np.ndarray, text: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each word's share of the toxic texts is thrice that of the others, and how many others have it."""
    seen = [np.bincount(of[toxic[text] == x], minlength=of.max() + 1) for x in (0, 1)]
    return seen[1] * (~toxic).sum() > 3 * seen[0] * toxic.sum(), seen[0]


def _bent(words: np.ndarray) -> np.ndarray:
    """Each word with a strange letter put in, with one doubled, and with one left out."""
    draw = np.random.default_rng(12)
    out = []
    for word in words:
        x = word[word != _OTHER][:-1]
        if len(x) < 5 or len(x) > WINDOW:
            continue
        at = draw.integers(2, len(x))
        strange = draw.integers(1, 27)
        for y in (np.insert(x, at, strange), np.insert(x, at, x[at]), np.delete(x, at)):
            row = np.full(WINDOW + 2, _OTHER, np.uint8)
            row[: len(y)], row[len(y)] = y, _RIM
            out.append(row)
    return np.array(out, np.uint8).reshape(-1, WINDOW + 2)


def _worst(margin: np.ndarray, of: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """The worst word of each text, -1 if it has none."""
    order = np.lexsort((of, margin[of], text))
    last = np.flatnonzero(np.diff(text[order], append=-1) != 0)
    out = np.full(texts, -1)
    out[text[order[last]]] = of[order[last]]
    return out


def _gathered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different words of all texts, and the word and text of each that occurs, text by text once."""
    words, of, text = [], [], []
    for first in range(0, len(texts), _TEXTS):
        rows, owner = words_of(texts.slice(first, _TEXTS))
        some, number = different(rows)
        pairs = np.unique(owner * max(len(some), 1) + number)
        of.append(pairs % max(len(some), 1) + sum(map(len, words)))
        text.append(pairs // max(len(some), 1) + first)
        words.append(some)
    words, same = different(np.concatenate(words))
    return words, same[np.concatenate(of)], np.concatenate(text)


def train(texts: pa.Array, toxic: np.ndarray) -> Machine | None:
    """Train on texts and their labels; None unless both labels have words."""
    words, of, text = _gathered(texts)
    if not toxic[text].any() or toxic[text].all():
        return None
    margin = _first_guess(words, of, text, toxic)
    telling, others = _telling(of, text, toxic)
    harmless = np.flatnonzero(others)
    frequent = harmless[np.argsort(-others[harmless], kind="stable")]
    ordinary = frequent[:ORDINARY]
    machine = None
    for _ in range(ROUNDS):
        worst = _worst(np.where(telling, margin, margin.min() - 1), of, text, len(texts))
        worst = np.where(telling[worst], worst, -1)
        examples, counts = np.unique(worst[toxic & (worst >= 0)], return_counts=True)
        # The worst ordinary words of each round stay among the examples.
        hard = harmless[np.argsort(-margin[harmless], kind="stable")[:ORDINARY]]
        ordinary = np.union1d(ordinary, hard)
        often = examples[np.argsort(-counts, kind="stable")]
        marks = [often[: LANDMARKS // 2], hard[: LANDMARKS // 4], frequent[: LANDMARKS // 4]]
        marks = words[np.unique(np.concatenate(marks))]
        # Nyström: coordinates in which products are the kernel, as far as landmarks tell.
        spread = spread_of(marks)
        value, axis = np.linalg.eigh(landmark_kernel(marks, spread).astype(np.float64))
        good = value > 1e-4
        turn = axis[:, good] / np.sqrt(value[good])
        bent = _bent(words[often[:BENT]])
        x = landmark_kernel(np.concatenate([words[examples], bent, words[ordinary]]), spread) @ turn
        y = np.where(np.arange(len(x)) < len(examples) + len(bent), 1.0, -1.0)
        parts = [counts / counts.sum(), np.full(len(bent), 0.5 / max(len(bent), 1))]
        weight = np.concatenate([*parts, np.full(len(ordinary), 1 / len(ordinary))])
        w = _border(x, y, weight)
        folded = spread @ (turn @ w[:-1]).astype(np.float32)
        machine = Machine(folded.astype(np.float32), float(w[-1]), 1.0, 0.0)
        margin = machine.margins(words)
    worst = _worst(margin, of, text, len(texts))
    reached = np.where(worst >= 0, margin[worst], machine.offset)
    slope, shift = _calibrated(reached, toxic)
    return machine._replace(slope=slope, shift=shift)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine | float:
    """A machine from at most ``sample`` labelled rows of each label, those of the smallest hashes.

    Texts of up to ``SAMPLE_BYTES`` are taken. If only one label is there, its
    number is the answer; 0 if there is none.
    """
    said = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    said = said.agg((F.max("toxic") > 0).alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.where(F.octet_length("text").between(1, SAMPLE_BYTES))
    known = rows.select("doc_id").join(said, "doc_id").where(~held_out())
    mark = F.xxhash64("doc_id")
    ids = [known.where(c).orderBy(mark, "doc_id").limit(sample) for c in ("toxic", "NOT toxic")]
    chosen = ids[0].unionAll(ids[1]).distinct()
    # The ids of a bounded sample.
    found = rows.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id", "text"), "doc_id")
    found = found.limit(2 * sample).select("text", "toxic").toArrow()
    toxic = found.column("toxic").to_numpy().astype(bool)
    machine = train(found.column("text").combine_chunks(), toxic) if len(toxic) else None
    if machine is None:
        return float(toxic.mean()) if len(toxic) else 0.0
    return machine


def judge(machine: Machine | float, texts: pa.Array) -> np.ndarray:
    """Probability that each text is toxic, from all of its words."""
    if not isinstance(machine, Machine):
        return np.full(len(texts), machine)
    rows, text = words_of(texts)
    words, of = different(rows)
    worst = np.full(len(texts), -np.inf)
    np.maximum.at(worst, text, machine.margins(words)[of])
    return machine.probability(np.where(np.isfinite(worst), worst, machine.offset))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``, from its whole text.

    Learned from rows of ``labels(doc_id, toxic)`` that are not held out; if a
    label repeats, toxic counts. A text without a letter, or null, has the score of
    a word that is like no landmark. Without labels all scores are 0. Other columns
    are not read; ids may repeat or be null (never held out); an empty table gives
    no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            score = judge(sent.value, part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = slim.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
