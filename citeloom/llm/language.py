"""Language identification with a small byte convolutional network.

The network reads windows of bytes: an embedding, filters of several widths,
the maximum of each over the window, and a softmax. It is trained in numpy on a
bounded sample of labelled rows and applied to every window of every text; a
text's scores are the mean log-probabilities of its windows, weighted by length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.words import joined, pieces

#: Bytes of a window, numbers of an embedding, filter widths, filters of each.
WINDOW, DIM, WIDTHS, FILTERS = 256, 6, (2, 3, 4, 5), 8
#: Labelled windows that are learned from, for each language.
SAMPLE_PER_LANGUAGE = 1_500
#: Texts whose best language is less likely than this are rejected as unclear.
LEAST_SCORE = 0.34
UNKNOWN = "und"
_WIDE = max(WIDTHS)
_BATCH = 512


@dataclass
class Network:
    """Weights of a trained network; byte 0 fills windows up."""

    languages: list[str]
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray


def _columns(windows: np.ndarray, embedding: np.ndarray) -> np.ndarray:
    """Each position with the embeddings of the bytes that follow it, as one row."""
    x = embedding[np.pad(windows, ((0, 0), (0, _WIDE - 1)))]
    n, m, d = x.shape
    step = x.strides
    view = np.lib.stride_tricks.as_strided(
        x, (n, m - _WIDE + 1, _WIDE * d), (step[0], step[1], step[2]), writeable=False
    )
    return view.reshape(-1, _WIDE * d)


def _mask() -> np.ndarray:
    """Which weights a filter of each width may use."""
    mask = np.zeros((_WIDE * DIM, len(WIDTHS) * FILTERS), np.float32)
    for i, width in enumerate(WIDTHS):
        mask[: width * DIM, i * FILTERS : (i + 1) * FILTERS] = 1
    return mask


def _pooled(net: Network, windows: np.ndarray) -> np.ndarray:
    y = _columns(windows, net.embedding) @ net.filters
    y = y.reshape(len(windows), -1, net.filters.shape[1]).max(1)
    return np.maximum(y + net.bias, 0)


def log_probabilities(net: Network, windows: np.ndarray) -> np.ndarray:
    """Log-probability of each language for each window of bytes."""
    out = []
    for i in range(0, len(windows), _BATCH):
        z = _pooled(net, windows[i : i + _BATCH]) @ net.dense + net.dense_bias
        z -= z.max(1, keepdims=True)
        out.append(z - np.log(np.exp(z).sum(1, keepdims=True)))
    return np.concatenate(out) if out else np.empty((0, len(net.languages)), np.float32)


def train(
    windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 12, seed: int = 7
) -> Network:
    """Fit a network to labelled windows with Adam; the same input gives the same weights."""
    rng = np.random.default_rng(seed)
    mask = _mask()
    n_filters = mask.shape[1]
    weights = [
        rng.normal(0, 0.5, (256, DIM)),
        rng.normal(0, 0.2, mask.shape) * mask,
        np.zeros(n_filters),
        rng.normal(0, 0.2, (n_filters, len(languages))),
        np.zeros(len(languages)),
    ]
    weights = [w.astype(np.float32) for w in weights]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step, size = 0, 32
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), size):
            pick = order[at : at + size]
            batch, want = windows[pick], labels[pick]
            cols = _columns(batch, weights[0])
            y = (cols @ weights[1]).reshape(len(batch), -1, n_filters)
            where = y.argmax(1)
            raw = np.take_along_axis(y, where[:, None], 1)[:, 0] + weights[2]
            act = np.maximum(raw, 0)
            z = act @ weights[3] + weights[4]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(want)), want] -= 1
            p /= len(want)
            g_act = (p @ weights[3].T) * (raw > 0)
            # Only the position of each maximum takes part.
            rows = where + np.arange(len(batch))[:, None] * y.shape[1]
            seen = cols[rows.ravel()].reshape(len(batch), n_filters, -1)
            g_filters = np.einsum("bfc,bf->cf", seen, g_act) * mask
            g_cols = np.einsum("bf,cf->bfc", g_act, weights[1]).reshape(-1, _WIDE, DIM)
            place = where[:, :, None] + np.arange(_WIDE)
            bytes_at = np.take_along_axis(
                np.pad(batch, ((0, 0), (0, _WIDE - 1)))[:, None], place, 2
            )
            g_embedding = np.zeros_like(weights[0])
            np.add.at(g_embedding, bytes_at.ravel(), g_cols.reshape(-1, DIM))
            grads = [g_embedding, g_filters, g_act.sum(0), act.T @ p, p.sum(0)]
            step += 1
            for w, g, m, v in zip(weights, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 0.004 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            weights[1] *= mask
    return Network(languages, *weights)


def cut_windows(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, the text of each, and how many bytes each has.

    Windows follow each other without a gap; the last one is filled with zeros.
    """
    sizes = np.diff(at)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = at[:-1][owner] + nth * WINDOW
    length = np.minimum(at[1:][owner] - begin, WINDOW)
    index = np.minimum(begin[:, None] + np.arange(WINDOW), max(len(body) - 1, 0))
    windows = np.where(np.arange(WINDOW) < length[:, None], body[index], 0) if len(owner) else (
        np.empty((0, WINDOW), np.uint8)
    )
    return windows.astype(np.uint8), owner, length


def held_out(modulus: int = 5) -> Column:
    """Rows that are never learned from: the CRC of the id, as text, divides."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 0


def learn(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Network | None:
    """Train on at most ``per_language`` windows of each label of the labelled rows given.

    A row gives one window, from a place that a hash of its text picks; the rows
    of the smallest hashes are taken. No labels, no network.
    """
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    mark = F.xxhash64("doc_id", "text")
    size = F.greatest(F.octet_length("text") - F.lit(WINDOW), F.lit(0))
    begin = F.pmod(mark, size + 1).cast("int") + 1
    from_there = F.substr(F.col("text").cast("binary"), begin, F.lit(WINDOW))
    rows = rows.select("lang", mark.alias("mark"), from_there.alias("bytes"))
    # Labels are few. All rows are counted, and of each label only about twice the
    # sample is moved, so the ranking stays small however many rows there are.
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    shares = [(F.lit(k), F.lit(2.0 * per_language / n)) for k, n in sorted(counts.items())]
    share = F.create_map(*[x for pair in shares for x in pair])[F.col("lang")]
    few = rows.where(F.pmod(F.xxhash64("mark"), F.lit(1 << 30)) < share * F.lit(float(1 << 30)))
    ranked = few.selectExpr(
        "*", "row_number() OVER (PARTITION BY lang ORDER BY mark, bytes) AS nth"
    )
    sample = ranked.where(F.col("nth") <= per_language).select("lang", "mark", "bytes").toPandas()
    if not len(sample):
        return None
    sample = sample.sort_values(["lang", "mark"], kind="stable")
    languages = sorted(set(sample["lang"]))
    windows = np.zeros((len(sample), WINDOW), np.uint8)
    for i, data in enumerate(sample["bytes"]):
        windows[i, : len(data)] = np.frombuffer(bytes(data), np.uint8)
    labels = np.array([languages.index(x) for x in sample["lang"]])
    return train(windows, labels, languages)


def judge(net: Network | None, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of each text's language (0 if unknown, else from 1) and its probability."""
    n = len(texts)
    if net is None:
        return np.zeros(n, np.int64), np.zeros(n)
    letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False)
    known = letters.to_numpy(zero_copy_only=False)
    body, at = joined(texts)
    windows, owner, length = cut_windows(body, at)
    total = np.zeros((n, len(net.languages)))
    np.add.at(total, owner, log_probabilities(net, windows) * length[:, None])
    mean = total / np.maximum(np.diff(at), 1)[:, None]
    p = np.exp(mean - mean.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    return np.where(known, p.argmax(1) + 1, 0), np.where(known, p.max(1), 0.0)


PREDICTION_SCHEMA = "doc_id long, lang_pred string, score double"


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row, from its whole text.

    ``und`` with score 0 if the text is null or has no letter, or if there is no
    network. Other columns are not read. Ids may repeat or be null.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        names = np.array([UNKNOWN, *(net.languages if net else [])], object)
        for part in pieces(batches):
            best, score = judge(net, part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score)],
                names=["doc_id", "lang_pred", "score"],
            )

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(run, PREDICTION_SCHEMA)


def _learned(docs: DataFrame) -> Network | None:
    """The network of the rows that are not held out."""
    return learn(docs.where(~F.coalesce(held_out(), F.lit(True))))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out and predict all: adds ``held_out``."""
    found = predict(docs, _learned(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def clear_documents(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents with a clear language, with all their columns as they were.

    Rejected are texts that are null or without a letter, and those whose best
    language is less likely than ``least``; without any label, nothing is known
    and nothing is rejected but texts without a letter. The whole rows pass
    through the tasks, so nothing is joined or moved.
    """
    net = _learned(docs)
    if net is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            best, score = judge(sent.value, part.column("text"))
            yield part.filter(pa.array((best > 0) & (score >= least)))

    return docs.mapInArrow(run, docs.schema)
