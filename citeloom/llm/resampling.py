"""Importance resampling towards a target text distribution.

Words and runs of words are hashed into buckets. Two arrays of counts, of the corpus
and of the target text, give each bucket a gain, and a document's weight is the sum
of its gains. Gumbel noise that a hash of the id seeds turns the highest scores into
a draw without replacement. The lowest drawn key is found by a distributed
quickselect: random pivots, exact counts before and at each, and on with the span
that holds the key. Only the drawn rows are sorted and ranked.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.shared import stored
from citeloom.llm.words import ALPHANUMERIC, LOWER, joined, pieces, spans

BUCKETS = 10_000
#: Pivots of one round of the quickselect.
PIVOTS = 24
#: Words of more bytes are hashed one by one.
_LONG = 256
_SEED, _RANGE = "2024:", 4294967296.0
#: Rows of one partition are numbered from here on (``monotonically_increasing_id``).
_PLACE_BITS = 33


def _crc_table() -> np.ndarray:
    """CRC-32 of each byte, by the rule of the reflected polynomial 0xEDB88320."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


_TABLE = _crc_table()


def _extended(body: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """CRC states carried on over a span of bytes each, longest spans first."""
    size = end - begin
    order = np.argsort(-size, kind="stable")
    out, at, size = state[order], begin[order], size[order]
    long = int(np.searchsorted(-size, -_LONG, side="left"))
    for i in range(long):
        span = body[at[i] : at[i] + size[i]].tobytes()
        out[i] = zlib.crc32(span, int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    rest, at, size = out[long:], at[long:], size[long:]
    for k in range(int(size[0]) if len(size) else 0):
        m = int(np.searchsorted(-size, -(k + 1), side="right"))
        rest[:m] = _TABLE[(rest[:m] ^ body[at[:m] + k]) & 255] ^ (rest[:m] >> 8)
    back = np.empty_like(out)
    back[order] = out
    return back


def run_buckets(
    texts: pa.Array, order: int, buckets: int
) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text; and for runs of 1, 2, ... words their buckets and texts.

    A run is its words in lower case with one space between.
    """
    body, at = joined(texts)
    begin, end, text = spans(body, at, ALPHANUMERIC)
    body = LOWER[body]
    words = np.bincount(text, minlength=len(at) - 1)
    state = np.full(len(begin), 0xFFFFFFFF, np.uint32)
    out = []
    for n in range(order):
        if n:
            # A run goes on with the n-th word after its first, within its text.
            state = state[: len(begin) - n]
            inside = text[: len(state)] == text[n : n + len(state)]
            state = _TABLE[(state ^ 32) & 255] ^ (state >> 8)
            state = _extended(body, begin[n:], end[n:], state)
        else:
            state = _extended(body, begin, end, state)
            inside = np.ones(len(state), bool)
        crc = (~state[inside]).astype(np.int64)
        out.append((crc % buckets, text[: len(state)][inside]))
    return words, out


def bucket_counts(texts: DataFrame, order: int = 1, buckets: int = BUCKETS) -> list[int]:
    """Features of all texts in each bucket; a task sends one row per bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in pieces(batches):
            for bucket, _ in run_buckets(part.column("text"), order, buckets)[1]:
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    slim = texts.select(F.col("text").cast("string"))
    rows = slim.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for row in rows.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> np.ndarray:
    """What a feature of each bucket adds to a weight, in thousandths, rounded down."""
    n, many, wanted = len(corpus), sum(corpus), sum(target)
    ratio = ((t + 1) * (many + n) / ((s + 1) * (wanted + n)) for s, t in zip(corpus, target, strict=True))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, order: int = 1) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row, from its whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for part in pieces(batches):
            words, runs = run_buckets(part.column("text"), order, len(gain))
            features, weight = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            for bucket, text in runs:
                features += np.bincount(text, minlength=len(words))
                # Sums are kept whole: bincount would add doubles.
                total = np.concatenate([[0], np.cumsum(gain[bucket])])
                first = np.searchsorted(text, np.arange(len(words) + 1))
                weight += np.diff(total[first])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (words, features, weight))],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise() -> Column:
    """Gumbel noise in thousandths, rounded down, from a hash of the id (null as empty)."""
    key = F.concat(F.lit(_SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(_RANGE))))


# A row's place in the draw: by score, then id (a null id first), then features, so
# that rows of one place are alike in all that is returned.
_KEY = ("down", "known", "id", "n_features")


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "down": -F.col("score"),
            "known": F.col("doc_id").isNotNull().cast("long"),
            "id": F.coalesce("doc_id", F.lit(0).cast("long")),
        }
    )


def _before(key: tuple[int, ...], columns: tuple[str, ...] = _KEY) -> Column:
    """Whether a row comes before a key."""
    first, rest = F.col(columns[0]), columns[1:]
    ahead = first < F.lit(key[0])
    return ahead | ((first == F.lit(key[0])) & _before(key[1:], rest)) if rest else ahead


def _at(key: tuple[int, ...]) -> Column:
    return functools.reduce(Column.__and__, (F.col(c) == F.lit(v) for c, v in zip(_KEY, key, strict=True)))


def _counts(rows: DataFrame, keys: list[tuple[int, ...]]) -> tuple[list[int], list[int]]:
    """How many rows come before each of the sorted keys, and how many have it.

    A task sends one row per span between the keys and one per key, at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * len(keys) + 1, np.int64)
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in _KEY]
            slot = np.zeros(batch.num_rows, np.int64)
            for key in keys:
                above, same = np.zeros(len(slot), bool), np.ones(len(slot), bool)
                for column, value in zip(columns, key, strict=True):
                    above |= same & (column > value)
                    same &= column == value
                slot += 2 * above + same
            total += np.bincount(slot, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["slot", "n"])

    slots = rows.select(*_KEY).mapInArrow(run, "slot long, n long")
    found = {r["slot"]: r["n"] for r in slots.groupBy("slot").agg(F.sum("n").alias("n")).collect()}
    counts = [found.get(i, 0) for i in range(2 * len(keys) + 1)]
    return [sum(counts[: 2 * i + 1]) for i in range(len(keys))], counts[1::2]


def kth_key(rows: DataFrame, k: int, pivots: int = PIVOTS) -> tuple[tuple[int, ...], int, int]:
    """The key of the k-th row (from 1), how many rows come before it, and how many have it.

    ``rows`` has the key columns and at least k rows. Each round takes the rows of
    the smallest hashes in the span as pivots, whose order is random, and counts
    exactly, so that the span shrinks by the number of pivots on average.
    """
    span, passed, turn = F.lit(True), 0, 0
    while True:
        inside = rows.where(span)
        drawn = inside.select(*_KEY).orderBy(F.xxhash64(*_KEY, F.lit(turn)), *_KEY).limit(pivots)
        keys = sorted({tuple(r) for r in drawn.collect()})
        low, ahead = None, 0
        for key, before, equal in zip(keys, *_counts(inside, keys), strict=True):
            if passed + before >= k:
                span &= _before(key)
                break
            if passed + before + equal >= k:
                return key, passed + before, equal
            low, ahead = key, before + equal
        if low is not None:
            span &= ~_before(low) & ~_at(low)
        passed += ahead
        turn += 1


def _ranked(spark: SparkSession, drawn: DataFrame) -> DataFrame:
    """The drawn rows with their rank, sorted in ranges and numbered on from range to range."""
    placed = stored(drawn.orderBy(*_KEY).withColumn("place", F.monotonically_increasing_id()), "drawn")
    part = F.shiftright("place", _PLACE_BITS)
    sizes = sorted(tuple(r) for r in placed.groupBy(part).count().collect())
    starts, total = [], 0
    for number, size in sizes:
        starts.append((number, total))
        total += size
    begin = spark.createDataFrame(starts, "part long, begin long")
    inside = F.col("place").bitwiseAND((1 << _PLACE_BITS) - 1)
    # One row per partition.
    out = placed.withColumn("part", part).join(F.broadcast(begin), "part")
    return out.withColumn("rank", F.col("begin") + inside + 1)


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    least_words: int = 20,
    order: int = 1,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` (long) of every row of ``docs``.

    Of the rows with at least ``least_words`` words, ``percent`` in a hundred are
    drawn towards the word runs of ``target(text)``, those of the highest scores,
    ties to the smaller id, and ranked from 1; the others' rank is null. A null
    text has no words. Rows that share an id are drawn one by one. A null id has
    the noise of an empty one and comes first among ties. Other columns are not
    read; an empty table gives no rows, an empty target is uniform.
    """
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, order, buckets), bucket_counts(target, order, buckets))
    rows = weighted(docs, gain, order).withColumn("score", F.col("weight") + noise())
    rows = stored(_keyed(rows), "scored")
    long_enough = F.col("n_words") >= least_words
    fit = rows.where(long_enough)
    k = fit.count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not k:
        return rows.select(*columns, none)
    key, ahead, equal = kth_key(fit, k)
    # Rows of the last key are alike; as many of them are drawn as are still wanted.
    last = fit.where(_at(key)).limit(1)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(equal).cast("long")))
    last = last.withColumn("copy", copies)
    taken, over = (last.where(x).drop("copy") for x in (F.col("copy") <= k - ahead, F.col("copy") > k - ahead))
    drawn = fit.where(_before(key)).unionByName(taken)
    left = rows.where(~long_enough | (~_before(key) & ~_at(key))).unionByName(over)
    ranked = _ranked(spark, drawn).select(*columns, "rank")
    return ranked.unionByName(left.select(*columns, none))
