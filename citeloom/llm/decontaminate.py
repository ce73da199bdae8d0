"""Benchmark decontamination with a distributed positional inverted index.

The index is kept by document segments: each segment of a few million bytes has
the sorted terms of its documents and, for each term, all positions. A segment
needs nothing from another one, so building it moves no rows, and a term that
makes up a third of the corpus is spread over all segments.

A phrase is looked up from its rarest term in the segment: the positions of that
term, shifted to where the phrase would begin, are intersected with the shifted
positions of the next rarer term, and so on until none are left or all terms are
used. Proximity matches let the terms stand within a wider window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.shared import stored
from citeloom.llm.words import ALPHANUMERIC, pieces, words_of

WINDOW = 13
#: Words of benchmark text that are looked up at a time; more are taken in turn.
BLOCK_WORDS = 2_000_000
INDEX_SCHEMA = "doc_ids binary, first binary, terms binary, begins binary, positions binary"


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _pack_steps(values: np.ndarray) -> bytes:
    """Pack the steps from value to value, byte by byte of equal weight: mostly small."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return _pack(steps.view(np.uint8).reshape(len(values), values.itemsize).T)


def _unpack_steps(data: bytes, kind: type) -> np.ndarray:
    planes = _unpack(data, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


@dataclass
class Segment:
    """Documents of one index row: word positions run on from text to text."""

    number: int
    doc_ids: np.ndarray
    first: np.ndarray
    terms: np.ndarray
    begins: np.ndarray
    positions: np.ndarray

    def postings(self, term: np.uint64) -> np.ndarray:
        i = int(np.searchsorted(self.terms, term))
        if i == len(self.terms) or self.terms[i] != term:
            return np.empty(0, np.int32)
        return self.positions[self.begins[i] : self.begins[i + 1]]

    def counts(self, terms: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        if not len(self.terms):
            return np.zeros(len(terms), np.int64)
        found = self.terms[i] == terms
        return np.where(found, self.begins[i + 1] - self.begins[i], 0)


def build_index(docs: DataFrame) -> DataFrame:
    """Segments of the positional index over all texts of ``docs(doc_id, text)``.

    A null or empty text has no words but keeps its place, so every document is
    in exactly one segment. Further columns are ignored.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            words, first, _ = words_of(part.column("text"), ALPHANUMERIC)
            order = np.argsort(words, kind="stable").astype(np.int32)
            terms, begins = np.unique(words[order], return_index=True)
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            row = [
                _pack(ids.astype(np.int64)),
                _pack(first.astype(np.int32)),
                _pack_steps(terms),
                _pack_steps(np.append(begins, len(words)).astype(np.int32)),
                _pack_steps(order),
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], pa.binary()) for x in row],
                names=["doc_ids", "first", "terms", "begins", "positions"],
            )

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    segments = slim.where("doc_id IS NOT NULL").mapInArrow(build, INDEX_SCHEMA)
    return stored(segments.withColumn("segment", F.monotonically_increasing_id()), "index")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[Segment]:
    for batch in batches:
        for row in batch.to_pylist():
            yield Segment(
                row["segment"],
                _unpack(row["doc_ids"], np.int64),
                _unpack(row["first"], np.int32),
                _unpack_steps(row["terms"], np.uint64),
                _unpack_steps(row["begins"], np.int32).astype(np.int64),
                _unpack_steps(row["positions"], np.int32),
            )


def phrase_starts(segment: Segment, phrase: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions where the words of a phrase stand in a row, within one document.

    ``counts`` tells how often each word occurs in the segment.
    """
    starts = None
    for k in np.argsort(counts, kind="stable"):
        at = segment.postings(phrase[k]) - np.int32(k)
        starts = at if starts is None else starts[np.isin(starts, at, assume_unique=True)]
        if not len(starts):
            return starts
    doc = np.searchsorted(segment.first, starts, side="right")
    return starts[(starts >= 0) & (starts + len(phrase) <= segment.first[doc])]


def near_spans(segment: Segment, phrase: np.ndarray, width: int) -> np.ndarray:
    """Begin of each run of ``width`` words, in one document, that holds all the phrase's terms.

    Each run begins at an occurrence of one of the terms; order is free.
    """
    terms = np.unique(phrase)
    lists = [segment.postings(x) for x in terms]
    if not all(map(len, lists)):
        return np.empty(0, np.int64)
    starts = np.unique(np.concatenate(lists)).astype(np.int64)
    doc_end = segment.first[np.searchsorted(segment.first, starts, side="right")]
    for at in sorted(lists, key=len):
        i = np.searchsorted(at, starts)
        following = at[np.minimum(i, len(at) - 1)]
        good = (i < len(at)) & (following < np.minimum(starts + width, doc_end))
        starts, doc_end = starts[good], doc_end[good]
    return starts


def _windows(items: list[tuple[str, np.ndarray]], size: int) -> list[tuple[np.ndarray, list]]:
    """Each different window once, with the items that have it."""
    out: dict[bytes, tuple[np.ndarray, set[str]]] = {}
    for item, words in items:
        for k in range(max(1, len(words) - size + 1) if len(words) else 0):
            w = words[k : k + size]
            out.setdefault(w.tobytes(), (w, set()))[1].add(item)
    return [(w, sorted(ids)) for w, ids in out.values()]


#: A row's segment and its place there tell it from others of the same id.
MATCH_SCHEMA = (
    "segment long, place int, doc_id long, n_words long, "
    "spans array<struct<begin: int, end: int>>, items array<string>"
)


def _search_block(index: DataFrame, items: list, window: int, proximity: int | None) -> DataFrame:
    windows = _windows(items, window)
    every = np.unique(np.concatenate([np.empty(0, np.uint64), *[w for w, _ in windows]]))
    places = [(w, np.searchsorted(every, w), ids) for w, ids in windows]
    flat = np.concatenate([np.empty(0, np.int64), *[place for _, place, _ in places]])
    cuts = np.cumsum([0, *[len(place) for _, place, _ in places]])[:-1]
    sent = index.sparkSession.sparkContext.broadcast((every, places, flat, cuts))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment in _segments(batches):
            edge = np.zeros(int(segment.first[-1]) + 1, np.int32)
            found: dict[int, set[str]] = {}
            terms, places, flat, cuts = sent.value
            counts = segment.counts(terms)
            # Most phrases have a term that the segment lacks.
            rarest = np.minimum.reduceat(counts[flat], cuts) if len(flat) else flat
            for i in np.flatnonzero(rarest):
                phrase, place, ids = places[i]
                if proximity is None:
                    starts = phrase_starts(segment, phrase, counts[place])
                    width = len(phrase)
                else:
                    width = max(proximity, len(phrase))
                    starts = near_spans(segment, phrase, width)
                if len(starts):
                    docs = np.searchsorted(segment.first, starts, side="right")
                    np.add.at(edge, starts, 1)
                    np.subtract.at(edge, np.minimum(starts + width, segment.first[docs]), 1)
                    for d in np.unique(docs):
                        found.setdefault(int(d) - 1, set()).update(ids)
            hit = np.cumsum(edge[:-1]) > 0
            spans: list[list[dict]] = [[] for _ in segment.doc_ids]
            for d in found:
                a, b = segment.first[d], segment.first[d + 1]
                run = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b], [0]])))
                spans[d] = [
                    {"begin": int(x), "end": int(y)}
                    for x, y in zip(run[::2], run[1::2], strict=True)
                ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(spans), segment.number)),
                    pa.array(np.arange(len(spans), dtype=np.int32)),
                    pa.array(segment.doc_ids),
                    pa.array(np.diff(segment.first).astype(np.int64)),
                    pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
                    pa.array([sorted(found.get(d, ())) for d in range(len(spans))], pa.list_(pa.string())),
                ],
                names=["segment", "place", "doc_id", "n_words", "spans", "items"],
            )

    return index.mapInArrow(look, MATCH_SCHEMA)


def search(
    index: DataFrame, benchmark: DataFrame, window: int = WINDOW, proximity: int | None = None
) -> DataFrame:
    """Every document with its word count, the spans of its hit words, and the items found.

    ``benchmark(item_id, text)`` is the query set. It is taken in blocks of
    ``BLOCK_WORDS`` words, so that what is sent to the tasks has that bound
    however long the benchmark is; each block is looked up in every segment. A
    window is ``window`` item words in a row, or all words of a shorter item.
    With ``proximity`` its words may stand anywhere in a run of that many words.
    Items without words, or null, match nothing; equal items all count.
    """
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    block: list[tuple[str, np.ndarray]] = []
    held, parts = 0, []
    for row in rows.where("item_id IS NOT NULL").toLocalIterator():
        words, _, _ = words_of(pa.array([row["text"]], pa.string()), ALPHANUMERIC)
        if block and held + len(words) > BLOCK_WORDS:
            parts.append(stored(_search_block(index, block, window, proximity), "matches"))
            block, held = [], 0
        block.append((row["item_id"], words))
        held += len(words)
    last = _search_block(index, block, window, proximity)
    if not parts:
        return last.drop("segment", "place")
    for part in parts:
        last = last.unionByName(part)
    merged = last.groupBy("segment", "place").agg(
        F.first("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return merged.select("doc_id", "n_words", "spans", "items")


def covered(spans: str) -> F.Column:
    """Words inside at least one of the spans, which are sorted by their begin."""
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("upto"))
    return F.aggregate(
        F.col(spans),
        zero,
        lambda acc, x: F.struct(
            (
                acc["total"]
                + F.greatest(F.lit(0), x["end"] - F.greatest(x["begin"], acc["upto"]))
            ).alias("total"),
            F.greatest(acc["upto"], x["end"]).alias("upto"),
        ),
        lambda acc: acc["total"].cast("long"),
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    proximity: int | None = None,
    share: int = 20,
) -> DataFrame:
    """``doc_id, n_words, n_hit, spans, items, contaminated`` of every document.

    A document is contaminated if at least one word in ``share`` is inside an
    occurrence of a window. Documents that are null, empty or without words have
    no hits; repeated rows are judged one by one; rows without an id are left out;
    empty tables give no rows. Further columns are not read.
    """
    found = search(build_index(docs), benchmark, window, proximity)
    found = found.withColumn("n_hit", covered("spans"))
    return found.withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with all their columns.

    A row whose id is null is kept. Contaminated ids are few, so the texts are
    joined with those only, and Spark decides how.
    """
    bad = decontaminate(docs, benchmark, window).where("contaminated").select("doc_id").distinct()
    return docs.join(stored(bad, "contaminated"), "doc_id", "left_anti")
