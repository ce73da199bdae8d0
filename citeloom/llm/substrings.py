"""Removal of repeated substrings by sorting sampled positions of all texts.

A difference cover picks positions so that two equal substrings of a given
length always hold picked positions at the same offset; only picked positions
are sorted and named, and all others follow from the picked one next to them.
Here the cover is chosen by content (a string synchronising set): of every 26
strings of 25 bytes in a row, the one with the least hash is picked. Any two
equal strings of 50 bytes pick the same offset, and one position in 13 is
picked, where a cover by residues would move a multiple of all positions.

1. Sample: the picked positions of every text, named by the hash of 25 bytes.
2. Recurse on the names: those that stand in one document only cannot be part of
   a repetition, and drop out.
3. Merge: around each position left, the 50-byte strings that picked it follow
   from their offset; they are sorted by name, offset and content.
4. Compare neighbours in that order, byte by byte; each run of equal strings has
   its first document, and all others lose the bytes it covers.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.shared import shard_of, shards_for, text_bytes, work_dir
from citeloom.llm.words import _SYMBOLS, joined, mix, pieces

LENGTH = 50
NAME = 25
#: Offsets of a string from the position it picks: 0 to 25 bytes before it.
REACH = LENGTH - NAME + 1
#: Bytes around a picked position that hold all strings which may pick it.
CONTEXT = LENGTH + REACH - 1
_BLOCK = 1 << 15
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _join(left: np.ndarray, right: np.ndarray, k: int) -> np.ndarray:
    """Hash of two neighbouring strings from their hashes."""
    z = (left ^ (left >> np.uint64(29))) * _M[k % 3] + right
    return z ^ (z >> np.uint64(32))


def _gram_hashes(x: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of all strings of 1, 2, 4, ... 32 symbols along the last axis."""
    out = {1: x}
    for k, size in enumerate((1, 2, 4, 8, 16)):
        if x.shape[-1] < 2 * size:
            break
        h = out[size]
        out[2 * size] = _join(h[..., :-size], h[..., size:], k)
    return out


def picked(
    body: np.ndarray, at: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Picked position of every 50-byte string, as runs.

    Gives for each run of strings that pick the same position: that position, the
    hash that names it, the first string of the run, and how many strings it has.
    No string crosses a text.
    """
    n = len(body) - LENGTH + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none.astype(np.uint64), none, none
    runs = []
    last = (-1, False)
    for i in range(0, n, _BLOCK):
        m = min(_BLOCK, n - i)
        g = _gram_hashes(_SYMBOLS[body[i : i + m + LENGTH - 1]])
        size = m + REACH - 1
        h = mix(_join(_join(g[16][:size], g[8][16 : 16 + size], 1), g[1][24 : 24 + size], 2))
        # The hash, then the place, decide; places fit below the hash's high bits.
        low = (h & ~np.uint64(0xFFFF)) | np.arange(size, dtype=np.uint64)
        for step in (1, 2, 4, 8):
            low = np.minimum(low[:-step], low[step:])
        low = np.minimum(low[:m], low[REACH - 16 : REACH - 16 + m])
        place = (low & np.uint64(0xFFFF)).astype(np.int64)
        here = np.arange(i, i + m)
        inside = here + LENGTH <= at[np.searchsorted(at, here, side="right")]
        start = np.ones(m, bool)
        start[1:] = (place[1:] != place[:-1]) | (inside[1:] != inside[:-1])
        start[0] = (place[0] + i, inside[0]) != last
        last = (place[-1] + i, inside[-1])
        runs.append((place[start] + i, h[place[start]], here[start], inside[start]))
    where, name, first, inside = (np.concatenate(x) for x in zip(*runs, strict=True))
    count = np.diff(np.append(first, n))
    return where[inside], name[inside], first[inside], count[inside]


def _split(order_by: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each different shard number and the rows that go there."""
    order = np.argsort(order_by, kind="stable")
    cut = np.flatnonzero(np.diff(order_by[order], prepend=-1))
    for s, e in zip(cut, np.append(cut[1:], len(order)), strict=True):
        yield int(order_by[order[s]]), order[s:e]


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _texts(docs: DataFrame, table: str, buckets: int) -> DataFrame:
    """The texts in pieces of a few million bytes, stored in buckets of the piece number.

    Later steps read a piece together with what other pieces answered; as the
    table is dealt by piece, its texts are not moved for that.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            body, at = joined(part.column("text"))
            ids = part.column("doc_id").to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], pa.binary()) for x in (_pack(ids), _pack(at), _pack(body))],
                names=["doc_ids", "at", "body"],
            )

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    packed = slim.where("doc_id IS NOT NULL").mapInArrow(
        pack, "doc_ids binary, at binary, body binary"
    )
    packed = packed.withColumn("piece", F.monotonically_increasing_id())
    spark = docs.sparkSession
    path = work_dir(spark, "texts")
    writer = packed.write.option("path", path).bucketBy(buckets, "piece")
    writer.option("compression", "uncompressed").saveAsTable(table)
    return spark.table(table)


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, where texts begin, and the bytes of a piece."""
    return (
        np.frombuffer(_unpack(row["doc_ids"]), np.int64),
        np.frombuffer(_unpack(row["at"]), np.int64),
        np.frombuffer(_unpack(row["body"]), np.uint8),
    )


def _named(row: dict) -> tuple[np.ndarray, ...]:
    """A piece with its picked positions: its different names and the documents of each."""
    ids, at, body = _opened(row)
    position, name, first, count = picked(body, at)
    doc = ids[np.searchsorted(at, position, side="right") - 1]
    order = np.argsort(name, kind="stable")
    begin = np.flatnonzero(np.diff(name[order], prepend=~name[order[:1]]))
    return body, position, name, first, count, doc, order, begin


_REPLY = "piece long, shard int, payload binary"


def _shared_names(texts: DataFrame, shards: int) -> DataFrame:
    """Which names of a piece stand in more than one document: a bit for each, by shard.

    A piece sends each name once, with the smallest and largest document it stands
    in, so a frequent name does not weigh more than a rare one.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, _, name, _, _, doc, order, begin = _named(row)
                if not len(begin):
                    continue
                one = name[order[begin]]
                low, high = (f.reduceat(doc[order], begin) for f in (np.minimum, np.maximum))
                shard, packed = [], []
                for s, rows in _split(shard_of(one, shards)):
                    # Mostly both documents are one; only the others have two numbers.
                    two = low[rows] != high[rows]
                    data = _pack(one[rows], low[rows], two, high[rows][two])
                    shard.append(s)
                    packed.append(np.int64(len(rows)).tobytes() + data)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["piece"]] * len(shard), pa.int64()),
                        pa.array(shard, pa.int32()),
                        pa.array(packed, pa.binary()),
                    ],
                    names=["piece", "shard", "payload"],
                )

    def meet(table: pa.Table) -> pa.Table:
        names, lows, highs = [], [], []
        for data in table.column("payload").to_pylist():
            n = int(np.frombuffer(data[:8], np.int64)[0])
            raw = _unpack(data[8:])
            names.append(np.frombuffer(raw, np.uint64, n))
            low = np.frombuffer(raw, np.int64, n, 8 * n)
            two = np.frombuffer(raw, bool, n, 16 * n)
            high = low.copy()
            high[two] = np.frombuffer(raw[17 * n :], np.int64)
            lows.append(low)
            highs.append(high)
        sizes = [len(x) for x in names]
        name, low, high = (np.concatenate(x) for x in (names, lows, highs))
        order = np.argsort(name, kind="stable")
        new = np.diff(name[order], prepend=~name[order[:1]]) != 0
        begin = np.flatnonzero(new)
        apart = np.minimum.reduceat(low[order], begin) != np.maximum.reduceat(high[order], begin)
        shared = np.empty(len(name), bool)
        shared[order] = apart[np.cumsum(new) - 1]
        bits = [
            _pack(np.packbits(x)) if x.any() else None
            for x in np.split(shared, np.cumsum(sizes)[:-1])
        ]
        return table.set_column(2, "payload", pa.array(bits, pa.binary())).filter(
            pa.array([x is not None for x in bits])
        )

    sent = texts.select("piece", "doc_ids", "at", "body").mapInArrow(send, _REPLY)
    return sent.groupBy("shard").applyInArrow(meet, _REPLY)


_MAIL = "piece long, shard int, to long, payload binary"


def _contexts(texts: DataFrame, shared: DataFrame, shards: int) -> DataFrame:
    """What surrounds each shared name, sent to the name's shard, and a note to the piece itself.

    Equal surroundings in one piece are sent once, with their smallest document.
    The note (no shard) tells, for every occurrence, which of the sent ones it is.
    """

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int | None, bytes]] = []
        piece = 0
        if len(left) and len(right):
            row = left.to_pylist()[0]
            piece = row["piece"]
            body, position, name, first, count, doc, order, begin = _named(row)
            one = name[order[begin]]
            bits = dict(
                zip(right.column("shard").to_pylist(), right.column("payload").to_pylist(), strict=True)
            )
            good = np.zeros(len(one), bool)
            for s, rows in _split(shard_of(one, shards)):
                if s in bits:
                    flags = np.unpackbits(np.frombuffer(_unpack(bits[s]), np.uint8))
                    good[rows] = flags[: len(rows)].astype(bool)
            mine = np.zeros(len(name), bool)
            sizes = np.diff(np.append(begin, len(name)))
            mine[order] = np.repeat(good, sizes)
            position, name, first, count, doc = (x[mine] for x in (position, name, first, count, doc))
            # The bytes from the first string's begin to the last one's end, the name at REACH - 1.
            lead = REACH - 1 - (position - first)
            length = count + LENGTH - 1
            shape = np.arange(CONTEXT)
            around = np.zeros((len(first), CONTEXT), np.uint8)
            for i in range(0, len(first), 1 << 13):
                f, d, n = (x[i : i + (1 << 13), None] for x in (first, lead, length))
                inside = (shape >= d) & (shape < d + n)
                take = np.clip(f - d + shape, 0, len(body) - 1)
                around[i : i + (1 << 13)] = np.where(inside, body[take], 0)
            head = np.stack([lead, count], 1).astype(np.uint8)
            key = np.concatenate([around, head], 1)
            group, head_row = _equal_rows(key, doc)
            target = shard_of(mix(name[head_row]), shards)
            number = np.empty(len(head_row), np.int32)
            at_shard = np.empty(len(head_row), np.int32)
            for s, rows in _split(target):
                number[rows], at_shard[rows] = np.arange(len(rows)), s
                pick = head_row[rows]
                out.append((s, _pack(np.array([len(rows)]), doc[pick], key[pick])))
            first_doc = doc[head_row][group]
            out.append(
                (
                    None,
                    _pack(
                        np.array([len(name)]), first, count, at_shard[group], number[group], doc != first_doc
                    ),
                )
            )
        return pa.table(
            {
                "piece": pa.array([piece] * len(out), pa.int64()),
                "shard": pa.array([x[0] for x in out], pa.int32()),
                "to": pa.array([-1 - piece if x[0] is None else x[0] for x in out], pa.int64()),
                "payload": pa.array([x[1] for x in out], pa.binary()),
            }
        )

    return texts.groupBy("piece").cogroup(shared.groupBy("piece")).applyInArrow(send, _MAIL)


def _row_hash(rows: np.ndarray) -> np.ndarray:
    """A hash of each row of bytes."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    out = np.zeros(len(rows), np.uint64)
    for column in wide.view(np.uint64).T:
        out = mix(out * _M[0] + column)
    return out


def _equal_rows(rows: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of equal rows that each row is in, and each group's row of the first document."""
    order = np.lexsort((doc, _row_hash(rows)))
    ordered = rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(1)
    group = np.empty(len(rows), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, order[new]


def _strings(around: np.ndarray, lead: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, begin and hash of all 50-byte strings in the given surroundings."""
    rows, begins, found = [], [], []
    for i in range(0, len(around), 2048):
        part = around[i : i + 2048]
        g = _gram_hashes(_SYMBOLS[part])
        n = CONTEXT - LENGTH + 1
        h = mix(_join(_join(g[32][:, :n], g[16][:, 32 : 32 + n], 1), g[2][:, 48 : 48 + n], 2))
        where = np.arange(n)
        lo, c = lead[i : i + 2048, None], count[i : i + 2048, None]
        r, b = np.nonzero((where >= lo) & (where < lo + c))
        rows.append(r + i)
        begins.append(b)
        found.append(h[r, b])
    return np.concatenate(rows), np.concatenate(begins), np.concatenate(found)


def _repeated(mail: DataFrame) -> DataFrame:
    """For each surrounding sent, a bit for each string that stands in a smaller document.

    Notes pass by, so that what was sent is made and moved only once.
    """

    def meet(table: pa.Table) -> pa.Table:
        to = table.column("to")[0].as_py()
        table = table.select(["piece", "shard", "payload"])
        if to < 0:
            return table
        docs, keys, sizes = [], [], []
        for data in table.column("payload").to_pylist():
            raw = _unpack(data)
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            docs.append(np.frombuffer(raw, np.int64, n, 8))
            keys.append(np.frombuffer(raw, np.uint8, offset=8 + 8 * n).reshape(n, CONTEXT + 2))
            sizes.append(n)
        doc, key = np.concatenate(docs), np.concatenate(keys)
        # Equal surroundings of different pieces count once, with their first document;
        # all strings of the others stand in that one too.
        group, head = _equal_rows(key, doc)
        mine, key = doc[head], key[head]
        around = np.ascontiguousarray(key[:, :CONTEXT])
        lead, count = key[:, CONTEXT].astype(np.int64), key[:, CONTEXT + 1].astype(np.int64)
        row, begin, found = _strings(around, lead, count)
        order = np.argsort(found)
        row, begin, found = row[order], begin[order], found[order]
        # Neighbours are compared byte by byte: a hash alone decides nothing.
        new = np.ones(len(row), bool)
        new[1:] = found[1:] != found[:-1]
        again = np.flatnonzero(~new)
        shape = np.arange(LENGTH)
        for i in range(0, len(again), 1 << 15):
            k = again[i : i + (1 << 15)]
            this = around[row[k][:, None], begin[k][:, None] + shape]
            other = around[row[k - 1][:, None], begin[k - 1][:, None] + shape]
            new[k] = (this != other).any(1)
        least = np.minimum.reduceat(mine[row], np.flatnonzero(new))[np.cumsum(new) - 1]
        gone = least < mine[row]
        masks = np.zeros(len(mine), np.uint32)
        np.bitwise_or.at(masks, row[gone], np.uint32(1) << (begin - lead[row])[gone].astype(np.uint32))
        masks = np.where(doc > mine[group], np.uint32(0xFFFFFFFF), masks[group])
        packed = [_pack(x) for x in np.split(masks, np.cumsum(sizes)[:-1])]
        return table.set_column(2, "payload", pa.array(packed, pa.binary()))

    return mail.groupBy("to").applyInArrow(meet, _REPLY)


RESULT_SCHEMA = (
    "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
    "spans array<struct<begin: long, end: long>>"
)


def repeated_substrings(docs: DataFrame) -> DataFrame:
    """Bytes of each text that an earlier document already has in strings of 50 bytes.

    Gives ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` for every
    row of ``docs(doc_id, text)``. Texts are their UTF-8 bytes, null is empty. A
    byte goes if a 50-byte string covers it that also begins in a document with a
    smaller id; overlaps count. Spans are the maximal runs of removed bytes.

    Texts under 50 bytes lose nothing. Rows with an equal id do not repeat each
    other. Rows without an id are left out; further columns are not read.
    """
    spark = docs.sparkSession
    shards = shards_for(text_bytes(docs))
    table = f"texts_{uuid.uuid4().hex}"
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = _texts(docs, table, buckets)
    shared = _shared_names(texts, shards)
    answers = _repeated(_contexts(texts, shared, shards))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        columns: list[list] = [[] for _ in range(6)]
        for row in left.to_pylist():
            ids, at, body = _opened(row)
            edge = np.zeros(len(body) + 1, np.int32)
            masks, note = {}, None
            for s, data in zip(
                right.column("shard").to_pylist(), right.column("payload").to_pylist(), strict=True
            ):
                if s is None:
                    note = _unpack(data)
                else:
                    masks[s] = np.frombuffer(_unpack(data), np.uint32)
            if note is not None:
                n = int(np.frombuffer(note, np.int64, 1)[0])
                first, count = np.frombuffer(note, np.int64, 2 * n, 8).reshape(2, n)
                shard, number = np.frombuffer(note, np.int32, 2 * n, 8 + 16 * n).reshape(2, n)
                later = np.frombuffer(note, bool, n, 8 + 24 * n)
                mask = np.zeros(n, np.uint32)
                for s, bits in masks.items():
                    mine = shard == s
                    mask[mine] = bits[number[mine]]
                mask[later] = np.uint32(0xFFFFFFFF)
                for k in range(REACH):
                    begin = first[(mask >> np.uint32(k) & np.uint32(1)).astype(bool) & (count > k)] + k
                    edge[begin] += 1
                    np.subtract.at(edge, begin + LENGTH, 1)
            gone = np.cumsum(edge[:-1]) > 0
            for i, doc in enumerate(ids):
                a, b = int(at[i]), int(at[i + 1])
                mine = gone[a:b]
                run = np.flatnonzero(np.diff(mine.astype(np.int8), prepend=0, append=0))
                kept = body[a:b][~mine] if len(run) else body[a:b]
                columns[0].append(int(doc))
                columns[1].append(b - a)
                columns[2].append(b - a - len(kept))
                columns[3].append(len(run) // 2)
                columns[4].append(hashlib.sha256(kept.tobytes()).hexdigest())
                columns[5].append(
                    [
                        {"begin": int(x), "end": int(y)}
                        for x, y in zip(run[::2], run[1::2], strict=True)
                    ]
                )
        kinds = [pa.int64()] * 4 + [pa.string()]
        kinds.append(pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
        return pa.table(
            {n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)}
        )

    return texts.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(
        finish, RESULT_SCHEMA
    )
