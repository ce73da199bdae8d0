"""Fuzzy line deduplication by sketches of character strings.

Lines are normalised to their words in lower case, with a space between. Equal
normalised lines are found by a 128-bit hash. Of the different ones, the strings of
a few characters are hashed into bins; the least hashes of bins are the keys of a
line, and two bits of each of 128 other bins tell roughly how many strings two lines
share. Lines with a key in common are compared by these bits, and what is near is
verified by its edit distance in characters. First the lines of a bucket are
compared with one of their kind; then those that are not connected yet, with all
others of the bucket. Of each connected group the first occurrence stays.
"""

from __future__ import annotations

import functools
import math
import operator
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from citeloom.llm.components import components
from citeloom.llm.shared import MIN_SHARDS, bucketed, freed, shard_of, staged, stored, unpacked
from citeloom.llm.words import ALPHANUMERIC, LOWER, hashes, joined, mix, spans

#: Keys of a line, the same at any number of lines.
KEYS = 20
#: Strings of a key, and their bytes: in lines of so many bytes at least, or at most.
LONG, SHORT = (48, 1, 12), (64, 2, 4)
#: Bins of two bits for strings of so many bytes, and in how many two candidates agree.
BINS, PART, AGREE = 128, 5, 54
#: Parts of a line, by which equal strings are told apart: in lines of so many bytes
#: in some bins, in longer ones in more, so that similar lines hardly differ in that.
PARTS, PLACED = 4, (48, 384)
#: Least edit similarity: 1 - edits / characters of the longer line.
SIMILARITY = 0.9
_C = mix(np.arange(1, 17, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_EVEN = np.uint64(0x5555555555555555)
_SYMBOLS = mix(np.arange(300, 556, dtype=np.uint64) * _C[0])
#: Numbers that hold a line's bins.
WIDTH = BINS // 32
_PLACED = np.geomspace(*PLACED, BINS)[np.argsort(mix(np.arange(BINS, dtype=np.uint64)))]
_TILE = 1 << 18
#: Rows of a block of a bucket, blocks of a bucket at most, and parts in which a shard's small buckets are compared.
BLOCK, BLOCKS, PARTED = 512, 3, 4
_CACHED = 1 << 16
#: Cells of a table of edits that are filled at once, and characters of the pairs compared together.
_CELLS, _CHARS = 1 << 17, 1 << 21
#: Lower case, with a space for what is in no word.
_SPACED = np.where(ALPHANUMERIC, LOWER, 32).astype(np.uint8)


def lines_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, where each line begins, and the text of each line.

    A text is cut at each line feed; the empty text, or null, is one empty line.
    """
    body, at = joined(texts)
    feeds = np.flatnonzero(body == 10) + 1
    owner = np.searchsorted(at, feeds - 1, side="right") - 1
    begins = np.concatenate([at[:-1], feeds])
    owner = np.concatenate([np.arange(len(at) - 1), owner])
    order = np.lexsort((begins, owner))
    return body, np.append(begins[order], len(body)), owner[order]


def _normal(body: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of lines in lower case, each with a space behind it, and where each line begins."""
    data = body.tobytes()
    parts = [data[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
    raw = np.frombuffer(b" ".join([*parts, b""]), np.uint8)
    inside = ALPHANUMERIC[raw]
    kept = inside.copy()
    kept[1:] |= inside[:-1]
    at = np.cumsum(np.append(0, end - begin + 1))
    count = np.add.reduceat(kept, at[:-1], dtype=np.int64) if len(begin) else np.empty(0, np.int64)
    return _SPACED[raw[kept]], np.cumsum(np.append(0, count))


def _rolled(symbols: np.ndarray, q: int) -> np.ndarray:
    """The polynomial of the q symbols from each on, put together from those of two halves."""
    if q == 1:
        return symbols
    half = q // 2
    left = _rolled(symbols, half)
    right = left if q == 2 * half else _rolled(symbols, q - half)
    with np.errstate(over="ignore"):
        out = left * _C[1] ** np.uint64(q - half)
        out[: len(out) - half] += right[half:]
    return out


def _strings(text: np.ndarray, at: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q bytes from each byte on; a line goes on at its begin."""
    symbols = _SYMBOLS[text]
    out = _rolled(np.concatenate([symbols, np.zeros(q, np.uint64)]), q)[: len(text)]
    size = np.diff(at)
    last = np.minimum(size, q - 1)
    line = np.repeat(np.arange(len(size)), last)
    place = size[line] - 1 - (np.arange(len(line)) - np.repeat(np.cumsum(last) - last, last))
    turned = np.zeros(len(line), np.uint64)
    for j in range(q):
        turned = turned * _C[1] + symbols[at[line] + (place + j) % size[line]]
    out[at[line] + place] = turned
    return mix(out)


@functools.lru_cache(maxsize=1 << 12)
def _other_bins(bins: int, turn: int) -> np.ndarray:
    """From which bin each takes its hash at a turn, if it is empty."""
    return (mix(np.arange(bins, dtype=np.uint64) * _C[2] + np.uint64(turn)) % np.uint64(bins)).astype(np.int64)


def _least(strings: np.ndarray, at: np.ndarray, bins: int) -> np.ndarray:
    """The least hash of each line in each bin; an empty bin takes another one's."""
    n = len(at) - 1
    out = np.full(n * bins, _FULL)
    place = ((strings >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    place += np.repeat(np.arange(n) * bins, np.diff(at))
    np.minimum.at(out, place, mix(strings))
    full = out != _FULL
    cell = np.flatnonzero(~full)
    bin_ = cell % bins
    turn = 0
    # What is given stood here from the start, so that no order matters.
    while len(cell):
        turn += 1
        other = cell - bin_ + _other_bins(bins, turn)[bin_]
        good = full[other]
        out[cell[good]] = mix(out[other[good]] + np.uint64(turn))
        cell, bin_ = cell[~good], bin_[~good]
    return out.reshape(n, bins)


def _spans(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """From which to which line a block of lines goes that fits a processor's cache."""
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + _CACHED, side="right")) - 1)
        yield first, last
        first = last


def _blocks(
    text: np.ndarray, at: np.ndarray, compared: bool = True
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same as ``sketches``, in blocks of lines that fit a processor's cache."""
    for first, last in _spans(at):
        keys, line, bits = _sketches(text[at[first] : at[last]], at[first : last + 1] - at[first], compared)
        yield keys, line + first, bits


def _all_bits(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bits of each line, as in ``sketches``."""
    return np.concatenate([_bits(text[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in _spans(at)])


def sketches(
    text: np.ndarray, at: np.ndarray, compared: bool = True
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of lines, the line of each key, and, if they are to be compared, 256 bits of each line."""
    none = (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty((0, WIDTH), np.uint64))
    return tuple(np.concatenate(x) for x in zip(none, *_blocks(text, at, compared), strict=True))


def _sketches(text: np.ndarray, at: np.ndarray, compared: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.diff(at)
    keys, lines = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for (limit, each, q), mine in ((LONG, size >= LONG[0]), (SHORT, size <= SHORT[0])):
        own = np.flatnonzero(mine)
        part = text[np.repeat(mine, size)]
        begin = np.concatenate([[0], np.cumsum(size[own])])
        least = _least(_strings(part, begin, q), begin, KEYS * each).reshape(-1, KEYS, each)
        key = np.arange(KEYS, dtype=np.uint64) * _C[3] + np.uint64(q)
        for i in range(each):
            key = mix(key + least[:, :, i])
        keys.append(key.reshape(-1))
        lines.append(np.repeat(own, KEYS))
    bits = _bits(text, at) if compared else np.empty((0, WIDTH), np.uint64)
    return np.concatenate(keys), np.concatenate(lines), bits


def _bits(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """256 bits of each line.

    In long lines, which all share a little, a string counts as shared in the same part of both only.
    """
    size = np.diff(at)
    strings = _strings(text, at, PART)
    part = np.diff(-(-size[:, None] * np.arange(PARTS + 1) // PARTS), axis=1).reshape(-1)
    part = np.repeat(np.tile(_C[8 : 8 + PARTS], len(size)), part)
    least = np.empty((len(size), BINS), np.uint64)
    # The longest lines have all their bins from parts, the shortest none.
    short, long = size < _PLACED.max(), size >= _PLACED[0]

    def found(own: np.ndarray, mine: np.ndarray) -> np.ndarray:
        return _least(own[np.repeat(mine, size)], np.concatenate([[0], np.cumsum(size[mine])]), BINS)

    least[short] = found(strings, short)
    least[long] = np.where(size[long, None] >= _PLACED, found(strings ^ part, long), least[long])
    least &= np.uint64(3)
    up = np.uint64(2) * np.arange(32, dtype=np.uint64)
    return np.stack([(least[:, i : i + 32] << up).sum(1, dtype=np.uint64) for i in range(0, BINS, 32)], axis=1)


OCCURRENCE_SCHEMA = "piece long, row int, line int, doc_id long, size int, k1 long, k2 long"


def _occurrences(texts: DataFrame) -> DataFrame:
    """One row per line that has a word, with its key and bytes; rows without an id have none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.to_pylist():
                part = unpacked(packed["rows"])
                body, at, owner = lines_of(part.column("text"))
                begin, end, line = spans(body, at, ALPHANUMERIC)
                words = hashes(body, begin, end)
                some, first = np.unique(line, return_index=True)
                if not len(some):
                    continue
                first = np.append(first, len(words))
                place = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
                chain = words + mix(place.astype(np.uint64) + _C[5])
                keys = [np.add.reduceat(mix(chain ^ _C[k]), first[:-1]) for k in (6, 7)]
                size = np.add.reduceat(end - begin + 1, first[:-1]) - 1
                starts = np.searchsorted(owner, np.arange(part.num_rows))
                row = owner[some]
                ids = pc.cast(part.column("doc_id"), pa.int64())
                columns = [
                    pa.array(np.full(len(some), packed["piece"])),
                    pa.array(row.astype(np.int32)),
                    pa.array((some - starts[row]).astype(np.int32)),
                    ids.take(pa.array(row)),
                    pa.array(size.astype(np.int32)),
                    *[pa.array(x.view(np.int64)) for x in keys],
                ]
                found = pa.RecordBatch.from_arrays(columns, names=_OCCURRENCE_NAMES)
                yield found.filter(pc.is_valid(found.column("doc_id")))

    return texts.select("piece", "rows").mapInArrow(read, OCCURRENCE_SCHEMA)


_OCCURRENCE_NAMES = [x.split()[0] for x in OCCURRENCE_SCHEMA.split(", ")]


def _close(
    bits: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float
) -> np.ndarray:
    """Whether rows ``a`` and ``b`` may be similar."""
    longer, shorter = np.maximum(size[a], size[b]), np.minimum(size[a], size[b])
    out = longer - shorter <= (1 - similarity) * longer + 1e-9
    a, b = a[out], b[out]
    apart = bits[a] ^ bits[b]
    apart = np.bitwise_count((apart | (apart >> np.uint64(1))) & _EVEN).sum(1)
    out[out] = apart <= BINS - AGREE
    return out


def _sized(keys: np.ndarray, size: np.ndarray, similarity: float) -> np.ndarray:
    """Buckets cut by the lines' sizes, each at other sizes, so that lead need not compare what differs too much in size."""
    wide = 4 * max(-math.log(max(similarity, 0.01)), 0.01)
    turn = (mix(keys.astype(np.uint64)) >> np.uint64(40)) / float(1 << 24)
    cell = np.log(np.maximum(size, 1)) / wide + turn
    return (keys.astype(np.uint64) << np.uint64(16)) + cell.astype(np.uint64)


def lead(
    keys: np.ndarray,
    ids: np.ndarray,
    bits: np.ndarray,
    size: np.ndarray,
    similarity: float = SIMILARITY,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaders among rows of equal keys, and which row follows which leader.

    In each bucket the first row leads and takes the rows that may be similar; the
    first of the others leads next, and so on. Gives the indices of leaders, of
    followers, and of the followers' leaders.
    """
    left = np.lexsort((ids, keys))
    leaders, follows, followed = [], [], []
    while len(left):
        k = keys[left]
        new = np.ones(len(left), bool)
        new[1:] = k[1:] != k[:-1]
        head = left[np.flatnonzero(new)[np.cumsum(new) - 1]]
        near = _close(bits, size, left, head, similarity)
        leaders.append(left[new])
        mine = near & ~new
        follows.append(left[mine])
        followed.append(head[mine])
        left = left[~near & ~new]
    none = np.empty(0, np.int64)
    return tuple(np.concatenate([none, *x]) for x in (leaders, follows, followed))


def apart(
    keys: np.ndarray,
    ids: np.ndarray,
    bits: np.ndarray,
    size: np.ndarray,
    group: np.ndarray,
    similarity: float = SIMILARITY,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a bucket that may be similar and are of different groups.

    Rows of a bucket's largest group are compared with those of other groups only,
    and each row with those of about its size.
    """
    if not len(keys):
        return
    order = np.lexsort((ids, group, keys))
    k, g = keys[order], group[order]
    run = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (g[1:] != g[:-1])))
    length = np.diff(np.append(run, len(k)))
    bucket = np.cumsum(np.append(True, np.diff(k[run].astype(np.int64)) != 0)) - 1
    largest = np.lexsort((run, -length, bucket))
    largest = largest[np.append(True, np.diff(bucket[largest]) != 0)]
    other = np.ones(len(run), bool)
    other[largest] = False
    other = np.repeat(other, length)
    bucket = np.repeat(bucket, length)
    # By bucket, size and id, so that what may be similar to a row stands next to it.
    size_ = size[order].astype(np.int64)
    turn = np.lexsort((ids[order], size_, bucket))
    order, other = order[turn], other[turn]
    wide = int(size_.max()) + 2
    place = bucket[turn] * wide + size_[turn]
    base = bucket[turn] * wide
    least = np.floor(similarity * size_[turn] - 1e-6).astype(np.int64)
    most = np.minimum(size_[turn] / max(similarity, 1e-9) + 1e-6, wide - 1).astype(np.int64)
    rows = np.flatnonzero(other)
    # Of two rows outside the largest group, the first finds the second.
    start = np.searchsorted(place, (base + np.maximum(least, 0))[rows], side="left")
    stop = np.searchsorted(place, (base + most)[rows], side="right")
    done = np.concatenate([[0], np.cumsum(stop - start)])
    at = 0
    # A tile is a span of the pairs, whether or not it ends within a row's.
    while at < done[-1]:
        end = min(at + _TILE, int(done[-1]))
        i, last = np.searchsorted(done, [at, end - 1], side="right") - 1
        count = np.minimum(done[i + 1 : last + 2], end) - np.maximum(done[i : last + 1], at)
        row = np.repeat(np.arange(i, last + 1), count)
        b = np.arange(at, end) + (start - done[:-1])[row]
        a = rows[row]
        good = (b > a) | ~other[b]
        a, b = order[a[good]], order[b[good]]
        good = group[a] != group[b]
        a, b = a[good], b[good]
        good = _close(bits, size, a, b, similarity)
        yield a[good], b[good]
        at = end


#: Bytes of a row in a shard, column by column: id, key, characters, bits.
_ROW = 8 + 4 + 2 + 8 * WIDTH


def _wanted_words(packed: dict, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The normal form of the wanted lines of a piece, and where each begins."""
    part = unpacked(packed["rows"])
    body, at, owner = lines_of(part.column("text"))
    starts = np.searchsorted(owner, np.arange(part.num_rows))
    line = starts[right.column("row").to_numpy()] + right.column("line").to_numpy()
    return _normal(body, at[line], at[line + 1])


def _cells(size: np.ndarray, similarity: float) -> np.ndarray:
    """A number for sizes, which differs by one at most between lines that may be similar."""
    return np.minimum(np.log(np.maximum(size, 1)) / max(-1.001 * math.log(max(similarity, 0.01)), 0.05), 250).astype("u1")


def _keyed(packed: dict, wanted: pa.Table, shards: int, compared: bool = True) -> tuple[np.ndarray, ...]:
    """Keys of the wanted lines of a piece in the order of their shards, these, lines, bits and sizes."""
    text, at = _wanted_words(packed, wanted)
    return _keyed_words(text, at, shards, compared)


def _keyed_words(text: np.ndarray, at: np.ndarray, shards: int, compared: bool) -> tuple[np.ndarray, ...]:
    keys, target, lines, bits = [np.empty(0, "<u4")], [np.empty(0, np.int32)], [np.empty(0, np.int32)], []
    for key, line, part in _blocks(text, at, compared):
        scrambled = mix(key)
        keys.append(scrambled.astype("<u4"))
        target.append(shard_of(scrambled, shards))
        lines.append(line.astype(np.int32))
        bits.append(part)
    target = np.concatenate(target)
    order = np.argsort(target, kind="stable")
    size = np.add.reduceat(text & 0xC0 != 0x80, at[:-1], dtype=np.int64) - 1
    size = np.minimum(size, 65535).astype("<u2")
    return np.concatenate(keys)[order], target[order], np.concatenate(lines)[order], np.concatenate(bits), size


def _by_shard(target: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each shard among sorted ones, and from where to where it stands."""
    cut = np.flatnonzero(np.diff(target, prepend=-1))
    for start, stop in zip(cut.tolist(), np.append(cut[1:], len(target)).tolist(), strict=True):
        yield int(target[start]), start, stop


def _asked(texts: DataFrame, lines: DataFrame, shards: int, similarity: float) -> DataFrame:
    """``shard, piece, keys``: the keys of all lines alone, four bytes each, and behind them a byte of each for its line's size."""

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"shard": [], "piece": [], "keys": []}
        right = right.sort_by([("row", "ascending"), ("line", "ascending")])
        for packed in left.to_pylist():
            if not len(right):
                break
            keys, target, line, _, size = _keyed(packed, right, shards, compared=False)
            cells = _cells(size, similarity)[line]
            for shard, start, stop in _by_shard(target):
                out["shard"].append(shard)
                out["piece"].append(packed["piece"])
                out["keys"].append(keys[start:stop].astype("<u4").tobytes() + cells[start:stop].tobytes())
        return pa.table(out, pa.schema([("shard", pa.int32()), ("piece", pa.int64()), ("keys", pa.binary())]))

    return texts.groupBy("piece").cogroup(lines.groupBy("piece")).applyInArrow(
        read, "shard int, piece long, keys binary"
    )


def _shared(asked: DataFrame) -> DataFrame:
    """``piece, shard, shared``: for each key that a piece sent, a bit whether another line of about its size has it."""

    def run(table: pa.Table) -> pa.Table:
        parts = table.column("keys").to_pylist()
        count = [len(x) // 5 for x in parts]
        keys = np.concatenate([np.frombuffer(x, "<u4", n) for x, n in zip(parts, count, strict=True)]).astype(np.uint64)
        cells = np.concatenate([np.frombuffer(x, "u1", n, 4 * n) for x, n in zip(parts, count, strict=True)])
        keys = keys << np.uint64(8) | cells
        order = np.argsort(keys)
        # Cells end before the byte does, so the next key's are not near.
        near = np.diff(keys[order]) <= 1
        some = np.zeros(len(keys), bool)
        some[order[1:]] = near
        some[order[:-1]] |= near
        bits = [np.packbits(x).tobytes() for x in np.split(some, np.cumsum(count)[:-1])]
        return pa.table({"piece": table.column("piece"), "shard": table.column("shard"), "shared": pa.array(bits, pa.binary())})

    return asked.groupBy("shard").applyInArrow(run, "piece long, shard int, shared binary")


def _dealt(texts: DataFrame, lines: DataFrame, shared: DataFrame, shards: int) -> DataFrame:
    """``shard, payload``: the rows of the shared keys of ``lines(id, piece, row, line)``."""

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        zip_ = zstandard.ZstdCompressor(level=1)
        out: dict[str, list] = {"shard": [], "payload": []}
        told = right.filter(pc.is_valid(right.column("shard")))
        told = dict(zip(told.column("shard").to_pylist(), told.column("shared").to_pylist(), strict=True))
        right = right.filter(pc.is_valid(right.column("id")))
        right = right.sort_by([("row", "ascending"), ("line", "ascending")])
        for packed in left.to_pylist():
            if not len(right):
                break
            text, at = _wanted_words(packed, right)
            keys, target, line, _, size = _keyed_words(text, at, shards, compared=False)
            ids = right.column("id").to_numpy()
            marks = {}
            some = np.zeros(len(ids), bool)
            for shard, start, stop in _by_shard(target):
                mark = np.unpackbits(np.frombuffer(told[shard], np.uint8), count=stop - start)
                marks[shard] = start + np.flatnonzero(mark)
                some[line[marks[shard]]] = True
            bits = np.zeros((len(ids), WIDTH), np.uint64)
            if some.any():
                cut = np.diff(at)
                bits[some] = _all_bits(text[np.repeat(some, cut)], np.append(0, np.cumsum(cut[some])))
            for shard, part in marks.items():
                if not len(part):
                    continue
                of = line[part]
                # The bytes of ids in turn, as the upper ones are alike.
                data = ids[of].view(np.uint8).reshape(-1, 8).T.tobytes()
                data += keys[part].astype("<u4").tobytes()
                data += size[of].tobytes() + bits[of].tobytes()
                out["shard"].append(shard)
                out["payload"].append(zip_.compress(data))
        return pa.table({"shard": pa.array(out["shard"], pa.int32()), "payload": pa.array(out["payload"], pa.binary())})

    both = lines.unionByName(shared, allowMissingColumns=True)
    return texts.groupBy("piece").cogroup(both.groupBy("piece")).applyInArrow(
        read, "shard int, payload binary"
    )


def _rows(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Keys, ids, bits and sizes of a shard, where a key has several rows."""
    zip_ = zstandard.ZstdDecompressor()
    parts = []
    for data in table.column("payload").to_pylist():
        raw = np.frombuffer(zip_.decompress(data), np.uint8)
        n = len(raw) // _ROW
        ids = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(np.int64).reshape(n)
        keys, size, bits = raw[8 * n : 12 * n], raw[12 * n : 14 * n], raw[14 * n :]
        bits = bits.copy().view(np.uint64).reshape(n, WIDTH)
        parts.append((keys.copy().view("<u4"), ids, bits, size.copy().view("<u2").astype(np.int64)))
    keys, ids, bits, size = (np.concatenate(x) for x in zip(*parts, strict=True))
    _, of, n = np.unique(keys, return_inverse=True, return_counts=True)
    some = n[of] > 1
    return keys[some], ids[some], bits[some], size[some]


def _led(dealt: DataFrame, similarity: float) -> DataFrame:
    """``shard, a, b``: each line and the leader it follows, in each bucket."""

    def run(table: pa.Table) -> pa.Table:
        keys, ids, bits, size = _rows(table)
        _, follow, leader = lead(_sized(keys, size, similarity), ids, bits, size, similarity)
        pair = np.unique(np.stack([ids[leader], ids[follow]], axis=1), axis=0)
        shard = np.full(len(pair), table.column("shard")[0].as_py(), np.int32)
        return pa.table({"shard": shard, "a": pair[:, 0].copy(), "b": pair[:, 1].copy()})

    return dealt.groupBy("shard").applyInArrow(run, "shard int, a long, b long")


LEFT_SCHEMA = "shard int, key long, id long, component long, block int, blocks int, others int, size int, bits binary"


def _left(dealt: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """The rows that may be similar to one of their bucket they are not connected with by ``groups(shard, id, component)``.

    They are numbered in blocks, of which a bucket has a few at most, so that the
    rows sent to them grow with the rows. Those that are not of the bucket's largest
    group come first, in the first ``others`` of its ``blocks``.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return none
        keys, ids, bits, size = _rows(left)
        right = right.sort_by("id")
        known, component = (right.column(c).to_numpy() for c in ("id", "component"))
        group = ids.copy()
        if len(known):
            at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
            group = np.where(known[at] == ids, component[at], ids)
        first, second = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        # What a row was to its leader is known.
        _, follow, leader = lead(_sized(keys, size, similarity), ids, bits, size, similarity)
        told = np.sort(np.minimum(follow, leader) * len(keys) + np.maximum(follow, leader))
        for a, b in apart(keys, ids, bits, size, group, similarity) if len(keys) else ():
            pair = np.minimum(a, b) * len(keys) + np.maximum(a, b)
            new = ~np.isin(pair, told)
            first[a[new]] = second[b[new]] = True
        rows = np.flatnonzero(first | second)
        if not len(rows):
            return none
        rows = rows[np.lexsort((ids[rows], ~first[rows], keys[rows]))]
        new = np.append(True, np.diff(keys[rows].astype(np.int64)) != 0)
        bucket = np.cumsum(new) - 1
        place = np.arange(len(rows)) - np.flatnonzero(new)[bucket]
        count = np.bincount(bucket)
        each = np.maximum(BLOCK, -(-count // BLOCKS))
        blocks = -(-count // each)
        others = -(-np.bincount(bucket, first[rows]).astype(np.int64) // each)
        columns = [np.full(len(rows), left.column("shard")[0].as_py()), keys[rows], ids[rows], group[rows], place // each[bucket]]
        columns += [blocks[bucket], others[bucket], size[rows]]
        columns = [pa.array(x.astype(kind.type.to_pandas_dtype())) for x, kind in zip(columns, none.schema, strict=False)]
        columns.append(pa.array([x.tobytes() for x in bits[rows]], pa.binary()))
        return pa.table(columns, none.schema)

    empty = dealt.sparkSession.createDataFrame([], LEFT_SCHEMA)
    none = pa.Table.from_batches([], to_arrow_schema(empty.schema))
    return dealt.groupBy("shard").cogroup(groups.groupBy("shard")).applyInArrow(run, LEFT_SCHEMA)


def _once(a: np.ndarray, b: np.ndarray, ids: np.ndarray, keys: np.ndarray, cards: np.ndarray) -> np.ndarray:
    """Whether a pair's bucket is the one that compares it, of all that the pair shares."""
    with np.errstate(over="ignore"):
        pair = mix(np.minimum(ids[a], ids[b]).view(np.uint64) * _C[6]) + np.maximum(ids[a], ids[b]).view(np.uint64)
    turn = mix(pair[:, None] + _C[7] * np.arange(1, cards.shape[1] + 1, dtype=np.uint64)) | np.uint64(1)
    both = (cards[a] == cards[b]) & (cards[a] != 0)
    chosen = np.where(both, turn, np.uint64(0)).argmax(1)
    # Rows of a bucket whose keys are alike by chance only have none in common.
    return ~both.any(1) | (cards[a, chosen] == keys[a])


def _root(tops: np.ndarray, x: int) -> int:
    """The end of the chain from x on."""
    while tops[x] != x:
        x = tops[x]
    return x


def _joined(left: DataFrame, spelled: DataFrame, similarity: float) -> DataFrame:
    """Links ``(a, b)`` of the rows that ``_left`` gives, as many as connect what they connect.

    A task compares two blocks of a bucket, or all rows of a few small buckets.
    """
    many = F.col("blocks") > 1
    met = F.when(F.expr("block < others"), F.col("blocks")).otherwise(F.col("others"))
    turns = F.explode(F.sequence(F.lit(0), met - 1))
    tiles = left.withColumn("turn", turns)
    tiles = tiles.withColumn("i", F.least("block", "turn")).withColumn("j", F.greatest("block", "turn"))
    tiles = tiles.withColumn("part", F.when(many, F.col("key")).otherwise(F.col("key") % PARTED))
    tiles = tiles.select("shard", "part", "blocks", "i", "j", "key", "id", "component", "block", "size", "bits")
    tiles = tiles.join(spelled, "id")

    def run(table: pa.Table) -> pa.Table:
        read = {c: table.column(c).to_numpy() for c in ("key", "id", "component", "block", "size")}
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(-1, WIDTH)
        cards = np.frombuffer(b"".join(table.column("card").to_pylist()), "<u4").reshape(len(bits), -1)
        words = table.column("words").to_pylist()
        length = np.array([len(x) for x in words])
        i, j = (table.column(c)[0].as_py() for c in ("i", "j"))
        block, ids = read["block"], read["id"]
        kinds, top = np.unique(read["component"], return_inverse=True)
        tops = np.arange(len(kinds))
        found = []
        for a, b in apart(read["key"], ids, bits, read["size"], read["component"], similarity):
            mine = (np.minimum(block[a], block[b]) == i) & (np.maximum(block[a], block[b]) == j)
            mine[mine] = _once(a[mine], b[mine], ids, read["key"], cards)
            a, b = a[mine], b[mine]
            # What is found joins groups, whose other pairs need no look; hence little at first.
            many = 64
            while len(a):
                apart_ = tops[top[a]] != tops[top[b]]
                a, b = a[apart_], b[apart_]
                x, y, a, b = a[:many], b[:many], a[many:], b[many:]
                many = min(2 * many, 1 << 13)
                most = np.floor((1 - similarity) * np.maximum(length[x], length[y]) + 1e-9).astype(np.int64)
                good = similar_pairs([words[k] for k in x.tolist()], [words[k] for k in y.tolist()], most)
                for one, other in zip(x[good].tolist(), y[good].tolist(), strict=True):
                    p, q = _root(tops, top[one]), _root(tops, top[other])
                    if p != q:
                        tops[max(p, q)] = min(p, q)
                        found.append((ids[one], ids[other]))
                while (tops[tops] != tops).any():
                    tops = tops[tops]
        found = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": found[:, 0].copy(), "b": found[:, 1].copy()})

    return tiles.groupBy("shard", "part", "blocks", "i", "j").applyInArrow(run, "a long, b long")


@functools.lru_cache(maxsize=2 * BLOCK)
def _strings_of(text: str) -> np.ndarray:
    """The strings of three characters of a text, sorted."""
    x = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    return np.sort((x[:-2] << 42) + (x[1:-1] << 21) + x[2:])


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many strings two sorted arrays share, repeated ones as often as both have them."""
    kinds, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    return int(np.minimum(*(np.bincount(part, minlength=len(kinds)) for part in (at[: len(x)], at[len(x) :]))).sum())


def similar(x: str, y: str, most: int) -> bool:
    """Whether at most so many characters are put in, left out or changed.

    An edit changes three strings of three characters at most, which rules out
    what is too far apart. The distance of the rest is found column by column, a
    column being one number with a bit for each character (Myers; Hyyrö).
    """
    if abs(len(x) - len(y)) > most:
        return False
    if min(len(x), len(y)) > 16:
        longer = max(len(x), len(y))
        if _common(_strings_of(x), _strings_of(y)) < longer - 2 - 3 * most:
            return False
    # What both begin or end with takes no part.
    first = len(os.path.commonprefix([x, y]))
    x, y = x[first:], y[first:]
    last = len(os.path.commonprefix([x[::-1], y[::-1]]))
    x, y = x[: len(x) - last], y[: len(y) - last]
    if not x or not y or max(len(x), len(y)) <= most:
        return max(len(x), len(y)) <= most
    if len(x) == len(y) and sum(map(operator.ne, x, y)) <= most:
        return True
    places: dict[str, int] = {}
    for i, c in enumerate(x):
        places[c] = places.get(c, 0) | 1 << i
    full, top = (1 << len(x)) - 1, 1 << (len(x) - 1)
    up, down, score, left = full, 0, len(x), len(y)
    for c in y:
        same = places.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        rise, fall = down | (full & ~(diagonal | up)), up & diagonal
        score += bool(rise & top) - bool(fall & top)
        left -= 1
        if score - left > most:
            return False
        rise, fall = rise << 1 | 1, fall << 1
        same |= down
        up, down = (fall | ~(same | rise)) & full, rise & same & full
    return score <= most


def similar_pairs(x: list[str], y: list[str], most: np.ndarray) -> np.ndarray:
    """What ``similar`` tells of each pair of two lists."""
    out = np.zeros(len(x), bool)
    size = np.array([[len(a), len(b)] for a, b in zip(x, y, strict=True)], np.int64).reshape(-1, 2)
    rest = np.flatnonzero(np.abs(size[:, 0] - size[:, 1]) <= most)
    first = 0
    total = np.cumsum(np.append(0, size[rest].sum(1)))
    while first < len(rest):
        last = max(first + 1, int(np.searchsorted(total, total[first] + _CHARS, side="right")) - 1)
        some = rest[first:last]
        # The longer one of a pair is the first.
        turned = size[some, 0] < size[some, 1]
        pairs = [(y[i], x[i]) if t else (x[i], y[i]) for i, t in zip(some.tolist(), turned.tolist(), strict=True)]
        out[some] = _similar_some([a for a, _ in pairs], [b for _, b in pairs], most[some])
        first = last
    return out


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts, and where each begins."""
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return data, np.cumsum([0, *map(len, texts)])


def _similar_some(x: list[str], y: list[str], most: np.ndarray) -> np.ndarray:
    """The same for pairs whose first one is as long as the other at least, by ``most`` at most."""
    (a, at), (b, bt) = _coded(x), _coded(y)
    m, n = np.diff(at), np.diff(bt)
    # Letters of few kinds are compared as bytes.
    top = int(max(a.max(initial=0), b.max(initial=0))) + 1
    kinds = np.zeros(top, bool)
    kinds[a] = kinds[b] = True
    code = np.cumsum(kinds)
    if code[-1] < 255:
        a, b = (code.astype(np.uint8)[z] for z in (a, b))
    # What both begin or end with takes no part.
    place = np.arange(bt[-1]) - np.repeat(bt[:-1], n)
    begin = a[np.repeat(at[:-1], n) + place] != b
    end = a[np.repeat(at[1:] - n, n) + place] != b
    differ = np.append(np.flatnonzero(begin), len(b))
    head = np.minimum(differ[np.searchsorted(differ, bt[:-1])] - bt[:-1], n)
    differ = np.append(-1, np.flatnonzero(end))
    tail = bt[1:] - 1 - differ[np.searchsorted(differ, bt[1:], side="left") - 1]
    tail = np.minimum(tail, n - head)
    edits = np.diff(np.cumsum(np.append(0, begin))[bt])
    m, n = m - head - tail, n - head - tail
    out = (m <= most) | ((m == n) & (edits <= most))
    open_ = np.flatnonzero(~out & (n > 0))
    open_ = open_[np.argsort(m[open_] + n[open_], kind="stable")]
    both = (m + n)[open_]
    at, bt = at[:-1] + head, bt[:-1] + head
    first = 0
    while first < len(open_):
        limit = int(np.searchsorted(both, 1.4 * both[first] + 16, side="right"))
        wide = int(np.minimum(most[open_[first:limit]], both[limit - 1]).max()) // 2 + 2
        last = min(limit, first + max(16, _CELLS // wide))
        some = open_[first:last]
        if last - first < 6 or most[some].max() > 60_000:
            out[some] = [similar(x[i], y[i], int(most[i])) for i in some.tolist()]
        else:
            out[some] = _edits(a, b, at[some], bt[some], m[some], n[some], most[some]) <= most[some]
        first = last
    return out


def _edits(
    a: np.ndarray, b: np.ndarray, at: np.ndarray, bt: np.ndarray, m: np.ndarray, n: np.ndarray, most: np.ndarray
) -> np.ndarray:
    """Edits from each of the texts of ``m`` characters at ``at`` in ``a`` to that of ``n``, no more, at ``bt`` in ``b``, or more than ``most``.

    All tables are filled at once, diagonal by diagonal from the upper left to the
    lower right. Row t of a diagonal has the cells that are ``2t`` to the side of its
    first one, and a column for each pair. What needs more than ``most`` edits to get
    to or away from lies outside.
    """
    count = len(m)
    gap = m - n
    low, high = int(np.minimum((most - gap) // 2, n).max()), int(np.minimum((most + gap) // 2, m).max())
    low, high = low + low % 2, high + high % 2
    wide = (low + high) // 2
    ends = m + n
    total = int(ends.max())
    long, short = int(m.max()), int(n.max())
    front = (low + 2, max(0, (total + low) // 2 - short) + 2)
    upper = np.zeros((front[0] + max(long, total // 2 + high) + 4, count), a.dtype)
    lower = np.zeros((front[1] + short + high + wide + 4, count), b.dtype)
    column = np.repeat(np.arange(count), m)
    place = np.arange(len(column)) - np.repeat(np.cumsum(m) - m, m)
    upper[front[0] + place, column] = a[np.repeat(at, m) + place]
    column = np.repeat(np.arange(count), n)
    place = np.arange(len(column)) - np.repeat(np.cumsum(n) - n, n)
    lower[front[1] + short - 1 - place, column] = b[np.repeat(bt, n) + place]
    cap = int(most.max()) + 1
    kind = np.uint8 if cap < 200 else np.uint16
    # How many diagonals may pass before what is too much is made less again.
    often = (255 if kind is np.uint8 else 65535) - cap - 2
    even, odd = np.full((wide + 1, count), cap, kind), np.full((wide + 2, count), cap, kind)
    even[low // 2] = 0
    unlike, side, one = np.empty((wide + 1, count), bool), np.empty((wide + 1, count), kind), np.array(1, kind)
    out = np.full(count, cap, np.int64)
    order = np.argsort(ends, kind="stable")
    done = np.searchsorted(ends[order], np.arange(total + 2)).tolist()
    turns = [
        (cells, others[:-1], others[1:], unlike[:w], unlike[:w].view(np.uint8), side[:w], w, d)
        for cells, others, w, d in ((even, odd, wide + 1, -low), (odd[1:-1], even, wide, 1 - low))
    ]
    for s in range(1, total + 1):
        cells, left, right, other, put, least, w, d = turns[s % 2]
        i, j = front[0] + (s + d) // 2 - 1, front[1] + short - (s - d) // 2
        np.not_equal(upper[i : i + w], lower[j : j + w], out=other)
        np.add(cells, put, out=cells)
        np.minimum(left, right, out=least)
        np.add(least, one, out=least)
        np.minimum(cells, least, out=cells)
        if s % often == 0:
            np.minimum(even, cap, out=even)
            np.minimum(odd, cap, out=odd)
        if done[s] < done[s + 1]:
            own = order[done[s] : done[s + 1]]
            out[own] = cells[(gap[own] - d) // 2, own]
    return out


def _cards(text: np.ndarray, at: np.ndarray) -> list[bytes]:
    """All keys of each line, those of long lines before those of short ones; 0 for what it has not."""
    out = np.zeros((len(at) - 1, 2 * KEYS), "<u4")
    for keys, line, _ in _blocks(text, at, compared=False):
        # Whole runs of keys: those of long lines come first.
        line = line[::KEYS]
        second = np.diff(at)[line] < LONG[0]
        second[1:] |= np.cumsum(np.diff(line) < 0) > 0
        of = line[:, None], KEYS * second[:, None] + np.arange(KEYS)
        out[of] = mix(keys).astype("<u4").reshape(-1, KEYS)
    return [x.tobytes() for x in out]


def _spelled(texts: DataFrame, wanted: DataFrame, carded: bool = False) -> DataFrame:
    """``id, words`` of the lines in ``wanted(id, piece, row, line)``, their words in lower case, and their keys as ``card``."""

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, out, cards = [], [], []
        right = right.sort_by([("row", "ascending"), ("line", "ascending")])
        for packed in left.to_pylist():
            if not len(right):
                break
            text, at = _wanted_words(packed, right)
            data = text.tobytes()
            ids.extend(right.column("id").to_pylist())
            out.extend(data[a : b - 1].decode() for a, b in zip(at, at[1:]))
            cards.extend(_cards(text, at) if carded else [])
        found = {"id": pa.array(ids, pa.int64()), "words": pa.array(out, pa.string())}
        return pa.table(found | ({"card": pa.array(cards, pa.binary())} if carded else {}))

    return texts.groupBy("piece").cogroup(wanted.groupBy("piece")).applyInArrow(
        read, "id long, words string" + ", card binary" * carded
    )


def _verified(texts: DataFrame, lines: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` whose edit similarity in characters is enough."""
    both = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id")))
    wanted = lines.join(stored(both.distinct(), "wanted"), "id")
    spelled = stored(_spelled(texts, wanted), "spelled")
    checked = pairs.join(spelled.select(F.col("id").alias("a"), F.col("words").alias("x")), "a")
    checked = checked.join(spelled.select(F.col("id").alias("b"), F.col("words").alias("y")), "b")
    longer = F.greatest(F.length("x"), F.length("y"))
    most = F.floor((1 - F.lit(similarity)) * longer + F.lit(1e-9)).cast("int")
    checked = checked.withColumn("most", most).where(
        F.abs(F.length("x") - F.length("y")) <= F.col("most")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
            good = similar_pairs(x, y, batch.column("most").to_numpy().astype(np.int64))
            yield batch.select(["a", "b"]).filter(pa.array(good))

    found = checked.select("a", "b", "x", "y", "most").mapInArrow(run, "a long, b long")
    links = stored(found, "line-links")
    freed(spelled)
    return links


def _gone(texts: DataFrame, similarity: float) -> DataFrame:
    """``piece, row, line`` of the lines that go.

    Of each connected group of similar lines the occurrence with the smallest
    document id and line number stays. Lines without a word are never removed.
    """
    seen = stored(_occurrences(texts), "occurrences")
    lines = seen.groupBy("k1", "k2").agg(
        F.min(F.struct("doc_id", "line", "piece", "row")).alias("first"),
        F.count("*").alias("n"),
        F.min("size").alias("size"),
    )
    lines = stored(lines.withColumn("id", F.monotonically_increasing_id()), "lines")
    # Shorter lines are not similar to any other: one character is too much already.
    some = lines.where((F.col("size") + 1) * (1 - F.lit(similarity)) >= 1 - 1e-9)
    some = some.select("id", "first.piece", "first.row", "first.line")
    shards = max(MIN_SHARDS, math.ceil(some.count() / 25_000))
    # Most keys are no other line's. They are told apart first, by the keys alone.
    asked = bucketed(_asked(texts, some, shards, similarity), "shard", "asked")
    shared = stored(_shared(asked), "shared")
    freed(asked)
    dealt = bucketed(_dealt(texts, some, shared, shards), "shard", "line-keys")
    freed(shared)
    led = stored(_led(dealt, similarity), "led")
    pairs = stored(led.select("a", "b").distinct(), "line-pairs")
    links = _verified(texts, some, pairs, similarity)
    groups = stored(components(links), "line-groups")
    seen_in = led.select("shard", F.col("a").alias("id")).unionAll(
        led.select("shard", F.col("b").alias("id"))
    )
    known = stored(seen_in.distinct().join(groups, "id").select("shard", "id", "component"), "known")
    left = stored(_left(dealt, known, similarity), "left")
    freed(dealt, led, known)
    wanted = some.join(stored(left.select("id").distinct(), "wanted"), "id")
    spelled = stored(_spelled(texts, wanted, carded=True), "spelled")
    links = links.unionAll(stored(_joined(left, spelled, similarity), "line-links"))
    freed(left, spelled)
    groups = stored(components(links), "line-groups")

    # Lines that occur more than once, or belong to a group, and what stays of them.
    named = lines.join(groups, "id", "left").where("n > 1 OR component IS NOT NULL")
    place = F.struct("first.doc_id", "first.line").alias("first")
    named = stored(
        named.select("k1", "k2", place, F.coalesce("component", "id").alias("component")), "named"
    )
    stays = named.groupBy("component").agg(F.min("first").alias("stays"))
    named = stored(
        named.join(stored(stays, "stays"), "component").select(
            "k1",
            "k2",
            F.col("stays.doc_id").alias("stay_doc"),
            F.col("stays.line").alias("stay_line"),
        ),
        "repeated",
    )
    gone = seen.select("piece", "row", "line", "doc_id", "k1", "k2").join(named, ["k1", "k2"])
    gone = gone.where("doc_id <> stay_doc OR line <> stay_line")
    gone = stored(gone.select("piece", "row", "line"), "gone")
    freed(seen, lines, named)
    return gone


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the text of the lines that stay, and ``n_lines, n_removed`` (long).

    Every row stays; a text all of whose lines go becomes empty. A null text stays
    null. Rows that share an id count as one document, so a line with the same
    number in two of them is one occurrence; a row without an id is left as it
    is. Columns of the added names in the input are replaced. Empty tables give
    no rows.
    """
    taken = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    docs = docs.select(*taken)
    texts = staged(docs)
    gone = _gone(texts, similarity)
    zero = F.lit(0).cast("long")
    schema = docs.select("*", zero.alias("n_lines"), zero.alias("n_removed")).schema

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for packed in left.to_pylist():
            part = unpacked(packed["rows"])
            body, at, owner = lines_of(part.column("text"))
            starts = np.searchsorted(owner, np.arange(part.num_rows + 1))
            keep = np.ones(len(owner), bool)
            if len(right):
                row, line = (right.column(c).to_numpy() for c in ("row", "line"))
                keep[starts[row] + line] = False
            removed = np.add.reduceat((~keep).astype(np.int64), starts[:-1])
            texts = part.column("text").to_pylist()
            for i in np.flatnonzero(removed):
                stay = keep[starts[i] : starts[i + 1]]
                pairs = zip(texts[i].split("\n"), stay, strict=True)
                texts[i] = "\n".join(x for x, good in pairs if good)
            columns = {c: part.column(c) for c in taken}
            columns["text"] = pa.array(texts, pa.string())
            columns["n_lines"] = pa.array(np.diff(starts).astype(np.int64))
            columns["n_removed"] = pa.array(removed)
            out.append(pa.table(columns))
        return pa.concat_tables(out) if out else empty

    empty = pa.Table.from_batches([], to_arrow_schema(schema))
    return texts.groupBy("piece").cogroup(gone.groupBy("piece")).applyInArrow(cut, schema)
