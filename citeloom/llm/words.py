"""Words and hashes of many texts at a time, as numpy arrays over their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled together.
PIECE_BYTES = 6 << 20
_BLOCK = 1 << 16
_ODD = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(z: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of splitmix64)."""
    z = z ^ (z >> _S30)
    z *= _A
    z ^= z >> _S27
    z *= _B
    z ^= z >> _S31
    return z


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_ALL = np.arange(256)
#: Bytes of words that ASCII white space separates.
NOT_SPACE = ~((_ALL == 32) | ((_ALL >= 9) & (_ALL <= 13)))
#: Bytes of words of ASCII letters, digits and everything beyond ASCII.
ALPHANUMERIC = (
    ((_ALL >= 48) & (_ALL <= 57))
    | ((_ALL >= 65) & (_ALL <= 90))
    | ((_ALL >= 97) & (_ALL <= 122))
    | (_ALL >= 128)
)
_SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 2 * _BLOCK)
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        up, down = np.full(n, _ODD, np.uint64), np.full(n, inverse, np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up), np.cumprod(down)]
    return _POWERS[0], _POWERS[1]


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and where each begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that each part has about PIECE_BYTES of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = joined(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(at, at[first] + PIECE_BYTES, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def spans(body: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, ...]:
    """Begin, end and text number of each word; words end where texts end."""
    n = len(body)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, none
    inside = np.zeros(n + 1, bool)
    inside[:n] = kind[body]
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:n]
    cut = at[1:-1]
    cut = np.unique(cut[cut < n])
    first, last = inside & ~before, ~inside & before
    split = cut[inside[cut] & before[cut]]
    first[split] = last[split] = True
    begin, end = np.flatnonzero(first), np.flatnonzero(last)
    return begin, end, np.searchsorted(at, begin, side="right") - 1


def hashes(body: np.ndarray, begin: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each span of bytes; with ``fold``, A-Z count as a-z."""
    table = _SYMBOLS[LOWER] if fold else _SYMBOLS
    out = np.empty(len(begin), np.uint64)
    i = 0
    while i < len(begin):
        j = max(int(np.searchsorted(end, begin[i] + _BLOCK, side="right")), i + 1)
        zero = begin[i]
        size = int(end[j - 1] - zero)
        up, down = _powers(size + 1)
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(table[body[zero : zero + size]] * up[:size], out=total[1:])
        b, e = begin[i:j] - zero, end[i:j] - zero
        out[i:j] = (total[e] - total[b]) * down[b] + (e - b).astype(np.uint64)
        i = j
    return mix(out)


def words_of(column: pa.Array, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, and from which word on each text's words stand."""
    body, at = joined(column)
    begin, end, text = spans(body, at, kind)
    first = np.searchsorted(text, np.arange(len(at)))
    return hashes(body, begin, end), first, text


def shingles(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n words in a row, and the text of each.

    A text of fewer words, but not none, has all of them as its one shingle.
    """
    counts = np.diff(first)
    chain = mix(words + _ODD)
    text = np.repeat(np.arange(len(counts)), counts)
    out, owner = [], []
    full = len(words) - n + 1
    if full > 0:
        z = chain[:full].copy()
        for k in range(1, n):
            z = mix(z * _ODD + chain[k : k + full])
        same = text[:full] == text[n - 1 :]
        out.append(z[same])
        owner.append(text[:full][same])
    for k in range(1, n):
        short = np.flatnonzero(counts == k)
        if len(short):
            z = chain[first[short]]
            for step in range(1, k):
                z = mix(z * _ODD + chain[first[short] + step])
            out.append(mix(z + np.uint64(k)))
            owner.append(short)
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(out), np.concatenate(owner)
