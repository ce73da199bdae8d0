"""Language-model scores from an Elias-Fano n-gram trie.

The model is a word bigram model with Dirichlet smoothing (MacKay and Peto):
``p(w | v) = (c(v, w) + m * p(w)) / (c(v) + m)`` over
``p(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1))``; the end of a text is a token, and
the context of the next text's first word.

The trie is dealt to shards by bigram, so a frequent word's successors are spread
over all of them and no shard grows with one word. A shard has two levels in
compact, memory-mapped files: contexts with monotone pointers to their
successors, and successors counted from their context's base, all in Elias-Fano
code, with smoothed log-probabilities in 16 bits. A bigram is found by its
context and a successor search relative to that context.

Texts are encoded once, in pieces that stay where they are; a piece asks each
shard once for its different words, then for its different bigrams, and adds up
the answers.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.shared import shard_of, shards_for, stored, text_bytes, work_dir
from citeloom.llm.words import NOT_SPACE, mix, pieces, words_of

HELD_OUT = 10
ADDED = 0.1
#: The token at the end of each text.
END = np.uint64(0x5851F42D4C957F2D)
#: Weight of the lower order, in occurrences.
STRENGTH = 500.0
#: Log-probabilities are held in steps of this many decades.
STEP = 1 / 4096
ABSENT = np.uint16(65535)


class EliasFano:
    """A monotone sequence of integers in high bits (unary) and low bits (packed bytes)."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        # Ones before each 512-bit block of the high bits: the only thing beside the code.
        ones = np.bitwise_count(high).astype(np.int64)
        pad = -len(ones) % 64
        blocks = np.pad(ones, (0, pad)).reshape(-1, 64).sum(1)
        self._before = np.concatenate([[0], np.cumsum(blocks)])

    @classmethod
    def encode(cls, values: np.ndarray, folder: str, name: str) -> EliasFano:
        """Write the code of ascending values to two files and map them."""
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, int(math.log2(max(1, top // max(n, 1)))))
        rest = values & np.uint64((1 << low_bits) - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits((rest[:, None] >> shifts).astype(np.uint8) & 1, bitorder="little")
        place = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(place[-1]) + 1 if n else 1, np.uint8)
        bits[place] = 1
        high = np.packbits(bits, bitorder="little")
        mapped = []
        for kind, data in (("low", low), ("high", high)):
            path = os.path.join(folder, f"{name}.{kind}")
            np.append(data, np.zeros(9, np.uint8)).tofile(path)
            mapped.append(np.memmap(path, np.uint8, "r"))
        return cls(n, low_bits, *mapped)

    def _select(self, i: np.ndarray) -> np.ndarray:
        """Bit position of the i-th one."""
        block = np.searchsorted(self._before, i, side="right") - 1
        out = np.empty(len(i), np.int64)
        for s in range(0, len(i), 4096):
            b = block[s : s + 4096]
            want = i[s : s + 4096] - self._before[b]
            at = b[:, None] * 64 + np.arange(64)
            part = np.where(at < len(self.high), self.high[np.minimum(at, len(self.high) - 1)], 0)
            upto = np.cumsum(np.bitwise_count(part.astype(np.uint8)), axis=1, dtype=np.int64)
            byte = (upto <= want[:, None]).sum(1)
            left = want - np.where(byte > 0, upto[np.arange(len(b)), np.maximum(byte - 1, 0)], 0)
            value = part[np.arange(len(b)), byte].astype(np.uint8)
            seen = np.cumsum(np.unpackbits(value[:, None], axis=1, bitorder="little"), axis=1)
            out[s : s + 4096] = (b * 64 + byte) * 8 + (seen <= left[:, None]).sum(1)
        return out

    def decode(self) -> np.ndarray:
        """All values in order."""
        bits = np.unpackbits(self.high, bitorder="little")
        high = (np.flatnonzero(bits) - np.arange(self.n)).astype(np.uint64)
        if not self.low_bits:
            return high
        low = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little")
        powers = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        low = (low.reshape(self.n, self.low_bits) * powers).sum(1, dtype=np.uint64)
        return (high << np.uint64(self.low_bits)) | low

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at the given places."""
        high = (self._select(i) - i).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high
        bit = i.astype(np.int64) * self.low_bits
        byte, shift = bit >> 3, (bit & 7).astype(np.uint64)
        raw = np.zeros(len(i), np.uint64)
        for k in range(8):
            raw |= self.low[byte + k].astype(np.uint64) << np.uint64(8 * k)
        low = raw >> shift
        over = (self.low[byte + 8].astype(np.uint64) << np.uint64(1)) << (np.uint64(63) - shift)
        return high | ((low | over) & np.uint64((1 << self.low_bits) - 1))


@dataclass
class Trie:
    """Two levels: context ids and pointers, successors relative to their context."""

    contexts: EliasFano
    pointers: EliasFano
    successors: EliasFano
    scores: np.ndarray

    @classmethod
    def build(
        cls, context: np.ndarray, word: np.ndarray, log10: np.ndarray, folder: str
    ) -> Trie:
        """From rows sorted by context and word, both as numbers of 31 bits or less."""
        ids, begin = np.unique(context, return_index=True)
        ends = np.append(begin, len(context))
        # A context's successors follow the last one of the context before it.
        base = np.zeros(len(ids) + 1, np.uint64)
        last = word[ends[1:] - 1].astype(np.uint64) + np.uint64(1) if len(ids) else base[:0]
        base[1:] = np.cumsum(last)
        absolute = word.astype(np.uint64) + np.repeat(base[:-1], np.diff(ends))
        path = os.path.join(folder, "scores")
        code = np.clip(np.rint(-log10 / STEP), 0, 65534).astype(np.uint16)
        np.append(code, np.uint16(0)).tofile(path)
        return cls(
            EliasFano.encode(ids, folder, "contexts"),
            EliasFano.encode(ends, folder, "pointers"),
            EliasFano.encode(absolute, folder, "successors"),
            np.memmap(path, np.uint16, "r"),
        )

    @staticmethod
    def _search(code: EliasFano, low: np.ndarray, high: np.ndarray, want: np.ndarray) -> np.ndarray:
        """First place in [low, high) with a value not below the wanted one."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) // 2
            below = np.zeros(len(low), bool)
            below[open_] = code.get(middle[open_]) < want[open_]
            low = np.where(open_ & below, middle + 1, low)
            high = np.where(open_ & ~below, middle, high)
        return low

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Code of each bigram's log-probability; ABSENT where the trie has none.

        Few bigrams are looked up by halving, many against the decoded levels.
        """
        out = np.full(len(context), ABSENT)
        n = self.contexts.n
        if not n or not len(context):
            return out
        context, word = context.astype(np.uint64), word.astype(np.uint64)
        many = len(context) > 256
        if many:
            ids, ends, successors = (
                x.decode() for x in (self.contexts, self.pointers, self.successors)
            )
            ends = ends.astype(np.int64)
            at = np.searchsorted(ids, context)
        else:
            zero = np.zeros(len(context), np.int64)
            at = self._search(self.contexts, zero, zero + n, context)
        i = np.flatnonzero(at < n)
        at = at[i]
        same = (ids[at] if many else self.contexts.get(at)) == context[i]
        i, at = i[same], at[same]
        if not len(i):
            return out
        begin, end = (
            ends[at + k] if many else self.pointers.get(at + k).astype(np.int64) for k in (0, 1)
        )
        # The ids of a context count from one beyond the last of the one before.
        before = np.zeros(len(i), np.uint64)
        some = begin > 0
        last = begin[some] - 1
        before[some] = (successors[last] if many else self.successors.get(last)) + np.uint64(1)
        want = before + word[i]
        if many:
            place = np.searchsorted(successors, want)
        else:
            place = self._search(self.successors, begin, end, want)
        good = np.flatnonzero((place >= begin) & (place < end))
        found = successors[place[good]] if many else self.successors.get(place[good])
        good = good[found == want[good]]
        out[i[good]] = self.scores[place[good]]
        return out


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after another, the bytes of equal weight of each together, compressed."""
    planes = [
        np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays
    ]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _read(raw: bytes, kind: type, n: int = -1, offset: int = 0) -> np.ndarray:
    """An array of n numbers (or all) that begins at a byte."""
    size = np.dtype(kind).itemsize
    n = (len(raw) - offset) // size if n < 0 else n
    planes = np.frombuffer(raw, np.uint8, n * size, offset).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _split(target: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(target, kind="stable")
    cut = np.flatnonzero(np.diff(target[order], prepend=-1))
    for s, e in zip(cut, np.append(cut[1:], len(order)), strict=True):
        yield int(target[order[s]]), order[s:e]


def _encoded(docs: DataFrame, buckets: int) -> DataFrame:
    """Pieces of the corpus: the words of each as numbers into the piece's own word list.

    Stored in buckets of the piece number, so that answers come to the pieces.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            words, first, _ = words_of(part.column("text"), NOT_SPACE)
            # One end after each text's words.
            counts = np.diff(first) + 1
            at = np.concatenate([[0], np.cumsum(counts)])
            tokens = np.full(at[-1], END)
            tokens[np.arange(len(words)) + np.repeat(np.arange(len(counts)), counts - 1)] = words
            vocabulary, numbers = np.unique(tokens, return_inverse=True)
            ids = part.column("doc_id").to_numpy().astype(np.int64)
            held = part.column("held").to_numpy(zero_copy_only=False)
            row = [
                _pack(ids),
                _pack(held),
                _pack(at.astype(np.int64)),
                _pack(numbers.astype(np.int32)),
                _pack(vocabulary),
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], pa.binary()) for x in row], names=_COLUMNS
            )

    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT == 0).alias("held")
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held)
    coded = slim.where("doc_id IS NOT NULL").mapInArrow(
        encode, ", ".join(f"{c} binary" for c in _COLUMNS)
    )
    spark = docs.sparkSession
    table = f"tokens_{uuid.uuid4().hex}"
    writer = coded.withColumn("piece", F.monotonically_increasing_id()).write
    writer = writer.option("path", work_dir(spark, "tokens")).bucketBy(buckets, "piece")
    writer.option("compression", "uncompressed").saveAsTable(table)
    return spark.table(table)


_COLUMNS = ["doc_ids", "held", "at", "numbers", "words"]
_KINDS = [np.int64, bool, np.int64, np.int32, np.uint64]
_REPLY = "piece long, shard int, payload binary"


def _opened(row: dict) -> list[np.ndarray]:
    return [_read(_unpack(row[c]), k) for c, k in zip(_COLUMNS, _KINDS, strict=True)]


def _reply(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    piece, shard, payload = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table(
        {
            "piece": pa.array(piece, pa.int64()),
            "shard": pa.array(shard, pa.int32()),
            "payload": pa.array(payload, pa.binary()),
        }
    )


def _word_counts(coded: DataFrame, shards: int) -> DataFrame:
    """For each piece and shard, the number and the training count of the piece's words there.

    A shard numbers its words by falling count, so frequent words get small
    numbers; a number is unique over all shards. Rows of piece -1 have a shard's
    total count and how many different words occur in training texts.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, held, at, numbers, words = _opened(row)
                learned = np.repeat(~held, np.diff(at))
                counts = np.bincount(numbers[learned], minlength=len(words))
                rows = [
                    (row["piece"], s, _pack(np.array([len(i)]), words[i], counts[i]))
                    for s, i in _split(shard_of(words, shards))
                ]
                yield from _reply(rows).to_batches()

    def meet(table: pa.Table) -> pa.Table:
        words, counts, sizes = [], [], []
        for data in table.column("payload").to_pylist():
            raw = _unpack(data)
            n = int(_read(raw, np.int64, 1)[0])
            words.append(_read(raw, np.uint64, n, 8))
            counts.append(_read(raw, np.int64, n, 8 + 8 * n))
            sizes.append(n)
        different, which = np.unique(np.concatenate(words), return_inverse=True)
        total = np.zeros(len(different), np.int64)
        np.add.at(total, which, np.concatenate(counts))
        shard = table.column("shard")[0].as_py()
        rank = np.empty(len(different), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(different))
        number = rank * shards + shard
        cut = np.cumsum(sizes)[:-1]
        rows = [
            (piece, shard, _pack(np.array([len(a)]), a, b))
            for piece, a, b in zip(
                table.column("piece").to_pylist(),
                np.split(number[which], cut),
                np.split(total[which], cut),
                strict=True,
            )
        ]
        rows.append((-1, shard, _pack(np.array([total.sum(), (total > 0).sum()]))))
        return _reply(rows)

    sent = coded.select("piece", *_COLUMNS).mapInArrow(send, _REPLY)
    return sent.groupBy("shard").applyInArrow(meet, _REPLY)


def _known(words: np.ndarray, answers: pa.Table, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Number and count of each of a piece's words, from the shards' answers."""
    number, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    data = dict(
        zip(answers.column("shard").to_pylist(), answers.column("payload").to_pylist(), strict=True)
    )
    for s, i in _split(shard_of(words, shards)):
        raw = _unpack(data[s])
        number[i] = _read(raw, np.int64, len(i), 8)
        count[i] = _read(raw, np.int64, len(i), 8 + 8 * len(i))
    return number, count


def _bigrams(
    at: np.ndarray, numbers: np.ndarray, end: int, size: int
) -> tuple[np.ndarray, np.ndarray]:
    """The different bigrams of a piece as one number each, and that of each token.

    The context of a text's first token is the end of a text.
    """
    before = np.empty(len(numbers), np.int64)
    before[1:] = numbers[:-1]
    before[at[:-1]] = end
    return np.unique(before * size + numbers, return_inverse=True)


def _end_of(words: np.ndarray) -> int:
    return int(np.searchsorted(words, END))


def _ask(coded: DataFrame, counts: DataFrame, shards: int) -> DataFrame:
    """A piece's different bigrams, sent to the bigrams' shards in the order of their numbers."""

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in left.to_pylist():
            _, held, at, numbers, words = _opened(row)
            number, count = _known(words, right, shards)
            n = len(words)
            pair, which = _bigrams(at, numbers, _end_of(words), n)
            learned = np.repeat(~held, np.diff(at))
            times = np.bincount(which[learned], minlength=len(pair)).astype(np.int32)
            v, w = pair // n, pair % n
            for s, i in _split(_pair_shard(number[v], number[w], shards)):
                # In the order of the context's, then the word's number: small steps, well packed.
                i = i[np.lexsort((number[w[i]], number[v[i]]))]
                rows.append(
                    (
                        row["piece"],
                        s,
                        _pack(
                            np.array([len(i)]),
                            np.diff(number[v[i]], prepend=0),
                            number[w[i]],
                            count[v[i]],
                            count[w[i]],
                            times[i],
                        ),
                    )
                )
        return _reply(rows)

    return coded.groupBy("piece").cogroup(counts.groupBy("piece")).applyInArrow(send, _REPLY)


def _pair_shard(v: np.ndarray, w: np.ndarray, shards: int) -> np.ndarray:
    return shard_of(mix(mix(v.astype(np.uint64)) + w.astype(np.uint64)), shards)


def _answer(asked: DataFrame, total: int, different: int, strength: float) -> DataFrame:
    """Build each shard's trie from the counts of all pieces, and look up what they ask."""

    def meet(table: pa.Table) -> pa.Table:
        parts, sizes = [], []
        for data in table.column("payload").to_pylist():
            raw = _unpack(data)
            n = int(_read(raw, np.int64, 1)[0])
            wide = [_read(raw, np.int64, n, 8 + 8 * n * k) for k in range(4)]
            times = _read(raw, np.int32, n, 8 + 32 * n)
            parts.append((np.cumsum(wide[0]), *wide[1:], times))
            sizes.append(n)
        v, w, cv, cw, times = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((w, v))
        seen = order[times[order] > 0]
        new = np.ones(len(seen), bool)
        new[1:] = (v[seen][1:] != v[seen][:-1]) | (w[seen][1:] != w[seen][:-1])
        begin = np.flatnonzero(new)
        top = seen[begin]
        both = np.add.reduceat(times[seen].astype(np.int64), begin) if len(seen) else times[:0]
        low = (cw[top] + ADDED) / (total + ADDED * (different + 1))
        score = np.log10((both + strength * low) / (cv[top] + strength))
        with tempfile.TemporaryDirectory() as folder:
            trie = Trie.build(v[top], w[top], score, folder)
            codes = trie.find(v, w)
        packed = [_pack(x) for x in np.split(codes, np.cumsum(sizes)[:-1])]
        return table.set_column(2, "payload", pa.array(packed, pa.binary()))

    return asked.groupBy("shard").applyInArrow(meet, _REPLY)


RESULT_SCHEMA = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
    "base_score double, score double"
)


def score_texts(docs: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """Score every row of ``docs(doc_id, text)`` with a model of the rows that are not held out.

    Words are split at ASCII white space, A-Z count as a-z, and every text ends in
    one more token. Gives ``doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score``; scores are log10 probabilities, of single words
    (``base_score``) and of the bigram model (``score``).

    A null text is empty and has its end only. Rows with an equal id are scored
    one by one. Rows without an id are left out; further columns are not read.
    With nothing to learn from, all tokens are unknown.
    """
    spark = docs.sparkSession
    shards = shards_for(text_bytes(docs))
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    coded = _encoded(docs, buckets)
    counts = stored(_word_counts(coded, shards), "word-counts")
    total = different = 0
    for row in counts.where("piece = -1").select("payload").toLocalIterator():
        n, v = _read(_unpack(bytes(row["payload"])), np.int64)
        total, different = total + int(n), different + int(v)
    counts = counts.where("piece >= 0")
    answers = _answer(_ask(coded, counts, shards), total, different, strength)
    # Counts and codes come to the piece together, told apart by their shard's sign.
    mail = counts.withColumn("shard", -1 - F.col("shard")).unionAll(answers)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[] for _ in range(6)]
        flags = np.array(right.column("shard").to_pylist()) < 0
        first = right.filter(pa.array(flags))
        first = first.set_column(
            1, "shard", pa.array([-1 - x for x in first.column("shard").to_pylist()], pa.int32())
        )
        second = right.filter(pa.array(~flags))
        codes = dict(
            zip(second.column("shard").to_pylist(), second.column("payload").to_pylist(), strict=True)
        )
        for row in left.to_pylist():
            ids, held, at, numbers, words = _opened(row)
            number, count = _known(words, first, shards)
            n = len(words)
            pair, which = _bigrams(at, numbers, _end_of(words), n)
            v, w = pair // n, pair % n
            code = np.full(len(pair), ABSENT)
            for s, i in _split(_pair_shard(number[v], number[w], shards)):
                i = i[np.lexsort((number[w[i]], number[v[i]]))]
                code[i] = _read(_unpack(codes[s]), np.uint16)
            low = np.log10((count + ADDED) / (total + ADDED * (different + 1)))
            back = np.log10(strength / (count[v] + strength)) + low[w]
            value = np.where(code == ABSENT, back, -code.astype(np.float64) * STEP)
            begin = at[:-1]
            for k, x in enumerate(
                (
                    ids,
                    held,
                    np.diff(at),
                    np.add.reduceat((count[numbers] > 0).astype(np.int64), begin),
                    np.add.reduceat(low[numbers], begin),
                    np.add.reduceat(value[which], begin),
                )
            ):
                out[k].append(x)
        cols = [np.concatenate(x) if x else np.empty(0) for x in out]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        table = {n: pa.array(c, k) for n, c, k in zip(names, cols, kinds, strict=True)}
        table["train_tokens"] = pa.array([total] * len(cols[0]), pa.int64())
        return pa.table(table).select([*names[:4], "train_tokens", *names[4:]])

    return coded.groupBy("piece").cogroup(mail.groupBy("piece")).applyInArrow(
        finish, RESULT_SCHEMA
    )
