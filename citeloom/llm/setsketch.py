"""Near-duplicate documents by SetSketch registers (Ertl, 2021).

A register is the truncated, exponentially spaced minimum of an exponential
variable over a document's shingles: ``floor(1 - log_b(min))``, held in 16 bits.
Registers merge by maximum and are equal in two sketches about as often as the
sets overlap, so bands of them find candidates. The overlap of a candidate pair
is first estimated from how many registers are larger, smaller and equal, at the
maximum of their joint likelihood, and then confirmed on the full sets.

Only components are wanted, so pairs within a bucket are not listed. Every
document is compared with the first of its bucket, then with one that a hash
picks among those of other components; what stands in one
component needs no comparison. What is then left apart in a bucket is compared
with all of it in tiles of bounded size, and a tile tells only the links that
join components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.components import components
from citeloom.llm.shared import stored
from citeloom.llm.words import NOT_SPACE, mix, pieces, shingles, words_of

BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
BASE = 1.001
#: An estimate may be this much too low (over five standard errors).
MARGIN = 0.18
#: Rounds with one partner each before the rest is compared in tiles.
ROUNDS = 1
#: Documents of a tile in the comparison of what the first round left apart.
TILE = 256
_SALT = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_ODD = _SALT | np.uint64(1)
_STEP = mix(_SALT + np.uint64(7))
_BLOCK = 1 << 15


def _distinct(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes by text, ascending, and where each text's begin."""
    found, owner = shingles(words, first, n)
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    if len(found):
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
        found, owner = found[new], owner[new]
    return found, np.searchsorted(owner, np.arange(len(first)))


def _minima(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each run of values, the smallest under each of the hash functions."""
    out = np.empty((len(begins) - 1, REGISTERS), np.uint64)
    i = 0
    while i < len(begins) - 1:
        j = int(np.searchsorted(begins, begins[i] + _BLOCK, side="right")) - 1
        j = max(j, i + 1)
        part, at = values[begins[i] : begins[j]], begins[i:j] - begins[i]
        for k in range(REGISTERS):
            out[i:j, k] = np.minimum.reduceat(part * _ODD[k] + _STEP[k], at)
        i = j
    return out


def registers(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Registers of non-empty runs of hashes: one row of 16-bit numbers for each."""
    least = _minima(values, begins)
    u = (least.astype(np.float64) + 0.5) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 1e-16))
    return np.clip(np.floor(1 - np.log(x) / math.log(BASE)) + 4096, 0, 65535).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def estimate(
    more: np.ndarray, less: np.ndarray, size_a: np.ndarray, size_b: np.ndarray
) -> np.ndarray:
    """The overlap (Jaccard) at which the register comparison is most likely.

    ``more`` and ``less`` count the registers where the first sketch is larger or
    smaller; the likelihood is concave in the overlap, so thirds are cut off.
    """
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)
    equal = REGISTERS - more - less

    def p(x: np.ndarray) -> np.ndarray:
        x = np.clip(x, 1e-12, 1.0)
        return np.clip(-np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE), 1e-12, 1.0)

    def likelihood(j: np.ndarray) -> np.ndarray:
        a, b = p(u - v * j), p(v - u * j)
        return more * np.log(a) + less * np.log(b) + equal * np.log(np.maximum(1 - a - b, 1e-12))

    low = np.zeros(u.shape)
    high = np.minimum(u / v, v / u)
    for _ in range(30):
        one, two = low + (high - low) / 3, high - (high - low) / 3
        up = likelihood(one) < likelihood(two)
        low, high = np.where(up, one, low), np.where(up, high, two)
    return (low + high) / 2


SKETCH_SCHEMA = "doc_id long, n_shingles long, mark1 long, mark2 long, registers binary"


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """Set size, order-free fingerprint and registers of every document's shingles."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            words, first, _ = words_of(part.column("text"), NOT_SPACE)
            found, begins = _distinct(words, first, n)
            sizes = np.diff(begins)
            some = sizes > 0
            starts = begins[:-1][some]
            marks = np.zeros((2, len(sizes)), np.uint64)
            packed: list[bytes | None] = [None] * len(sizes)
            if some.any():
                for k in (0, 1):
                    one = mix(found + _SALT[k])
                    marks[k, some] = np.add.reduceat(one, starts)
                rows = registers(found, np.append(starts, len(found)))
                for i, row in zip(np.flatnonzero(some), rows, strict=True):
                    packed[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(marks[0].view(np.int64)),
                    pa.array(marks[1].view(np.int64)),
                    pa.array(packed, pa.binary()),
                ],
                names=["doc_id", "n_shingles", "mark1", "mark2", "registers"],
            )

    return docs.mapInArrow(sketch, SKETCH_SCHEMA)


def _band_keys(rows: np.ndarray) -> np.ndarray:
    """The key of each band of each row of registers."""
    rows = rows.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(_SALT[:BANDS], rows.shape[:2])
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
    return key.view(np.int64)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16)
        ids = batch.column("doc_id").to_numpy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(_band_keys(rows).ravel()), pa.array(np.repeat(ids, BANDS))],
            names=["key", "doc_id"],
        )


def _likely(
    a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float
) -> np.ndarray:
    """Pairs of register rows whose sets may overlap enough."""
    fits = np.minimum(na, nb) >= least * np.maximum(na, nb) * (1 - 1e-9)
    # Registers are equal about as often as the sets overlap; what is far off that
    # needs no estimate.
    fits &= (a == b).sum(-1) >= (least - MARGIN - 0.05) * REGISTERS
    i = np.flatnonzero(fits)
    if len(i):
        a = a[i] if a.ndim > 1 else a
        more, less = (a > b[i]).sum(-1), (a < b[i]).sum(-1)
        fits[i] = estimate(more, less, na[i].astype(float), nb[i].astype(float)) >= least - MARGIN
    return fits


def _linked(x: bytes, y: bytes, percent: int) -> bool:
    """Whether two full sets of hashes share enough of their union."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _confirmed(pairs: DataFrame, sketch: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs ``(a, b)``, those likely by their registers and linked by their full sets."""
    side = sketch.select("doc_id", F.col("n_shingles").alias("n"), "registers")
    both = pairs.join(side.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra")), "a")
    both = both.join(side.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb")), "b")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sides = [
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                for c in ("ra", "rb")
            ]
            good = _likely(
                *sides, batch.column("na").to_numpy(), batch.column("nb").to_numpy(), percent / 100
            )
            yield batch.select(["a", "b"]).filter(pa.array(good))

    likely = both.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(judge, "a long, b long")
    full = likely.join(sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("hb")), "b")
    full = full.join(sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("ha")), "a")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [
                _linked(x.as_py(), y.as_py(), percent)
                for x, y in zip(batch.column("ha"), batch.column("hb"), strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return full.select("a", "b", "ha", "hb").mapInArrow(confirm, "a long, b long")


def _partners(placed: DataFrame, turn: int) -> DataFrame:
    """Pairs of a document and one of another component that a hash picks in its bucket."""
    pick = F.min(F.struct(F.xxhash64("doc_id", "key", F.lit(turn)), "doc_id", "component"))
    heads = placed.groupBy("key").agg(
        pick.alias("h"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    heads = heads.where("low < high").select(
        "key", F.col("h.doc_id").alias("a"), F.col("h.component").alias("its")
    )
    pairs = placed.join(stored(heads, "picked"), "key").where("component <> its")
    return pairs.select(F.least("a", "doc_id").alias("a"), F.greatest("a", "doc_id").alias("b"))


def _apart(placed: DataFrame, sketch: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between documents of one bucket that are in different components so far.

    What shares a bucket's most frequent component needs no comparison among
    itself. The others, in tiles, meet all documents of the bucket, in tiles; a
    group is two tiles, and once two components are joined in it they count as one.
    """
    least = percent / 100
    buckets = placed.groupBy("key").agg(
        F.count("*").alias("n"),
        F.mode("component").alias("main"),
        F.min("component").alias("low"),
        F.max("component").alias("high"),
    )
    buckets = stored(buckets.where("low < high").select("key", "n", "main"), "split-buckets")
    rows = placed.join(buckets, "key").withColumn("odd", F.col("component") != F.col("main"))
    counts = rows.groupBy("key").agg(F.sum(F.col("odd").cast("int")).alias("n_odd"))
    rows = rows.join(stored(counts, "odd-counts"), "key")
    rows = rows.withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int")).withColumn(
        "odd_tiles", F.ceil(F.col("n_odd") / TILE).cast("int")
    )
    place = F.xxhash64("doc_id")
    all_rows = rows.select(
        "key",
        F.explode(F.sequence(F.lit(0), F.col("odd_tiles") - 1)).alias("i"),
        F.pmod(place, F.col("tiles")).cast("int").alias("j"),
        "doc_id",
        "component",
        F.lit(False).alias("odd"),
    )
    odd_rows = rows.where("odd").select(
        "key",
        F.pmod(place, F.col("odd_tiles")).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("j"),
        "doc_id",
        "component",
        F.lit(True).alias("odd"),
    )
    full = all_rows.unionAll(odd_rows)
    full = full.join(sketch.select("doc_id", "n_shingles", "registers"), "doc_id")
    full = full.join(sets, "doc_id")

    def compare(table: pa.Table) -> pa.Table:
        mine = table.filter(table.column("odd"))
        others = table.filter(pc.invert(table.column("odd")))
        regs = [
            np.frombuffer(b"".join(t.column("registers").to_pylist()), np.uint16)
            for t in (mine, others)
        ]
        regs = [r.reshape(-1, REGISTERS) for r in regs]
        (id_a, id_b), (part_a, part_b), (n_a, n_b) = (
            [t.column(c).to_numpy() for t in (mine, others)]
            for c in ("doc_id", "component", "n_shingles")
        )
        hash_a, hash_b = mine.column("hashes"), others.column("hashes")
        band = int((_band_keys(regs[0][:1])[0] == table.column("key")[0].as_py()).argmax())
        before = slice(0, band * ROWS)
        rows, cols = [], []
        for i in range(0, len(mine), 32):
            near = (regs[0][i : i + 32, None] == regs[1][None]).sum(-1)
            r, c = np.nonzero(
                (near >= (least - MARGIN - 0.05) * REGISTERS)
                & (part_a[i : i + 32, None] != part_b[None])
            )
            rows.append(r + i)
            cols.append(c)
        rows, cols = np.concatenate(rows), np.concatenate(cols)
        # Two documents that share several buckets are compared in the first of them.
        earlier = regs[0][rows, before] == regs[1][cols, before]
        new = ~earlier.reshape(len(rows), band, ROWS).all(2).any(1)
        rows, cols = rows[new], cols[new]
        good = _likely(regs[0][rows], regs[1][cols], n_a[rows], n_b[cols], least)
        root = {int(x): int(x) for x in np.concatenate([part_a, part_b])}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        links = []
        for i, k in zip(rows[good], cols[good], strict=True):
            x, y = find(int(part_a[i])), find(int(part_b[k]))
            if x != y and _linked(hash_a[i].as_py(), hash_b[k].as_py(), percent):
                links.append((min(id_a[i], id_b[k]), max(id_a[i], id_b[k])))
                root[max(x, y)] = min(x, y)
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        return pa.table({"a": a, "b": b})

    # Many small tasks: the work lies in comparing, not in bytes.
    tasks = 4 * int(full.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = full.repartition(tasks, "key", "i", "j")
    return dealt.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row of ``docs(doc_id, text)``.

    Documents are linked if their sets of ``n``-word shingles share ``percent`` in
    a hundred of their union. Words are split at ASCII white space, A-Z count as
    a-z. A component is named by its smallest id, and that document is kept.

    Null, empty and wordless texts have no shingles and are linked with nothing;
    a text of fewer words has all of them as its one shingle. Rows with an equal
    id are one document with several texts; rows without an id are left out.
    Equal sets count once and are never paired. Further columns are not read.
    """
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    slim = slim.where("doc_id IS NOT NULL")
    every = stored(sketches(slim, n), "sketches")
    some = every.where("n_shingles > 0")
    # Documents of equal sets stand behind the one with the smallest id.
    marks = ["n_shingles", "mark1", "mark2"]
    heads = stored(some.groupBy(*marks).agg(F.min("doc_id").alias("head")), "heads")
    headed = some.drop("registers").join(heads, marks).select("doc_id", "head", *marks)
    sketch = some.join(
        heads.withColumnRenamed("head", "doc_id"), ["doc_id", *marks], "left_semi"
    ).dropDuplicates(["doc_id", "mark1", "mark2"])
    sketch = stored(sketch.select(every.columns), "head-sketches")

    bands = stored(
        sketch.select("doc_id", "registers").mapInArrow(_bands, "key long, doc_id long"), "bands"
    )
    buckets = bands.groupBy("key").agg(
        F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")
    )
    buckets = stored(buckets.where("leader < last").select("key", "leader"), "buckets")
    members = stored(bands.join(buckets, "key"), "members")
    stars = members.where("doc_id <> leader").select(
        F.col("leader").alias("a"), F.col("doc_id").alias("b")
    )

    def keep_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            words, first, _ = words_of(part.column("text"), NOT_SPACE)
            found, at = _distinct(words, first, n)
            packed = [found[at[i] : at[i + 1]].tobytes() for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(packed, pa.binary())], names=["doc_id", "hashes"]
            )

    wanted = stored(members.select("doc_id").distinct(), "wanted")
    sets = slim.join(wanted, "doc_id", "left_semi")
    sets = stored(sets.mapInArrow(keep_sets, "doc_id long, hashes binary"), "sets")

    links = stored(_confirmed(stored(stars.distinct(), "pairs"), sketch, sets, percent), "linked")
    found = stored(components(links), "found")

    def placed() -> DataFrame:
        known = members.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        part = F.coalesce("component", "doc_id").alias("component")
        return stored(known.select("key", "doc_id", part), "placed")

    for turn in range(ROUNDS):
        pairs = stored(_partners(placed(), turn).distinct(), "pairs")
        more = stored(_confirmed(pairs, sketch, sets, percent), "linked")
        if more.isEmpty():
            break
        links = links.unionAll(more)
        found = stored(components(links), "found")
    rest = stored(_apart(placed(), sketch, sets, percent), "rest")
    if not rest.isEmpty():
        found = stored(components(links.unionAll(rest)), "found")

    joined = headed.select("doc_id", F.col("head").alias("id")).join(found, "id", "left")
    # An id with several texts links whatever these are linked with.
    parts = joined.select("doc_id", F.coalesce("component", "id").alias("component_id"))
    out = every.select("doc_id", "n_shingles").join(
        parts.groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "doc_id", "left"
    )
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
