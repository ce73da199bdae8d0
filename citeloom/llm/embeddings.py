"""Near-duplicate embeddings by a robust-pruned flat graph.

1. Equal vectors stand behind one; it carries how many it stands for.
2. Centroids are fitted to a bounded sample; every vector goes to the shards of its
   nearest few, so shards overlap.
3. In each shard, every vector's nearest candidates are pruned to a few edges in
   different directions (robust pruning); the adjacency lists of all shards are
   united.
4. In each shard, all its vectors search the graph from the shard's medoid,
   greedily until their neighbourhood is reached, then on through everything in
   range. What is found is verified in double precision.
5. An audit compares a bounded set of queries with all vectors by brute force; if too
   little was found, the search is repeated with more shards a vector and wider
   beams.

A link is counted in the first shard that its two vectors share, so nothing is
listed by pairs: a shard tells each vector's count and the smallest vector it
reaches. Shards that grow beyond a bound are compared exactly, tile by tile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.components import components
from citeloom.llm.shared import stored

COSINE = 0.9
#: Vectors that centroids are fitted to, and vectors of a usual shard.
SAMPLE, SHARD = 20_000, 1_500
#: A larger shard is compared in tiles of that many vectors.
LARGEST, TILE = 6_000, 2_000
OVERLAP, DEGREE, CANDIDATES, ALPHA, BEAM = 4, 12, 48, 1.2, 24
#: Rings in random order through all vectors of a shard: edges that lead out of tight groups.
RINGS = 4
#: How far below the threshold the search goes on through the graph.
SLACK = 0.06
#: Queries of the audit, the least mean share of their links that must be found, and
#: how many links a query has at most to be judged with its like as well.
AUDIT, RECALL, FEW = 512, 0.97, 8
_BLOCK = 200_000


def _heads(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable vectors as unit vectors, and the first id and the number of each different one."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").to_pylist()
            rows = [np.array(v, np.float64) for v in x]
            norms = [float(np.sqrt(v @ v)) for v in rows]
            # Very large or very small numbers are scaled before they are squared.
            units = []
            for v, n in zip(rows, norms, strict=True):
                if not np.isfinite(n) or n < 1e-140:
                    v = v / np.abs(v).max()
                    n = float(np.sqrt(v @ v))
                units.append((v / n).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(units, pa.binary())], names=["id", "unit"]
            )

    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = vectors.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull()
        & F.col("v").isNotNull()
        & ~bad
        & F.exists(F.col("v"), lambda c: c != 0.0)
    )
    units = usable.mapInArrow(read, "id long, unit binary")
    marks = units.select(
        "id", "unit", F.md5("unit").alias("mark"), F.octet_length("unit").alias("size")
    )
    marks = stored(marks, "units")
    first = marks.groupBy("mark", "size").agg(
        F.min("id").alias("head"), F.count("*").alias("copies")
    )
    return marks, stored(first, "heads")


def centroids(sample: np.ndarray, count: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Directions in the middle of groups of the sample (spherical k-means)."""
    rng = np.random.default_rng(seed)
    middle = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate(
            [(sample[i : i + 4096] @ middle.T).argmax(1) for i in range(0, len(sample), 4096)]
        )
        total = np.zeros_like(middle)
        np.add.at(total, near, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        middle = np.where(norm > 0, total / np.maximum(norm, 1e-30), middle).astype(np.float32)
    return middle


def pruned(x: np.ndarray) -> np.ndarray:
    """Edges of a robust-pruned graph over unit vectors: places, or -1.

    Of a vector's nearest candidates, the nearest is taken and all those it is
    closer to by a factor than the vector itself are passed over; and so on.
    """
    n = len(x)
    k = min(CANDIDATES, n - 1)
    out = np.full((n, DEGREE + RINGS), -1, np.int32)
    if k < 1:
        return out
    for i in range(0, n, 512):
        own = np.arange(i, min(i + 512, n))
        s = x[own] @ x.T
        s[np.arange(len(own)), own] = -2
        cand = np.argpartition(-s, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(s, cand, 1)
        order = np.argsort(-near, axis=1, kind="stable")
        cand, near = np.take_along_axis(cand, order, 1), np.take_along_axis(near, order, 1)
        gap = np.sqrt(np.maximum(2 - 2 * near, 0))
        left = np.ones(cand.shape, bool)
        vectors = x[cand]
        for r in range(DEGREE):
            first = left.argmax(1)
            some = left[np.arange(len(own)), first]
            pick = cand[np.arange(len(own)), first]
            out[own[some], r] = pick[some]
            to_pick = np.sqrt(np.maximum(2 - 2 * np.einsum("ikd,id->ik", vectors, x[pick]), 0))
            left &= ALPHA * to_pick > gap
            left[np.arange(len(own)), first] = False
    draw = np.random.default_rng(n)
    for r in range(DEGREE, DEGREE + RINGS):
        ring = draw.permutation(n)
        out[ring, r] = np.roll(ring, 1)
    return out


def reach(x: np.ndarray, edges: np.ndarray, least: float, beam: int) -> np.ndarray:
    """All pairs (query, vector) found at ``least`` or above, every vector being a query.

    A greedy search with a beam starts at the medoid; once its beam is used up,
    the search expands from the query itself, too, through all vectors found in
    range until none is new.
    """
    n = len(x)
    medoid = int((x @ x.mean(0)).argmax())
    seen = np.zeros((n, n), bool)
    seen[:, medoid] = True
    ids = np.full((n, beam), -1, np.int32)
    near = np.full((n, beam), -np.inf, np.float32)
    done = np.ones((n, beam), bool)
    ids[:, 0], near[:, 0], done[:, 0] = medoid, x @ x[medoid], False
    hits = [np.flatnonzero(near[:, 0] >= least) * n + medoid]

    def look(query: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Neighbours of a place not seen by its query yet, and how near they are."""
        to = edges[at]
        q = np.repeat(query, edges.shape[1]).reshape(to.shape)[to >= 0]
        to = to[to >= 0]
        new = ~seen[q, to]
        pair = np.unique(q[new].astype(np.int64) * n + to[new])
        q, to = pair // n, pair % n
        seen[q, to] = True
        s = np.empty(len(q), np.float32)
        for i in range(0, len(q), _BLOCK):
            a, b = q[i : i + _BLOCK], to[i : i + _BLOCK]
            s[i : i + _BLOCK] = np.einsum("ij,ij->i", x[a], x[b])
        return q, to, s

    while True:
        score = np.where(done, -np.inf, near)
        best = score.argmax(1)
        active = np.flatnonzero(score[np.arange(n), best] > -np.inf)
        if not len(active):
            break
        done[active, best[active]] = True
        q, to, s = look(active, ids[active, best[active]])
        hits.append(q[s >= least] * n + to[s >= least])
        if not len(q):
            continue
        # The best of what was found comes in for the worst of the beam.
        order = np.lexsort((-s, q))
        q, to, s = q[order], to[order], s[order]
        begin = np.flatnonzero(np.diff(q, prepend=-1))
        rank = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
        rows, row_of = np.unique(q, return_inverse=True)
        wide = int(min(rank.max() + 1, beam))
        fits = rank < wide
        new_ids = np.full((len(rows), wide), -1, np.int32)
        new_near = np.full((len(rows), wide), -np.inf, np.float32)
        new_ids[row_of[fits], rank[fits]], new_near[row_of[fits], rank[fits]] = to[fits], s[fits]
        both = np.concatenate([near[rows], new_near], 1)
        top = np.argpartition(-both, beam - 1, axis=1)[:, :beam]
        for table, more in ((near, new_near), (ids, new_ids), (done, np.isinf(new_near))):
            table[rows] = np.take_along_axis(np.concatenate([table[rows], more], 1), top, 1)
    hits.append(np.arange(n) * (n + 1))
    front = np.unique(np.concatenate(hits))
    found = [front]
    while len(front):
        part, front = front[:_BLOCK], front[_BLOCK:]
        q, to, s = look(part // n, part % n)
        new = q[s >= least] * n + to[s >= least]
        found.append(new)
        front = np.concatenate([front, new])
    return np.unique(np.concatenate(found))


def _smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the smallest place it reaches over the links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _counted(
    ids: np.ndarray,
    copies: np.ndarray,
    homes: np.ndarray,
    units: np.ndarray,
    a: np.ndarray,
    b: np.ndarray,
    shard: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each vector that count here, with and without copies, and the smallest id it reaches."""
    good = np.empty(len(a), bool)
    counts = np.empty(len(a), bool)
    for i in range(0, len(a), _BLOCK):
        p, q = a[i : i + _BLOCK], b[i : i + _BLOCK]
        good[i : i + _BLOCK] = np.einsum("ij,ij->i", units[p], units[q]) >= COSINE
        same = homes[p][:, :, None] == homes[q][:, None, :]
        first = np.where(same, homes[p][:, :, None], np.iinfo(np.int64).max).min((1, 2))
        counts[i : i + _BLOCK] = first == shard
    a, b, counts = a[good], b[good], counts[good]
    n, heads = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    np.add.at(n, a[counts], copies[b[counts]])
    np.add.at(n, b[counts], copies[a[counts]])
    np.add.at(heads, a[counts], 1)
    np.add.at(heads, b[counts], 1)
    return n, heads, ids[_smallest(len(ids), a, b)]


def _in_shard(x: np.ndarray, edges: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a shard that may be linked: what the search finds, and what it has missed.

    A link counts in the first shard its vectors share, so each shard has to know
    all of its own, whatever other shards find. It compares its vectors once more
    in blocks, as it does for its edges.
    """
    n = len(x)
    pairs = [reach(x, edges, COSINE - SLACK, beam)]
    for i in range(0, n, 512):
        a, b = np.nonzero(x[i : i + 512] @ x.T >= COSINE - 1e-4)
        pairs.append((a + i) * n + b)
    a, b = np.divmod(np.concatenate(pairs), n)
    pairs = np.unique(np.minimum(a, b) * n + np.maximum(a, b))
    a, b = pairs // n, pairs % n
    return a[a < b], b[a < b]


_PART = "id long, n long, heads long, low long"


def _members(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Ids (ascending), copies, homes and unit vectors of a shard."""
    table = table.sort_by("id")
    units = np.frombuffer(b"".join(table.column("unit").to_pylist())).reshape(len(table), -1)
    homes = np.array(table.column("homes").to_pylist(), np.int64)
    return table.column("id").to_numpy(), table.column("copies").to_numpy(), homes, units


def _linked(
    heads: DataFrame, count: int, overlap: int, beam: int, exact: bool = False
) -> DataFrame:
    """``id, n, low`` rows: counts to be added up, and links to smaller ids.

    With ``exact``, all shards are compared tile by tile.
    """
    groups = max(1, math.ceil(count * overlap / SHARD))
    groups = min(groups, SAMPLE // 8)
    share = min(1.0, 1.5 * SAMPLE / max(count, 1))
    drawn = heads.where(
        F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1)
    )
    rows = drawn.orderBy(F.xxhash64("id")).limit(SAMPLE).select("unit").toPandas()["unit"]
    sample = np.frombuffer(b"".join(map(bytes, rows))).reshape(len(rows), -1).astype(np.float32)
    middle = centroids(sample, groups)
    homes_each = min(overlap, len(middle))
    sent = heads.sparkSession.sparkContext.broadcast(middle)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units = np.frombuffer(b"".join(batch.column("unit").to_pylist()))
            near = units.reshape(batch.num_rows, -1).astype(np.float32) @ sent.value.T
            top = np.argpartition(-near, homes_each - 1, axis=1)[:, :homes_each]
            homes = pa.array(np.sort(top, axis=1).astype(np.int64).tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, homes], names=[*batch.schema.names, "homes"])

    placed = stored(
        heads.select("id", "copies", "unit").mapInArrow(
            assign, "id long, copies long, unit binary, homes array<long>"
        ),
        "placed",
    )
    spread = placed.withColumn("shard", F.explode("homes"))
    sizes = stored(spread.groupBy("shard").agg(F.count("*").alias("rows")), "sizes")
    if exact:
        return _tiled(spread, sizes)
    large = [r["shard"] for r in sizes.where(F.col("rows") > LARGEST).collect()]
    usual = spread.where(~F.col("shard").isin(large)) if large else spread

    def build(table: pa.Table) -> pa.Table:
        ids, _, _, units = _members(table)
        edges = pruned(units.astype(np.float32))
        return pa.table(
            {
                "id": pa.array(ids),
                "edges": pa.array(
                    [ids[row[row >= 0]].tolist() for row in edges], pa.list_(pa.int64())
                ),
            }
        )

    built = usual.groupBy("shard").applyInArrow(build, "id long, edges array<long>")
    union = built.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("edges"))).alias("edges"))
    graph = placed.join(stored(union, "graph"), "id").withColumn("shard", F.explode("homes"))
    graph = graph.where(~F.col("shard").isin(large)) if large else graph

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        shard = table.column("shard")[0].as_py()
        ids, copies, homes, units = _members(table)
        lists = table.column("edges").to_pylist()
        width = max(map(len, lists), default=0)
        edges = np.full((len(ids), max(width, 1)), -1, np.int32)
        for i, row in enumerate(lists):
            to = np.searchsorted(ids, row)
            to = to[(to < len(ids)) & (ids[np.minimum(to, len(ids) - 1)] == row)]
            edges[i, : len(to)] = to
        a, b = _in_shard(units.astype(np.float32), edges, beam)
        n, different, low = _counted(ids, copies, homes, units, a, b, shard)
        return pa.table({"id": ids, "n": n, "heads": different, "low": low})

    found = graph.groupBy("shard").applyInArrow(search, _PART)
    if large:
        found = found.unionAll(_tiled(spread.where(F.col("shard").isin(large)), sizes))
    return found


def _tiled(spread: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every pair of tiles of the large shards, compared exactly."""
    rows = spread.join(sizes, "shard").withColumn("tiles", F.ceil(F.col("rows") / TILE).cast("int"))
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, copies, homes, units = _members(table)
        tile, i, j = (table.column(c).to_numpy() for c in ("tile", "i", "j"))
        mine, others = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        a_all, b_all = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k in range(0, len(mine), 256):
            rows = mine[k : k + 256]
            p, q = np.nonzero(units[rows] @ units[others].T >= COSINE - 1e-9)
            p, q = rows[p], others[q]
            good = p < q if i[0] == j[0] else p != q
            a_all.append(p[good])
            b_all.append(q[good])
        a, b = np.concatenate(a_all), np.concatenate(b_all)
        shard = table.column("shard")[0].as_py()
        n, different, low = _counted(ids, copies, homes, units, a, b, shard)
        return pa.table({"id": ids, "n": n, "heads": different, "low": low})

    return rows.groupBy("shard", "i", "j").applyInArrow(compare, _PART)


def _true_links(heads: DataFrame, queries: list) -> dict[int, int]:
    """Links of the queries to different vectors by brute force: the query set, in blocks, against all vectors."""
    ids = np.array([r["id"] for r in queries])
    x = np.frombuffer(b"".join(bytes(r["unit"]) for r in queries)).reshape(len(ids), -1)
    sent = heads.sparkSession.sparkContext.broadcast((ids, x))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = sent.value
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            if batch.num_rows:
                y = np.frombuffer(b"".join(batch.column("unit").to_pylist()))
                y = y.reshape(batch.num_rows, -1)
                near = (x @ y.T >= COSINE) & (ids[:, None] != batch.column("id").to_numpy())
                total += near.sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["id", "n"])

    found = heads.select("id", "unit").mapInArrow(count, "id long, n long")
    return {r["id"]: r["n"] for r in found.groupBy("id").agg(F.sum("n").alias("n")).collect()}


def audited(heads: DataFrame, found: DataFrame) -> float:
    """The mean share of a query's links that the search has found, for a bounded set of queries.

    Copies of a vector count once, and the share is the smaller one of all queries
    that have links and of those that have few.

    Queries are the ``AUDIT`` vectors of the smallest hashes among those with an id
    that 100 divides, or among all if these are too few to tell.
    """
    ranked = heads.withColumn("mark", F.xxhash64("id")).orderBy(
        (F.col("id") % 100 != 0).cast("int"), "mark"
    )
    queries = ranked.limit(AUDIT).select("id", "unit").collect()
    if not queries:
        return 1.0
    true = _true_links(heads, queries)
    have = found.where(F.col("id").isin([r["id"] for r in queries]))
    got = {r["id"]: r["n"] for r in have.groupBy("id").agg(F.sum("heads").alias("n")).collect()}
    shares = {k: min(got.get(k, 0), n) / n for k, n in true.items() if n}
    few = [x for k, x in shares.items() if true[k] <= FEW]
    return min((sum(x) / len(x) for x in (list(shares.values()), few) if x), default=1.0)


def near_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each row of ``vectors(vec_id, embedding)``.

    Two vectors are linked if their cosine is 0.9 or more. Vectors that are null,
    empty, zero, or hold a null, NaN or infinite number link with nothing, and
    vectors of different length do not link with each other. Equal vectors link,
    and share all other links. Rows with an equal id count as one vector each
    but carry the same result; rows without an id are left out. Further columns,
    labels too, are not read.
    """
    marks, first = _heads(vectors)
    parts = None
    for row in first.select("size").distinct().collect():
        mine = first.where(F.col("size") == row["size"])
        heads = marks.join(
            mine.select(F.col("head").alias("id"), "mark", "size", "copies"),
            ["id", "mark", "size"],
        ).dropDuplicates(["id", "mark"])
        heads = stored(heads.select("id", "copies", "unit"), "unit-heads")
        count = heads.count()
        overlap, beam = OVERLAP, BEAM
        for _ in range(3):
            found = stored(_linked(heads, count, overlap, beam), "found")
            if audited(heads, found) >= RECALL:
                break
            overlap, beam = 2 * overlap, 2 * beam
        else:
            found = stored(_linked(heads, count, overlap, beam, exact=True), "found")
        parts = found if parts is None else parts.unionAll(found)
    ids = vectors.select(F.col("vec_id").cast("long")).where("vec_id IS NOT NULL")
    if parts is None:
        return ids.select(
            "vec_id",
            F.lit(0).cast("long").alias("n_links"),
            F.col("vec_id").alias("component_id"),
            F.lit(True).alias("kept"),
        )
    sums = stored(parts.groupBy("id").agg(F.sum("n").alias("n")), "sums")
    links = parts.where("low < id").select(F.col("id").alias("a"), F.col("low").alias("b"))
    found = stored(components(links.distinct()), "vector-components")
    known = marks.select("id", "mark", "size").join(first, ["mark", "size"])
    known = known.select(F.col("id").alias("vec_id"), F.col("head").alias("id"), "copies")
    known = known.join(sums, "id", "left").join(found, "id", "left")
    known = known.groupBy("vec_id").agg(
        F.sum(F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.min(F.coalesce("component", "id")).alias("component_id"),
    )
    out = ids.join(known, "vec_id", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
