"""Divergence between the sources of a language, term by term and pair by pair.

The counts of terms by group, a language's source, form a sparse matrix with a row
per group and a column per term. The columns are dealt to tasks; each task cuts its
part into squares and holds these as K²-trees, quadtrees of nonzero quadrants only.
The trees are walked once for all pairs of rows together: where both quadrants of a
pair are empty, all their cells are alike, and are priced as one number times their
width; other pairs are followed down to the cells. All numbers are whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.shared import stored
from citeloom.llm.words import LOWER, joined, pieces, spans

#: Documents of a language that a kept term is in, and ranks of terms that are told.
LEAST_DOCUMENTS, TOP_TERMS = 3, 200
#: The scale of probabilities.
_ONE = 1_000_000_000
_ALL = np.arange(256)
#: Bytes of terms: ASCII letters and everything beyond ASCII.
LETTERS = ((_ALL >= 65) & (_ALL <= 90)) | ((_ALL >= 97) & (_ALL <= 122)) | (_ALL >= 128)
#: Cells of a block of columns, and pairs of cells that are walked at a time.
_BLOCK_CELLS, _FRONTIER = 1 << 20, 1 << 21
#: Rows of one walk; more rows are walked by pairs of strips of so many.
_STRIP = 256


class Groups(NamedTuple):
    """All groups in order: their languages by number, their sources, and totals."""

    languages: list[str]
    lang: np.ndarray
    source: list[str]

    def numbers(self) -> dict[tuple[str, str], int]:
        return {(self.languages[k], s): i for i, (k, s) in enumerate(zip(self.lang, self.source, strict=True))}


def _groups(docs: DataFrame) -> Groups:
    rows = sorted(tuple(r) for r in docs.select("lang", "source").distinct().collect())
    languages = sorted({lang for lang, _ in rows})
    place = {x: i for i, x in enumerate(languages)}
    return Groups(languages, np.array([place[x] for x, _ in rows], np.int64), [s for _, s in rows])


def _terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different terms, and the number and text of each term that occurs."""
    body, at = joined(texts)
    begin, end, text = spans(body, at, LETTERS)
    letters = LOWER[body][LETTERS[body]]
    offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int64)
    array = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(letters))
    encoded = array.dictionary_encode()
    return encoded.dictionary.cast(pa.string()), encoded.indices.to_numpy().astype(np.int64), text


def _counted(docs: DataFrame, groups: Groups) -> DataFrame:
    """``l, term, g, n, d``: how often a group has a term, and in how many rows, by pieces of rows."""
    sent = docs.sparkSession.sparkContext.broadcast((groups.numbers(), groups.lang))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, lang = sent.value
        for part in pieces(batches):
            pairs = zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True)
            group = np.array([numbers[x] for x in pairs], np.int64)
            terms, number, text = _terms(part.column("text"))
            if not len(terms):
                continue
            cell, n = np.unique(text * len(terms) + number, return_counts=True)
            cell = group[cell // len(terms)] * len(terms) + cell % len(terms)
            cell, of = np.unique(cell, return_inverse=True)
            # Sums of whole numbers in doubles are exact here.
            total = np.bincount(of, weights=n).astype(np.int64)
            g = cell // len(terms)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(lang[g].astype(np.int32)),
                    terms.take(pa.array(cell % len(terms))),
                    pa.array(g.astype(np.int32)),
                    pa.array(total),
                    pa.array(np.bincount(of)),
                ],
                names=["l", "term", "g", "n", "d"],
            )

    return docs.mapInArrow(run, "l int, term string, g int, n long, d long")


def _columns(docs: DataFrame, groups: Groups, least: int) -> DataFrame:
    """``l, term, g, n``: a column of the matrix per kept term, with its nonzero cells as arrays.

    Cells are summed before columns are put together, so however frequent a term
    is, a task gets one row per group for it.
    """
    cells = _counted(docs, groups).groupBy("l", "term", "g").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    columns = cells.groupBy("l", "term").agg(F.sum("d").alias("d"), F.collect_list(F.struct("g", "n")).alias("cells"))
    columns = columns.where(F.col("d") >= least)
    return stored(columns.select("l", "term", F.col("cells.g").alias("g"), F.col("cells.n").alias("n")), "columns")


def probabilities(count: np.ndarray, total: np.ndarray, width: np.ndarray) -> np.ndarray:
    return 1 + _ONE * (count + 1) // (total + width)


class Tree:
    """A K²-tree over squares of ``side`` rows and columns: the nonzero quadrants of each level.

    A quadrant is told by one number: its square, then two bits a level, for the
    half of the rows and of the columns. A child is found by its number among
    those of the next level.
    """

    def __init__(self, row: np.ndarray, column: np.ndarray, side: int) -> None:
        self.height = side.bit_length() - 1
        code = column >> self.height
        for bit in reversed(range(self.height)):
            code = code << 2 | (row >> bit & 1) << 1 | (column >> bit & 1)
        self.cell = np.argsort(code, kind="stable")
        self.levels = [code[self.cell]]
        for _ in range(self.height):
            above = self.levels[0] >> 2
            self.levels.insert(0, above[np.append(True, np.diff(above) != 0)] if len(above) else above)

    def child(self, node: np.ndarray, level: int, lower: int, right: int) -> np.ndarray:
        """Where a child of each node stands in the next level; -1 if it is empty."""
        if not len(self.cell):
            return node
        code = self.levels[level][node] << 2 | lower << 1 | right
        there = self.levels[level + 1]
        at = np.minimum(np.searchsorted(there, code), len(there) - 1)
        return np.where((node >= 0) & (there[at] == code), at, -1)


def _walk(
    tree: Tree, squares: np.ndarray, width: int, rows: int, across: bool, empty: np.ndarray
) -> tuple[np.ndarray, ...]:
    """Pairs of rows ``(a, b)`` and their cells' places, -1 for an empty one; not both are.

    ``empty[a, b]`` is raised by the number of columns that are empty in both. Each
    pair ``a < b`` is met once; with ``across``, only those with a row in either
    half of the square.
    """
    side = 1 << tree.height
    roots = tree.levels[0]
    u = np.minimum(np.searchsorted(roots, squares), max(len(roots) - 1, 0))
    u = np.where(roots[u] == squares, u, -1) if len(roots) else np.full(len(squares), -1)
    v, column = u.copy(), squares.copy()
    a, b = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64)
    for level in range(tree.height):
        size = side >> (level + 1)
        parts = []
        for i, k in ((0, 1),) if across and not level else ((0, 0), (0, 1), (1, 0), (1, 1)):
            # Of a quadrant with itself, halves are met in one order only.
            use = np.flatnonzero((a < b) | (i <= k))
            for j in (0, 1):
                one = tree.child(u[use], level, i, j)
                other = tree.child(v[use], level, k, j)
                parts.append((one, other, a[use] * 2 + i, b[use] * 2 + k, column[use] * 2 + j))
        u, v, a, b, column = (np.concatenate(x) for x in zip(*parts, strict=True))
        inside = (a * size < rows) & (b * size < rows) & (column * size < width)
        if size == 1:
            inside &= a != b
        none = inside & (u < 0) & (v < 0)
        wide = np.minimum((column[none] + 1) * size, width) - column[none] * size
        total = np.zeros((side // size, side // size), np.int64)
        np.add.at(total, (a[none], b[none]), wide)
        empty += np.repeat(np.repeat(total, size, 0), size, 1)
        go = inside & ~none
        u, v, a, b, column = u[go], v[go], a[go], b[go], column[go]
    return a, b, u, v


def _excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def pair_values(
    row: np.ndarray, column: np.ndarray, p: np.ndarray, zero: np.ndarray, width: int, strip: int = _STRIP
) -> np.ndarray:
    """Excess of each row over each other row, summed over ``width`` columns.

    Cells are told by row, column and probability ``p``; ``zero`` is that of an
    empty cell of each row. All rows are compared, strip by strip if they are many.
    """
    rows = len(zero)
    out = np.zeros((rows, rows), np.int64)
    starts = range(0, rows, strip)
    for x, y in ((x, y) for x in starts for y in starts if x <= y):
        mine = np.arange(x, min(x + strip, rows))
        if x != y:
            mine = np.concatenate([mine, np.arange(y, min(y + strip, rows))])
        side = max(2, 1 << (len(mine) - 1).bit_length())
        place = np.full(rows, -1)
        place[mine] = np.arange(len(mine))
        here = place[row] >= 0
        tree = Tree(place[row[here]], column[here], side)
        value = np.append(p[here][tree.cell], 0)
        own = zero[mine]
        empty = np.zeros((side, side), np.int64)
        total = np.zeros((len(mine), len(mine)), np.int64)
        squares = -(-width // side)
        step = max(1, _FRONTIER // (side**3 // 2 + 1))
        for at in range(0, squares, step):
            part = np.arange(at, min(at + step, squares))
            a, b, u, v = _walk(tree, part, width, len(mine), x != y, empty)
            left, right = np.where(u < 0, own[a], value[u]), np.where(v < 0, own[b], value[v])
            np.add.at(total, (a, b), _excess(left, right))
            np.add.at(total, (b, a), _excess(right, left))
        empty = np.triu(empty[: len(mine), : len(mine)], 1)
        if x != y:
            empty[:, :strip] = 0
            empty[strip:] = 0
        both = _excess(own[:, None], own[None, :])
        total += (empty + empty.T) * both
        out[np.ix_(mine, mine)] += total
    return out


_FOUND = "g int, h int, term string, value long"


def _priced(columns: DataFrame, groups: Groups, totals: np.ndarray, widths: np.ndarray, top: int) -> DataFrame:
    """Partial sums of pairs ``g, h, value``, and terms ``g, term, value`` that may rank, by blocks."""
    # One number per group; the result has a row per pair of them.
    sent = columns.sparkSession.sparkContext.broadcast((groups.lang, totals, widths))

    def priced(block: pa.Table, lang: np.ndarray, totals: np.ndarray, widths: np.ndarray) -> Iterator[pa.RecordBatch]:
        of = block.column("l").to_numpy()
        for l in np.unique(of):
            part = block.filter(pa.array(of == l)).combine_chunks()
            g = pc.list_flatten(part.column("g")).to_numpy()
            n = pc.list_flatten(part.column("n")).to_numpy()
            column = pc.list_parent_indices(part.column("g")).to_numpy()
            first, last = np.searchsorted(lang, [l, l + 1])
            p = probabilities(n, totals[g], widths[l])
            zero = probabilities(np.int64(0), totals[first:last], widths[l])
            value = pair_values(g - first, column, p, zero, part.num_rows)
            a, b = np.nonzero(~np.eye(last - first, dtype=bool))
            sums = [a + first, b + first]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x.astype(np.int32)) for x in sums), pa.nulls(len(a), pa.string()), pa.array(value[a, b])],
                names=["g", "h", "term", "value"],
            )
            all_n = np.zeros(part.num_rows, np.int64)
            np.add.at(all_n, column, n)
            q = probabilities(all_n, totals[first:last].sum(), widths[l])[column]
            more = np.flatnonzero(p > q)
            f = _excess(p[more], q[more])
            by_term = np.empty(part.num_rows, np.int64)
            by_term[pc.sort_indices(part.column("term")).to_numpy()] = np.arange(part.num_rows)
            order = np.lexsort((by_term[column[more]], -f, g[more]))
            more, f = more[order], f[order]
            nth = np.arange(len(more)) - np.searchsorted(g[more], g[more])
            more, f = more[nth < top], f[nth < top]
            terms = part.column("term").take(pa.array(column[more])).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [pa.array(g[more]), pa.nulls(len(more), pa.int32()), terms, pa.array(f)],
                names=["g", "h", "term", "value"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cells = [], 0
        for batch in batches:
            held.append(batch)
            cells += len(batch.column("g").flatten())
            if cells >= _BLOCK_CELLS:
                yield from priced(pa.Table.from_batches(held), *sent.value)
                held, cells = [], 0
        if cells:
            yield from priced(pa.Table.from_batches(held), *sent.value)

    return columns.mapInArrow(run, _FOUND)


def source_divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: how the sources of each language differ.

    ``part`` is ``pair`` for each other source of the language, with the excess of
    the source's term probabilities over the other's, summed over all kept terms;
    and ``term`` for the ``top`` terms that a source has oftener than its language.
    A term is kept if ``least`` rows of the language have it. Null texts, languages
    and sources count as empty ones. A row is a document, also if its id occurs
    again. A language of one source has no pairs, a source without kept terms no
    terms; an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    groups = _groups(texts)
    columns = _columns(texts, groups, least)
    totals, widths = np.zeros(len(groups.lang), np.int64), np.zeros(len(groups.languages), np.int64)
    cells = columns.select(F.explode(F.arrays_zip("g", "n")).alias("c"))
    for r in cells.groupBy("c.g").agg(F.sum("c.n").alias("n")).collect():
        totals[r["g"]] = r["n"]
    for r in columns.groupBy("l").count().collect():
        widths[r["l"]] = r["count"]

    found = stored(_priced(columns, groups, totals, widths, top), "priced")
    named = [(i, groups.languages[k], s) for i, (k, s) in enumerate(zip(groups.lang.tolist(), groups.source, strict=True))]
    names = spark.createDataFrame(named, "g int, lang string, source string")
    other = names.select(F.col("g").alias("h"), "lang", F.col("source").alias("item"))
    sums = found.where("h IS NOT NULL").groupBy("g", "h").agg(F.sum("value").alias("value"))
    pairs = names.join(other, "lang").where("g <> h").join(sums, ["g", "h"], "left")
    pairs = pairs.select("g", "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    ranked = "row_number() OVER (PARTITION BY g ORDER BY value DESC, {}) AS rank"
    pairs = pairs.selectExpr("*", ranked.format("item"))
    terms = found.where("term IS NOT NULL").selectExpr("g", "term AS item", "value", ranked.format("term"))
    terms = terms.where(F.col("rank") <= top).join(names, "g")
    columns_out = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns_out).unionByName(terms.withColumn("part", F.lit("term")).select(*columns_out))
