"""Connected components of links that are rows of a DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.shared import stored


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the links in a partition, keep for each id the smallest id it reaches here."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a = batch.column(0).to_numpy()
        b = batch.column(1).to_numpy()
        ids, both = np.unique(np.concatenate([a, b]), return_inverse=True)
        left, right = both[: len(a)], both[len(a) :]
        root = np.arange(len(ids))
        while True:
            low = np.minimum(root[left], root[right])
            new = root.copy()
            np.minimum.at(new, root[left], low)
            np.minimum.at(new, root[right], low)
            new = new[new]
            while (new != new[new]).any():
                new = new[new]
            if (new == root).all():
                break
            root = new
        moved = root != np.arange(len(ids))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[moved]), pa.array(ids[root[moved]])], names=["a", "b"]
        )


def components(links: DataFrame) -> DataFrame:
    """``id, component`` of every id in ``links(a, b)``; the smallest id names it.

    Alternates the large-star and small-star steps: each id hooks what it is
    linked to on to the smallest id it sees. Links shrink to stars in rounds
    that grow with the logarithm of a component's size. A star's centre may have
    any number of rows, but they are only ever reduced by ``min`` and joined
    back, so no task holds a group. Links are first reduced within partitions.
    Nulls and links of an id with itself are dropped; empty links give no rows.
    """
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long"))
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    links = stored(links.mapInArrow(_forest, "a long, b long"), "links")
    while True:
        # a > b holds from here on.
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written first, so that the join reads two plain inputs and a centre with
        # very many rows is split at run time.
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        least = stored(least, "least")
        # Larger neighbours go to the smallest in reach.
        large = (
            links.select(F.col("b").alias("a"), F.col("a").alias("other"))
            .join(least, "a")
            .select(F.col("other").alias("a"), F.col("low").alias("b"))
            .distinct()
        )
        # Of what an id then hangs on, the smallest keeps it and takes the others.
        lowest = large.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
        rest = large.join(lowest.where("n > 1"), "a").where("b <> low")
        small = lowest.select("a", F.col("low").alias("b")).unionAll(
            rest.select(F.col("b").alias("a"), F.col("low").alias("b"))
        )
        links = stored(small.distinct(), "stars")
        flat = links.alias("x").join(links.alias("y"), F.col("x.b") == F.col("y.a"), "left_semi")
        twice = links.groupBy("a").count().where("count > 1")
        if flat.isEmpty() and twice.isEmpty():
            break
    ids = links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ids.unionAll(
        links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
