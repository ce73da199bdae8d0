"""Mixing sources to target weights by Poisson replication.

Every source has a rate: how often each of its documents should appear on
average, so that the sources reach their target shares. A document's number of
copies is drawn by inverting the Poisson distribution at a uniform number that
its id and the seed are hashed to, so a draw needs no state and repeats exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.shared import stored

#: Larger means are split into a sum of draws with at most this mean each.
PART_MEAN = 8.0
#: Terms of the distribution at that mean; the tail beyond is below 1e-30.
TERMS = 65
#: Rows of rates (a name and a number list each) that are sent to all tasks.
BROADCAST_RATES = 20_000


def _digits(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def source_rates(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    default_weight: float = 1.0,
    alpha: float = 0.5,
    total: int | None = None,
) -> DataFrame:
    """``source, n_docs, rate`` of every source, counted over all documents.

    With ``weights``, a source's share is its weight among those of all sources
    present; sources not named, and documents without a source, weigh
    ``default_weight``. Without, it is the document count to the power ``alpha``.
    ``total`` is the expected size of the mixture, by default that of the input.
    """
    counts = docs.groupBy("source").agg(F.count("*").alias("n_docs"))
    if weights is None:
        weight = F.pow(F.col("n_docs").cast("double"), F.lit(alpha))
    elif not weights:
        weight = F.lit(float(default_weight))
    else:
        named = F.create_map(
            *[x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(float(v)))]
        )
        weight = F.coalesce(named[F.col("source")], F.lit(float(default_weight)))
    counts = counts.withColumn("weight", weight)
    sums = counts.agg(F.sum("weight").alias("w"), F.sum("n_docs").alias("n")).first()
    wanted = float(total if total is not None else sums["n"] or 0)
    rate = F.col("weight") / F.lit(sums["w"] or 1.0) * F.lit(wanted) / F.col("n_docs")
    return counts.select("source", "n_docs", rate.alias("rate"))


def _cumulative(mean: Column) -> Column:
    """The first terms of the cumulative Poisson distribution."""
    empty = F.struct(
        F.exp(-mean).alias("term"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("all")
    )
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        empty,
        lambda acc, k: F.struct(
            (acc["term"] * mean / k).alias("term"),
            (acc["sum"] + acc["term"]).alias("sum"),
            F.concat(acc["all"], F.array(acc["sum"] + acc["term"])).alias("all"),
        ),
        lambda acc: acc["all"],
    )


def _draw(key: Column, parts: Column, cumulative: Column, seed: int) -> Column:
    """A Poisson number: how many terms lie at or below the uniform number, summed over parts."""

    def one(total: Column, part: Column) -> Column:
        u = (_digits(F.concat_ws("|", F.lit(f"n{seed}"), key, part), 13) + F.lit(0.5)) / F.lit(
            float(1 << 52)
        )
        return total + F.size(F.filter(cumulative, lambda c: c <= u))

    return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), one)


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    default_weight: float = 1.0,
    alpha: float = 0.5,
    total: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """``docs`` with each row once per drawn copy, in a globally shuffled order.

    Adds ``n_copies`` (of the document), ``copy`` (from 1) and ``position``; the
    order is that of ``position`` within each partition, and partitions are dealt
    by its hash, so any of them is a random sample. A column of that name in the
    input is replaced. See ``source_rates`` for the other parameters.

    A row without an id is hashed by its text; rows with equal ids get equal
    draws. A rate of 0 leaves out the source. An empty table gives no rows.
    """
    taken = [c for c in docs.columns if c not in ("n_copies", "copy", "position")]
    docs = docs.select(*taken)
    rates = source_rates(docs, weights, default_weight, alpha, total).where("rate > 0")
    parts = F.ceil(F.col("rate") / F.lit(PART_MEAN)).cast("int")
    rates = stored(
        rates.select(
            F.col("source").alias("name"),
            parts.alias("parts"),
            _cumulative(F.col("rate") / parts).alias("cumulative"),
        ),
        "rates",
    )
    # Few sources go to all tasks; beyond the bound, a source that holds a large
    # part of the rows is left to the run-time split of the shuffled join.
    if rates.count() <= BROADCAST_RATES:
        rates = F.broadcast(rates)
    # The document's own columns stay in one, so that none of them can clash.
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))
    whole = docs.select(F.struct(*taken).alias("row"), F.col("source").alias("of"), key.alias("key"))
    drawn = whole.join(rates, F.col("of").eqNullSafe(F.col("name")))
    drawn = drawn.withColumn("n_copies", _draw(F.col("key"), F.col("parts"), F.col("cumulative"), seed))
    copies = drawn.where("n_copies > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("n_copies")))
    )
    place = _digits(F.concat_ws("|", F.lit(f"p{seed}"), F.col("key"), F.col("copy")), 15)
    copies = copies.select("row.*", "n_copies", "copy", place.alias("position"))
    return copies.repartition("position").sortWithinPartitions("position", "doc_id", "copy")
