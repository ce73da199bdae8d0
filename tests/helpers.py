from pyspark.sql import functions as F


def values(spark, texts, expression, name="x"):
    """Evaluate an expression of one text column, in order."""
    rows = spark.createDataFrame(list(enumerate(texts)), f"i int, {name} string")
    out = rows.select("i", expression(F.col(name)).alias("out")).orderBy("i").collect()
    return [r["out"] for r in out]


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())
