"""Expressions for storage accounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def policy_document(bucket: Column) -> Column:
    """JSON policy that allows everything inside one bucket."""
    # The policy's version, effect, action and resource form.
    statement = F.struct(
        F.lit("Allow").alias("Effect"),
        F.array(F.lit("s3:*")).alias("Action"),
        F.array(F.concat(F.lit("arn:aws:s3:::"), bucket, F.lit("/*"))).alias("Resource"),
    )
    return F.to_json(
        F.struct(F.lit("2012-10-17").alias("Version"), F.array(statement).alias("Statement"))
    )
