"""Data-quality checks on the inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def author_email_duplicates(tables) -> DataFrame:
    """Author emails that occur more than once after ``lower``: each one multiplies the
    rows of every join to the lookup (the reference keeps that fan-out)."""
    a = tables.authors.filter(F.col("email").isNotNull())
    return (
        a.groupBy(F.lower(F.col("email")).alias("email_key"))
        .agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("email").alias("spellings"))
        .filter(F.col("rows") > 1)
    )
