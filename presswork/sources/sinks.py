"""Result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header, written by the executors (one file per partition)."""
    df.write.mode(mode).option("header", True).csv(path)
