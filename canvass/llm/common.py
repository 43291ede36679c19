"""Shared helpers of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.scratch import Scratch, broadcast_by_bytes, shared_dir

__all__ = ["SEPARATORS", "Scratch", "broadcast_by_bytes", "broadcast_if_small", "read", "shared_dir"]

#: ASCII white space that separates words: space and 0x09 to 0x0D.
SEPARATORS = "[\\x20\\x09-\\x0D]"


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast hint for a table whose counted size is within the limit; else Spark shuffles it."""
    return F.broadcast(df) if rows <= limit else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
