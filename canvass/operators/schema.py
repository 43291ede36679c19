"""Mapping of headers to a standard schema."""

from __future__ import annotations

from pyspark.sql import DataFrame

from canvass.functions.columns import col


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Renames columns by exact name; unknown names are ignored, and a clash of names is an error."""
    names = [mapping.get(c, c) for c in df.columns]
    if clash := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"two columns would be named {', '.join(clash)}")
    return df.select(*[col(c).alias(n) for c, n in zip(df.columns, names, strict=True)])


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]
