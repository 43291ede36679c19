"""Small Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of integer, floating and decimal columns, in order; booleans, dates and strings are not numeric."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """One kind of missing value: NaN becomes NULL in all floating columns."""
    floating = {f.name for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)}
    return df.select(*[F.nanvl(col(c), F.lit(None)).alias(c) if c in floating else col(c) for c in df.columns])


def round_even(x: Column, digits: int) -> Column:
    """Half-even rounding of the scaled double."""
    return F.rint(x * F.lit(float(10**digits))) / F.lit(float(10**digits))


def require(df: DataFrame, names: list[str]) -> None:
    if absent := [c for c in names if c not in df.columns]:
        raise KeyError(f"no such columns: {', '.join(absent)}")


def require_numeric(df: DataFrame, names: list[str]) -> None:
    require(df, names)
    if other := [c for c in names if c not in numeric_columns(df)]:
        raise TypeError(f"not numeric: {', '.join(other)}")
