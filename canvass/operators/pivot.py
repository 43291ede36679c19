"""Group-and-aggregate ("pivot"), with the semantics of a data-frame pivot table.

NULL keys are left out; rows whose values are all NULL are dropped, but a sum over NULLs alone is 0 and a count 0; the result
is in ascending key order with value columns in alphabetical order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.functions.columns import col, require, require_numeric
from canvass.functions.quantiles import INTERVAL_ROWS, grouped_quantiles
from canvass.functions.scan import ROWS_A_RANGE, running_sum


def _skew(c: Column) -> Column:
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def _guarded(fn: Callable[[Column], Column], least: int) -> Callable[[Column], Column]:
    return lambda c: F.when(F.count(c) >= least, fn(c))


#: By name: aggregates of numbers.
NUMERIC: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "std": _guarded(F.stddev_samp, 2),
    "var": _guarded(F.var_samp, 2),
    "sem": _guarded(lambda c: F.stddev_samp(c) / F.sqrt(F.count(c)), 2),
    "prod": lambda c: F.coalesce(F.product(c), F.lit(1.0)),
    "any": lambda c: F.coalesce(F.bool_or(c != 0), F.lit(False)),
    "all": lambda c: F.coalesce(F.bool_and(c != 0), F.lit(True)),
    "skew": _skew,
}
#: Aggregates of values of any type.
GENERAL: dict[str, Callable[[Column], Column]] = {"count": F.count, "min": F.min, "max": F.max, "nunique": F.count_distinct}
#: Aggregates that need an order of rows.
ORDERED: dict[str, Callable[[Column, Column], Column]] = {
    "first": lambda c, row: F.min_by(c, F.when(c.isNotNull(), row)),
    "last": lambda c, row: F.max_by(c, F.when(c.isNotNull(), row)),
    "idxmin": lambda c, row: F.min_by(row, F.when(c.isNotNull(), F.struct(c, row))),
    "idxmax": lambda c, row: F.max_by(row, F.when(c.isNotNull(), F.struct(c, -row))),
}
#: Quantiles, found by rank selection (``grouped_quantiles``).
QUANTILES = {"median": 0.5, "quantile": 0.5}
#: Statistics of "describe", each a column of its own.
DESCRIBE: dict[str, Callable[[Column], Column] | float] = {
    "count": F.count,
    "mean": F.avg,
    "std": _guarded(F.stddev_samp, 2),
    "min": F.min,
    "25%": 0.25,
    "50%": 0.5,
    "75%": 0.75,
    "max": F.max,
}
AGGREGATES = (*NUMERIC, *QUANTILES, *GENERAL, *ORDERED, "describe")


def _aggregate(df: DataFrame, name: str, value: str, row_id: str | None) -> Column | float:
    """An aggregate, or the probability of a quantile."""
    if name in QUANTILES:
        require_numeric(df, [value])
        return QUANTILES[name]
    if name in NUMERIC:
        require_numeric(df, [value])
        return NUMERIC[name](col(value))
    if name in GENERAL:
        return GENERAL[name](col(value))
    if name in ORDERED:
        if row_id is None:
            raise ValueError(f"{name} needs row_id, the column that orders rows")
        return ORDERED[name](col(value), col(row_id))
    raise ValueError(f"unknown aggregate {name}; choose of {', '.join(AGGREGATES)}")


def pivot(df: DataFrame, keys: str | list[str], values: str | list[str] | None = None, agg: str | list[str] | dict[str, str] = "mean", row_id: str | None = None, interval_rows: int = INTERVAL_ROWS) -> DataFrame:
    """keys, then the values' aggregates.

    agg: one name for all values; a list of names, which gives columns named value_name; or a name for each
    value. values=None takes all other columns. Result names that clash with a key or each other are an error. interval_rows: see ``grouped_quantiles``.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if not keys:
        raise ValueError("no group keys")
    if isinstance(agg, dict):
        values = list(agg)
    elif values is None:
        values = [c for c in df.columns if c not in keys and c != row_id]
    values = sorted([values] if isinstance(values, str) else values)
    require(df, keys + values)
    if both := set(keys) & set(values):
        raise ValueError(f"both key and value: {', '.join(sorted(both))}")
    out = {}
    for v in values:
        names = agg[v] if isinstance(agg, dict) else agg
        for name in [names] if isinstance(names, str) else names:
            if name == "describe":
                require_numeric(df, [v])
                made = {f"{v}_{k}": (v, fn if isinstance(fn, float) else fn(col(v))) for k, fn in DESCRIBE.items()}
            else:
                made = {v if isinstance(names, str) else f"{v}_{name}": (v, _aggregate(df, name, v, row_id))}
            if clash := (made.keys() & (out.keys() | set(keys))):
                raise ValueError(f"two columns of the result would be named {', '.join(sorted(clash))}")
            out |= made
    # Keys and results go by numbers meanwhile, so that no name can clash.
    own, number = [f"k{i}" for i in range(len(keys))], {n: f"r{i}" for i, n in enumerate(out)}
    rows = df.na.drop(subset=[f"`{k}`" for k in keys])
    plain = [x.alias(number[n]) for n, (_, x) in out.items() if isinstance(x, Column)]
    of_keys = [col(k).alias(n) for k, n in zip(keys, own, strict=True)]
    quantiles: dict[str, list[str]] = {}
    for n, (v, x) in out.items():
        if not isinstance(x, Column):
            quantiles.setdefault(v, []).append(n)
    grouped = rows.groupBy(*of_keys).agg(*plain) if plain else rows.select(*of_keys).distinct() if len(quantiles) != 1 else None
    for v, names in quantiles.items():
        found = grouped_quantiles(df, keys, v, [out[n][1] for n in names], interval_rows)
        found = found.select(*[col(k).alias(n) for k, n in zip(keys, own, strict=True)], *[F.col(f"q{i}").alias(number[n]) for i, n in enumerate(names)])
        grouped = found if grouped is None else grouped.join(found, own, "left")
    grouped = grouped.na.drop(how="all", subset=list(number.values()))
    return grouped.select(*[F.col(n).alias(k) for k, n in zip(keys, own, strict=True)], *[F.col(number[n]).alias(n) for n in out]).orderBy(*[col(k) for k in keys])


def group_transform(df: DataFrame, keys: list[str], value: str, how: str, row_id: str, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """(row_id, value): running sum or average rank of each row within its group, NULL for NULL; NULL keys are left out.

    Groups are spread over ranges of row_id or of values (see ``scan``). A rank follows from the counts of the group's distinct values alone, so equal
    values, however many, are one row until the ranks are joined back.
    """
    require_numeric(df, [value])
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[col(k).alias(n) for k, n in zip(keys, names, strict=True)], col(row_id).alias("row"), col(value).alias("v")).na.drop(subset=names)
    if how == "cumsum":
        result = running_sum(rows, names, "row", "v", "result", rows_a_range)
    elif how == "rank":
        counts = rows.where("v is not null").groupBy(*names, "v").agg(F.count("*").alias("n"))
        ranked = running_sum(counts, names, "v", "n", "up_to", rows_a_range)
        ranked = ranked.select(*names, "v", (F.col("up_to") - (F.col("n") - 1) / 2).alias("result"))
        result = rows.join(ranked, [*names, "v"], "left")
    else:
        raise ValueError("how is cumsum or rank")
    return result.select(F.col("row").alias(row_id), F.when(F.col("v").isNotNull(), F.col("result")).alias(value))
