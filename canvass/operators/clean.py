"""Cleaning: imputation, interquartile-range outliers, range and mandatory rules.

Each step takes a table and gives the lazy cleaned table with a report of what it did; the scalars of a step come from one
aggregate over all columns.
"""

from __future__ import annotations

import functools
import operator
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from canvass.functions.columns import col, numeric_columns, require_numeric
from canvass.functions.quantiles import exact_quantiles


@dataclass(frozen=True)
class Change:
    """One line of a step's report: rows found and changed (or removed) for a column or rule."""

    step: str
    column: str
    found: int
    changed: int
    #: The bounds of a range rule.
    detail: str = ""


@dataclass(frozen=True)
class Range:
    column: str
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class Rules:
    ranges: tuple[Range, ...] = ()
    mandatory: tuple[str, ...] = field(default=())

    @classmethod
    def of(cls, document: dict) -> Rules:
        """From a rules document: range (col, min, max) and mandatory; an absent or null bound is open."""
        ranges = tuple(Range(r["col"], r.get("min"), r.get("max")) for r in document.get("range", ()))
        return cls(ranges, tuple(document.get("mandatory", ())))


#: The built-in rules.
DEFAULT_RULES = Rules((Range("Age", 0, 120), Range("Income", 0, 10_000_000)))
METHODS = ("mean", "median", "mode", "drop")


class Observed:
    """Counts that the job delivers which makes the cleaned rows, in place of jobs of their own.

    Give one to the steps, run one action on the table they return (write it, say), then ask for ``changes``. An action that reads part of the rows,
    or none yet, gives no whole counts: ``changes`` waits for the first one.
    """

    def __init__(self) -> None:
        self._steps: list[tuple[Observation | None, Callable[[dict], list[Change]]]] = []

    def watch(self, df: DataFrame, counts: dict[str, Column], told: Callable[[dict], list[Change]]) -> DataFrame:
        """df, which counts its rows as it is read; told makes changes of the counts."""
        seen = Observation()
        self._steps.append((seen, told))
        return df.observe(seen, *[x.alias(n) for n, x in counts.items()])

    def know(self, changes: list[Change]) -> None:
        """Changes that were counted before, in the place of this step."""
        self._steps.append((None, lambda _: changes))

    def changes(self) -> list[Change]:
        """In the order of the steps."""
        return [c for seen, told in self._steps for c in told(seen.get if seen is not None else {})]


def first_failure(tests: dict[str, Column]) -> Column:
    """Name of the first test that a row fails, NULL if it passes all: gives the counts of a sequence of filters in one pass."""
    chain = F
    for name, passes in tests.items():
        chain = chain.when(~F.coalesce(passes, F.lit(False)), F.lit(name))
    return chain if tests else F.lit(None).cast("string")


def _counted(df: DataFrame, counts: dict[str, Column], told: Callable[[dict], list[Change]], observed: Observed | None) -> tuple[DataFrame, list[Change]]:
    """df and the changes, from an aggregate of its own; or df that is observed, and none yet."""
    if observed is not None:
        return observed.watch(df, counts, told), []
    return df, told(df.agg(*[x.alias(n) for n, x in counts.items()]).first().asDict())


def _attributed(df: DataFrame, tests: dict[str, Column], step: str, details: dict[str, str] | None = None, observed: Observed | None = None) -> tuple[DataFrame, list[Change]]:
    """Rows that pass all tests, and what each test, in order, would remove of what the ones before left."""
    if not tests:
        return df, []
    verdict, names = first_failure(tests), list(tests)

    def told(counts: dict) -> list[Change]:
        found = [(name, counts[f"n{i}"]) for i, name in enumerate(names)]
        return [Change(step, name, n, n, (details or {}).get(name, "")) for name, n in found if n]

    seen, changes = _counted(df, {f"n{i}": F.count_if(verdict == name) for i, name in enumerate(names)}, told, observed)
    return seen.where(functools.reduce(operator.and_, [F.coalesce(x, F.lit(False)) for x in tests.values()])), changes


def column_modes(df: DataFrame, names: list[str]) -> dict[str, object]:
    """The most frequent value of each column, the smallest on ties, None without values: all columns in one job.

    Values are counted in groups, so that no task holds all distinct values of a column.
    """
    if not names:
        return {}
    cells = F.array(*[F.struct(F.lit(i).alias("c"), *[(col(n) if k == i else F.lit(None).cast(df.schema[n].dataType)).alias(f"v{k}") for k, n in enumerate(names)]) for i in range(len(names))])
    values = [f"v{k}" for k in range(len(names))]
    present = functools.reduce(operator.or_, [F.col(v).isNotNull() for v in values])  # of the row's own column: the others are NULL
    counts = df.select(F.inline(cells)).where(present).groupBy("c", *values).agg(F.count("*").alias("n"))
    best = [F.min(F.when(F.col("c") == k, F.struct(-F.col("n"), F.col(v).alias("v")))).alias(v) for k, v in enumerate(values)]
    row = counts.agg(*best).first()
    return {n: row[v]["v"] if row[v] is not None else None for n, v in zip(names, values, strict=True)}


def impute(df: DataFrame, method: str | None, columns: list[str] | None = None, observed: Observed | None = None) -> tuple[DataFrame, list[Change]]:
    """Fills or drops NULLs of the numeric columns, or of the given ones; unknown columns are skipped.

    What to fill with has to be known first, so fills are counted with that; drops can be observed.
    """
    if method in (None, "", "none"):
        return df, []
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; choose of {', '.join(METHODS)}")
    names = [c for c in (numeric_columns(df) if columns is None else columns) if c in df.columns]
    if not names:
        return df, []
    if method == "drop":
        return _attributed(df, {c: col(c).isNotNull() for c in names}, "impute drop", observed=observed)
    if method in ("mean", "median"):
        require_numeric(df, names)
    found = df.agg(*[F.count_if(col(c).isNull()) for c in names], *[F.avg(col(c).cast("double")) for c in names if method == "mean"]).first()
    missing = dict(zip(names, found, strict=False))
    if method == "mean":
        fills = dict(zip(names, found[len(names) :], strict=True))
    else:
        holed = [c for c in names if missing[c]]
        fills = {c: x[0] for c, x in exact_quantiles(df, holed, [0.5]).items()} if method == "median" else column_modes(df, holed)
    kinds = {f.name: f.dataType for f in df.schema}

    def filled(c: str) -> Column:
        if c not in names or not missing[c] or fills.get(c) is None:
            return col(c)
        # An integer column takes a fractional fill as double.
        own = col(c) if method == "mode" else col(c).cast("double")
        return F.coalesce(own, F.lit(fills[c]).cast(kinds[c] if method == "mode" else "double")).alias(c)

    changes = [Change(f"impute {method}", c, missing[c], missing[c] if fills.get(c) is not None else 0) for c in names if missing[c]]
    if observed is not None:
        observed.know(changes)
    return df.select(*[filled(c) for c in df.columns]), changes


def fences(df: DataFrame, columns: list[str], reach: float = 1.5) -> dict[str, tuple[float | None, float | None]]:
    """Lower and upper fence of each column, from the same input."""
    return {c: fences_of(a, b, reach) for c, (a, b) in exact_quantiles(df, columns, [0.25, 0.75]).items()}


def fences_of(low: float | None, high: float | None, reach: float = 1.5) -> tuple[float | None, float | None]:
    """Fences from the two quartiles."""
    return (None, None) if low is None else (low - reach * (high - low), high + reach * (high - low))


def remove_outliers(df: DataFrame, columns: list[str] | None = None, method: str = "iqr", keep_nulls: bool = False, observed: Observed | None = None) -> tuple[DataFrame, list[Change]]:
    """Keeps rows inside the fences of all numeric columns, or of the given ones.

    A NULL in any of them removes the row unless keep_nulls; so a column of NULLs alone removes all. Methods other than
    "iqr" remove nothing.
    """
    names = [c for c in (numeric_columns(df) if columns is None else columns) if c in df.columns]
    if method != "iqr" or not names:
        return df, []
    require_numeric(df, names)
    bands = []
    for c, (low, high) in fences(df, names).items():
        if low is None and not keep_nulls:
            warnings.warn(f"{c} has no values: all rows are removed", stacklevel=2)
        band = F.lit(False) if low is None else F.coalesce(col(c).between(low, high), F.lit(False))
        bands.append(band | col(c).isNull() if keep_nulls else band)
    inside = functools.reduce(operator.and_, bands)
    seen, changes = _counted(df, {"removed": F.count_if(~inside)}, lambda n: [Change("outliers", "all", n["removed"], n["removed"])] if n["removed"] else [], observed)
    return seen.where(inside), changes


def apply_rules(df: DataFrame, rules: Rules | None, observed: Observed | None = None) -> tuple[DataFrame, list[Change]]:
    """Range rules in order, then mandatory columns; NULL fails a range, columns that are absent are skipped."""
    if not rules:
        return df, []
    ranges = [r for r in rules.ranges if r.column in df.columns]
    require_numeric(df, [r.column for r in ranges])
    tests: dict[str, Column] = {}
    details = {f"{i}: range {r.column}": f"{'open' if r.low is None else r.low} to {'open' if r.high is None else r.high}" for i, r in enumerate(ranges)}
    for i, r in enumerate(ranges):
        passes = col(r.column).isNotNull()
        if r.low is not None:
            passes = passes & (col(r.column) >= r.low)
        if r.high is not None:
            passes = passes & (col(r.column) <= r.high)
        tests[f"{i}: range {r.column}"] = passes
    needed = [c for c in rules.mandatory if c in df.columns]
    if needed:
        tests[f"mandatory {', '.join(needed)}"] = functools.reduce(operator.and_, [col(c).isNotNull() for c in needed])
    return _attributed(df, tests, "rules", details, observed)


def clean(df: DataFrame, impute_method: str | None = None, outliers: bool = False, rules: Rules | None = None, observed: Observed | None = None) -> tuple[DataFrame, list[Change]]:
    """Impute, then outliers, then rules; each step works on what the one before left. With observed, changes come from it, once the table has been read."""
    out, changes = impute(df, impute_method, observed=observed)
    if outliers:
        out, more = remove_outliers(out, observed=observed)
        changes = changes + more
    out, more = apply_rules(out, rules, observed)
    return out, changes + more


def clean_to(df: DataFrame, path: str, impute_method: str | None = None, outliers: bool = False, rules: Rules | None = None) -> list[Change]:
    """Writes the cleaned table as Parquet; the job that writes it counts what the steps change."""
    observed = Observed()
    clean(df, impute_method, outliers, rules, observed)[0].write.parquet(path)
    return observed.changes()
