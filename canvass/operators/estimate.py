"""Design-weighted estimates: effective sample size, mean, standard error, 95% interval, population projection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.functions.columns import col, require_numeric, round_even
from canvass.functions.student import critical, critical_column
from canvass.scratch import Scratch

SCHEMA = (
    "column string, n_sample long, n_effective double, mean double, std_error double, margin_of_error double, "
    "ci_95_lower double, ci_95_upper double, population_estimate double"
)


def effective_sample_size(df: DataFrame, weight: str) -> DataFrame:
    """Kish: squared sum of weights over the sum of their squares; 0 for no weights."""
    w = col(weight).cast("double")
    return df.agg(F.coalesce(F.try_divide(F.sum(w) * F.sum(w), F.sum(w * w)), F.lit(0.0)).alias("n_effective"))


def parse_population(given: str | float | None) -> float | None:
    """A population total from a form field: blank or zero is none, other text is an error."""
    text = str(given).strip() if given is not None else ""
    return (float(text) or None) if text else None


def _even(x: float | None, digits: int) -> float | None:
    """As round_even does, for one number."""
    return None if x is None or not math.isfinite(x) else float(round(x * 10**digits)) / 10**digits


#: Rows from which a value near a column's middle is taken, and how much larger the square of the mean may be than the variance, beside that value.
SAMPLE, SAFE = 200, 1e6


def _origins(df: DataFrame, names: list[str]) -> dict[str, float]:
    """A value of each column, the middle one of the first rows that come: sums of distances from it keep their digits."""
    rows = df.select(*[col(n).cast("double").alias(f"x{i}") for i, n in enumerate(names)]).take(SAMPLE)
    found = {}
    for i, n in enumerate(names):
        values = sorted(r[i] for r in rows if r[i] is not None and math.isfinite(r[i]))
        found[n] = values[len(values) // 2] if values else 0.0
    return found


def _moments(df: DataFrame, pairs: dict[str, tuple[Column, Column]], origins: dict[str, float]) -> dict[str, tuple]:
    """Of each target, from one aggregate: n, sum of weights and of their squares, and the weighted sums of distances from its origin and of their squares."""
    sums = []
    for t, (w, x) in pairs.items():
        off = x - F.lit(origins[t])
        sums += [F.count(w), F.sum(w), F.sum(w * w), F.sum(w * off), F.sum(w * off * off)]
    row = df.agg(*sums).first()
    return {t: row[5 * i : 5 * i + 5] for i, t in enumerate(pairs)}


def weighted_estimates(df: DataFrame, targets: list[str], weight: str, population: float | None = None) -> DataFrame:
    """One record for each target that is present, in order; targets of fewer than two rows have none.

    Rows count for a target where it and the weight are present. All sums come from one pass over the rows; a target whose mean is too far from the
    value its distances are taken from, for its spread, has a second pass from the mean. Where the weights sum to zero, or the effective size
    is at most one, what is undefined is NULL.
    """
    spark, names = df.sparkSession, [t for t in targets if t in df.columns]
    if not names:
        return spark.createDataFrame([], SCHEMA)
    require_numeric(df, [*names, weight])
    w = col(weight).cast("double")
    pairs = {t: (F.when(col(t).isNotNull() & w.isNotNull(), w), col(t).cast("double")) for t in names}
    origins = _origins(df, names)
    parts = _moments(df, pairs, origins)

    def spread_of(t: str) -> float:
        _, total, _, first, second = parts[t]
        return second - first * first / total

    far = {t: pairs[t] for t, (n, total, _, first, second) in parts.items() if n and total and second and first * first / total > SAFE * abs(spread_of(t))}
    if far:
        origins |= {t: origins[t] + parts[t][3] / parts[t][1] for t in far}
        parts |= _moments(df, far, origins)
    rows = []
    for t in names:
        n, total, squares, first, _ = parts[t]
        if n <= 1:
            continue
        size, mean = (total * total / squares if squares else 0.0), origins[t] + first / total if total else None
        variance = spread_of(t) / total * n / (n - 1) if mean is not None else None
        error = math.sqrt(variance) / math.sqrt(size) if variance is not None and variance >= 0 and size > 0 else None
        t_value = critical(size - 1)
        margin = t_value * error if t_value is not None and error is not None else None
        low, high = (mean - margin, mean + margin) if margin is not None else (None, None)
        projected = mean * population if population and population > 0 and mean is not None else None
        rows.append((t, n, _even(size, 2), *[_even(x, 4) for x in (mean, error, margin, low, high)], _even(projected, 2)))
    return spark.createDataFrame(rows, SCHEMA)


def weighted_estimates_by(df: DataFrame, keys: list[str], target: str, weight: str) -> DataFrame:
    """The record of one target for each group; NULL keys are left out. One pass over the rows, and a second over groups whose mean is far from the others, for their spread."""
    require_numeric(df, [target, weight])
    results = ["n_sample", "n_effective", "mean", "std_error", "margin_of_error", "ci_95_lower", "ci_95_upper"]
    if clash := set(results) & set(keys):
        raise ValueError(f"keys have the names of results: {', '.join(sorted(clash))}")
    own = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[col(k).alias(n) for k, n in zip(keys, own, strict=True)], col(target).cast("double").alias("x"), col(weight).cast("double").alias("w")).na.drop()
    origin = _origins(df, [target])[target]

    def summed(given: DataFrame, origin: Column) -> DataFrame:
        off = F.col("x") - origin
        return given.withColumn("origin", origin).groupBy(*own, "origin").agg(
            F.count("*").alias("n"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sww"), F.sum(F.col("w") * off).alias("first"), F.sum(F.col("w") * off * off).alias("second")
        )

    drift = F.try_divide(F.col("first") * F.col("first"), F.col("sw"))
    far = F.coalesce((F.col("second") != 0) & (drift > SAFE * F.abs(F.col("second") - drift)), F.lit(False))
    scratch = Scratch(df.sparkSession, "estimates")
    sums = scratch.save("sums", summed(rows, F.lit(origin)))
    mean = F.col("origin") + F.try_divide("first", "sw")
    if not (distant := sums.where(far)).isEmpty():
        again = rows.join(distant.select(*own, mean.alias("center")), own)
        sums = sums.where(~far).unionByName(scratch.save("again", summed(again, F.col("center"))))
    size: Column = F.try_divide(F.col("sw") * F.col("sw"), F.col("sww"))
    variance = F.try_divide(F.col("second") - drift, F.col("sw")) * F.col("n") / (F.col("n") - 1)
    error = F.when(variance >= 0, F.sqrt(F.try_divide(variance, size)))
    done = sums.where("n > 1").select(*own, "n", size.alias("size"), mean.alias("mean"), error.alias("se"))
    done = done.withColumn("moe", critical_column(F.col("size") - 1) * F.col("se"))
    four = lambda x, name: round_even(x, 4).alias(name)
    return done.select(
        *[F.col(n).alias(k) for k, n in zip(keys, own, strict=True)], F.col("n").alias("n_sample"), round_even(F.col("size"), 2).alias("n_effective"), four(F.col("mean"), "mean"), four(F.col("se"), "std_error"),
        four(F.col("moe"), "margin_of_error"), four(F.col("mean") - F.col("moe"), "ci_95_lower"), four(F.col("mean") + F.col("moe"), "ci_95_upper"),
    )


def reliability(estimates: DataFrame, absolute: bool = False) -> DataFrame:
    """estimates with cv (percent, one digit) and reliability; the sign of cv counts unless absolute."""
    cv = F.when(F.col("mean") != 0, F.col("std_error") / F.col("mean") * 100).otherwise(F.lit(0.0))
    cv = F.abs(cv) if absolute else cv
    label = F.when(cv < 5, "high").when(cv < 15, "moderate").otherwise("low")
    return estimates.withColumns({"cv": round_even(cv, 1), "reliability": label})
