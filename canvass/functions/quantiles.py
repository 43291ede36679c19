"""Exact, linearly interpolated quantiles: of many columns, and of groups of any size.

Order statistics are found by rank selection. Bounds around a rank come from a quantile sketch, exact counts tell on which side of them the rank lies, and the
open interval that is left is narrowed again until it holds few values; those alone are collected and sorted. Every quantile is interpolated by the same
formula between two order statistics.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.functions.columns import col
from canvass.scratch import Scratch

#: Most values of one interval that are sorted at the end; of a group that is sorted at once.
INTERVAL_ROWS = 20_000
#: Cuts of an interval of a group in one round.
CUTS = 128
#: How far, as a share of ranks, a column's first bounds are from the rank.
MARGIN = 0.002


def interpolated(low, high, share):
    """Between two neighbouring order statistics, from the nearer one; numbers or Columns."""
    if isinstance(share, Column):
        return F.when(low == high, low).when(share < 0.5, low + (high - low) * share).otherwise(high - (high - low) * (1 - share))
    if low == high:
        return low
    return low + (high - low) * share if share < 0.5 else high - (high - low) * (1 - share)


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float], interval_rows: int = INTERVAL_ROWS) -> dict[str, list[float | None]]:
    """Quantiles by column; None where a column has no values. NULLs are skipped."""
    if not columns:
        return {}
    cuts = [min(1.0, max(0.0, p + d)) for p in probabilities for d in (-MARGIN, MARGIN)]
    first = df.agg(*[F.count(col(c)) for c in columns], *[F.percentile_approx(col(c).cast("double"), F.array(*map(F.lit, cuts))) for c in columns]).first()
    counts = dict(zip(columns, first, strict=False))
    pivots = {c: x or [] for c, x in zip(columns, first[len(columns) :], strict=True)}
    ranks = {(c, r): None for c in columns for p in probabilities if counts[c] for r in (math.floor(p * (counts[c] - 1)), math.ceil(p * (counts[c] - 1)))}
    found = _order_statistics(df, list(ranks), counts, pivots, interval_rows)
    out: dict[str, list[float | None]] = {}
    for c in columns:
        places = [p * (counts[c] - 1) for p in probabilities]
        out[c] = [interpolated(found[c, math.floor(at)], found[c, math.ceil(at)], at - math.floor(at)) if counts[c] else None for at in places]
    return out


def _inside(x: Column, low: float | None, high: float | None) -> Column:
    """Strictly between two bounds, either of which may be open."""
    test = x.isNotNull()
    test = test if low is None else test & (x > low)
    return test if high is None else test & (x < high)


def _order_statistics(df: DataFrame, wanted: list[tuple[str, int]], counts: dict[str, int], pivots: dict[str, list[float]], interval_rows: int) -> dict[tuple[str, int], float]:
    """Values by (column, rank from 0). A round is one aggregate for counts and, if intervals are still wide, one for new bounds.

    All intervals together hold at most interval_rows values for each column when they are sorted.
    """
    found: dict[tuple[str, int], float] = {}
    spans = {key: (None, None, 0, counts[key[0]]) for key in wanted}  # low, high, values up to low, values inside
    while spans:
        distinct = {(key[0], *span) for key, span in spans.items()}
        if sum(x[4] for x in distinct) <= interval_rows * max(1, len(counts)):
            order = list(distinct)
            row = df.agg(*[F.sort_array(F.collect_list(F.when(_inside(x, low, high), x))) for c, low, high, _, _ in order for x in [col(c).cast("double")]]).first()
            values = dict(zip(order, row, strict=True))
            return found | {key: values[key[0], *span][key[1] - span[2]] for key, span in spans.items()}
        bounds = [(c, t) for c in pivots for t in sorted(set(pivots[c]))]
        row = df.agg(*[f for c, t in bounds for x in [col(c).cast("double")] for f in (F.count_if(x < t), F.count_if(x <= t))]).first()
        ranked = {b: row[2 * i : 2 * i + 2] for i, b in enumerate(bounds)}
        for key, (low, high, below, inside) in list(spans.items()):
            end = below + inside
            for c, t in bounds:
                if c == key[0] and (low is None or t > low) and (high is None or t < high):
                    less, up_to = ranked[c, t]
                    if less <= key[1] < up_to:
                        found[key] = t
                        spans.pop(key)
                        break
                    if key[1] < less:
                        high, end = t, less
                        break
                    low, below = t, up_to
            if key in spans:
                spans[key] = (low, high, below, end - below)
        pivots = _cuts(df, spans) if spans else {}
    return found


def _cuts(df: DataFrame, spans: dict) -> dict[str, list[float]]:
    """New bounds inside each interval, near the rank."""
    order, tests = list({(key[0], *span) for key, span in spans.items()}), []
    for c, low, high, below, inside in order:
        at = [(key[1] - below) / max(1, inside - 1) for key, span in spans.items() if (key[0], *span) == (c, low, high, below, inside)]
        near = sorted({min(1.0, max(0.0, a + d)) for a in at for d in (-MARGIN, 0.0, MARGIN)})
        x = col(c).cast("double")
        tests.append(F.percentile_approx(F.when(_inside(x, low, high), x), F.array(*map(F.lit, near))))
    out: dict[str, list[float]] = {}
    for (c, *_), values in zip(order, df.agg(*tests).first(), strict=True):
        out.setdefault(c, []).extend(values or [])
    return out


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, probabilities: list[float], interval_rows: int = INTERVAL_ROWS) -> DataFrame:
    """(keys, q0, q1, ...) for each group with a value; NULL keys and values are left out.

    Groups of up to interval_rows values are sorted as they are. Of a larger one no task sees more than a sketch, counts and the values of an interval.
    """
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[col(k).alias(n) for k, n in zip(keys, names, strict=True)], col(value).cast("double").alias("v")).na.drop()
    scratch = Scratch(df.sparkSession, "quantiles")
    sizes = scratch.save("sizes", rows.groupBy(*names).agg(F.count("*").alias("n")))
    back = [F.col(n).alias(k) for k, n in zip(keys, names, strict=True)]
    quantiles = lambda at: [at(F.lit(p) * (F.col("n") - 1)).alias(f"q{i}") for i, p in enumerate(probabilities)]

    def of_sorted(at: Column) -> Column:
        return interpolated(F.get("sorted", F.floor(at).cast("int")), F.get("sorted", F.ceil(at).cast("int")), at - F.floor(at))

    few = rows.join(sizes.where(F.col("n") <= interval_rows), names).groupBy(*names, "n").agg(F.sort_array(F.collect_list("v")).alias("sorted"))
    done = few.select(*back, *quantiles(of_sorted))
    many = sizes.where(F.col("n") > interval_rows)
    if many.isEmpty():
        return done
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(F.lit(p) * (F.col("n") - 1)), F.ceil(F.lit(p) * (F.col("n") - 1))) for p in probabilities])))
    state = many.select(*names, F.explode(ranks).alias("rank")).selectExpr(*names, "rank", "cast(null as double) low", "cast(null as double) high", "0L below")
    state = scratch.save("state0", state.join(many, names).withColumnRenamed("n", "inside").withColumn("value", F.lit(None).cast("double")))
    turn = 0
    inside = (F.col("low").isNull() | (F.col("v") > F.col("low"))) & (F.col("high").isNull() | (F.col("v") < F.col("high")))
    place = [*names, "rank"]
    while True:
        wide = state.where(F.col("value").isNull() & (F.col("inside") > interval_rows))
        if wide.isEmpty():
            break
        turn += 1
        # One sketch for all ranks that share an interval.
        spans = [*names, "low", "high", "below", "inside"]
        held = scratch.save(f"spans{turn}", wide.select(*spans).distinct())
        grid = rows.join(held, names).where(inside).groupBy(*spans).agg(F.percentile_approx("v", F.array(*[F.lit(i / CUTS) for i in range(CUTS + 1)]), F.lit(20 * CUTS)).alias("grid"))
        grid = scratch.save(f"grid{turn}", grid)
        same = [F.col(f"w.{c}").eqNullSafe(F.col(f"g.{c}")) for c in spans]
        at = F.floor((F.col("w.rank") - F.col("w.below")) / F.col("w.inside") * CUTS).cast("int")
        cut = wide.alias("w").join(grid.alias("g"), same).select("w.*", F.get("g.grid", F.greatest(at - 1, F.lit(0))).alias("a"), F.get("g.grid", F.least(at + 2, F.lit(CUTS))).alias("b"))
        cut = scratch.save(f"cut{turn}", cut)
        v, a, b = F.col("v"), F.col("a"), F.col("b")
        counted = rows.join(cut.select(*place, "low", "high", "a", "b"), names).where(inside).groupBy(*place).agg(
            F.count_if(v < a).alias("less"), F.count_if(v <= a).alias("up_to"), F.count_if(v < b).alias("less_b"), F.count_if(v <= b).alias("up_to_b")
        )
        rank = F.col("rank") - F.col("below")
        step = lambda first, middle, last: F.when(rank < F.col("less"), first).when(rank < F.col("less_b"), middle).otherwise(last)
        narrowed = cut.join(counted, place).select(
            *place, step(F.col("low"), a, b).alias("low"), step(a, b, F.col("high")).alias("high"),
            (F.col("below") + step(F.lit(0), F.col("up_to"), F.col("up_to_b"))).alias("below"),
            step(F.col("less"), F.col("less_b") - F.col("up_to"), F.col("inside") - F.col("up_to_b")).alias("inside"),
            F.when((F.col("less") <= rank) & (rank < F.col("up_to")), a).when((F.col("less_b") <= rank) & (rank < F.col("up_to_b")), b).alias("value"),
        )
        kept = state.where(F.col("value").isNotNull() | (F.col("inside") <= interval_rows))
        state = scratch.save(f"state{turn}", kept.unionByName(narrowed))
        scratch.drop(f"state{turn - 1}", f"spans{turn}", f"grid{turn}", f"cut{turn}")
    left = state.where("value is null")
    spans = [*names, "low", "high", "below"]
    sorted_values = rows.join(left.select(*spans).distinct(), names).where(inside).groupBy(*spans).agg(F.sort_array(F.collect_list("v")).alias("sorted"))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"g.{c}")) for c in spans]
    last = left.alias("s").join(sorted_values.alias("g"), same).select(*[F.col(f"s.{c}") for c in place], F.get("g.sorted", (F.col("s.rank") - F.col("s.below")).cast("int")).alias("value"))
    statistics = last.unionByName(state.where("value is not null").select(*place, "value"))
    ranked = statistics.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("by_rank")).join(many, names)

    def of_ranks(at: Column) -> Column:
        return interpolated(F.element_at("by_rank", F.floor(at)), F.element_at("by_rank", F.ceil(at)), at - F.floor(at))

    return done.unionByName(ranked.select(*back, *quantiles(of_ranks)))
