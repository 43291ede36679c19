"""Running totals within groups, without a task that holds a whole group.

Places in a group's order are cut into ranges by bounds of about equal row counts, taken from a quantile sketch of all rows. Totals run within
(group, range), and each range starts from the sum of the group's ranges before it: those sums are one small row for each group and range. So a group
of any size is spread over as many tasks as it fills ranges, with one shuffle of the rows.

Which range a row is in follows from its place alone, so a task that runs again makes the same rows. Equal places share a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Least and most ranges, and the rows that are aimed at in each.
RANGES, MOST_RANGES, ROWS_A_RANGE = 32, 4096, 500_000


def _code(df: DataFrame, name: str) -> Column:
    """A number that does not fall where the column rises."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.NumericType):
        return F.col(name).cast("double")
    if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    if isinstance(kind, T.StringType):  # by its first bytes
        return F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(name), "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    raise TypeError(f"rows can't be ordered by {kind.simpleString()}")


def in_ranges(df: DataFrame, order: str, into: str, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """df with the number of each row's range, an int that does not fall where ``order`` rises; NULL places are in range 0."""
    code = _code(df, order)
    parts = [F.percentile_approx(code, F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(4 * n)) for n in (RANGES, MOST_RANGES)]
    n = df.agg(F.count(code)).first()[0]
    wanted = max(RANGES, min(MOST_RANGES, n // rows_a_range))
    found = df.agg(parts[wanted > RANGES]).first()[0] or []
    step = 1 if wanted == RANGES else max(1, MOST_RANGES // wanted)
    bounds = sorted(set(found[step - 1 :: step]))
    levels = len(bounds).bit_length()
    held = F.array(*[F.lit(x) for x in bounds + [float("inf")] * ((1 << levels) - 1 - len(bounds))]) if levels else None
    # Binary search, a level a projection: the number of bounds below the place.
    out = df.withColumn(into, F.lit(0))
    for level in reversed(range(levels)):
        below = F.get(held, F.col(into) + F.lit((1 << level) - 1)) < code
        out = out.withColumn(into, F.col(into) + F.when(below, 1 << level).otherwise(0))
    return out


def running_sum(df: DataFrame, keys: list[str], order: str, value: str, into: str, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """df with the sum of value over the group's rows up to and including this one in ascending order; NULLs add nothing.

    Columns of the names range, carried and local must not be in df.
    """
    placed = in_ranges(df, order, "range", rows_a_range)
    sums = placed.groupBy(*keys, "range").agg(F.sum(value).alias("local"))
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*keys, "range", F.sum("local").over(before).alias("carried"))
    own = Window.partitionBy(*keys, "range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.withColumn("local", F.sum(value).over(own))
    zero = F.lit(0)
    return local.join(carried, [*keys, "range"]).withColumn(into, F.coalesce("local", zero) + F.coalesce("carried", zero)).drop("range", "local", "carried")
