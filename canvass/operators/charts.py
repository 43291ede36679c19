"""Chart data as small tables: histogram, density, box statistics. Rendering is left to the caller's plotting library."""

from __future__ import annotations

import base64
import io
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.functions.columns import col, numeric_columns, require_numeric
from canvass.functions.quantiles import exact_quantiles
from canvass.operators.clean import fences, fences_of


#: Up to this many bins are put together on the driver.
LOCAL_BINS = 10_000


def automatic_bins(n: int, low: float, high: float, iqr: float, whole: bool) -> int:
    """Bins from the narrower of the Freedman-Diaconis and Sturges widths, with a floor of range / (2 sqrt n) for the former."""
    span = high - low
    if n == 0 or span == 0:
        return 1
    sturges = span / (math.log2(n) + 1)
    robust = 2 * iqr * n ** (-1 / 3)
    width = min(max(robust, span / (2 * math.sqrt(n))), sturges)
    width = max(width, 1.0) if whole else width
    return max(1, math.ceil(span / width))


def histogram(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """(bin, low, high, count) with all bins, empty ones too; the last bin includes its end. Empty for no values."""
    require_numeric(df, [column])
    x = col(column).cast("double")
    n, low, high = df.agg(F.count(x), F.min(x), F.max(x)).first()
    shape = "bin int, low double, high double, count long"
    if not n:
        return df.sparkSession.createDataFrame([], shape)
    if bins is None:
        whole = isinstance(df.schema[column].dataType, T.IntegralType)
        a, b = exact_quantiles(df, [column], [0.25, 0.75])[column]
        bins = automatic_bins(n, low, high, b - a, whole)
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    edges = [low + k * width for k in range(bins)] if bins <= LOCAL_BINS else None
    number = F.least(F.floor((x - F.lit(low)) / F.lit(width)).cast("int"), F.lit(bins - 1)) + 1
    counts = df.where(x.isNotNull()).groupBy(number.alias("bin")).agg(F.count("*").alias("count"))
    if edges:
        held = dict(counts.collect())  # a row for each bin
        return df.sparkSession.createDataFrame([(k + 1, a, low + (k + 1) * width, held.get(k + 1, 0)) for k, a in enumerate(edges)], shape)
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    edge = lambda k: F.lit(low) + k * F.lit(width)
    return every.join(counts, "bin", "left").select("bin", edge(F.col("bin") - 1).alias("low"), edge(F.col("bin")).alias("high"), F.coalesce("count", F.lit(0)).alias("count")).orderBy("bin")


def density(df: DataFrame, column: str, points: int = 200, bins: int = 1000, scale: float = 1.0) -> DataFrame:
    """(x, density): Gaussian kernel with Scott's bandwidth over binned data, times scale. Both sides of its join are of fixed size."""
    fine = histogram(df, column, bins)
    x = col(column).cast("double")
    n, sd, low, high = df.agg(F.count(x), F.stddev_samp(x), F.min(x), F.max(x)).first()
    if not n or not sd:
        return df.sparkSession.createDataFrame([], "x double, density double")
    width = sd * n ** (-1 / 5)
    start, stop = low - 3 * width, high + 3 * width
    grid = df.sparkSession.range(points).select((F.lit(start) + F.col("id") * F.lit((stop - start) / (points - 1))).alias("x"))
    z = (F.col("x") - (F.col("low") + F.col("high")) / 2) / F.lit(width)
    kernel = F.exp(-z * z / 2) * F.col("count") / F.lit(n * width * math.sqrt(2 * math.pi))
    return fine.join(F.broadcast(grid)).groupBy("x").agg((F.sum(kernel) * F.lit(scale)).alias("density")).orderBy("x")


def box_stats(df: DataFrame, columns: list[str]) -> DataFrame | None:
    """(column, q1, median, q3, whisker_low, whisker_high, outliers) of the numeric ones; None if there are none."""
    names = [c for c in columns if c in numeric_columns(df)]
    if not names:
        return None
    quartiles = exact_quantiles(df, names, [0.25, 0.5, 0.75])
    bounds = {c: fences_of(a, b) for c, (a, _, b) in quartiles.items()}
    tests = []
    for c in names:
        low, high = bounds[c] if bounds[c][0] is not None else (0.0, 0.0)
        x = col(c).cast("double")
        inside = x.between(low, high)
        tests += [F.min(F.when(inside, x)), F.max(F.when(inside, x)), F.count_if(~inside)]
    row = df.agg(*tests).first()
    rows = [(c, *quartiles[c], *row[3 * i : 3 * i + 3]) for i, c in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, "column string, q1 double, median double, q3 double, whisker_low double, whisker_high double, outliers long")


#: Most points of a column beside its box.
POINTS = 200


def outlier_points(df: DataFrame, columns: list[str], by: list[str] | None = None, most: int = POINTS, seed: int = 0) -> DataFrame:
    """(column, value): values outside the fences, at most so many of each column, those of the least hashes.

    The hash is of the seed, the column and the row's cells in ``by`` (all if None), so that each outlier is as likely as any other to be among
    them, and the same ones are whenever the table is the same. All columns come from one job; each task keeps its own least ones, so few rows are shuffled.
    """
    names = [c for c in columns if c in numeric_columns(df)]
    shape = "column string, value double"
    bounds = {c: x for c, x in fences(df, names).items() if x[0] is not None} if names else {}
    if not bounds:
        return df.sparkSession.createDataFrame([], shape)
    cells = [F.coalesce(col(c).cast("string"), F.lit("")) for c in (df.columns if by is None else by)]
    found = []
    for c, (low, high) in bounds.items():
        outside = F.coalesce(~col(c).between(low, high), F.lit(False))
        point = F.struct(F.lit(c).alias("column"), col(c).cast("double").alias("value"), F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(c), *cells)).alias("hash"))
        found.append(F.when(outside, F.array(point)).otherwise(F.array().cast("array<struct<column:string,value:double,hash:string>>")))
    points = df.select(F.inline(F.concat(*found)))
    place = F.row_number().over(Window.partitionBy("column").orderBy("hash", "value"))
    return points.withColumn("place", place).where(F.col("place") <= most).select("column", "value")


def png_base64(draw) -> str | None:
    """Base64 PNG of what draw(axes) draws; None without a plotting library."""
    try:
        from matplotlib.figure import Figure
    except ImportError:
        return None
    figure = Figure(figsize=(8, 5))
    draw(figure.subplots())
    held = io.BytesIO()
    figure.savefig(held, format="png", bbox_inches="tight")
    return base64.b64encode(held.getvalue()).decode()


def draw_histogram(bins: DataFrame, density_line: DataFrame | None = None):
    """For png_base64: bars of a histogram table and, if given, a density scaled to counts."""
    rows = bins.collect()  # a row for each bin
    line = density_line.collect() if density_line is not None else []

    def draw(axes) -> None:
        axes.bar([r["low"] for r in rows], [r["count"] for r in rows], width=[r["high"] - r["low"] for r in rows], align="edge")
        if line:
            axes.plot([r["x"] for r in line], [r["density"] for r in line])
        axes.set_ylabel("Count")

    return draw


def draw_boxes(boxes: DataFrame, points: DataFrame | None = None):
    """For png_base64: a box for each row of box statistics, with the outlier points given for its column."""
    held: dict[str, list[float]] = {}
    for r in points.collect() if points is not None else ():  # at most POINTS a column
        held.setdefault(r["column"], []).append(r["value"])
    stats = [{"label": r["column"], "q1": r["q1"], "med": r["median"], "q3": r["q3"], "whislo": r["whisker_low"], "whishi": r["whisker_high"], "fliers": held.get(r["column"], [])} for r in boxes.collect()]
    return lambda axes: axes.bxp(stats, showfliers=bool(held))
