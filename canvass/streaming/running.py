"""Running weighted means over a stream: sums that merge, by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.functions.columns import col


def windowed_weighted_mean(stream: DataFrame, time: str, target: str, weight: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(start, end, n_sample, n_effective, mean) for each window; rows later than the delay are left out, as are those with a NULL."""
    w, x = col(weight).cast("double"), col(target).cast("double")
    both = stream.where(w.isNotNull() & x.isNotNull()).withWatermark(time, delay)
    sums = both.groupBy(F.window(col(time), window).alias("w")).agg(F.count("*").alias("n_sample"), F.sum(w).alias("sw"), F.sum(w * w).alias("sww"), F.sum(w * x).alias("swx"))
    return sums.select("w.start", "w.end", "n_sample", F.try_divide(F.col("sw") * F.col("sw"), F.col("sww")).alias("n_effective"), F.try_divide("swx", "sw").alias("mean"))
