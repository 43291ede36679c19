"""A seeded synthetic survey with one planted defect for each cleaning step."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def survey(respondents: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A row for each respondent: Respondent_ID, Q1_Age_Years, Income, Household_Size, Survey_Weight, which follow from the key and the seed alone.

    Of each thousand rows about 50 have no income, 5 an income ten times as high and 10 an age of -5.
    """
    def draw(i: int) -> Column:
        """Even between 0 and 1."""
        return F.pmod(F.xxhash64(F.lit(seed + i), F.col("id")), F.lit(1 << 40)) / float(1 << 40)

    normal = F.sqrt(-2 * F.log(1 - draw(2))) * F.cos(2 * math.pi * draw(8))
    df = respondents.select(F.col(key).cast("long").alias("id")).select(
        F.col("id").alias("Respondent_ID"),
        (F.lit(18) + F.floor(draw(1) * 62)).cast("int").alias("age"),
        (F.lit(50_000.0) + F.lit(15_000.0) * normal).alias("income"),
        (F.lit(1) + F.floor(draw(3) * 5)).cast("int").alias("Household_Size"),
        (F.lit(0.8) + draw(4) * 0.7).alias("Survey_Weight"),
        (draw(5) < 0.05).alias("no_income"), (draw(6) < 0.005).alias("high"), (draw(7) < 0.01).alias("bad_age"),
    )
    return df.select(
        "Respondent_ID",
        F.when(F.col("bad_age"), -5).otherwise(F.col("age")).alias("Q1_Age_Years"),
        F.when(~F.col("no_income"), F.when(F.col("high"), F.col("income") * 10).otherwise(F.col("income"))).alias("Income"),
        "Household_Size",
        "Survey_Weight",
    )
