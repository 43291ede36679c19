"""Session settings that the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.caseSensitive": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}


def session(app: str = "canvass", **more: str) -> SparkSession:
    return SparkSession.builder.appName(app).config(map=SETTINGS | more).getOrCreate()
