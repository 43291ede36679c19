"""Sinks: CSV, records, HTML."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, mode: str = "error", **options) -> None:
    """With a header; quotes in cells are doubled and white space is kept. options: further ones of Spark's CSV writer."""
    df.write.mode(mode).options(**{"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False} | options).csv(path, header=True)


#: Most rows of a response.
RECORDS = 100_000


def records(df: DataFrame, most: int = RECORDS) -> list[dict]:
    """Row dictionaries of a small result, keys included; a larger one is an error, not cut."""
    found = df.toJSON().take(most + 1)
    if len(found) > most:
        raise ValueError(f"over {most} rows: write them with a sink instead")
    return [json.loads(x) for x in found]


def write_html(html: str, path: str) -> None:
    Path(path).write_text(html, encoding="utf-8")
