"""Readers by suffix. Every table gets one inferred schema at ingest, with one kind of missing value, NULL."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canvass.functions.columns import col, nan_to_null
from canvass.scratch import Scratch, broadcast_by_bytes
from canvass.sources.records import numbered, records

#: Cell texts that mean a missing value.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
MOST_FILES = 5


def has_quoted_line_ends(spark: SparkSession, path: str) -> bool:
    """Some line has an odd number of quotes, so that a cell goes on in the next one."""
    line = F.col("value")
    return not spark.read.text(path).where((F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, multi_line: bool | None = None, row_label: str | None = None, split_bytes: int | None = None) -> DataFrame:
    """First row as header; types are inferred from all rows in one aggregate. A column without values is double.

    Files are read in splits, also where cells hold line ends (multi_line says so, None looks): see ``records``. Only files with stray quotes
    are read whole, by one task each. row_label: name of a column with each row's number from 0 in file order, to be added.
    """
    multi_line = has_quoted_line_ends(spark, path) if multi_line is None else multi_line
    if not multi_line and row_label is None:
        return infer_types(spark.read.csv(path, header=True, inferSchema=False, escape='"', nullValue=None))
    whole = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', nullValue=None)
    names = [*whole.columns[:-1], whole.columns[-1].removesuffix("\r")]
    if row_label in names:
        raise ValueError(f"the file has a column {row_label}")
    scratch = Scratch(spark, "csv")
    found, sound = records(spark, path, scratch, split_bytes)
    if not sound:
        if row_label is not None:
            raise ValueError("rows of a file with stray quotes can't be numbered")
        return infer_types(whole.toDF(*names))
    rows = numbered(found, "row")
    cells = F.from_csv("text", ", ".join(f"c{i} string" for i in range(len(names))), {"escape": '"'})
    table = scratch.save("table", rows.select("row", cells.alias("cells")))
    scratch.drop("states", "pieces")
    text = table.select(*[F.col(f"cells.c{i}").alias(c) for i, c in enumerate(names)], *([F.col("row").cast("string").alias(row_label)] if row_label else []))
    return infer_types(text)


def read_parquet(spark: SparkSession, path: str, row_label: str | None = None) -> DataFrame:
    """NaN becomes NULL. row_label: as for ``read_csv``; files follow each other by path."""
    df = spark.read.parquet(path)
    if row_label is None:
        return nan_to_null(df)
    if row_label in df.columns:
        raise ValueError(f"the file has a column {row_label}")
    own = df.select(F.struct(*[col(c) for c in df.columns]).alias("own"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    counts = own.groupBy("file").agg(F.count("*").alias("n"))  # a row for each file
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = own.join(broadcast_by_bytes(offsets), "file").withColumn("row", F.col("offset") + F.col("at"))
    return nan_to_null(placed.select("own.*", F.col("row").alias(row_label)))


def infer_types(text: DataFrame) -> DataFrame:
    """Table of strings -> long, double, boolean or string columns, by what all present cells can be."""
    cells = text.select(*[F.when(~col(c).isin(*NA_TOKENS), col(c)).alias(c) for c in text.columns])
    tests = []
    for c in text.columns:
        x = F.trim(col(c))
        tests += [F.count(col(c)), F.count(F.when(x.rlike(r"^[+-]?[0-9]+$"), x.try_cast("long"))), F.count(F.when(x.rlike(r"^[+-]?([0-9.]|inf)"), x.try_cast("double"))), F.count_if(x.isin("True", "False", "TRUE", "FALSE", "true", "false"))]
    row = cells.agg(*tests).first() if tests else ()
    out = []
    for i, c in enumerate(text.columns):
        n, longs, doubles, booleans = row[4 * i : 4 * i + 4]
        kind = "double" if n == 0 else "long" if longs == n else "double" if doubles == n else "boolean" if booleans == n else None
        out.append(F.trim(col(c)).try_cast(kind).alias(c) if kind else col(c))
    return cells.select(*out)


def _with_pandas(reader: str, library: str, **options):
    def read(spark: SparkSession, path: str) -> DataFrame:
        import pandas as pd

        try:
            frame = getattr(pd, reader)(path, **options)
        except ImportError as missing:
            raise RuntimeError(f"reading {path} needs the optional library {library}") from missing
        frame.columns = [str(c) for c in frame.columns]
        for c in frame.select_dtypes("category"):
            frame[c] = frame[c].astype("string")
        return nan_to_null(spark.createDataFrame(frame.astype(object).where(frame.notna(), None) if frame.empty else frame))

    return read


#: Office and statistics files are small by their formats' limits and are read on the driver.
READERS = {
    ".csv": read_csv,
    ".parquet": read_parquet,
    ".xls": _with_pandas("read_excel", "xlrd"),
    ".xlsx": _with_pandas("read_excel", "openpyxl"),
    ".sav": _with_pandas("read_spss", "pyreadstat"),
    ".sas7bdat": _with_pandas("read_sas", "pandas", format="sas7bdat", encoding="latin-1"),
}


def load(spark: SparkSession, path: str) -> DataFrame:
    suffix = PurePosixPath(path).suffix
    if suffix not in READERS:
        raise ValueError(f"unknown suffix {suffix or '(none)'} of {path}; known: {', '.join(READERS)}")
    return READERS[suffix](spark, path)


def safe_name(path: str) -> str:
    """The file's name without folders and signs that have a meaning in paths."""
    return re.sub(r"[^A-Za-z0-9_.-]", "", PurePosixPath(path.replace("\\", "/")).name.replace(" ", "_")).strip("._")


@dataclass
class Batch:
    """What a batch of files gave: tables by name, and the reason for each file that was left out."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    failures: dict[str, str] = field(default_factory=dict)


def load_batch(spark: SparkSession, paths: list[str], most: int = MOST_FILES) -> Batch:
    """Loads each file; one that fails doesn't stop the others. No file, or more than most, is an error."""
    if not paths or len(paths) > most:
        raise ValueError(f"give 1 to {most} files")
    out = Batch()
    for path in paths:
        if name := safe_name(path):
            try:
                out.tables[name] = load(spark, path)
            except Exception as error:  # noqa: BLE001  the reason is returned
                out.failures[path] = str(error)
        else:
            out.failures[path] = "no file name"
    return out
