"""Profiling: missing cells, duplicate rows and columns, shape."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.functions.columns import col, numeric_columns

#: Pairs of columns of one type that are compared as they are; where there are more, a fingerprint of each column comes first.
PAIRS = 40


def missing_by_column(df: DataFrame) -> DataFrame:
    """(column, missing) for each column, from one aggregate."""
    counts = df.agg(*[F.count_if(col(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(df.columns)])
    return counts.select(F.inline(rows))


def missing_cells(df: DataFrame) -> DataFrame:
    total = F.lit(0).cast("long")
    for c in df.columns:
        total = total + F.count_if(col(c).isNull())
    return df.agg(total.alias("missing_count"))


def duplicate_row_count(df: DataFrame) -> DataFrame:
    """All members of groups of equal rows, the first included; NULL equals NULL. Counts combine before the shuffle."""
    groups = df.groupBy(*[col(c) for c in df.columns]).agg(F.count("*").alias("members"))
    return groups.where("members > 1").agg(F.coalesce(F.sum("members"), F.lit(0)).alias("duplicate_rows"))


def duplicate_row_members(df: DataFrame, row_id: str) -> DataFrame:
    """The rows that equal another one in all columns but row_id, which a reader's row_label may be.

    Rows are compared whole only where their hashes repeat.
    """
    by = [f"c{i}" for i in range(len(df.columns) - 1)]
    rest = [c for c in df.columns if c != row_id]
    own = df.select(col(row_id).alias("row"), *[col(c).alias(n) for c, n in zip(rest, by, strict=True)])
    own = own.withColumn("hash", F.xxhash64(*by))
    hashes = own.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    likely = own.join(hashes, "hash", "left_semi")
    repeated = likely.groupBy("hash", *by).agg(F.count("*").alias("n")).where("n > 1")
    same = F.col("d.hash") == F.col("r.hash")
    for c in by:
        same = same & F.col(f"d.{c}").eqNullSafe(F.col(f"r.{c}"))
    found = likely.alias("d").join(repeated.alias("r"), same, "left_semi")
    names = dict(zip(rest, by, strict=True)) | {row_id: "row"}
    return found.select(*[F.col(names[c]).alias(c) for c in df.columns])


def _equal(df: DataFrame, pairs: list[tuple[str, str]]) -> list[bool]:
    """Whether the columns of each pair are equal in all rows, from one aggregate."""
    return list(df.agg(*[F.coalesce(F.bool_and(col(a).eqNullSafe(col(b))), F.lit(True)) for a, b in pairs]).first()) if pairs else []


def column_classes(df: DataFrame) -> list[list[str]]:
    """Columns of one type and equal content together, in the order of the table, also those alone.

    Columns are put together by a fingerprint of their cells with their rows, and each is then compared with the first of its class alone; those
    that differ from it, for all that their fingerprints agree, are tried among themselves. So comparisons are as many as columns.
    """
    if not df.columns:
        return []
    kinds = {f.name: f.dataType.json() for f in df.schema}
    # What ties a cell to its row is a hash of the whole row: equal columns agree in it whatever their place.
    row = F.xxhash64(*[col(c) for c in df.columns])
    prints = df.select(row.alias("row"), F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(df.columns)]).alias("cells"))
    found = prints.agg(*[F.bit_xor(F.xxhash64("row", f"cells.c{i}")) for i in range(len(df.columns))]).first()
    waiting = [list(g) for g in _grouped([(kinds[c], p, c) for c, p in zip(df.columns, found, strict=True)])]
    classes = []
    while waiting:
        tests = [(g[0], c) for g in waiting for c in g[1:]]
        same = dict(zip(tests, _equal(df, tests), strict=True))
        classes += [[g[0], *[c for c in g[1:] if same[g[0], c]]] for g in waiting]
        waiting = [rest for g in waiting if (rest := [c for c in g[1:] if not same[g[0], c]])]
    return sorted(classes, key=lambda g: df.columns.index(g[0]))


def _grouped(rows: list[tuple]) -> list[list[str]]:
    groups: dict[tuple, list[str]] = {}
    for *key, name in rows:
        groups.setdefault(tuple(key), []).append(name)
    return list(groups.values())


def duplicate_columns(df: DataFrame) -> DataFrame:
    """(pair) "a == b" for each pair of one type and equal content; all pairs of one type in an empty table."""
    kinds = {f.name: f.dataType for f in df.schema}
    pairs = [(a, b) for a, b in itertools.combinations(df.columns, 2) if kinds[a] == kinds[b]]
    if len(pairs) <= PAIRS:
        equal = [x for x, same in zip(pairs, _equal(df, pairs), strict=True) if same]
    else:
        place = {c: i for i, c in enumerate(df.columns)}
        equal = sorted(((a, b) for g in column_classes(df) for a, b in itertools.combinations(g, 2)), key=lambda x: (place[x[0]], place[x[1]]))
    return df.sparkSession.createDataFrame([(f"{a} == {b}",) for a, b in equal], "pair string")


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"), F.lit(len(df.columns)).cast("long").alias("col_count"))


def profile(df: DataFrame, filename: str) -> dict:
    """The upload profile: counts, duplicate columns, numeric columns and headers."""
    first = df.agg(F.count("*").alias("rows"), *[F.count_if(col(c).isNull()) for c in df.columns]).first()
    return {
        "filename": filename,
        "row_count": first["rows"],
        "col_count": len(df.columns),
        "missing_count": sum(first[1:]),
        "duplicate_rows": duplicate_row_count(df).first()[0],
        "duplicate_cols": [x[0] for x in duplicate_columns(df).collect()],  # bounded by the schema
        "numeric_columns": numeric_columns(df),
        "headers": df.columns,
    }
