"""A training-corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps; all but the last return the columns
of documents. ``run`` writes each stage's result to the shared folder as Parquet and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm import bpe, decontaminate, pii, quality, simhash
from canvass.llm.common import Scratch, broadcast_by_bytes, read
from canvass.llm.queries import codec


def _row(docs: DataFrame) -> Column:
    """What tells rows apart: doc_id and text."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text"))


def _marked(docs: DataFrame) -> DataFrame:
    """(kept: the row's own columns, row), so that no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"), _row(docs).alias("row"))


def _without(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """docs without the rows that ``gone`` (row) names."""
    gone = Scratch(docs.sparkSession, name).save("out", gone.distinct())
    return _marked(docs).join(broadcast_by_bytes(gone), "row", "left_anti").select("kept.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier, trained on the labels, predicts to be of quality 1.

    Null and empty texts are scored by the bias alone; equal rows have equal scores; without labels all scores are 0.5 and nothing is kept; an
    empty table stays empty; columns of the names held_out, score and predicted come back unchanged.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"), "doc_id", "text")
    return quality.classify(own, read(spark, sf_dir, "labels")).where("predicted = 1").select("kept.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group that chains of pairs of five-word Jaccard similarity 0.8 or more connect: that of smallest doc_id.

    Rows are told apart by doc_id and text, so that a repeated doc_id loses no text; of rows equal in both one stays. A null doc_id comes after
    all others, ties go by a hash of the row. Null and empty texts are one group; an empty table stays empty; further columns are carried along.
    """
    scratch = Scratch(spark, "copies")
    rows = docs.select(_row(docs).alias("row"), "doc_id", "text")
    found = simhash.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), shingle=5, similarity=0.8)
    found = scratch.save("found", found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")).distinct())
    several = scratch.save("several", found.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component"))
    members = found.join(broadcast_by_bytes(several), "component").join(rows.select("row", "doc_id").distinct(), "row")
    first = members.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    gone = members.join(broadcast_by_bytes(scratch.save("first", first)), "component").where("row <> first.row")
    kept = _without(docs, gone.select("row"), "gone")
    # Rows that are equal in doc_id and text count as one.
    repeated = scratch.save("repeated", rows.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select("row"))
    once = _marked(kept).join(broadcast_by_bytes(repeated), "row", "left_anti").select("kept.*")
    again = _marked(kept).join(broadcast_by_bytes(repeated), "row", "left_semi").select("kept.*").dropDuplicates(["doc_id", "text"])
    return once.unionByName(again)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item or most of its tokens in a row.

    Each row is judged by its own text, whatever its doc_id; null and empty texts stay; equal rows go together; an empty table on either
    side drops nothing; further columns are carried along.
    """
    found = decontaminate.contaminated(docs.select(_row(docs).alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    return _without(docs, found.select(F.col("doc_id").alias("row")), "leaks")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, with personal data replaced by its kind; n_chars follows the new text.

    A null text stays null, with n_chars null; an empty one stays empty; equal rows are treated alike; an empty table stays empty; columns
    of the names base and spans come back unchanged.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"), "doc_id", "text")
    found = pii.personal_data(own).withColumn("text", pii.sanitised(F.col("text"), F.col("spans")))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return found.select(*[new.get(c, F.col(f"kept.`{c}`")).alias(c) for c in docs.columns])


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, their digest and that of the bytes decoded from them.

    A null text has the ids of an empty one, none; every row stays; an empty table stays empty; columns of the names that are added are replaced.
    """
    return bpe.round_trip(docs, codec(), with_ids=True)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("bpe", bpe_stage),
]

#: Training and components can't be expressed in SQL; tests/llm tests the operators behind the stages and the run as a whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what one stage keeps is written for the next and dropped when that is written."""
    scratch = Scratch(spark, "pipeline")
    docs, before = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = scratch.save(name, stage(spark, docs, sf_dir))
        scratch.drop(*before)
        before = [name]
    return STAGES[-1][1](spark, docs, sf_dir)
