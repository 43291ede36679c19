"""CSV records of files whose cells may hold line ends, read in splits, and row numbers in file order.

A split can't tell from its own bytes whether it starts within quotes: that follows from the parity of all quotes before it. One pass takes each split's
parity, a prefix XOR over a file's splits (a row each) gives the state in which each starts, and a second pass puts lines together into records from
there. A record that goes on into the next splits leaves a piece in each; those pieces, two a split at most, are joined afterwards.

Lines end at 0x0A; a 0x0D before the end of a record is left out, one within a cell stays. Blank records are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canvass.scratch import Scratch, broadcast_by_bytes, setting

WHOLE, HEAD, TAIL = range(3)
#: Bytes of splits that one task reads one after another: small splits don't each cost a task and an output file.
TASK_BYTES = 32 << 20
_RECORDS = "file string, block long, at long, kind int, text string"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block: where the line's split starts)."""
    found = spark.read.option("lineSep", "\n").text(path)
    return found.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _dealt(found: DataFrame, split_bytes: int) -> DataFrame:
    """lines with a task for TASK_BYTES of splits, or as many as there are cores; splits stay whole and their lines in order."""
    splits = found.rdd.getNumPartitions()
    tasks = max(found.sparkSession.sparkContext.defaultParallelism, -(-splits * split_bytes // TASK_BYTES))
    return found.coalesce(tasks) if tasks < splits else found


def starts_open(found: DataFrame) -> DataFrame:
    """lines -> (file, block, open: the split starts within quotes, last: the file ends within them)."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    parity = found.groupBy("file", "block").agg(F.bit_xor(quotes % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    return parity.select("file", "block", F.coalesce(F.bit_xor("odd").over(before), F.lit(0)).alias("open"), F.bit_xor("odd").over(whole).alias("last"))


class _Block:
    """Records of one split, from its lines in order."""

    def __init__(self, file: str, block: int, is_open: bool):
        self.file, self.block, self.open, self.at = file, block, is_open, 0
        self.pending: list[str] = []
        self.kind = HEAD if is_open else WHOLE
        self.rows: list[tuple] = []

    def _put(self, kind: int, text: str) -> None:
        if kind == HEAD:
            self.rows.append((-1, kind, text))
        elif kind == TAIL or text.strip():
            self.rows.append((self.at, kind, text.removesuffix("\r") if kind == WHOLE else text))
            self.at += 1

    def add(self, values: pa.Array) -> None:
        state = np.cumsum(np.concatenate([[self.open], pc.count_substring(values, '"').to_numpy(zero_copy_only=False)])) % 2
        self.open = bool(state[-1])
        ends = np.flatnonzero(state[1:] == 0)
        texts, start = values.to_pylist(), 0
        for end in ends.tolist():
            if self.pending or end > start:
                self._put(self.kind, "\n".join([*self.pending, *texts[start : end + 1]]))
                self.pending, self.kind = [], WHOLE
            else:
                self._put(self.kind, texts[end])
                self.kind = WHOLE
            start = end + 1
        self.pending += texts[start:]

    def flush(self, last: bool = False) -> pa.RecordBatch:
        if last and self.pending:
            self._put(HEAD if self.kind == HEAD else TAIL, "\n".join(self.pending))
            self.pending = []
        rows, self.rows, n = self.rows, [], len(self.rows)
        at, kind, text = zip(*rows, strict=True) if rows else ((), (), ())
        arrays = [pa.array([self.file] * n, pa.string()), pa.array([self.block] * n, pa.int64()), pa.array(at, pa.int64()), pa.array(kind, pa.int32()), pa.array(text, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=["file", "block", "at", "kind", "text"])


def _record_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(value, file, block, open), a split's lines in order -> its records and pieces."""
    held: _Block | None = None
    for batch in batches:
        files, blocks = batch.column(1), batch.column(2).to_numpy()
        edges = np.flatnonzero(np.diff(blocks) != 0) + 1
        if len(files.unique()) > 1:
            codes = files.dictionary_encode().indices.to_numpy()
            edges = np.union1d(edges, np.flatnonzero(np.diff(codes) != 0) + 1)
        bounds = [0, *edges.tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:], strict=False):
            if a == b:
                continue
            file, block = files[a].as_py(), int(blocks[a])
            if held is None or (held.file, held.block) != (file, block):
                if held is not None:
                    yield held.flush(last=True)
                held = _Block(file, block, bool(batch.column(3)[a].as_py()))
            held.add(batch.column(0).slice(a, b - a))
            yield held.flush()
    if held is not None:
        yield held.flush(last=True)


def records(spark: SparkSession, path: str, scratch: Scratch, split_bytes: int | None = None) -> tuple[DataFrame, bool]:
    """((file, block, at: number within the split, text) of each record, whether all quotes enclose whole cells).

    split_bytes: bytes of a split, by the session's setting if None. Where quotes stand within cells, or a file ends within quotes, records can't be told by
    parity, and the caller has to read whole files.
    """
    key = "spark.sql.files.maxPartitionBytes"
    with setting(spark, key, str(split_bytes) if split_bytes else spark.conf.get(key)), setting(spark, "spark.sql.files.openCostInBytes", "0" if split_bytes else spark.conf.get("spark.sql.files.openCostInBytes")):
        found = _dealt(lines(spark, path), split_bytes) if split_bytes else lines(spark, path)
        states = scratch.save("states", starts_open(found))
        opens = states.select("file", "block", "open")
        small = broadcast_by_bytes(opens)
        if small is opens:  # too many splits to broadcast: the join deals lines anew, each split's to one task but in any order
            told = found.withColumn("place", F.monotonically_increasing_id()).join(opens, ["file", "block"]).sortWithinPartitions("file", "block", "place")
        else:
            told = found.join(small, ["file", "block"])
        told = told.select("value", "file", "block", "open")
        pieces = scratch.save("pieces", told.mapInArrow(_record_rows, _RECORDS))
    order = Window.partitionBy("file").orderBy("block", "kind")
    parts = pieces.where(F.col("kind") != WHOLE).withColumn("record", F.count_if(F.col("kind") == TAIL).over(order))
    joined = parts.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "kind", "at", "text"))).alias("p"))
    joined = joined.select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["at"].alias("at"), F.regexp_replace(F.array_join(F.transform("p", lambda x: x["text"]), "\n"), "\r$", "").alias("text"))
    whole = pieces.where(F.col("kind") == WHOLE).select("file", "block", "at", "text")
    # Quoted stretches become one sign each; beside them only a comma, another stretch or the record's end may stand.
    marked = F.regexp_replace("text", '"[^"]*"', "\u0001")
    every = whole.unionByName(joined)
    odd = marked.rlike('[^,\u0001]\u0001|\u0001[^,\u0001]|"')
    sound = states.where("last = 1").isEmpty() and every.where(odd).isEmpty()
    return every, sound


def numbered(found: DataFrame, into: str, header: bool = True) -> DataFrame:
    """Records -> (into: the row's number from 0 in the order of files and places in them, text), without the files' headers."""
    counts = found.groupBy("file", "block").agg(F.count("*").alias("n"))
    within = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.select("file", "block", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("before"))
    files = counts.groupBy("file").agg((F.sum("n") - int(header)).alias("n"))  # a row for each file
    across = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.join(files.select("file", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("offset")), "file")
    placed = found.join(broadcast_by_bytes(offsets.select("file", "block", "before", "offset")), ["file", "block"])
    number = F.col("before") + F.col("at")
    rows = placed.where(number > 0) if header else placed
    return rows.select((F.col("offset") + number - int(header)).alias(into), "text")
