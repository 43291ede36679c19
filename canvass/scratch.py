"""Tables that one operator call writes to the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shuffle files of a finished query are deleted at once while this is on.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master may do without: all its tasks share the machine."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="canvass-checkpoint-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Scratch:
    """Intermediate tables of one operator call, written as Parquet to the shared folder.

    A written table cuts the lineage and survives lost executors. Tables that later steps no longer
    need are deleted with ``drop``; those behind the returned DataFrame stay, as checkpoints do.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, name: str, df: DataFrame) -> DataFrame:
        with setting(self.spark, _SHUFFLE_CLEANUP, "true"):
            df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


#: Bytes of a table up to which it is broadcast.
BROADCAST_BYTES = 32 << 20


def broadcast_by_bytes(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint for a small table whose measured bytes, 24 a value beside its text form, are within the limit; else Spark shuffles it."""
    size = F.octet_length(F.to_json(F.struct("*"))) + 24 * len(df.columns)
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= limit else df
