"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``.

A written table cuts lineage: any executor can read it again after another one is lost, and a
frame that two branches use is computed once. Tables go as soon as nothing reads them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

ROWS_PER_FILE = 250_000
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def own_names(*names: str) -> list[str]:
    """Column names that no other frame has."""
    tag = uuid.uuid4().hex
    return [f"{n}_{tag}" for n in names]


class Scratch:
    """A fresh folder of written tables below the session's shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Write ``df`` once and return a reader of the written rows. ``rows`` is about how many there can
        be, where the caller knows: a small table then makes few files, whatever the number of shuffle
        partitions, and a large one as many as its size asks for."""
        path = f"{self.path}/{name}"
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
        conf = self.spark.conf
        before = conf.get(_CLEAN, "false")
        conf.set(_CLEAN, "true")  # the written rows replace this frame's shuffle files
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            conf.set(_CLEAN, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def lookup(self, df: DataFrame, name: str, most: int = 1_000_000) -> DataFrame:
        """A written table of short fixed-width keys that another frame is joined with: broadcast up to
        ``most`` rows (16 MB), so that the other side, with its texts, is not shuffled; else the planner's
        choice."""
        table = self.table(df, name)
        return F.broadcast(table) if table.count() <= most else table

    def drop(self, *names: str) -> None:
        """Delete written tables that no later plan reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        jvm.System.gc()  # broadcasts and generated classes that no plan refers to go with the driver's garbage
