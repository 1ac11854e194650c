"""Shared helpers: scratch tables in the cluster's folder, row digests, components."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master without that setting (tests) gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        set_already = spark.sparkContext.getCheckpointDir()
        if set_already:
            return set_already
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


class Scratch:
    """Intermediate tables written as Parquet in the shared folder.

    A written table cuts the lineage and survives a lost executor. ``drop`` deletes what is no
    longer read; a table that the returned frame still reads is left for the folder's owner.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
        self.count = 0

    def store(self, df: DataFrame, compression: str = "zstd") -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("compression", compression).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def buckets(self, df: DataFrame, key: str) -> DataFrame:
        """A table bucketed by ``key``, its files beside the others: joins on it move only the other side."""
        self.count += 1
        name = f"{self.root.rsplit('/', 1)[1].replace('-', '_')}_{self.count}"
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.format("parquet").option("compression", "lz4").option("path", f"{self.root}/{self.count}").bucketBy(parts, key).saveAsTable(name)
        out = self.spark.table(name)
        out._scratch_path = f"{self.root}/{self.count}"
        out._scratch_table = name
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for table in tables:
            if hasattr(table, "_scratch_table"):
                self.spark.sql(f"DROP TABLE {table._scratch_table}")
            path = jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are written.

    It does so when the driver's JVM finds their plans unused; Python hands back the plans it has
    dropped within a second or two.
    """
    gc.collect()
    for _ in range(3):
        time.sleep(1.5)
        spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> F.Column:
    """True where crc32(doc_id as text) mod 5 is 0."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def components(edges: DataFrame, scratch: Scratch, src: str = "src", dst: str = "dst") -> DataFrame:
    """Smallest reachable id per linked id, as (id, component_id); ids without links are absent.

    Alternating large-star and small-star rounds: every round hangs the neighbours of an id on
    the smallest of them, so long chains shrink by a factor. A round is two aggregations and
    joins whose sizes follow the edges; a hub's edges are pre-aggregated, its join can be split.
    """

    def around(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v").distinct()
    e = scratch.store(e)
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(around(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
        low_min = around(low)
        small = low.join(low_min, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low_min.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        fresh = scratch.store(small)
        state = fresh.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        scratch.drop(e)
        e = fresh
        if tuple(state) == seen:
            break
        seen = tuple(state)
    found = e.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return found.union(e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
