"""Run, comparison, score, content, review and search tables as partitioned files.

A store is a folder every executor can reach. Large facts are Parquet partitioned by their
id, so a filter on the id prunes folders; manifests and the run index are JSON lines.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.session import ensure_checkpoint_dir

# File extensions per media type and the largest accepted file.
MEDIA_TYPES = {
    "video": ("mp4", "mov", "avi", "mkv", "webm"), "audio": ("wav", "mp3", "flac", "ogg"), "text": ("txt", "md"),
    "table": ("parquet",),
}
MAX_FILE_BYTES = 4_000_000_000
RECORD_BYTES = 100_000_000  # larger files are hashed in pieces
PIECE_BYTES = 1 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """New folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    # Facts ---------------------------------------------------------------------------
    def write(self, name: str, df: DataFrame, by: Sequence[str] = (), mode: str = "append") -> None:
        """Rows of one partition value are spread over several files by their hash."""
        writer = df.write.mode(mode)
        (writer.partitionBy(*by) if by else writer).parquet(self.path(name))

    def read(self, name: str, schema: str | None = None, **equals: object) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        df = reader.parquet(self.path(name))
        for column, value in equals.items():
            df = df.where(F.col(column) == F.lit(value))
        return df

    def write_once(self, name: str, df: DataFrame, key: str, value: str) -> None:
        """Immutable sink: a second write of the same id fails."""
        df.write.mode("errorifexists").parquet(f"{self.path(name)}/{key}={value}")

    # Runs ----------------------------------------------------------------------------
    def write_panel(self, panel: DataFrame) -> None:
        self.write("panel", panel, ["run_id"])

    def load_runs(self, run_ids: Sequence[str]) -> DataFrame:
        return self.read("panel", schemas.PANEL).where(F.col("run_id").isin(list(run_ids)))

    def write_manifests(self, manifests: DataFrame) -> None:
        manifests.write.mode("append").json(self.path("manifests"))

    def manifests(self) -> DataFrame:
        return self.spark.read.schema(schemas.MANIFEST).json(self.path("manifests"))

    def append_index(self, entries: DataFrame) -> None:
        entries.write.mode("append").json(self.path("index"))

    def index(self) -> DataFrame:
        return self.spark.read.schema(schemas.RUN_INDEX).json(self.path("index"))

    def latest_by_cache_key(self) -> DataFrame:
        """Latest completed run of every cache key."""
        done = self.index().where("status <> 'failed'")
        return done.groupBy("cache_key").agg(F.max_by("run_id", "seq").alias("run_id"))

    def list_runs(self, limit: int) -> DataFrame:
        return self.index().orderBy(F.col("seq").desc()).limit(limit)

    # Decisions -----------------------------------------------------------------------
    def reviews(self) -> DataFrame:
        """Latest decision per recommendation, whatever was rewritten since."""
        return self.read("reviews").groupBy("recommendation_id").agg(
            F.max_by(F.struct("state", "seq"), "seq").alias("r")
        ).select("recommendation_id", "r.*")

    def latest_model(self) -> DataFrame:
        """Newest surrogate version of each search."""
        return self.read("models").groupBy("search_id").agg(F.max_by(F.struct("version", "mae"), "version").alias("m")).select(
            "search_id", "m.*"
        )


def _streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of files below file: paths (unescaped, as Spark lists them), read in pieces."""
    for pdf in batches:
        found = []
        for path in pdf["path"]:
            digest = hashlib.sha256()
            with open("/" + path.removeprefix("file:").lstrip("/"), "rb") as f:
                while piece := f.read(PIECE_BYTES):
                    digest.update(piece)
            found.append(digest.hexdigest())
        yield pdf[["path"]].assign(sha256=found)


def _digest_by_hadoop(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file in a store that only Hadoop's file systems reach, streamed by the driver's JVM."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    digest = jvm.java.security.MessageDigest.getInstance("SHA-256")
    sink = jvm.java.security.DigestOutputStream(jvm.java.io.OutputStream.nullOutputStream(), digest)
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(where.getFileSystem(conf).open(where), sink, PIECE_BYTES, True)
    return bytes(digest.digest()).hex()


def scan_files(
    spark: SparkSession, pattern: str, max_bytes: int = MAX_FILE_BYTES, max_hashed: int | None = None, record_bytes: int = RECORD_BYTES,
) -> DataFrame:
    """Content files with media type, size verdict and SHA-256.

    Every file of at most ``max_bytes`` is hashed, unless the caller sets a lower ``max_hashed``;
    accepted files above that have the verdict ``not hashed``. Files of up to ``record_bytes`` are
    read as one record, with the length filter pushed into the source. Larger ones are streamed in
    pieces: below file: paths one task a file, in other stores by the driver, eight at a time,
    since Python tasks cannot open them.
    """
    max_hashed = max_bytes if max_hashed is None else max_hashed
    files = spark.read.format("binaryFile").load(pattern)
    listed = files.select("path", "length")
    hashed = files.where(F.col("length") <= min(record_bytes, max_hashed)).select("path", F.sha2("content", 256).alias("sha256"))
    large = [r["path"] for r in listed.where((F.col("length") > record_bytes) & (F.col("length") <= min(max_bytes, max_hashed))).collect()]
    local = [(p,) for p in large if p.startswith("file:")]
    other = [p for p in large if not p.startswith("file:")]
    if local:
        paths = spark.sparkContext.parallelize(local, len(local)).toDF("path string")
        hashed = hashed.unionByName(paths.mapInPandas(_streamed, "path string, sha256 string"))
    if other:
        with ThreadPoolExecutor(8) as pool:
            digests = list(pool.map(lambda p: _digest_by_hadoop(spark, p), other))
        hashed = hashed.unionByName(spark.createDataFrame(list(zip(other, digests, strict=True)), "path string, sha256 string"))
    ext = F.lower(F.element_at(F.split("path", r"\."), -1))
    media = F.coalesce(*[F.when(ext.isin(list(x)), F.lit(name)) for name, x in MEDIA_TYPES.items()])
    verdict = (
        F.when(media.isNull(), "unsupported extension").when(F.col("length") == 0, "empty")
        .when(F.col("length") > max_bytes, "too large").when(F.col("length") > max_hashed, "not hashed").otherwise("ok")
    )
    return listed.join(hashed, "path", "left").select(
        F.element_at(F.split("path", "/"), -1).alias("file"), media.alias("media_type"), "length", verdict.alias("verdict"), "sha256"
    )


def region_dimension(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unit map, regions) with dense region ids by hemisphere and label; excluded units have none.

    ``units`` is ``unit_id, hemisphere, label, excluded``. Ids are ranked over the distinct
    labels only, a dimension.
    """
    from pyspark.sql import Window

    live = units.where(~F.col("excluded"))
    labels = live.groupBy("hemisphere", "label").agg(F.count(F.lit(1)).alias("unit_count"))
    regions = labels.withColumn("region_id", F.dense_rank().over(Window.orderBy("hemisphere", "label")) - 1)
    ids = regions.select("hemisphere", "label", "region_id")
    mapped = units.join(ids, ["hemisphere", "label"], "left").withColumn(
        "region_id", F.when(~F.col("excluded"), F.col("region_id"))
    )
    return mapped, regions


def map_report(mapped: DataFrame, regions: DataFrame) -> DataFrame:
    """Problems of a unit map against its declared regions, one row each.

    ``regions`` declares ``region_id, hemisphere, unit_count``.
    """
    known = mapped.join(regions.select("region_id", F.lit(True).alias("_known")), "region_id", "left")
    outside = known.where("region_id IS NOT NULL AND _known IS NULL").select(
        F.lit("out_of_range").alias("problem"), F.col("unit_id").cast("bigint").alias("id")
    )
    walls = mapped.where("excluded AND region_id IS NOT NULL").select(F.lit("excluded_but_mapped").alias("problem"), F.col("unit_id").cast("bigint").alias("id"))
    bare = mapped.where("NOT excluded AND region_id IS NULL").select(F.lit("unmapped").alias("problem"), F.col("unit_id").cast("bigint").alias("id"))
    counts = mapped.where("region_id IS NOT NULL").groupBy("region_id").agg(
        F.count(F.lit(1)).alias("actual"), F.min("hemisphere").alias("_lo"), F.max("hemisphere").alias("_hi")
    )
    both = regions.join(counts, "region_id", "left")
    rid = F.col("region_id").cast("bigint").alias("id")
    empty = both.where("actual IS NULL").select(F.lit("empty_region").alias("problem"), rid)
    wrong = both.where("actual <> unit_count").select(F.lit("count_mismatch").alias("problem"), rid)
    crossing = both.where("_lo <> hemisphere OR _hi <> hemisphere").select(F.lit("crosses_hemisphere").alias("problem"), rid)
    return outside.unionByName(walls).unionByName(bare).unionByName(empty).unionByName(wrong).unionByName(crossing)
