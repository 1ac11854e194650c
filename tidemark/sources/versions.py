"""Tables that grow by whole parts: a part counts from the moment its commit is written.

The data of a part is written first, then one small commit file. A writer that dies in between
leaves data that no reader sees and that the next attempt replaces.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.base import Model
from pyspark.ml.util import MLReadable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Parts:
    """Tables of a folder written together, part by part, below ``root``."""

    COMMIT = "part string, seq long, facts map<string,string>"

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def commits(self) -> DataFrame:
        """One row for each committed part: part, seq, facts."""
        path = f"{self.root}/commits"
        if not self._exists(path):
            return self.spark.createDataFrame([], self.COMMIT)
        return self.spark.read.schema(self.COMMIT).option("recursiveFileLookup", "true").json(path)

    def stage(self, part: str, **tables: DataFrame) -> None:
        """Write a part's tables; nobody reads them yet, and an earlier attempt is replaced."""
        if self._exists(f"{self.root}/commits/{part}"):
            raise FileExistsError(f"part {part} is committed and does not change")
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{name}/part={part}")

    def commit(self, part: str, seq: int, **facts: str) -> None:
        """Make a staged part visible; a second commit of the same part fails."""
        one = self.spark.createDataFrame([(part, seq, {k: str(v) for k, v in facts.items()})], self.COMMIT)
        one.coalesce(1).write.mode("errorifexists").json(f"{self.root}/commits/{part}")

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        """Rows of all committed parts, with ``part``; the folders of others are not opened."""
        if not self._exists(f"{self.root}/{name}"):
            if schema is None:
                raise FileNotFoundError(f"no part of {name} is written")
            return self.spark.createDataFrame([], f"{schema}, part string")
        reader = self.spark.read.option("basePath", f"{self.root}/{name}")
        reader = reader.schema(f"{schema}, part string") if schema else reader
        rows = reader.parquet(f"{self.root}/{name}").withColumn("part", F.col("part").cast("string"))
        return rows.join(self.commits().select("part"), "part", "left_semi")

    def latest(self) -> dict | None:
        """The commit with the largest seq."""
        row = self.commits().orderBy(F.desc("seq"), F.desc("part")).first()
        return None if row is None else {"part": row["part"], "seq": row["seq"], **row["facts"]}


class SearchStore(Parts):
    """Generations of searches: evaluations, populations and states, visible only together."""

    TABLES = ("evaluations", "populations", "states")

    def write_generation(self, generation: int, evaluations: DataFrame, populations: DataFrame, states: DataFrame, commit: bool = True) -> None:
        """Append one generation of all searches in it; ``commit=False`` leaves it for a later ``commit``."""
        part = f"g{generation:06d}"
        self.stage(part, evaluations=evaluations, populations=populations, states=states)
        if commit:
            self.commit(part, generation)

    def write_generations(self, evaluations: DataFrame, populations: DataFrame, states: DataFrame) -> None:
        """Append finished generations as one part, visible together; the three tables carry ``generation``.

        However many generations there are, each table is one job and the commit one file.
        """
        first, last = states.agg(F.min("generation"), F.max("generation")).first()
        if first is None:
            return
        newest = self.latest()
        if newest is not None and newest["seq"] >= first:
            raise FileExistsError(f"generation {newest['seq']} is committed; {first} is not newer")
        part = f"g{first:06d}-g{last:06d}"
        self.stage(part, evaluations=evaluations, populations=populations, states=states)
        self.commit(part, last)

    def current_states(self) -> DataFrame:
        """Newest committed state of each search."""
        rows = self.read("states").drop("part")
        return rows.groupBy("search_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "search_id"]), "generation").alias("s")).select("search_id", "s.*")


class ModelStore(Parts):
    """Versions of a fitted model with the dataset and the round log it came from."""

    def save(self, version: int, model: Model, dataset: DataFrame, rounds: DataFrame, **facts: str) -> None:
        """Model first, then its tables, and the commit that points at them last."""
        part = f"v{version:06d}"
        self.stage(part, dataset=dataset, rounds=rounds)
        model.write().overwrite().save(f"{self.root}/models/{part}")
        self.commit(part, version, kind=f"{type(model).__module__}.{type(model).__name__}", **facts)

    def load(self, kind: type[MLReadable], version: int | None = None) -> Model:
        """The model of a version, by default the newest committed one."""
        found = self.latest() if version is None else {"part": f"v{version:06d}"}
        if found is None or not self._exists(f"{self.root}/commits/{found['part']}"):
            raise FileNotFoundError("no such committed model")
        return kind.load(f"{self.root}/models/{found['part']}")


class TimelineStore(Parts):
    """Intervals of runs in folders of (run group, level, time bucket), written once and read by window.

    An interval is filed under the bucket of its start. One longer than a bucket goes to a coarser
    level, whose buckets are ``STEP`` times as wide, so what overlaps a window starts at most one
    bucket before it (on the last level: at most the longest interval before it, which the commit
    tells). A window opens those folders and no others; ``groups`` spreads the runs, so that a
    few runs open few folders too.
    """

    STEP = 8

    def __init__(self, spark: SparkSession, root: str, width: float, levels: int = 4, groups: int = 1) -> None:
        super().__init__(spark, root)
        self.widths = [float(width) * self.STEP**i for i in range(levels)]
        self.groups = groups

    def _group(self, run: Column) -> Column:
        return F.pmod(F.xxhash64(run.cast("string")), F.lit(self.groups)).cast("int")

    def write(self, name: str, spans: DataFrame, start: str, end: str) -> None:
        """File ``spans`` (run_id, ...) and commit them; a name is written once."""
        length = F.col(end) - F.col(start)
        level = F.lit(len(self.widths) - 1)
        for i in range(len(self.widths) - 2, -1, -1):
            level = F.when(length <= self.widths[i], i).otherwise(level)
        size = F.element_at(F.array(*[F.lit(w) for w in self.widths]), F.col("level") + 1)
        filed = spans.withColumn("level", level.cast("int")).withColumn("bucket", F.floor(F.col(start) / size).cast("int"))
        filed = filed.withColumn("run_group", self._group(F.col("run_id")))
        if self._exists(f"{self.root}/commits/{name}"):
            raise FileExistsError(f"{name} is committed and does not change")
        path = f"{self.root}/{name}"
        folders = ["run_group", "level", "bucket"]
        filed.repartition(*folders, F.pmod(F.xxhash64("run_id"), F.lit(8))).write.mode("overwrite").partitionBy(*folders).parquet(path)
        schema = filed.schema.json()
        longest = self.spark.read.schema(filed.schema).parquet(path).agg(F.max(F.col(end) - F.col(start))).first()[0]
        self.commit(name, 0, start=start, end=end, longest=repr(float(longest or 0.0)), schema=schema)

    def _open(self, name: str) -> tuple[DataFrame, str, str, list[float]]:
        """Rows, names of the ends, and how far before a window each level can start."""
        row = self.commits().where(F.col("part") == name).first()
        if row is None:
            raise FileNotFoundError(f"{name} is not committed")
        facts = row["facts"]
        rows = self.spark.read.schema(StructType.fromJson(json.loads(facts["schema"]))).parquet(f"{self.root}/{name}")
        return rows, facts["start"], facts["end"], [*self.widths[:-1], float(facts["longest"])]

    def window(self, name: str, low: float, high: float, runs: Sequence[object] | None = None) -> DataFrame:
        """Spans that overlap (low, high), of these runs or of all."""
        rows, start, end, reach = self._open(name)
        folders = [
            (F.col("level") == i) & F.col("bucket").between(math.floor((low - back) / w), math.floor(high / w))
            for i, (w, back) in enumerate(zip(self.widths, reach, strict=True))
        ]
        rows = rows.where(reduce(lambda a, b: a | b, folders))
        if runs is not None:
            kind = rows.schema["run_id"].dataType
            groups = self.spark.range(1).select(*[self._group(F.lit(x).cast(kind)).alias(f"g{i}") for i, x in enumerate(runs)]).first()
            rows = rows.where(F.col("run_group").isin(sorted(set(groups))) & F.col("run_id").isin(list(runs)))
        return rows.where((F.col(start) < high) & (F.col(end) > low)).drop("run_group", "level", "bucket")

    def around(self, name: str, points: DataFrame, low: str, high: str, slack: float = 0.0) -> DataFrame:
        """Every row of ``points`` (run_id, low, high, ...) with each span that overlaps its window.

        A point goes to the few buckets of each level that can hold such a span, and a span lies in
        one of them, so no pair is found twice.
        """
        rows, start, end, reach = self._open(name)
        def places(level: int, w: float, back: float) -> Column:
            first, last = F.floor((F.col(low) - back) / w).cast("int"), F.floor(F.col(high) / w).cast("int")
            return F.transform(F.sequence(first, last), lambda b: F.struct(F.lit(level).alias("level"), b.alias("bucket")))

        per_level = [places(i, w, back) for i, (w, back) in enumerate(zip(self.widths, reach, strict=True))]
        asked = points.withColumn("_at", F.explode(F.concat(*per_level))).withColumn("run_group", self._group(F.col("run_id")))
        asked = asked.select(*points.columns, "run_group", "_at.level", "_at.bucket")
        both = asked.join(rows, ["run_id", "run_group", "level", "bucket"])
        return both.where((F.col(start) < F.col(high) - slack) & (F.col(end) > F.col(low) + slack)).drop("run_group", "level", "bucket")
