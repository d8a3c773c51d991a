"""Tables by day in a folder that driver and executors share: caches, prebuilds, backfills, artifacts."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; only a local session may leave it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="barloom-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """``df`` written once and read back: later plans start from it instead of computing it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/barloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_RECORD = "date int, rows long, columns array<string>, made_by string, version string, seq long"


class DayStore:
    """A table with one partition per date and a manifest of the days that are complete.

    Every write goes to a folder of its own, its version; only when all of it is there, a
    record of each day (rows, columns, what it was made by, version) is added to the
    manifest.  A day is what its latest record says, and is a hit if that was made by the
    same ``made_by`` (such as the hash of a factor set) with all columns asked for.  What a
    killed write leaves has no record and is never read.  Data are not looked at to find hits.
    One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, made_by: str = ""):
        self.spark, self.path, self.made_by = spark, path or f"{shared_dir(spark)}/days-{uuid.uuid4().hex}", made_by

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _there(self, name: str) -> bool:
        path, store = self._folder(name)
        return store.exists(path)

    def manifest(self) -> DataFrame:
        """The latest record of each day."""
        if not self._there("manifest"):
            return self.spark.createDataFrame([], _RECORD)
        records = self.spark.read.schema(_RECORD).parquet(f"{self.path}/manifest")
        last = F.max_by(F.struct(*[F.col(c) for c in records.columns if c != "date"]), "seq").alias("r")
        return records.groupBy("date").agg(last).select("date", "r.*")

    def write(self, rows: DataFrame, dates: DataFrame | None = None, beside=None) -> str:
        """Adds days, or replaces those that are there; other days stay.  Returns the version.

        ``dates`` names days that are complete even if they have no row; ``beside`` is
        called with the version before the days are published.
        """
        version, columns = uuid.uuid4().hex, [c for c in rows.columns if c != "date"]
        target = f"{self.path}/data/version={version}"
        rows.repartition("date").write.option("compression", "zstd").partitionBy("date").parquet(target)
        stored = self.spark.read.schema(rows.select(*columns, "date").schema).parquet(target)
        counts = stored.groupBy("date").agg(F.count(F.lit(1)).alias("rows"))
        if dates is not None:
            counts = dates.select("date").distinct().join(counts, "date", "left").select("date", F.coalesce("rows", F.lit(0)).alias("rows"))
        if beside is not None:
            beside(version)
        record = counts.select(F.col("date").cast("int"), "rows", F.array(*[F.lit(c) for c in sorted(columns)]).alias("columns"), F.lit(self.made_by).alias("made_by"), F.lit(version).alias("version"), F.lit(time.time_ns()).alias("seq"))
        record.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")  # one row per day, published by one rename
        return version

    def current(self, columns: list[str] | None = None) -> DataFrame:
        """Records of the days made by this store's ``made_by``; with ``columns``, of those that have them all."""
        found = self.manifest().where(F.col("made_by") == self.made_by)
        wanted = [c for c in columns or [] if c != "date"]
        return found.where(F.size(F.array_except(F.array(*[F.lit(c) for c in wanted]), "columns")) == 0) if wanted else found

    def read(self, like: DataFrame) -> DataFrame:
        """The days of this ``made_by``, with the columns of ``like``; a column that a day lacks is NULL."""
        if not self._there("data"):
            return like.limit(0)
        schema = like.select(*[c for c in like.columns if c != "date"], "date").schema.add("version", "string")
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/data")
        return rows.join(self.current().select("date", "version"), ["date", "version"], "left_semi").select(*like.columns)  # folders of other versions are pruned by the join

    def missing(self, calendar: DataFrame) -> DataFrame:
        """Dates of ``calendar`` that are not stored by this ``made_by``, with whatever columns."""
        return calendar.select("date").distinct().join(self.current().select("date"), "date", "left_anti")

    def lacking(self, columns: list[str]) -> DataFrame:
        """Stored dates that lack one of the columns."""
        return self.current().select("date").join(self.current(columns).select("date"), "date", "left_anti")

    def prebuild(self, source: DataFrame) -> DataFrame:
        """Builds all missing days in one job; returns each date and whether it was there (a hit)."""
        dates = written(source.select("date").distinct())
        missing = written(self.missing(dates))
        if not missing.isEmpty():
            self.write(source.join(missing, "date", "left_semi"), missing)
        return dates.join(missing.withColumn("new", F.lit(True)), "date", "left").select("date", F.col("new").isNull().alias("hit"))

    def backfill(self, like: DataFrame, column: str, base: DataFrame, keys: list[str]) -> DataFrame:
        """Adds ``column``, looked up in ``base`` by ``keys`` (date among them), to the days that lack it, and only to these; returns their dates."""
        days = written(self.lacking([column]))
        if not days.isEmpty():
            old = self.read(like.drop(column)).join(days, "date", "left_semi")
            values = base.join(days, "date", "left_semi").select(*keys, column)
            self.write(old.join(values, keys, "left").select(*like.columns), days)
        return days

    def vacuum(self) -> int:
        """Deletes the folders that no current record names: replaced days' versions and what killed writes left.  Returns how many."""
        named = {r["version"] for r in self.manifest().select("version").distinct().collect()}  # one per write
        path, store = self._folder("data")
        folders = [x.getPath() for x in store.listStatus(path)] if store.exists(path) else []
        dead = [f for f in folders if f.getName().removeprefix("version=") not in named]
        for f in dead:
            store.delete(f, True)
        return len(dead)


class RunStore:
    """Result tables of many runs; of several runs of one kind the latest counts."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"

    def add(self, rows: DataFrame, run: str) -> None:
        """Appends a run's rows, stamped with its name and the time."""
        rows.withColumns({"run": F.lit(run), "made_at": F.lit(time.time_ns())}).write.mode("append").parquet(self.path)

    def latest(self, kind: list[str]) -> DataFrame:
        """The rows of the latest run of each kind, a set of key columns; ties go to the later name."""
        rows = self.spark.read.parquet(self.path)
        last = rows.groupBy(*kind).agg(F.max(F.struct("made_at", "run")).alias("last_"))
        return rows.join(last, kind).where(F.struct("made_at", "run") == F.col("last_")).drop("last_", "made_at")


def long_metrics(metrics: DataFrame, section: str, keys: list[str], values: list[str]) -> DataFrame:
    """A metrics table as (section, keys..., metric, value)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])).alias("m")
    return metrics.select(F.lit(section).alias("section"), *keys, pairs).select("section", *keys, "m.metric", "m.value")
