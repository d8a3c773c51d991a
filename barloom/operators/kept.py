"""Metrics that are kept up to date by day, without reading earlier rows again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import metrics
from barloom.sources.store import DayStore, written


class KeptSums:
    """Central sums of each group and day, and of each group over all days.

    ``put`` reads the rows of the days that it is given, their own earlier sums, and the
    totals.  A day that comes again is taken out of the totals before it is put in.  The
    sums of the days and the totals are published together (see ``DayStore``), so after a
    killed ``put`` both are as they were before.
    """

    def __init__(self, spark: SparkSession, by: list[str], path: str | None = None):
        self.spark, self.by, self.store = spark, by, DayStore(spark, path, made_by="sums by " + ", ".join(by))

    def put(self, rows: DataFrame) -> None:
        """Adds the days of ``rows`` (the columns ``by``, date, pred, label), or replaces them."""
        dates = written(rows.select("date").distinct())
        new = written(metrics.sufficient(rows, [*self.by, "date"]))
        old = self.store.read(new).join(dates, "date", "left_semi")
        changed = self.totals(new).unionByName(new.drop("date")).unionByName(metrics.negated(old).drop("date"))
        total = metrics.merge_sums(changed, self.by).where("n > 0")
        self.store.write(new, dates, beside=lambda version: total.write.option("compression", "zstd").parquet(self._path(version)))

    def _path(self, version: str) -> str:
        return f"{self.store.path}/totals/version={version}"

    def days(self) -> DataFrame:
        """Sums of each group and day."""
        return self.store.read(self.totals().withColumn("date", F.lit(0)))

    def _last(self) -> str | None:
        found = self.store.manifest().orderBy("seq", ascending=False).select("version").first()
        return found["version"] if found else None

    def totals(self, like: DataFrame | None = None) -> DataFrame:
        """Sums of each group over all days; empty, with the columns of ``like``, before anything was put."""
        last = self._last()
        if last is None and like is None:
            raise ValueError("nothing has been put")
        if last is None:
            return like.drop("date").limit(0)
        return self.spark.read.parquet(self._path(last))

    def rebuilt(self) -> DataFrame:
        """The totals merged anew from the days, which sheds what rounding many retractions have left."""
        return metrics.merge_sums(self.days().drop("date"), self.by)
