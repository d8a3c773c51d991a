"""Boosted trees on panel features: validation split, out-of-fold baskets, walk-forward, two stages.

Spark ML trains the trees; the driver only loops over folds.  Rows are whole panels, or a
sample of bounded size where a fit says so.  Trees cannot take missing values, so features are standardised on the training
rows and missing ones become 0, the mean.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators import basket, metrics
from barloom.operators.selection import row_hash, smallest
from barloom.plans.sql import SPLIT, bars_sql, grid_sql
from barloom.sources import bars as src
from barloom.sources.store import written

#: Two learners: shallow trees, and deeper ones with slower steps and larger leaves.
SHALLOW = {"maxDepth": 2, "stepSize": 0.03, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
DEEP = {"maxDepth": 5, "stepSize": 0.02, "subsamplingRate": 0.8, "minInstancesPerNode": 80}
#: Most trees of a query's fits.  Every tree is a Spark job, so the thousands that a local library grows in seconds would take hours; README says so.
ROUNDS = 25

#: Most rows that the shallow trees learn from, those with the least hashes.
SAMPLE_ROWS = 2_000_000

FEATURES = ["ret_1", "ret_5", "range_", "vol_ratio", "place"]


def panel_features(bars: DataFrame, horizon: int) -> DataFrame:
    """Bars with a few factors, the forward label and the split."""
    w = Window.partitionBy("instrument").orderBy("datetime")
    lagged = lambda c, n: F.nullif(F.lag(c, n).over(w), F.lit(0.0))
    return src.forward_label(bars, horizon).withColumns({
        "ret_1": F.col("close") / lagged("close", 1) - 1, "ret_5": F.col("close") / lagged("close", 5) - 1, "range_": F.col("high") / F.nullif(F.col("low"), F.lit(0.0)) - 1,
        "vol_ratio": F.col("vol") / F.nullif(F.avg("vol").over(w.rowsBetween(-4, 0)), F.lit(0.0)), "place": F.percent_rank().over(Window.partitionBy("datetime").orderBy("vol")), "split": src.split_of(F.col("date")),
    })


class Bundle:
    """Standardisation and trees fitted on labelled rows; the latest date is the validation set, at which growth stops."""

    def __init__(self, rows: DataFrame, label: str = "label", learner: dict = SHALLOW, rounds: int = ROUNDS):
        rows = rows.where(F.col(label).isNotNull())
        stats = rows.agg(*[f(c).alias(f"{n}_{c}") for c in [*FEATURES, label] for n, f in (("m", F.avg), ("s", F.stddev_pop))], F.max("date").alias("last")).first()
        self.label, self.stats = label, stats
        ready = self._vector(rows).withColumn("y", self._z(label)).withColumn("validation", F.col("date") == stats["last"])
        trees = GBTRegressor(featuresCol="features", labelCol="y", predictionCol="z", maxIter=rounds, validationIndicatorCol="validation", validationTol=0.0, seed=7, **learner)
        self.model = trees.fit(ready)

    def _z(self, c: str):
        s = self.stats[f"s_{c}"]
        return F.lit(0.0) if not s else F.coalesce((F.col(c) - self.stats[f"m_{c}"]) / s, F.lit(0.0))

    def _vector(self, rows: DataFrame) -> DataFrame:
        named = rows.select("*", *[self._z(c).alias(f"z_{c}") for c in FEATURES])
        return VectorAssembler(inputCols=[f"z_{c}" for c in FEATURES], outputCol="features").transform(named)

    def predict(self, rows: DataFrame) -> DataFrame:
        """Rows with pred on the label's scale."""
        out = self.model.transform(self._vector(rows))
        return out.select(*rows.columns, (F.col("z") * (self.stats[f"s_{self.label}"] or 0.0) + self.stats[f"m_{self.label}"]).alias("pred"))

    def importance(self) -> list[tuple[str, float]]:
        return sorted(zip(FEATURES, (float(x) for x in self.model.featureImportances.toArray())), key=lambda x: (-x[1], x[0]))


def _rows(spark, sf) -> DataFrame:
    return written(panel_features(src.monthly_bars(spark, sf), 1))  # every fold starts from these


def _split_metrics(preds: DataFrame) -> DataFrame:
    return metrics.finalised(metrics.sufficient(preds, ["split"])).select("split", "n", "ic", "rmse", "mae", "direction_acc")


def gbt_bundle(spark, sf) -> DataFrame:
    """Metrics by split of shallow trees fitted on a bounded sample of the labelled rows of the train split."""
    rows = _rows(spark, sf)
    keys = ("date", "instrument", "minute_index")
    sample = smallest(rows.where("split = 'train' and label is not null"), SAMPLE_ROWS, row_hash(*keys), list(keys))
    return _split_metrics(Bundle(sample).predict(rows))


def gbt_deep(spark, sf) -> DataFrame:
    """Metrics by split of the second learner."""
    rows = _rows(spark, sf)
    return _split_metrics(Bundle(rows.where("split = 'train'"), learner=DEEP).predict(rows))


def feature_importance(spark, sf) -> DataFrame:
    """The features by their importance in the shallow trees."""
    found = Bundle(_rows(spark, sf).where("split = 'train'")).importance()
    return spark.createDataFrame([(k + 1, n, x) for k, (n, x) in enumerate(found)], "place int, feature string, importance double")


def _folds(rows: DataFrame) -> list[int]:
    return [r["date"] for r in rows.select("date").distinct().orderBy("date").collect()]  # the calendar of years


def out_of_fold(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Each year predicted by trees fitted on all earlier years; two are needed, one of them to validate."""
    parts, years = [], _folds(rows)
    for year in years[2:]:
        parts.append(Bundle(rows.where(F.col("date") < year), rounds=rounds).predict(rows.where(F.col("date") == year)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fold_table(spark, sf) -> DataFrame:
    """What each fold learns from, validates on and predicts."""
    rows = _rows(spark, sf)
    per = rows.groupBy("date").agg(F.count("label").alias("labelled"), F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("date")  # one row per year
    per = per.withColumns({"place": F.row_number().over(w), "earlier": F.sum("labelled").over(w.rowsBetween(Window.unboundedPreceding, -1)), "validated": F.lag("labelled").over(w)})
    return per.where("place > 2").select(F.col("date").alias("fold"), (F.col("earlier") - F.col("validated")).alias("fitted"), "validated", F.col("n").alias("predicted"))


def oof_basket(spark, sf) -> DataFrame:
    """Out-of-fold predictions as a basket weighted by amount."""
    preds = out_of_fold(_rows(spark, sf)).withColumn("weight", F.col("amount"))
    return basket.aggregate_basket(preds, ["date", "datetime"]).select("date", F.col("datetime").cast("date").cast("string").alias("day"), "basket_pred", "basket_label", "weight_coverage_pred")


def oof_coverage(spark, sf) -> DataFrame:
    """Which times the out-of-fold baskets cover, with the realised side of each."""
    from barloom.plans.evaluation import grid

    found = oof_basket(spark, sf)
    return found.select("date", "day", grid("basket_label").alias("basket_label"), grid("weight_coverage_pred").alias("covered"))


def _fold_metrics(spark, sf) -> DataFrame:
    return metrics.daily_metrics(out_of_fold(_rows(spark, sf)), ["date"]).select("date", "n", "ic", "rank_ic", "rmse")


def walk_forward(spark, sf) -> DataFrame:
    """IC and rank IC of each fold."""
    return _fold_metrics(spark, sf)


def walk_forward_summary(spark, sf) -> DataFrame:
    """Folds, folds with a negative IC, and the least, median and largest IC."""
    return _fold_metrics(spark, sf).agg(F.count(F.lit(1)).alias("folds"), F.sum((F.col("ic") < 0).cast("long")).alias("negative"), F.min("ic").alias("least"), F.median("ic").alias("median"), F.max("ic").alias("largest"))


def two_stage(spark, sf) -> DataFrame:
    """A second model on what the first leaves: final prediction is the sum of both."""
    rows = _rows(spark, sf)
    first = Bundle(rows.where("split = 'train'")).predict(rows).withColumn("residual", F.col("label") - F.col("pred")).withColumnRenamed("pred", "first_pred")
    second = Bundle(first.where("split = 'train'"), label="residual", learner=DEEP).predict(first).withColumn("pred", F.col("first_pred") + F.col("pred"))
    return _split_metrics(second)


QUERIES = {
    "gbt_bundle": gbt_bundle, "gbt_deep": gbt_deep, "feature_importance": feature_importance, "fold_table": fold_table, "oof_basket": oof_basket, "oof_coverage": oof_coverage,
    "walk_forward": walk_forward, "walk_forward_summary": walk_forward_summary, "two_stage": two_stage,
}
_LABELS = f"{bars_sql('month')}, l AS (SELECT *, lead(close) OVER (PARTITION BY date, instrument ORDER BY datetime) / nullif(close, 0) - 1 AS label, {SPLIT} AS split FROM bars)"
#: What does not depend on the trees.
ORACLES = {
    "fold_table": f"WITH {_LABELS}, p AS (SELECT date, count(label) AS labelled, count(*) AS n, row_number() OVER (ORDER BY date) AS place FROM l GROUP BY 1) SELECT a.date AS fold, CAST((SELECT sum(labelled) FROM p b WHERE b.place < a.place - 1) AS BIGINT) AS fitted, (SELECT labelled FROM p b WHERE b.place = a.place - 1) AS validated, n AS predicted FROM p a WHERE place > 2",
    "oof_coverage": f"WITH {_LABELS} SELECT date, CAST(CAST(datetime AS DATE) AS VARCHAR) AS day, {grid_sql('sum(amount * label) / sum(amount)')} AS basket_label, 1.0::DOUBLE AS covered FROM l WHERE date > (SELECT min(date) FROM l WHERE date > (SELECT min(date) FROM l)) GROUP BY date, datetime",
}
