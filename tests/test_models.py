"""Boosted-tree bundles on a planted signal."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.plans import models


@pytest.fixture(scope="module")
def rows(spark):
    """Four years; the label follows ret_1 with some noise, the other features are noise with holes."""
    rng = np.random.default_rng(0)
    made = []
    for date in (20010101, 20020101, 20030101, 20040101):
        for i in range(150):
            x = [float(v) for v in rng.normal(size=5)]
            made.append((date, i, *[None if k and rng.random() < 0.1 else v for k, v in enumerate(x)], 0.01 * (2.0 if x[0] > 0.3 else -1.0) + 0.002 * float(rng.normal()) + 0.05))
    return spark.createDataFrame(made, "date int, i int, " + ", ".join(f"{f} double" for f in models.FEATURES) + ", label double").cache()


def predicted(df):
    return {(r["date"], r["i"]): r["pred"] for r in df.collect()}


def test_predictions_beat_the_mean_on_the_scale_of_the_label(rows):
    bundle = models.Bundle(rows.where("date < 20040101"), rounds=12, learner=models.SHALLOW | {"stepSize": 0.3})
    last = rows.where("date = 20040101")
    pred, y = predicted(bundle.predict(last)), {(r["date"], r["i"]): r["label"] for r in last.collect()}
    p, t = np.array([pred[k] for k in y]), np.array(list(y.values()))
    assert np.sqrt(np.mean((p - t) ** 2)) < 0.5 * t.std() and abs(p.mean() - t.mean()) < 0.003 and np.corrcoef(p, t)[0, 1] > 0.9
    assert bundle.importance()[0][0] == "ret_1" and sum(v for _, v in bundle.importance()) == pytest.approx(1)
    other = models.Bundle(rows.where("date < 20040101").withColumn("label", 1000 * F.col("label") + 7), rounds=12, learner=models.SHALLOW | {"stepSize": 0.3})
    scaled = predicted(other.predict(last))
    assert all(scaled[k] == pytest.approx(1000 * pred[k] + 7, rel=1e-6) for k in pred)


def test_growth_stops_where_the_latest_date_gets_worse(rows):
    turned = rows.withColumn("label", F.when(F.col("date") == 20040101, -F.col("label")).otherwise(F.col("label")))
    assert models.Bundle(turned, rounds=12, learner=models.SHALLOW | {"stepSize": 0.3}).model.getNumTrees < 12


def test_later_labels_change_no_earlier_prediction(rows):
    first = predicted(models.out_of_fold(rows, rounds=3))
    assert {d for d, _ in first} == {20030101, 20040101} and len(first) == 300
    later = rows.withColumn("label", F.when(F.col("date") == 20040101, 9 - F.col("label")).otherwise(F.col("label")))
    second = predicted(models.out_of_fold(later, rounds=3))
    assert first == second  # each year learns from the years before it alone
    earlier = rows.withColumn("label", F.when(F.col("date") == 20010101, 9 - F.col("label")).otherwise(F.col("label")))
    assert predicted(models.out_of_fold(earlier, rounds=3)) != first
