"""The expanding walk-forward against one least-squares fit per fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import expanding

X = ["x", "x2", "flat"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    made = []
    for k in range(200):
        x, x2 = (float(v) for v in rng.normal(size=2))
        y = 0.5 * x - 0.2 * x2 + 0.1 * float(rng.normal()) + 3
        made.append((200100 + k // 25, k, None if k % 20 == 3 else x, x2, 1.5, None if k % 10 == 7 else float("nan") if k % 50 == 9 else y))
    made.append((None, 999, 0.0, 0.0, 1.5, 0.0))
    return spark.createDataFrame(made, "month int, id int, x double, x2 double, flat double, y double").cache()


def test_each_fold_is_the_fit_of_all_earlier_months(rows):
    got = {r["id"]: r for r in expanding.walk_forward(rows, "month", X, "y", 2, ridge=0.0).collect()}
    data = [r for r in rows.collect() if r["month"] is not None]
    assert set(got) == {r["id"] for r in data if r["month"] >= 200102}
    for month in range(200102, 200108):
        fit = [r for r in data if r["month"] < month and r["x"] is not None and r["y"] is not None and not np.isnan(r["y"])]
        w = np.linalg.lstsq(np.array([[1, r["x"], r["x2"]] for r in fit]), np.array([r["y"] for r in fit]), rcond=None)[0]
        for r in (r for r in data if r["month"] == month):
            g = got[r["id"]]
            assert (g["train_start"], g["train_end"], g["fitted"]) == (200100, month - 1, len(fit))
            assert g["pred"] is None if r["x"] is None else g["pred"] == pytest.approx(w @ [1, r["x"], r["x2"]], rel=1e-8)


def test_later_labels_change_no_earlier_fold(rows):
    pred = lambda df: {r["id"]: r["pred"] for r in expanding.walk_forward(df, "month", X, "y", 3).collect()}
    first, turned = pred(rows), pred(rows.withColumn("y", F.when(F.col("month") >= 200106, -F.col("y")).otherwise(F.col("y"))))
    month = {r["id"]: r["month"] for r in rows.collect()}
    assert all(turned[i] == first[i] for i in first if month[i] <= 200106)
    assert any(turned[i] != first[i] for i in first if month[i] == 200107 and first[i] is not None)


def test_folds_without_rows_and_empty_tables(rows):
    none = rows.withColumn("y", F.lit(None).cast("double"))
    got = expanding.walk_forward(none, "month", X, "y", 2).collect()
    assert len(got) == 150 and all(r["pred"] is None and r["fitted"] == 0 for r in got)
    assert expanding.walk_forward(rows.limit(0), "month", X, "y", 2).count() == 0
    assert expanding.walk_forward(rows, "month", X, "y", 99).count() == 0


def test_rows_are_read_once_whatever_the_number_of_folds(rows):
    """Sums of parts add up, so a month that comes later needs no earlier row."""
    whole = {r["month"]: r.asDict() for r in expanding.product_sums(rows.where("month is not null"), "month", X, "y").collect()}
    parts = expanding.product_sums(rows.where("id % 2 = 0"), "month", X, "y").unionByName(expanding.product_sums(rows.where("id % 2 = 1"), "month", X, "y"))
    merged = parts.where("month is not null").groupBy("month").agg(*[F.sum(c).alias(c) for c in parts.columns if c != "month"])
    for r in merged.collect():
        assert all(r[c] == pytest.approx(whole[r["month"]][c]) for c in parts.columns)
