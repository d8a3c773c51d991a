"""Day stores with manifests, and sums kept by day."""

import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import metrics
from barloom.operators.kept import KeptSums
from barloom.sources.store import DayStore


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(20200101 + d, i, float(d * 10 + i), float(i)) for d in range(4) for i in range(5)], "date int, i int, x double, y double")


def dates(df):
    return sorted(r["date"] for r in df.collect())


def stored(store, like):
    return sorted(tuple(r) for r in store.read(like).collect())


def test_a_killed_write_is_no_hit_and_is_never_read(spark, rows, tmp_path):
    store = DayStore(spark, str(tmp_path))
    assert stored(store, rows) == [] and dates(store.missing(rows)) == [20200101 + d for d in range(4)]
    store.write(rows.where("date <= 20200102"))
    before = stored(store, rows)
    dying = rows.where("date >= 20200102").withColumn("x", F.when(F.col("date") == 20200104, F.raise_error("killed")).otherwise(-1.0).cast("double"))
    with pytest.raises(Exception, match="killed"):
        store.write(dying)
    half = tmp_path / "data" / "version=half" / "date=20200103"  # complete files, but no record
    shutil.copytree(next((tmp_path / "data").glob("version=*/date=20200101")), half)
    assert stored(store, rows) == before and dates(store.missing(rows)) == [20200103, 20200104]
    hits = {r["date"]: r["hit"] for r in store.prebuild(rows).collect()}
    assert hits == {20200101: True, 20200102: True, 20200103: False, 20200104: False}
    assert stored(store, rows) == sorted(tuple(r) for r in rows.collect())
    assert store.vacuum() >= 1 and not os.path.exists(half) and store.read(rows).count() == 20 and store.vacuum() == 0


def test_only_days_of_another_set_or_without_a_column_are_built(spark, rows, tmp_path):
    old = DayStore(spark, str(tmp_path), made_by="old")
    first = old.write(rows)
    store = DayStore(spark, str(tmp_path), made_by="new")
    assert stored(store, rows) == [] and dates(store.missing(rows)) == dates(rows.select("date").distinct())
    second = store.write(rows.where("date <= 20200103").drop("y"))
    third = store.write(rows.where("date = 20200102"))
    assert dates(store.lacking(["x", "y"])) == [20200101, 20200103] and dates(store.missing(rows)) == [20200104]
    assert sorted(r["y"] is None for r in store.read(rows).collect()) == [False] * 5 + [True] * 10
    assert dates(store.backfill(rows, "y", rows.withColumn("y", F.col("y") + 100), ["date", "i"])) == [20200101, 20200103]
    assert dates(store.backfill(rows, "y", rows, ["date", "i"])) == []
    versions = {r["date"]: r["version"] for r in store.manifest().collect()}
    assert versions[20200102] == third and versions[20200104] == first and versions[20200101] == versions[20200103] not in (first, second, third)
    assert {(r["date"], r["y"] >= 100) for r in store.read(rows).collect()} == {(20200101, True), (20200102, False), (20200103, True)}
    assert {r["rows"] for r in store.current().collect()} == {5}
    store.write(rows.limit(0), rows.where("date = 20200101"))  # complete, and empty
    assert store.read(rows).where("date = 20200101").count() == 0 and dates(store.missing(rows)) == [20200104]


def signals(spark, seed, day):
    rng = np.random.default_rng(seed)
    rows = [("ab"[k % 2], 20200100 + day, float(rng.normal(5)), None if k % 11 == 0 else float(rng.normal(5) + 1e3)) for k in range(60)]
    return spark.createDataFrame(rows, "model_name string, date int, pred double, label double")


def test_kept_sums_equal_a_full_pass_after_a_day_is_replaced(spark, tmp_path):
    kept = KeptSums(spark, ["model_name"], str(tmp_path))
    with pytest.raises(ValueError, match="nothing"):
        kept.totals()
    for seed, day in ((1, 1), (2, 2), (3, 3)):
        kept.put(signals(spark, seed, day))
    for folder in (tmp_path / "data").glob("version=*/date=2020010[13]"):
        shutil.move(folder, tmp_path / f"gone-{folder.parent.name}-{folder.name}")  # what is not read is not missed
    kept.put(signals(spark, 9, 2).unionByName(signals(spark, 4, 4)))
    for gone in tmp_path.glob("gone-*"):
        _, version, date = gone.name.split("-")
        shutil.move(gone, tmp_path / "data" / version / date)
    kept.put(signals(spark, 5, 5).withColumn("label", F.lit(None).cast("double")))
    whole = metrics.sufficient(signals(spark, 1, 1).union(signals(spark, 9, 2)).union(signals(spark, 3, 3)).union(signals(spark, 4, 4)), ["model_name"])
    want = {r["model_name"]: r for r in metrics.finalised(whole).collect()}
    for found in (kept.totals(), kept.rebuilt()):
        got = {r["model_name"]: r for r in metrics.finalised(found).collect()}
        assert got.keys() == want.keys()
        for m in want:
            assert all(got[m][c] == pytest.approx(want[m][c], rel=1e-9) for c in ("n", "ic", "rmse", "mae", "direction_acc", "ic_t"))
    assert dates(kept.days().select("date").distinct()) == [20200101, 20200102, 20200103, 20200104]
    before = sorted(map(str, kept.totals().collect()))
    with pytest.raises(Exception, match="killed"):
        kept.put(signals(spark, 7, 1).withColumn("pred", F.raise_error("killed").cast("double")))
    assert sorted(map(str, kept.totals().collect())) == before
    kept.put(signals(spark, 1, 4).withColumn("label", F.lit(None).cast("double")))  # a day that comes again without a row
    assert {r["n"] for r in kept.totals().collect()} == {r["n"] for r in metrics.sufficient(signals(spark, 1, 1).union(signals(spark, 9, 2)).union(signals(spark, 3, 3)), ["model_name"]).collect()}
