"""Selection by rank, percentiles, bounded samples, and curves worked on in ranges."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import backtest, metrics
from barloom.operators.selection import medians, nth, percentiles, row_hash, smallest


def test_keys_at_ranks(spark):
    rng = np.random.default_rng(3)
    keys = {g: [int(x) for x in [*rng.integers(-(2**63), 2**63 - 1, 200), *rng.integers(-3, 3, 200), 2**63 - 1, -(2**63), 0, -1]] for g in "ab"}
    rows = spark.createDataFrame([(g, k, 1) for g in keys for k in keys[g]], "g string, k long, rank int").select("g", "k")
    wanted = spark.createDataFrame([(g, n, "x") for g in keys for n in (0, 1, 57, 200, 201, 403, 404)], "g string, rank long, note string")
    got = {(r["g"], r["rank"]): r["key_"] for r in nth(rows, ["g"], "k", wanted).collect()}
    assert got == {(g, n): sorted(keys[g])[n] for g in keys for n in (0, 1, 57, 200, 201, 403)}


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(5)
    values = {1: [*rng.normal(size=301), 1e300, -1e300, 5e-324], 2: [0.0, -0.0, 1.0, 1.0], 3: [-7.5], 4: list(np.repeat([1.0, 2.0], [700, 300]))}
    rows = spark.createDataFrame([(g, float(v)) for g in values for v in values[g]] + [(1, None), (5, None)], "g int, v double")
    shares = {"low": 0.05, "mid": 0.5, "high": 0.95, "last": 1.0}
    got = {r["g"]: [r[n] for n in shares] for r in percentiles(rows, ["g"], "v", shares).collect()}
    assert got.keys() == values.keys()
    for g, v in values.items():
        assert np.allclose(got[g], [np.quantile(v, q) for q in shares.values()], rtol=1e-12, atol=0)
    one = medians(rows.withColumn("w", -F.col("v")), ["v", "w"]).collect()
    every = [x for v in values.values() for x in v]
    assert len(one) == 1 and one[0]["m_v"] == pytest.approx(np.median(every)) == pytest.approx(-one[0]["m_w"])
    assert medians(rows.where("false"), ["v"]).collect()[0]["m_v"] is None


def test_sample_is_the_same_for_every_partitioning(spark):
    rows = spark.range(3000).select((F.col("id") % 9).alias("date"), (F.col("id") % 7).alias("instrument"), (F.col("id") % 50).alias("minute_index"), "id")  # many rows share a hash
    key, ties = row_hash("date", "instrument", "minute_index"), ["id"]
    plain = [r["id"] for r in rows.orderBy(key, "id").limit(700).collect()]
    for dealt in (rows, rows.repartition(13), rows.repartition("instrument").sort(F.desc("id"))):
        assert sorted(r["id"] for r in smallest(dealt, 700, key, ties).collect()) == sorted(plain)
    halves = [smallest(rows.where(F.col("id") % 2 == k), 700, key, ties) for k in (0, 1)]
    assert sorted(r["id"] for r in smallest(halves[0].union(halves[1]), 700, key, ties).collect()) == sorted(plain)
    assert smallest(rows, 5000, key, ties).count() == 3000 and smallest(rows.where("false"), 5, key, ties).count() == 0
    big = smallest(rows, 700, key, ties)
    assert big.columns == rows.columns


def test_ranks_of_a_value_that_most_rows_have(spark):
    x = [0.0] * 900 + [float(k) for k in range(-30, 30)]
    rows = spark.createDataFrame([(v,) for v in x], "v double").repartition(5)
    got = {(r["v"], r["r"]) for r in metrics.global_rank(rows, "v", "r").collect()}
    assert got == {(v, (np.array(x) < v).sum() + ((np.array(x) == v).sum() + 1) / 2) for v in x}


def test_curves_look_at_rows_within_ranges_only(spark):
    """Windows over a whole model see one row for each range."""
    done = spark.createDataFrame([("m", 20200101 + k // 40, k, 0.01 * (-1) ** k if k != 70 else -1.0) for k in range(1, 100, 3)], "model_name string, date int, exit_datetime int, strategy_ret double")
    prices = spark.createDataFrame([(k, 100.0 + k % 7) for k in range(120)], "datetime int, close double")
    curve = backtest.equity_curve(done, prices)
    plan = curve._jdf.queryExecution().executedPlan().toString()
    alone = re.findall(r"Window \[.*?\], \[model_name#\d+\], \[(\w+)#", plan)
    within = re.findall(r"Window \[.*?\], \[model_name#\d+, part_#\d+\], \[(\w+)#", plan)
    assert alone and set(alone) == {"part_"} and within and set(within) == {"datetime"}
    returns, equity, top = {r["exit_datetime"]: r["strategy_ret"] for r in done.collect()}, 1.0, 1.0
    for r in curve.orderBy("datetime").collect():
        equity *= 1 + returns.get(r["datetime"], 0.0)
        top = max(top, equity)
        assert (r["equity"], r["drawdown"], r["benchmark"]) == (pytest.approx(equity), pytest.approx(equity / top - 1), pytest.approx((100 + r["datetime"] % 7) / 100))
    assert equity == 0.0
