"""Long series in blocks: halos, carried totals, sliding statistics, against whole series."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import factor as f
from barloom.operators import blocks, sliding
from barloom.plans import factors
from barloom.plans.panel import compute

FIELDS = ["open", "high", "low", "close", "vol", "amount"]


@pytest.fixture(scope="module")
def long_panel(spark):
    """Three instruments, 90 bars, some values missing."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(3):
        px = 100 + np.cumsum(rng.normal(size=90))
        for t in range(90):
            gone = rng.random() < 0.02
            o, c, v = float(px[t]), float(px[t] + rng.normal()), float(rng.integers(1, 50))
            rows.append((i, t, None if gone else o, max(o, c) + 1, min(o, c) - 1, None if gone else c, v, v * c))
    df = spark.createDataFrame(rows, "instrument long, t int, open double, high double, low double, close double, vol double, amount double")
    return df.select("instrument", F.timestamp_seconds(F.col("t") * 60).cast("timestamp_ntz").alias("datetime"), *FIELDS, F.lit(1.0).alias("valid_"), F.col("t").alias("pos_"))


TERMS = {
    "nested": f.ts_sum(f.delta(f.ts_mean(f.close, 5), 3), 4), "slides": f.decay_linear(f.ts_rank(f.ts_argmax(f.close, 6), 5), 7), "both_ways": f.ts_rank(f.rank(f.ts_std(f.close, 9)) - f.rank(f.volume), 8),
    "from_start": f.ts_mean(f.vwap, 4) + f.delay(f.high_so_far, 2), "open_first": f.ts_sum(f.low_so_far - f.open0, 3), "product": f.ts_product(1 + f.returns, 14), **{n: factors.FACTORS[n] for n in ("alpha_001", "alpha_004", "alpha_032", "alpha_096")},
}


def rows_by_key(df):
    return {(r["instrument"], r["datetime"]): [r[n] for n in TERMS] for r in df.collect()}


@pytest.mark.parametrize("block", [7])
def test_blocks_change_no_value(long_panel, block):
    whole = rows_by_key(compute(long_panel.drop("pos_"), TERMS))
    cut = rows_by_key(compute(long_panel, TERMS, block=block))
    assert whole.keys() == cut.keys() and len(whole) == 270
    for k in whole:
        assert all((a is None and b is None) or abs(a - b) <= 1e-9 * max(1, abs(a)) for a, b in zip(whole[k], cut[k])), (k, whole[k], cut[k])
    assert sum(v is not None for k in whole for v in whole[k]) > 800


def test_one_long_history_is_many_partitions_of_block_and_halo(spark):
    bars = spark.range(20_000).select(F.lit(1).alias("instrument"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("datetime"), (F.col("id") % 97).cast("double").alias("close"), F.col("id").alias("pos_"))
    cut = blocks.with_halo(bars, 30, 1000)
    sizes = [r["count"] for r in cut.groupBy("block_").count().collect()]
    assert max(sizes) == 1030 and len(sizes) == 21 and cut.where("own_").count() == 20_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # 20,000 rows are little
    try:
        out = compute(bars, {"y": f.ts_mean(f.close, 31), "z": f.ts_rank(f.close, 20)}, block=1000).withColumn("task", F.spark_partition_id())
        assert out.select("task").distinct().count() == 8 and out.where("y is null").count() == 30 and out.where("z is null").count() == 19
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


STATS = {
    "product": np.prod, "argmax": lambda w: float(np.argmax(w)), "argmin": lambda w: float(np.argmin(w)), "rank": lambda w: ((w < w[-1]).sum() + ((w == w[-1]).sum() + 1) / 2) / len(w),
    "decay": lambda w: (w * np.arange(len(w), 0, -1)).sum() / (len(w) * (len(w) + 1) / 2),
}


@pytest.mark.parametrize("name", STATS)
def test_sliding_statistics_equal_their_definition(name):
    rng = np.random.default_rng(6)
    for n in (1, 2, 5, 64, 250):
        x = np.round(rng.normal(1, 0.1, 700), 2)
        x[rng.random(700) < 1 / 300] = math.nan
        start = np.repeat([0, 300, 310], [300, 10, 390])
        got, null = sliding.strict(name, np.nan_to_num(x), np.isnan(x), start, n)
        for t in range(700):
            w = x[max(0, t - n + 1) : t + 1]
            whole = t - n + 1 >= start[t] and not np.isnan(w).any()
            assert null[t] == (not whole) and (not whole or abs(got[t] - STATS[name](w)) < 1e-9)


def test_groups_across_batches_and_missing_groups(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(g, t, float((t * 7 + (g or 0)) % 11)) for g in (None, 1, 2) for t in range(40)]
        df = spark.createDataFrame(rows, "g int, t int, x double").repartition(2, "g")
        got = {(r["g"], r["t"]): r["y"] for r in sliding.sliding(df, ["g"], "t", [("y", "argmax", "x", 5)]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g in (None, 1, 2):
        xs = [float((t * 7 + (g or 0)) % 11) for t in range(40)]
        assert [got[g, t] for t in range(40)] == [None if t < 4 else float(np.argmax(xs[t - 4 : t + 1])) for t in range(40)]


def test_scan_and_positions_over_ranges(spark):
    rng = np.random.default_rng(9)
    rows = [(m, t, None if rng.random() < 0.2 else float(np.round(rng.normal(), 2))) for m in "ab" for t in range(200)]
    df = spark.createDataFrame(rows, "m string, t int, x double")
    placed = blocks.positions(df, ["m"], "t")
    assert placed.select("part_").distinct().count() > 2
    assert all(r["pos_"] == r["t"] for r in placed.collect())
    x = F.col("x")
    out = blocks.scan(placed, ["m"], "part_", "t", {"total": ("sum", x), "top": ("max", x), "low": ("min", x), "opened": ("first", x), "latest": ("last", x)})
    out = blocks.running_product(out, ["m"], "part_", "t", {"grown": F.coalesce(x, F.lit(1.0))})
    for m in "ab":
        got = out.where(F.col("m") == m).orderBy("t").collect()
        xs = [r[2] for r in rows if r[0] == m]
        for t, r in enumerate(got):
            there = [v for v in xs[: t + 1] if v is not None]
            assert abs(r["total"] - sum(there)) < 1e-9 and r["opened"] == xs[0]
            assert (r["top"], r["low"], r["latest"]) == ((max(there), min(there), there[-1]) if there else (None, None, None))
            assert abs(r["grown"] - math.prod(there)) <= 1e-9 * max(1.0, abs(math.prod(there)))
