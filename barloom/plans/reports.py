"""Reports on signals, features, regimes and curves, each with SQL written apart from the Spark code."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators import backtest, basket, metrics
from barloom.operators.blocks import positions, ranged, running_product, scan, with_halo
from barloom.operators.selection import medians
from barloom.plans.evaluation import _BASKET, _DAILY, _METRICS, _METRICS_SQL, _SIG, _STATE_SQL, _TRADES, _backtest, _basket_rows, _basket_sql, _component_rows, _day, _day_sql, _grids, _grids_sql, _query, _signals, _stock, grid
from barloom.plans.sql import WEIGHTS, bars_sql, grid_sql, signals_sql
from barloom.sources import bars as src
from barloom.sources.store import DayStore, long_metrics, written

_RATIO = metrics.ratio


def _ok(rows: DataFrame) -> DataFrame:
    return rows.where("pred is not null and label is not null")


# Signals by stock, minute, bucket and date.


@_query("stock_daily_ic", f"""WITH {_SIG}, d AS (SELECT model_name, instrument, date, {_METRICS_SQL} FROM ok GROUP BY 1, 2, 3),
s AS (SELECT model_name, instrument, avg(ic) AS daily_ic, count(ic) AS days, CAST(sum(n) AS BIGINT) AS daily_n, avg(CASE WHEN ic < 0 THEN 1e0 WHEN ic >= 0 THEN 0e0 END) AS negative_rate FROM d GROUP BY 1, 2),
o AS (SELECT model_name, instrument, {_METRICS_SQL} FROM ok GROUP BY 1, 2)
SELECT model_name, instrument, o.n, days, daily_n, {_grids_sql(['ic', 'daily_ic', 'negative_rate'])} FROM o LEFT JOIN s USING (model_name, instrument)""")
def stock_daily_ic(spark, sf):
    """IC of each stock within each date, summed up and joined to its metrics over all rows."""
    rows = _signals(spark, sf)
    daily = metrics.finalised(metrics.sufficient(rows, ["model_name", "instrument", "date"]))
    summed = daily.groupBy("model_name", "instrument").agg(F.avg("ic").alias("daily_ic"), F.count("ic").alias("days"), F.sum("n").alias("daily_n"), F.avg((F.col("ic") < 0).cast("double")).alias("negative_rate"))
    overall = metrics.finalised(metrics.sufficient(rows, ["model_name", "instrument"])).select("model_name", "instrument", "n", "ic")
    return _grids(overall.join(summed, ["model_name", "instrument"], "left"), ["model_name", "instrument", "n", "days", "daily_n"], ["ic", "daily_ic", "negative_rate"])


_MINUTE_SQL = _DAILY.replace("SELECT model_name, split, datetime, ", "SELECT model_name, split, date, datetime, minute_index, ").replace("FROM ranked GROUP BY 1, 2, 3)", "FROM ranked GROUP BY 1, 2, 3, 4, 5)")


def _minute_ic(spark, sf) -> DataFrame:
    return metrics.daily_metrics(_signals(spark, sf), ["model_name", "split", "date", "datetime", "minute_index"])


@_query("panel_ic_daily", f"WITH {_MINUTE_SQL} SELECT model_name, split, date, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT minute_index) AS minutes, {grid_sql('avg(ic)')} AS ic, {grid_sql('avg(rank_ic)')} AS rank_ic FROM daily GROUP BY 1, 2, 3")
def panel_ic_daily(spark, sf):
    """The ICs of a date's minutes, averaged."""
    out = _minute_ic(spark, sf).groupBy("model_name", "split", "date").agg(F.sum("n").alias("n"), F.countDistinct("minute_index").alias("minutes"), F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic"))
    return _grids(out, ["model_name", "split", "date", "n", "minutes"], ["ic", "rank_ic"])


@_query("panel_ic_bucket", f"WITH {_MINUTE_SQL} SELECT model_name, CAST(minute_index // 3 AS INT) AS bucket, CAST(sum(n) AS BIGINT) AS n, count(*) AS minutes, {grid_sql('avg(ic)')} AS ic, {grid_sql('avg(rank_ic)')} AS rank_ic FROM daily GROUP BY 1, 2")
def panel_ic_bucket(spark, sf):
    """The ICs of the minutes in a bucket, averaged (not the IC of their rows)."""
    out = _minute_ic(spark, sf).groupBy("model_name", F.floor(F.col("minute_index") / 3).cast("int").alias("bucket")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("minutes"), F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic"))
    return _grids(out, ["model_name", "bucket", "n", "minutes"], ["ic", "rank_ic"])


@_query("error_by_bucket", f"WITH {_SIG} SELECT model_name, bucket, n, {_grids_sql([*_METRICS, 'bias'])} FROM (SELECT model_name, CAST(minute_index // 3 AS INT) AS bucket, avg(e) AS bias, {_METRICS_SQL} FROM ok GROUP BY 1, 2)")
def error_by_bucket(spark, sf):
    rows = _signals(spark, sf).withColumn("bucket", F.floor(F.col("minute_index") / 3).cast("int"))
    out = metrics.finalised(metrics.sufficient(rows, ["model_name", "bucket"])).withColumn("bias", F.col("mp") - F.col("my"))
    return _grids(out, ["model_name", "bucket", "n"], [*_METRICS, "bias"])


_WSIG = f"{bars_sql('week')}, {signals_sql(4)}, ok AS (SELECT *, pred - label AS e FROM sig WHERE pred IS NOT NULL AND label IS NOT NULL)"


def _by_time_sql(key: str, where: str) -> str:
    ranks = f"r0 AS (SELECT *, {key} AS k FROM ok WHERE {where}), ranked AS (SELECT *, " + ", ".join(f"rank() OVER (PARTITION BY model_name, split, k ORDER BY {c}) + (count(*) OVER (PARTITION BY model_name, split, k, {c}) - 1) / 2e0 AS {n}" for c, n in (("pred", "pr"), ("label", "yr"))) + " FROM r0)"
    return f"WITH {_WSIG}, {ranks} SELECT model_name, split, k, n, {_grids_sql([*_METRICS, 'rank_ic'])} FROM (SELECT model_name, split, k, {_METRICS_SQL}, covar_pop(pr, yr) / nullif(stddev_pop(pr) * stddev_pop(yr), 0) AS rank_ic FROM ranked GROUP BY 1, 2, 3)"


def _by_time(rows: DataFrame, key) -> DataFrame:
    return _grids(metrics.daily_metrics(rows.withColumn("k", key), ["model_name", "split", "k"]), ["model_name", "split", "k", "n"], [*_METRICS, "rank_ic"])


@_query("metrics_daily", _by_time_sql(_day_sql(), "split = 'test'"))
def metrics_daily(spark, sf):
    """Metrics of each time of the test split."""
    return _by_time(src.signals(src.weekly_bars(spark, sf), 4).where("split = 'test'"), _day())


@_query("metrics_monthly", _by_time_sql("CAST(strftime(datetime, '%Y%m') AS INT)", "split = 'test'"))
def metrics_monthly(spark, sf):
    """Metrics of each calendar month of the test split."""
    return _by_time(src.signals(src.weekly_bars(spark, sf), 4).where("split = 'test'"), F.date_format("datetime", "yyyyMM").cast("int"))


@_query("metrics_overall_ranked", _by_time_sql("'all'", "true"))
def metrics_overall_ranked(spark, sf):
    """Metrics over all rows of a model and split, with the rank IC from ranks by range."""
    rows = _ok(src.signals(src.weekly_bars(spark, sf), 4)).withColumns({"op": F.struct("model_name", "split", "pred"), "oy": F.struct("model_name", "split", "label")})
    rows = written(rows.select("model_name", "split", "pred", "label", "op", "oy"))
    ranked = metrics.global_rank(metrics.global_rank(rows, "op", "pr"), "oy", "yr")
    by = ["model_name", "split"]
    ranks = ranked.groupBy(*by).agg((F.covar_pop("pr", "yr") / F.nullif(F.stddev_pop("pr") * F.stddev_pop("yr"), F.lit(0.0))).alias("rank_ic"))
    out = metrics.finalised(metrics.sufficient(rows, by)).join(ranks, by).withColumn("k", F.lit("all"))
    return _grids(out, [*by, "k", "n"], [*_METRICS, "rank_ic"])


@_query("metrics_by_merging", f"WITH {_SIG} SELECT model_name, split, n, {_grids_sql(_METRICS)} FROM (SELECT model_name, split, {_METRICS_SQL} FROM ok GROUP BY 1, 2)")
def metrics_by_merging(spark, sf):
    """Metrics of model and split from the sums of single dates, as a new date is merged into kept ones."""
    return _grids(metrics.finalised(metrics.merge_sums(metrics.sufficient(_signals(spark, sf), ["model_name", "split", "date"]), ["model_name", "split"])), ["model_name", "split", "n"], _METRICS)


@_query("daily_mean_series", f"WITH {_SIG} SELECT model_name, date, count(*) AS n, {grid_sql('avg(pred)')} AS pred, {grid_sql('avg(label)')} AS label FROM ok GROUP BY 1, 2")
def daily_mean_series(spark, sf):
    out = _ok(_signals(spark, sf)).groupBy("model_name", "date").agg(F.count(F.lit(1)).alias("n"), F.avg("pred").alias("pred"), F.avg("label").alias("label"))
    return _grids(out, ["model_name", "date", "n"], ["pred", "label"])


_DELTA = "m AS (SELECT model_name, datetime, avg(pred - label) AS delta FROM ok GROUP BY 1, 2)"


@_query("daily_mean_delta", f"WITH {_WSIG}, {_DELTA} SELECT model_name, {_day_sql()} AS day, {_grids_sql(['delta', 'roll_20', 'roll_60'])} FROM (SELECT *, {', '.join(f'CASE WHEN count(delta) OVER r{k} = {k} THEN avg(delta) OVER r{k} END AS roll_{k}' for k in (20, 60))} FROM m WINDOW {', '.join(f'r{k} AS (PARTITION BY model_name ORDER BY datetime ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)' for k in (20, 60))})")
def daily_mean_delta(spark, sf):
    """Mean of prediction minus label at each time, and its strict means over 20 and 60 times."""
    rows = _ok(src.signals(src.weekly_bars(spark, sf), 4)).groupBy("model_name", "datetime").agg(F.avg(F.col("pred") - F.col("label")).alias("delta"))
    cut = with_halo(positions(rows, ["model_name"], "datetime"), 59)
    out = cut.withColumns({f"roll_{k}": metrics.rolling("delta", k, ["model_name", "block_"], "datetime") for k in (20, 60)}).where("own_")
    return _grids(out, ["model_name", _day().alias("day")], ["delta", "roll_20", "roll_60"])


@_query("basket_realised_mean", f"WITH {_BASKET}, b AS (SELECT model_name, datetime, {_basket_sql('weight')} FROM rows_ GROUP BY 1, 2) SELECT {_day_sql()} AS day, count(*) AS models, {grid_sql('avg(basket_label)')} AS realised, {grid_sql('avg(basket_pred)')} AS pred FROM b GROUP BY datetime")
def basket_realised_mean(spark, sf):
    """Baskets averaged over models at each time."""
    b = basket.aggregate_basket(_basket_rows(spark, sf), ["model_name", "datetime"])
    return _grids(b.groupBy("datetime").agg(F.count(F.lit(1)).alias("models"), F.avg("basket_label").alias("realised"), F.avg("basket_pred").alias("pred")), [_day().alias("day"), "models"], ["realised", "pred"])


@_query("strata_deciles", f"""WITH {_SIG}, a AS (SELECT instrument, sum(amount) AS amount FROM bars GROUP BY 1), e AS (SELECT list_sort(list_distinct(quantile_cont(amount, {[k / 10 for k in range(11)]}))) AS edges FROM a),
b AS (SELECT instrument, CAST(len(list_filter(edges[2:len(edges) - 1], lambda x: x < amount)) AS INT) AS stratum FROM a, e),
s AS (SELECT model_name, stratum, instrument, {_METRICS_SQL} FROM ok JOIN b USING (instrument) GROUP BY 1, 2, 3),
p AS (SELECT model_name, stratum, {_METRICS_SQL} FROM ok JOIN b USING (instrument) GROUP BY 1, 2)
SELECT model_name, stratum, any_value(p.n) AS n, count(*) AS instruments, {", ".join(f"{grid_sql(f'any_value(p.{m})')} AS {m}" for m in _METRICS)}, {grid_sql('avg(s.ic)')} AS mean_ic, {grid_sql('median(s.ic)')} AS median_ic FROM s JOIN p USING (model_name, stratum) GROUP BY 1, 2""")
def strata_deciles(spark, sf):
    """Instruments cut into ten by amount (right-closed, equal edges dropped), metrics pooled from their sums."""
    amount = src.monthly_bars(spark, sf).groupBy("instrument").agg(F.sum("amount").alias("amount"))
    edges = amount.agg(F.array_sort(F.array_distinct(F.percentile("amount", [k / 10 for k in range(11)]))).alias("edges")).withColumn("one", F.lit(1))  # eleven numbers
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    strata = amount.withColumn("one", F.lit(1)).join(F.broadcast(edges), "one").select("instrument", F.size(F.filter(inner, lambda x: x < F.col("amount"))).alias("stratum"))
    sums = metrics.sufficient(_signals(spark, sf), ["model_name", "instrument"]).join(strata, "instrument")
    per = metrics.finalised(sums).groupBy("model_name", "stratum").agg(F.count(F.lit(1)).alias("instruments"), F.avg("ic").alias("mean_ic"), F.median("ic").alias("median_ic"))
    out = metrics.finalised(metrics.merge_sums(sums, ["model_name", "stratum"])).join(per, ["model_name", "stratum"])
    return _grids(out, ["model_name", "stratum", "n", "instruments"], [*_METRICS, "mean_ic", "median_ic"])


_VERDICT = "CASE WHEN ic >= 0.05 AND ic_t >= 2 THEN 'good' WHEN ic <= -0.05 AND ic_t <= -2 THEN 'bad' ELSE 'neutral' END"


@_query("verdict_counts", f"WITH {_SIG}, stock AS (SELECT model_name, instrument, {_METRICS_SQL} FROM ok GROUP BY 1, 2), v AS (SELECT *, ic * sqrt((n - 2) / nullif(1 - ic * ic, 0)) AS ic_t FROM stock) SELECT model_name, {_VERDICT} AS verdict, count(*) AS instruments, CAST(sum(n) AS BIGINT) AS n FROM v GROUP BY 1, 2")
def verdict_counts(spark, sf):
    ic, t = F.col("ic"), F.col("ic_t")
    verdict = F.when((ic >= 0.05) & (t >= 2), "good").when((ic <= -0.05) & (t <= -2), "bad").otherwise("neutral")
    return _stock(spark, sf).groupBy("model_name", verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("instruments"), F.sum("n").alias("n"))


_END = "row_number() OVER (PARTITION BY model_name ORDER BY ic{}, instrument) <= 10"


@_query("top_bottom_instruments", f"WITH {_SIG}, s AS (SELECT model_name, instrument, {_METRICS_SQL} FROM ok GROUP BY 1, 2), g AS (SELECT model_name, instrument, n, {grid_sql('ic')} AS ic FROM s WHERE ic IS NOT NULL) (SELECT 'top' AS side, * FROM g QUALIFY {_END.format(' DESC')}) UNION ALL (SELECT 'bottom', * FROM g QUALIFY {_END.format('')})")
def top_bottom_instruments(spark, sf):
    """The ten best and the ten worst instruments of each model by IC: a top-k report."""
    rows = metrics.finalised(metrics.sufficient(_signals(spark, sf), ["model_name", "instrument"])).where("ic is not null")
    rows = written(_grids(rows, ["model_name", "instrument", "n"], ["ic"]))
    place = lambda order: F.row_number().over(Window.partitionBy("model_name").orderBy(order, "instrument"))  # noqa: E731  the planner keeps ten rows a task before the shuffle
    ends = [rows.withColumn("place", place(order)).where("place <= 10").drop("place").select(F.lit(side).alias("side"), "*") for side, order in (("top", F.desc("ic")), ("bottom", F.asc("ic")))]
    return ends[0].unionByName(ends[1])


@_query("model_pick", f"WITH {_SIG}, m AS (SELECT model_name, {_METRICS_SQL} FROM ok WHERE split = 'test' GROUP BY 1), best AS (SELECT * FROM m ORDER BY coalesce(ic, -1e9) DESC, model_name LIMIT 1) SELECT m.model_name, m.n, best.model_name AS picked, {', '.join(f'{grid_sql(f'm.{v} - best.{v}')} AS d_{v}' for v in _METRICS)} FROM m, best")
def model_pick(spark, sf):
    """The model with the best IC on the test split (missing counts as worst), and how far others are from it."""
    rows = metrics.finalised(metrics.sufficient(_signals(spark, sf).where("split = 'test'"), ["model_name"])).select("model_name", "n", *_METRICS)
    best = rows.orderBy(F.coalesce("ic", F.lit(-1e9)).desc(), "model_name").limit(1).select(F.lit(1).alias("one"), F.col("model_name").alias("picked"), *[F.col(v).alias(f"best_{v}") for v in _METRICS])
    out = rows.withColumn("one", F.lit(1)).join(F.broadcast(best), "one")  # one row
    return _grids(out.withColumns({f"d_{v}": F.col(v) - F.col(f"best_{v}") for v in _METRICS}), ["model_name", "n", "picked"], [f"d_{v}" for v in _METRICS])


@_query("model_cross_correlation", f"WITH {_SIG}, p AS (SELECT instrument, datetime, any_value(label) AS label, max(CASE WHEN model_name = 'model_a' THEN pred END) AS a, max(CASE WHEN model_name = 'model_b' THEN pred END) AS b FROM sig GROUP BY 1, 2) SELECT count(*) AS n, {grid_sql('corr(a, b)')} AS pred_corr, {grid_sql('corr(a - label, b - label)')} AS error_corr FROM p WHERE a IS NOT NULL AND b IS NOT NULL AND label IS NOT NULL")
def model_cross_correlation(spark, sf):
    wide = _signals(spark, sf).groupBy("instrument", "datetime").agg(F.max("label").alias("label"), *[F.max(F.when(F.col("model_name") == m, F.col("pred"))).alias(c) for m, c in (("model_a", "a"), ("model_b", "b"))])
    wide = wide.where("a is not null and b is not null and label is not null")
    return _grids(wide.agg(F.count(F.lit(1)).alias("n"), F.corr("a", "b").alias("pred_corr"), F.corr(F.col("a") - F.col("label"), F.col("b") - F.col("label")).alias("error_corr")), ["n"], ["pred_corr", "error_corr"])


# Features: coverage, audit, IC.

_FEATURES = ["ret_1", "ret_5", "place_in_range", "inverse_move", "vol_ratio"]
_FEATURES_SQL = f"""{bars_sql('month')}, feats AS (SELECT date, datetime, instrument, minute_index, lead(close) OVER (PARTITION BY date, instrument ORDER BY datetime) / nullif(close, 0) - 1 AS label,
close / nullif(lag(close) OVER w, 0) - 1 AS ret_1, close / nullif(lag(close, 5) OVER w, 0) - 1 AS ret_5, CASE WHEN high = low THEN CAST('nan' AS DOUBLE) ELSE (close - low) / (high - low) END AS place_in_range,
CASE WHEN close = open THEN CAST('infinity' AS DOUBLE) ELSE 1 / (close - open) END AS inverse_move, vol / nullif(avg(vol) OVER (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0) AS vol_ratio
FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY datetime)),
long AS ({' UNION ALL '.join(f"SELECT date, datetime, instrument, minute_index, label, '{c}' AS feature, {c} AS value FROM feats" for c in _FEATURES)})"""
_FINITE_SQL = "value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value)"


def _features(spark, sf) -> DataFrame:
    """Monthly bars with a few features, two of which may be infinite or no number."""
    w = Window.partitionBy("instrument").orderBy("datetime")
    bars = src.forward_label(src.monthly_bars(spark, sf), 1)
    back = lambda n: F.col("close") / F.nullif(F.lag("close", n).over(w), F.lit(0.0)) - 1
    return bars.withColumns({
        "ret_1": back(1), "ret_5": back(5), "place_in_range": F.when(F.col("high") == F.col("low"), F.lit(float("nan"))).otherwise(F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low"))),
        "inverse_move": F.when(F.col("close") == F.col("open"), F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1.0), F.col("close") - F.col("open"))), "vol_ratio": F.col("vol") / F.nullif(F.avg("vol").over(w.rowsBetween(-4, 0)), F.lit(0.0)),
    })


def _long(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., feature, value): all features in one job."""
    return rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in _FEATURES])).alias("f")).select(*keys, "f.feature", "f.value")


def _finite():
    return F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))


@_query("feature_coverage", f"WITH {_FEATURES_SQL} SELECT feature, count(*) AS n, {grid_sql('avg(CASE WHEN value IS NOT NULL AND NOT isnan(value) THEN 1e0 ELSE 0e0 END)')} AS covered FROM long GROUP BY 1")
def feature_coverage(spark, sf):
    return _grids(_long(_features(spark, sf), []).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("value").isNotNull() & ~F.isnan("value")).cast("double")).alias("covered")), ["feature", "n"], ["covered"])


_SAMPLED = "(CAST(date AS BIGINT) * 1000003 + instrument * 10007 + minute_index * 10009) % 50 = 0"


@_query("factor_audit", f"""WITH {_FEATURES_SQL}, c AS (SELECT feature, count(*) AS total, count(*) FILTER ({_FINITE_SQL}) AS finite, count(*) FILTER (isinf(value)) AS inf, count(*) FILTER (value IS NULL OR isnan(value)) AS missing,
count(*) FILTER ({_SAMPLED}) AS sampled, count(*) FILTER ({_SAMPLED} AND {_FINITE_SQL}) AS sampled_finite, avg(CASE WHEN {_FINITE_SQL} THEN value END) AS mean, stddev_pop(CASE WHEN {_FINITE_SQL} THEN value END) AS std FROM long GROUP BY 1)
SELECT feature, total, finite, inf, missing, sampled, sampled_finite, {_grids_sql(['mean', 'std'], 4)}, CASE WHEN finite = 0 OR inf > 0 OR std = 0 THEN 'fail' WHEN sampled_finite < 0.8 * sampled THEN 'warn' ELSE 'pass' END AS gate FROM c""")
def factor_audit(spark, sf):
    """Counts, moments and a verdict for every feature, over all rows and over the sample, in one grouping."""
    value = F.when(_finite(), F.col("value"))
    long = _long(_features(spark, sf), ["date", "instrument", "minute_index"]).withColumn("sample", F.expr(_SAMPLED))
    count = lambda c: F.sum(c.cast("long"))
    out = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("total"), F.count(value).alias("finite"), count(F.coalesce(F.abs("value") == float("inf"), F.lit(False))).alias("inf"), count(F.col("value").isNull() | F.coalesce(F.isnan("value"), F.lit(False))).alias("missing"),
        count(F.col("sample")).alias("sampled"), F.count(F.when(F.col("sample"), value)).alias("sampled_finite"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
    )
    gate = F.when((F.col("finite") == 0) | (F.col("inf") > 0) | (F.col("std") == 0), "fail").when(F.col("sampled_finite") < 0.8 * F.col("sampled"), "warn").otherwise("pass")
    return _grids(out.withColumn("gate", gate), ["feature", "total", "finite", "inf", "missing", "sampled", "sampled_finite", "gate"], ["mean", "std"], 4)


@_query("feature_ic", f"""WITH {_FEATURES_SQL}, f AS (SELECT * FROM long WHERE {_FINITE_SQL} AND label IS NOT NULL), o AS (SELECT feature, count(*) AS n, covar_pop(value, label) / nullif(stddev_pop(value) * stddev_pop(label), 0) AS ic FROM f GROUP BY 1),
d AS (SELECT feature, date, CASE WHEN count(*) >= 2 THEN covar_pop(value, label) / nullif(stddev_pop(value) * stddev_pop(label), 0) END AS ic FROM f GROUP BY 1, 2), s AS (SELECT feature, avg(ic) AS daily_ic, stddev_pop(ic) AS daily_std, CASE WHEN count(ic) >= 2 THEN avg(ic) / nullif(stddev_pop(ic), 0) END AS ir, count(ic) AS days FROM d GROUP BY 1)
SELECT feature, n, days, {_grids_sql(['ic', 'daily_ic', 'daily_std'])}, {grid_sql('ir', 4)} AS ir FROM o JOIN s USING (feature)""")
def feature_ic(spark, sf):
    """IC of every feature over all rows and by date."""
    long = _long(_features(spark, sf), ["date", "label"]).where(_finite()).withColumnRenamed("value", "pred")
    overall = metrics.finalised(metrics.sufficient(long, ["feature"])).select("feature", "n", "ic")
    daily = metrics.finalised(metrics.sufficient(long, ["feature", "date"]))
    ir = F.when(F.count("ic") >= 2, F.avg("ic") / F.nullif(F.stddev_pop("ic"), F.lit(0.0)))
    summed = daily.groupBy("feature").agg(F.avg("ic").alias("daily_ic"), F.stddev_pop("ic").alias("daily_std"), ir.alias("ir"), F.count("ic").alias("days"))
    out = overall.join(summed, "feature")
    return out.select("feature", "n", "days", *[grid(v).alias(v) for v in ("ic", "daily_ic", "daily_std")], grid("ir", 4).alias("ir"))


# Components.

_COMPONENT = ["w_ret", "w_vol_chg", "xs_ret_std", "weight_coverage", "missing_rate", "breadth"]


@_query("component_state", f"""WITH {bars_sql('week')}, {WEIGHTS}, x AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS r, vol / nullif(lag(vol) OVER w, 0) - 1 AS v FROM bars WINDOW w AS (PARTITION BY date, instrument ORDER BY datetime)),
j AS (SELECT x.*, wbars.trade_date, wbars.weight FROM x JOIN wbars USING (date, datetime, instrument)), t AS (SELECT trade_date, sum(weight / 100) AS total, count(DISTINCT instrument) AS members FROM weights GROUP BY 1),
c AS (SELECT datetime, sum(weight * r) / sum(weight) AS w_ret, sum(weight * v) / sum(weight) AS w_vol_chg, stddev_samp(r) AS xs_ret_std, sum(CASE WHEN r IS NOT NULL THEN weight END) / any_value(total) AS weight_coverage,
1 - nullif(count(DISTINCT CASE WHEN r IS NOT NULL THEN instrument END), 0) / CAST(any_value(members) AS DOUBLE) AS missing_rate, sum(CASE WHEN r > 0 THEN weight END) / any_value(total) AS breadth FROM j JOIN t USING (trade_date) GROUP BY 1)
SELECT {_day_sql()} AS day, {_grids_sql(_COMPONENT)} FROM c""")
def component_state_query(spark, sf):
    """Weighted return and volume change, spread, coverage and breadth against the whole index."""
    bars = src.weekly_bars(spark, sf)
    weights = src.index_weights(bars)
    w = Window.partitionBy("date", "instrument").orderBy("datetime")
    change = lambda c: F.col(c) / F.nullif(F.lag(c).over(w), F.lit(0.0)) - 1
    rows = bars.withColumns({"r": change("close"), "v": change("vol")})
    rows = src.weighted_bars(rows, weights)
    total = weights.groupBy("trade_date").agg(F.sum(F.col("weight") / 100).alias("total"), F.countDistinct("instrument").alias("members"))
    r, wt = F.col("r"), F.col("weight")
    seen = F.countDistinct(F.when(r.isNotNull(), F.col("instrument")))
    out = rows.join(total, "trade_date").groupBy("datetime").agg(
        _RATIO(F.sum(wt * r), F.sum(wt)).alias("w_ret"), _RATIO(F.sum(wt * F.col("v")), F.sum(wt)).alias("w_vol_chg"), F.stddev_samp("r").alias("xs_ret_std"),
        (F.sum(F.when(r.isNotNull(), wt)) / F.max("total")).alias("weight_coverage"), (1 - F.nullif(seen, F.lit(0)) / F.max("members")).alias("missing_rate"), (F.sum(F.when(r > 0, wt)) / F.max("total")).alias("breadth"),
    )
    return _grids(out, [_day().alias("day")], _COMPONENT)


_TIERS = [f"{v}_{n}" for n in (1, 5, 10) for v in ("w_ret", "top10", "top20", "rest20", "top20_minus_rest20", "top10_minus_basket")] + ["missing_rate", "amount_shock"]


@_query("component_tiers", f"""WITH {bars_sql('week')}, {WEIGHTS}, {_STATE_SQL}, y AS (SELECT *, amount / nullif(lag(amount) OVER (PARTITION BY date, instrument ORDER BY datetime), 0) - 1 AS a FROM rets),
c AS (SELECT datetime, {", ".join(f"sum(weight * r{n}) / sum(weight) AS w_ret_{n}, sum(CASE WHEN place <= 10 THEN weight * r{n} END) / sum(CASE WHEN place <= 10 THEN weight END) AS top10_{n}, sum(CASE WHEN place <= 20 THEN weight * r{n} END) / sum(CASE WHEN place <= 20 THEN weight END) AS top20_{n}, sum(CASE WHEN place > 20 THEN weight * r{n} END) / sum(CASE WHEN place > 20 THEN weight END) AS rest20_{n}" for n in (1, 5, 10))},
1 - sum(CASE WHEN r1 IS NOT NULL THEN weight END) / sum(weight) AS missing_rate, sum(weight * a) / sum(weight) AS amount_shock FROM y GROUP BY 1),
z AS (SELECT *, {", ".join(f"top20_{n} - rest20_{n} AS top20_minus_rest20_{n}, top10_{n} - w_ret_{n} AS top10_minus_basket_{n}" for n in (1, 5, 10))} FROM c) SELECT {_day_sql()} AS day, {_grids_sql(_TIERS)} FROM z""")
def component_tiers(spark, sf):
    """Relative strength of the largest weights over 1, 5 and 10 bars, and the weighted change of amounts."""
    w = Window.partitionBy("date", "instrument").orderBy("datetime")
    change = lambda c, n: F.col(c) / F.nullif(F.lag(c, n).over(w), F.lit(0.0)) - 1
    rows = basket.weight_rank(_component_rows(spark, sf)).withColumns({**{f"r{n}": change("close", n) for n in (1, 5, 10)}, "a": change("amount", 1)})
    wt = F.col("weight")
    out = [(1 - _RATIO(F.sum(F.when(F.col("r1").isNotNull(), F.col("weight"))), F.sum("weight"))).alias("missing_rate"), _RATIO(F.sum(wt * F.col("a")), F.sum(wt)).alias("amount_shock")]
    tiers = {"w_ret": F.lit(True), "top10": F.col("place") <= 10, "top20": F.col("place") <= 20, "rest20": F.col("place") > 20}
    out += [_RATIO(F.sum(F.when(inside, wt * F.col(f"r{n}"))), F.sum(F.when(inside, wt))).alias(f"{name}_{n}") for n in (1, 5, 10) for name, inside in tiers.items()]
    found = rows.groupBy("datetime").agg(*out)
    found = found.withColumns({f"top20_minus_rest20_{n}": F.col(f"top20_{n}") - F.col(f"rest20_{n}") for n in (1, 5, 10)} | {f"top10_minus_basket_{n}": F.col(f"top10_{n}") - F.col(f"w_ret_{n}") for n in (1, 5, 10)})
    return _grids(found, [_day().alias("day")], _TIERS)


# Regimes.

_FUND_SQL = "fund_ AS (SELECT date, datetime, any_value(minute_index) AS minute_index, sum(amount) / sum(vol) AS close, sum(amount) AS amount FROM bars GROUP BY 1, 2)"
_MARKET_SQL = f"""{_FUND_SQL}, fr AS (SELECT *, close / lag(close) OVER (PARTITION BY date ORDER BY datetime) - 1 AS r FROM fund_),
md AS (SELECT date, sum(amount) AS daily_amount, sqrt(coalesce(sum(r * r), 0)) AS daily_rvol, arg_max(close, datetime) / arg_min(close, datetime) - 1 AS daily_ret FROM fr GROUP BY 1),
wx AS (SELECT date, datetime, weight, close / nullif(lag(close) OVER (PARTITION BY date, instrument ORDER BY datetime), 0) - 1 AS x FROM wbars),
pm AS (SELECT date, datetime, coalesce(sum(weight * x), 0) / sum(weight) AS mean, coalesce(sum(weight * x * x), 0) / sum(weight) AS square, sum(CASE WHEN x > 0 THEN weight ELSE 0 END) / sum(weight) AS breadth FROM wx GROUP BY 1, 2),
dd AS (SELECT date, avg(breadth) AS breadth, avg(sqrt(greatest(square - mean * mean, 0))) AS dispersion FROM pm GROUP BY 1),
market AS (SELECT md.*, abs(daily_ret) / nullif(daily_rvol, 0) AS trend, breadth, dispersion FROM md JOIN dd USING (date))"""
_MARKET = ["daily_rvol", "daily_ret", "trend", "breadth", "dispersion"]


def _fund(bars: DataFrame) -> DataFrame:
    return bars.groupBy("date", "datetime").agg(F.max("minute_index").alias("minute_index"), (F.sum("amount") / F.sum("vol")).alias("close"), F.sum("amount").alias("amount"))


def market_facts(bars: DataFrame) -> DataFrame:
    """Facts of each date: amount, volatility, return and trend of the fund; breadth and dispersion of its members.

    Returns start anew with each date.  A member without a return counts in the weights
    but not in the sums.
    """
    w = Window.partitionBy("date").orderBy("datetime")
    fund = _fund(bars).withColumn("r", F.col("close") / F.lag("close").over(w) - 1)
    daily = fund.groupBy("date").agg(F.sum("amount").alias("daily_amount"), F.sqrt(F.coalesce(F.sum(F.col("r") * F.col("r")), F.lit(0.0))).alias("daily_rvol"), (F.max_by("close", "datetime") / F.min_by("close", "datetime") - 1).alias("daily_ret"))
    x = F.col("close") / F.nullif(F.lag("close").over(Window.partitionBy("date", "instrument").orderBy("datetime")), F.lit(0.0)) - 1
    members = src.weighted_bars(bars, src.index_weights(bars)).withColumn("x", x)
    wt, total = F.col("weight"), F.sum("weight")
    per = members.groupBy("date", "datetime").agg(
        (F.coalesce(F.sum(wt * F.col("x")), F.lit(0.0)) / total).alias("mean"), (F.coalesce(F.sum(wt * F.col("x") * F.col("x")), F.lit(0.0)) / total).alias("square"), (F.sum(F.when(F.col("x") > 0, wt).otherwise(0.0)) / total).alias("breadth"),
    )
    spread = per.groupBy("date").agg(F.avg("breadth").alias("breadth"), F.avg(F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0)))).alias("dispersion"))
    return daily.join(spread, "date").withColumn("trend", F.abs("daily_ret") / F.nullif(F.col("daily_rvol"), F.lit(0.0)))


@_query("regime_facts", f"WITH {bars_sql('week')}, {WEIGHTS}, {_MARKET_SQL} SELECT date, {grid_sql('daily_amount', 2)} AS daily_amount, {_grids_sql(_MARKET)} FROM market")
def regime_facts(spark, sf):
    facts = market_facts(src.weekly_bars(spark, sf))
    return facts.select("date", grid("daily_amount", 2).alias("daily_amount"), *[grid(c).alias(c) for c in _MARKET])


#: Family, the fact it is cut by (at its median over dates or rows, or at 0), and its names above and below.
_TWO_WAY = [
    ("amount", "daily_amount", "date", "high", "low"), ("vol", "daily_rvol", "date", "high", "low"), ("trend", "trend", "date", "trend", "choppy"), ("dispersion", "dispersion", "date", "dispersed", "consensus"),
    ("prediction_strength", "abs_pred", "row", "strong", "weak"), ("basis", "abs_basis", "row", "large", "small"), ("coverage", "coverage", "row", "high", "low"),
]
_REGIME_ROWS_SQL = f"""{_TRADES}, {_MARKET_SQL.replace("fund_ AS", "fund9_ AS").replace("FROM fund_)", "FROM fund9_)")},
rr AS (SELECT s.model_name, s.date, s.datetime, s.pred, s.label, f.minute_index, daily_amount, daily_rvol, daily_ret, trend, dispersion, abs(s.pred) AS abs_pred, abs(s.label - bk.basket_label) AS abs_basis, bk.weight_coverage_pred AS coverage
FROM series s JOIN fund9_ f USING (date, datetime) JOIN market USING (date) JOIN bk ON bk.model_name = s.model_name AND bk.datetime = s.datetime WHERE s.pred IS NOT NULL AND s.label IS NOT NULL),
mm AS (SELECT {", ".join(f"median({fact}) AS m_{fact}" for _, fact, at, _, _ in _TWO_WAY if at == "date")} FROM market), mr AS (SELECT model_name, {", ".join(f"median({fact}) AS m_{fact}" for _, fact, at, _, _ in _TWO_WAY if at == "row")} FROM rr GROUP BY 1),
lab AS ({" UNION ALL ".join(f"SELECT rr.*, '{name}' AS family, CASE WHEN coalesce({fact} >= m_{fact}, false) THEN '{above}' ELSE '{below}' END AS regime FROM rr JOIN mr USING (model_name), mm" for name, fact, _, above, below in _TWO_WAY)}
UNION ALL SELECT rr.*, 'direction', CASE WHEN daily_ret >= 0 THEN 'up' ELSE 'down' END FROM rr UNION ALL SELECT rr.*, 'intraday', CASE WHEN minute_index < 18 THEN 'morning' WHEN minute_index < 36 THEN 'afternoon' ELSE 'tail' END FROM rr
UNION ALL SELECT rr.*, 'breadth_dispersion', CASE WHEN daily_ret >= 0 THEN 'up' ELSE 'down' END || '_' || CASE WHEN coalesce(dispersion >= m_dispersion, false) THEN 'dispersed' ELSE 'consensus' END FROM rr, mm)"""


def regime_rows(spark, sf) -> DataFrame:
    """Each prediction of each model's basket once per family, with its regime: one explode, all families and models in one job.

    Regimes of dates are the same for every model; those of rows are cut at the model's own medians.
    """
    bars = written(src.weekly_bars(spark, sf))
    facts = written(market_facts(bars))
    rows = src.signals(bars, 4).join(src.weighted_bars(bars, src.index_weights(bars)).select("date", "datetime", "instrument", "weight"), ["date", "datetime", "instrument"])
    b = basket.aggregate_basket(rows, ["model_name", "date", "datetime"])
    fund = src.forward_label(_fund(bars).withColumn("instrument", F.lit(0)), 4)
    base = fund.join(b, ["date", "datetime"]).join(facts, "date").select(
        "model_name", "date", "datetime", "minute_index", "label", F.col("basket_pred").alias("pred"), "daily_amount", "daily_rvol", "daily_ret", "trend", "dispersion",
        F.abs("basket_pred").alias("abs_pred"), F.abs(F.col("label") - F.col("basket_label")).alias("abs_basis"), F.col("weight_coverage_pred").alias("coverage"),
    )
    base = written(_ok(base))
    facts_of = lambda at: [fact for _, fact, per, _, _ in _TWO_WAY if per == at]
    of_dates = medians(facts, facts_of("date")).withColumn("one", F.lit(1))
    base = base.withColumn("one", F.lit(1)).join(F.broadcast(of_dates), "one").join(F.broadcast(medians(base, facts_of("row"), ["model_name"])), "model_name")  # one row, and one per model
    cut = {name: F.when(F.coalesce(F.col(fact) >= F.col(f"m_{fact}"), F.lit(False)), above).otherwise(below) for name, fact, _, above, below in _TWO_WAY}
    direction = F.when(F.col("daily_ret") >= 0, "up").otherwise("down")
    cut |= {"direction": direction, "intraday": F.when(F.col("minute_index") < 18, "morning").when(F.col("minute_index") < 36, "afternoon").otherwise("tail"), "breadth_dispersion": F.concat_ws("_", direction, cut["dispersion"])}
    return base.select("*", F.explode(F.array(*[F.struct(F.lit(name).alias("family"), regime.alias("regime")) for name, regime in cut.items()])).alias("r")).select("*", "r.family", "r.regime").drop("r", "one")


@_query("regime_labels", f"WITH {_REGIME_ROWS_SQL} SELECT model_name, family, regime, count(*) AS n, count(DISTINCT date) AS dates, {_day_sql('min(datetime)')} AS first_day FROM lab GROUP BY 1, 2, 3")
def regime_labels(spark, sf):
    return regime_rows(spark, sf).groupBy("model_name", "family", "regime").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("date").alias("dates"), _day(F.min("datetime")).alias("first_day"))


_REGIME = ["ic", "rank_ic", "daily_ic", "daily_std", "icir", "positive_ratio", "strategy"]


@_query("regime_report", f"""WITH {_REGIME_ROWS_SQL}, e1 AS (SELECT *, pred - label AS e FROM lab), rk AS (SELECT *, rank() OVER (PARTITION BY model_name, family, regime ORDER BY pred) + (count(*) OVER (PARTITION BY model_name, family, regime, pred) - 1) / 2e0 AS pr, rank() OVER (PARTITION BY model_name, family, regime ORDER BY label) + (count(*) OVER (PARTITION BY model_name, family, regime, label) - 1) / 2e0 AS yr FROM e1),
po AS (SELECT model_name, family, regime, {_METRICS_SQL}, covar_pop(pr, yr) / nullif(stddev_pop(pr) * stddev_pop(yr), 0) AS rank_ic, product(CASE WHEN minute_index % 4 = 0 THEN 1 + sign(pred) * label ELSE 1 END) - 1 AS strategy FROM rk GROUP BY 1, 2, 3),
dy AS (SELECT model_name, family, regime, date, {_METRICS_SQL} FROM e1 GROUP BY 1, 2, 3, 4), ds AS (SELECT model_name, family, regime, count(*) AS days, avg(ic) AS daily_ic, stddev_samp(ic) AS daily_std, avg(ic) / nullif(stddev_samp(ic), 0) AS icir, avg(CASE WHEN ic > 0 THEN 1e0 WHEN ic <= 0 THEN 0e0 END) AS positive_ratio FROM dy GROUP BY 1, 2, 3)
SELECT model_name, family, regime, n, days, {_grids_sql(_REGIME)} FROM po JOIN ds USING (model_name, family, regime)""")
def regime_report(spark, sf):
    """For every model and regime: IC and rank IC of its rows, its dates' ICs, and the product of its non-overlapping trades."""
    rows, by = written(regime_rows(spark, sf)), ["model_name", "family", "regime"]
    pooled = metrics.finalised(metrics.sufficient(rows, by)).join(metrics.large_rank_ic(rows, by), by)
    trade = F.when(F.col("minute_index") % 4 == 0, 1 + F.signum("pred") * F.col("label")).otherwise(1.0)
    strategy = rows.groupBy(*by).agg((F.product(trade) - 1).alias("strategy"))
    daily = metrics.finalised(metrics.sufficient(rows, [*by, "date"])).groupBy(*by).agg(
        F.count(F.lit(1)).alias("days"), F.avg("ic").alias("daily_ic"), F.stddev_samp("ic").alias("daily_std"), (F.avg("ic") / F.nullif(F.stddev_samp("ic"), F.lit(0.0))).alias("icir"), F.avg((F.col("ic") > 0).cast("double")).alias("positive_ratio"),
    )
    return _grids(pooled.join(strategy, by).join(daily, by), [*by, "n", "days"], _REGIME)


# Curves.

_EXTREMA = ["start", "end_", "top", "low", "max_drawdown"]
_OVERLAP_SQL = f"""{_TRADES}, ev AS (SELECT model_name, datetime, 1 + sign(pred) * label AS s, 1 + label AS b FROM series WHERE pred IS NOT NULL AND label IS NOT NULL),
cu AS (SELECT model_name, 'strategy' AS curve, datetime, product(s) OVER w AS v FROM ev WINDOW w AS (PARTITION BY model_name ORDER BY datetime ROWS UNBOUNDED PRECEDING) UNION ALL SELECT model_name, 'benchmark', datetime, product(b) OVER w FROM ev WINDOW w AS (PARTITION BY model_name ORDER BY datetime ROWS UNBOUNDED PRECEDING)
UNION ALL SELECT model_name, 'price', datetime, close / first_value(close) OVER (PARTITION BY model_name ORDER BY datetime) FROM series WHERE pred IS NOT NULL AND label IS NOT NULL),
cd AS (SELECT *, v / nullif(max(v) OVER (PARTITION BY model_name, curve ORDER BY datetime ROWS UNBOUNDED PRECEDING), 0) - 1 AS d FROM cu)"""


@_query("backtest_overlap_check", f"WITH {_OVERLAP_SQL} SELECT model_name, curve, {', '.join(f'{grid_sql(x, 4)} AS {n}' for n, x in zip(_EXTREMA, ('arg_min(v, datetime)', 'arg_max(v, datetime)', 'max(v)', 'min(v)', 'min(d)')))}, {_day_sql('arg_max(datetime, v)')} AS top_day, {_day_sql('arg_min(datetime, v)')} AS low_day, {_day_sql('arg_min(datetime, d)')} AS drawdown_day FROM cd GROUP BY 1, 2")
def backtest_overlap_check(spark, sf):
    """Extrema of curves that compound overlapping returns, next to the price itself: the difference shows the error."""
    series = ranged(_backtest(spark, sf)[0].where("pred is not null and label is not null").select("model_name", "datetime", "close", "pred", "label"), ["model_name"], ["datetime"])
    growth = {"strategy": 1 + F.signum("pred") * F.col("label"), "benchmark": 1 + F.col("label")}
    values = running_product(series, ["model_name"], "part_", "datetime", growth)
    values = scan(values, ["model_name"], "part_", "datetime", {"opened": ("first", F.col("close"))}).withColumn("price", F.col("close") / F.col("opened"))
    long = values.select("model_name", "datetime", "part_", F.explode(F.array(*[F.struct(F.lit(n).alias("curve"), F.col(n).alias("v")) for n in ("strategy", "benchmark", "price")])).alias("c")).select("model_name", "datetime", "part_", "c.*")
    return _grids(backtest.curve_extrema(long, ["model_name", "curve"]), ["model_name", "curve", "top_day", "low_day", "drawdown_day"], _EXTREMA, 4)


# Splits, prediction tables, stores.


@_query("date_range", f"WITH {bars_sql('month')} SELECT date, count(*) AS n FROM bars WHERE date BETWEEN 19970101 AND 20000101 GROUP BY 1")
def date_range(spark, sf):
    """Both ends belong to the range."""
    return src.monthly_bars(spark, sf).where(F.col("date").between(19970101, 20000101)).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@_query("bounded_split", f"WITH {bars_sql('week')}, d AS (SELECT DISTINCT date FROM bars) (SELECT 'train' AS split, date FROM d WHERE date < 19990101 ORDER BY date DESC LIMIT 2) UNION ALL (SELECT 'test', date FROM d WHERE date >= 20000101 ORDER BY date LIMIT 1)")
def bounded_split(spark, sf):
    """The last two dates of the train split and the first one of the test split."""
    dates = src.weekly_bars(spark, sf).select("date").distinct().withColumn("split", src.split_of(F.col("date"))).where("split <> 'ignore'")
    place = F.row_number().over(Window.partitionBy("split").orderBy(F.when(F.col("split") == "train", -F.col("date")).otherwise(F.col("date"))))  # the calendar, one row per date
    return dates.withColumn("place", place).where("place <= case when split = 'train' then 2 else 1 end").select("split", "date")


@_query("prediction_table", f"WITH {_BASKET} SELECT {_day_sql()} AS day, date, model_name, split, {_grids_sql(['pred', 'label'])} FROM (SELECT model_name, split, date, datetime, {_basket_sql('weight')} FROM rows_ GROUP BY 1, 2, 3, 4) t, LATERAL (SELECT basket_pred AS pred, basket_label AS label)")
def prediction_table(spark, sf):
    """Baskets in the six columns of every prediction table."""
    b = basket.aggregate_basket(_basket_rows(spark, sf), ["model_name", "split", "date", "datetime"])
    table = b.select("datetime", "date", F.col("basket_pred").alias("pred"), F.col("basket_label").alias("label"), "split", "model_name")
    return _grids(table, [_day().alias("day"), "date", "model_name", "split"], ["pred", "label"])


@_query("prediction_prices", f"WITH {_SIG}, f AS (SELECT datetime, sum(amount) / sum(vol) AS price FROM bars WHERE trades >= 2 GROUP BY 1) SELECT model_name, instrument, {_day_sql('s.datetime')} AS day, {_grids_sql(['pred', 'price'], 4)} FROM sig s LEFT JOIN f ON f.datetime = s.datetime WHERE pred IS NOT NULL")
def prediction_prices(spark, sf):
    """All predictions with the price of their time, if there is one: that of bars with two trades or more."""
    bars = src.monthly_bars(spark, sf)
    prices = bars.where("trades >= 2").groupBy("datetime").agg((F.sum("amount") / F.sum("vol")).alias("price"))
    rows = src.signals(bars, 1).where("pred is not null")
    return _grids(rows.join(prices, "datetime", "left"), ["model_name", "instrument", _day().alias("day")], ["pred", "price"], 4)


@_query("fund_scan", f"WITH {bars_sql('week')} SELECT {_day_sql()} AS day, minute_index, {_grids_sql(['close', 'vol', 'amount'], 3)} FROM bars WHERE instrument = 12")
def fund_scan(spark, sf):
    """Bars of one instrument; the filter on its brand reaches the scan."""
    bars = src.weekly_bars(spark, sf).where("instrument = 12").sort("datetime")
    return _grids(bars, [_day().alias("day"), "minute_index"], ["close", "vol", "amount"], 3)


@_query("coverage_audit", f"""WITH {_BASKET}, w AS (SELECT date, datetime, minute_index, instrument FROM wbars), mods AS (SELECT DISTINCT model_name FROM sig), c AS (SELECT mods.model_name, w.date, w.minute_index, avg(CASE WHEN s.pred IS NOT NULL THEN 1e0 ELSE 0e0 END) AS covered, count(*) AS n, count(s.instrument) AS joined FROM w CROSS JOIN mods LEFT JOIN sig s ON s.datetime = w.datetime AND s.instrument = w.instrument AND s.model_name = mods.model_name GROUP BY 1, 2, 3),
m AS (SELECT *, minute_index = min(minute_index) OVER (PARTITION BY model_name, date) AS is_first, minute_index = max(minute_index) OVER (PARTITION BY model_name, date) AS is_last FROM c),
x AS (SELECT model_name, 'minute' AS section, CAST(minute_index AS INT) AS minute_index, covered, n, joined FROM m UNION ALL SELECT model_name, 'first', -1, covered, n, joined FROM m WHERE is_first UNION ALL SELECT model_name, 'last', -1, covered, n, joined FROM m WHERE is_last UNION ALL SELECT model_name, 'all', -1, covered, n, joined FROM m)
SELECT model_name, section, minute_index, count(*) AS dates, {grid_sql('avg(covered)')} AS covered, {grid_sql('avg(1 - covered)')} AS missing, CAST(sum(n) AS BIGINT) AS n, {grid_sql('sum(joined) * 1e0 / sum(n)')} AS retained FROM x GROUP BY 1, 2, 3""")
def coverage_audit(spark, sf):
    """Coverage of each model by minute, of the first and last minute of the dates, and how many rows the join keeps."""
    bars = written(src.weekly_bars(spark, sf))
    members = src.weighted_bars(bars, src.index_weights(bars)).select("date", "datetime", "minute_index", "instrument")
    preds = src.signals(bars, 4).groupBy("datetime", "instrument").agg(F.map_from_entries(F.collect_list(F.struct("model_name", F.struct("pred")))).alias("preds"))  # one entry per model
    models = src.signals(bars, 4).agg(F.sort_array(F.collect_set("model_name")).alias("models"))
    every = members.join(preds, ["datetime", "instrument"], "left").join(F.broadcast(models)).select("*", F.explode("models").alias("model_name"))  # one row
    found = F.col("preds")[F.col("model_name")]
    per = every.groupBy("model_name", "date", "minute_index").agg(F.avg(found.getField("pred").isNotNull().cast("double")).alias("covered"), F.count(F.lit(1)).alias("n"), F.count(found).alias("joined"))
    w = Window.partitionBy("model_name", "date")
    per = per.withColumns({"is_first": F.col("minute_index") == F.min("minute_index").over(w), "is_last": F.col("minute_index") == F.max("minute_index").over(w)})
    sections = [("minute", F.lit(True), F.col("minute_index")), ("first", F.col("is_first"), F.lit(-1)), ("last", F.col("is_last"), F.lit(-1)), ("all", F.lit(True), F.lit(-1))]
    rows = per.select("model_name", "covered", "n", "joined", F.explode(F.array(*[F.struct(F.lit(s).alias("section"), at.cast("int").alias("minute_index"), keep.alias("keep")) for s, keep, at in sections])).alias("s")).where("s.keep")
    out = rows.groupBy("model_name", "s.section", "s.minute_index").agg(F.count(F.lit(1)).alias("dates"), F.avg("covered").alias("covered"), F.avg(1 - F.col("covered")).alias("missing"), F.sum("n").alias("n"), (F.sum("joined") / F.sum("n")).alias("retained"))
    return _grids(out, ["model_name", "section", "minute_index", "dates", "n"], ["covered", "missing", "retained"])


@_query("panel_cache", f"WITH {bars_sql('month')} SELECT date, date <= 19970101 AS hit, count(*) AS n, {grid_sql('sum(close)', 1)} AS close, {grid_sql('sum(amount)', 1)} AS amount FROM bars GROUP BY 1, 2")
def panel_cache(spark, sf):
    """Days up to 1997 are stored without amounts, the rest is prebuilt, and the amounts are added to the days that lack them."""
    bars = src.monthly_bars(spark, sf)
    store = DayStore(spark)
    store.write(bars.where("date <= 19970101").drop("amount"))
    days = store.prebuild(bars)
    store.backfill(bars, "amount", bars, ["date", "datetime", "instrument", "minute_index"])
    rows = store.read(bars)
    return _grids(rows.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("close").alias("close"), F.sum("amount").alias("amount")).join(days, "date"), ["date", "hit", "n"], ["close", "amount"], 1)


@_query("panel_writer", f"WITH {_FEATURES_SQL} SELECT feature, count(*) AS n, {grid_sql('avg(CASE WHEN value IS NOT NULL THEN 1e0 ELSE 0e0 END)')} AS covered FROM long WHERE label IS NOT NULL AND date // 10000 <> 1999 GROUP BY 1")
def panel_writer(spark, sf):
    """Feature rows with a label, outside the ignored split, stored by date; coverage from what was stored."""
    rows = _features(spark, sf).withColumn("split", src.split_of(F.col("date"))).where("split <> 'ignore' and label is not null").select("date", "datetime", "instrument", "split", "label", *_FEATURES)
    store = DayStore(spark)
    store.write(rows)
    return _grids(_long(store.read(rows), []).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("value").isNotNull().cast("double")).alias("covered")), ["feature", "n"], ["covered"])


@_query("run_artifacts", f"WITH {_SIG}, m AS (SELECT model_name, split, {_METRICS_SQL} FROM ok GROUP BY 1, 2), u AS ({' UNION ALL '.join(f"SELECT 'overall' AS section, model_name, split, '{v}' AS metric, CAST({v} AS DOUBLE) AS value FROM m" for v in [*_METRICS, 'n'])}) SELECT section, model_name, split, metric, {grid_sql('value')} AS value FROM u")
def run_artifacts(spark, sf):
    """Metrics as one long table, written and read back."""
    found = metrics.finalised(metrics.sufficient(_signals(spark, sf), ["model_name", "split"]))
    return _grids(written(long_metrics(found, "overall", ["model_name", "split"], [*_METRICS, "n"])), ["section", "model_name", "split", "metric"], ["value"])
