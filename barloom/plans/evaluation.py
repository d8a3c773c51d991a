"""Queries over bars, baskets, signals and back-tests, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators import backtest, basket, metrics
from barloom.operators.blocks import positions, scan, with_halo
from barloom.operators.selection import medians, percentiles, row_hash, smallest
from barloom.plans.sql import SPLIT, WEIGHTS, bars_sql, grid_sql, signals_sql
from barloom.sources import bars as src
from barloom.sources.store import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def grid(x: Column | str, digits: int = 6) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x * 10.0**digits + 0.3217).cast("double") / 10.0**digits + 0.0


def _day(x: Column | str = "datetime") -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("date").cast("string")


def _day_sql(x: str = "datetime") -> str:
    return f"CAST(CAST({x} AS DATE) AS VARCHAR)"


def _query(name: str, sql: str | None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _grids(df: DataFrame, keys: list, values: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keys, *[grid(v, digits).alias(v) for v in values])


def _grids_sql(values: list[str], digits: int = 6) -> str:
    return ", ".join(f"{grid_sql(v, digits)} AS {v}" for v in values)


_PRICES = ["open", "high", "low", "close", "vol", "amount"]
for _kind, _name, _make in (("week", "bars_weekly", src.weekly_bars), ("month", "bars_monthly", src.monthly_bars)):
    _query(_name, f"WITH {bars_sql(_kind)} SELECT date, {_day_sql()} AS day, instrument, minute_index, {_grids_sql(_PRICES, 3)}, CAST(trades AS BIGINT) AS trades FROM bars")(
        lambda spark, sf, make=_make: _grids(make(spark, sf), ["date", _day().alias("day"), "instrument", "minute_index", "trades"], _PRICES, 3)
    )


@_query("weights_asof", f"WITH {bars_sql('week')}, {WEIGHTS} SELECT {_day_sql()} AS day, instrument, trade_date, {grid_sql('weight', 8)} AS weight FROM wbars")
def weights_asof(spark, sf):
    bars = src.weekly_bars(spark, sf)
    return src.weighted_bars(bars, src.index_weights(bars)).select(_day().alias("day"), "instrument", "trade_date", grid("weight", 8).alias("weight"))


@_query("session_filter", """SELECT bucket, count(*) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM (SELECT user_id, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS s, hour(ts) * 100 + minute(ts) AS h,
  CASE WHEN h BETWEEN 930 AND 1130 THEN 'morning' WHEN h >= 1300 AND h < 1430 THEN 'afternoon' WHEN h BETWEEN 1430 AND 1500 THEN 'tail' ELSE 'other' END AS bucket FROM events)
WHERE s BETWEEN 34200 AND 41400 OR s BETWEEN 46800 AND 54000 GROUP BY bucket""")
def session_filter(spark, sf):
    events = src.table(spark, sf, "events").where(src.in_session(F.col("ts")))
    return events.groupBy(src.session_bucket(F.col("ts")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


_MARKED = """marked0 AS (SELECT date, datetime, instrument, minute_index, open, high, low, close, amount, CASE WHEN (instrument + minute_index) % 29 = 0 THEN 0.0 ELSE vol END AS vol, lag(close) OVER (PARTITION BY date, instrument ORDER BY datetime) AS prev FROM bars),
marked AS (SELECT * EXCLUDE (prev), coalesce(vol <= 0, false) OR coalesce(amount <= 0, false) OR open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR coalesce(high = low AND abs(close / nullif(prev, 0) - 1) >= 0.095, false) AS invalid_bar FROM marked0)"""


@_query("invalid_bars", f"WITH {bars_sql('month')}, {_MARKED} SELECT {_day_sql()} AS day, instrument, invalid_bar, {grid_sql('CASE WHEN NOT invalid_bar THEN close END', 3)} AS close, {grid_sql('CASE WHEN NOT invalid_bar THEN vol END', 3)} AS vol FROM marked")
def invalid_bars(spark, sf):
    return _grids(src.wiped(src.marked_bars(src.monthly_bars(spark, sf))), [_day().alias("day"), "instrument", "invalid_bar"], ["close", "vol"], 3)


@_query("invalid_after", f"WITH {bars_sql('month')}, {_MARKED} SELECT {_day_sql()} AS day, instrument, {grid_sql('CASE WHEN NOT bool_or(invalid_bar) OVER (PARTITION BY date, instrument ORDER BY datetime) THEN close / open END')} AS masked FROM marked")
def invalid_after(spark, sf):
    seen = F.max("invalid_bar").over(Window.partitionBy("date", "instrument").orderBy("datetime"))
    bars = src.marked_bars(src.monthly_bars(spark, sf)).withColumn("masked", F.when(~seen, F.col("close") / F.col("open")))
    return bars.select(_day().alias("day"), "instrument", grid("masked").alias("masked"))


@_query("forward_label", f"WITH {bars_sql('week')} SELECT {_day_sql()} AS day, instrument, {grid_sql('lead(close, 4) OVER (PARTITION BY date, instrument ORDER BY datetime) / nullif(close, 0) - 1')} AS label FROM bars")
def forward_label(spark, sf):
    return src.forward_label(src.weekly_bars(spark, sf), 4).select(_day().alias("day"), "instrument", grid("label").alias("label"))


@_query("split_counts", f"WITH {bars_sql('week')} SELECT {SPLIT} AS split, date // 100 AS month, count(*) AS n, CAST(min(date) AS INT) AS first_date FROM bars GROUP BY 1, 2")
def split_counts(spark, sf):
    bars = src.weekly_bars(spark, sf)
    return bars.groupBy(src.split_of(F.col("date")).alias("split"), F.floor(F.col("date") / 100).cast("int").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"))


_SAMPLE = "(CAST(date AS BIGINT) * 1000003 + instrument * 10007 + minute_index * 10009) % 50 = 0"


@_query("hash_sample", f"WITH {bars_sql('month')} SELECT {_day_sql()} AS day, instrument, minute_index FROM bars WHERE {_SAMPLE}")
def hash_sample(spark, sf):
    return src.monthly_bars(spark, sf).where(_SAMPLE).select(_day().alias("day"), "instrument", "minute_index")


_ROW_HASH = "(((CAST(date AS BIGINT) * 1000003 + instrument * 10007 + minute_index * 10009) % 2147483647) * 48271) % 2147483647"


@_query("bounded_sample", f"WITH {bars_sql('month')}, l AS (SELECT *, lead(close) OVER (PARTITION BY date, instrument ORDER BY datetime) AS later, {_ROW_HASH} AS h FROM bars) SELECT {_day_sql()} AS day, instrument, minute_index FROM l WHERE later IS NOT NULL AND {SPLIT} = 'train' ORDER BY h, date, instrument, minute_index LIMIT 300")
def bounded_sample(spark, sf):
    """Exactly 300 rows of the labelled train split, those with the least hashes, found by counting."""
    rows = src.forward_label(src.monthly_bars(spark, sf), 1).where("label is not null").where(src.split_of(F.col("date")) == "train")
    kept = smallest(rows, 300, row_hash("date", "instrument", "minute_index"), ["date", "instrument", "minute_index"])
    return kept.select(_day().alias("day"), "instrument", "minute_index")


@_query("time_features", f"WITH {bars_sql('week')} SELECT minute_index // 10 AS bucket, count(*) AS n, CAST(sum(CASE WHEN minute_index < 30 THEN 1 ELSE 0 END) AS BIGINT) AS is_open, CAST(sum(CASE WHEN minute_index >= 22 THEN 1 ELSE 0 END) AS BIGINT) AS is_close FROM bars GROUP BY 1")
def time_features(spark, sf):
    m = F.col("minute_index")
    return src.weekly_bars(spark, sf).groupBy(F.floor(m / 10).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum((m < 30).cast("long")).alias("is_open"), F.sum((m >= 22).cast("long")).alias("is_close"))


def _basket_rows(spark, sf):
    """Weekly signals with as-of weights."""
    bars = src.weekly_bars(spark, sf)
    weights = src.weighted_bars(bars, src.index_weights(bars)).select("date", "datetime", "instrument", "weight")
    return src.signals(bars, 4).join(weights, ["date", "datetime", "instrument"])


_BASKET = f"{bars_sql('week')}, {WEIGHTS}, {signals_sql(4)}, rows_ AS (SELECT s.*, w.weight FROM sig s JOIN wbars w USING (date, datetime, instrument))"
_BASKET_VALUES = ["basket_pred", "basket_label", "weight_coverage_pred"]


def _basket_sql(weight: str) -> str:
    return (
        f"sum(CASE WHEN pred IS NOT NULL THEN {weight} * pred END) / nullif(sum(CASE WHEN pred IS NOT NULL THEN {weight} END), 0) AS basket_pred, sum({weight} * label) / nullif(sum({weight}), 0) AS basket_label, "
        f"coalesce(sum(CASE WHEN pred IS NOT NULL THEN {weight} END), 0) / nullif(sum({weight}), 0) AS weight_coverage_pred"
    )


@_query("basket_index", f"WITH {_BASKET} SELECT model_name, split, {_day_sql()} AS day, {_grids_sql(_BASKET_VALUES)} FROM (SELECT model_name, split, datetime, {_basket_sql('weight')} FROM rows_ GROUP BY 1, 2, 3)")
def basket_index(spark, sf):
    return _grids(basket.aggregate_basket(_basket_rows(spark, sf), ["model_name", "split", "datetime"]), ["model_name", "split", _day().alias("day")], _BASKET_VALUES)


_MODES = " UNION ALL ".join(f"SELECT *, '{m}' AS mode, {w} AS ew FROM rows_" for m, w in (("index", "weight"), ("weight_squared", "weight * weight"), ("weight_times_amount", "weight * amount"), ("effective_amount_weight", "weight * CASE WHEN amount IS NOT NULL THEN 1.0 ELSE 0.0 END")))


@_query("basket_weight_modes", f"WITH {_BASKET}, modes AS ({_MODES}) SELECT mode, model_name, {_day_sql()} AS day, {_grids_sql(_BASKET_VALUES)} FROM (SELECT mode, model_name, datetime, {_basket_sql('ew')} FROM modes GROUP BY 1, 2, 3)")
def basket_weight_modes(spark, sf):
    return _grids(basket.basket_modes(_basket_rows(spark, sf), ["model_name", "datetime"]), ["mode", "model_name", _day().alias("day")], _BASKET_VALUES)


_PLACED = """firsts AS (SELECT date, instrument, arg_min(weight, datetime) AS first_weight FROM rows_ GROUP BY 1, 2),
places AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY first_weight DESC, instrument) AS place FROM firsts), ks AS (SELECT unnest([5, 10, 20]) AS k)"""


@_query("basket_topk_variants", f"WITH {_BASKET}, {_PLACED} SELECT k, model_name, {_day_sql()} AS day, {_grids_sql(_BASKET_VALUES)} FROM (SELECT k, model_name, datetime, {_basket_sql('weight')} FROM rows_ JOIN places USING (date, instrument) JOIN ks ON place <= k GROUP BY 1, 2, 3)")
def basket_topk_variants(spark, sf):
    return _grids(basket.topk_variants(_basket_rows(spark, sf), (5, 10, 20), ["model_name", "datetime"]), ["k", "model_name", _day().alias("day")], _BASKET_VALUES)


_SIZES = (10, 20, 50, 100, 200)
_MONTHLY_BASKET = f"{bars_sql('month')}, {WEIGHTS}, {signals_sql(1)}, rows_ AS (SELECT s.*, w.weight FROM sig s JOIN wbars w USING (date, datetime, instrument))"


@_query("basket_topk_modes", f"WITH {_MONTHLY_BASKET}, modes AS ({_MODES}), {_PLACED.replace('[5, 10, 20]', str(list(_SIZES)))} SELECT k, mode, model_name, {_day_sql()} AS day, {_grids_sql(_BASKET_VALUES)} FROM (SELECT k, mode, model_name, datetime, {_basket_sql('ew')} FROM modes JOIN places USING (date, instrument) JOIN ks ON place <= k GROUP BY 1, 2, 3, 4)")
def basket_topk_modes(spark, sf):
    """Baskets of the 10 to 200 largest weights under each weight mode, all in one job."""
    bars = src.monthly_bars(spark, sf)
    weights = src.weighted_bars(bars, src.index_weights(bars)).select("date", "datetime", "instrument", "weight")
    placed = basket.weight_rank(src.signals(bars, 1).join(weights, ["date", "datetime", "instrument"]))
    sized = placed.select("*", F.explode(F.array(*[F.lit(k) for k in _SIZES])).alias("k")).where("place <= k")
    return _grids(basket.basket_modes(sized, ["k", "model_name", "datetime"]), ["k", "mode", "model_name", _day().alias("day")], _BASKET_VALUES)


@_query("topk_weight_share", f"WITH {_BASKET}, {_PLACED} SELECT k, {grid_sql('avg(share)', 7)} AS share, count(*) AS n_dates FROM (SELECT date, k, sum(CASE WHEN place <= k THEN first_weight END) / sum(first_weight) AS share FROM places, ks GROUP BY 1, 2) GROUP BY k")
def topk_weight_share(spark, sf):
    return _grids(basket.topk_share(_basket_rows(spark, sf), (5, 10, 20)), ["k", "n_dates"], ["share"], 7)


def _component_rows(spark, sf):
    bars = src.weekly_bars(spark, sf)
    return src.weighted_bars(bars, src.index_weights(bars)).select("date", "datetime", "instrument", "close", "amount", "weight")


_STATE = ["weight_coverage"] + [f"{v}_{n}" for n in (1, 5, 10) for v in ("wret", "xs_std", "breadth", "sync", "top20", "rest")]
_STATE_SQL = f"""firsts AS (SELECT date, instrument, arg_min(weight, datetime) AS first_weight FROM wbars GROUP BY 1, 2), places AS (SELECT date, instrument, row_number() OVER (PARTITION BY date ORDER BY first_weight DESC, instrument) AS place FROM firsts),
rets AS (SELECT b.*, place, {", ".join(f"close / nullif(lag(close, {n}) OVER (PARTITION BY date, instrument ORDER BY datetime), 0) - 1 AS r{n}" for n in (1, 5, 10))} FROM wbars b JOIN places USING (date, instrument)),
state AS (SELECT date, datetime, sum(CASE WHEN r1 IS NOT NULL THEN weight END) / nullif(sum(weight), 0) AS weight_coverage, CAST(count(DISTINCT instrument) AS BIGINT) AS n_instruments,
{", ".join(f"sum(weight * r{n}) AS wret_{n}, stddev_samp(r{n}) AS xs_std_{n}, sum(CASE WHEN r{n} > 0 THEN weight END) AS breadth_{n}, abs(sum(weight * r{n})) / nullif(sum(weight * abs(r{n})), 0) AS sync_{n}, sum(CASE WHEN place <= 20 THEN weight * r{n} END) AS top20_{n}, sum(CASE WHEN place > 20 THEN weight * r{n} END) AS rest_{n}" for n in (1, 5, 10))} FROM rets GROUP BY 1, 2)"""


@_query("component_basis", f"WITH {bars_sql('week')}, {WEIGHTS}, {_STATE_SQL} SELECT {_day_sql()} AS day, n_instruments, {_grids_sql(_STATE, 5)} FROM state")
def component_basis(spark, sf):
    return _grids(basket.component_state(_component_rows(spark, sf)), [_day().alias("day"), "n_instruments"], _STATE, 5)


def basis_frame(spark, sf):
    """Fund joined to basket and components, residual label, and its rolling state."""
    bars = src.weekly_bars(spark, sf)
    fund = src.forward_label(bars.groupBy("date", "datetime", "minute_index").agg((F.sum("amount") / F.sum("vol")).alias("close")).withColumn("instrument", F.lit(0)), 4).withColumnRenamed("label", "fund_label")
    b = basket.aggregate_basket(_basket_rows(spark, sf).where("model_name = 'model_a'"), ["date", "datetime"])
    state = basket.component_state(_component_rows(spark, sf)).select("date", "datetime", "wret_1", "weight_coverage")
    joined = fund.join(b, ["date", "datetime"]).join(state, ["date", "datetime"], "left").withColumn("residual", F.col("fund_label") - F.col("basket_label"))
    w = Window.partitionBy("date").orderBy("datetime")
    recent, run = w.rowsBetween(-19, 0), w.rowsBetween(Window.unboundedPreceding, 0)
    enough = F.count("residual").over(recent) >= 5
    return joined.withColumns({"roll_mean": F.when(enough, F.avg("residual").over(recent)), "roll_std": F.when(enough, F.stddev_samp("residual").over(recent)), "cum_wret": F.sum(F.coalesce("wret_1", F.lit(0.0))).over(run)})


_BASIS = ["fund_label", "basket_pred", "residual", "roll_mean", "roll_std", "cum_wret"]
_BASIS_SQL = f"""{_BASKET}, {_STATE_SQL}, fund0 AS (SELECT date, datetime, sum(amount) / sum(vol) AS close FROM bars GROUP BY 1, 2), fund AS (SELECT *, lead(close, 4) OVER (PARTITION BY date ORDER BY datetime) / nullif(close, 0) - 1 AS fund_label FROM fund0),
bk AS (SELECT date, datetime, {_basket_sql('weight')} FROM rows_ WHERE model_name = 'model_a' GROUP BY 1, 2),
bf AS (SELECT fund.date, datetime, fund_label, basket_pred, basket_label, fund_label - basket_label AS residual, wret_1 FROM fund JOIN bk USING (date, datetime) LEFT JOIN state USING (date, datetime)),
basis AS (SELECT *, CASE WHEN count(residual) OVER r >= 5 THEN avg(residual) OVER r END AS roll_mean, CASE WHEN count(residual) OVER r >= 5 THEN stddev_samp(residual) OVER r END AS roll_std, sum(coalesce(wret_1, 0)) OVER (PARTITION BY date ORDER BY datetime ROWS UNBOUNDED PRECEDING) AS cum_wret
FROM bf WINDOW r AS (PARTITION BY date ORDER BY datetime ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""


@_query("basis_frame", f"WITH {_BASIS_SQL} SELECT {_day_sql()} AS day, {_grids_sql(_BASIS, 5)} FROM basis")
def basis_query(spark, sf):
    return _grids(basis_frame(spark, sf), [_day().alias("day")], _BASIS, 5)


def _signals(spark, sf):
    return src.signals(src.monthly_bars(spark, sf), 1)


_SIG = f"{bars_sql('month')}, {signals_sql(1)}, ok AS (SELECT *, pred - label AS e FROM sig WHERE pred IS NOT NULL AND label IS NOT NULL)"
_METRICS = ["ic", "rmse", "mae", "direction_acc"]
_METRICS_SQL = "CASE WHEN count(*) >= 2 THEN covar_pop(pred, label) / nullif(stddev_pop(pred) * stddev_pop(label), 0) END AS ic, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, avg(CASE WHEN (pred > 0) = (label > 0) THEN 1e0 ELSE 0e0 END) AS direction_acc, count(*) AS n"
for _name, _by in (("pooled_metrics", ["model_name"]), ("metrics_overall", ["model_name", "split"]), ("metrics_by_year", ["model_name", "date"])):
    _keys = ", ".join(_by)
    _query(_name, f"WITH {_SIG} SELECT {_keys}, n, {_grids_sql(_METRICS)} FROM (SELECT {_keys}, {_METRICS_SQL} FROM ok GROUP BY {_keys})")(
        lambda spark, sf, by=_by: _grids(metrics.finalised(metrics.sufficient(_signals(spark, sf), by)), [*by, "n"], _METRICS)
    )

_RANKED = """ranked AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY pred) + (count(*) OVER (PARTITION BY {by}, pred) - 1) / 2e0 AS pr, rank() OVER (PARTITION BY {by} ORDER BY label) + (count(*) OVER (PARTITION BY {by}, label) - 1) / 2e0 AS yr FROM ok)"""
_DAILY = f"{_SIG}, {_RANKED.format(by='model_name, datetime')}, daily AS (SELECT model_name, split, datetime, {_METRICS_SQL}, CASE WHEN count(*) >= 2 THEN covar_pop(pr, yr) / nullif(stddev_pop(pr) * stddev_pop(yr), 0) END AS rank_ic FROM ranked GROUP BY 1, 2, 3)"


def _panel_daily(spark, sf):
    return metrics.daily_metrics(_signals(spark, sf), ["model_name", "split", "datetime"])


@_query("panel_ic_minute", f"WITH {_DAILY} SELECT model_name, split, {_day_sql()} AS day, n, {_grids_sql([*_METRICS, 'rank_ic'])} FROM daily")
def panel_ic_minute(spark, sf):
    return _grids(_panel_daily(spark, sf), ["model_name", "split", _day().alias("day"), "n"], [*_METRICS, "rank_ic"])


@_query("metrics_rolling", f"WITH {_DAILY} SELECT model_name, {_day_sql()} AS day, {_grids_sql(['roll_20', 'cum_ic'])} FROM (SELECT model_name, datetime, CASE WHEN count(ic) OVER r = 20 THEN avg(ic) OVER r END AS roll_20, sum(coalesce(ic, 0)) OVER (PARTITION BY model_name ORDER BY datetime ROWS UNBOUNDED PRECEDING) AS cum_ic FROM daily WINDOW r AS (PARTITION BY model_name ORDER BY datetime ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))")
def metrics_rolling(spark, sf):
    """Rolling mean and running sum of the ICs; a model's times are worked on in ranges and blocks."""
    daily = positions(_panel_daily(spark, sf).select("model_name", "datetime", "ic"), ["model_name"], "datetime")
    summed = scan(daily, ["model_name"], "part_", "datetime", {"cum_ic": ("sum", F.coalesce("ic", F.lit(0.0)))})
    cut = with_halo(summed, 19)
    out = cut.withColumn("roll_20", metrics.rolling("ic", 20, ["model_name", "block_"], "datetime")).where("own_")
    return _grids(out, ["model_name", _day().alias("day")], ["roll_20", "cum_ic"])


@_query("metrics_icir", f"WITH {_DAILY} SELECT model_name, split, count(*) AS days, {_grids_sql(['ic_mean', 'icir', 'rank_icir'])} , n_positive FROM (SELECT model_name, split, count(*) AS c, avg(ic) AS ic_mean, avg(ic) / nullif(stddev_samp(ic), 0) AS icir, avg(rank_ic) / nullif(stddev_samp(rank_ic), 0) AS rank_icir, CAST(sum(CASE WHEN ic > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive FROM daily GROUP BY 1, 2) GROUP BY ALL".replace("count(*) AS days", "c AS days").replace(" GROUP BY ALL", ""))
def metrics_icir(spark, sf):
    daily = _panel_daily(spark, sf)
    ratio = lambda c: F.avg(c) / F.nullif(F.stddev_samp(c), F.lit(0.0))
    out = daily.groupBy("model_name", "split").agg(F.count(F.lit(1)).alias("days"), F.avg("ic").alias("ic_mean"), ratio("ic").alias("icir"), ratio("rank_ic").alias("rank_icir"), F.sum((F.coalesce("ic", F.lit(0.0)) > 0).cast("long")).alias("n_positive"))
    return _grids(out, ["model_name", "split", "days", "n_positive"], ["ic_mean", "icir", "rank_icir"])


_STOCK = f"""{_SIG}, stock AS (SELECT model_name, instrument, {_METRICS_SQL} FROM ok GROUP BY 1, 2), verdicts AS (SELECT *, ic * sqrt((n - 2) / nullif(1 - ic * ic, 0)) AS ic_t FROM stock)"""


def _stock(spark, sf):
    return metrics.finalised(metrics.sufficient(_signals(spark, sf), ["model_name", "instrument"]))


@_query("stock_metrics_verdict", f"WITH {_STOCK} SELECT model_name, instrument, n, {_grids_sql(['ic', 'rmse', 'mae'])}, CASE WHEN ic >= 0.05 AND ic_t >= 2 THEN 'good' WHEN ic <= -0.05 AND ic_t <= -2 THEN 'bad' ELSE 'neutral' END AS verdict FROM verdicts")
def stock_metrics_verdict(spark, sf):
    ic, t = F.col("ic"), F.col("ic_t")
    verdict = F.when((ic >= 0.05) & (t >= 2), "good").when((ic <= -0.05) & (t <= -2), "bad").otherwise("neutral")
    return _grids(_stock(spark, sf).withColumn("verdict", verdict), ["model_name", "instrument", "n", "verdict"], ["ic", "rmse", "mae"])


@_query("ic_quantiles", f"WITH {_STOCK} SELECT model_name, {grid_sql('quantile_cont(ic, 0.05)')} AS q05, {grid_sql('quantile_cont(ic, 0.5)')} AS q50, {grid_sql('quantile_cont(ic, 0.95)')} AS q95, count(*) AS n FROM stock GROUP BY 1")
def ic_quantiles(spark, sf):
    stock = written(_stock(spark, sf).select("model_name", "ic"))
    out = percentiles(stock, ["model_name"], "ic", {"q05": 0.05, "q50": 0.5, "q95": 0.95}).join(stock.groupBy("model_name").agg(F.count(F.lit(1)).alias("n")), "model_name")
    return _grids(out, ["model_name", "n"], ["q05", "q50", "q95"])


_ERRORS = ["bias", "bias_std", "err_q05", "err_q50", "err_q95", "abs_q95"]


@_query("error_summary", f"WITH {_SIG} SELECT model_name, split, {_grids_sql(_ERRORS)} FROM (SELECT model_name, split, avg(e) AS bias, stddev_pop(e) AS bias_std, quantile_cont(e, 0.05) AS err_q05, quantile_cont(e, 0.5) AS err_q50, quantile_cont(e, 0.95) AS err_q95, quantile_cont(abs(e), 0.95) AS abs_q95 FROM ok GROUP BY 1, 2)")
def error_summary(spark, sf):
    """Mean, spread and exact percentiles of the errors; the percentiles are selected, no task holds a group's errors."""
    by, error = ["model_name", "split"], F.col("pred") - F.col("label")
    rows = written(_signals(spark, sf).where("pred is not null and label is not null").select(*by, error.alias("e")))
    kinds = F.explode(F.array(F.struct(F.lit("e").alias("kind"), F.col("e").alias("v")), F.struct(F.lit("abs").alias("kind"), F.abs("e").alias("v")))).alias("x")
    found = percentiles(rows.select(*by, kinds).select(*by, "x.*"), [*by, "kind"], "v", {"q05": 0.05, "q50": 0.5, "q95": 0.95})
    signed = found.where("kind = 'e'").select(*by, *[F.col(q).alias(f"err_{q}") for q in ("q05", "q50", "q95")])
    out = rows.groupBy(*by).agg(F.avg("e").alias("bias"), F.stddev_pop("e").alias("bias_std")).join(signed, by).join(found.where("kind = 'abs'").select(*by, F.col("q95").alias("abs_q95")), by)
    return _grids(out, ["model_name", "split"], _ERRORS)


@_query("ols_summary", f"WITH {_SIG} SELECT model_name, {_grids_sql(['slope', 'intercept', 'r2'])} FROM (SELECT model_name, regr_slope(label, pred) AS slope, regr_intercept(label, pred) AS intercept, regr_r2(label, pred) AS r2 FROM ok WHERE split = 'train' GROUP BY 1)")
def ols_summary(spark, sf):
    rows = _signals(spark, sf).where("pred is not null and label is not null and split = 'train'")
    return _grids(rows.groupBy("model_name").agg(F.regr_slope("label", "pred").alias("slope"), F.regr_intercept("label", "pred").alias("intercept"), F.regr_r2("label", "pred").alias("r2")), ["model_name"], ["slope", "intercept", "r2"])


@_query("target_alignment", f"WITH {_SIG}, fit AS (SELECT model_name, regr_slope(label, pred) AS b, regr_intercept(label, pred) AS a FROM ok WHERE split = 'train' GROUP BY 1) SELECT model_name, split, {grid_sql('avg(a + b * pred)')} AS aligned, {grid_sql('sqrt(avg((a + b * pred - label) ** 2))')} AS rmse FROM ok JOIN fit USING (model_name) GROUP BY 1, 2")
def target_alignment(spark, sf):
    rows = _signals(spark, sf).where("pred is not null and label is not null")
    fit = rows.where("split = 'train'").groupBy("model_name").agg(F.regr_slope("label", "pred").alias("b"), F.regr_intercept("label", "pred").alias("a"))
    out = rows.join(fit, "model_name").withColumn("p", F.col("a") + F.col("b") * F.col("pred"))
    out = out.groupBy("model_name", "split").agg(F.avg("p").alias("aligned"), F.sqrt(F.avg((F.col("p") - F.col("label")) ** 2)).alias("rmse"))
    return _grids(out, ["model_name", "split"], ["aligned", "rmse"])


@_query("calibration_buckets", f"WITH {_SIG}, b AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY pred, instrument, datetime) AS r, count(*) OVER (PARTITION BY model_name) AS c FROM ok) SELECT model_name, bucket, count(*) AS n, {grid_sql('avg(pred) * 1e4', 3)} AS pred_bps, {grid_sql('avg(label) * 1e4', 3)} AS label_bps FROM (SELECT *, CAST(greatest(1, ceil((r - 1) * 10e0 / (c - 1))) AS INT) AS bucket FROM b) GROUP BY 1, 2")
def calibration_buckets(spark, sf):
    """Ten buckets of equal count by prediction, ties in row order; ranks by range, not in one task."""
    rows = _signals(spark, sf).where("pred is not null and label is not null").withColumn("o", F.struct("model_name", "pred", "instrument", "datetime"))
    ranked = metrics.global_rank(rows, "o", "r")
    ends = ranked.groupBy("model_name").agg(F.min("r").alias("r0"), F.count(F.lit(1)).alias("c"))
    out = ranked.join(ends, "model_name").withColumn("bucket", F.greatest(F.lit(1), F.ceil((F.col("r") - F.col("r0")) * 10 / (F.col("c") - 1))).cast("int"))
    out = out.groupBy("model_name", "bucket").agg(F.count(F.lit(1)).alias("n"), (F.avg("pred") * 1e4).alias("pred_bps"), (F.avg("label") * 1e4).alias("label_bps"))
    return _grids(out, ["model_name", "bucket", "n"], ["pred_bps", "label_bps"], 3)


@_query("histogram", f"WITH {_SIG}, x AS (SELECT model_name, min(e) AS lo, max(e) AS hi FROM ok GROUP BY 1) SELECT model_name, least(49, CAST(floor((e - lo) / (hi - lo) * 50) AS INT)) AS bin, count(*) AS n FROM ok JOIN x USING (model_name) GROUP BY 1, 2")
def histogram(spark, sf):
    rows = _signals(spark, sf).where("pred is not null and label is not null").withColumn("e", F.col("pred") - F.col("label"))
    ends = rows.groupBy("model_name").agg(F.min("e").alias("lo"), F.max("e").alias("hi"))
    return rows.join(ends, "model_name").groupBy("model_name", F.least(F.lit(49), F.floor((F.col("e") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 50).cast("int")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@_query("zscore", f"WITH {_SIG}, z AS (SELECT model_name, avg(pred) AS m, stddev_pop(pred) AS s FROM ok WHERE split = 'train' GROUP BY 1) SELECT model_name, {_day_sql()} AS day, instrument, {grid_sql('(pred - m) / nullif(s, 0)')} AS z FROM ok JOIN z USING (model_name)")
def zscore(spark, sf):
    rows = _signals(spark, sf).where("pred is not null and label is not null")
    stats = rows.where("split = 'train'").groupBy("model_name").agg(F.avg("pred").alias("m"), F.stddev_pop("pred").alias("s"))
    return rows.join(F.broadcast(stats), "model_name").select("model_name", _day().alias("day"), "instrument", grid((F.col("pred") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0))).alias("z"))  # one row per model


def _backtest(spark, sf):
    """Basket predictions on the weekly fund."""
    bars = src.weekly_bars(spark, sf)
    fund = bars.groupBy("date", "datetime").agg((F.sum("amount") / F.sum("vol")).alias("close")).withColumn("instrument", F.lit(0))
    series = src.forward_label(fund, 4).drop("instrument").join(basket.aggregate_basket(_basket_rows(spark, sf), ["model_name", "date", "datetime"]).select("model_name", "date", "datetime", F.col("basket_pred").alias("pred")), ["date", "datetime"])
    return series, backtest.trades(series, 4)


_TRADES = f"""{_BASKET}, fund0 AS (SELECT date, datetime, sum(amount) / sum(vol) AS close FROM bars GROUP BY 1, 2), fund AS (SELECT *, lead(close, 4) OVER (PARTITION BY date ORDER BY datetime) / nullif(close, 0) - 1 AS label FROM fund0),
bk AS (SELECT model_name, date, datetime, {_basket_sql('weight')} FROM rows_ GROUP BY 1, 2, 3),
series AS (SELECT model_name, f.date, datetime, close, label, basket_pred AS pred, row_number() OVER w - 1 AS row_in_day, lead(datetime, 4) OVER w AS exit_datetime FROM fund f JOIN bk USING (date, datetime) WINDOW w AS (PARTITION BY model_name, f.date ORDER BY datetime)),
trades AS (SELECT *, sign(pred) * label AS strategy_ret FROM series WHERE row_in_day % 4 = 0 AND pred IS NOT NULL AND label IS NOT NULL AND exit_datetime IS NOT NULL)"""
_CURVE = f"""{_TRADES}, growth AS (SELECT model_name, exit_datetime AS datetime, product(product(1 + strategy_ret)) OVER (PARTITION BY model_name ORDER BY exit_datetime) AS equity FROM trades GROUP BY 1, 2),
grid_ AS (SELECT model_name, f.datetime, f.close FROM (SELECT DISTINCT model_name FROM trades) CROSS JOIN fund0 f),
curve0 AS (SELECT model_name, datetime, coalesce(last_value(equity IGNORE NULLS) OVER w, 1.0) AS equity, close / first_value(close) OVER w AS benchmark FROM grid_ LEFT JOIN growth USING (model_name, datetime) WINDOW w AS (PARTITION BY model_name ORDER BY datetime ROWS UNBOUNDED PRECEDING)),
curve AS (SELECT *, equity / max(equity) OVER (PARTITION BY model_name ORDER BY datetime ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM curve0)"""


@_query("backtest_trades", f"WITH {_TRADES} SELECT model_name, {_day_sql()} AS day, {_day_sql('exit_datetime')} AS exit_day, CAST(row_in_day AS INT) AS row_in_day, CAST(sign(pred) AS DOUBLE) AS position, {grid_sql('strategy_ret')} AS strategy_ret FROM trades")
def backtest_trades(spark, sf):
    done = _backtest(spark, sf)[1]
    return done.select("model_name", _day().alias("day"), _day("exit_datetime").alias("exit_day"), F.col("row_in_day").cast("int").alias("row_in_day"), "position", grid("strategy_ret").alias("strategy_ret"))


def _curve(spark, sf):
    series, done = _backtest(spark, sf)
    prices = src.weekly_bars(spark, sf).groupBy("datetime").agg((F.sum("amount") / F.sum("vol")).alias("close"))
    return backtest.equity_curve(done, prices), done


@_query("backtest_curve", f"WITH {_CURVE} SELECT model_name, {_day_sql()} AS day, {_grids_sql(['equity', 'benchmark', 'drawdown'])} FROM curve")
def backtest_curve(spark, sf):
    return _grids(_curve(spark, sf)[0], ["model_name", _day().alias("day")], ["equity", "benchmark", "drawdown"])


@_query("backtest_summary", f"WITH {_CURVE} SELECT c.model_name, n_trades, {_grids_sql(['end_equity', 'end_benchmark', 'max_drawdown_pct', 'total_pct', 'excess_bps'], 3)} FROM (SELECT model_name, arg_max(equity, datetime) AS end_equity, arg_max(benchmark, datetime) AS end_benchmark, 100 * min(drawdown) AS max_drawdown_pct, 100 * (arg_max(equity, datetime) - 1) AS total_pct, 1e4 * (arg_max(equity, datetime) / arg_max(benchmark, datetime) - 1) AS excess_bps FROM curve GROUP BY 1) c JOIN (SELECT model_name, count(*) AS n_trades FROM trades GROUP BY 1) t USING (model_name)")
def backtest_summary(spark, sf):
    curve, done = _curve(spark, sf)
    return _grids(backtest.summary(curve, done), ["model_name", "n_trades"], ["end_equity", "end_benchmark", "max_drawdown_pct", "total_pct", "excess_bps"], 3)


_FACTS = ["amount", "vol", "ret"]


@_query("regime_metrics", f"""WITH {_SIG}, facts AS (SELECT date, sum(amount) AS amount, avg(abs(label)) AS vol, avg(label) AS ret FROM sig WHERE model_name = 'model_a' GROUP BY 1), med AS (SELECT median(amount) AS m_amount, median(vol) AS m_vol, median(ret) AS m_ret FROM facts),
labels_ AS (SELECT date, 'amount' AS family, CASE WHEN coalesce(amount >= m_amount, false) THEN 'high' ELSE 'low' END AS regime FROM facts, med UNION ALL SELECT date, 'vol', CASE WHEN coalesce(vol >= m_vol, false) THEN 'high' ELSE 'low' END FROM facts, med UNION ALL SELECT date, 'ret', CASE WHEN coalesce(ret >= m_ret, false) THEN 'high' ELSE 'low' END FROM facts, med)
SELECT model_name, family, regime, n, {_grids_sql(_METRICS)} FROM (SELECT model_name, family, regime, {_METRICS_SQL} FROM ok JOIN labels_ USING (date) GROUP BY 1, 2, 3)""")
def regime_metrics(spark, sf):
    """Each date's facts against their medians, all families in one job.

    The facts are written once: sums of doubles differ in their last digits from one
    computation to the next, and the date that is the median itself would fall below it.
    """
    rows = src.signals(written(src.monthly_bars(spark, sf)), 1)
    facts = written(rows.where("model_name = 'model_a'").groupBy("date").agg(F.sum("amount").alias("amount"), F.avg(F.abs("label")).alias("vol"), F.avg("label").alias("ret")))
    med = medians(facts, _FACTS).withColumn("one", F.lit(1))
    high = lambda c: F.when(F.coalesce(F.col(c) >= F.col(f"m_{c}"), F.lit(False)), "high").otherwise("low")
    labels = facts.withColumn("one", F.lit(1)).join(F.broadcast(med), "one").select("date", F.explode(F.array(*[F.struct(F.lit(c).alias("family"), high(c).alias("regime")) for c in _FACTS])).alias("r")).select("date", "r.*")  # one row of medians
    return _grids(metrics.finalised(metrics.sufficient(rows.join(labels, "date"), ["model_name", "family", "regime"])), ["model_name", "family", "regime", "n"], _METRICS)


@_query("lookahead_check", f"WITH {_SIG}, p AS (SELECT date, instrument, close, row_number() OVER (PARTITION BY date, instrument ORDER BY datetime) AS k FROM bars), l AS (SELECT date, instrument, label, row_number() OVER (PARTITION BY date, instrument ORDER BY datetime) AS k FROM sig WHERE model_name = 'model_a') SELECT l.date, count(*) AS n, CAST(sum(CASE WHEN abs(label - (b.close / a.close - 1)) > 1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS mismatches FROM l JOIN p a USING (date, instrument, k) JOIN p b ON b.date = l.date AND b.instrument = l.instrument AND b.k = l.k + 1 GROUP BY 1")
def lookahead_check(spark, sf):
    """Every label recomputed by an equal join on the row number ahead."""
    w = Window.partitionBy("date", "instrument").orderBy("datetime")
    bars = src.monthly_bars(spark, sf)
    prices = bars.select("date", "instrument", "close", F.row_number().over(w).alias("k"))
    labels = src.forward_label(bars, 1).select("date", "instrument", "label", F.row_number().over(w).alias("k"))
    joined = labels.join(prices, ["date", "instrument", "k"]).join(prices.select("date", "instrument", (F.col("k") - 1).alias("k"), F.col("close").alias("later")), ["date", "instrument", "k"])
    return joined.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum((F.abs(F.col("label") - (F.col("later") / F.col("close") - 1)) > 1e-9).cast("long")).alias("mismatches"))


@_query("calendar_missing_days", f"WITH {bars_sql('month')}, d AS (SELECT DISTINCT datetime FROM bars), c AS (SELECT instrument, datetime FROM (SELECT DISTINCT instrument FROM bars) CROSS JOIN d) SELECT c.instrument, count(*) AS n_missing, {_day_sql('min(c.datetime)')} AS first_missing FROM c ANTI JOIN bars b ON b.instrument = c.instrument AND b.datetime = c.datetime GROUP BY 1")
def calendar_missing_days(spark, sf):
    from barloom.plans.panel import densify

    bars = src.monthly_bars(spark, sf)
    missing = densify(bars.select("datetime", "instrument", "close")).join(bars.select("datetime", "instrument"), ["datetime", "instrument"], "left_anti")
    return missing.groupBy("instrument").agg(F.count(F.lit(1)).alias("n_missing"), F.min("datetime").cast("date").cast("string").alias("first_missing"))


@_query("panel_history", f"WITH {bars_sql('week')}, dates AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM bars)), h AS (SELECT e.date AS eval_day, b.*, row_number() OVER (PARTITION BY e.date, instrument ORDER BY datetime DESC) AS back FROM dates e JOIN dates p ON p.pos BETWEEN e.pos - 2 AND e.pos - 1 JOIN bars b ON b.date = p.date) SELECT eval_day, instrument, count(*) AS bars, {_day_sql('min(datetime)')} AS first_bar, {grid_sql('avg(close)', 2)} AS mean_close FROM h WHERE back <= 250 GROUP BY 1, 2")
def panel_history(spark, sf):
    """The last 250 bars of each instrument before every date, from its two dates before."""
    bars = src.weekly_bars(spark, sf)
    dates = bars.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")))  # the calendar, one row per date
    ahead = dates.select(F.col("date").alias("eval_day"), F.explode(F.array(F.col("pos") - 2, F.col("pos") - 1)).alias("pos")).join(dates, "pos").select("eval_day", "date")
    rows = bars.join(ahead, "date").withColumn("back", F.row_number().over(Window.partitionBy("eval_day", "instrument").orderBy(F.desc("datetime"))))
    return _grids(rows.where("back <= 250").groupBy("eval_day", "instrument").agg(F.count(F.lit(1)).alias("bars"), F.min("datetime").cast("date").cast("string").alias("first_bar"), F.avg("close").alias("mean_close")), ["eval_day", "instrument", "bars", "first_bar"], ["mean_close"], 2)


@_query("pooled_rank_ic", f"WITH {_SIG}, {_RANKED.format(by='model_name')} SELECT model_name, {grid_sql('covar_pop(pr, yr) / nullif(stddev_pop(pr) * stddev_pop(yr), 0)')} AS rank_ic, count(*) AS n FROM ranked GROUP BY 1")
def pooled_rank_ic(spark, sf):
    """Rank correlation over all rows of a model, with ranks by range."""
    rows = _signals(spark, sf).where("pred is not null and label is not null").withColumns({"op": F.struct("model_name", "pred"), "oy": F.struct("model_name", "label")})
    ranked = metrics.global_rank(metrics.global_rank(rows, "op", "pr"), "oy", "yr")
    out = ranked.groupBy("model_name").agg((F.covar_pop("pr", "yr") / F.nullif(F.stddev_pop("pr") * F.stddev_pop("yr"), F.lit(0.0))).alias("rank_ic"), F.count(F.lit(1)).alias("n"))
    return _grids(out, ["model_name", "n"], ["rank_ic"])


_HORIZONS = (1, 2, 3, 6)


@_query("horizon_compare", f"WITH {bars_sql('month')}, l AS (SELECT instrument, datetime, -(close / nullif(lag(close) OVER (PARTITION BY instrument ORDER BY datetime), 0) - 1) AS pred, {', '.join(f'lead(close, {h}) OVER (PARTITION BY date, instrument ORDER BY datetime) / nullif(close, 0) - 1 AS y{h}' for h in _HORIZONS)} FROM bars), u AS ({' UNION ALL '.join(f'SELECT {h} AS horizon, pred, y{h} AS label FROM l' for h in _HORIZONS)}), ok AS (SELECT *, pred - label AS e FROM u WHERE pred IS NOT NULL AND label IS NOT NULL), m AS (SELECT horizon, {_METRICS_SQL} FROM ok GROUP BY 1) SELECT horizon, n, {_grids_sql(_METRICS)}, ic = max(ic) OVER () AS best FROM m")
def horizon_compare(spark, sf):
    """One signal against several horizons in one job; the best by IC is marked."""
    w, ahead = Window.partitionBy("instrument").orderBy("datetime"), Window.partitionBy("date", "instrument").orderBy("datetime")
    bars = src.monthly_bars(spark, sf)
    labels = F.array(*[F.struct(F.lit(h).alias("horizon"), (F.lead("close", h).over(ahead) / F.nullif(F.col("close"), F.lit(0.0)) - 1).alias("label")) for h in _HORIZONS])
    rows = bars.select(labels.alias("ls"), (-(F.col("close") / F.nullif(F.lag("close").over(w), F.lit(0.0)) - 1)).alias("pred")).select("pred", F.explode("ls").alias("l")).select("pred", "l.*")
    out = metrics.finalised(metrics.sufficient(rows, ["horizon"]))
    best = out.agg(F.max("ic").alias("top")).withColumn("one", F.lit(1))
    return _grids(out.withColumn("one", F.lit(1)).join(F.broadcast(best), "one").withColumn("best", F.col("ic") == F.col("top")), ["horizon", "n", "best"], _METRICS)  # one row
