"""Queries over what is stored by day: day files, kept sums, day stores, each with the DuckDB SQL over the tables they came from."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators import metrics
from barloom.operators.kept import KeptSums
from barloom.plans.evaluation import _METRICS_SQL, _SIG, _day, _day_sql, _grids, _grids_sql, _query, _signals
from barloom.plans.sql import bars_sql, grid_sql
from barloom.sources import bars as src
from barloom.sources import day_files
from barloom.sources.store import DayStore, RunStore, shared_dir, written

_DATED = f"{bars_sql('month')}, dated AS (SELECT *, CAST(strftime(datetime, '%Y%m%d') AS INT) AS day_ FROM bars)"


def _stored_bars(spark, sf) -> str:
    """Monthly bars of suppliers as day files; their folder."""
    root = f"{shared_dir(spark)}/day-files-{uuid.uuid4().hex}"
    bars = src.monthly_bars(spark, sf).drop("date").withColumn("date", day_files.day_of("datetime"))
    day_files.write_days(bars, root, ["instrument"])
    return root


@_query("bars_day_files", f"WITH {_DATED} SELECT day_ AS date, instrument, {_day_sql()} AS day, {_grids_sql(['open', 'close', 'vol'], 3)} FROM dated WHERE day_ BETWEEN 19960301 AND 19990930 AND vol > 50")
def bars_day_files(spark, sf) -> DataFrame:
    """A range of dates read from day files: other files stay closed, and only five columns are read."""
    rows = day_files.read_days(spark, _stored_bars(spark, sf), "date int, datetime timestamp_ntz, instrument long, open double, close double, vol double")
    return _grids(rows.where("date between 19960301 and 19990930 and vol > 50"), ["date", "instrument", _day().alias("day")], ["open", "close", "vol"], 3)


@_query("fund_day_files", f"WITH {_DATED} SELECT day_ AS date, minute_index, {_grids_sql(['close', 'vol', 'amount'], 3)} FROM dated WHERE instrument = 7")
def fund_day_files(spark, sf) -> DataFrame:
    """One instrument's bars from all day files, with the columns that the fund needs."""
    rows = day_files.read_days(spark, _stored_bars(spark, sf), "date int, minute_index int, instrument long, close double, vol double, amount double")
    return _grids(rows.where("instrument = 7"), ["date", "minute_index"], ["close", "vol", "amount"], 3)


@_query("calendar_day_files", f"WITH {_DATED}, c AS (SELECT DISTINCT day_ AS date FROM dated) SELECT date, lag(date) OVER (ORDER BY date) AS before, lag(date, 2) OVER (ORDER BY date) AS before_2 FROM c QUALIFY date >= 19960101")
def calendar_day_files(spark, sf) -> DataFrame:
    """The calendar from the names of the files, with the two dates before each."""
    w = Window.orderBy("date")  # one row per file
    dates = day_files.calendar(spark, _stored_bars(spark, sf))
    return dates.select("date", F.lag("date").over(w).alias("before"), F.lag("date", 2).over(w).alias("before_2")).where("date >= 19960101")


# Kept sums and manifests.

_KEPT = ["ic", "rmse", "mae", "direction_acc"]


def kept_by_day(spark, sf) -> KeptSums:
    """Signals put in by year: all up to 1999, then 2000 with wrong labels, then 2000 anew together with 2001."""
    rows = _signals(spark, sf).select("model_name", "instrument", "date", "pred", "label")
    kept = KeptSums(spark, ["model_name", "instrument"])
    kept.put(rows.where("date < 20000101"))
    kept.put(rows.where("date = 20000101").withColumn("label", 3 * F.col("label") - 1))
    kept.put(rows.where("date >= 20000101"))
    return kept


@_query("metrics_kept", f"WITH {_SIG} SELECT model_name, instrument, n, {_grids_sql(_KEPT)} FROM (SELECT model_name, instrument, {_METRICS_SQL} FROM ok GROUP BY 1, 2)")
def metrics_kept(spark, sf) -> DataFrame:
    """Metrics of each stock from kept totals, after a day was replaced."""
    return _grids(metrics.finalised(kept_by_day(spark, sf).totals()), ["model_name", "instrument", "n"], _KEPT)


@_query("metrics_kept_daily", f"WITH {_SIG} SELECT model_name, instrument, date, n, {_grids_sql(_KEPT)} FROM (SELECT model_name, instrument, date, {_METRICS_SQL} FROM ok GROUP BY 1, 2, 3)")
def metrics_kept_daily(spark, sf) -> DataFrame:
    """Metrics of each stock and date from the same store."""
    return _grids(metrics.finalised(kept_by_day(spark, sf).days()), ["model_name", "instrument", "date", "n"], _KEPT)


@_query("panel_manifest", f"WITH {bars_sql('month')} SELECT date, CASE date // 10000 WHEN 1995 THEN 'hit' WHEN 1996 THEN 'backfilled' ELSE 'built' END AS state, count(*) AS rows, {grid_sql('sum(close)', 1)} AS close, {grid_sql('sum(amount)', 1)} AS amount FROM bars GROUP BY 1, 2")
def panel_manifest(spark, sf) -> DataFrame:
    """Days in four states: complete (1995), without a column (1996), by another factor set (1997), not stored; each is mended by what it needs."""
    bars = written(src.monthly_bars(spark, sf))
    set_hash = lambda names: hashlib.sha256(repr(sorted(names)).encode()).hexdigest()
    other = DayStore(spark, made_by=set_hash(["close"]))
    other.write(bars.where("date = 19970101").withColumn("close", F.lit(-1.0)))
    store = DayStore(spark, other.path, made_by=set_hash(["close", "amount"]))
    store.write(bars.where("date = 19950101"))
    store.write(bars.where("date = 19960101").drop("amount"))
    days = store.prebuild(bars)
    filled = store.backfill(bars, "amount", bars, ["date", "datetime", "instrument", "minute_index"])
    state = days.join(filled.withColumn("late", F.lit(True)), "date", "left").select("date", F.when(F.col("late"), "backfilled").when(F.col("hit"), "hit").otherwise("built").alias("state"))
    stored = store.read(bars).groupBy("date").agg(F.sum("close").alias("close"), F.sum("amount").alias("amount"))
    return _grids(stored.join(state, "date").join(store.current(bars.columns).select("date", "rows"), "date"), ["date", "state", "rows"], ["close", "amount"], 1)


_AHEAD = (1, 2, 3, 6)


def _horizon_metrics(bars: DataFrame, horizon: int, sign: int) -> DataFrame:
    before = F.lag("close").over(Window.partitionBy("instrument").orderBy("datetime"))
    rows = src.forward_label(bars, horizon).withColumn("pred", sign * (F.col("close") / F.nullif(before, F.lit(0.0)) - 1))
    return metrics.finalised(metrics.sufficient(rows.withColumn("horizon", F.lit(horizon)), ["horizon"])).select("horizon", "n", *_KEPT)


@_query("horizon_latest_runs", f"WITH {bars_sql('month')}, l AS (SELECT -(close / nullif(lag(close) OVER (PARTITION BY instrument ORDER BY datetime), 0) - 1) AS pred, {', '.join(f'lead(close, {h}) OVER (PARTITION BY date, instrument ORDER BY datetime) / nullif(close, 0) - 1 AS y{h}' for h in _AHEAD)} FROM bars), u AS ({' UNION ALL '.join(f'SELECT {h} AS horizon, CASE WHEN {h} = 6 THEN -pred ELSE pred END AS pred, y{h} AS label FROM l' for h in _AHEAD)}), ok AS (SELECT *, pred - label AS e FROM u WHERE pred IS NOT NULL AND label IS NOT NULL) SELECT horizon, CASE WHEN horizon = 6 THEN 'first' ELSE 'second' END AS run, n, {_grids_sql(_KEPT)} FROM (SELECT horizon, {_METRICS_SQL} FROM ok GROUP BY 1)")
def horizon_latest_runs(spark, sf) -> DataFrame:
    """Stored runs of several horizons, all but one of them run again with the sign turned; the latest of each horizon is compared."""
    bars, store = written(src.monthly_bars(spark, sf)), RunStore(spark)
    for run, sign, horizons in (("first", 1, _AHEAD), ("second", -1, _AHEAD[:-1])):
        for h in horizons:
            store.add(_horizon_metrics(bars, h, sign), run)
    return _grids(store.latest(["horizon"]), ["horizon", "run", "n"], _KEPT)
