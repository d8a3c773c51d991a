"""Non-overlapping back-test of a signal on a price series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.blocks import ranged, running_product, scan


def trades(series: DataFrame, horizon: int) -> DataFrame:
    """Every ``horizon``-th row of a date: the position's sign, its return, and when it ends.

    ``series`` has model_name, date, datetime, pred, label and every row of the grid.
    Trades that would end behind the date's last row have no label and drop out.
    """
    w = Window.partitionBy("model_name", "date").orderBy("datetime")
    rows = series.withColumns({"row_in_day": F.row_number().over(w) - 1, "exit_datetime": F.lead("datetime", horizon).over(w)})
    rows = rows.where((F.col("row_in_day") % horizon == 0) & F.col("pred").isNotNull() & F.col("label").isNotNull() & F.col("exit_datetime").isNotNull())
    return rows.select("model_name", "date", "datetime", "exit_datetime", "row_in_day", F.signum("pred").alias("position"), (F.signum("pred") * F.col("label")).alias("strategy_ret"))


def equity_curve(done: DataFrame, prices: DataFrame) -> DataFrame:
    """Equity at each time, carried forward between exits, and the benchmark.

    ``prices`` has datetime and close.  Equity compounds 1 + return; a total loss stays
    one.  A curve is worked on in ranges of time, not as a whole.
    """
    exits = done.groupBy("model_name", F.col("exit_datetime").alias("datetime")).agg(F.product(1 + F.col("strategy_ret")).alias("g"))
    models = done.select(F.lit(1).alias("one"), "model_name").distinct()  # one row per model
    grid = prices.select(F.lit(1).alias("one"), "datetime", "close").join(F.broadcast(models), "one").drop("one")
    rows = ranged(grid.join(exits, ["model_name", "datetime"], "left"), ["model_name"], ["datetime"])
    rows = running_product(rows, ["model_name"], "part_", "datetime", {"equity": F.coalesce("g", F.lit(1.0))})
    rows = scan(rows, ["model_name"], "part_", "datetime", {"top": ("max", F.col("equity")), "opened": ("first", F.col("close"))})
    return rows.select("model_name", "datetime", "equity", (F.col("close") / F.col("opened")).alias("benchmark"), (F.col("equity") / F.col("top") - 1).alias("drawdown"))


def curve_extrema(curves: DataFrame, by: list[str]) -> DataFrame:
    """First, last, largest and least value of each curve (datetime, v, and part_ as ``blocks.ranged`` has it), its largest drawdown, and when they were."""
    day = lambda c: c.cast("date").cast("string")
    topped = scan(curves, by, "part_", "datetime", {"top_": ("max", F.col("v"))})
    return topped.withColumn("d", F.col("v") / F.nullif(F.col("top_"), F.lit(0.0)) - 1).groupBy(*by).agg(
        F.min_by("v", "datetime").alias("start"), F.max_by("v", "datetime").alias("end_"), F.max("v").alias("top"), F.min("v").alias("low"), F.min("d").alias("max_drawdown"),
        day(F.max_by("datetime", "v")).alias("top_day"), day(F.min_by("datetime", "v")).alias("low_day"), day(F.min_by("datetime", "d")).alias("drawdown_day"),
    )


def summary(curve: DataFrame, done: DataFrame) -> DataFrame:
    ends = curve.groupBy("model_name").agg(F.max_by("equity", "datetime").alias("end_equity"), F.max_by("benchmark", "datetime").alias("end_benchmark"), (100 * F.min("drawdown")).alias("max_drawdown_pct"))
    n = done.groupBy("model_name").agg(F.count(F.lit(1)).alias("n_trades"))
    return ends.join(n, "model_name").withColumns({"total_pct": 100 * (F.col("end_equity") - 1), "excess_bps": 1e4 * (F.col("end_equity") / F.col("end_benchmark") - 1)})
