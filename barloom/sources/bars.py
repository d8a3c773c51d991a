"""Bars, weights, fund and signals derived from the sales tables; calendars and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_of(sales: DataFrame, unit: str) -> DataFrame:
    """Open, high, low, close, volume and amount of each instrument and calendar unit.

    ``sales`` has instrument, the line item columns, and nothing is sorted: first and
    last prices are grouped minima, combined before the shuffle.
    """
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    sold = sales.where("l_quantity > 0").select("instrument", F.date_trunc(unit, "l_shipdate").cast("timestamp_ntz").alias("datetime"), order.alias("o"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), "l_quantity", "l_extendedprice")
    bars = sold.groupBy("instrument", "datetime").agg(
        F.min_by("px", "o").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "o").alias("close"), F.sum("l_quantity").alias("vol"), F.round(F.sum("l_extendedprice"), 2).alias("amount"), F.count(F.lit(1)).alias("trades"),
    )
    return with_calendar(bars)


def with_calendar(bars: DataFrame) -> DataFrame:
    """Adds date (yyyymmdd of the year's first day) and minute_index (number of the bar in its year)."""
    times = bars.select("datetime").distinct().withColumn("date", F.year("datetime") * 10000 + 101)
    times = times.withColumn("minute_index", F.row_number().over(Window.partitionBy("date").orderBy("datetime")) - 1)
    return bars.join(times, "datetime").select("date", "datetime", "instrument", "minute_index", "open", "high", "low", "close", "vol", "amount", "trades")


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of brands."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long").alias("instrument"))
    return bars_of(table(spark, sf_dir, "lineitem").join(part, "l_partkey"), "week")


def monthly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars of suppliers."""
    return bars_of(table(spark, sf_dir, "lineitem").withColumn("instrument", F.col("l_suppkey")), "month")


def marked_bars(bars: DataFrame) -> DataFrame:
    """Bars with the flag of bad ones: no volume, no amount, missing prices, or a limit move in one price.

    Some volumes are set to zero by rule, so that there are bad bars.
    """
    vol = F.when((F.col("instrument") + F.col("minute_index")) % 29 == 0, 0.0).otherwise(F.col("vol"))
    before = F.lag("close").over(Window.partitionBy("date", "instrument").orderBy("datetime"))
    move = F.abs(F.col("close") / F.nullif(before, F.lit(0.0)) - 1)
    missing = F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull()
    limit = (F.col("high") == F.col("low")) & (move >= 0.095)
    bad = F.coalesce(vol <= 0, F.lit(False)) | F.coalesce(F.col("amount") <= 0, F.lit(False)) | missing | F.coalesce(limit, F.lit(False))
    return bars.withColumns({"vol": vol, "invalid_bar": bad})


def wiped(bars: DataFrame) -> DataFrame:
    """Marked bars without the values of bad ones."""
    return bars.withColumns({c: F.when(~F.col("invalid_bar"), F.col(c)) for c in ("open", "high", "low", "close", "vol", "amount")})


def split_of(date) -> F.Column:
    """train, an embargo year that is ignored, and test."""
    year = F.floor(date / 10000)
    return F.when(year <= 1998, "train").when(year >= 2000, "test").otherwise("ignore")


def forward_label(bars: DataFrame, horizon: int) -> DataFrame:
    """Return from each bar to the one ``horizon`` rows later on the same date."""
    later = F.lead("close", horizon).over(Window.partitionBy("date", "instrument").orderBy("datetime"))
    return bars.withColumn("label", later / F.nullif(F.col("close"), F.lit(0.0)) - 1)


def index_weights(bars: DataFrame) -> DataFrame:
    """Snapshots at each quarter's start: percent of the amount of the quarter before."""
    quarter = bars.groupBy(F.date_trunc("quarter", "datetime").alias("q"), "instrument").agg(F.sum("amount").alias("a"))
    share = 100 * F.col("a") / F.sum("a").over(Window.partitionBy("q"))
    start = F.add_months(F.to_date("q"), 3)
    return quarter.select(F.date_format(start, "yyyyMMdd").cast("int").alias("trade_date"), "instrument", share.alias("weight"))


def bar_day() -> F.Column:
    return F.date_format("datetime", "yyyyMMdd").cast("int")


def weighted_bars(bars: DataFrame, weights: DataFrame) -> DataFrame:
    """Bars inner-joined to the last snapshot at or before their day.

    The as-of step runs on distinct days and snapshot dates: a window over their union,
    so nothing but two short lists is compared.  Days before all snapshots drop out.
    """
    days = bars.select(bar_day().alias("day")).distinct()
    both = days.select("day", F.lit(None).cast("int").alias("snap")).union(weights.select("trade_date").distinct().select("trade_date", "trade_date"))
    last = Window.orderBy("day", F.col("snap").isNull()).rowsBetween(Window.unboundedPreceding, 0)  # one row per day, not per bar
    as_of = both.withColumn("trade_date", F.last("snap", ignorenulls=True).over(last)).where("snap is null and trade_date is not null").select("day", "trade_date")
    return bars.withColumn("day", bar_day()).join(as_of, "day").join(weights.select("trade_date", "instrument", (F.col("weight") / 100).alias("weight")), ["trade_date", "instrument"]).drop("day")


def signals(bars: DataFrame, horizon: int) -> DataFrame:
    """Two deterministic signals as model output, long by model, with the forward label."""
    w = Window.partitionBy("instrument").orderBy("datetime")
    ret = lambda n: F.col("close") / F.nullif(F.lag("close", n).over(w), F.lit(0.0)) - 1
    keep = (F.col("instrument") + F.col("minute_index")) % 17 != 0
    both = forward_label(bars, horizon).withColumns({"a": F.when(keep, -ret(1)), "b": F.when(keep, ret(5)), "split": split_of(F.col("date"))})
    return both.select("date", "datetime", "instrument", "minute_index", "split", "amount", "close", "label", F.explode(F.array(F.struct(F.lit("model_a").alias("model_name"), F.col("a").alias("pred")), F.struct(F.lit("model_b").alias("model_name"), F.col("b").alias("pred")))).alias("m")).select("*", "m.model_name", "m.pred").drop("m")


def in_session(ts, spans=((34200, 41400), (46800, 54000))) -> F.Column:
    """Whether the wall clock is in one of the spans of seconds, both ends included."""
    second = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    out = F.lit(False)
    for lo, hi in spans:
        out = out | second.between(lo, hi)
    return out


def session_bucket(ts) -> F.Column:
    hhmm = F.hour(ts) * 100 + F.minute(ts)
    return F.when(hhmm.between(930, 1130), "morning").when((hhmm >= 1300) & (hhmm < 1430), "afternoon").when(hhmm.between(1430, 1500), "tail").otherwise("other")
