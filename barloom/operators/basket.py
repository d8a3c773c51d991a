"""Baskets of predictions, their components' state, and weight variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.metrics import ratio

WEIGHT_MODES = ("index", "weight_squared", "weight_times_amount", "effective_amount_weight")


def effective_weight(mode: str) -> Column:
    w, a = F.col("weight"), F.col("amount")
    modes = {"index": w, "weight_squared": w * w, "weight_times_amount": w * a, "effective_amount_weight": w * F.when(a.isNotNull(), 1.0).otherwise(0.0)}
    if mode not in modes:
        raise ValueError(f"unknown weight mode {mode}")
    return modes[mode]


def aggregate_basket(rows: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """Weighted prediction over rows that have one, weighted label over all, and coverage."""
    w = F.col("weight") if weight is None else weight
    rows = rows.withColumn("w_", w)
    has = F.col("pred").isNotNull()
    return rows.groupBy(*by).agg(
        ratio(F.sum(F.when(has, F.col("w_") * F.col("pred"))), F.sum(F.when(has, F.col("w_")))).alias("basket_pred"), ratio(F.sum(F.col("w_") * F.col("label")), F.sum("w_")).alias("basket_label"),
        ratio(F.coalesce(F.sum(F.when(has, F.col("w_"))), F.lit(0.0)), F.sum("w_")).alias("weight_coverage_pred"),
    )


def basket_modes(rows: DataFrame, by: list[str]) -> DataFrame:
    """All weight modes in one job."""
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), effective_weight(m).alias("w")) for m in WEIGHT_MODES]))
    return aggregate_basket(rows.withColumn("m_", modes).withColumns({"mode": F.col("m_.mode"), "weight": F.col("m_.w")}), [*by, "mode"])


def weight_rank(rows: DataFrame) -> DataFrame:
    """Adds the place of each instrument by weight on its date, ties by instrument."""
    first = rows.groupBy("date", "instrument").agg(F.min_by("weight", "datetime").alias("first_weight"))
    place = first.withColumn("place", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("first_weight"), "instrument")))
    return rows.join(place, ["date", "instrument"])


def topk_variants(rows: DataFrame, sizes: tuple[int, ...], by: list[str]) -> DataFrame:
    """Baskets of the k largest weights for several k, in one job."""
    ks = F.explode(F.array(*[F.lit(k) for k in sizes])).alias("k")
    return aggregate_basket(weight_rank(rows).select("*", ks).where("place <= k"), [*by, "k"])


def topk_share(rows: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """Share of the k largest weights in all, averaged over dates."""
    place = weight_rank(rows).select("date", "instrument", "first_weight", "place").distinct()
    daily = place.select("*", F.explode(F.array(*[F.lit(k) for k in sizes])).alias("k")).groupBy("date", "k").agg(ratio(F.sum(F.when(F.col("place") <= F.col("k"), F.col("first_weight"))), F.sum("first_weight")).alias("share"))
    return daily.groupBy("k").agg(F.avg("share").alias("share"), F.count(F.lit(1)).alias("n_dates"))


def component_state(rows: DataFrame) -> DataFrame:
    """Per time: weighted returns over 1, 5 and 10 bars, their spread, breadth and sync, and coverage.

    Returns are row by row inside a date.  Top-20 and rest spreads use the date's weights.
    One conditional aggregation, no self-joins.
    """
    w = Window.partitionBy("date", "instrument").orderBy("datetime")
    rows = weight_rank(rows).withColumns({f"r{n}": F.col("close") / F.nullif(F.lag("close", n).over(w), F.lit(0.0)) - 1 for n in (1, 5, 10)})
    wt = F.col("weight")
    out = [ratio(F.sum(F.when(F.col("r1").isNotNull(), wt)), F.sum(wt)).alias("weight_coverage"), F.countDistinct("instrument").alias("n_instruments")]
    for n in (1, 5, 10):
        r = F.col(f"r{n}")
        out += [
            F.sum(wt * r).alias(f"wret_{n}"), F.stddev_samp(r).alias(f"xs_std_{n}"), F.sum(F.when(r > 0, wt)).alias(f"breadth_{n}"), ratio(F.abs(F.sum(wt * r)), F.sum(wt * F.abs(r))).alias(f"sync_{n}"),
            F.sum(F.when(F.col("place") <= 20, wt * r)).alias(f"top20_{n}"), F.sum(F.when(F.col("place") > 20, wt * r)).alias(f"rest_{n}"),
        ]
    return rows.groupBy("date", "datetime").agg(*out)
