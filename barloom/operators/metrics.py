"""Signal metrics from additive sums: one partial and final aggregation for any grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.blocks import ranged, scan


def ratio(a, b) -> Column:
    """a / b, NULL where b is 0 or missing."""
    return a / F.nullif(b, F.lit(0.0))


def sufficient(preds: DataFrame, by: list[str]) -> DataFrame:
    """n, means, central sums of squares and products, and sums of errors, over rows where prediction and label are present.

    Central sums keep their digits where the mean is large against the spread.
    """
    p, y, n = F.col("pred"), F.col("label"), F.count(F.lit(1))
    rows = preds.where(p.isNotNull() & y.isNotNull())
    return rows.groupBy(*by).agg(
        n.alias("n"), F.avg(p).alias("mp"), F.avg(y).alias("my"), (F.var_pop(p) * n).alias("cpp"), (F.var_pop(y) * n).alias("cyy"), (F.covar_pop(p, y) * n).alias("cpy"),
        F.sum(F.abs(p - y)).alias("sae"), F.sum((p - y) * (p - y)).alias("sse"), F.sum(((p > 0) == (y > 0)).cast("double")).alias("hits"),
    )


def merge_sums(sums: DataFrame, by: list[str]) -> DataFrame:
    """Sums of coarser groups; a new day's sums are merged into kept ones the same way."""
    n = F.col("n")
    means = sums.groupBy(*by).agg(*[ratio(F.sum(n * F.col(m)), F.sum(n)).alias(f"all_{m}") for m in ("mp", "my")])
    off = {m: F.col(m) - F.col(f"all_{m}") for m in ("mp", "my")}
    parts = {"cpp": off["mp"] * off["mp"], "cyy": off["my"] * off["my"], "cpy": off["mp"] * off["my"]}
    return sums.join(means, by).groupBy(*by).agg(
        F.sum("n").alias("n"), F.first("all_mp").alias("mp"), F.first("all_my").alias("my"), *[F.sum(F.col(c) + n * d).alias(c) for c, d in parts.items()], *[F.sum(c).alias(c) for c in ("sae", "sse", "hits")]
    )


def negated(sums: DataFrame) -> DataFrame:
    """Sums that take their rows out again when they are merged."""
    return sums.withColumns({c: -F.col(c) for c in ("n", "cpp", "cyy", "cpy", "sae", "sse", "hits")})


def finalised(sums: DataFrame) -> DataFrame:
    """Adds ic, ic_t, rmse, mae and direction_acc.  A group without spread has no ic."""
    n = F.col("n")
    ic = F.when((n >= 2) & (F.col("cpp") > 0) & (F.col("cyy") > 0), F.col("cpy") / F.sqrt(F.col("cpp")) / F.sqrt(F.col("cyy")))
    out = sums.withColumn("ic", ic).withColumn("ic_t", F.when(F.abs("ic") < 1, F.col("ic") * F.sqrt(ratio(n - 2, 1 - F.col("ic") * F.col("ic")))))
    return out.withColumns({"rmse": F.sqrt(F.col("sse") / n), "mae": F.col("sae") / n, "direction_acc": F.col("hits") / n})


def average_rank(value: str, over: list[str]) -> Column:
    """Rank with ties averaged among the rows of a group."""
    w = Window.partitionBy(*over)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*over, value)) - 1) / 2


def rank_ic(preds: DataFrame, by: list[str]) -> DataFrame:
    """Correlation of average ranks of prediction and label in each group."""
    rows = preds.where("pred is not null and label is not null")
    ranked = rows.withColumns({"pr": average_rank("pred", by), "yr": average_rank("label", by)})
    dev = F.stddev_pop("pr") * F.stddev_pop("yr")
    return ranked.groupBy(*by).agg(F.when((F.count(F.lit(1)) >= 2) & (dev > 1e-12), F.covar_pop("pr", "yr") / F.nullif(dev, F.lit(0.0))).alias("rank_ic"))


def daily_metrics(preds: DataFrame, by: list[str] = ["model_name", "split", "date"]) -> DataFrame:
    return finalised(sufficient(preds, by)).join(rank_ic(preds, by), by)


def rolling(value: str, days: int, by: list[str], order: str = "date") -> Column:
    """Strict mean over ``days`` rows."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(days - 1), 0)
    return F.when(F.count(value).over(w) == days, F.avg(value).over(w))


def global_rank(df: DataFrame, value: str, name: str, parts: int | None = None) -> DataFrame:
    """Average rank over all rows without one task for all: values are counted, dealt out by range, and summed up range by range.

    Rows are counted by value before anything is dealt out, so a value that very many
    rows have is one row of a range; the planner splits its side of the join.
    """
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("k_"))
    upto = scan(ranged(counts, [], [value], parts), [], "part_", value, {"upto_": ("sum", F.col("k_"))})
    return df.join(upto.select(value, (F.col("upto_") - F.col("k_") + (F.col("k_") + 1) / 2).alias(name)), value)


def large_rank_ic(preds: DataFrame, by: list[str]) -> DataFrame:
    """Correlation of average ranks where the groups are few and large: no group is one task."""
    rows = preds.where("pred is not null and label is not null").select(*by, F.struct(*by, "pred").alias("p_"), F.struct(*by, "label").alias("y_"))
    ranked = global_rank(global_rank(rows, "p_", "pr"), "y_", "yr")
    dev = F.stddev_pop("pr") * F.stddev_pop("yr")
    return ranked.groupBy(*by).agg(F.when((F.count(F.lit(1)) >= 2) & (dev > 1e-12), F.covar_pop("pr", "yr") / F.nullif(dev, F.lit(0.0))).alias("rank_ic"))
