"""Values at exact ranks without a sort, and what follows: percentiles and bounded samples.

Keys are 64-bit integers.  Four passes count them by 16 bits, each pass only those that
share the higher bits with a wanted rank, until the whole key is known.  Counting is
combined before the shuffle and a group has at most 65,536 counters for each wanted rank,
whatever its rows; no task holds or sorts the values of a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.store import written

DIGIT = 16


def _flipped(bits: np.ndarray) -> np.ndarray:
    """Bits of doubles to integers of the same order, and back."""
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def _to_key(x: pd.Series) -> pd.Series:
    return pd.Series(_flipped((x.to_numpy(dtype=np.float64) + 0.0).view(np.int64)))


def _from_key(key: pd.Series) -> pd.Series:
    return pd.Series(_flipped(key.to_numpy(dtype=np.int64)).view(np.float64))


def ordered_bits(x: Column) -> Column:
    """A double as an integer that sorts like it; -0.0 is 0.0."""
    return F.pandas_udf(_to_key, "long")(x)


def from_ordered_bits(key: Column) -> Column:
    return F.pandas_udf(_from_key, "double")(key)


def nth(rows: DataFrame, by: list[str], key: str, wanted: DataFrame) -> DataFrame:
    """``wanted`` (the columns ``by``, further ones, and rank, from 0 on) with key_, the key at that rank of its group.

    Keys are longs without NULLs; ranks beyond a group's rows drop out.
    """
    low = F.lit((1 << DIGIT) - 1)
    unsigned = F.col(key).bitwiseXOR(F.lit(-(1 << 63)))
    rows = written(rows.select(*by, unsigned.alias("u_")))  # read in four passes
    found = wanted.withColumns({"high_": F.lit(0).cast("long"), "left_": F.col("rank").cast("long")})
    for shift in range(64 - DIGIT, -1, -DIGIT):
        high = F.shiftrightunsigned("u_", shift + DIGIT) if shift + DIGIT < 64 else F.lit(0).cast("long")
        cells = rows.select(*by, high.alias("high_"), F.shiftrightunsigned("u_", shift).bitwiseAND(low).alias("digit_"))
        if shift + DIGIT < 64:
            cells = cells.join(found.select(*by, "high_").distinct(), [*by, "high_"], "left_semi")
        counts = cells.groupBy(*by, "high_", "digit_").agg(F.count(F.lit(1)).alias("n_"))
        upto = F.sum("n_").over(Window.partitionBy(*by, "high_").orderBy("digit_").rowsBetween(Window.unboundedPreceding, 0))  # at most 65,536 rows
        counts = counts.withColumn("upto_", upto).withColumn("before_", F.col("upto_") - F.col("n_"))
        hit = found.join(counts, [*by, "high_"]).where("left_ >= before_ and left_ < upto_")
        found = hit.select(*wanted.columns, F.shiftleft("high_", DIGIT).bitwiseOR(F.col("digit_")).alias("high_"), (F.col("left_") - F.col("before_")).alias("left_"))
        found = written(found)  # a row for each wanted rank
    return found.select(*wanted.columns, F.col("high_").bitwiseXOR(F.lit(-(1 << 63))).alias("key_"), F.col("left_").alias("among_equal_"))


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles of each group, interpolated between neighbours; one column for each name.  NULLs are left out."""
    keyed = rows.where(F.col(value).isNotNull()).select(*by, ordered_bits(F.col(value).cast("double")).alias("k_"))
    sizes = keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("n_"))
    place = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(float(q)) * (F.col("n_") - 1)).alias("at")) for name, q in shares.items()])).alias("w")
    sides = F.explode(F.array(F.floor("w.at"), F.ceil("w.at"))).alias("rank")
    wanted = sizes.select(*by, place).select(*by, "w.name", "w.at", sides).distinct()
    values = nth(keyed, by, "k_", wanted).withColumn("v_", from_ordered_bits(F.col("key_")))
    both = values.groupBy(*by, "name", "at").agg(F.min("v_").alias("a"), F.max("v_").alias("b"))
    between = both.withColumn("v_", F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at")))
    return between.groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, F.col("v_"))).alias(name) for name in shares])


def medians(rows: DataFrame, columns: list[str], by: list[str] = []) -> DataFrame:
    """One row, or one for each group, with the median of each column, NULLs left out, named m_ and the column."""
    long = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("fact"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select(*by, "x.*")
    found = percentiles(long, [*by, "fact"], "v", {"m": 0.5})
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("fact") == c, F.col("m"))).alias(f"m_{c}") for c in columns])


def smallest(rows: DataFrame, k: int, key: Column, ties: list[str]) -> DataFrame:
    """The ``k`` rows with the smallest keys (longs), ties by the columns ``ties``; all if there are fewer.

    The rows kept are the same for every partitioning.  Samples of parts merge: the sample
    of a union is that of the union of the samples.
    """
    rows = rows.withColumn("k_", key)
    last = rows.agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("n")).where("n > 0").select(F.lit(0).alias("all_"), (F.col("n") - 1).alias("rank"))
    bound = F.broadcast(nth(rows.withColumn("all_", F.lit(0)), ["all_"], "k_", last).select(F.col("key_").alias("bound_"), (F.col("among_equal_") + 1).alias("room_")))  # one row
    near = rows.join(bound, F.col("k_") <= F.col("bound_"))
    sure = near.where("k_ < bound_").drop("k_", "bound_", "room_")
    place = F.row_number().over(Window.partitionBy("k_").orderBy(*ties))
    return sure.unionByName(near.where("k_ = bound_").withColumn("place_", place).where("place_ <= room_").drop("k_", "bound_", "room_", "place_"))


def row_hash(*columns: str) -> Column:
    """A number below 2**31 - 1 from integer columns, the same in any engine: a weighted sum, mixed by one step of a multiplicative generator."""
    weights = (1_000_003, 10_007, 10_009, 10_037)
    total = sum((F.col(c).cast("long") * w for c, w in zip(columns, weights)), F.lit(0).cast("long"))
    return F.pmod(F.pmod(total, F.lit(2**31 - 1)) * 48_271, F.lit(2**31 - 1))
