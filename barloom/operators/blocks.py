"""Work over long series in blocks of bounded size.

A series is cut into blocks by the place of its rows.  What looks back over a few rows gets
these as a halo before its block; what runs from the beginning gets the totals of all
blocks before.  So neither the number nor the length of the series bounds the parallelism.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.store import written

#: Rows of a block, besides its halo.
BLOCK = 2048


def with_halo(rows: DataFrame, lookback: int, block: int = BLOCK, pos: str = "pos_") -> DataFrame:
    """Adds block_ and own_, and copies of the last ``lookback`` rows before a block to the block, with own_ false.

    ``pos`` is a row's place in its series, without gaps.
    """
    first, last = F.floor(F.col(pos) / block), F.floor((F.col(pos) + lookback) / block)
    return rows.select("*", F.explode(F.sequence(first, last)).alias("block_")).withColumn("own_", F.col("block_") == F.floor(F.col(pos) / block))


def ranged(rows: DataFrame, by: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """Rows with part_, a number that grows with ``by`` and ``order``: ranges of about equal size.

    The ranges are written, since a second plan might draw them elsewhere.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(parts, *by, *order).withColumn("part_", F.spark_partition_id()))


_OPS = {
    "sum": (lambda x, o: F.sum(x), lambda before, here: F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0))),
    "max": (lambda x, o: F.max(x), lambda before, here: F.greatest(before, here)),
    "min": (lambda x, o: F.min(x), lambda before, here: F.least(before, here)),
    "first": (lambda x, o: F.min_by(F.struct(x.alias("x")), o), lambda before, here: F.coalesce(before, here)["x"]),
    "last": (lambda x, o: F.max_by(x, F.when(x.isNotNull(), o)), lambda before, here: F.coalesce(here, before)),
}
_INSIDE = {"first": lambda x: F.first(F.struct(x.alias("x"))), "last": lambda x: F.last(x, ignorenulls=True), "sum": F.sum, "max": F.max, "min": F.min}


def scan(rows: DataFrame, by: list[str], part: str, order: str, columns: dict[str, tuple[str, Column]]) -> DataFrame:
    """``rows`` with running values from the start of each series to the row: name to (op, column).

    ``part`` cuts the series and grows along ``order``.  Only the totals of the parts, one
    row each, are looked at as whole series; rows are looked at within their part.  Sums
    take NULL for 0, max and min pass over it, first is the first row's value, last the
    latest that is not NULL.
    """
    o = F.col(order)
    totals = rows.groupBy(*by, part).agg(*[_OPS[op][0](x, o).alias(f"{name}_t") for name, (op, x) in columns.items()])
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    over = {"first": lambda c: F.first(c, ignorenulls=True), "last": lambda c: F.last(c, ignorenulls=True), "sum": F.sum, "max": F.max, "min": F.min}
    carried = totals.select(*by, part, *[over[op](F.col(f"{name}_t")).over(before).alias(f"{name}_b") for name, (op, _) in columns.items()])
    inside = Window.partitionBy(*by, part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(carried, [*by, part])
    return joined.select(*rows.columns, *[_OPS[op][1](F.col(f"{name}_b"), _INSIDE[op](x).over(inside)).alias(name) for name, (op, x) in columns.items()])


def running_product(rows: DataFrame, by: list[str], part: str, order: str, factors: dict[str, Column]) -> DataFrame:
    """Products from the start of each series; sizes add up as logarithms, beside the parity of the signs and whether a zero came."""
    columns = {}
    for name, x in factors.items():
        columns |= {
            f"{name}_size": ("sum", F.when(x != 0, F.log(F.abs(x))).otherwise(0.0)), f"{name}_minus": ("sum", (x < 0).cast("long")), f"{name}_zero": ("sum", (x == 0).cast("long")),
        }
    out = scan(rows, by, part, order, columns)
    product = lambda n: F.when(F.col(f"{n}_zero") > 0, 0.0).otherwise(F.exp(f"{n}_size") * F.when(F.col(f"{n}_minus") % 2 == 1, -1.0).otherwise(1.0))
    return out.select(*rows.columns, *[product(n).alias(n) for n in factors])


def positions(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """``rows``, cut into ranges, with part_ and pos_, the place of each in its series from 0 on."""
    counted = scan(ranged(rows, by, [order]), by, "part_", order, {"pos_": ("sum", F.lit(1).cast("long"))})
    return counted.withColumn("pos_", F.col("pos_") - 1)
