"""Linear models of every fold of an expanding walk-forward from one pass over the rows.

Sums of products by period are additive, so the sums of all periods before one come from a
running total over one row per period: the rows are read once, whatever the number of
folds, and a new period needs no earlier row.  A fold is one small system of equations,
solved in a task; its coefficients, one row per period, are joined back to the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def product_sums(rows: DataFrame, period: str, features: list[str], label: str) -> DataFrame:
    """n, sums and sums of products by period, over rows where the label and every feature are finite."""
    ok = F.lit(True)
    for c in (*features, label):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    names = [*features, label]
    value = lambda c: F.when(ok, F.col(c))
    sums = [F.sum(value(c)).alias(f"s_{k}") for k, c in enumerate(names)]
    products = [F.sum(value(a) * F.col(b)).alias(f"p_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    return rows.groupBy(period).agg(F.sum(ok.cast("long")).alias("n"), *sums, *products)


def earlier_sums(sums: DataFrame, period: str, least: int) -> DataFrame:
    """For each period with at least ``least`` periods before it: their sums, and the first and last of them.

    The input has one row per period of the calendar, so one task orders it.
    """
    every = Window.orderBy(period)
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    added = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in sums.columns if c != period]
    out = sums.select(period, F.first(period).over(before).alias("train_start"), F.last(period).over(before).alias("train_end"), F.row_number().over(every).alias("place_"), *added)
    return out.where(F.col("place_") > least).drop("place_")


def coefficients(sums: DataFrame, period: str, n_features: int, ridge: float) -> DataFrame:
    """(period, train_start, train_end, fitted, intercept, slopes) of each row of sums.

    ``ridge`` enlarges each feature's variance by that share.  Features without spread have
    slope 0; a fold without rows predicts nothing (intercept NULL).
    """

    def solve(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                r, p, n = row._asdict(), n_features, row.n
                if n == 0:
                    out.append((r[period], row.train_start, row.train_end, n, None, [0.0] * p))
                    continue
                mean = np.array([r[f"s_{k}"] for k in range(p + 1)]) / n
                cov = np.array([[r[f"p_{min(i, j)}_{max(i, j)}"] / n - mean[i] * mean[j] for j in range(p + 1)] for i in range(p)]).reshape(p, p + 1)
                spread = np.flatnonzero(np.array([cov[i, i] > 1e-12 * (mean[i] ** 2 + 1e-12) for i in range(p)], dtype=bool))
                slopes = np.zeros(p)
                if len(spread):
                    system = cov[np.ix_(spread, spread)]
                    system[np.diag_indices(len(spread))] *= 1 + ridge
                    slopes[spread] = np.linalg.lstsq(system, cov[spread, p], rcond=None)[0]
                out.append((r[period], row.train_start, row.train_end, n, mean[p] - slopes @ mean[:p], slopes.tolist()))
            yield pd.DataFrame(out, columns=[period, "train_start", "train_end", "fitted", "intercept", "slopes"])

    kind = sums.schema[period].dataType.simpleString()
    return sums.mapInPandas(solve, f"{period} {kind}, train_start {kind}, train_end {kind}, fitted long, intercept double, slopes array<double>")


def walk_forward(rows: DataFrame, period: str, features: list[str], label: str, least: int, ridge: float = 1e-3) -> DataFrame:
    """``rows`` of the periods that have ``least`` earlier ones, with train_start, train_end, fitted and pred.

    Each period is predicted from the rows of all earlier periods alone.  Rows that lack a
    feature have a NULL prediction; rows without a period are left out.
    """
    rows = rows.where(F.col(period).isNotNull())
    folds = coefficients(earlier_sums(product_sums(rows, period, features, label), period, least), period, len(features), ridge)
    pred = F.col("intercept")
    for k, c in enumerate(features):
        pred = pred + F.col("slopes")[k] * F.col(c)
    return rows.join(F.broadcast(folds), period).select(*rows.columns, "train_start", "train_end", "fitted", pred.alias("pred"))  # one row per period
