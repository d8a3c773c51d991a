"""Walk-forward by months on panel features, and the residual stage on the basis features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators import expanding, metrics
from barloom.plans.evaluation import _BASIS_SQL, _METRICS_SQL, _grids, _grids_sql, basis_frame
from barloom.plans.models import FEATURES, panel_features
from barloom.plans.sql import SPLIT, bars_sql
from barloom.sources import bars as src
from barloom.sources.store import written

#: Months before the first fold.
LEAST_MONTHS = 12
RIDGE = 1e-3

#: Features of the residual stage.  Those made of residuals, which look 4 bars ahead, are those of 4 bars ago.
BASIS_FEATURES = ["basket_pred", "wret_1", "weight_coverage", "cum_wret", "past_mean", "past_std"]


def _month() -> F.Column:
    return (F.year("datetime") * 100 + F.month("datetime")).cast("int")


def monthly_predictions(spark, sf) -> DataFrame:
    """Panel rows with the prediction of the model of all earlier months."""
    rows = panel_features(src.monthly_bars(spark, sf), 1).withColumn("month", _month())
    return expanding.walk_forward(rows, "month", FEATURES, "label", LEAST_MONTHS, RIDGE)


def monthly_folds(preds: DataFrame) -> DataFrame:
    """Each fold's months, rows fitted, and IC, rank IC and error on its own month."""
    by = ["month"]
    folds = preds.groupBy("month").agg(F.max("train_start").alias("train_start"), F.max("train_end").alias("train_end"), F.max("fitted").alias("fitted"))
    return folds.join(metrics.finalised(metrics.sufficient(preds, by)), by).join(metrics.large_rank_ic(preds, by), by)


def walk_forward_months(spark, sf) -> DataFrame:
    """Fold table of the expanding monthly walk-forward."""
    return _grids(monthly_folds(written(monthly_predictions(spark, sf))), ["month", "train_start", "train_end", "fitted", "n"], ["ic", "rank_ic", "rmse"], 4)


def walk_forward_months_summary(spark, sf) -> DataFrame:
    """Stability of the monthly folds: how many, how many with a negative IC, least, mean and largest IC."""
    ic = metrics.finalised(metrics.sufficient(monthly_predictions(spark, sf), ["month"])).where("ic is not null")
    out = ic.agg(F.count(F.lit(1)).alias("folds"), F.sum((F.col("ic") < 0).cast("long")).alias("negative"), F.min("ic").alias("least"), F.avg("ic").alias("mean"), F.max("ic").alias("largest"))
    return _grids(out, ["folds", "negative"], ["least", "mean", "largest"], 4)


def basis_rows(spark, sf) -> DataFrame:
    """The basis frame with its month, split and features."""
    w = Window.partitionBy("date").orderBy("datetime")
    frame = basis_frame(spark, sf)
    return frame.withColumns({"past_mean": F.lag("roll_mean", 4).over(w), "past_std": F.lag("roll_std", 4).over(w), "month": _month(), "split": src.split_of(F.col("date"))})


def basis_two_stage(spark, sf) -> DataFrame:
    """The fund's return by the basket alone, and by the basket plus a residual model of all earlier months, by split."""
    rows = expanding.walk_forward(basis_rows(spark, sf), "month", BASIS_FEATURES, "residual", LEAST_MONTHS, RIDGE).where("pred is not null")
    stage = lambda name, pred: F.struct(F.lit(name).alias("stage"), pred.alias("pred"))
    both = rows.select("split", F.col("fund_label").alias("label"), F.explode(F.array(stage("basket", F.col("basket_pred")), stage("basket_and_residual", F.col("basket_pred") + F.col("pred")))).alias("s")).select("split", "label", "s.*")
    return _grids(metrics.finalised(metrics.sufficient(both, ["split", "stage"])), ["split", "stage", "n"], ["ic", "rmse", "mae", "direction_acc"], 4)


QUERIES = {"walk_forward_months": walk_forward_months, "walk_forward_months_summary": walk_forward_months_summary, "basis_two_stage": basis_two_stage}


def _solved_sql(rows: str, features: list[str], label: str) -> str:
    """Every fold by a self-join on earlier rows and Gaussian elimination, one step a table; ends in the table ``solved``."""
    p, names = len(features), [*features, label]
    fit = f"fit AS (SELECT m.month, min(r.month) AS train_start, max(r.month) AS train_end, count({label}) FILTER (good) AS fitted, " + ", ".join(f"avg({c}) FILTER (good) AS m_{k}" for k, c in enumerate(names))
    flat = [f"var_pop({c}) FILTER (good) <= 1e-12 * (avg({c}) FILTER (good) ** 2 + 1e-12)" for c in features]  # such a feature's row and column are those of the identity
    for i, a in enumerate(features):
        for j, b in enumerate(names):
            cell = f"covar_pop({a}, {b}) FILTER (good)" + (f" * (1 + {RIDGE:.4f}::DOUBLE)" if i == j else "")
            fit += f", CASE WHEN {flat[i]}{f' OR {flat[j]}' if j < p else ''} THEN {float(i == j)}::DOUBLE ELSE {cell} END AS a_{i}_{j}"
    fit += f" FROM (SELECT month FROM (SELECT month, row_number() OVER (ORDER BY month) AS k FROM (SELECT DISTINCT month FROM {rows})) WHERE k > {LEAST_MONTHS}) m JOIN (SELECT *, {' AND '.join(f'{c} IS NOT NULL' for c in names)} AS good FROM {rows}) r ON r.month < m.month GROUP BY m.month)"
    steps, kept = [fit], "month, train_start, train_end, fitted, " + ", ".join(f"m_{k}" for k in range(p + 1))
    for k in range(p):  # row k is divided by its pivot and taken from every other row
        cells = [f"a_{k}_{j} / a_{k}_{k} AS a_{k}_{j}" if i == k else f"a_{i}_{j} - a_{i}_{k} * a_{k}_{j} / a_{k}_{k} AS a_{i}_{j}" for i in range(p) for j in range(k + 1, p + 1)]
        steps.append(f"step{k} AS (SELECT {kept}, {', '.join(cells)} FROM {'fit' if k == 0 else f'step{k - 1}'})")
    pred = f"m_{p} + " + " + ".join(f"a_{k}_{p} * ({c} - m_{k})" for k, c in enumerate(features))
    return ", ".join(steps) + f", solved AS (SELECT r.*, train_start, train_end, fitted, {pred} AS pred FROM {rows} r JOIN step{p - 1} USING (month))"


_MONTH_SQL = "CAST(year(datetime) * 100 + month(datetime) AS INT) AS month"
_PANEL = f"""{bars_sql('month')}, pf AS (SELECT date, datetime, instrument, {_MONTH_SQL}, lead(close) OVER d / nullif(close, 0) - 1 AS label, close / nullif(lag(close) OVER w, 0) - 1 AS ret_1, close / nullif(lag(close, 5) OVER w, 0) - 1 AS ret_5,
high / nullif(low, 0) - 1 AS range_, vol / nullif(avg(vol) OVER (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0) AS vol_ratio, percent_rank() OVER (PARTITION BY datetime ORDER BY vol) AS place
FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY datetime), d AS (PARTITION BY date, instrument ORDER BY datetime)), {_solved_sql('pf', FEATURES, 'label')}, good AS (SELECT *, pred - label AS e FROM solved WHERE pred IS NOT NULL AND label IS NOT NULL)"""
_RANKED = ", ".join(f"rank() OVER (PARTITION BY month ORDER BY {c}) + (count(*) OVER (PARTITION BY month, {c}) - 1) / 2e0 AS {n}" for c, n in (("pred", "pr"), ("label", "yr")))
_BASIS_ROWS = f"{_BASIS_SQL}, bx AS (SELECT b.*, s.weight_coverage, lag(roll_mean, 4) OVER (PARTITION BY date ORDER BY datetime) AS past_mean, lag(roll_std, 4) OVER (PARTITION BY date ORDER BY datetime) AS past_std, {_MONTH_SQL}, {SPLIT} AS split FROM basis b LEFT JOIN state s USING (date, datetime)), {_solved_sql('bx', BASIS_FEATURES, 'residual')}"
ORACLES = {
    "walk_forward_months": f"WITH {_PANEL}, rk AS (SELECT *, {_RANKED} FROM good), m AS (SELECT month, max(train_start) AS train_start, max(train_end) AS train_end, max(fitted) AS fitted, {_METRICS_SQL}, covar_pop(pr, yr) / nullif(stddev_pop(pr) * stddev_pop(yr), 0) AS rank_ic FROM rk GROUP BY month) SELECT month, train_start, train_end, fitted, n, {_grids_sql(['ic', 'rank_ic', 'rmse'], 4)} FROM m",
    "walk_forward_months_summary": f"WITH {_PANEL}, m AS (SELECT month, {_METRICS_SQL} FROM good GROUP BY month), s AS (SELECT count(*) AS folds, CAST(count(*) FILTER (ic < 0) AS BIGINT) AS negative, min(ic) AS least, avg(ic) AS mean, max(ic) AS largest FROM m WHERE ic IS NOT NULL) SELECT folds, negative, {_grids_sql(['least', 'mean', 'largest'], 4)} FROM s",
    "basis_two_stage": f"WITH {_BASIS_ROWS}, st AS (SELECT split, 'basket' AS stage, fund_label AS label, basket_pred AS pred FROM solved WHERE pred IS NOT NULL UNION ALL SELECT split, 'basket_and_residual', fund_label, basket_pred + pred FROM solved WHERE pred IS NOT NULL), e1 AS (SELECT *, pred - label AS e FROM st WHERE pred IS NOT NULL AND label IS NOT NULL), m AS (SELECT split, stage, {_METRICS_SQL} FROM e1 GROUP BY 1, 2) SELECT split, stage, n, {_grids_sql(['ic', 'rmse', 'mae', 'direction_acc'], 4)} FROM m",
}
