"""All queries of the panel engine and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions import factor as f
from barloom.functions.factor import Term
from barloom.plans import evaluation, factors, models, monthly
from barloom.plans import days as _days  # noqa: F401  these two register their queries with those of evaluation
from barloom.plans import reports as _reports  # noqa: F401
from barloom.plans.evaluation import grid
from barloom.plans.panel import checking_sql, compute, densify
from barloom.plans.sql import bars_sql, grid_sql
from barloom.sources import bars as src
from barloom.sources.store import written

FLAGSHIP = "factors_default"
#: Factors that one job computes; more would only make its plan unwieldy.
CHUNK = 10


def _rounded(name: str, digits: int) -> F.Column:
    """On a grid of 10**-digits.  The odd offset keeps halves, which prices give, from tipping on the last bit."""
    return grid(F.when(F.abs(name) < F.lit(float("inf")), F.col(name)), digits).alias(name)


_FIELDS = ["open", "high", "low", "close", "vol", "amount"]


def _bars(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return (src.weekly_bars if kind == "week" else src.monthly_bars)(spark, sf_dir)


def panel_query(kind: str, terms: dict[str, Term], digits: int = 6, marked: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    """Terms over the dense panel of weekly or monthly bars; ``marked`` bars have bad ones wiped and the column valid_."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bars = written(src.wiped(with_valid(_bars(kind, spark, sf_dir))) if marked else _bars(kind, spark, sf_dir))
        panel = densify(bars.select("datetime", "instrument", *_FIELDS, *["valid_"] * marked))
        return compute(panel, terms).select(F.col("datetime").cast("date").cast("string").alias("day"), "instrument", *[_rounded(n, digits) for n in terms])

    return run


def with_valid(bars: DataFrame) -> DataFrame:
    """Marked bars, and 1 up to the first bad bar of a date, NULL from it on."""
    seen = F.max("invalid_bar").over(Window.partitionBy("date", "instrument").orderBy("datetime"))
    return src.marked_bars(bars).withColumn("valid_", F.when(~seen, F.lit(1.0)))


_VALID = f"""{evaluation._MARKED}, wiped AS (SELECT date, datetime, instrument, minute_index, {", ".join(f"CASE WHEN NOT invalid_bar THEN {c} END AS {c}" for c in _FIELDS)}, CASE WHEN NOT bool_or(invalid_bar) OVER (PARTITION BY date, instrument ORDER BY datetime) THEN 1e0 END AS valid_ FROM marked)"""


def panel_sql(kind: str, terms: dict[str, Term], digits: int = 6, marked: bool = False) -> str:
    source, extra = ("wiped", ", valid_") if marked else ("bars", "")
    grid = f"grid AS (SELECT t.datetime, i.instrument, open, high, low, close, vol, amount{extra} FROM (SELECT DISTINCT datetime FROM bars) t CROSS JOIN (SELECT DISTINCT instrument FROM bars) i LEFT JOIN {source} USING (datetime, instrument))"
    steps, last = checking_sql("grid", terms, ["datetime", "instrument"])
    return f"WITH {bars_sql(kind)},\n{_VALID + ',' if marked else ''}\n{grid},\n{steps}\nSELECT CAST(CAST(datetime AS DATE) AS VARCHAR) AS day, instrument, {_outputs(terms, digits)} FROM {last}"


def _outputs(terms: dict[str, Term], digits: int) -> str:
    return ", ".join(f"{grid_sql(f"CASE WHEN abs({n}) < CAST('infinity' AS DOUBLE) THEN {n} END", digits)} AS {n}" for n in terms)


#: Dates before the evaluated one that a feature panel takes, and at most so many bars of an instrument from them.
HISTORY_DATES, HISTORY_BARS = 2, 250


def feature_panel(terms: dict[str, Term], digits: int) -> Callable[[SparkSession, str], DataFrame]:
    """Factors of every date as they are known on it: history as it is, the date's own bars wiped and masked, history cut off.

    Work is dealt out by evaluated date and instrument, so no window runs over more than
    its history and one date.
    """
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        marked = written(with_valid(_bars("week", spark, sf_dir)))
        dates = marked.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")))  # the calendar, one row per date
        back = F.explode(F.array(*[F.col("pos") - k for k in range(1, HISTORY_DATES + 1)])).alias("pos")
        ahead = dates.select(F.col("date").alias("eval_day"), back).join(dates, "pos").select("eval_day", "date")
        tail = Window.partitionBy("eval_day", "instrument").orderBy(F.desc("datetime"))
        history = marked.join(ahead, "date").withColumn("back", F.row_number().over(tail)).where(F.col("back") <= HISTORY_BARS).withColumn("current", F.lit(None).cast("double"))
        today = src.wiped(marked).withColumns({"eval_day": F.col("date"), "current": F.lit(1.0)})
        columns = ["eval_day", "datetime", "instrument", *_FIELDS, "valid_", "current"]
        panel = densify(written(history.select(columns).unionByName(today.select(columns))), keys=("eval_day",))
        out = compute(panel, terms, keys=("eval_day",)).where("current = 1")
        return out.select("eval_day", F.col("datetime").cast("date").cast("string").alias("day"), "instrument", *[_rounded(n, digits) for n in terms])

    return run


def _feature_panel_sql(terms: dict[str, Term], digits: int) -> str:
    columns = "eval_day, datetime, instrument, open, high, low, close, vol, amount, valid_, current"
    rows = f"""dates AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM bars)),
hist AS (SELECT e.date AS eval_day, m.datetime, m.instrument, m.open, m.high, m.low, m.close, m.vol, m.amount, w.valid_, CAST(NULL AS DOUBLE) AS current, row_number() OVER (PARTITION BY e.date, m.instrument ORDER BY m.datetime DESC) AS back
FROM dates e JOIN dates p ON p.pos BETWEEN e.pos - {HISTORY_DATES} AND e.pos - 1 JOIN marked m ON m.date = p.date JOIN wiped w ON w.datetime = m.datetime AND w.instrument = m.instrument),
panel_rows AS (SELECT {columns} FROM hist WHERE back <= {HISTORY_BARS} UNION ALL SELECT date, datetime, instrument, open, high, low, close, vol, amount, valid_, 1e0 FROM wiped),
grid AS (SELECT {columns} FROM (SELECT DISTINCT eval_day, datetime FROM panel_rows) JOIN (SELECT DISTINCT eval_day, instrument FROM panel_rows) USING (eval_day) LEFT JOIN panel_rows USING (eval_day, datetime, instrument))"""
    steps, last = checking_sql("grid", terms, ["eval_day", "datetime", "instrument", "current"], keys=("eval_day",))
    return f"WITH {bars_sql('week')},\n{_VALID},\n{rows},\n{steps}\nSELECT eval_day, CAST(CAST(datetime AS DATE) AS VARCHAR) AS day, instrument, {_outputs(terms, digits)} FROM {last} WHERE current = 1"


def _final(name: str) -> Term:
    """A factor as its set has it: masked behind a bad bar, clipped and ranked."""
    made = factors.FACTORS[name]
    made = f.while_valid(made) if name in factors.MASKED else made
    return f.clip_rank(made) if name in factors.CLIP_RANKED else made


def _chunks(names: list[str]) -> list[dict[str, Term]]:
    terms = {n: _final(n) for n in names}
    return [dict(list(terms.items())[k : k + CHUNK]) for k in range(0, len(terms), CHUNK)]


_c, _v = f.close, f.volume
#: Terms of the feature panel: plain, masked, and masked with clipping.
PANEL_TERMS = {n: _final(n) for n in ("ret_5", "ret_30", "volatility_10", "alpha_003", "alpha_009", "alpha_012", "alpha_033", "alpha_041", "alpha_042", "alpha_053")}
#: Name to bars, terms, digits and whether bad bars are wiped and masked.
PANELS: dict[str, tuple] = {
    "ts_returns": ("week", {"ret_1": f.ts_returns(_c, 1), "ret_5": f.ts_returns(_c, 5), "ret_20": f.ts_returns(_c, 20), "returns": f.returns}, 6),
    "ts_delay_delta": ("week", {"lag_1": f.delay(_c, 1), "lag_3": f.delay(_c, 3.9), "delta_1": f.delta(_c, 1), "delta_7": f.delta(_c, 7)}, 6),
    "ts_moments": ("week", {"mean_5": f.ts_mean(_c, 5), "std_10": f.ts_std(_c, 10), "max_20": f.ts_max(_c, 20), "min_20": f.ts_min(_c, 20), "sum_8": f.ts_sum(_c, 8)}, 4),
    "ts_product": ("week", {"product_3": f.ts_product(_c / 1000, 3), "product_14": f.ts_product(1 + f.returns, 14.9)}, 6),
    "ts_cov_corr": ("week", {"cov_10": f.ts_cov(_c / 1000, f.high / 1000, 10), "corr_6": f.ts_corr(_c, f.log(_v), 6), "corr_30": f.ts_corr(f.open_, _v, 30)}, 6),
    "ts_rank": ("week", {"rank_5": f.ts_rank(_c, 5), "rank_32": f.ts_rank(_v, 32)}, 6),
    "ts_arg": ("week", {"argmax_10": f.ts_argmax(_c, 10), "argmin_30": f.ts_argmin(_c, 30)}, 6),
    "ts_decay": ("week", {"decay_2": f.decay_linear(_c, 2), "decay_10": f.decay_linear(_c, 10)}, 4),
    "vwap_runmax": ("month", {"vwap": f.vwap, "high_so_far": f.high_so_far, "low_so_far": f.low_so_far, "open0": f.open0}, 4),
    "adv_windows": ("week", {f"adv{n}": f.adv(n) for n in (5, 10, 15, 20, 30, 40, 50, 60, 81, 120, 150, 180)}, 4),
    "cs_rank": ("month", {"rank_close": f.rank(_c), "rank_vol": f.rank(_v), "rank_of_rank": f.rank(f.rank(_v))}, 6),
    "cs_scale": ("month", {"scaled": f.scale(_c - f.open_), "scaled_2": f.scale(_v, 2)}, 6),
    "cs_neutralize": ("month", {"neutral": f.neutralize(_c, f.sign(_v - 500))}, 4),
    "cs_clip_rank": ("month", {"clipped": f.clip_rank(_c), "clipped_5": f.clip_rank(_v, 0.05, 0.95)}, 6),
    "elementwise_pack": ("week", {
        "log_vol": f.log(_v), "sign_d": f.sign(_c - f.open_), "abs_d": f.abs_(_c - f.open_), "sin_c": f.sin(_c / 1000), "sqrt_v": f.sqrt(_v), "pow_2": f.pow_(_c / 1000, 2), "ssqrt": f.signed_sqrt(_c - f.open_),
        "spow": f.signed_power((_c - f.open_) / 1000, 2), "sdiv": f.safe_div(_c, _c - f.open_), "least_": f.min_(f.open_, _c), "most_": f.max_(f.open_, _c), "pick": f.where((_c > f.open_) | (_v < 100), 1, f.where((_c < f.open_) & (_v > 10), -1, 0)),
        "divide": (_c - f.low) / (f.high - f.low), "same": _c.equals(f.open_), "other": _c.differs(f.high), "upto": _c <= f.open_, "from_": _c >= f.open_,
    }, 6),
    "factors_default": ("week", {n: factors.FACTORS[n] for n in factors.DEFAULT}, 5),
    "factors_fund": ("week", {n: factors.FACTORS[n] for n in factors.FUND}, 4),
    **{f"factors_alpha_{chr(97 + k)}": ("week", chunk, 4, True) for k, chunk in enumerate(_chunks(factors.ALPHA))},
    "factors_library_only": ("week", {n: _final(n) for n in factors.LIBRARY_ONLY}, 4, True),
}

#: The feature panel by parts: all factors of the stock set.
FEATURE_PANELS: dict[str, tuple] = {"feature_panel": (PANEL_TERMS, 5)} | {f"feature_panel_{chr(97 + k)}": (chunk, 4) for k, chunk in enumerate(_chunks([*factors.DEFAULT, *factors.ALPHA]))}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: panel_query(*p) for n, p in PANELS.items()} | {n: feature_panel(*p) for n, p in FEATURE_PANELS.items()} | evaluation.QUERIES | models.QUERIES | monthly.QUERIES
ORACLE_SQL: dict[str, str] = {n: panel_sql(*p) for n, p in PANELS.items()} | {n: _feature_panel_sql(*p) for n, p in FEATURE_PANELS.items()} | evaluation.ORACLES | models.ORACLES | monthly.ORACLES
