"""Factor functions against a plain numpy version, and what their plans look like."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import factor as f
from barloom.plans import factors
from barloom.plans.panel import compute, densify

NAN = math.nan
X = {1: [1.0, 2.0, 2.0, None, 5.0, 3.0, 3.0, 8.0, 8.0, 0.5], 2: [4.0, 4.0, 4.0, 4.0, 4.0, 4.0, -1.0, None, 2.0, 2.0], 3: [0.0, -2.0, 7.0, 7.0, 1.0, None, None, 9.0, 9.0, 1.0]}


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(i, t, x, float(t) if x is not None else None) for i, xs in X.items() for t, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "instrument long, t int, close double, vol double")
    return df.select("instrument", F.timestamp_seconds(F.col("t") * 60).cast("timestamp_ntz").alias("datetime"), "t", "close", "vol")


def values(panel, term):
    rows = compute(panel, {"y": term}).orderBy("instrument", "t").collect()
    return {i: [r["y"] for r in rows if r["instrument"] == i] for i in X}


def strict(xs, n, fn):
    out = []
    for t in range(len(xs)):
        w = xs[max(0, t - n + 1) : t + 1]
        out.append(fn(np.array(w)) if len(w) == n and None not in w else None)
    return out


def same(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert (x is None or (isinstance(x, float) and math.isnan(x))) == (y is None) and (y is None or abs(x - y) < 1e-9), (a, b)


WINDOWS = {
    "mean": (f.ts_mean, np.mean), "std": (f.ts_std, lambda w: np.std(w, ddof=1)), "max": (f.ts_max, np.max), "min": (f.ts_min, np.min), "sum": (f.ts_sum, np.sum), "product": (f.ts_product, np.prod),
    "rank": (f.ts_rank, lambda w: ((w < w[-1]).sum() + ((w == w[-1]).sum() + 1) / 2) / len(w)), "argmax": (f.ts_argmax, lambda w: float(np.argmax(w))), "argmin": (f.ts_argmin, lambda w: float(np.argmin(w))),
    "decay": (f.decay_linear, lambda w: (w * np.arange(len(w), 0, -1)).sum() / (len(w) * (len(w) + 1) / 2)),
}


@pytest.mark.parametrize("name", WINDOWS)
@pytest.mark.parametrize("n", [2, 3.9])
def test_window(panel, name, n):
    term, fn = WINDOWS[name]
    got = values(panel, term(f.close, n))
    for i, xs in X.items():
        same(got[i], strict(xs, int(n), fn))


def test_correlation_is_scaled_and_null_on_constant_windows(panel):
    got = values(panel, f.ts_corr(f.close, f.volume, 3))
    for i, xs in X.items():
        both = [None if x is None else (x, float(t)) for t, x in enumerate(xs)]
        def corr(w):
            a, b = w[:, 0], w[:, 1]
            return None if a.std() == 0 else ((a * b).mean() - a.mean() * b.mean()) / (a.std(ddof=1) * b.std(ddof=1))
        same(got[i], strict(both, 3, corr))


def test_cross_section_rank(panel):
    got = values(panel, f.rank(f.close))
    for t in range(10):
        col = {i: xs[t] for i, xs in X.items() if xs[t] is not None}
        for i in X:
            x = X[i][t]
            want = None if x is None else (sum(v < x for v in col.values()) + (sum(v == x for v in col.values()) + 1) / 2) / len(col)
            same([got[i][t]], [want])


def test_infix_rules(panel):
    got = values(panel, f.where(f.close > 3, f.close / 0, f.safe_div(f.close, 0)))
    for i, xs in X.items():
        assert got[i] == [None] * len(xs)  # infinities are missing in a finished factor
    got = values(panel, (f.close < f.delay(f.close, 1)) * 1)
    assert got[1] == [0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    with pytest.raises(ValueError, match="unknown function"):
        values(panel, f.Term("el", "nonsense", (f.close,)))


def test_scale_sums_to_one(panel):
    rows = compute(panel, {"y": f.scale(f.close, 2)}).groupBy("t").agg(F.sum(F.abs("y")).alias("s")).collect()
    assert all(r["s"] is None or abs(r["s"] - 2) < 1e-9 for r in rows)


def test_densify_fills_the_grid(spark, panel):
    holes = panel.where("close is not null").select("datetime", "instrument", "close")
    dense = densify(holes)
    assert dense.count() == 30 and dense.where("close is null").count() == 4


def test_lookbacks_cover_the_library():
    assert set(factors.LOOKBACK) == set(factors.FACTORS) and len(factors.FACTORS) == 108
    assert set(factors.DEFAULT + factors.ALPHA + factors.FUND + factors.LIBRARY_ONLY) == set(factors.FACTORS)


def test_shuffles_follow_changes_of_direction(spark, panel):
    """Ten factors of one and two changes share their shuffles."""
    terms = {n: factors.FACTORS[n] for n in ("alpha_009", "alpha_010", "alpha_012", "alpha_023", "alpha_034")}
    fields = panel.select("instrument", "datetime", *[F.col("close").alias(c) for c in ("open", "high", "low", "close", "vol", "amount")])
    plan = compute(fields, terms)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") <= 4


def at_times(got):
    return [{i: got[i][t] for i in X} for t in range(10)]


def test_neutralize_takes_out_the_mean_of_each_group(panel):
    got = at_times(values(panel, f.neutralize(f.close, f.sign(f.close - 3))))
    for t in range(10):
        col = {i: xs[t] for i, xs in X.items()}
        for i, x in col.items():
            group = [v for v in col.values() if v is not None and x is not None and np.sign(v - 3) == np.sign(x - 3)]
            same([got[t][i]], [None if x is None else x - sum(group) / len(group)])


def test_clip_rank_ranks_what_percentiles_bound(panel):
    got = at_times(values(panel, f.clip_rank(f.close, 0.3, 0.6)))
    for t in range(10):
        col = {i: xs[t] for i, xs in X.items() if xs[t] is not None}
        lo, hi = np.quantile(list(col.values()), [0.3, 0.6])
        cut = {i: max(min(v, hi), lo) for i, v in col.items()}
        for i in X:
            same([got[t][i]], [(sum(v < cut[i] for v in cut.values()) + (sum(v == cut[i] for v in cut.values()) + 1) / 2) / len(cut) if i in cut else None])


POINTWISE = {
    "signed_power": (lambda x: f.signed_power(x - 3, 2), lambda v: math.copysign(abs(v - 3) ** 2, v - 3)), "signed_root": (lambda x: f.signed_sqrt(x - 3), lambda v: math.copysign(math.sqrt(abs(v - 3)), v - 3)),
    "inverse": (lambda x: f.signed_power(x - 3, -1), lambda v: None if v == 3 else 1 / (v - 3)), "pow": (lambda x: f.pow_(x, 3), lambda v: v**3), "root_of_negative": (lambda x: f.pow_(x, 0.5), lambda v: v**0.5 if v >= 0 else None),
    "zero_to_minus_one": (lambda x: f.pow_(x, -1), lambda v: None if v == 0 else 1 / v), "anything_to_zero": (lambda x: f.pow_(x, 0), lambda v: 1.0), "log": (f.log, lambda v: math.log(v) if v > 0 else None),
    "least": (lambda x: f.min_(x, 2), lambda v: min(v, 2)), "most": (lambda x: f.max_(x, 2), lambda v: max(v, 2)),
}


@pytest.mark.parametrize("name", POINTWISE)
def test_row_by_row(panel, name):
    term, plain = POINTWISE[name]
    got = values(panel, term(f.close))
    for i, xs in X.items():
        missing = {"anything_to_zero": 1.0, "least": 2.0, "most": 2.0}.get(name)  # least and most pass over what is missing
        same(got[i], [missing if x is None else plain(x) for x in xs])


def test_covariance_of_a_population(panel):
    got = values(panel, f.ts_cov(f.close, f.volume, 3))
    for i, xs in X.items():
        same(got[i], strict([None if x is None else (x, float(t)) for t, x in enumerate(xs)], 3, lambda w: (w[:, 0] * w[:, 1]).mean() - w[:, 0].mean() * w[:, 1].mean()))


def test_running_fields(panel):
    df = panel.withColumns({"high": F.col("close"), "low": F.col("close"), "open": F.col("close"), "amount": F.col("close") * F.col("vol")})
    terms = {"vwap": f.vwap, "top": f.high_so_far, "low_": f.low_so_far, "opened": f.open0}
    rows = compute(df, terms).orderBy("instrument", "t").collect()
    for i, xs in X.items():
        own = [r for r in rows if r["instrument"] == i]
        for t, x in enumerate(xs):
            there = [(v, float(s)) for s, v in enumerate(xs[: t + 1]) if v is not None]
            volume = sum(v for _, v in there)
            same([own[t]["vwap"]], [sum(a * v for a, v in there) / volume if volume else None])
            same([own[t]["top"], own[t]["low_"], own[t]["opened"]], [None if x is None else max(a for a, _ in there), None if x is None else min(a for a, _ in there), xs[0]])
