"""Factors over a panel: one projection per level, one shuffle per change of direction.

Terms are shared by structure, so a window that many factors use is computed once.  All
terms over time that can be computed next go into one projection on data dealt out by
instrument and block of time, all terms over instruments into one on data dealt out by
time.  The number of shuffles follows the number of changes between the two, however many
factors there are.  A block carries as many earlier bars as the terms until the next
change look back; what runs from the first bar on is carried from block to block.

The checking SQL has the same levels as common table expressions, but computes sliding
statistics from lists and knows no blocks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.factor import Term, clean
from barloom.operators import blocks
from barloom.operators.sliding import sliding

_INF = "CAST('infinity' AS DOUBLE)"
_TRUTH = {"<", "<=", ">", ">=", "=", "<>"}


def _element(t: Term, a: list[str]) -> str:
    op = t.op
    if op in "+-*":
        return f"{a[0]} {op} {a[1]}"
    if op in _TRUTH:
        missing = "1" if op == "<>" else "0"
        return f"CAST(coalesce(CAST({a[0]} {op} {a[1]} AS INT), {missing}) AS DOUBLE)"
    simple = {
        "/": "CASE WHEN {1} <> 0 THEN {0} / {1} WHEN {1} = 0 AND {0} > 0 THEN {inf} WHEN {1} = 0 AND {0} < 0 THEN -{inf} END",
        "pow": "CASE WHEN {0} = 1 OR {1} = 0 THEN CAST(1 AS DOUBLE) WHEN {0} < 0 AND {1} <> floor({1}) THEN NULL WHEN {0} = 0 AND {1} < 0 THEN {inf} ELSE pow({0}, {1}) END",
        "and": "CASE WHEN coalesce({0}, 0) <> 0 AND coalesce({1}, 0) <> 0 THEN 1e0 ELSE 0e0 END", "or": "CASE WHEN coalesce({0}, 0) <> 0 OR coalesce({1}, 0) <> 0 THEN 1e0 ELSE 0e0 END",
        "clean": "CASE WHEN isnan({0}) OR {0} = {inf} OR {0} = -{inf} THEN NULL ELSE {0} END", "if_present": "CASE WHEN {1} IS NOT NULL THEN {0} END",
        "steady": "CASE WHEN abs({0}) < 1e-12 THEN CAST(0 AS DOUBLE) ELSE round({0} * pow(CAST(10 AS DOUBLE), 8 - floor(log10(abs({0}))))) / pow(CAST(10 AS DOUBLE), 8 - floor(log10(abs({0})))) END",
        "ratio": "CASE WHEN {1} > 1e-10 * {3} AND {2} > 1e-10 * {4} THEN {0} / ({1} * {2}) END", "log": "CASE WHEN {0} > 0 THEN ln({0}) END", "sign": "CAST(sign({0}) AS DOUBLE)",
        "signed_sqrt": "sign({0}) * sqrt(abs({0}))", "signed_power": "CASE WHEN {1} IS NOT NULL AND NOT ({0} = 0 AND {1} < 0) THEN sign({0}) * pow(abs({0}), {1}) END",
        "safe_div": "CASE WHEN {1} <> 0 THEN {0} / {1} END", "least": "least({0}, {1})", "greatest": "greatest({0}, {1})", "abs": "abs({0})", "sin": "sin({0})",
        "sqrt": "CASE WHEN {0} >= 0 THEN sqrt({0}) END", "where": "CASE WHEN coalesce({0}, 0) <> 0 THEN {1} ELSE {2} END", "clip": "CASE WHEN {0} IS NOT NULL THEN greatest(least({0}, {2}), {1}) END",
    }
    if op in simple:
        return simple[op].format(*a, inf=_INF)
    raise ValueError(f"unknown function {op}")


def _over(keys: str) -> str:
    return f"PARTITION BY {keys} ORDER BY datetime"


def _window(t: Term, a: list[str], keys: str) -> str:
    n = t.params[0]
    if t.op == "lag":
        return f"lag({a[0]}, {n}) OVER ({_over(keys)})"
    rows = f"OVER ({_over(keys)} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({a[0]}) {rows} = {n} THEN {t.op}({', '.join(a)}) {rows} END"


def _checked_run(t: Term, a: list[str], keys: str) -> str:
    run = f"OVER ({_over(keys)} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return {
        "total": f"sum(coalesce({a[0]}, 0)) {run}", "max": f"CASE WHEN {a[0]} IS NOT NULL THEN max({a[0]}) {run} END", "min": f"CASE WHEN {a[0]} IS NOT NULL THEN min({a[0]}) {run} END",
        "first": f"first_value({a[0]}) {run}",
    }[t.op]


def _checked_slide(t: Term, a: list[str], keys: str) -> str:
    """From the list of the window's values."""
    n, x = t.params[0], a[0]
    rows = f"OVER ({_over(keys)} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    bars = f"list({x}) {rows}"
    value = {
        "product": f"list_product({bars})", "argmax": f"list_position({bars}, max({x}) {rows}) - 1", "argmin": f"list_position({bars}, min({x}) {rows}) - 1",
        "rank": f"(list_sum(list_transform({bars}, lambda v: CASE WHEN v < {x} THEN 1e0 WHEN v = {x} THEN 0.5e0 ELSE 0e0 END)) + 0.5e0) / {n}",
        "decay": f"list_sum(list_transform({bars}, lambda v, i: v * ({n} + 1 - i))) / {n * (n + 1) // 2}",
    }[t.op]
    return f"CASE WHEN count({x}) {rows} = {n} THEN CAST({value} AS DOUBLE) END"


def _section(t: Term, a: list[str], keys: str, percentile: str) -> str:
    at = f"PARTITION BY {keys}datetime"
    x = a[0]
    return {
        "rank": f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER ({at}, {x} IS NULL ORDER BY {x}) + (count(*) OVER ({at}, {x}) - 1) * 0.5e0) / count({x}) OVER ({at}) END",
        "scale": f"{t.params[0] if t.params else 1}e0 * {x} / nullif(sum(abs({x})) OVER ({at}), 0)",
        "neutralize": f"{x} - avg({x}) OVER ({at}, {a[-1]})",
        "percentile": f"{percentile}({x}, {t.params[0] if t.params else 0}) OVER ({at})",
    }[t.op]


def _levels(factors: Mapping[str, Term]) -> tuple[list[tuple[str, dict[str, Term]]], dict[Term, str]]:
    """Groups of terms that can be computed together, in order, and the column of each term."""
    names: dict[Term, str] = {}
    waiting: dict[Term, None] = {}

    def visit(t: Term) -> None:
        if t in names or t in waiting:
            return
        if t.kind == "field":
            names[t] = t.op
        elif t.kind == "value":
            names[t] = f"CAST({t.op} AS DOUBLE)"
        else:
            for x in t.args:
                visit(x)
            waiting[t] = None

    for t in factors.values():
        visit(t)
    levels, kind = [], "run"
    while waiting:
        ready = [t for t in waiting if all(x in names for x in t.args)]
        kinds = {t.kind for t in ready}
        alike = ("sl", "ts") if kind in ("sl", "ts") else (kind,)  # go on in the direction of the last level
        now = next((k for k in ("el", *alike) if k in kinds), None) or next(k for k in ("run", "ts", "sl", "cs") if k in kinds)
        if now != "el":
            kind = now
        group = {f"c{len(names) + k}_": t for k, t in enumerate(t for t in ready if t.kind == now)}
        for name, t in group.items():
            names[t] = name
            del waiting[t]
        levels.append((now, group))
    return levels, names


def _stretches(levels: list) -> list[tuple[str, int, list]]:
    """Levels of one direction together, with the bars that they look back: ``time`` for ts and sl, also across levels of elements."""
    out: list = []
    for kind, group in levels:
        way = {"ts": "time", "sl": "time"}.get(kind, kind)
        back = max(t.params[0] - (t.op != "lag") for t in group.values()) if way == "time" else 0
        if way == "time" and [w for w, *_ in out[-2:]] == ["time", "el"]:
            out[-2:] = [["time", out[-2][1], out[-2][2] + out[-1][2]]]
        if out and way in ("time", "el") and out[-1][0] == way:
            out[-1][1] += back
            out[-1][2].append((kind, group))
        else:
            out.append([way, back, [(kind, group)]])
    return out


_RUN = {"total": "sum", "max": "max", "min": "min", "first": "first"}


def compute(panel: DataFrame, factors: Mapping[str, Term], keys: tuple[str, ...] = (), block: int = blocks.BLOCK) -> DataFrame:
    """``panel`` with a column for each factor.

    ``panel`` has instrument, datetime and the fields, one row per pair, and pos_ (see
    ``densify``), by which histories are cut into blocks of ``block`` bars; without pos_
    each is one block.  ``keys`` are further columns that separate panels, such as the
    day evaluated.
    """
    factors = {n: clean(t) for n, t in factors.items()}
    levels, names = _levels(factors)
    base = [c for c in panel.columns if c != "pos_"]
    if "pos_" not in panel.columns:
        panel = panel.withColumn("pos_", F.lit(0))
    series = [*keys, "instrument"]
    lead, whole, by_time = "".join(f"{k}, " for k in keys), ", ".join([*series, "block_"]), False
    level, until = -1, {names[x]: k for k, (_, group) in enumerate(levels) for t in group.values() for x in t.args}  # the last level that needs a column
    until |= {names[t]: len(levels) for t in factors.values()} | {c: len(levels) for c in [*base, "pos_", "block_", "own_"]}
    for way, back, inner in _stretches(levels):
        by_time, dealt = way == "cs" or (by_time and way == "el"), by_time
        if way == "cs" and not dealt:
            panel = panel.repartition(*keys, "datetime")
        if way == "run":
            for _, group in inner:
                level += 1
                runs = {n: (_RUN[t.op], F.expr(names[t.args[0]])) for n, t in group.items()}
                cut = panel.withColumn("block_", F.floor(F.col("pos_") / block)).repartition(*series, "block_")
                panel = blocks.scan(cut, series, "block_", "datetime", runs).drop("block_")
                panel = panel.withColumns({n: F.when(F.expr(names[t.args[0]]).isNotNull(), F.col(n)) for n, t in group.items() if t.op in ("max", "min")})
            continue
        elif way == "time":
            panel = blocks.with_halo(panel, back, block).repartition(*series, "block_")
        for kind, group in inner:
            level += 1
            if kind == "sl":  # Catalyst cannot tell which columns are still needed behind it
                values = {x: n for n, x in enumerate(dict.fromkeys(names[t.args[0]] for t in group.values()))}
                needed = [c for c in panel.columns if until.get(c, -1) > level]
                panel = panel.select(*needed, *[F.expr(x).cast("double").alias(f"x{n}_") for x, n in values.items()])
                panel = sliding(panel, [*series, "block_"], "datetime", [(n, t.op, f"x{values[names[t.args[0]]]}_", t.params[0]) for n, t in group.items()]).drop(*[f"x{n}_" for n in values.values()])
                continue
            made = {n: (t, [names[x] for x in t.args]) for n, t in group.items()}
            sql = {n: _element(t, a) if kind == "el" else _window(t, a, whole) if kind == "ts" else _section(t, a, lead, "percentile") for n, (t, a) in made.items()}
            panel = panel.select("*", *[F.expr(x).alias(n) for n, x in sql.items()])
        if way == "time":
            panel = panel.where("own_").drop("own_", "block_")
    return panel.select(*base, *[F.expr(names[t]).alias(n) for n, t in factors.items()])


def checking_sql(source: str, factors: Mapping[str, Term], base: list[str], keys: tuple[str, ...] = ()) -> tuple[str, str]:
    """(common table expressions, name of the last) that compute the factors from table ``source``."""
    factors = {n: clean(t) for n, t in factors.items()}
    levels, names = _levels(factors)
    series, lead = ", ".join([*keys, "instrument"]), "".join(f"{k}, " for k in keys)
    forms = {"el": _element, "ts": lambda t, a: _window(t, a, series), "run": lambda t, a: _checked_run(t, a, series), "sl": lambda t, a: _checked_slide(t, a, series), "cs": lambda t, a: _section(t, a, lead, "quantile_cont")}
    steps, at = [], source
    for k, (kind, group) in enumerate(levels):
        made = ", ".join(f"{forms[kind](t, [names[x] for x in t.args])} AS {n}" for n, t in group.items())
        steps.append(f"lv{k} AS MATERIALIZED (SELECT *, {made} FROM {at})")
        at = f"lv{k}"
    steps.append(f"computed AS (SELECT {', '.join(base)}, {', '.join(f'{names[t]} AS {n}' for n, t in factors.items())} FROM {at})")
    return ",\n".join(steps), "computed"


def densify(bars: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Every instrument at every time of its panel, with pos_, the number of the time; bars that are missing are NULL.

    The grid is the distinct times of each panel with the list of its instruments, which
    is made by a combined aggregation and has as many entries as instruments.
    """
    panel = F.struct(*keys) if keys else F.lit(0)
    one = bars.withColumn("panel_", panel)
    members = one.groupBy("panel_").agg(F.collect_set("instrument").alias("instruments"))
    times = one.select("panel_", "datetime").distinct().withColumn("pos_", F.row_number().over(Window.partitionBy("panel_").orderBy("datetime")) - 1)  # one row per time
    grid = times.join(members, "panel_") if keys else times.crossJoin(F.broadcast(members.drop("panel_")))  # without keys, members is one row
    grid = grid.select("panel_", "datetime", "pos_", F.explode("instruments").alias("instrument"))
    columns = [c for c in bars.columns if c not in (*keys, "datetime", "instrument")]
    return grid.join(one, ["panel_", "datetime", "instrument"], "left").select(*[F.col(f"panel_.{k}").alias(k) for k in keys], "datetime", "instrument", "pos_", *columns)
