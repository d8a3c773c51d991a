"""Common table expressions of the checking SQL: bars, weights, signals."""

from __future__ import annotations

_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey"


def bars_sql(kind: str) -> str:
    sales = "SELECT CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS instrument, l.* FROM lineitem l JOIN part ON l_partkey = p_partkey" if kind == "week" else "SELECT l_suppkey AS instrument, * FROM lineitem"
    return f"""sales AS ({sales}),
bars0 AS (SELECT instrument, CAST(date_trunc('{kind}', l_shipdate) AS TIMESTAMP) AS datetime, first(px ORDER BY {_ORDER}) AS open, max(px) AS high, min(px) AS low, last(px ORDER BY {_ORDER}) AS close,
  sum(l_quantity) AS vol, round(sum(l_extendedprice), 2) AS amount, count(*) AS trades FROM (SELECT *, l_extendedprice / l_quantity AS px FROM sales WHERE l_quantity > 0) GROUP BY 1, 2),
cal AS (SELECT datetime, CAST(year(datetime) * 10000 + 101 AS INT) AS date, CAST(row_number() OVER (PARTITION BY year(datetime) ORDER BY datetime) - 1 AS INT) AS minute_index FROM (SELECT DISTINCT datetime FROM bars0)),
bars AS (SELECT date, datetime, instrument, minute_index, open, high, low, close, vol, amount, trades FROM bars0 JOIN cal USING (datetime))"""


WEIGHTS = """quarters AS (SELECT date_trunc('quarter', datetime) AS q, instrument, sum(amount) AS a FROM bars GROUP BY 1, 2),
weights AS (SELECT CAST(strftime(q + INTERVAL 3 MONTH, '%Y%m%d') AS INT) AS trade_date, instrument, 100 * a / sum(a) OVER (PARTITION BY q) AS weight FROM quarters),
days AS (SELECT DISTINCT CAST(strftime(datetime, '%Y%m%d') AS INT) AS day FROM bars),
snaps AS (SELECT day, max(trade_date) AS trade_date FROM days JOIN weights ON trade_date <= day GROUP BY day),
wbars AS (SELECT b.*, snaps.trade_date, w.weight / 100 AS weight FROM bars b JOIN snaps ON snaps.day = CAST(strftime(b.datetime, '%Y%m%d') AS INT) JOIN weights w ON w.trade_date = snaps.trade_date AND w.instrument = b.instrument)"""

SPLIT = "CASE WHEN date // 10000 <= 1998 THEN 'train' WHEN date // 10000 >= 2000 THEN 'test' ELSE 'ignore' END"


def signals_sql(horizon: int) -> str:
    return f"""sig0 AS (SELECT *, lead(close, {horizon}) OVER (PARTITION BY date, instrument ORDER BY datetime) / nullif(close, 0) - 1 AS label, {SPLIT} AS split,
  CASE WHEN (instrument + minute_index) % 17 <> 0 THEN -(close / nullif(lag(close, 1) OVER (PARTITION BY instrument ORDER BY datetime), 0) - 1) END AS a,
  CASE WHEN (instrument + minute_index) % 17 <> 0 THEN close / nullif(lag(close, 5) OVER (PARTITION BY instrument ORDER BY datetime), 0) - 1 END AS b FROM bars),
sig AS (SELECT date, datetime, instrument, minute_index, split, amount, close, label, 'model_a' AS model_name, a AS pred FROM sig0 UNION ALL SELECT date, datetime, instrument, minute_index, split, amount, close, label, 'model_b', b FROM sig0)"""


def grid_sql(x: str, digits: int = 6) -> str:
    return f"CAST(floor(({x}) * 1e{digits} + 0.3217e0) / 1e{digits} AS DOUBLE) + 0.0"
