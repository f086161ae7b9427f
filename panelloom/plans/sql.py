"""Common table expressions shared by the comparison SQL (DuckDB dialect)."""

from __future__ import annotations

PRICES = """prices AS (
  SELECT o_orderpriority AS instrument, CAST(o_orderdate AS DATE) AS dt, avg(o_totalprice) AS px
  FROM orders GROUP BY 1, 2)"""

VENDOR_PRICES = """vendor_prices AS (
  SELECT o_orderstatus AS vendor, o_orderpriority AS instrument,
         CAST(o_orderdate AS DATE) AS dt, avg(o_totalprice) AS px
  FROM orders GROUP BY 1, 2, 3)"""

RETURNS = PRICES + """, rets AS (
  SELECT * FROM (
    SELECT instrument, dt, px AS px_t,
           lag(px) OVER (PARTITION BY instrument ORDER BY dt) AS px_t_1
    FROM prices) WHERE px_t_1 IS NOT NULL),
returns AS (SELECT instrument, dt, px_t, px_t_1, px_t / px_t_1 - 1 AS ret FROM rets)"""

ASSET_PRICES = """asset_prices AS (
  SELECT ['US10Y','US2Y','GOLD','USD_index','SP500','OIL','CARRY_ETF','TIPS'][(l_suppkey % 8) + 1] AS asset,
         CAST(l_shipdate AS DATE) AS dt, 1000 + avg(l_extendedprice / l_quantity) / 100 AS px
  FROM lineitem GROUP BY 1, 2)"""

ASSET_RETURNS = ASSET_PRICES + """, asset_returns AS (
  SELECT asset, dt, px, px_prev, px / px_prev - 1 AS ret FROM (
    SELECT asset, dt, px, lag(px) OVER (PARTITION BY asset ORDER BY dt) AS px_prev FROM asset_prices)
  WHERE px_prev IS NOT NULL)"""

STRATEGY = """strategy AS (
  SELECT l_returnflag AS portfolio, CAST(l_shipdate AS DATE) AS dt,
         round((avg(l_extendedprice) / 53000 - 1) * 0.02, 9) AS ret
  FROM lineitem GROUP BY 1, 2)"""

PROBS = """probs AS (
  SELECT l_returnflag AS portfolio, CAST(l_shipdate AS DATE) AS dt,
         [count(*) FILTER (l_linenumber % 4 = 0) / count(*),
          count(*) FILTER (l_linenumber % 4 = 1) / count(*),
          count(*) FILTER (l_linenumber % 4 = 2) / count(*),
          count(*) FILTER (l_linenumber % 4 = 3) / count(*)] AS p
  FROM lineitem GROUP BY 1, 2)"""

STATES = PROBS + """, states AS (
  SELECT portfolio, dt, p, list_position(p, list_max(p)) - 1 AS state,
         ['Easing','Reacceleration','Stagflation','Risk-Off'][list_position(p, list_max(p))] AS label
  FROM probs)"""

POSITIONS = """positions AS (
  SELECT o_orderpriority AS contract, o_orderstatus AS grp,
         CAST(date_trunc('week', o_orderdate) AS DATE) + 1 AS report_date,
         CAST(round(sum(CASE WHEN o_custkey % 2 = 0 THEN o_totalprice ELSE 0 END)) AS BIGINT) AS long,
         CAST(round(sum(CASE WHEN o_custkey % 2 <> 0 THEN o_totalprice ELSE 0 END)) AS BIGINT) AS short
  FROM orders GROUP BY 1, 2, 3)"""

# The same reports from exact sums: a sum of doubles near a half rounds by the order of its rows.
EXACT_POSITIONS = POSITIONS.replace("THEN o_totalprice", "THEN CAST(o_totalprice AS DECIMAL(18, 4))")

RELEASES = """releases AS (
  SELECT series_id, period, 'v' || v AS vintage_id,
         last_day(CAST(period + v * 11 AS DATE)) AS dt_ingest,
         CASE WHEN (month(period) + v) % 3 <> 0 THEN CAST(period + v * 9 AS DATE) END AS release_date,
         round(value, 4) AS value
  FROM (SELECT l_returnflag AS series_id, last_day(l_shipdate) AS period, l_linenumber AS v,
               avg(l_extendedprice) / 7 AS value FROM lineitem GROUP BY 1, 2, 3))"""

CURVE = """curve AS (
  SELECT CAST(l_shipdate AS DATE) AS dt, CAST(l_quantity AS BIGINT) * 8 AS tenor_days,
         round(avg(l_discount), 9) AS implied_rate
  FROM lineitem GROUP BY 1, 2)"""

SEQUENCES = """sequences AS (
  SELECT user_id AS series_id, CAST(ts AS DATE) AS dt,
         round(ln(1 + sum(value)), 9) AS x0, ln(1 + count(*)) AS x1
  FROM events GROUP BY 1, 2)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


def with_recursive(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts)
