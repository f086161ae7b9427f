"""Window queries: returns, rolling statistics, compounding, runs, folds."""

from pyspark.sql import functions as F

from panelloom.operators import returns as R
from panelloom.plans.registry import query
from panelloom.plans.sql import EXACT_POSITIONS, RETURNS, STATES, STRATEGY, VENDOR_PRICES, with_
from panelloom.sources import panels


def r(value, digits=6):
    return F.round(F.col(value) if isinstance(value, str) else value, digits)


@query("w1_simple_returns", with_(VENDOR_PRICES) + """
SELECT vendor, instrument, dt, round(px, 4) AS px_t, round(prev, 4) AS px_t_1, round(px / prev - 1, 6) AS ret
FROM (SELECT *, lag(px) OVER (PARTITION BY vendor, instrument ORDER BY dt) AS prev FROM vendor_prices)
WHERE prev IS NOT NULL""")
def w1(t):
    out = R.simple_returns(panels.vendor_prices(t), ["vendor", "instrument"])
    return out.select("vendor", "instrument", "dt", r("px_t", 4).alias("px_t"),
                      r("px_t_1", 4).alias("px_t_1"), r("ret").alias("ret"))


@query("w2_positioning_zscore", with_(EXACT_POSITIONS) + """
SELECT contract, grp, report_date, long - short AS net_pos,
       round(CASE WHEN count(*) OVER w >= 4 THEN
         ((long - short) - avg(long - short) OVER w) / nullif(stddev_samp(long - short) OVER w, 0) END, 6) AS zscore
FROM positions
WINDOW w AS (PARTITION BY contract, grp ORDER BY report_date ROWS BETWEEN 259 PRECEDING AND CURRENT ROW)""")
def w2(t):
    net = panels.weekly_positions(t).withColumn("net_pos", F.col("long") - F.col("short"))
    z = R.rolling_zscore(net, ["contract", "grp"], "net_pos", 260, 4, "report_date")
    return z.select("contract", "grp", "report_date", "net_pos", r("zscore").alias("zscore"))


@query("w3_rolling_means", with_(RETURNS) + """
SELECT instrument, dt,
  round(CASE WHEN count(ret) OVER w5 >= 3 THEN avg(ret) OVER w5 END, 6) AS ma5,
  round(CASE WHEN count(ret) OVER w20 >= 10 THEN avg(ret) OVER w20 END, 6) AS ma20
FROM returns WINDOW w5 AS (PARTITION BY instrument ORDER BY dt ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
  w20 AS (PARTITION BY instrument ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def w3(t):
    ret = R.simple_returns(panels.prices(t), ["instrument"])
    key = ["instrument"]
    return ret.select(
        "instrument", "dt",
        r(R.rolling_mean("ret", R.trailing(key, 5), 3)).alias("ma5"),
        r(R.rolling_mean("ret", R.trailing(key, 20), 10)).alias("ma20"),
    )


@query("w5_first_difference", with_(VENDOR_PRICES) + """
SELECT vendor, instrument, dt,
  round(px - lag(px) OVER (PARTITION BY vendor, instrument ORDER BY dt), 4) AS diff FROM vendor_prices""")
def w5(t):
    out = R.first_difference(panels.vendor_prices(t), ["vendor", "instrument"], "px")
    return out.select("vendor", "instrument", "dt", r("diff", 4).alias("diff"))


@query("w7_nav", with_(STRATEGY) + """
SELECT portfolio, dt, round(product(1 + ret) OVER (PARTITION BY portfolio ORDER BY dt), 6) AS nav FROM strategy""")
def w7(t):
    return R.net_asset_value(panels.strategy(t), ["portfolio"]).select("portfolio", "dt", r("nav").alias("nav"))


@query("w8_drawdown", with_(STRATEGY) + """, nav AS (
SELECT portfolio, dt, product(1 + ret) OVER (PARTITION BY portfolio ORDER BY dt) AS nav FROM strategy)
SELECT portfolio, dt, round(max(nav) OVER w, 6) AS peak, round(nav / max(nav) OVER w - 1, 6) AS drawdown
FROM nav WINDOW w AS (PARTITION BY portfolio ORDER BY dt)""")
def w8(t):
    nav = R.net_asset_value(panels.strategy(t), ["portfolio"])
    return nav.select("portfolio", "dt", r("peak").alias("peak"), r("drawdown").alias("drawdown"))


ROLLING_RISK = """SELECT portfolio, dt,
  round(CASE WHEN count(ret) OVER w >= 20 THEN stddev_samp(ret) OVER w END * sqrt(252), 6) AS vol,
  round(CASE WHEN count(ret) OVER w >= 20 THEN avg(ret) OVER w / nullif(stddev_samp(ret) OVER w, 0) END
        * sqrt(252), 6) AS sharpe
FROM strategy WINDOW w AS (PARTITION BY portfolio ORDER BY dt ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)"""


@query("w9_rolling_risk", with_(STRATEGY) + ROLLING_RISK)
def w9(t):
    out = R.rolling_risk(panels.strategy(t), ["portfolio"])
    return out.select("portfolio", "dt", r("vol").alias("vol"), r("sharpe").alias("sharpe"))


@query("w10_signal_means", with_(STRATEGY) + """, sig AS (
SELECT portfolio, dt, ln(1 + greatest(ret, -0.999999)) AS s FROM strategy)
SELECT portfolio, dt, round(s, 6) AS signal,
  round(CASE WHEN count(s) OVER a >= 5 THEN avg(s) OVER a END, 6) AS mean_21,
  round(CASE WHEN count(s) OVER b >= 10 THEN avg(s) OVER b END, 6) AS mean_63
FROM sig WINDOW a AS (PARTITION BY portfolio ORDER BY dt ROWS BETWEEN 20 PRECEDING AND CURRENT ROW),
  b AS (PARTITION BY portfolio ORDER BY dt ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)""")
def w10(t):
    out = R.signal_means(R.signal(panels.strategy(t), ["portfolio"], "log"), ["portfolio"])
    return out.select("portfolio", "dt", *[r(c).alias(c) for c in ("signal", "mean_21", "mean_63")])


@query("w11_change_points", with_(STATES) + """
SELECT portfolio, dt, CAST(state AS INTEGER) AS state FROM (
  SELECT *, lag(state) OVER (PARTITION BY portfolio ORDER BY dt) AS prev FROM states)
WHERE state IS DISTINCT FROM prev""")
def w11(t):
    out = R.change_points(panels.states(t), ["portfolio"], "state")
    return out.where("changed").select("portfolio", "dt", "state")


TRANSITIONS = """, pairs AS (
SELECT portfolio, state AS to_state, lag(state) OVER (PARTITION BY portfolio ORDER BY dt) AS from_state FROM states),
counts AS (SELECT portfolio, from_state, to_state, count(*) AS n FROM pairs WHERE from_state IS NOT NULL GROUP BY ALL)
SELECT portfolio, CAST(from_state AS INTEGER) AS from_state, CAST(to_state AS INTEGER) AS to_state, n,
  round(n / sum(n) OVER (PARTITION BY portfolio, from_state), 6) AS share FROM counts"""


@query("w12_transition_matrix", with_(STATES) + TRANSITIONS)
def w12(t):
    out = R.transition_matrix(panels.states(t), ["portfolio"], "state")
    return out.withColumn("share", r("share"))
