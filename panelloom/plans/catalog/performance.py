"""Portfolio metrics, rankings and report marts."""

from pyspark.sql import functions as F

from panelloom.operators import marts, quality
from panelloom.operators import performance as P
from panelloom.operators.returns import simple_returns, transition_matrix
from panelloom.plans.catalog.windows import ROLLING_RISK, TRANSITIONS
from panelloom.plans.registry import query
from panelloom.session import stored
from panelloom.plans.sql import PROBS, RETURNS, STATES, STRATEGY, with_
from panelloom.sources import panels

KEY = ["portfolio"]


def r(value, digits=6):
    return F.round(F.col(value) if isinstance(value, str) else value, digits)


def rounded(df, *names, digits=6):
    return df.withColumns({n: r(n, digits) for n in names})


CURVES = """,
nav AS (SELECT *, product(1 + ret) OVER (PARTITION BY portfolio ORDER BY dt) AS nav FROM strategy),
dd AS (SELECT *, nav / max(nav) OVER (PARTITION BY portfolio ORDER BY dt) - 1 AS drawdown FROM nav)"""
METRICS = CURVES + """,
agg AS (SELECT portfolio, count(*) AS n, product(1 + ret) - 1 AS total, avg(ret) AS mean, stddev_samp(ret) AS sd,
  stddev_samp(ret) FILTER (ret < 0.02 / 252) AS down, min(drawdown) AS mdd, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS hit,
  quantile_cont(ret, 0.05) AS q05, quantile_cont(ret, 0.95) AS q95 FROM dd GROUP BY portfolio),
tail AS (SELECT s.portfolio, avg(ret) AS cvar FROM strategy s JOIN agg USING (portfolio) WHERE ret <= q05 GROUP BY 1)"""


@query("a7_a8_a9_portfolio_metrics", with_(STRATEGY) + METRICS + """
SELECT portfolio, n AS n_trading_days, round(total, 6) AS total_return, round(pow(1 + total, 252 / n) - 1, 6) AS cagr,
  round(sd * sqrt(252), 6) AS ann_vol, round((mean - 0.02 / 252) / sd * sqrt(252), 6) AS sharpe,
  round((mean - 0.02 / 252) / down * sqrt(252), 6) AS sortino, round(mdd, 6) AS max_drawdown,
  round(CASE WHEN mdd < 0 THEN (pow(1 + total, 252 / n) - 1) / abs(mdd) ELSE 0 END, 6) AS calmar, round(hit, 6) AS hit_rate,
  round(q05, 6) AS var_95, round(cvar, 6) AS cvar_95, round(CASE WHEN q05 < 0 THEN q95 / abs(q05) ELSE 0 END, 6) AS tail_ratio
FROM agg JOIN tail USING (portfolio)""")
def a7_a9(t):
    out = P.return_metrics(stored(panels.strategy(t), "strategy"), KEY, risk_free=0.02)
    return rounded(out, *[c for c in out.columns if c not in ("portfolio", "n_trading_days")])


@query("a7_performance", with_(RETURNS) + """,
nav AS (SELECT *, product(1 + ret) OVER (PARTITION BY instrument ORDER BY dt) AS nav FROM returns),
dd AS (SELECT *, nav / max(nav) OVER (PARTITION BY instrument ORDER BY dt) - 1 AS drawdown FROM nav)
SELECT instrument, count(*) AS n_trading_days, round(product(1 + ret) - 1, 6) AS total_return,
  round(avg(ret) / stddev_samp(ret) * sqrt(252), 6) AS sharpe, round(stddev_samp(ret) * sqrt(252), 6) AS ann_vol,
  round(min(drawdown), 6) AS max_drawdown FROM dd GROUP BY instrument""")
def a7(t):
    daily = stored(simple_returns(panels.prices(t), ["instrument"]), "returns")
    out = P.return_metrics(daily, ["instrument"])
    kept = out.select("instrument", "n_trading_days", "total_return", "sharpe", "ann_vol", "max_drawdown")
    return rounded(kept, "total_return", "sharpe", "ann_vol", "max_drawdown")


LOG = STATES + """,
log AS (SELECT portfolio, dt, state, label, list_max(p) AS max_prob,
  coalesce(list_sum([abs(p[i] - prev[i]) FOR i IN [1, 2, 3, 4]]), 0) AS distance,
  coalesce(list_sum([abs(p[i] - prev[i]) FOR i IN [1, 2, 3, 4]]), 0) > 0.7 OR list_max(p) >= 0.6 AS do_rebalance,
  list_max(p) >= 0.6 AS surprise_triggered
  FROM (SELECT *, lag(p) OVER (PARTITION BY portfolio ORDER BY dt) AS prev FROM states))"""


def decision_log(t, states=None):
    """Decision rows from probability moves between consecutive days."""
    from panelloom.functions.probability import l1_distance, max_prob
    from panelloom.operators.returns import by_date

    moved = (states or panels.states(t)).withColumn("prev", F.lag("p").over(by_date(KEY)))
    scored = moved.withColumn("distance", F.coalesce(l1_distance(F.col("p"), F.col("prev")), F.lit(0.0)))
    confident = max_prob(F.col("p"))
    return scored.select(
        "portfolio", "dt", "state", "label", confident.alias("max_prob"), "distance",
        ((F.col("distance") > 0.7) | (confident >= 0.6)).alias("do_rebalance"),
        (confident >= 0.6).alias("surprise_triggered"),
    )


@query("a10_rebalance_metrics", with_(LOG) + """
SELECT portfolio, count(*) FILTER (do_rebalance) AS n_rebalances, round(count(*) / count(*) FILTER (do_rebalance), 6) AS avg_rebal_freq_days,
  round(avg(distance), 6) AS avg_jsd_distance, count(*) FILTER (surprise_triggered) AS surprise_rebalances,
  round(avg(max_prob), 6) AS avg_max_regime_prob FROM log GROUP BY portfolio""")
def a10(t):
    out = P.rebalance_metrics(decision_log(t), KEY)
    return rounded(out, "avg_rebal_freq_days", "avg_jsd_distance", "avg_max_regime_prob")


CONDITIONAL = """ SELECT s.portfolio, label, round(avg(ret), 6) AS mean_daily_ret, round(avg(ret) * 252, 6) AS ann_ret,
  round(stddev_samp(ret) * sqrt(252), 6) AS vol, count(*) AS "count"
FROM strategy s JOIN states t ON s.portfolio = t.portfolio AND s.dt = t.dt GROUP BY 1, 2"""


@query("a11_j10_conditional_returns", with_(STRATEGY, STATES) + CONDITIONAL)
def a11(t):
    out = P.conditional_returns(panels.strategy(t), panels.states(t), KEY)
    return rounded(out, "mean_daily_ret", "ann_ret", "vol")


@query("a12_regime_durations", with_(STATES) + """,
flagged AS (SELECT portfolio, dt, label, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY portfolio ORDER BY dt) THEN 1 ELSE 0 END AS c FROM states),
runs AS (SELECT *, sum(c) OVER (PARTITION BY portfolio ORDER BY dt) AS run FROM flagged),
lens AS (SELECT portfolio, label, run, count(*) AS n FROM runs GROUP BY ALL)
SELECT portfolio, label, round(avg(n), 6) AS mean_run FROM lens GROUP BY 1, 2""")
def a12(t):
    return rounded(P.regime_durations(panels.states(t), KEY), "mean_run")


ALLOC = PROBS + """,
weights AS (SELECT portfolio, dt, ['a0','a1','a2','a3'][i] AS asset, p[i] - 0.25 AS w FROM probs, (VALUES (1), (2), (3), (4)) x(i))"""


def long_weights(t):
    """Long weights per asset: the probability of each class less a quarter."""
    long = panels.probabilities(t).select("portfolio", "dt", F.posexplode("p").alias("k", "prob"))
    return long.select("portfolio", "dt", F.concat(F.lit("a"), F.col("k")).alias("asset"), (F.col("prob") - 0.25).alias("w"))


EXPOSURE = """,
moved AS (SELECT *, abs(w - lag(w) OVER (PARTITION BY portfolio, asset ORDER BY dt)) AS m FROM weights),
exposure AS (SELECT portfolio, dt, sum(abs(w)) AS gross, sum(w) AS net, coalesce(sum(m), 0) AS turnover FROM moved GROUP BY 1, 2)"""


@query("a13_alternate_metrics", with_(STRATEGY, ALLOC) + CURVES + EXPOSURE + """,
agg AS (SELECT portfolio, count(*) AS n, product(1 + ret) AS growth, stddev_samp(ret) * sqrt(252) AS vol,
  stddev_samp(ret) FILTER (ret < 0) * sqrt(252) AS down, min(drawdown) AS mdd FROM dd GROUP BY 1),
tr AS (SELECT portfolio, avg(turnover) AS tv FROM exposure GROUP BY 1)
SELECT portfolio, n AS n_days, round(pow(growth, 252 / n) - 1, 6) AS cagr, round(vol, 6) AS ann_vol,
  round((pow(growth, 252 / n) - 1 - 0.05) / vol, 6) AS sharpe, round((pow(growth, 252 / n) - 1 - 0.05) / down, 6) AS sortino,
  round(mdd, 6) AS max_drawdown, round(CASE WHEN mdd < 0 THEN (pow(growth, 252 / n) - 1) / abs(mdd) END, 6) AS calmar,
  round(tv, 6) AS avg_daily_turnover FROM agg JOIN tr USING (portfolio)""")
def a13(t):
    turnover = marts.weight_diagnostics(long_weights(t), KEY)
    out = P.alternate_metrics(panels.strategy(t), turnover, KEY)
    return rounded(out, *[c for c in out.columns if c not in ("portfolio", "n_days")])


@query("a14_versus_benchmark", with_(STRATEGY) + """,
bench AS (SELECT dt, avg(ret) AS b FROM strategy GROUP BY dt),
agg AS (SELECT portfolio, count(*) AS n, product(1 + b) - 1 AS bt, product(1 + ret) - 1 AS total, avg(ret - b) AS m, stddev_samp(ret - b) AS sd
  FROM strategy JOIN bench USING (dt) GROUP BY 1)
SELECT portfolio, round(bt, 6) AS benchmark_total_return, round(pow(1 + bt, 252 / n) - 1, 6) AS benchmark_cagr,
  round(pow(1 + total, 252 / n) - pow(1 + bt, 252 / n), 6) AS alpha_cagr, round(m / sd * sqrt(252), 6) AS information_ratio FROM agg""")
def a14(t):
    base = stored(panels.strategy(t), "strategy")
    out = P.versus_benchmark(base, P.equal_weight_benchmark(base), KEY)
    return rounded(out, "benchmark_total_return", "benchmark_cagr", "alpha_cagr", "information_ratio")


@query("a6_daily_net_sum", """
SELECT o_orderpriority AS portfolio, CAST(o_orderdate AS DATE) AS dt, round(sum(o_totalprice / 700000 - 0.25), 9) AS ret FROM orders GROUP BY 1, 2""")
def a6(t):
    return t.orders.groupBy(F.col("o_orderpriority").alias("portfolio"), F.col("o_orderdate").cast("date").alias("dt")).agg(
        r(F.sum(F.col("o_totalprice") / 700000 - 0.25), 9).alias("ret")
    )


@query("a16_state_shares", with_(STATES) + """
SELECT portfolio, CAST(state AS INTEGER) AS state, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY portfolio), 6) AS share
FROM states GROUP BY 1, 2""")
def a16(t):
    return rounded(P.state_shares(panels.states(t), KEY, "state"), "share")


@query("a17_signal_quantiles", with_(STRATEGY) + """
SELECT portfolio, round(quantile_cont(ret, 0.01), 6) AS q01, round(quantile_cont(ret, 0.05), 6) AS q05,
  round(quantile_cont(ret, 0.95), 6) AS q95, round(quantile_cont(ret, 0.99), 6) AS q99 FROM strategy GROUP BY 1""")
def a17(t):
    return rounded(P.quantiles(panels.strategy(t), KEY, "ret", [0.01, 0.05, 0.95, 0.99]), "q01", "q05", "q95", "q99")


@query("q13_acceptance_gates", with_(STRATEGY, LOG) + CURVES + """,
m AS (SELECT portfolio, min(drawdown) AS mdd FROM dd GROUP BY 1),
l AS (SELECT portfolio, avg(max_prob) AS mp, count(*) FILTER (do_rebalance) AS n FROM log GROUP BY 1)
SELECT portfolio, mdd > -0.2 AS max_drawdown_ok, mp < 0.995 AS state_confidence_not_collapsed, n >= 5 AS enough_rebalances,
  mdd > -0.2 AND mp < 0.995 AND n >= 5 AS all_pass FROM m JOIN l USING (portfolio)""")
def q13(t):
    metrics = P.return_metrics(stored(panels.strategy(t), "strategy"), KEY).join(P.rebalance_metrics(decision_log(t), KEY), KEY)
    return quality.acceptance(metrics).select(
        "portfolio", "max_drawdown_ok", "state_confidence_not_collapsed", "enough_rebalances", "all_pass"
    )


# --- marts ----------------------------------------------------------------------------


@query("r1_returns_nav_events", with_(STRATEGY, LOG) + """,
sig AS (SELECT portfolio, dt, product(1 + ret) OVER w AS nav, ln(1 + greatest(ret, -0.999999)) AS s FROM strategy
  WINDOW w AS (PARTITION BY portfolio ORDER BY dt)),
means AS (SELECT *, CASE WHEN count(s) OVER a >= 5 THEN avg(s) OVER a END AS m21, CASE WHEN count(s) OVER b >= 10 THEN avg(s) OVER b END AS m63
  FROM sig WINDOW a AS (PARTITION BY portfolio ORDER BY dt ROWS BETWEEN 20 PRECEDING AND CURRENT ROW),
                  b AS (PARTITION BY portfolio ORDER BY dt ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)),
ch AS (SELECT portfolio, dt, state IS DISTINCT FROM lag(state) OVER (PARTITION BY portfolio ORDER BY dt) AS changed FROM states)
SELECT m.portfolio, m.dt, round(nav - 1, 6) AS cumulative_return, round(nav, 6) AS nav, round(s, 6) AS signal, round(m21, 6) AS mean_21,
  round(m63, 6) AS mean_63, coalesce(changed, false) AS regime_change, coalesce(do_rebalance, false) AS trade
FROM means m LEFT JOIN ch ON ch.portfolio = m.portfolio AND ch.dt = m.dt LEFT JOIN log l ON l.portfolio = m.portfolio AND l.dt = m.dt""")
def r1(t):
    states = stored(panels.states(t), "states")
    out = marts.returns_nav_events(panels.strategy(t), states, decision_log(t, states), KEY)
    return rounded(out, "cumulative_return", "nav", "signal", "mean_21", "mean_63")


@query("r2_underwater", with_(STRATEGY) + CURVES + ", risk AS (" + ROLLING_RISK + """)
SELECT d.portfolio, d.dt, round(drawdown, 6) AS drawdown, vol, sharpe FROM dd d JOIN risk k ON k.portfolio = d.portfolio AND k.dt = d.dt""")
def r2(t):
    return rounded(marts.underwater(panels.strategy(t), KEY), "drawdown", "vol", "sharpe")


@query("r3_probability_stack", with_(STATES) + """
SELECT portfolio, dt, CAST(state AS INTEGER) AS state, CAST(k AS INTEGER) AS k, round(greatest(0, least(1, p[k + 1])), 6) AS prob
FROM states, (VALUES (0), (1), (2), (3)) x(k)""")
def r3(t):
    return rounded(marts.probability_stack(panels.states(t), KEY), "prob")


@query("r4_transition_mart", with_(STATES) + TRANSITIONS)
def r4(t):
    return rounded(transition_matrix(panels.states(t), KEY, "state"), "share")


@query("w13_r5_weight_diagnostics", with_(ALLOC) + EXPOSURE + """
SELECT portfolio, dt, round(gross, 6) AS gross, round(net, 6) + 0.0 AS net, round(turnover, 6) AS turnover FROM exposure""")
def r5(t):
    out = marts.weight_diagnostics(long_weights(t), KEY)
    return rounded(out, "gross", "net", "turnover").withColumn("net", F.col("net") + 0.0)


@query("t4_r5_top_assets", with_(ALLOC) + """
SELECT portfolio, asset, round(m, 6) AS mean_abs, CAST(rn AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY m DESC, asset) AS rn FROM (
    SELECT portfolio, asset, avg(abs(w)) AS m FROM weights GROUP BY 1, 2)) WHERE rn <= 10""")
def t4(t):
    return rounded(marts.top_assets(long_weights(t), KEY), "mean_abs")


@query("r6_rebalance_series", with_(LOG) + """
SELECT portfolio, dt, round(distance, 6) AS distance, round(CASE WHEN do_rebalance THEN distance END, 6) AS trigger,
  round(max_prob, 6) AS max_prob, CASE WHEN surprise_triggered THEN 1.0::DOUBLE END AS surprise_mark FROM log""")
def r6(t):
    return rounded(marts.rebalance_series(decision_log(t), KEY), "distance", "trigger", "max_prob")


@query("r7_box_statistics", with_(STRATEGY, STATES) + """
SELECT s.portfolio, label, round(quantile_cont(ret, 0.05), 6) AS q05, round(quantile_cont(ret, 0.25), 6) AS q25, round(quantile_cont(ret, 0.5), 6) AS median,
  round(quantile_cont(ret, 0.75), 6) AS q75, round(quantile_cont(ret, 0.95), 6) AS q95, round(avg(ret), 6) AS mean, round(min(ret), 6) AS low,
  round(max(ret), 6) AS high, count(*) AS n FROM strategy s JOIN states t ON s.portfolio = t.portfolio AND s.dt = t.dt GROUP BY 1, 2""")
def r7_box(t):
    out = marts.box_statistics(marts.labelled_returns(panels.strategy(t), panels.states(t), KEY), KEY)
    return rounded(out, "q05", "q25", "median", "q75", "q95", "mean", "low", "high")


@query("r7_histogram", with_(STRATEGY) + """,
edges AS (SELECT portfolio, min(ret) AS lo, max(ret) AS hi FROM strategy GROUP BY 1)
SELECT portfolio, CAST(least(floor((ret - lo) / (hi - lo) * 60) + 1, 60) AS BIGINT) AS bin, count(*) AS n
FROM strategy JOIN edges USING (portfolio) GROUP BY 1, 2""")
def r7_hist(t):
    return marts.histogram(stored(panels.strategy(t), "strategy"), KEY)


@query("t1_output_sort", with_(RETURNS) + """
SELECT dt, instrument, round(ret, 6) AS ret FROM returns ORDER BY dt, instrument""")
def t1(t):
    out = simple_returns(panels.prices(t), ["instrument"])
    return out.select("dt", "instrument", r("ret").alias("ret")).orderBy("dt", "instrument")


@query("t6_argmax_state", with_(STATES) + """
SELECT portfolio, dt, CAST(state AS INTEGER) AS state, label, round(list_max(p), 6) AS max_prob FROM states""")
def t6(t):
    out = panels.states(t).withColumn("max_prob", r(F.array_max("p")))
    return out.select("portfolio", "dt", "state", "label", "max_prob")
