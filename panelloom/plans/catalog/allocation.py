"""Probability functions, weights, costs, folds, scaling, scenarios and paths."""

from pyspark.sql import functions as F

from panelloom.functions import probability as PF
from panelloom.operators import allocation as A
from panelloom.operators import folds, pnl, scaling, scenarios
from panelloom.operators import performance as P
from panelloom.operators.returns import by_date
from panelloom.plans import backtest as B
from panelloom.plans.registry import query
from panelloom.session import stored
from panelloom.plans.sql import ASSET_RETURNS, PROBS, SEQUENCES, STATES, STRATEGY, with_, with_recursive
from panelloom.sources import panels

KEY = ["portfolio"]
REGIMES = list(A.REGIME_WEIGHTS)


def r(value, digits=6):
    return F.round(F.col(value) if isinstance(value, str) else value, digits)


def rounded(df, *names, digits=6):
    return df.withColumns({n: r(n, digits) for n in names})


def with_previous(t):
    return panels.states(t).withColumn("q", F.lag("p").over(by_date(KEY))).where(F.col("q").isNotNull())


PREV = PROBS + """, prev AS (SELECT * FROM (SELECT *, lag(p) OVER (PARTITION BY portfolio ORDER BY dt) AS q FROM probs) WHERE q IS NOT NULL)"""
IDX = "[1, 2, 3, 4]"


def jsd_sql(p: str, q: str) -> str:
    half = lambda a, b: (
        f"list_sum([CASE WHEN {a}[i] > 1e-12 THEN {a}[i] * ln({a}[i] / (({a}[i] + {b}[i]) * 0.5 + 1e-12)) ELSE 0 END FOR i IN {IDX}])"
    )
    return f"(({half(p, q)} + {half(q, p)}) * 0.5)"


@query("f11_max_prob_entropy", with_(PROBS) + f"""
SELECT portfolio, dt, round(list_max(p), 6) AS max_prob,
  round(-list_sum([greatest(1e-12, p[i]) * ln(greatest(1e-12, p[i])) FOR i IN {IDX}]), 6) + 0.0 AS entropy FROM probs""")
def f11(t):
    return panels.probabilities(t).select(
        "portfolio", "dt", r(PF.max_prob(F.col("p"))).alias("max_prob"), (r(PF.entropy(F.col("p"))) + 0.0).alias("entropy")
    )


def temper_sql(p: str, t: str) -> str:
    power = f"exp(ln(greatest(1e-12, {p}[{{i}}])/1.0) / {t})"
    total = " + ".join(power.format(i=i) for i in range(1, 5))
    return "[" + ", ".join(f"{power.format(i=i)} / ({total})" for i in range(1, 5)) + "]"


@query("f12_tempering", with_(PROBS) + f""", hot AS (SELECT portfolio, dt, {temper_sql('p', '1.25')} AS h FROM probs)
SELECT portfolio, dt, round(h[1], 6) AS p_0, round(h[2], 6) AS p_1, round(h[3], 6) AS p_2, round(h[4], 6) AS p_3 FROM hot""")
def f12(t):
    hot = panels.probabilities(t).withColumn("h", PF.temper(F.col("p"), 1.25))
    return hot.select("portfolio", "dt", *[r(F.col("h")[k]).alias(f"p_{k}") for k in range(4)])


@query("f13_f14_f15_distances", with_(PREV) + f"""
SELECT portfolio, dt, round(list_sum([abs(p[i] - q[i]) FOR i IN {IDX}]), 6) AS l1, round({jsd_sql('p', 'q')}, 6) + 0.0 AS jsd FROM prev""")
def f13(t):
    p, q = F.col("p"), F.col("q")
    return with_previous(t).select(
        "portfolio", "dt", r(PF.distance(p, q, "l1")).alias("l1"), (r(PF.distance(p, q, "jsd")) + 0.0).alias("jsd")
    )


def values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(repr(x) for x in row) + ")" for row in rows)


WEIGHTS = "weights(k, regime, i, asset, w) AS (" + values(
    (k, name, i, A.ASSETS[i], w) for k, name in enumerate(REGIMES) for i, w in enumerate(A.REGIME_WEIGHTS[name])
) + "), baseline(i, asset, w) AS (" + values((i, A.ASSETS[i], w) for i, w in enumerate(A.BASELINE_WEIGHTS)) + ")"
SOFT = """soft AS (SELECT portfolio, dt, i, asset, sum(p[k + 1] * w) AS w FROM probs, weights GROUP BY ALL)"""


@query("p1_p2_soft_weights", with_(PROBS, WEIGHTS, SOFT) + " SELECT portfolio, dt, asset, round(w, 9) + 0.0 AS w FROM soft")
def p2(t):
    soft = panels.probabilities(t).withColumn("w", A.soft_weights(F.col("p"), REGIMES))
    return A.explode_weights(soft, KEY).withColumn("w", r("w", 9) + 0.0)


@query("p3_hard_weights", with_(STATES, WEIGHTS) + """
SELECT portfolio, dt, w.asset, w.w::DOUBLE + 0.0 AS w FROM states JOIN weights w ON w.k = state WHERE list_max(p) >= 0.5
UNION ALL SELECT portfolio, dt, b.asset, b.w::DOUBLE + 0.0 FROM states, baseline b WHERE list_max(p) < 0.5""")
def p3(t):
    hard = panels.probabilities(t).withColumn("w", A.hard_weights(F.col("p"), REGIMES, 0.5))
    return A.explode_weights(hard, KEY).withColumn("w", F.col("w") + 0.0)


TRIPLED = SOFT + """, capped AS (SELECT portfolio, dt, i, asset, greatest(-0.4, least(0.4, w * 3)) AS w FROM soft),
capg AS (SELECT portfolio, dt, i, asset, w, sum(abs(w)) OVER (PARTITION BY portfolio, dt) AS g FROM capped),
cons AS (SELECT portfolio, dt, i, asset, CASE WHEN g > 1.5 THEN w * 1.5 / g ELSE w END AS w FROM capg)"""


def tripled(t):
    soft = A.soft_weights(F.col("p"), REGIMES)
    return panels.probabilities(t).withColumn("w", A.constrain(A.scale(soft, F.lit(3.0)), 0.4, 1.5))


@query("p4_weight_and_gross_caps", with_(PROBS, WEIGHTS, TRIPLED) + " SELECT portfolio, dt, asset, round(w, 11) + 0.0 AS w FROM cons")
def p4(t):
    return A.explode_weights(tripled(t), KEY).withColumn("w", r("w", 11) + 0.0)


TURNOVER = """, steps AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY portfolio, asset ORDER BY dt), 0) AS before FROM cons),
moved AS (SELECT *, sum(abs(w - before)) OVER (PARTITION BY portfolio, dt) AS m FROM steps)"""


@query("p5_j11_turnover_cap", with_(PROBS, WEIGHTS, TRIPLED) + TURNOVER + """
SELECT portfolio, dt, asset, round(CASE WHEN m > 0.3 THEN before + 0.3 / m * (w - before) ELSE w END, 11) + 0.0 AS w FROM moved""")
def p5(t):
    none = PF.vector([0.0] * 8)
    before = tripled(t).withColumn("before", F.coalesce(F.lag("w").over(by_date(KEY)), none))
    out = before.withColumn("w", A.cap_turnover(F.col("w"), F.col("before"), 0.30))
    return A.explode_weights(out, KEY).withColumn("w", r("w", 11) + 0.0)


@query("p6_volatility_target", with_(PROBS, WEIGHTS, SOFT, STRATEGY) + """,
vol AS (SELECT portfolio, dt, CASE WHEN count(ret) OVER w >= 20 THEN stddev_samp(ret) OVER w END * sqrt(252) AS v FROM strategy
  WINDOW w AS (PARTITION BY portfolio ORDER BY dt ROWS BETWEEN 62 PRECEDING AND CURRENT ROW))
SELECT s.portfolio, s.dt, asset, round(CASE WHEN v > 0 THEN w * least(0.08 / v, 3) ELSE w END, 9) + 0.0 AS w
FROM soft s JOIN vol v ON v.portfolio = s.portfolio AND v.dt = s.dt""")
def p6(t):
    from panelloom.operators.returns import rolling_risk

    vol = rolling_risk(panels.strategy(t), KEY).select("portfolio", "dt", "vol")
    soft = panels.probabilities(t).withColumn("w", A.soft_weights(F.col("p"), REGIMES)).join(vol, ["portfolio", "dt"])
    out = soft.withColumn("w", A.volatility_target(F.col("w"), F.col("vol")))
    return A.explode_weights(out, KEY).withColumn("w", r("w", 9) + 0.0)


@query("p7_exposure_policy", with_(PROBS, WEIGHTS, SOFT) + """,
longs AS (SELECT *, greatest(w, 0) AS x, sum(greatest(w, 0)) OVER (PARTITION BY portfolio, dt) AS net FROM soft),
lev AS (SELECT *, greatest(0, least(0.4, CASE WHEN abs(net) > 1e-9 THEN x * 1.2 / net ELSE x END)) AS y FROM longs),
g AS (SELECT *, sum(y) OVER (PARTITION BY portfolio, dt) AS gross FROM lev)
SELECT portfolio, dt, asset, round(CASE WHEN gross > 1.0 THEN y / gross ELSE y END, 9) + 0.0 AS w FROM g""")
def p7(t):
    soft = panels.probabilities(t).withColumn("w", A.soft_weights(F.col("p"), REGIMES))
    out = soft.withColumn("w", A.exposure_policy(F.col("w"), True, 1.2, 0.4, 1.0))
    return A.explode_weights(out, KEY).withColumn("w", r("w", 9) + 0.0)


@query("p8_rebalance_decision", with_(PREV) + f""", d AS (
SELECT portfolio, dt, {jsd_sql('p', 'q')} AS distance, (p[1] - 0.25) * 6 AS s FROM prev)
SELECT portfolio, dt, round(distance, 6) + 0.0 AS distance, abs(s) >= 1.5 AS surprise_triggered, distance > 0.1 OR abs(s) >= 1.5 AS do_rebalance,
  CASE WHEN abs(s) >= 1.5 AND distance <= 0.1 THEN printf('""" + A.SURPRISED + """', s, distance)
    WHEN distance > 0.1 THEN printf('""" + A.SHIFTED.format(metric="jsd") + """', distance, 0.1) ELSE printf('""" + A.QUIET.format(metric="jsd") + """', distance, 0.1) END AS reason FROM d""")
def p8(t):
    out = A.decide(with_previous(t), "q", "p", 0.10, "jsd", (F.col("p")[0] - 0.25) * 6, 1.5)
    return out.select("portfolio", "dt", (r("distance") + 0.0).alias("distance"), "surprise_triggered", "do_rebalance", "reason")


# --- the path -------------------------------------------------------------------------

PLAN = folds.FoldPlan(train=756, step=63, refit_every=126)


def path_sql(settings) -> str:
    """Recursive form of the rebalance path for a list of settings."""
    grid = values((i, s.theta, s.turnover_cap, s.temperature) for i, s in enumerate(settings))
    weight_arrays = ", ".join(
        "greatest(-0.4, least(0.4, " + " + ".join(f"p[{k + 1}] * ({A.REGIME_WEIGHTS[n][i]!r})" for k, n in enumerate(REGIMES)) + "))"
        for i in range(8)
    )
    eight = "[1, 2, 3, 4, 5, 6, 7, 8]"
    return f"""days AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS i FROM (SELECT DISTINCT dt FROM probs)),
grid(setting, theta, cap, heat) AS ({grid}),
lagged AS (SELECT portfolio, dt, q, (q[1] - 0.25) * 6 AS score FROM (
  SELECT portfolio, dt, lag(p) OVER (PARTITION BY portfolio ORDER BY dt) AS q FROM probs) WHERE q IS NOT NULL),
tested AS (SELECT l.*, g.*, (d.i - 756) % 63 = 0 AS force,
    CASE WHEN heat > 1 THEN {temper_sql('q', 'heat')} ELSE q END AS p
  FROM lagged l JOIN days d ON d.dt = l.dt AND d.i >= 756, grid g),
seq AS MATERIALIZED (SELECT portfolio, setting, dt, theta, cap, force, score, p, [{weight_arrays}] AS target,
  row_number() OVER (PARTITION BY portfolio, setting ORDER BY dt) AS n FROM tested),
path AS (
  SELECT portfolio, setting, 0::BIGINT AS n, NULL::DATE AS dt, NULL::BOOLEAN AS trade, 0.0::DOUBLE AS distance, false AS surprised, NULL::BOOLEAN AS force, 0.0::DOUBLE AS score,
    NULL::DOUBLE[] AS p, p AS anchor, [{', '.join(repr(x) for x in A.BASELINE_WEIGHTS)}]::DOUBLE[] AS w, [{', '.join(repr(x) for x in A.BASELINE_WEIGHTS)}]::DOUBLE[] AS before
  FROM seq WHERE n = 1
  UNION ALL
  SELECT portfolio, setting, n, dt, trade, distance, surprised, force, score, p, CASE WHEN trade THEN p ELSE anchor END,
    CASE WHEN NOT trade THEN w WHEN m > cap THEN [w[i] + cap / m * (target[i] - w[i]) FOR i IN {eight}] ELSE target END, w
  FROM (SELECT *, force OR distance > theta OR surprised AS trade, list_sum([abs(target[i] - w[i]) FOR i IN {eight}]) AS m FROM (
    SELECT s.portfolio, s.setting, s.n, s.dt, s.theta, s.cap, s.force, s.score, s.p, s.target, x.anchor, x.w,
      CASE WHEN s.force THEN 0.0 ELSE {jsd_sql('x.anchor', 's.p')} END AS distance, NOT s.force AND abs(s.score) >= 1.5 AS surprised
    FROM path x JOIN seq s ON s.portfolio = x.portfolio AND s.setting = x.setting AND s.n = x.n + 1)))"""


ONE = [B.Setting(0.08, 0.30, 1.0)]


def surprise():
    return (F.col("trade_p")[0] - 0.25) * 6


def path(t, settings):
    rows = B.trade_rows(stored(panels.probabilities(t), "probabilities"), KEY, settings, PLAN, surprise=surprise())
    return B.run_path(rows, KEY)


@query("p9_p10_rebalance_path", with_recursive(PROBS, path_sql(ONE)) + """
SELECT portfolio, dt, trade AS do_rebalance, round(distance, 6) + 0.0 AS distance, surprised AS surprise_triggered,
  CASE WHEN force THEN '""" + A.FORCED + """' WHEN surprised AND distance <= 0.08 THEN printf('""" + A.SURPRISED + """', score, distance)
    WHEN distance > 0.08 THEN printf('""" + A.SHIFTED.format(metric="jsd") + """', distance, 0.08) ELSE printf('""" + A.QUIET.format(metric="jsd") + """', distance, 0.08) END AS reason,
  round(list_max(p), 4) AS max_prob, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS dominant_state, """ + ", ".join(
    f'round(w[{i + 1}], 12) AS "w_{a}"' for i, a in enumerate(A.ASSETS)) + """ FROM path WHERE n > 0""")
def p9(t):
    weights = {f"w_{a}": r(F.col("w")[i], 12) for i, a in enumerate(A.ASSETS)}
    log = A.decision_log(path(t, ONE).withColumns(weights), ["portfolio", *weights])
    return log.withColumn("distance", F.col("distance") + 0.0)


PNL = """, packed AS (SELECT dt, [""" + ", ".join(f"max(ret) FILTER (asset = '{a}')" for a in A.ASSETS) + """] AS r FROM asset_returns GROUP BY dt),
base AS (SELECT p.*, r, list_sum([abs(x) FOR x IN w]) AS gross,
    lag(w, 1, [""" + ", ".join(repr(x) for x in A.BASELINE_WEIGHTS) + """]::DOUBLE[]) OVER (PARTITION BY portfolio, setting ORDER BY p.dt) AS held_before
  FROM path p LEFT JOIN packed k ON k.dt = p.dt WHERE n > 0),
pnl AS (SELECT portfolio, setting, dt,
  coalesce(list_sum([w[i] * coalesce(r[i], 0) FOR i IN [1, 2, 3, 4, 5, 6, 7, 8]]), 0) AS asset_ret,
  greatest(gross - 1, 0) * (0.04 / 252) AS financing,
  CASE WHEN trade THEN list_sum([CASE WHEN abs(w[i] - held_before[i]) >= 0.001 THEN
     abs(w[i] - held_before[i]) * 5 / 1e4 + sqrt(abs(w[i] - held_before[i])) * 2 / 1e4 + 1 / 1e4 ELSE 0 END FOR i IN [1, 2, 3, 4, 5, 6, 7, 8]]) ELSE 0 END AS cost
  FROM base)"""


@query("p11_p12_p13_p14_p16_net_returns", with_recursive(PROBS, ASSET_RETURNS, path_sql(ONE)) + PNL + """
SELECT portfolio, dt, round(asset_ret, 6) + 0.0 AS asset_ret, round(financing, 9) AS financing, round(cost, 6) AS cost,
  round(asset_ret - financing - cost, 6) + 0.0 AS ret FROM pnl""")
def p12(t):
    out = B.net_returns(path(t, ONE), panels.asset_returns(t), KEY)
    out = rounded(out, "asset_ret", "cost", "ret").withColumn("financing", r("financing", 9))
    return out.select("portfolio", "dt", (F.col("asset_ret") + 0.0).alias("asset_ret"), "financing", "cost", (F.col("ret") + 0.0).alias("ret"))


@query("j12_weighted_asset_returns", with_(PROBS, WEIGHTS, SOFT, ASSET_RETURNS) + """
SELECT s.portfolio, s.dt, round(sum(s.w * a.ret), 6) + 0.0 AS ret FROM soft s JOIN asset_returns a ON a.dt = s.dt AND a.asset = s.asset
WHERE a.px_prev > 0 GROUP BY 1, 2""")
def j12(t):
    soft = panels.probabilities(t).withColumn("w", A.soft_weights(F.col("p"), REGIMES))
    packed = pnl.pack_returns(panels.asset_returns(t).where(F.col("px_t_1") > 0))
    return soft.join(packed, "dt").select("portfolio", "dt", (r(pnl.dot(F.col("w"), F.col("r"))) + 0.0).alias("ret"))


@query("p15_annual_drag", with_(PROBS, WEIGHTS, TRIPLED) + TURNOVER + """,
days AS (SELECT DISTINCT portfolio, dt, m FROM moved),
agg AS (SELECT portfolio, avg(m) AS m, count(*) * 1.0 / count(DISTINCT year(dt)) AS f FROM days GROUP BY 1)
SELECT portfolio, round((m * 5 / 1e4 + sqrt(m) * 2 / 1e4 + 1 / 1e4) * f, 6) AS drag FROM agg""")
def p15(t):
    none = PF.vector([0.0] * 8)
    before = tripled(t).withColumn("before", F.coalesce(F.lag("w").over(by_date(KEY)), none))
    daily = before.select("portfolio", "dt", PF.l1_distance(F.col("w"), F.col("before")).alias("m"))
    per = daily.groupBy("portfolio").agg(
        F.avg("m").alias("m"), (F.count(F.lit(1)) / F.count_distinct(F.year("dt"))).alias("f")
    )
    return per.select("portfolio", r(pnl.annual_drag(F.col("m"), F.col("f"))).alias("drag"))


@query("p17_t5_parameter_sweep", with_recursive(PROBS, ASSET_RETURNS, path_sql(B.SWEEP)) + PNL + """,
net AS (SELECT portfolio, setting, asset_ret - financing - cost AS ret FROM pnl),
m AS (SELECT portfolio, setting, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe, pow(product(1 + ret), 252 / count(*)) - 1 AS cagr FROM net GROUP BY 1, 2)
SELECT portfolio, theta::DOUBLE AS theta, cap::DOUBLE AS turnover_cap, heat::DOUBLE AS temperature, round(sharpe, 5) AS sharpe, round(cagr, 5) AS cagr FROM m JOIN grid USING (setting)""")
def p17(t):
    net = stored(B.net_returns(path(t, B.SWEEP), panels.asset_returns(t), KEY), "net")
    metrics = P.return_metrics(net, ["portfolio", "setting"])
    ranked = B.rank_settings(metrics, B.SWEEP)
    return ranked.select("portfolio", "theta", "turnover_cap", "temperature", r("sharpe", 5).alias("sharpe"), r("cagr", 5).alias("cagr"))


# --- folds, scaling, scenarios --------------------------------------------------------

FOLD_DAYS = STRATEGY + """, days AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS i, count(*) OVER () AS nd FROM (SELECT DISTINCT dt FROM strategy)),
folds AS (SELECT f, {start} AS a, 756 + f * 63 AS b, least(756 + (f + 1) * 63, nd) AS c
  FROM (SELECT max(nd) AS nd FROM days), range(0, 1000) x(f) WHERE 756 + f * 63 < nd)"""


def fold_sql(start: str) -> str:
    return with_(FOLD_DAYS.format(start=start)) + """
SELECT CAST(f AS INTEGER) AS fold, min(dt) FILTER (i >= a AND i < b) AS train_start, max(dt) FILTER (i >= a AND i < b) AS train_end,
  min(dt) FILTER (i >= b AND i < c) AS test_start, max(dt) FILTER (i >= b AND i < c) AS test_end, f % 2 = 0 AS refit
FROM folds, days GROUP BY f"""


@query("w14_folds_expanding", fold_sql("0"))
def w14(t):
    return folds.fold_table(folds.positions(panels.strategy(t)), PLAN)


@query("w14_folds_rolling", fold_sql("f * 63"))
def w14_rolling(t):
    plan = folds.FoldPlan(756, 63, 126, expanding=False)
    return folds.fold_table(folds.positions(panels.strategy(t)), plan)


@query("w15_lagged_signal", with_(PROBS) + """,
days AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS i FROM (SELECT DISTINCT dt FROM probs)),
lagged AS (SELECT portfolio, dt, lag(p) OVER (PARTITION BY portfolio ORDER BY dt) AS q FROM probs)
SELECT portfolio, l.dt, CAST(floor((i - 756) / 63) AS INTEGER) AS fold, (i - 756) % 63 = 0 AS opens, round(q[1], 6) AS p_0, round(q[2], 6) AS p_1,
  round(q[3], 6) AS p_2, round(q[4], 6) AS p_3
FROM lagged l JOIN days d ON d.dt = l.dt WHERE i >= 756 AND q IS NOT NULL""")
def w15(t):
    probs = stored(panels.probabilities(t), "probabilities")
    days = folds.test_days(folds.positions(probs), PLAN)
    out = A.lag_signal(probs, KEY).join(days, "dt")
    return out.select("portfolio", "dt", "fold", "opens", *[r(F.col("trade_p")[i]).alias(f"p_{i}") for i in range(4)])


@query("a5_fold_scaler_statistics", with_(FOLD_DAYS.format(start="0")) + """
SELECT portfolio, CAST(f AS INTEGER) AS fold, round(avg(ret), 8) AS mean, round(stddev_samp(ret), 8) AS sd
FROM folds JOIN days ON i >= a AND i < b JOIN strategy USING (dt) GROUP BY 1, 2""")
def a5(t):
    base = stored(panels.strategy(t), "strategy")
    out = scaling.expanding_fit(base, folds.positions(base), PLAN, KEY, "ret")
    return out.select("portfolio", "fold", r("mean", 8).alias("mean"), r("sd", 8).alias("sd"))


@query("m1_scaled_test_rows", with_(FOLD_DAYS.format(start="0")) + """,
st AS (SELECT portfolio, f, avg(ret) AS m, stddev_samp(ret) AS sd FROM folds JOIN days ON i >= a AND i < b JOIN strategy USING (dt) GROUP BY 1, 2)
SELECT s.portfolio, s.dt, CAST(fo.f AS INTEGER) AS fold, round((ret - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) + 0.0 AS z
FROM folds fo JOIN days d ON i >= b AND i < c JOIN strategy s ON s.dt = d.dt JOIN st ON st.f = fo.f AND st.portfolio = s.portfolio""")
def m1(t):
    base = stored(panels.strategy(t), "strategy")
    days = folds.positions(base)
    stats = scaling.expanding_fit(base, days, PLAN, KEY, "ret")
    tested = base.join(folds.test_days(days, PLAN).select("dt", "fold"), "dt")
    out = scaling.transform(tested, stats, ["portfolio", "fold"], "ret")
    return out.select("portfolio", "dt", "fold", (r("ret") + 0.0).alias("z"))


Z_ASSETS = ASSET_RETURNS + """, z AS (SELECT 'ret_' || asset AS feature, dt,
  (ret - avg(ret) OVER (PARTITION BY asset)) / stddev_samp(ret) OVER (PARTITION BY asset) AS value FROM asset_returns)"""
SHOCKS = "shocks(scenario, feature, shock) AS (" + values(
    (s.name, f, v) for s in scenarios.SCENARIOS.values() for f, v in s.shocks.items()
) + ")"


def scaled_assets(t):
    long = stored(panels.asset_returns(t), "returns").select(F.concat(F.lit("ret_"), "asset").alias("feature"), "dt", F.col("ret").alias("value"))
    return scaling.transform(long, scaling.fit(long, ["feature"]), ["feature"])


@query("n23_n24_scenario_shocks", with_(Z_ASSETS, SHOCKS) + """
SELECT s.scenario, z.feature, z.dt, round(value + CASE WHEN dt BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' THEN coalesce(k.shock, 0) ELSE 0 END, 6) + 0.0 AS value
FROM z CROSS JOIN (SELECT DISTINCT scenario FROM shocks) s LEFT JOIN shocks k ON k.scenario = s.scenario AND k.feature = z.feature""")
def n23(t):
    windowed = [
        scenarios.Scenario(s.name, s.description, s.shocks, "1996-01-01", "1999-12-31") for s in scenarios.SCENARIOS.values()
    ]
    return scenarios.apply_shocks(scaled_assets(t), windowed).withColumn("value", r("value") + 0.0)


def scenario_states(t):
    """Score shocked features against the four regime profiles and follow the weights."""
    shocked = scenarios.apply_shocks(scaled_assets(t), list(scenarios.SCENARIOS.values()))
    named = {f"ret_{a}": i for i, a in enumerate(A.ASSETS)}
    vectors = shocked.groupBy("scenario", "dt").agg(
        F.array(*[F.coalesce(F.max(F.when(F.col("feature") == f, F.col("value"))), F.lit(0.0)) for f in named]).alias("x")
    )
    means = [[3.0 * w for w in A.REGIME_WEIGHTS[name]] for name in REGIMES]
    ones = [[1.0] * 8 for _ in REGIMES]
    return vectors.withColumn("p", PF.softmax(PF.log_densities(F.col("x"), means, ones)))


@query("p18_scenario_run", with_(Z_ASSETS, SHOCKS, WEIGHTS) + """,
sh AS (SELECT s.scenario, z.feature, z.dt, value + coalesce(k.shock, 0) AS value
  FROM z CROSS JOIN (SELECT DISTINCT scenario FROM shocks) s LEFT JOIN shocks k ON k.scenario = s.scenario AND k.feature = z.feature),
cells AS (SELECT d.scenario, d.dt, w.k, w.asset, coalesce(sh.value, 0) AS x, 3 * w.w AS mu
  FROM (SELECT DISTINCT scenario, dt FROM sh) d CROSS JOIN weights w
  LEFT JOIN sh ON sh.scenario = d.scenario AND sh.dt = d.dt AND sh.feature = 'ret_' || w.asset),
lp AS (SELECT scenario, dt, k, sum(-0.5 * (x - mu) * (x - mu)) AS l FROM cells GROUP BY 1, 2, 3),
sm AS (SELECT *, exp(l - max(l) OVER q) / sum(exp(l - m)) OVER q AS p FROM (SELECT *, max(l) OVER (PARTITION BY scenario, dt) AS m FROM lp)
  WINDOW q AS (PARTITION BY scenario, dt)),
wt AS (SELECT s.scenario, s.dt, w.asset, sum(p * w.w) AS w FROM sm s JOIN weights w ON w.k = s.k GROUP BY 1, 2, 3),
ret AS (SELECT wt.scenario, wt.dt, sum(wt.w * a.ret) AS ret FROM wt JOIN asset_returns a ON a.dt = wt.dt AND a.asset = wt.asset GROUP BY 1, 2)
SELECT scenario, count(*) AS n_trading_days, round(avg(ret) / stddev_samp(ret) * sqrt(252), 5) AS sharpe, round(stddev_samp(ret) * sqrt(252), 5) AS ann_vol
FROM ret GROUP BY 1""")
def p18(t):
    scored = scenario_states(t).withColumn("w", A.soft_weights(F.col("p"), REGIMES))
    packed = pnl.pack_returns(panels.asset_returns(t))
    returns = scored.join(packed, "dt").select("scenario", "dt", pnl.dot(F.col("w"), F.col("r")).alias("ret"))
    returns = stored(returns, "scenario_returns")
    out = P.return_metrics(returns, ["scenario"])
    return out.select("scenario", "n_trading_days", r("sharpe", 5).alias("sharpe"), r("ann_vol", 5).alias("ann_vol"))
