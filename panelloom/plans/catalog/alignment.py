"""As-of joins, calendars and the feature panel."""

from pyspark.sql import functions as F

from panelloom.functions import scalars as S
from panelloom.operators import asof, curve, features, positioning
from panelloom.operators.returns import simple_returns
from panelloom.plans.registry import query
from panelloom.session import stored
from panelloom.plans.sql import ASSET_RETURNS, CURVE, POSITIONS, PRICES, RELEASES, RETURNS, with_
from panelloom.sources import panels


def r(value, digits=6):
    return F.round(F.col(value) if isinstance(value, str) else value, digits)


def fill_sql(source: str, target: str, key: str, value: str, limit: int | None, digits: int = 6) -> str:
    """Dense-grid statement of the row-limited as-of fill (the brute-force form)."""
    reach = "UNBOUNDED" if limit is None else str(limit)
    return f""",
spine AS (SELECT DISTINCT dt FROM {source} UNION SELECT DISTINCT dt FROM {target}),
grid AS (SELECT k.{key}, s.dt FROM (SELECT DISTINCT {key} FROM {source}) k, spine s),
filled AS (
  SELECT g.{key}, g.dt, last_value(v.{value} IGNORE NULLS) OVER (
    PARTITION BY g.{key} ORDER BY g.dt ROWS BETWEEN {reach} PRECEDING AND CURRENT ROW) AS {value}
  FROM grid g LEFT JOIN {source} v ON v.{key} = g.{key} AND v.dt = g.dt)
SELECT {key}, dt, round({value}, {digits}) AS {value} FROM filled
WHERE {value} IS NOT NULL AND dt IN (SELECT dt FROM {target})"""


SHIP_DAYS = "target AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS dt FROM lineitem)"


@query("j3_asof_limited_fill", with_(PRICES, SHIP_DAYS) + fill_sql("prices", "target", "instrument", "px", 3, 4))
def j3(t):
    target = t.lineitem.select(F.col("l_shipdate").cast("date").alias("dt"))
    out = asof.align(stored(panels.prices(t), "prices"), target, ["instrument"], "px", 3)
    return out.select("instrument", "dt", r("px", 4).alias("px"))


@query("w4_unlimited_fill", with_(CURVE, SHIP_DAYS) + """,
fed AS (SELECT CAST(tenor_days AS BIGINT) AS tenor_days, dt, implied_rate FROM curve)"""
       + fill_sql("fed", "target", "tenor_days", "implied_rate", None))
def w4(t):
    target = t.lineitem.select(F.col("l_shipdate").cast("date").alias("dt"))
    out = asof.align(stored(panels.daily_curve(t), "curve"), target, ["tenor_days"], "implied_rate", None)
    return out.select("tenor_days", "dt", r("implied_rate").alias("implied_rate"))


@query("j8_price_matrix_fill", with_(PRICES, """target AS (
  SELECT DISTINCT CAST(l_shipdate AS DATE) AS dt FROM lineitem WHERE dayofweek(l_shipdate) BETWEEN 1 AND 5)""",
  "kept AS (SELECT * FROM prices WHERE dt IN (SELECT dt FROM target))") + fill_sql("kept", "target", "instrument", "px", 3, 4))
def j8(t):
    ship = F.col("l_shipdate").cast("date").alias("dt")
    target = t.lineitem.select(ship).where(F.weekday("dt") < 5)
    out = asof.reindex_fill(panels.prices(t), target, ["instrument"], "px", 3)
    return out.select("instrument", "dt", r("px", 4).alias("px"))


KNOWN = """,
eff AS (SELECT *, {eff} AS effective FROM releases),
months AS (SELECT DISTINCT last_day(o_orderdate) AS month_end FROM orders),
ranked AS (SELECT m.month_end, e.*, row_number() OVER (PARTITION BY m.month_end, series_id
           ORDER BY period DESC, dt_ingest DESC, vintage_id DESC) AS rn
  FROM months m JOIN eff e ON e.effective <= m.month_end),
known AS (SELECT month_end, series_id, value, vintage_id, period FROM ranked WHERE rn = 1)"""
AS_REPORTED = "coalesce(release_date, last_day(date_trunc('month', period) + to_months({lag})))"
LAG = "CASE series_id WHEN 'A' THEN 2 WHEN 'N' THEN 1 ELSE 1 END"
KNOWN_SQL = RELEASES + KNOWN.format(eff=AS_REPORTED.format(lag=LAG))


def known(t, cutoff=False):
    months = t.orders.select(F.last_day("o_orderdate").alias("month_end"))
    lags = {"A": "P2M", "N": "P1M"}
    return asof.known_at_month_end(stored(panels.releases(t), "releases"), months, lags, vintage_cutoff=cutoff)


@query("j4_bitemporal_asof", with_(KNOWN_SQL) + " SELECT * FROM known")
def j4(t):
    return known(t)


CUTOFF = "greatest(" + AS_REPORTED.format(lag=LAG) + ", dt_ingest)"


@query("j4_bitemporal_asof_vintage_cutoff", with_(RELEASES + KNOWN.format(eff=CUTOFF)) + " SELECT * FROM known")
def j4_cutoff(t):
    return known(t, cutoff=True)


@query("a3_macro_wide", with_(KNOWN_SQL) + """
SELECT month_end, """ + ", ".join(
    f"max(value) FILTER (series_id = '{s}') AS \"{s}\", max(vintage_id) FILTER (series_id = '{s}') AS \"{s}__vintage_id\""
    for s in "ANR") + " FROM known GROUP BY month_end")
def a3(t):
    return features.widen_macro(known(t), ["A", "N", "R"])


PICKS = """, picks AS (SELECT dt, """ + ", ".join(
    f"first(implied_rate ORDER BY abs(tenor_days - {x}), tenor_days) AS r{x}" for x in (30, 90, 180, 365)
) + " FROM curve GROUP BY dt)"


@query("j5_nearest_tenor", with_(CURVE) + PICKS + "SELECT dt, r30 AS at_30, r90 AS at_90, r180 AS at_180, r365 AS at_365 FROM picks")
def j5(t):
    return asof.nearest(panels.daily_curve(t), ["dt"], "tenor_days", "implied_rate", curve.TENORS)


POLICY = CURVE + PICKS + """, policy AS (SELECT dt,
  1 / (1 + pow(2.71828, (r90 - r30) * 100)) AS implied_cut_prob_3m,
  1 / (1 + pow(2.71828, (r180 - r30) * 100)) AS implied_cut_prob_6m,
  r180 - r30 AS term_front_slope, r365 - r30 AS terminal_shift_30d, 'ois' AS source FROM picks)"""


@query("f1_f2_policy_features", with_(POLICY) + """
SELECT dt, round(implied_cut_prob_3m, 6) AS implied_cut_prob_3m, round(implied_cut_prob_6m, 6) AS implied_cut_prob_6m,
  round(term_front_slope, 6) AS term_front_slope, round(terminal_shift_30d, 6) AS terminal_shift_30d, source FROM policy""")
def f1_f2(t):
    out = curve.policy_features(panels.daily_curve(t))
    names = ["implied_cut_prob_3m", "implied_cut_prob_6m", "term_front_slope", "terminal_shift_30d"]
    return out.select("dt", *[r(n).alias(n) for n in names], "source")


FED = """, fed AS (SELECT portfolio, dt, p[1] AS prob_cut_1m, p[2] AS prob_cut_3m, p[3] AS prob_hike_1m,
  p[4] - 0.25 AS implied_rate_chg_3m FROM probs)"""


def probability_rows(t):
    p = F.col("p")
    return panels.probabilities(t).select(
        "portfolio", "dt", p[0].alias("prob_cut_1m"), p[1].alias("prob_cut_3m"),
        p[2].alias("prob_hike_1m"), (p[3] - 0.25).alias("implied_rate_chg_3m"),
    )


from panelloom.plans.sql import PROBS  # noqa: E402


@query("n8_probability_curve", with_(PROBS + FED) + """
SELECT portfolio, dt, CAST(tenor AS BIGINT) AS tenor_days, round(rate, 6) AS implied_rate, 'fedwatch' AS source FROM (
  SELECT portfolio, dt, 30 AS tenor, prob_hike_1m - prob_cut_1m AS rate FROM fed
  UNION ALL SELECT portfolio, dt, 90, implied_rate_chg_3m FROM fed
  UNION ALL SELECT portfolio, dt, 180, implied_rate_chg_3m + 0.5 * (prob_cut_3m - (prob_hike_1m - prob_cut_1m)) FROM fed
  UNION ALL SELECT portfolio, dt, 365, implied_rate_chg_3m + (prob_cut_3m - (prob_hike_1m - prob_cut_1m)) FROM fed)""")
def n8(t):
    out = curve.curve_from_probabilities(probability_rows(t), ["portfolio", "dt"])
    return out.withColumn("implied_rate", r("implied_rate"))


@query("j6_last_row_with_fallback", with_(PROBS + FED) + """
SELECT portfolio, coalesce(max_by(dt, dt) FILTER (dt <= DATE '1998-06-30'), max(dt)) AS dt,
  round(coalesce(max_by(prob_cut_1m, dt) FILTER (dt <= DATE '1998-06-30'), max_by(prob_cut_1m, dt)), 6) AS prob_cut_1m,
  round(coalesce(max_by(prob_cut_3m, dt) FILTER (dt <= DATE '1998-06-30'), max_by(prob_cut_3m, dt)), 6) AS prob_cut_3m
FROM fed GROUP BY portfolio""")
def j6(t):
    out = asof.latest_on_or_before(
        probability_rows(t), ["portfolio"], "dt", ["prob_cut_1m", "prob_cut_3m"], "1998-06-30", fallback=True
    )
    return out.select("portfolio", "dt", r("prob_cut_1m").alias("prob_cut_1m"), r("prob_cut_3m").alias("prob_cut_3m"))


@query("a18_u3_union_calendar", """
SELECT dt FROM (SELECT CAST(o_orderdate AS DATE) AS dt FROM orders UNION SELECT CAST(l_shipdate AS DATE) FROM lineitem)""")
def a18(t):
    orders = asof.calendar(t.orders.select(F.col("o_orderdate").cast("date").alias("dt")))
    ships = asof.calendar(t.lineitem.select(F.col("l_shipdate").cast("date").alias("dt")))
    return orders.unionByName(ships).distinct()


ASSET_NAMES = ["US10Y", "US2Y", "GOLD", "USD_index", "SP500", "OIL", "CARRY_ETF", "TIPS"]
RETURN_BLOCK = ASSET_RETURNS + """,
rdays AS (SELECT DISTINCT dt FROM asset_returns),
rgrid AS (SELECT a.asset, d.dt FROM (SELECT DISTINCT asset FROM asset_returns) a, rdays d),
rfilled AS (SELECT g.asset, g.dt, last_value(v.ret IGNORE NULLS) OVER (PARTITION BY g.asset ORDER BY g.dt
    ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS ret
  FROM rgrid g LEFT JOIN asset_returns v ON v.asset = g.asset AND v.dt = g.dt),
rolled AS (SELECT *,
  CASE WHEN count(ret) OVER (PARTITION BY asset ORDER BY dt ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 3
    THEN avg(ret) OVER (PARTITION BY asset ORDER BY dt ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS ma5,
  CASE WHEN count(ret) OVER (PARTITION BY asset ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) >= 10
    THEN avg(ret) OVER (PARTITION BY asset ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS ma20
  FROM rfilled),
base AS (SELECT dt, 'ret_' || asset AS feature, ret AS value FROM rolled
  UNION ALL SELECT dt, 'ma5_' || asset, ma5 FROM rolled UNION ALL SELECT dt, 'ma20_' || asset, ma20 FROM rolled),
legs AS (SELECT dt, max(value) FILTER (feature = 'ret_SP500') AS s, max(value) FILTER (feature = 'ret_US10Y') AS b,
  max(value) FILTER (feature = 'ret_OIL') AS o, max(value) FILTER (feature = 'ret_GOLD') AS g,
  max(value) FILTER (feature = 'ret_USD_index') AS u, max(value) FILTER (feature = 'ret_US2Y') AS t FROM base GROUP BY dt),
spreads AS (SELECT dt, 'stocks_vs_bonds' AS feature, s - b AS value FROM legs
  UNION ALL SELECT dt, 'oil_vs_stocks', o - s FROM legs UNION ALL SELECT dt, 'gold_vs_usd', g - u FROM legs
  UNION ALL SELECT dt, 'curve_slope', b - t FROM legs)"""


def returns_panel(t):
    return panels.asset_returns(t).withColumnRenamed("asset", "instrument")


@query("n18_w3_return_features", with_(RETURN_BLOCK) + """
SELECT dt, feature, round(value, 6) AS value FROM base WHERE value IS NOT NULL
UNION ALL SELECT dt, feature, round(value, 6) FROM spreads WHERE value IS NOT NULL""")
def return_block(t):
    return features.return_features(stored(returns_panel(t), "returns")).withColumn("value", r("value"))


@query("n21_spread_features", with_(RETURN_BLOCK) + " SELECT dt, feature, round(value, 6) AS value FROM spreads WHERE value IS NOT NULL")
def n21(t):
    names = stored(returns_panel(t), "returns").select("dt", S.prefixed("ret_", F.col("instrument")).alias("feature"), F.col("ret").alias("value"))
    days = asof.target_calendar(names)
    filled = asof.fill_on(names, days, ["feature"], "value", features.RETURN_FILL)
    return features.spread_features(filled).withColumn("value", r("value"))


COT_BLOCK = POSITIONS + """,
zed AS (SELECT contract, report_date, CASE WHEN count(*) OVER w >= 4 THEN
    ((long - short) - avg(long - short) OVER w) / nullif(stddev_samp(long - short) OVER w, 0) END AS zscore
  FROM positions WINDOW w AS (PARTITION BY contract, grp ORDER BY report_date ROWS BETWEEN 259 PRECEDING AND CURRENT ROW)),
cot AS (SELECT 'cot_z_' || replace(replace(contract, '_net', ''), ' ', '_') AS feature,
  CAST(date_trunc('week', report_date) AS DATE) + 3 AS dt, avg(zscore) AS value FROM zed GROUP BY 1, 2)"""


def cot_zscores(t):
    net = panels.weekly_positions(t).select(
        "contract", F.col("grp").alias("group"), "report_date", (F.col("long") - F.col("short")).alias("net_pos")
    )
    return positioning.zscores(net)


def ship_days(t):
    return t.lineitem.select(F.col("l_shipdate").cast("date").alias("dt"))


@query("a2_n15_positioning_features", with_(COT_BLOCK, SHIP_DAYS, "cotv AS (SELECT * FROM cot WHERE value IS NOT NULL)")
       + fill_sql("cotv", "target", "feature", "value", 7))
def a2(t):
    out = features.positioning_features(stored(cot_zscores(t), "positioning"), ship_days(t))
    return out.withColumn("value", r("value"))


POLICY_ROWS = """named AS (
  SELECT dt, 'fw_prob_cut_3m' AS feature, implied_cut_prob_3m AS value FROM policy
  UNION ALL SELECT dt, 'fw_prob_cut_6m', implied_cut_prob_6m FROM policy
  UNION ALL SELECT dt, 'fw_term_slope', term_front_slope FROM policy
  UNION ALL SELECT dt, 'fw_terminal_shift', terminal_shift_30d FROM policy
  UNION ALL SELECT dt, 'fw_net_cut_bias', implied_cut_prob_3m - (1 - implied_cut_prob_3m) FROM policy
  UNION ALL SELECT dt, 'fw_policy_uncertainty', 1 - abs(implied_cut_prob_3m) FROM policy)"""


@query("n19_n20_policy_feature_rows", with_(POLICY, POLICY_ROWS,
  "target AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS dt FROM orders)")
       + fill_sql("named", "target", "feature", "value", None))
def n19(t):
    target = t.orders.select(F.col("o_orderdate").cast("date").alias("dt"))
    out = features.policy_feature_rows(stored(curve.policy_features(panels.daily_curve(t)), "policy"), target)
    return out.withColumn("value", r("value"))


SURPRISE = KNOWN_SQL + """,
mgrid AS (SELECT s.series_id, m.month_end, k.value FROM (SELECT DISTINCT series_id FROM known) s
  CROSS JOIN (SELECT DISTINCT month_end FROM known) m LEFT JOIN known k ON k.series_id = s.series_id AND k.month_end = m.month_end),
mdiff AS (SELECT series_id, month_end, value - lag(value) OVER (PARTITION BY series_id ORDER BY month_end) AS change FROM mgrid),
mstd AS (SELECT *, CASE WHEN count(change) OVER w >= 3 THEN nullif(stddev_samp(change) OVER w, 0) END AS sd FROM mdiff
  WINDOW w AS (PARTITION BY series_id ORDER BY month_end ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
surprise AS (SELECT month_end AS dt, 'surprise_score' AS feature,
  greatest(-3, least(3, coalesce(avg(change / sd), 0))) AS value FROM mstd GROUP BY month_end)"""


@query("w6_macro_surprise", with_(SURPRISE, SHIP_DAYS) + """,
spine AS (SELECT dt FROM surprise UNION SELECT dt FROM target),
filled AS (SELECT s.dt, last_value(v.value IGNORE NULLS) OVER (ORDER BY s.dt ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS value
  FROM spine s LEFT JOIN surprise v ON v.dt = s.dt)
SELECT dt, 'surprise_score' AS feature, round(coalesce(value, 0), 6) AS value FROM filled
WHERE dt IN (SELECT dt FROM target)""")
def w6(t):
    return features.surprise_score(stored(known(t), "macro"), ship_days(t)).withColumn("value", r("value"))


COT_FEATURES = [f"cot_z_{c}" for c in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT_SPECIFIED", "5-LOW")]
POLICY_FEATURES = ["fw_prob_cut_3m", "fw_prob_cut_6m", "fw_term_slope", "fw_terminal_shift", "fw_net_cut_bias", "fw_policy_uncertainty"]
WIDE = [f"{kind}_{a}" for kind in ("ret", "ma5", "ma20") for a in ASSET_NAMES] + list(features.SPREADS) + COT_FEATURES + POLICY_FEATURES + ["surprise_score"]


def full_panel(t):
    return features.feature_panel(
        stored(returns_panel(t), "returns"), stored(cot_zscores(t), "positioning"),
        stored(curve.policy_features(panels.daily_curve(t)), "policy"), stored(known(t), "macro"),
    )


def outer_block(name: str, source: str, limit: int | None) -> str:
    """Every feature of `source` carried over its own days and the return days, by at most `limit` rows."""
    reach = "UNBOUNDED" if limit is None else str(limit)
    return f""", {name} AS (SELECT g.feature, g.dt, last_value(v.value IGNORE NULLS) OVER (PARTITION BY g.feature ORDER BY g.dt
  ROWS BETWEEN {reach} PRECEDING AND CURRENT ROW) AS value
  FROM (SELECT k.feature, s.dt FROM (SELECT DISTINCT feature FROM {source}) k, (SELECT dt FROM {source} UNION SELECT dt FROM rdays) s) g
  LEFT JOIN {source} v ON v.feature = g.feature AND v.dt = g.dt)"""


@query("j7_feature_matrix", with_(RETURN_BLOCK, COT_BLOCK, POLICY, POLICY_ROWS, SURPRISE)
       + outer_block("cot_days", "cot", 7) + outer_block("policy_days", "named", None) + outer_block("surprise_days", "surprise", 5) + """,
cells AS (SELECT dt, feature, value FROM base UNION ALL SELECT dt, feature, value FROM spreads UNION ALL SELECT dt, feature, value FROM cot_days
  UNION ALL SELECT dt, feature, value FROM policy_days UNION ALL SELECT dt, 'surprise_score', coalesce(value, 0) FROM surprise_days
  UNION ALL SELECT dt, 'surprise_score', 0 FROM rdays WHERE NOT EXISTS (FROM surprise))
SELECT dt, """ + ", ".join(f"""round(max(value) FILTER (feature = '{n}'), 6) AS "{n}\"""" for n in WIDE) + """
FROM cells WHERE dt IN (SELECT dt FROM rdays) GROUP BY dt""")
def j7(t):
    wide = features.widen(full_panel(t), WIDE)
    return wide.select("dt", *[r(F.col(f"`{n}`")).alias(n) for n in WIDE])


INSTRUMENTS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("a1_pivot_last", with_("""cells AS (
  SELECT o_orderpriority AS instrument, last_day(o_orderdate) AS month_end,
    max_by(px, dt) AS px FROM (SELECT o_orderpriority, o_orderdate, CAST(o_orderdate AS DATE) AS dt,
      round(avg(o_totalprice), 4) AS px FROM orders GROUP BY 1, 2, 3) GROUP BY 1, 2)""") + """
SELECT month_end, """ + ", ".join(f"""max(px) FILTER (instrument = '{i}') AS "{i}\"""" for i in INSTRUMENTS) + """
FROM cells GROUP BY month_end""")
def a1(t):
    daily = panels.prices(t).withColumn("px", r("px", 4)).withColumn("month_end", F.last_day("dt"))
    return features.pivot_last(daily, "month_end", "instrument", "px", "dt", INSTRUMENTS)


@query("a4_row_mean", with_(RETURNS) + " SELECT dt, round(avg(ret), 6) AS mean_ret FROM returns GROUP BY dt")
def a4(t):
    ret = simple_returns(panels.prices(t), ["instrument"])
    return ret.groupBy("dt").agg(r(F.avg("ret")).alias("mean_ret"))
