"""Normalisation, coercion, key functions and data-quality queries."""

from pyspark.sql import functions as F

from panelloom.functions import scalars as S
from panelloom.operators import normalize as N
from panelloom.operators import positioning, quality
from panelloom.plans.registry import query
from panelloom.plans.sql import PROBS, RETURNS, SEQUENCES, STATES, VENDOR_PRICES, with_
from panelloom.schemas import dataset
from panelloom.sources import panels


def r(value, digits=6):
    return F.round(F.col(value) if isinstance(value, str) else value, digits)


VENDOR_CASE = "CASE o_orderstatus WHEN 'F' THEN 'fred' WHEN 'P' THEN 'polygon' ELSE 'ecb' END"
TICKER_CASE = ("CASE o_orderpriority WHEN '1-URGENT' THEN 'SP500' WHEN '2-HIGH' THEN 'I:SPX' "
               "WHEN '3-MEDIUM' THEN 'PAYEMS' WHEN '5-LOW' THEN 'DGS10' ELSE o_orderpriority END")
MAPPED = """CASE WHEN vendor = 'fred' AND ticker = 'SP500' THEN 'SPX_US' WHEN vendor = 'polygon' AND ticker = 'I:SPX' THEN 'SPX_US'
  WHEN vendor = 'fred' AND ticker = 'DGS10' THEN 'US10Y_US' WHEN ticker = 'PAYEMS' THEN 'PAYROLLS_US' ELSE ticker END"""
RAW_PRICES = f"""raw AS (SELECT {VENDOR_CASE} AS vendor, {TICKER_CASE} AS ticker, CAST(o_orderdate AS DATE) AS dt,
  CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_totalprice END AS px_last FROM orders)"""


def raw_orders(t):
    """Order rows as a vendor file would deliver them: text, with '.' for missing."""
    vendor, ticker = F.expr(VENDOR_CASE), F.expr(TICKER_CASE)
    text = F.when(F.col("o_custkey") % 7 == 0, F.lit(".")).otherwise(F.col("o_totalprice").cast("string"))
    return t.orders.select(
        vendor.alias("vendor"), ticker.alias("ticker"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("dt"), text.alias("px_last"),
    )


@query("n1_canonical_prices", with_(RAW_PRICES) + f"""
SELECT vendor, dt, {MAPPED} AS instrument, px_last, 'USD' AS currency, ticker AS source_id,
  TIMESTAMP '2026-01-31 00:00:00' AS fetch_ts FROM raw WHERE px_last IS NOT NULL""")
def n1(t):
    mapping = N.mapping_table(t.spark)
    fetched = F.lit("2026-01-31 00:00:00").cast("timestamp_ntz")
    return N.canonical_prices(raw_orders(t), F.col("vendor"), mapping, fetched)


@query("j1_ticker_mapping", with_(RAW_PRICES) + f"""
SELECT vendor, ticker, {MAPPED} AS internal_id, count(*) AS n FROM raw GROUP BY ALL""")
def j1(t):
    out = N.map_tickers(raw_orders(t), N.mapping_table(t.spark))
    return out.groupBy("vendor", "ticker", "internal_id").agg(F.count(F.lit(1)).alias("n"))


@query("j1_unmapped_tickers", with_(RAW_PRICES) + f"""
SELECT DISTINCT vendor, ticker FROM raw WHERE {MAPPED} = ticker""")
def j1_strict(t):
    return N.unmapped_tickers(raw_orders(t), N.mapping_table(t.spark))


@query("j2_contract_patterns", """
SELECT target AS contract, count(*) AS n, sum(p_size)::BIGINT AS size FROM (
  SELECT p_size, CASE WHEN contains(upper(p_name), 'WIDGET') THEN 'WIDGETS' WHEN contains(upper(p_name), 'RED') THEN 'REDS'
    WHEN contains(upper(p_name), 'BOLT') THEN 'BOLTS' END AS target FROM part)
WHERE target IS NOT NULL GROUP BY 1""")
def j2(t):
    rules = [("bolt", "BOLTS"), ("red", "REDS"), ("widget", "WIDGETS")]
    out = positioning.map_contracts(t.part.withColumnRenamed("p_name", "contract"), rules)
    return out.groupBy("contract").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("size"))


@query("n2_melt_wide", """
SELECT l_orderkey, l_linenumber, ticker, px_last FROM (
  SELECT l_orderkey, l_linenumber, 'disc' AS ticker, l_discount AS px_last FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'tax', l_tax FROM lineitem)""")
def n2(t):
    wide = t.lineitem.select(
        F.struct("l_orderkey", "l_linenumber").alias("k"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax")
    )
    long = N.melt(wide, "k")
    return long.select("k.l_orderkey", "k.l_linenumber", "ticker", S.to_number(F.col("px_last")).alias("px_last"))


MACRO_RAW = """raw AS (SELECT CASE l_returnflag WHEN 'A' THEN 'PAYEMS' WHEN 'N' THEN 'INDPRO' ELSE 'OTHER' END AS series,
  CAST(l_shipdate AS DATE) AS d, l_linestatus, l_quantity AS q, l_tax FROM lineitem)"""


@query("n3_canonical_macro", with_(MACRO_RAW) + """
SELECT DATE '2026-02-01' AS dt_ingest,
  CASE series WHEN 'PAYEMS' THEN 'PAYROLLS_US' WHEN 'INDPRO' THEN 'INDPRO_US' ELSE series END AS series_id,
  last_day(d) AS period, CASE WHEN l_linestatus = 'F' THEN d + 20 END AS release_date, q AS value, 'index' AS unit,
  'fred' AS source, '20260201_fred' AS vintage_id, '' AS notes FROM raw WHERE l_tax > 0""")
def n3(t):
    series = F.expr("CASE l_returnflag WHEN 'A' THEN 'PAYEMS' WHEN 'N' THEN 'INDPRO' ELSE 'OTHER' END")
    day = F.col("l_shipdate").cast("date")
    text = F.when(F.col("l_tax") > 0, F.col("l_quantity").cast("string")).otherwise("n/a")
    released = F.when(F.col("l_linestatus") == "F", F.date_add(day, 20).cast("string")).otherwise("pending")
    raw = t.lineitem.select(
        series.alias("series_id"), day.cast("string").alias("period"), text.alias("value"), released.alias("release_date")
    )
    return N.canonical_macro(raw, "fred", N.mapping_table(t.spark), "2026-02-01", "20260201_fred")


@query("n9_macro_shape", """
SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS period, round(avg(o_totalprice), 4) AS value
FROM orders GROUP BY 1, 2""")
def n9(t):
    like_prices = panels.prices(t).select("dt", F.col("instrument").alias("ticker"), r("px", 4).alias("px_last"))
    return N.macro_shape(like_prices)


@query("n4_canonical_positions", """
SELECT DATE '2026-02-01' AS dt_ingest, CAST(o_orderdate AS DATE) AS report_date, o_orderpriority AS contract,
  'noncommercial' AS "group", o_orderkey - o_custkey AS net_pos, o_orderkey AS long, o_custkey AS short,
  o_orderkey + o_custkey AS open_interest FROM orders WHERE o_orderstatus <> 'P'""")
def n4(t):
    long = F.when(F.col("o_orderstatus") == "P", "n.a.").otherwise(F.col("o_orderkey").cast("string"))
    raw = t.orders.select(
        F.col("o_orderpriority").alias("Market_and_Exchange_Names"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Report_Date_as_YYYY-MM-DD"),
        long.alias("Noncommercial_Positions_Long_All"),
        F.col("o_custkey").cast("string").alias("Noncommercial_Positions_Short_All"),
        (F.col("o_orderkey") + F.col("o_custkey")).alias("Open_Interest_All"),
    )
    return N.canonical_positions(raw, "2026-02-01")


@query("n5_wide_net_positions", """
WITH totals AS (SELECT CAST(o_orderdate AS DATE) AS d, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18, 4)))) AS DOUBLE) AS total FROM orders GROUP BY 1),
nets AS (SELECT d, total - 500000 AS gold, 700000 - total AS oil FROM totals),
long AS (SELECT d, 'GOLD' AS contract, gold AS net FROM nets UNION ALL SELECT d, 'OIL', oil FROM nets)
SELECT d AS report_date, contract, CAST(greatest(net, 0) - greatest(-net, 0) AS BIGINT) AS net_pos, CAST(greatest(net, 0) AS BIGINT) AS long,
  CAST(greatest(-net, 0) AS BIGINT) AS short, CAST(abs(net) AS BIGINT) AS open_interest FROM long""")
def n5(t):
    total = F.round(F.sum(panels.exact("o_totalprice"))).cast("double")
    wide = t.orders.groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(
        (total - 500000).alias("gold_net"), (700000 - total).alias("oil_net")
    )
    out = N.canonical_positions(wide, "2026-02-01")
    return out.select("report_date", "contract", "net_pos", "long", "short", "open_interest")


@query("n6_noncommercial_buckets", """
SELECT l_returnflag || '-' || l_linestatus AS market, CAST(l_shipdate AS DATE) AS report_date,
  l_quantity + l_linenumber + CASE WHEN l_tax = 0 THEN NULL ELSE l_suppkey END AS long,
  l_quantity + l_partkey + l_linenumber AS short, CAST(l_orderkey AS DOUBLE) AS open_interest FROM lineitem""")
def n6(t):
    missing = F.when(F.col("l_tax") == 0, ".").otherwise(F.col("l_suppkey").cast("string"))
    text = lambda c: F.col(c).cast("string")
    raw = t.lineitem.select(
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("Market_and_Exchange_Names"),
        F.col("l_shipdate").cast("date").alias("Report_Date_as_YYYY-MM-DD"),
        text("l_orderkey").alias("Open_Interest_All"),
        text("l_quantity").alias("Asset_Mgr_Positions_Long_All"), text("l_quantity").alias("Asset_Mgr_Positions_Short_All"),
        text("l_linenumber").alias("Lev_Money_Positions_Long_All"), text("l_partkey").alias("Lev_Money_Positions_Short_All"),
        missing.alias("Other_Rept_Positions_Long_All"), text("l_linenumber").alias("Other_Rept_Positions_Short_All"),
    )
    return N.noncommercial(raw).withColumnsRenamed({
        "Market_and_Exchange_Names": "market", "Report_Date_as_YYYY-MM-DD": "report_date",
        "Noncommercial_Positions_Long_All": "long", "Noncommercial_Positions_Short_All": "short",
        "Open_Interest_All": "open_interest",
    })


@query("n7_canonical_policy", """
SELECT CAST(l_shipdate AS DATE) AS dt, CAST(l_quantity AS BIGINT) * 8 AS tenor_days, round(avg(l_discount), 6) AS implied_rate, 'ois' AS source
FROM lineitem GROUP BY 1, 2""")
def n7(t):
    raw = panels.daily_curve(t).drop("source").withColumn("implied_rate", r("implied_rate"))
    return N.canonical_policy(raw, F.col("dt"))


@query("n10_lenient_coercion", """
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k,
  CASE WHEN event_type = 'view' THEN NULL ELSE CAST(ts AS DATE) END AS dt FROM events""")
def n10(t):
    k = F.get_json_object("props", "$.k")
    dirty = F.when(F.col("event_type") == "error", F.concat(k, F.lit(" units"))).otherwise(k)
    day = F.when(F.col("event_type") == "view", "soon").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return t.events.select("event_id", S.to_number(dirty).alias("k"), S.to_day(day).alias("dt"))


@query("n11_strict_coercion", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(ts AS DATE) AS dt, CAST(user_id AS BIGINT) AS user_id FROM events""")
def n11(t):
    text = t.events.select(
        "event_id", F.get_json_object("props", "$.k").alias("k"),
        F.date_format("ts", "yyyy-MM-dd").alias("dt"), F.col("user_id").cast("string").alias("user_id"),
    )
    return N.strict_types(text, {"k": "float64", "dt": "date", "user_id": "int64"})


@query("n12_temporal_filter", """
SELECT week, count(*) AS n FROM (SELECT strftime(o_orderdate, '%G-%V') AS week, CAST(date_trunc('week', o_orderdate) AS DATE) AS monday FROM orders)
WHERE monday BETWEEN DATE '1996-02-07' AND DATE '1999-12-27' GROUP BY week""")
def n12(t):
    keyed = t.orders.select(S.iso_week_key(F.col("o_orderdate").cast("date")).alias("week"))
    counted = keyed.groupBy("week").agg(F.count(F.lit(1)).alias("n"))
    return N.between(counted, "week", "week", "1996-02-07", "1999-12-27")


@query("n13_partition_keys", """
SELECT dt, strftime(dt, '%Y-%m-%d') AS day, strftime(dt, '%G-%V') AS week, strftime(dt, '%Y-%m') AS month
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS dt FROM orders)""")
def n13(t):
    days = t.orders.select(F.col("o_orderdate").cast("date").alias("dt")).distinct()
    kinds = {"day": "dt", "week": "week", "month": "month"}
    return days.select("dt", *[N.partition_column(kind, F.col("dt")).alias(n) for n, kind in kinds.items()])


@query("n14_monday_week_key", """
SELECT strftime(o_orderdate, '%Y-%W') AS week, count(*) AS n, min(CAST(o_orderdate AS DATE)) AS first_day FROM orders GROUP BY 1""")
def n14(t):
    day = F.col("o_orderdate").cast("date")
    return t.orders.groupBy(S.monday_week_key(day).alias("week")).agg(
        F.count(F.lit(1)).alias("n"), F.min(day).alias("first_day")
    )


@query("n15_publication_thursday", """
SELECT DISTINCT strftime(dt, '%Y-%W') AS week,
  CAST(CASE WHEN strftime(dt, '%W') = '00' THEN
    date_trunc('week', make_date(CAST(year(dt) AS BIGINT), 1, 1)) + INTERVAL 3 DAY
  ELSE date_trunc('week', dt) + INTERVAL 3 DAY END AS DATE) AS thursday
FROM (SELECT CAST(o_orderdate AS DATE) AS dt FROM orders)""")
def n15(t):
    weeks = t.orders.select(S.monday_week_key(F.col("o_orderdate").cast("date")).alias("week")).distinct()
    return weeks.withColumn("thursday", S.monday_week_thursday(F.col("week")))


@query("f7_iso_week_dates", """
SELECT DISTINCT strftime(o_orderdate, '%G-%V') AS week, CAST(date_trunc('week', o_orderdate) AS DATE) AS monday,
  CAST(date_trunc('week', o_orderdate) AS DATE) + 3 AS thursday FROM orders""")
def f7(t):
    weeks = t.orders.select(S.iso_week_key(F.col("o_orderdate").cast("date")).alias("week")).distinct()
    return weeks.select("week", S.iso_week_monday(F.col("week")).alias("monday"), S.iso_week_thursday(F.col("week")).alias("thursday"))


@query("n16_time_split", with_(RETURNS) + """
SELECT 'train' AS part, instrument, count(*) AS n, round(avg(ret), 6) AS mean_ret FROM returns WHERE dt <= DATE '1999-06-30' GROUP BY 2
UNION ALL SELECT 'test', instrument, count(*), round(avg(ret), 6) FROM returns WHERE dt > DATE '1999-06-30' GROUP BY 2""")
def n16(t):
    from panelloom.operators.returns import simple_returns

    train, test = N.time_split(simple_returns(panels.prices(t), ["instrument"]), "1999-06-30")
    tagged = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return tagged.groupBy("part", "instrument").agg(F.count(F.lit(1)).alias("n"), r(F.avg("ret")).alias("mean_ret"))


@query("n17_non_finite_to_zero", """
SELECT event_id, CASE WHEN user_id % 5 IN (0, 1, 2) THEN 0.0 ELSE value END AS value FROM events""")
def n17(t):
    case = F.col("user_id") % 5
    dirty = (
        F.when(case == 0, F.lit(float("nan"))).when(case == 1, F.lit(float("inf")))
        .when(case == 2, F.lit(float("-inf"))).otherwise(F.col("value"))
    )
    return t.events.select("event_id", S.finite_or_zero(dirty).alias("value"))


@query("n22_signal_modes", """WITH strategy AS (
  SELECT l_returnflag AS portfolio, CAST(l_shipdate AS DATE) AS dt, round((avg(l_extendedprice) / 53000 - 1) * 0.02, 9) AS ret
  FROM lineitem GROUP BY 1, 2)
SELECT portfolio, dt, 'raw' AS mode, round(ret, 6) AS signal FROM strategy
UNION ALL SELECT portfolio, dt, 'log', round(ln(1 + greatest(ret, -0.999999)), 6) FROM strategy
UNION ALL SELECT portfolio, dt, 'zscore', round((ret - avg(ret) OVER w) / stddev_samp(ret) OVER w, 6) FROM strategy
WINDOW w AS (PARTITION BY portfolio)""")
def n22(t):
    from panelloom.operators.returns import signal

    base = panels.strategy(t)
    parts = [signal(base, ["portfolio"], m).withColumn("mode", F.lit(m)) for m in ("raw", "log", "zscore")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("portfolio", "dt", "mode", r("signal").alias("signal"))


@query("f5_f6_release_lags", """
SELECT o_orderkey, last_day(o_orderdate) AS month_end, lag_text, lag_months,
  last_day(date_trunc('month', o_orderdate) + to_months(lag_months)) AS released FROM (
  SELECT o_orderkey, o_orderdate, lag_text, CAST(CASE WHEN lag_text LIKE 'P%M' THEN substr(lag_text, 2, 1) ELSE '1' END AS INTEGER) AS lag_months
  FROM (SELECT o_orderkey, o_orderdate, CASE o_orderstatus WHEN 'F' THEN 'P2M' WHEN 'O' THEN 'P3M' ELSE 'monthly' END AS lag_text FROM orders))""")
def f5_f6(t):
    text = F.expr("CASE o_orderstatus WHEN 'F' THEN 'P2M' WHEN 'O' THEN 'P3M' ELSE 'monthly' END")
    day = F.col("o_orderdate").cast("date")
    lag = S.release_lag_months(F.col("lag_text"))
    return t.orders.withColumn("lag_text", text).select(
        "o_orderkey", S.month_end(day).alias("month_end"), "lag_text", lag.alias("lag_months"),
        S.month_end(day, lag).alias("released"),
    )


@query("f8_epoch_millis_day", "SELECT event_id, CAST(ts AS DATE) AS dt FROM events")
def f8(t):
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    millis = F.timestamp_diff("SECOND", epoch, F.col("ts")) * 1000
    return t.events.select("event_id", S.epoch_millis_day(millis).alias("dt"))


@query("f3_f4_numeric_functions", """
SELECT event_id, greatest(1.0, least(100.0, value)) AS clipped, round(sqrt(value), 6) AS root, round(ln(1 + value), 6) AS log1p,
  round(exp(-value), 6) AS decay, round(pow(value, 1.5), 4) AS power, round(abs(value - 50), 6) AS gap, round_even(value, 1) AS even
FROM events""")
def f3_f4(t):
    v = F.col("value")
    return t.events.select(
        "event_id", S.clip(v, 1.0, 100.0).alias("clipped"), r(F.sqrt(v)).alias("root"), r(F.log1p(v)).alias("log1p"),
        r(F.exp(-v)).alias("decay"), r(F.pow(v, F.lit(1.5)), 4).alias("power"), r(F.abs(v - 50)).alias("gap"),
        S.round_half_even(v, 1).alias("even"),
    )


@query("f9_string_functions", """
SELECT p_partkey, upper(p_name) AS upper_name, contains(upper(p_name), 'RED') AS has_red, replace(p_name, ' ', '_') AS joined,
  regexp_replace(p_brand, '^Brand#', '') AS brand_number, lpad(regexp_replace(p_brand, '^Brand#', ''), 2, '0') AS padded FROM part""")
def f9(t):
    number = F.regexp_replace("p_brand", "^Brand#", "")
    return t.part.select(
        "p_partkey", F.upper("p_name").alias("upper_name"), F.contains(F.upper("p_name"), F.lit("RED")).alias("has_red"),
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("joined"), number.alias("brand_number"), F.lpad(number, 2, "0").alias("padded"),
    )


@query("f10_row_digest", """
SELECT o_orderkey, sha256(concat_ws(',', CAST(o_orderkey AS VARCHAR), coalesce(CASE WHEN o_orderstatus <> 'P' THEN length(o_orderpriority) || ':' || o_orderpriority END, '__NULL__'),
  printf('%.11e', o_totalprice), strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'))) AS digest FROM orders""")
def f10(t):
    rows = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("o_orderpriority"),
        "o_totalprice", "o_orderdate",
    )
    text = S.canonical_text(rows.schema, rows.columns)
    return rows.select("o_orderkey", F.sha2(text, 256).alias("digest"))


# --- quality --------------------------------------------------------------------------


@query("q1_q2_column_report", """
SELECT s."column", s.status, n.n_rows FROM (VALUES ('dt', 'ok'), ('instrument', 'ok'), ('return', 'ok'), ('px_t', 'missing'), ('px_t_1', 'missing'),
  ('vendor', 'unexpected')) s("column", status), (SELECT count(*) AS n_rows FROM orders) n""")
def q1_q2(t):
    frame = t.orders.select(
        F.col("o_orderdate").cast("date").alias("dt"), F.col("o_orderpriority").alias("instrument"),
        F.col("o_totalprice").alias("return"), F.col("o_orderstatus").alias("vendor"),
    )
    return quality.column_report(frame, dataset("returns_daily"))


@query("q3_type_check", """
SELECT 'k' AS "column", count(*) FILTER (event_type = 'error') AS n_bad FROM events
UNION ALL SELECT 'dt', count(*) FILTER (event_type = 'view') FROM events
UNION ALL SELECT 'n', count(*) FILTER (false) FROM events""")
def q3(t):
    k = F.get_json_object("props", "$.k")
    frame = t.events.select(
        F.when(F.col("event_type") == "error", F.concat(k, F.lit("?"))).otherwise(k).alias("k"),
        F.when(F.col("event_type") == "view", "later").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("dt"),
        F.col("user_id").cast("string").alias("n"), "event_type",
    )
    return quality.uncastable(frame, {"k": "float64", "dt": "date", "n": "int64", "event_type": "string"})


@query("q4_delivery_order", """
SELECT o_orderkey AS seq, dt, previous FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS dt,
  lag(CAST(o_orderdate AS DATE)) OVER (ORDER BY o_orderkey) AS previous FROM orders) WHERE dt < previous""")
def q4(t):
    delivered = t.orders.select(F.col("o_orderkey").alias("seq"), F.col("o_orderdate").cast("date").alias("dt"))
    return quality.out_of_order(delivered, "seq")


@query("q5_duplicate_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def q5(t):
    return quality.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("q6_u4_missing_series", """
SELECT DISTINCT p_type AS series_id FROM part WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_size > 10 AND p_name LIKE 'red%')
UNION SELECT DISTINCT 'X-' || p_brand FROM part""")
def q6(t):
    seen = t.part.where((F.col("p_size") > 10) & F.col("p_name").startswith("red")).select(F.col("p_type").alias("series_id"))
    critical = t.part.select(F.col("p_type").alias("series_id")).unionByName(
        t.part.select(F.concat(F.lit("X-"), "p_brand").alias("series_id"))
    ).distinct()
    return quality.missing_series(seen, critical)


@query("q7_partition_values", """
SELECT month, low, high FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month,
  min(strftime(o_orderdate + INTERVAL 2 DAY, '%Y-%m')) AS low, max(strftime(o_orderdate + INTERVAL 2 DAY, '%Y-%m')) AS high
  FROM orders GROUP BY 1) WHERE low <> month OR high <> month""")
def q7(t):
    day = F.col("o_orderdate").cast("date")
    frame = t.orders.select(S.month_key(day).alias("month"), S.month_key(F.date_add(day, 2)).alias("held"))
    return quality.mixed_partitions(frame, "month", "held")


@query("q8_template_dates", """
SELECT CASE WHEN o_orderstatus = 'P' THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%Y-%m') || '-31' END AS "Date", o_orderkey
FROM orders WHERE o_orderstatus = 'P' OR (o_orderstatus = 'O' AND day(last_day(o_orderdate)) < 31)""")
def q8(t):
    month = F.date_format("o_orderdate", "yyyy-MM")
    text = (
        F.when(F.col("o_orderstatus") == "P", F.date_format("o_orderdate", "dd/MM/yyyy"))
        .when(F.col("o_orderstatus") == "O", F.concat(month, F.lit("-31")))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    )
    return quality.bad_template_dates(t.orders.select(text.alias("Date"), "o_orderkey"))


@query("q9_null_share", """
SELECT event_type, round(avg(CASE WHEN value > 60 OR (event_type = 'view' AND value > 40) THEN 1.0 ELSE 0.0 END), 6) AS null_share,
  avg(CASE WHEN value > 60 OR (event_type = 'view' AND value > 40) THEN 1.0 ELSE 0.0 END) > 0.2 AS flagged FROM events GROUP BY 1""")
def q9(t):
    gone = (F.col("value") > 60) | ((F.col("event_type") == "view") & (F.col("value") > 40))
    frame = t.events.withColumn("v", F.when(~gone, F.col("value")))
    return quality.null_share(frame, ["event_type"], "v").withColumn("null_share", r("null_share"))


@query("q10_flat_features", """
SELECT event_type, 0.0::DOUBLE AS sd FROM (SELECT event_type, stddev_samp(CASE WHEN event_type IN ('view', 'click') THEN 3.0 ELSE value END) AS s
FROM events GROUP BY 1) WHERE s < 1e-8""")
def q10(t):
    frame = t.events.withColumn("v", F.when(F.col("event_type").isin("view", "click"), F.lit(3.0)).otherwise(F.col("value")))
    return quality.flat_features(frame, ["event_type"], "v").withColumn("sd", r("sd"))


@query("q11_duplicate_dates", """
SELECT user_id, CAST(ts AS DATE) AS dt, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1""")
def q11(t):
    frame = t.events.select("user_id", F.col("ts").cast("date").alias("dt"))
    return quality.duplicate_keys(frame, ["user_id", "dt"])


@query("q12_rare_states", with_(STATES) + """
SELECT portfolio, CAST(state AS INTEGER) AS state, n, round(share, 6) AS share FROM (
  SELECT portfolio, state, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY portfolio) AS share
  FROM states GROUP BY 1, 2) WHERE share < 0.25""")
def q12(t):
    return quality.rare_states(panels.states(t), ["portfolio"], "state", 0.25).withColumn("share", r("share"))
