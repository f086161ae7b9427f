"""Lake reads and writes, landed files, change detection and update jobs."""

from pyspark.sql import functions as F

from panelloom.functions import scalars as S
from panelloom.operators import expectations
from panelloom.operators import incremental as I
from panelloom.operators import normalize as N
from panelloom.operators.returns import by_date, simple_returns
from panelloom.plans import ingest, jobs
from panelloom.plans.catalog.alignment import KNOWN, AS_REPORTED, POLICY
from panelloom.plans.registry import query
from panelloom.plans.sql import EXACT_POSITIONS, POSITIONS, RELEASES, RETURNS, VENDOR_PRICES, with_
from panelloom.session import scratch_path
from panelloom.sources import files, panels
from panelloom.sources.lake import Lake, expired


def r(value, digits=6):
    return F.round(F.col(value) if isinstance(value, str) else value, digits)


def new_lake(t) -> Lake:
    return Lake(t.spark, scratch_path(t.spark, "lake"))


def positions(t):
    """Silver cot_weekly rows from the weekly reports."""
    return panels.weekly_positions(t).select(
        F.lit("2026-02-01").cast("date").alias("dt_ingest"), "report_date", "contract", F.col("grp").alias("group"),
        (F.col("long") - F.col("short")).alias("net_pos"), "long", "short",
        (F.col("long") + F.col("short")).alias("open_interest"),
    )


def gold_return_rows(t):
    out = simple_returns(panels.prices(t), ["instrument"])
    return out.select("dt", "instrument", F.col("ret").alias("return"), "px_t", "px_t_1")


# --- reads and writes -----------------------------------------------------------------


@query("s1_s4_write_and_load_range", with_(RETURNS) + """
SELECT dt, instrument, round(ret, 6) AS "return" FROM returns WHERE dt BETWEEN DATE '1996-03-01' AND DATE '2000-02-29'""")
def s1(t):
    lake = new_lake(t)
    lake.replace("returns_daily", gold_return_rows(t))
    out = lake.load("returns_daily", "1996-03-01", "2000-02-29", ["dt", "instrument", "return"])
    return out.withColumn("return", r("return"))


@query("s2_dataset_view", with_(EXACT_POSITIONS) + """
SELECT strftime(report_date, '%G-%V') AS week, count(*) AS n, sum(long - short)::BIGINT AS net FROM positions GROUP BY 1""")
def s2(t):
    lake = new_lake(t)
    lake.replace("cot_weekly", positions(t))
    view = lake.view("cot_weekly", "canonical", f"positions_{abs(hash(lake.root))}")
    return t.spark.sql(f"SELECT week, count(*) AS n, sum(net_pos) AS net FROM {view} GROUP BY week")


@query("s3_read_given_partitions", with_(EXACT_POSITIONS) + """,
busy AS (SELECT date_trunc('week', report_date) AS w FROM positions GROUP BY 1 HAVING sum(long + short) > 6000000)
SELECT report_date, contract, grp AS "group", long - short AS net_pos FROM positions WHERE date_trunc('week', report_date) IN (SELECT w FROM busy)""")
def s3(t):
    lake = new_lake(t)
    lake.replace("cot_weekly", positions(t))
    busy = lake.scan("cot_weekly").groupBy("week").agg(F.sum("open_interest").alias("s")).where("s > 6000000")
    return lake.read_keys("cot_weekly", busy).select("report_date", "contract", "group", "net_pos")


@query("s5_keyed_upsert", with_(EXACT_POSITIONS) + """
SELECT report_date, contract, grp AS "group", CASE WHEN grp = 'P' THEN long - 2 * short ELSE long - short END AS net_pos FROM positions""")
def s5(t):
    lake = new_lake(t)
    rows = positions(t)
    late = F.col("contract") == "5-LOW"
    lake.upsert("cot_weekly", rows.where(~late))
    revised = rows.withColumn("net_pos", F.when(F.col("group") == "P", F.col("long") - 2 * F.col("short")).otherwise(F.col("net_pos")))
    lake.upsert("cot_weekly", revised)
    lake.upsert("cot_weekly", revised)
    return lake.load("cot_weekly", columns=["report_date", "contract", "group", "net_pos"])


@query("s6_bronze_landing", """
SELECT DATE '2026-02-01' AS ingest_date, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
UNION ALL SELECT DATE '2026-02-02', count(*), round(sum(o_totalprice), 2) FROM orders WHERE o_orderstatus = 'P'""")
def s6(t):
    lake = new_lake(t)
    path = lake.land("orders", t.orders, "2026-02-01")
    lake.land("orders", t.orders, "2026-02-02")
    lake.land("orders", t.orders.where("o_orderstatus = 'P'"), "2026-02-02")
    return t.spark.read.parquet(path).groupBy("ingest_date").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("o_totalprice"), 2).alias("total")
    )


@query("s7_csv_source", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS dt, o_orderpriority AS ticker, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS px_last FROM orders""")
def s7(t):
    path = scratch_path(t.spark, "csv")
    price = F.when(F.col("o_orderstatus") == "P", ".").otherwise(F.col("o_totalprice").cast("string"))
    t.orders.select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("dt"), F.col("o_orderpriority").alias("ticker"), price.alias("px_last")
    ).write.option("header", True).csv(path)
    raw = files.read_csv(t.spark, path, "o_orderkey bigint, dt date, ticker string, px_last string")
    return raw.withColumn("px_last", S.to_number(F.col("px_last")))


@query("s8_positional_report", """
SELECT l_returnflag || '-' || l_linestatus || '-' || l_orderkey AS market, CAST(l_shipdate AS DATE) AS report_date,
  l_quantity + l_linenumber + l_suppkey AS long, l_quantity + l_linenumber + l_partkey AS short, l_orderkey::DOUBLE AS open_interest FROM lineitem""")
def s8(t):
    filled = {
        "Market_and_Exchange_Names": F.concat_ws("-", "l_returnflag", "l_linestatus", "l_orderkey"),
        "Report_Date_as_YYYY-MM-DD": F.date_format("l_shipdate", "yyyy-MM-dd"),
        "Open_Interest_All": F.col("l_orderkey"),
        "Asset_Mgr_Positions_Long_All": F.col("l_quantity"), "Asset_Mgr_Positions_Short_All": F.col("l_quantity"),
        "Lev_Money_Positions_Long_All": F.col("l_linenumber"), "Lev_Money_Positions_Short_All": F.col("l_linenumber"),
        "Other_Rept_Positions_Long_All": F.col("l_suppkey"), "Other_Rept_Positions_Short_All": F.col("l_partkey"),
    }
    path = scratch_path(t.spark, "report")
    t.lineitem.select(*[filled.get(c, F.lit("0")).cast("string").alias(c) for c in files.REPORT_COLUMNS]).write.csv(path)
    return report_rows(files.read_positions(t.spark, path))


def report_rows(out):
    return out.select(
        F.col("Market_and_Exchange_Names").alias("market"), F.col("`Report_Date_as_YYYY-MM-DD`").cast("date").alias("report_date"),
        F.col("Noncommercial_Positions_Long_All").cast("double").alias("long"), F.col("Noncommercial_Positions_Short_All").cast("double").alias("short"),
        F.col("Open_Interest_All").cast("double").alias("open_interest"),
    )


@query("s8_mixed_layout_folder", """
SELECT l_returnflag || '-' || l_linestatus || '-' || l_orderkey AS market, CAST(l_shipdate AS DATE) AS report_date,
  CASE WHEN l_linestatus = 'O' THEN l_quantity + l_linenumber + l_suppkey ELSE l_quantity::DOUBLE END AS long,
  CASE WHEN l_linestatus = 'O' THEN l_quantity + l_linenumber + l_partkey ELSE l_suppkey::DOUBLE END AS short, l_orderkey::DOUBLE AS open_interest FROM lineitem""")
def s8_mixed(t):
    """Headerless files, newer files with a header and older files with a header in one landing folder."""
    keys = {
        "Market_and_Exchange_Names": F.concat_ws("-", "l_returnflag", "l_linestatus", "l_orderkey"),
        "Report_Date_as_YYYY-MM-DD": F.date_format("l_shipdate", "yyyy-MM-dd"), "Open_Interest_All": F.col("l_orderkey"),
    }
    newer = {
        **keys, "Asset_Mgr_Positions_Long_All": F.col("l_quantity"), "Asset_Mgr_Positions_Short_All": F.col("l_quantity"),
        "Lev_Money_Positions_Long_All": F.col("l_linenumber"), "Lev_Money_Positions_Short_All": F.col("l_linenumber"),
        "Other_Rept_Positions_Long_All": F.col("l_suppkey"), "Other_Rept_Positions_Short_All": F.col("l_partkey"),
    }
    older = {**keys, "Noncommercial_Positions_Long_All": F.col("l_quantity"), "Noncommercial_Positions_Short_All": F.col("l_suppkey")}
    path = scratch_path(t.spark, "reports")
    text = lambda cells: [c.cast("string").alias(n) for n, c in cells.items()]
    opened = F.col("l_linestatus") == "O"
    flagged = F.col("l_returnflag") == "N"
    positional = {c: newer.get(c, F.lit("0")) for c in files.REPORT_COLUMNS}
    t.lineitem.where(opened & flagged).select(*text(positional)).write.csv(path)
    t.lineitem.where(opened & ~flagged).select(*text(newer)).write.mode("append").option("header", True).csv(path)
    t.lineitem.where(~opened).select(*text(older)).write.mode("append").option("header", True).csv(path)
    return report_rows(files.read_positions(t.spark, path))


@query("s9_f16_json_observations", """
SELECT dt, ticker, px_last FROM (
  SELECT CAST(o_orderdate AS DATE) AS dt, o_orderpriority AS ticker, o_totalprice AS px_last FROM orders
  UNION ALL SELECT CAST(o_orderdate AS DATE) + 1, o_orderpriority, CAST(NULL AS DOUBLE) FROM orders)""")
def s9(t):
    path = scratch_path(t.spark, "json")
    day = F.col("o_orderdate").cast("date")
    one = F.struct(day.cast("string").alias("date"), F.col("o_totalprice").cast("string").alias("value"))
    two = F.struct(F.date_add(day, 1).cast("string").alias("date"), F.lit(".").alias("value"))
    t.orders.select(F.col("o_orderpriority").alias("ticker"), F.array(one, two).alias("observations")).write.json(path)
    return files.read_observations(t.spark, path)


@query("s9_f8_json_bars", "SELECT CAST(ts AS DATE) AS dt, event_type AS ticker, value AS px_last FROM events")
def s9_bars(t):
    path = scratch_path(t.spark, "bars")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    bar = F.struct((F.timestamp_diff("SECOND", epoch, F.col("ts")) * 1000).alias("t"), F.col("value").alias("c"))
    t.events.select(F.col("event_type").alias("ticker"), F.array(bar).alias("results")).write.json(path)
    return files.read_bars(t.spark, path)


@query("s10_result_sinks", with_(RETURNS) + """
SELECT kind, run_id, instrument, count(*) AS n, round(avg(ret), 6) AS mean_ret FROM returns,
  (VALUES ('parquet'), ('csv'), ('json')) k(kind), (VALUES ('a'), ('b')) x(run_id) GROUP BY ALL""")
def s10(t):
    base = simple_returns(panels.prices(t), ["instrument"]).select("instrument", "dt", "ret")
    out = None
    for kind in ("parquet", "csv", "json"):
        path = scratch_path(t.spark, kind)
        for run in ("a", "b"):
            files.write_results(base.withColumn("run_id", F.lit(run)), path, kind)
        back = t.spark.read.schema("instrument string, dt date, ret double, run_id string").format(kind).option("header", True).load(path)
        part = back.groupBy("run_id", "instrument").agg(F.count(F.lit(1)).alias("n"), r(F.avg("ret")).alias("mean_ret"))
        part = part.withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@query("s11_partition_catalogue", with_(POSITIONS) + """
SELECT DISTINCT 'week=' || strftime(report_date, '%G-%V') AS partition, CAST(date_trunc('week', report_date) AS DATE) AS day,
  date_trunc('week', report_date) = (SELECT max(date_trunc('week', report_date)) FROM positions) AS is_latest FROM positions""")
def s11(t):
    lake = new_lake(t)
    lake.replace("cot_weekly", positions(t))
    latest = lake.latest("cot_weekly")
    return lake.partitions("cot_weekly").select("partition", "day", (F.col("partition") == latest).alias("is_latest"))


@query("s12_retention", with_(POSITIONS) + """
, weeks AS (SELECT DISTINCT 'week=' || strftime(report_date, '%G-%V') AS partition, CAST(date_trunc('week', report_date) AS DATE) AS day FROM positions)
SELECT partition FROM weeks WHERE day < DATE '2001-07-09' AND partition NOT IN (SELECT partition FROM weeks ORDER BY day DESC LIMIT 10)""")
def s12(t):
    lake = new_lake(t)
    lake.replace("cot_weekly", positions(t))
    before = lake.partitions("cot_weekly").select("partition")
    lake.prune("cot_weekly", "silver", older_than="2001-07-09", keep_last=10)
    return before.join(lake.partitions("cot_weekly"), "partition", "left_anti")


@query("u1_u2_union_keep_last", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS price, CAST(l_shipdate AS DATE) AS dt FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_extendedprice DESC) AS rn FROM lineitem) WHERE rn = 1""")
def u2(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"), F.col("l_shipdate").cast("date").alias("dt"))
    early = rows.where(F.col("dt") < "1998-01-01")
    both = rows.where(F.col("dt") >= "1998-01-01").unionByName(early, allowMissingColumns=True)
    return I.keep_last(both, ["l_orderkey", "l_linenumber"], ["dt", "price"]).withColumn("price", r("price", 2))


# --- change detection -----------------------------------------------------------------

ROW_TEXT = "concat_ws(',', o_custkey, o_orderkey, length(o_orderpriority) || ':' || o_orderpriority, length(o_orderstatus) || ':' || o_orderstatus, printf('%.11e', {price}))"
LANES = """lanes_{n} AS (SELECT strftime(o_orderdate, '%Y-%m') AS partition, sha256({text}) AS h FROM orders {where}),
fp_{n} AS (SELECT partition, count(*) AS row_count, sha256(count(*) || '|' || bit_xor(('0x' || substr(h, 1, 15))::BIGINT) || '|' || sum(('0x' || substr(h, 16, 15))::BIGINT)) AS fingerprint
  FROM lanes_{n} GROUP BY 1)"""
OLD = LANES.format(n="old", text=ROW_TEXT.format(price="o_totalprice"), where="WHERE o_orderdate < DATE '2001-06-01'")
REVISED = "CASE WHEN o_totalprice > 499000 THEN o_totalprice + 1 ELSE o_totalprice END"
NEW = LANES.format(n="new", text=ROW_TEXT.format(price=REVISED), where="")


def month_rows(t, revised=False):
    price = F.col("o_totalprice")
    if revised:
        price = F.when(price > 499000, price + 1).otherwise(price)
    month = S.month_key(F.col("o_orderdate"))
    return t.orders.select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus", price.alias("o_totalprice"), month.alias("month"))


def snapshot(frame):
    return I.fingerprints(frame, "month").withColumn("dataset", F.lit("silver.orders"))


@query("i1_a15_fingerprints", with_(NEW) + " SELECT * FROM fp_new")
def i1(t):
    return I.fingerprints(month_rows(t, True), "month")


CHANGED = "changed AS (SELECT n.partition, n.fingerprint, n.row_count FROM fp_new n LEFT JOIN fp_old o USING (partition) WHERE n.fingerprint IS DISTINCT FROM o.fingerprint)"


@query("j13_i2_i3_changed_partitions", with_(OLD, NEW, CHANGED) + " SELECT partition, fingerprint, row_count FROM changed")
def j13(t):
    old = snapshot(month_rows(t).where(F.col("month") < "2001-06"))
    return I.changed_partitions(old, snapshot(month_rows(t, True))).select("partition", "fingerprint", "row_count")


@query("i4_impact_map", with_(VENDOR_PRICES, POSITIONS, RELEASES) + """,
days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_totalprice > 490000),
hit AS (SELECT * FROM (SELECT dt, lead(dt) OVER (PARTITION BY vendor, instrument ORDER BY dt) AS next_dt FROM vendor_prices) WHERE dt IN (SELECT d FROM days)),
reports AS (SELECT report_date, max(CASE WHEN strftime(report_date, '%G-%V') IN (SELECT strftime(d, '%G-%V') FROM days) THEN 1 ELSE 0 END)
  OVER (PARTITION BY contract, grp ORDER BY report_date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS reached FROM positions),
span AS (SELECT min(period) AS a, max(dt_ingest) AS b FROM releases WHERE dt_ingest IN (SELECT last_day(d) FROM days))
SELECT 'gold.returns_daily' AS dataset, strftime(dt, '%Y-%m-%d') AS partition FROM hit
UNION SELECT 'gold.returns_daily', strftime(next_dt, '%Y-%m-%d') FROM hit WHERE next_dt IS NOT NULL
UNION SELECT 'gold.policy_features', strftime(d, '%Y-%m-%d') FROM days
UNION SELECT 'gold.macro_asof_monthly', strftime(m, '%Y-%m') FROM span, generate_series(date_trunc('month', least(a, b)), date_trunc('month', b), INTERVAL 1 MONTH) g(m)
UNION SELECT 'gold.cot_z_weekly', strftime(report_date, '%G-%V') FROM reports WHERE reached = 1""")
def i4(t):
    """Partitions reached by changed days, from the price days, reports and releases that are stored."""
    day = F.col("o_orderdate").cast("date")
    hit = t.orders.where(F.col("o_totalprice") > 490000).select(
        S.day_key(day).alias("day"), S.iso_week_key(day).alias("week"), S.day_key(F.last_day(day)).alias("month_end")).distinct()
    source = lambda name, key: F.struct(F.lit(f"silver.{name}").alias("dataset"), F.col(key).alias("partition"))
    changed = hit.select(F.inline(F.array(
        source("market_prices", "day"), source("policy_curve", "day"), source("macro_releases", "month_end"), source("cot_weekly", "week")))).distinct()
    links = panels.vendor_prices(t).select("dt", F.lead("dt").over(by_date(["vendor", "instrument"])).alias("next_dt"))
    reports = panels.weekly_positions(t).withColumnRenamed("grp", "group")
    releases = panels.releases(t).select(F.col("dt_ingest").alias("dt"), "period")
    return I.impacted(changed, links, reports, releases, 4)


# --- jobs: two staged runs must equal one computation over everything -----------------


def silver_prices(t):
    """Daily mean prices per vendor and instrument."""
    daily = t.orders.groupBy(
        F.col("o_orderstatus").alias("vendor"), F.col("o_orderpriority").alias("instrument"),
        F.col("o_orderdate").cast("date").alias("dt"),
    ).agg(F.avg("o_totalprice").alias("px"))
    return daily.select(
        "vendor", "dt", "instrument", F.col("px").alias("px_last"), F.lit("USD").alias("currency"),
        F.col("instrument").alias("source_id"), F.lit("2026-02-01 00:00:00").cast("timestamp").alias("fetch_ts"),
    )


def staged_prices(t):
    """First delivery up to 1999 with one month still wrong, then the rest with the correction."""
    rows = silver_prices(t)
    wrong = F.when(F.date_format("dt", "yyyy-MM") == "1999-06", F.col("px_last") * 1.1).otherwise(F.col("px_last"))
    first = rows.where(F.col("dt") <= "1999-12-31").withColumn("px_last", wrong)
    second = rows.where((F.col("dt") >= "2000-01-01") | (F.date_format("dt", "yyyy-MM") == "1999-06"))
    return first, second


GOLD_RETURNS = with_(VENDOR_PRICES) + """,
r AS (SELECT vendor, instrument, dt, px, lag(px) OVER (PARTITION BY vendor, instrument ORDER BY dt) AS prev FROM vendor_prices),
one AS (SELECT dt, instrument, arg_min(px / prev - 1, vendor) AS ret FROM r WHERE prev IS NOT NULL GROUP BY 1, 2)
SELECT dt, instrument, round(ret, 6) AS "return" FROM one"""


@query("i6_update_prices", GOLD_RETURNS)
def i6(t):
    lake = new_lake(t)
    first, second = staged_prices(t)
    jobs.update_prices(lake, first, "2026-02-01")
    jobs.update_prices(lake, second, "2026-02-02")
    return lake.load("returns_daily", columns=["dt", "instrument", "return"]).withColumn("return", r("return"))


@query("i5_rebuild_changed_only", with_(EXACT_POSITIONS) + """
SELECT strftime(report_date, '%G-%V') AS week, contract, grp AS "group", long - short AS net_pos,
  round(CASE WHEN count(*) OVER w >= 4 THEN ((long - short) - avg(long - short) OVER w) / nullif(stddev_samp(long - short) OVER w, 0) END, 6) AS zscore
FROM positions WINDOW w AS (PARTITION BY contract, grp ORDER BY report_date ROWS BETWEEN 259 PRECEDING AND CURRENT ROW)""")
def i5(t):
    lake = new_lake(t)
    rows = positions(t)
    wrong = F.when(F.year("report_date") == 1999, F.col("net_pos") + 1000).otherwise(F.col("net_pos"))
    jobs.silver_upsert(lake, "cot_weekly", rows.withColumn("net_pos", wrong))
    jobs.rebuild(lake)
    seen = jobs.Versions(lake).log().agg(F.max("written_at")).first()[0]
    jobs.silver_upsert(lake, "cot_weekly", rows.where(F.year("report_date") == 1999))
    jobs.rebuild(lake, since=seen)
    return lake.load("cot_z_weekly").withColumn("zscore", r("zscore"))


@query("i7_update_macro", with_(RELEASES + KNOWN.format(eff=AS_REPORTED.format(lag="CASE series_id WHEN 'A' THEN 2 ELSE 1 END")).replace(
    "SELECT DISTINCT last_day(o_orderdate) AS month_end FROM orders",
    "SELECT last_day(m) AS month_end FROM generate_series((SELECT min(date_trunc('month', period)) FROM releases), TIMESTAMP '2002-03-01', INTERVAL 1 MONTH) g(m)")) + """
SELECT month_end, """ + ", ".join(f"max(value) FILTER (series_id = '{s}') AS \"{s}\", max(vintage_id) FILTER (series_id = '{s}') AS \"{s}__vintage_id\"" for s in "ANR") + """
FROM known GROUP BY month_end""")
def i7(t):
    lake = new_lake(t)
    rows = panels.releases(t).select(
        "dt_ingest", "series_id", "period", "release_date", "value", F.lit("index").alias("unit"),
        F.lit("fred").alias("source"), "vintage_id", F.lit("").alias("notes"),
    )
    cut = F.col("dt_ingest") < "1999-01-01"
    jobs.update_macro(lake, rows.where(cut).withColumn("value", F.col("value") + 1), "2002-03-15", {"A": "P2M"})
    jobs.update_macro(lake, rows, "2002-03-15", {"A": "P2M"})
    return lake.load("macro_asof_monthly")


@query("i8_update_positions", with_(EXACT_POSITIONS) + """
SELECT strftime(report_date, '%G-%V') AS week, contract, grp AS "group", long - short AS net_pos,
  round(CASE WHEN count(*) OVER w >= 4 THEN ((long - short) - avg(long - short) OVER w) / nullif(stddev_samp(long - short) OVER w, 0) END, 6) AS zscore
FROM positions WINDOW w AS (PARTITION BY contract, grp ORDER BY report_date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)""")
def i8(t):
    lake = new_lake(t)
    rows = positions(t)
    jobs.update_positions(lake, rows.where(F.col("report_date") < "2000-01-01"), "2026-02-01", 52)
    jobs.update_positions(lake, rows.where(F.col("report_date") >= "1999-11-01"), "2026-02-02", 52)
    return lake.load("cot_z_weekly").withColumn("zscore", r("zscore"))


@query("i9_update_policy", with_(POLICY) + """
SELECT dt, round(implied_cut_prob_3m, 6) AS implied_cut_prob_3m, round(implied_cut_prob_6m, 6) AS implied_cut_prob_6m,
  round(term_front_slope, 6) AS term_front_slope, round(terminal_shift_30d, 6) AS terminal_shift_30d, source FROM policy""")
def i9(t):
    lake = new_lake(t)
    rows = panels.daily_curve(t)
    early = F.col("dt") < "1998-01-01"
    jobs.update_policy(lake, rows.where(early).withColumn("implied_rate", F.col("implied_rate") * 2), "2026-02-01")
    jobs.update_policy(lake, rows, "2026-02-02")
    names = ["implied_cut_prob_3m", "implied_cut_prob_6m", "term_front_slope", "terminal_shift_30d"]
    out = lake.load("policy_features", columns=["dt", *names, "source"])
    return out.withColumns({c: r(c) for c in names})


def weekly_zscores(t):
    from panelloom.operators.positioning import zscores

    return zscores(positions(t))


def provider(t):
    """Rows of a weekly dataset in a date range, as a vendor would serve them."""
    from panelloom.operators.normalize import between

    rows = weekly_zscores(t)
    return lambda name, start, end: between(rows, "week", "week", start, end)


@query("i10_high_water_update", with_(EXACT_POSITIONS) + """
SELECT strftime(report_date, '%G-%V') AS week, count(*) AS n, sum(long - short)::BIGINT AS net FROM positions GROUP BY 1""")
def i10(t):
    lake, fetch = new_lake(t), provider(t)
    jobs.update_dataset(lake, "cot_z_weekly", fetch, start="1994-12-26", end="1998-12-31")
    jobs.update_dataset(lake, "cot_z_weekly", fetch, end="2001-12-31")
    jobs.update_dataset(lake, "cot_z_weekly", fetch, end="2001-12-31")
    return lake.load("cot_z_weekly").groupBy("week").agg(F.count(F.lit(1)).alias("n"), F.sum("net_pos").alias("net"))


@query("i11_update_statuses", with_(POSITIONS) + """,
w AS (SELECT CAST(date_trunc('week', report_date) AS DATE) AS monday FROM positions)
SELECT 'first' AS run, 'updated' AS status, count(*) FILTER (monday BETWEEN DATE '1994-12-26' AND DATE '1998-12-31') AS rows FROM w
UNION ALL SELECT 'second', 'updated', count(*) FILTER (monday > DATE '1998-12-28') FROM w
UNION ALL SELECT 'third', 'no_data', CAST(0 AS BIGINT)
UNION ALL SELECT 'fourth', 'up_to_date', CAST(0 AS BIGINT)""")
def i11(t):
    lake, fetch = new_lake(t), provider(t)
    runs = {
        "first": jobs.backfill(lake, ["cot_z_weekly"], fetch, "1994-12-26", "1998-12-31"),
        "second": jobs.update_all(lake, ["cot_z_weekly"], fetch, end="2001-12-31"),
        "third": jobs.update_all(lake, ["cot_z_weekly"], fetch, end="2002-12-31"),
        "fourth": jobs.update_all(lake, ["cot_z_weekly"], fetch, end="2000-01-01"),
    }
    out = None
    for name, frame in runs.items():
        part = frame.select(F.lit(name).alias("run"), "status", "rows")
        out = part if out is None else out.unionByName(part)
    return out


@query("i12_run_lineage", with_(POSITIONS) + """
SELECT 'update_positions' AS job, 'silver.cot_weekly' AS dataset, count(DISTINCT strftime(report_date, '%G-%V')) AS n_partitions, count(*)::BIGINT AS n_rows FROM positions
UNION ALL SELECT 'update_positions', 'gold.cot_z_weekly', count(DISTINCT strftime(report_date, '%G-%V')), count(*)::BIGINT FROM positions""")
def i12(t):
    lake = new_lake(t)
    jobs.update_positions(lake, positions(t), "2026-02-01")
    return jobs.runs(lake).groupBy("job", "dataset").agg(
        F.count(F.lit(1)).alias("n_partitions"), F.sum("row_count").alias("n_rows")
    )


# --- raw deliveries -------------------------------------------------------------------

DELIVERED = """delivered AS (
  SELECT CASE WHEN month(period) = 2 THEN 'Feb' ELSE strftime(period, '%Y-%m-%d') END AS period, CASE WHEN v = 7 THEN ' ' ELSE series_id END AS series_id,
    CASE WHEN (month(period) + v) % 5 = 0 THEN '.' ELSE CAST(n AS VARCHAR) END AS value
  FROM (SELECT l_returnflag AS series_id, last_day(l_shipdate) AS period, l_linenumber AS v, count(*) AS n FROM lineitem GROUP BY 1, 2, 3))"""


def delivered_releases(t):
    """Releases as a vendor's text, with unreadable periods, blank series and missing values."""
    rows = t.lineitem.groupBy(F.col("l_returnflag").alias("series_id"), F.last_day("l_shipdate").alias("period"), F.col("l_linenumber").alias("v")).agg(
        F.count(F.lit(1)).alias("n"))
    return rows.select(
        F.when(F.month("period") == 2, F.lit("Feb")).otherwise(F.date_format("period", "yyyy-MM-dd")).alias("period"),
        F.when(F.col("v") == 7, F.lit(" ")).otherwise(F.col("series_id")).alias("series_id"),
        F.when((F.month("period") + F.col("v")) % 5 == 0, F.lit(".")).otherwise(F.col("n").cast("string")).alias("value"))


@query("q6_n3_rejected_rows", with_(DELIVERED) + """,
judged AS (SELECT *, concat_ws(',', CASE WHEN period = 'Feb' THEN 'period' END, CASE WHEN series_id = ' ' THEN 'series' END, CASE WHEN value = '.' THEN 'value' END) AS reasons FROM delivered)
SELECT period, series_id, value, reasons, count(*) AS n FROM judged WHERE reasons <> '' GROUP BY ALL""")
def q6_rejected(t):
    """Rows of a raw delivery that are set aside, with every rule they fail."""
    source = ingest.SOURCES["macro"]
    settings = ingest.Settings(N.mapping_table(t.spark))
    _, rejected, _ = expectations.split(source.shape(delivered_releases(t)), source.rules(settings))
    return rejected.withColumn("reasons", F.array_join(expectations.REASONS, ",")).groupBy("period", "series_id", "value", "reasons").agg(F.count(F.lit(1)).alias("n"))


MONTHLY = "monthly AS (SELECT l_returnflag AS s, last_day(l_shipdate) AS period, count(*)::DOUBLE AS v FROM lineitem GROUP BY 1, 2)"


@query("i7_s6_raw_macro_to_gold", with_(MONTHLY) + """,
months AS (SELECT last_day(m) AS month_end FROM generate_series((SELECT min(date_trunc('month', period)) FROM monthly), TIMESTAMP '2002-03-01', INTERVAL 1 MONTH) g(m)),
known AS (SELECT month_end, s, arg_max(v, period) AS v FROM months JOIN monthly ON last_day(CAST(period + INTERVAL 1 DAY AS DATE)) <= month_end GROUP BY 1, 2)
SELECT month_end, """ + ", ".join(f"max(v) FILTER (s = '{s}') AS \"{s}\", max('2002-03-15') FILTER (s = '{s}') AS \"{s}__vintage_id\"" for s in "ANR") + """
FROM known GROUP BY month_end""")
def i7_raw(t):
    """Two raw deliveries to gold: the first one wrong for early periods, the second with unreadable rows among the right ones."""
    lake = new_lake(t)
    rows = t.lineitem.groupBy(F.col("l_returnflag").alias("series_id"), F.last_day("l_shipdate").alias("period")).agg(F.count(F.lit(1)).alias("n"))
    text = rows.select(F.date_format("period", "yyyy-MM-dd").alias("period"), "series_id", F.col("n").cast("string").alias("value"))
    junk = text.select(F.lit("n/a").alias("period"), "series_id", "value").unionByName(text.withColumn("value", F.lit(".")))
    settings = ingest.Settings(N.mapping_table(t.spark), critical=["A", "N", "R"])
    early = text.where("period < '1997-01-01'").withColumn("value", F.concat("value", F.lit("1")))
    ingest.ingest(lake, "macro", early, "fred", "2001-01-10", ingest.Settings(N.mapping_table(t.spark)))
    ingest.ingest(lake, "macro", text.unionByName(junk), "fred", "2002-03-15", settings)
    return lake.load("macro_asof_monthly")
