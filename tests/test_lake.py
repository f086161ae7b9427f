import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelloom.operators import incremental as I
from panelloom.operators.quality import ValidationError
from panelloom.plans import jobs
from panelloom.session import scratch_path, shared_dir
from panelloom.sources import files
from panelloom.sources.lake import Lake, expired, retention_cutoff

D = dt.date
RETURN_SCHEMA = "dt date, instrument string, return double, px_t double, px_t_1 double"


@pytest.fixture
def lake(spark):
    return Lake(spark, scratch_path(spark, "lake"))


def returns(spark, *days):
    rows = []
    for d in days:
        rows += [(d, "SP500", 0.01, 101.0, 100.0), (d, "US10Y", -0.01, 99.0, 100.0)]
    return spark.createDataFrame(rows, RETURN_SCHEMA)


def test_round_trip_latest_and_idempotent_upsert(spark, lake):
    frame = returns(spark, D(2026, 1, 2), D(2026, 1, 3))
    for _ in range(2):
        lake.upsert("returns_daily", frame)
    out = lake.load("returns_daily")
    assert out.count() == 4 and out.columns == ["dt", "instrument", "return", "px_t", "px_t_1"]
    assert dict(out.dtypes)["dt"] == "date"
    assert lake.latest("returns_daily") == "dt=2026-01-03"
    assert lake.load("returns_daily", "2026-01-03", "2026-01-03").count() == 2


def test_upsert_replaces_and_keeps(spark, lake):
    lake.upsert("returns_daily", returns(spark, D(2026, 1, 2)))
    new = spark.createDataFrame([(D(2026, 1, 2), "SP500", 0.5, 1.0, 1.0), (D(2026, 1, 2), "OIL", 0.2, 1.0, 1.0)], RETURN_SCHEMA)
    lake.upsert("returns_daily", new)
    got = {r["instrument"]: r["return"] for r in lake.load("returns_daily").collect()}
    assert got == {"SP500": 0.5, "US10Y": -0.01, "OIL": 0.2}
    with pytest.raises(ValidationError):
        lake.upsert("returns_daily", new.union(new))


def test_bad_type_is_rejected(spark, lake):
    text = spark.createDataFrame([(D(2026, 1, 2), "SP500", "bad", 1.0, 1.0)], "dt date, instrument string, return string, px_t double, px_t_1 double")
    with pytest.raises(PySparkException):
        lake.replace("returns_daily", text)


def test_missing_dataset_is_empty(lake):
    assert lake.load("policy_features").count() == 0
    assert lake.latest("policy_features") is None
    assert lake.partitions("policy_features").count() == 0


def test_partition_filters_reach_the_scan(spark, lake):
    lake.replace("returns_daily", returns(spark, D(2026, 1, 2), D(2026, 1, 3)))
    plan = lake.load("returns_daily", "2026-01-03", None, ["instrument", "return"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan
    assert "px_t" not in plan.split("ReadSchema")[1]


def test_prune(spark, lake):
    lake.replace("returns_daily", returns(spark, D(2025, 1, 1), D(2026, 1, 1), D(2026, 1, 2)))
    with pytest.raises(ValueError):
        lake.prune("returns_daily", "gold", older_than="2026-01-01")
    dropped = lake.prune("returns_daily", "gold", older_than="2026-01-01", keep_last=1, force=True)
    assert dropped == ["dt=2025-01-01"]
    assert lake.partitions("returns_daily").count() == 2
    with pytest.raises(ValueError):
        expired(lake.partitions("returns_daily"), None, None)


@pytest.mark.parametrize("text, days", [("180d", 180), ("12w", 84), ("6m", 180), ("2y", 730)])
def test_retention_ages(text, days):
    assert retention_cutoff(text, D(2026, 1, 31)) == D(2026, 1, 31) - dt.timedelta(days=days)


def test_fingerprint_ignores_order_and_sees_changes(spark):
    rows = [("p", 1, 0.1, None), ("p", 2, 0.2, "x"), ("q", 1, 0.1, None)]
    schema = "part string, id int, v double, s string"
    one = I.fingerprints(spark.createDataFrame(rows, schema), "part")
    two = I.fingerprints(spark.createDataFrame(rows[::-1], schema).repartition(3), "part")
    key = lambda f: {r["partition"]: r["fingerprint"] for r in f.collect()}
    assert key(one) == key(two)
    rows[1] = ("p", 2, 0.2000001, "x")
    three = key(I.fingerprints(spark.createDataFrame(rows, schema), "part"))
    assert three["p"] != key(one)["p"] and three["q"] == key(one)["q"]
    twice = key(I.fingerprints(spark.createDataFrame(rows + rows, schema), "part"))
    assert twice["q"] != three["q"]


def test_impact_map(spark):
    changed = spark.createDataFrame(
        [("silver.market_prices", "2026-01-30"), ("silver.macro_releases", "2026-02-10"),
         ("silver.cot_weekly", "2024-52"), ("silver.policy_curve", "2026-01-05")], "dataset string, partition string")
    links = spark.createDataFrame([(D(2026, 1, 30), D(2026, 2, 2)), (D(2026, 1, 30), D(2026, 3, 5)), (D(2026, 1, 29), D(2026, 1, 30)), (D(2026, 1, 30), None)], "dt date, next_dt date")
    # Two contracts: one reports every week, one leaves three weeks out.
    reports = spark.createDataFrame(
        [("a", "g", D(2024, 12, 24) + dt.timedelta(days=7 * i)) for i in range(-2, 6)] + [("b", "g", D(2024, 12, 24)), ("b", "g", D(2025, 1, 21)), ("b", "g", D(2025, 1, 28)), ("b", "g", D(2025, 2, 4))],
        "contract string, group string, report_date date")
    releases = spark.createDataFrame([(D(2026, 2, 10), D(2025, 12, 31)), (D(2026, 1, 10), D(2025, 1, 31))], "dt date, period date")
    got = {(r["dataset"], r["partition"]) for r in I.impacted(changed, links, reports, releases, 3).collect()}
    assert got == {
        ("gold.returns_daily", "2026-01-30"), ("gold.returns_daily", "2026-02-02"), ("gold.returns_daily", "2026-03-05"),
        *[("gold.macro_asof_monthly", m) for m in ("2025-12", "2026-01", "2026-02")],
        *[("gold.cot_z_weekly", w) for w in ("2024-52", "2025-01", "2025-02", "2025-04", "2025-05")], ("gold.policy_features", "2026-01-05"),
    }


def test_keep_last_takes_whole_row(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "new"), ("a", 3, None)], "k string, at int, v string")
    assert [tuple(r) for r in I.keep_last(df, ["k"], ["at"]).collect()] == [("a", 3, None)]


def test_version_log_reports_changes_once(spark, lake):
    lake.replace("returns_daily", returns(spark, D(2026, 1, 2), D(2026, 1, 3)))
    versions = jobs.Versions(lake)
    assert versions.record("returns_daily", "gold").count() == 2
    assert versions.record("returns_daily", "gold").count() == 0
    lake.upsert("returns_daily", spark.createDataFrame([(D(2026, 1, 3), "OIL", 0.2, 1.0, 1.0)], RETURN_SCHEMA))
    assert [r["partition"] for r in versions.record("returns_daily", "gold").collect()] == ["2026-01-03"]


PRICE_SCHEMA = "vendor string, dt date, instrument string, px_last double, currency string, source_id string, fetch_ts timestamp"


def prices(spark, rows):
    stamp = dt.datetime(2026, 1, 1)
    return spark.createDataFrame([("v", d, i, p, "USD", i, stamp) for d, i, p in rows], PRICE_SCHEMA)


def test_incremental_equals_full_across_gaps(spark, lake):
    friday, monday, tuesday = D(2026, 1, 2), D(2026, 1, 5), D(2026, 1, 6)
    base = [(friday, "a", 10.0), (monday, "a", 11.0), (tuesday, "a", 12.0), (friday, "b", 5.0), (tuesday, "b", 6.0)]
    jobs.update_prices(lake, prices(spark, base), "2026-01-07")
    rebuilt = jobs.update_prices(lake, prices(spark, [(friday, "a", 20.0), (friday, "b", 4.0)]), "2026-01-08")
    assert {r["partition"] for r in rebuilt.collect()} == {"2026-01-05", "2026-01-06"}
    full = jobs.gold_returns(lake)
    got = {(r["dt"], r["instrument"]): round(r["return"], 9) for r in lake.load("returns_daily").collect()}
    assert got == {(r["dt"], r["instrument"]): round(r["return"], 9) for r in full.collect()}
    assert got[(monday, "a")] == round(11 / 20 - 1, 9) and got[(tuesday, "b")] == 0.5
    assert jobs.update_prices(lake, prices(spark, [(friday, "a", 20.0)]), "2026-01-09").count() == 0
    # The third run changed nothing and still leaves its record.
    assert jobs.runs(lake).select("run_id").distinct().count() == 3


def test_backfill_checks_range(lake):
    with pytest.raises(ValueError):
        jobs.backfill(lake, [], None, "2026-02-01", "2026-01-01")
    assert jobs.pack_id("2026-02-01") == "20260201_v1"


def test_named_and_positional_reports(spark):
    legacy = scratch_path(spark, "legacy")
    spark.createDataFrame(
        [("GOLD", "2026-01-06", "10", "4", "20")],
        "Market_and_Exchange_Names string, `Report_Date_as_YYYY-MM-DD` string, Noncommercial_Positions_Long_All string, "
        "Noncommercial_Positions_Short_All string, Open_Interest_All string",
    ).write.option("header", True).csv(legacy)
    row = files.read_positions(spark, legacy).first()
    assert row["Noncommercial_Positions_Long_All"] == "10"
    assert len(files.REPORT_COLUMNS) == 87


def test_shared_dir_reads_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
