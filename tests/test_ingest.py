"""Raw deliveries: rejected rows, warnings, errors, and the same lake again from bronze."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelloom.operators import expectations
from panelloom.operators.normalize import mapping_table
from panelloom.operators.quality import ValidationError
from panelloom.plans import ingest, jobs
from panelloom.sources.lake import Lake


@pytest.fixture
def settings(spark):
    return ingest.Settings(mapping_table(spark), contracts=[("GOLD", "GOLD_CMX"), ("CRUDE", "OIL")], critical=["CPI_US"], lookback=4)


@pytest.fixture
def lake(spark, tmp_path):
    return Lake(spark, str(tmp_path / "lake"))


def prices(spark, rows):
    return spark.createDataFrame(rows, "dt string, ticker string, px_last string")


def test_every_failed_rule_is_named(spark):
    df = spark.createDataFrame([(1, "a", None), (None, "", None), (3, "b", 1.0)], "x int, name string, _v double")
    rules = {"x": F.col("x") > 0, "name": F.col("name") != "", "v": F.col("_v").isNotNull()}
    good, bad, counts = expectations.split(df, rules)
    assert [tuple(r) for r in good.collect()] == [(3, "b", 1.0)]
    assert sorted(map(tuple, bad.select("x", expectations.REASONS).collect()), key=repr) == [(1, ["v"]), (None, ["x", "name", "v"])]
    assert counts == {"rows": 3, "rejected": 2, "failed x": 1, "failed name": 1, "failed v": 2}
    none, _, counts = expectations.split(df.limit(0), rules)
    assert none.count() == 0 and counts["rows"] == 0


def test_rejected_rows_are_kept_and_counted(spark, lake, settings):
    rows = [("2026-01-02", "SP500", "100"), ("2026-01-05", "SP500", "110"), ("bad", "SP500", "1"), ("2026-01-05", "DGS2", "."), (None, " ", None)]
    ingest.ingest(lake, "prices", prices(spark, rows), "fred", "2026-01-06", settings)
    assert [(r["instrument"], round(r["return"], 9)) for r in lake.load("returns_daily").collect()] == [("SPX_US", 0.1)]
    kept = spark.read.parquet(f"{lake.root}/bronze/prices_rejected").collect()
    assert sorted((r["dt"] or "", r["ticker"], tuple(r["reasons"])) for r in kept) == [
        ("", " ", ("date", "ticker", "price")), ("2026-01-05", "DGS2", ("price",)), ("bad", "SP500", ("date",))]
    run = jobs.runs(lake).first()
    assert run["warnings"] == ["failed date: 2 of 5 rows", "failed ticker: 1 of 5 rows", "failed price: 2 of 5 rows"] and run["input"].endswith("bronze/prices_raw")
    assert spark.read.parquet(f"{lake.root}/bronze/prices_raw").count() == 5


def test_missing_critical_series_stop_the_job(spark, lake, settings):
    raw = spark.createDataFrame([("2026-01-31", "PAYEMS", "1")], "period string, series_id string, value string")
    with pytest.raises(ValidationError):
        ingest.ingest(lake, "macro", raw, "fred", "2026-02-01", settings)
    assert lake.load("macro_releases").count() == 0
    run = jobs.runs(lake).first()
    assert run["errors"] == ["critical series missing: 1 > 0"] and run["partition"] is None
    assert ingest.macro_start(lake) == "2010-01-01"
    ingest.ingest(lake, "macro", raw.withColumn("series_id", F.lit("CPIAUCSL")), "fred", "2026-02-10", settings)
    assert ingest.macro_start(lake) == "2026-01-10"


def test_replay_gives_the_same_lake(spark, lake, settings, tmp_path):
    ingest.ingest(lake, "prices", prices(spark, [("2026-01-02", "SP500", "100"), ("2026-01-05", "SP500", "110")]), "fred", "2026-01-06", settings)
    ingest.ingest(lake, "prices", prices(spark, [("2026-01-02", "SP500", "50"), ("2026-01-07", "SP500", "x"), ("2026-01-08", "I:SPX", "7")]), "polygon", "2026-01-08", settings)
    macro = spark.createDataFrame([("2025-11-30", "CPIAUCSL", "3"), ("2025-12-31", "CPIAUCSL", "4")], "period string, series_id string, value string")
    ingest.ingest(lake, "macro", macro, "fred", "2026-01-08", settings)
    cot = spark.createDataFrame([(f"2025-{m:02d}-03", "GOLD - COMEX", str(m * m), "1", "9") for m in range(1, 9)] + [("2025-01-03", "WHEAT", "1", "1", "1")],
                                "report_date string, contract string, long string, short string, open_interest string")
    ingest.ingest(lake, "cot", cot, "cftc", "2026-01-08", settings)
    curve = spark.createDataFrame([("2026-01-05", n, r) for n, r in (("30", "0.05"), ("90", "0.04"), ("180", "0.03"), ("365", "0.02"), ("x", "0.01"))], "dt string, tenor_days string, implied_rate string")
    ingest.ingest(lake, "policy", curve, "ois", "2026-01-08", settings)
    again = Lake(spark, str(tmp_path / "again"))
    assert ingest.replay(lake, again, settings) == 5
    names = ["market_prices", "returns_daily", "macro_releases", "macro_asof_monthly", "cot_weekly", "cot_z_weekly", "policy_curve", "policy_features"]
    found = {r["dataset"]: (r["n_partitions"], r["n_same"]) for r in ingest.same_partitions(lake, again, names).collect()}
    assert set(found) == set(names) and all(n == same > 0 for n, same in found.values()), found
    assert ingest.deliveries(lake, "prices", start="2026-01-07") == [("2026-01-08", "polygon")]
    with pytest.raises(ValueError):
        ingest.replay(lake, again, settings, start="2026-02-01", end="2026-01-01")


def test_wide_deliveries(spark, lake, settings):
    wide = spark.createDataFrame([("2026-01-02", "100", "4.0"), ("2026-01-05", "110", "")], "Date string, SP500 string, DGS2 string")
    ingest.ingest(lake, "prices", wide, "fred", "2026-01-06", settings)
    assert {(r["instrument"], r["dt"].day) for r in lake.scan("market_prices").collect()} == {("SPX_US", 2), ("SPX_US", 5), ("US2Y_US", 2)}
