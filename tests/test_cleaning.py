import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelloom.functions import scalars as S
from panelloom.operators import normalize as N
from panelloom.operators import positioning, quality
from panelloom.schemas import dataset

D = dt.date


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text, want", [("1.5", 1.5), (".", None), ("NaN", None), ("Infinity", None), (None, None)])
def test_numbers_are_lenient(spark, text, want):
    assert one(spark, S.to_number(F.lit(text).cast("string"))) == want


def test_clip_keeps_null(spark):
    assert one(spark, S.clip(F.lit(None).cast("double"), 0.0, 1.0)) is None
    assert one(spark, S.clip(F.lit(7.0), 0.0, 1.0)) == 1.0


@pytest.mark.parametrize("day, iso, monday, thursday", [
    ("2024-12-30", "2025-01", D(2024, 12, 30), D(2025, 1, 2)),
    ("2021-01-01", "2020-53", D(2020, 12, 28), D(2020, 12, 31)),
    ("2023-06-14", "2023-24", D(2023, 6, 12), D(2023, 6, 15)),
])
def test_iso_weeks(spark, day, iso, monday, thursday):
    key = S.iso_week_key(F.lit(day).cast("date"))
    assert one(spark, key) == iso
    assert one(spark, S.iso_week_monday(key)) == monday
    assert one(spark, S.iso_week_thursday(key)) == thursday


@pytest.mark.parametrize("day", ["2022-01-01", "2022-01-03", "2023-12-31", "2024-02-29", "2026-01-01"])
def test_monday_weeks_match_strftime(spark, day):
    assert one(spark, S.monday_week_key(F.lit(day).cast("date"))) == D.fromisoformat(day).strftime("%Y-%W")


def test_cut_probability_saturates(spark):
    assert one(spark, S.cut_probability(F.lit(1e5), F.lit(0.0))) == 0.0
    assert one(spark, S.cut_probability(F.lit(0.0), F.lit(0.0))) == 0.5


def test_prices_long_wide_and_empty(spark):
    mapping = N.mapping_table(spark)
    stamp = F.lit("2026-01-01 00:00:00").cast("timestamp")
    long = spark.createDataFrame(
        [("2026-01-02", "SP500", "101.5"), ("2026-01-02", "DGS2", "."), ("soon", "SP500", "1")], "dt string, ticker string, px_last string"
    )
    out = N.canonical_prices(long, "fred", mapping, stamp).collect()
    assert [(r["instrument"], r["px_last"], r["source_id"]) for r in out] == [("SPX_US", 101.5, "SP500")]
    wide = spark.createDataFrame([("2026-01-02", 1.0, 2.0)], "Date string, SP500 double, Other double")
    out = N.canonical_prices(wide, "fred", mapping, stamp)
    assert {(r["instrument"], r["px_last"]) for r in out.collect()} == {("SPX_US", 1.0), ("Other", 2.0)}
    empty = N.canonical_prices(wide.limit(0), "fred", mapping, stamp)
    assert empty.columns == dataset("market_prices").columns and empty.count() == 0


def test_wide_macro_and_default_columns(spark):
    wide = spark.createDataFrame([("2026-01-15", 3.0, None)], "period string, PAYEMS double, INDPRO double")
    row = N.canonical_macro(wide, "fred", N.mapping_table(spark), "2026-02-01", "v").collect()
    assert len(row) == 1 and row[0]["series_id"] == "PAYROLLS_US" and row[0]["period"] == D(2026, 1, 31)
    assert row[0]["unit"] == "index" and row[0]["release_date"] is None


def test_wide_net_positions_split_by_sign(spark):
    raw = spark.createDataFrame([("2026-01-06", 5.0, -3.0)], "date string, gold_net double, oil_net double")
    out = {r["contract"]: (r["net_pos"], r["long"], r["short"], r["open_interest"]) for r in N.canonical_positions(raw, "2026-01-07").collect()}
    assert out == {"GOLD": (5, 5, 0, 5), "OIL": (-3, 0, 3, 3)}


def test_last_pattern_wins_and_unmatched_drop(spark):
    df = spark.createDataFrame([("UST 10Y NOTE - CBOT",), ("ust 10y note ultra",), ("CORN",)], "contract string")
    out = positioning.map_contracts(df, [("ust 10y", "BONDS"), ("ULTRA", "ULTRAS")]).collect()
    assert [r["contract"] for r in out] == ["BONDS", "ULTRAS"]


def test_strict_types_raise(spark):
    df = spark.createDataFrame([("x",)], "v string")
    with pytest.raises(PySparkException):
        N.strict_types(df, {"v": "float64"}).collect()


def test_schema_checks(spark):
    df = spark.createDataFrame([(1,)], "dt int")
    with pytest.raises(quality.ValidationError):
        quality.require_columns(df, dataset("returns_daily"))
    open_frame = spark.createDataFrame([(1, 2.0)], "month_end int, CPI double")
    quality.require_columns(open_frame, dataset("macro_asof_monthly"), reject_extra=True)
    extra = spark.createDataFrame([], "dt date, instrument string, return double, px_t double, px_t_1 double, x int")
    with pytest.raises(quality.ValidationError):
        quality.require_columns(extra, dataset("returns_daily"), reject_extra=True)


def test_critical_series_threshold(spark):
    present = spark.createDataFrame([("CPI_US",), ("INDPRO_US",)], "series_id string")
    critical = spark.createDataFrame([(s,) for s in ("CPI_US", "INDPRO_US", "PAYROLLS_US")], "series_id string")
    with pytest.raises(quality.ValidationError):
        quality.check_critical(present, critical, 0)
    quality.check_critical(present, critical, quality.critical_threshold("fred", from_file=False))
    assert quality.critical_threshold("fred", from_file=True) == 0


def test_zone_and_template_checks(spark):
    with pytest.raises(quality.ValidationError):
        quality.require_zoned(spark.sql("select timestamp_ntz '2024-01-01 00:00:00' as t"), "t")
    quality.require_zoned(spark.sql("select timestamp '2024-01-01 00:00:00' as t"), "t")
    dates = spark.createDataFrame([("2024-02-30",), ("2024-02-29",), ("2024-2-9",), (None,)], "Date string")
    assert quality.bad_template_dates(dates).count() == 3


def test_out_of_order_rows(spark):
    rows = [(0, D(2024, 1, 1)), (1, D(2024, 1, 3)), (2, D(2024, 1, 2)), (3, D(2024, 1, 2))]
    bad = quality.out_of_order(spark.createDataFrame(rows, "seq int, dt date"), "seq").collect()
    assert [r["seq"] for r in bad] == [2]
