"""Raw vendor frames to typed silver rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions import scalars as S

# The vendor symbols and series ids of the default mapping.
INSTRUMENT_IDS = [
    ("fred", "SP500", "SPX_US"),
    ("polygon", "I:SPX", "SPX_US"),
    ("fred", "DGS2", "US2Y_US"),
    ("fred", "DGS10", "US10Y_US"),
    ("fred", "DEXUSEU", "EURUSD_FX"),
]
SERIES_IDS = [
    ("CPIAUCSL", "CPI_US"),
    ("CPILFESL", "CORE_CPI_US"),
    ("PAYEMS", "PAYROLLS_US"),
    ("INDPRO", "INDPRO_US"),
]
CONTRACT_PATTERNS = [("UST 10Y NOTE", "UST_BONDS")]
CRITICAL_SERIES = [internal for _, internal in SERIES_IDS]

# Column names of the positioning report in its older layout.
LEGACY_POSITION_NAMES = {
    "Market_and_Exchange_Names": "contract",
    "Report_Date_as_YYYY-MM-DD": "report_date",
    "Noncommercial_Positions_Long_All": "long",
    "Noncommercial_Positions_Short_All": "short",
    "Open_Interest_All": "open_interest",
}
NONCOMMERCIAL_BUCKETS = ("Asset_Mgr", "Lev_Money", "Other_Rept")


def mapping_table(spark, instruments=None, series=None) -> DataFrame:
    """(vendor, ticker, internal_id); a NULL vendor applies to every vendor."""
    rows = list(instruments or INSTRUMENT_IDS)
    rows += [(None, ticker, internal) for ticker, internal in (series or SERIES_IDS)]
    return spark.createDataFrame(rows, "vendor string, ticker string, internal_id string")


def map_tickers(
    df: DataFrame, mapping: DataFrame, ticker: str = "ticker", vendor: str = "vendor", out: str = "internal_id"
) -> DataFrame:
    """Vendor-specific id first, then the any-vendor id, else the ticker itself.

    The mapping is joined without a hint: Spark broadcasts it while its measured
    size is below the threshold and shuffles otherwise.
    """
    exact = mapping.where("vendor is not null").groupBy("vendor", "ticker").agg(
        F.min("internal_id").alias("_exact")
    ).withColumnsRenamed({"vendor": vendor, "ticker": ticker})
    general = mapping.where("vendor is null").groupBy("ticker").agg(
        F.min("internal_id").alias("_general")
    ).withColumnRenamed("ticker", ticker)
    joined = df.join(exact, [vendor, ticker], "left").join(general, ticker, "left")
    return joined.withColumn(out, F.coalesce("_exact", "_general", F.col(ticker))).drop("_exact", "_general")


def unmapped_tickers(df: DataFrame, mapping: DataFrame, ticker: str = "ticker", vendor: str = "vendor") -> DataFrame:
    """Strict mode: tickers without any id (must be empty)."""
    seen = df.select(vendor, ticker).distinct()
    exact = mapping.where("vendor is not null").select(F.col("vendor").alias(vendor), F.col("ticker").alias(ticker))
    general = mapping.where("vendor is null").select(F.col("ticker").alias(ticker))
    return seen.join(exact, [vendor, ticker], "left_anti").join(general, ticker, "left_anti")


def melt(df: DataFrame, date: str, name: str = "ticker", value: str = "px_last") -> DataFrame:
    """Wide (date + one column per series) to long."""
    columns = [c for c in df.columns if c != date]
    same_type = [F.col(f"`{c}`").cast("string").alias(c) for c in columns]
    return df.select(date, *same_type).unpivot(date, columns, name, value)


def canonical_prices(
    raw: DataFrame, vendor: str | Column, mapping: DataFrame, fetch_ts: Column, currency: str = "USD"
) -> DataFrame:
    """Long or wide vendor prices to silver market_prices rows."""
    if not raw.columns:
        raw = raw.sparkSession.createDataFrame([], "dt date, ticker string, px_last double")
    if not {"dt", "ticker", "px_last"} <= set(raw.columns):
        date = raw.columns[0]
        raw = melt(raw, date).withColumnRenamed(date, "dt")
    source = vendor if isinstance(vendor, Column) else F.lit(vendor)
    typed = raw.select(
        source.alias("vendor"),
        S.to_day(F.col("dt")).alias("dt"),
        F.col("ticker").cast("string").alias("ticker"),
        S.to_number(F.col("px_last").cast("string")).alias("px_last"),
    )
    mapped = map_tickers(typed, mapping, out="instrument")
    return mapped.select(
        "vendor", "dt", "instrument", "px_last", F.lit(currency).alias("currency"),
        F.col("ticker").alias("source_id"), fetch_ts.alias("fetch_ts"),
    ).dropna(subset=["dt", "instrument", "px_last"])


def macro_shape(raw: DataFrame) -> DataFrame:
    """Accept (period, series_id, value) or the price-like (dt, ticker, px_last)."""
    if {"period", "series_id", "value"} <= set(raw.columns):
        return raw
    if {"dt", "ticker", "px_last"} <= set(raw.columns):
        names = {"dt": "period", "ticker": "series_id", "px_last": "value"}
        return raw.withColumnsRenamed(names).select("period", "series_id", "value")
    return raw


def canonical_macro(raw: DataFrame, vendor: str, mapping: DataFrame, dt_ingest: str, vintage_id: str) -> DataFrame:
    if not {"period", "series_id", "value"} <= set(raw.columns):
        date = raw.columns[0]
        raw = melt(raw, date, "series_id", "value").withColumnRenamed(date, "period")
    has = set(raw.columns)
    released = S.to_day(F.col("release_date")) if "release_date" in has else F.lit(None).cast("date")
    typed = raw.select(
        F.lit(vendor).alias("vendor"),
        F.col("series_id").cast("string").alias("ticker"),
        S.month_end(S.to_day(F.col("period"))).alias("period"),
        released.alias("release_date"),
        S.to_number(F.col("value").cast("string")).alias("value"),
        (F.col("unit") if "unit" in has else F.lit("index")).alias("unit"),
        (F.col("notes") if "notes" in has else F.lit("")).alias("notes"),
    )
    mapped = map_tickers(typed, mapping, out="series_id")
    return mapped.select(
        F.lit(dt_ingest).cast("date").alias("dt_ingest"), "series_id", "period", "release_date",
        "value", "unit", F.col("vendor").alias("source"), F.lit(vintage_id).alias("vintage_id"), "notes",
    ).dropna(subset=["period", "series_id", "value"])


def wide_net_positions(raw: DataFrame, date: str = "date") -> DataFrame:
    """Columns named *_net to one row per contract; the sign splits long and short."""
    nets = [c for c in raw.columns if c.endswith("_net")]
    long = raw.select(date, *[F.col(f"`{c}`").cast("double").alias(c) for c in nets]).unpivot(
        date, nets, "contract", "net"
    )
    net = F.col("net")
    return long.select(
        F.upper(F.replace("contract", F.lit("_net"), F.lit(""))).alias("contract"),
        F.col(date).alias("report_date"),
        S.clip(net, low=0.0).alias("long"),
        S.clip(-net, low=0.0).alias("short"),
        F.abs(net).alias("open_interest"),
    )


def noncommercial(report: DataFrame) -> DataFrame:
    """Sum three trader buckets per side; any unreadable bucket leaves the sum NULL."""

    def side(name: str) -> Column:
        parts = [S.to_number(F.col(f"{b}_Positions_{name}_All").cast("string")) for b in NONCOMMERCIAL_BUCKETS]
        return parts[0] + parts[1] + parts[2]

    return report.select(
        "Market_and_Exchange_Names",
        "`Report_Date_as_YYYY-MM-DD`",
        side("Long").alias("Noncommercial_Positions_Long_All"),
        side("Short").alias("Noncommercial_Positions_Short_All"),
        S.to_number(F.col("Open_Interest_All").cast("string")).alias("Open_Interest_All"),
    ).dropna(subset=["Market_and_Exchange_Names", "`Report_Date_as_YYYY-MM-DD`"])


def canonical_positions(raw: DataFrame, dt_ingest: str) -> DataFrame:
    """Any accepted layout to silver cot_weekly rows."""
    frame = raw.withColumnsRenamed(LEGACY_POSITION_NAMES)
    if "report_date" not in frame.columns and "date" in frame.columns:
        frame = wide_net_positions(frame)
    group = F.col("group") if "group" in frame.columns else F.lit("noncommercial")
    sizes = {c: S.to_whole(F.col(c)) for c in ("long", "short", "open_interest")}
    typed = frame.select(
        F.lit(dt_ingest).cast("date").alias("dt_ingest"),
        S.to_day(F.col("report_date")).alias("report_date"),
        F.col("contract").cast("string").alias("contract"),
        group.alias("group"),
        *[value.alias(name) for name, value in sizes.items()],
    ).withColumn("net_pos", F.col("long") - F.col("short"))
    columns = ["dt_ingest", "report_date", "contract", "group", "net_pos", "long", "short", "open_interest"]
    return typed.select(*columns).dropna(subset=["report_date", "contract", "group", "net_pos"])


def canonical_policy(raw: DataFrame, dt: str | Column, source: str = "ois") -> DataFrame:
    missing = {"tenor_days", "implied_rate"} - set(raw.columns)
    if missing:
        raise ValueError(f"missing policy columns: {sorted(missing)}")
    day = dt if isinstance(dt, Column) else F.lit(dt).cast("date")
    return raw.select(day.alias("dt"), "tenor_days", "implied_rate", F.lit(source).alias("source"))


def time_split(df: DataFrame, train_end: str, date: str = "dt") -> tuple[DataFrame, DataFrame]:
    """Rows up to and including the cut day, and the rows after it."""
    cut = F.lit(train_end).cast("date")
    return df.where(F.col(date) <= cut), df.where(F.col(date) > cut)


def between(df: DataFrame, column: str, kind: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Inclusive range on a date, ISO week or month column.

    Dates are compared as they are, so the filter reaches the scan.
    """
    day = S.partition_day(F.col(column), kind) if kind in ("week", "month") else F.col(column)
    if start is not None:
        df = df.where(day >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(day <= F.lit(end).cast("date"))
    return df


def partition_column(kind: str, date: Column) -> Column:
    keys = {"dt": S.day_key, "week": S.iso_week_key, "month": S.month_key}
    if kind not in keys:
        raise ValueError(f"unknown partition kind {kind!r}")
    return keys[kind](date)


def strict_types(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Cast to the declared types; an unreadable value is an error, NULL stays NULL."""
    names = {"string": "string", "float64": "double", "int64": "bigint", "date": "date", "timestamp": "timestamp"}
    casts = []
    for column in df.columns:
        if column not in kinds:
            casts.append(F.col(f"`{column}`"))
            continue
        target = names[kinds[column]]
        lenient = F.col(column).try_cast(target)
        failed = F.col(column).isNotNull() & lenient.isNull()
        message = F.concat(F.lit(f"column {column} is not {target}: "), F.col(column).cast("string"))
        casts.append(F.when(failed, F.raise_error(message).cast(target)).otherwise(lenient).alias(column))
    return df.select(*casts)
