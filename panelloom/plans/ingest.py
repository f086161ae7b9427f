"""From a raw delivery to gold in one job: land it as it came, set bad rows aside, canonicalise, update; and the same again from bronze."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions import scalars as S
from panelloom.operators import expectations, incremental, normalize, positioning, quality
from panelloom.plans import jobs
from panelloom.schemas import dataset
from panelloom.sources.lake import Lake


@dataclass(frozen=True)
class Settings:
    """What the deliveries of one lake are read with."""

    mapping: DataFrame
    contracts: Sequence[tuple[str, str]] = tuple(normalize.CONTRACT_PATTERNS)
    critical: Sequence[str] = ()
    lags: dict[str, str] | None = None
    lookback: int = jobs.LOOKBACK_WEEKS
    from_file: bool = True
    missing_allowed: int = 0


@dataclass(frozen=True)
class Source:
    """How one kind of delivery is read: its long form, the rules its rows must meet, its silver rows and its update job."""

    name: str
    shape: Callable[[DataFrame], DataFrame]
    rules: Callable[[Settings], dict[str, Column]]
    canonical: Callable[[DataFrame, str, str, Settings], DataFrame]
    update: Callable[..., DataFrame]
    options: Callable[[Settings], dict] = field(default=lambda s: {})


def _long_prices(raw: DataFrame) -> DataFrame:
    if {"dt", "ticker", "px_last"} <= set(raw.columns):
        return raw
    return normalize.melt(raw, raw.columns[0]).withColumnRenamed(raw.columns[0], "dt")


def _long_macro(raw: DataFrame) -> DataFrame:
    raw = normalize.macro_shape(raw)
    if {"period", "series_id", "value"} <= set(raw.columns):
        return raw
    return normalize.melt(raw, raw.columns[0], "series_id", "value").withColumnRenamed(raw.columns[0], "period")


def _long_positions(raw: DataFrame) -> DataFrame:
    raw = raw.withColumnsRenamed(normalize.LEGACY_POSITION_NAMES)
    return normalize.wide_net_positions(raw) if "report_date" not in raw.columns and "date" in raw.columns else raw


def _named(column: str) -> Column:
    return F.trim(F.col(column).cast("string")) != ""


def _number(column: str) -> Column:
    return S.to_number(F.col(column).cast("string")).isNotNull()


def _day(column: str) -> Column:
    return S.to_day(F.col(column)).isNotNull()


def _has_contract(s: Settings) -> Column:
    known = [F.contains(F.upper(F.col("contract")), F.lit(p.upper())) for p, _ in s.contracts]
    out = F.lit(False)
    for hit in known:
        out = out | hit
    return out


SOURCES = {s.name: s for s in (
    Source("prices", _long_prices, lambda s: {"date": _day("dt"), "ticker": _named("ticker"), "price": _number("px_last")},
           lambda raw, vendor, date, s: normalize.canonical_prices(raw, vendor, s.mapping, F.lit(date).cast("timestamp")), jobs.update_prices),
    Source("macro", _long_macro, lambda s: {"period": _day("period"), "series": _named("series_id"), "value": _number("value")},
           lambda raw, vendor, date, s: normalize.canonical_macro(raw, vendor, s.mapping, date, date), jobs.update_macro, lambda s: {"lags": s.lags}),
    Source("cot", _long_positions, lambda s: {"date": _day("report_date"), "contract": _has_contract(s), "long": _number("long"), "short": _number("short")},
           lambda raw, vendor, date, s: positioning.map_contracts(normalize.canonical_positions(raw, date), s.contracts),
           jobs.update_positions, lambda s: {"lookback": s.lookback}),
    Source("policy", lambda raw: raw, lambda s: {"date": _day("dt"), "tenor": _number("tenor_days"), "rate": _number("implied_rate")},
           lambda raw, vendor, date, s: normalize.canonical_policy(
               raw.withColumns({"tenor_days": S.to_whole(F.col("tenor_days")), "implied_rate": S.to_number(F.col("implied_rate").cast("string"))}), S.to_day(F.col("dt")), vendor),
           jobs.update_policy),
)}


def raw_name(kind: str) -> str:
    return f"{kind}_raw"


def rejected_name(kind: str) -> str:
    return f"{kind}_rejected"


def ingest(lake: Lake, kind: str, raw: DataFrame, vendor: str, run_date: str, settings: Settings) -> DataFrame:
    """Land a delivery, then bring it to gold; returns the rebuilt gold partitions.

    Rows that fail a rule are kept below bronze with their reasons, and their numbers are warnings in the run's lineage.
    A delivery without enough of the critical series is landed and recorded with its error, and goes no further.
    """
    return _from_bronze(lake, lake, kind, jobs.landed(lake, raw_name(kind), raw, run_date, vendor), vendor, run_date, settings)


def _from_bronze(kept: Lake, lake: Lake, kind: str, raw: DataFrame, vendor: str, run_date: str, settings: Settings) -> DataFrame:
    source, started = SOURCES[kind], jobs.now()
    good, rejected, counts = expectations.split(source.shape(raw), source.rules(settings))
    lake.land(rejected_name(kind), rejected.select([F.col(c).cast("string").alias(c) for c in rejected.columns if c != expectations.REASONS] + [F.col(expectations.REASONS).alias("reasons")]), run_date, vendor)
    warnings = [f"{name}: {n} of {counts['rows']} rows" for name, n in counts.items() if name.startswith("failed ") and n]
    canonical = source.canonical(good, vendor, run_date, settings)
    if kind == "macro" and settings.critical:
        critical = lake.spark.createDataFrame([(c,) for c in settings.critical], "series_id string")
        try:
            quality.check_critical(canonical, critical, quality.critical_threshold(vendor, settings.from_file, settings.missing_allowed))
        except quality.ValidationError as error:
            jobs.record_run(lake, f"update_{kind}", run_date, started, raw_name(kind), lake.spark.createDataFrame([], incremental.VERSION_SCHEMA), [str(error)], warnings)
            raise
    return source.update(lake, canonical, run_date, delivery=raw_name(kind), warnings=warnings, **source.options(settings))


def deliveries(lake: Lake, kind: str, start: str | None = None, end: str | None = None) -> list[tuple[str, str]]:
    """(ingest date, vendor) of the landed deliveries, in the order they came, from folder names."""
    days = lake.folders_below(f"bronze/{raw_name(kind)}", "ingest_date")
    chosen = sorted(d for d in days if (start is None or d >= start) and (end is None or d <= end))
    return [(d, v) for d in chosen for v in sorted(lake.folders_below(f"bronze/{raw_name(kind)}/ingest_date={d}", "batch"))]


def replay(lake: Lake, into: Lake, settings: Settings, kinds: Sequence[str] = tuple(SOURCES), start: str | None = None, end: str | None = None) -> int:
    """Run the landed deliveries of a date range again, oldest first, into a lake; returns how many there were.

    Into an empty lake this gives the same silver and gold; into the lake itself it is the backfill of all jobs.
    """
    if start is not None and end is not None and start > end:
        raise ValueError(f"replay start {start} lies after its end {end}")
    done = 0
    for kind in kinds:
        for day, vendor in deliveries(lake, kind, start, end):
            raw = lake.spark.read.parquet(f"{lake.root}/bronze/{raw_name(kind)}/ingest_date={day}/batch={vendor}")
            _from_bronze(lake, into, kind, raw, vendor, day, settings)
            done += 1
    return done


def macro_start(lake: Lake) -> str:
    """The day from which releases are fetched next: a month before the latest ingest day, to catch revisions."""
    latest = lake.partitions("macro_releases", "silver").agg(F.max("key").alias("key"))
    return latest.select(incremental.releases_start(F.col("key")).cast("string")).first()[0]


def same_partitions(one: Lake, other: Lake, names: Sequence[str]) -> DataFrame:
    """(dataset, n_partitions, n_same): partitions of two lakes with equal fingerprints."""
    out = None
    for name in names:
        spec = dataset(name)
        prints = [incremental.fingerprints(x.scan(name, spec.level), spec.partition).select("partition", F.col("fingerprint").alias(f)) for x, f in ((one, "a"), (other, "b"))]
        part = prints[0].join(prints[1], "partition", "full_outer").agg(
            F.count(F.lit(1)).alias("n_partitions"), F.count_if(F.col("a") == F.col("b")).alias("n_same")).select(F.lit(name).alias("dataset"), "n_partitions", "n_same")
        out = part if out is None else out.unionByName(part)
    return out
