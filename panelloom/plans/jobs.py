"""Update jobs: landed frames to silver, changed partitions, rebuilt gold, lineage.

Every job reads its input once into silver by keyed upsert, compares partition
fingerprints with the recorded versions and rebuilds only the gold partitions a
change can reach. Rebuilding from scratch gives the same tables.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions import scalars as S
from panelloom.operators import asof, curve, features, incremental, normalize, positioning, returns
from panelloom.plans import state
from panelloom.schemas import dataset
from panelloom.session import stored
from panelloom.sources.lake import Lake, path_exists

LOOKBACK_WEEKS = 260


class Versions:
    """Append-only log of partition fingerprints below the lake's meta folder."""

    def __init__(self, lake: Lake) -> None:
        self.lake = lake
        self.path = f"{lake.root}/meta/versions"

    def log(self) -> DataFrame:
        spark = self.lake.spark
        if not path_exists(spark, self.path):
            return spark.createDataFrame([], incremental.VERSION_SCHEMA)
        return spark.read.schema(incremental.VERSION_SCHEMA).parquet(self.path)

    def latest(self, name: str, level: str = "silver") -> int:
        """When the dataset was last recorded; 0 if never."""
        return self.log().where(F.col("dataset") == f"{level}.{name}").agg(F.max("written_at")).first()[0] or 0

    def record(self, name: str, level: str, keys: DataFrame | None = None) -> DataFrame:
        """Fingerprint the given (or all) partitions, log them, return the changed ones."""
        spec = dataset(name)
        rows = self.lake.scan(name, level) if keys is None else self.lake.read_keys(name, keys, level)
        label = f"{level}.{name}"
        entries = incremental.fingerprints(rows, spec.partition).select(
            F.lit(label).alias("dataset"), "partition", "fingerprint", "row_count",
            F.lit(self.lake.path(name, level)).alias("path"), F.lit(time.time_ns()).alias("written_at"),
        )
        before = incremental.current_versions(self.log().where(F.col("dataset") == label))
        stamp = time.time_ns()
        staged = f"{self.lake.root}/meta/staged/{stamp}"
        entries.write.parquet(staged)
        fresh = self.lake.spark.read.schema(incremental.VERSION_SCHEMA).parquet(staged)
        changed = incremental.changed_partitions(before, fresh)
        changed_path = f"{self.lake.root}/meta/changed/{stamp}"
        changed.write.parquet(changed_path)
        fresh.write.mode("append").parquet(self.path)
        return self.lake.spark.read.schema(incremental.VERSION_SCHEMA).parquet(changed_path)


def keys_of(frame: DataFrame, name: str) -> DataFrame:
    spec = dataset(name)
    if spec.partition in frame.columns:
        return frame.select(spec.partition).distinct()
    key = normalize.partition_column(spec.partition, F.col(spec.temporal))
    return frame.select((key.cast("date") if spec.partition == "dt" else key).alias(spec.partition)).distinct()


def silver_upsert(lake: Lake, name: str, frame: DataFrame) -> DataFrame:
    """Upsert silver rows; (dataset, partition, ...) of the partitions that changed."""
    lake.upsert(name, frame, "silver")
    return Versions(lake).record(name, "silver", keys_of(frame, name))


def write_gold(lake: Lake, name: str, rows: DataFrame) -> None:
    lake.replace(name, rows, "gold")


def landed(lake: Lake, source: str, frame: DataFrame, run_date: str, batch: str | None = None) -> DataFrame:
    """Write the delivery to bronze and read it back, so later steps never recompute it.

    Deliveries of one date that carry a batch are kept side by side.
    """
    path = lake.land(source, frame, run_date, batch)
    back = lake.spark.read.parquet(path).where(F.col("ingest_date") == F.lit(run_date).cast("date"))
    if batch is not None:
        back = back.where(F.col("batch") == batch)
    return back.select(*frame.columns)


def delivered(lake: Lake, delivery: str | None, source: str, canonical: DataFrame, run_date: str) -> DataFrame:
    """Canonical rows of a delivery landed raw are stored; rows handed in as they are get landed themselves."""
    return stored(canonical, "canonical") if delivery else landed(lake, source, canonical, run_date)


# --- gold builders --------------------------------------------------------------------


def gold_returns(lake: Lake) -> DataFrame:
    """Returns of the first vendor (by name) per instrument and day, over its own history."""
    prices = lake.scan("market_prices", "silver").select("vendor", "instrument", "dt", "px_last")
    rows = returns.simple_returns(prices, ["instrument", "vendor"], "px_last")
    best = F.min_by(F.struct("ret", "px_t", "px_t_1"), "vendor")
    return rows.groupBy("dt", "instrument").agg(best.alias("r")).select(
        "dt", "instrument", F.col("r.ret").alias("return"), "r.px_t", "r.px_t_1"
    )


def gold_positions(lake: Lake, lookback: int = LOOKBACK_WEEKS) -> DataFrame:
    return positioning.zscores(
        lake.scan("cot_weekly", "silver").select("contract", "group", "report_date", "net_pos"), lookback
    )


def gold_macro(lake: Lake, months: DataFrame, lags: dict[str, str] | None = None) -> DataFrame:
    """One open-schema row per month: value and vintage of every series known then."""
    releases = lake.scan("macro_releases", "silver")
    picks = asof.known_at_month_end(releases, months, lags)
    names = [r["series_id"] for r in releases.select("series_id").distinct().orderBy("series_id").collect()]
    return features.widen_macro(picks, names)


def gold_policy(lake: Lake, days: DataFrame | None = None) -> DataFrame:
    return curve.policy_features(lake.scan("policy_curve", "silver") if days is None else lake.read_keys("policy_curve", days, "silver"))


# --- update jobs ----------------------------------------------------------------------


def partition_list(changed: DataFrame) -> list[str]:
    """Names of changed partitions: at most one per stored folder."""
    return sorted(r["partition"] for r in changed.select("partition").distinct().collect())


def update_prices(lake: Lake, canonical: DataFrame, run_date: str, delivery: str | None = None, warnings: list[str] | None = None) -> DataFrame:
    """Upsert prices; rebuild the returns of changed days and of each next priced day.

    The state before the update links new days to the last prices, so that no history is read for them.
    """
    started, versions, last = now(), Versions(lake), state.LastPrices(lake)
    before = last.at(versions.latest("market_prices"))
    canonical = delivered(lake, delivery, "prices", canonical, run_date)
    changed = silver_upsert(lake, "market_prices", canonical)
    days = [dt.date.fromisoformat(d) for d in partition_list(changed)]
    rows, reached, links = state.reached_returns(lake, before, days)
    lake.swap("returns_daily", reached, rows, "gold")
    rebuilt = versions.record("returns_daily", "gold", reached.select("dt"))
    last.advance(before, links, versions.latest("market_prices"))
    record_run(lake, "update_prices", run_date, started, delivery or "prices", changed.unionByName(rebuilt), warnings=warnings)
    return rebuilt


def update_macro(lake: Lake, canonical: DataFrame, run_date: str, lags: dict[str, str] | None = None, delivery: str | None = None, warnings: list[str] | None = None) -> DataFrame:
    """Upsert releases; rebuild every month from the earliest period seen to the run month."""
    started = now()
    canonical = delivered(lake, delivery, "macro", canonical, run_date)
    changed = silver_upsert(lake, "macro_releases", canonical)
    days = changed.select(F.col("partition").cast("date").alias("dt"))
    touched = lake.read_keys("macro_releases", days, "silver")
    last = F.lit(run_date).cast("date")
    months = touched.agg(F.min("period").alias("first")).where("first is not null").select(
        F.explode(incremental.months_between(F.least("first", last), last)).alias("month_end")
    )
    write_gold(lake, "macro_asof_monthly", gold_macro(lake, months, lags))
    keys = months.select(S.month_key(F.col("month_end")).alias("month"))
    rebuilt = Versions(lake).record("macro_asof_monthly", "gold", keys)
    record_run(lake, "update_macro", run_date, started, delivery or "macro", changed.unionByName(rebuilt), warnings=warnings)
    return rebuilt


def update_positions(lake: Lake, canonical: DataFrame, run_date: str, lookback: int = LOOKBACK_WEEKS, delivery: str | None = None, warnings: list[str] | None = None) -> DataFrame:
    """Upsert reports; rebuild the z-scores of the reports that a changed one reaches.

    Reports before the first changed week come from the kept ring of each contract and group, so only later weeks are read.
    """
    started, versions = now(), Versions(lake)
    canonical = delivered(lake, delivery, "cot", canonical, run_date)
    changed = silver_upsert(lake, "cot_weekly", canonical)
    weeks = partition_list(changed)
    if not weeks:
        record_run(lake, "update_positions", run_date, started, delivery or "cot", changed, warnings=warnings)
        return changed
    scored, reports = state.scored_reports(lake, versions.log(), weeks, lookback)
    lake.upsert("cot_z_weekly", scored, "gold")
    rebuilt = versions.record("cot_z_weekly", "gold", scored.select("week"))
    state.keep_rings(lake, reports, weeks, lookback, versions.latest("cot_weekly"))
    record_run(lake, "update_positions", run_date, started, delivery or "cot", changed.unionByName(rebuilt), warnings=warnings)
    return rebuilt


def update_policy(lake: Lake, canonical: DataFrame, run_date: str, delivery: str | None = None, warnings: list[str] | None = None) -> DataFrame:
    started = now()
    canonical = delivered(lake, delivery, "policy", canonical, run_date)
    changed = silver_upsert(lake, "policy_curve", canonical)
    days = changed.select(F.col("partition").cast("date").alias("dt"))
    write_gold(lake, "policy_features", gold_policy(lake, days))
    rebuilt = Versions(lake).record("policy_features", "gold", days)
    record_run(lake, "update_policy", run_date, started, delivery or "policy", changed.unionByName(rebuilt), warnings=warnings)
    return rebuilt


def rebuild(lake: Lake, since: int | None = None, lags: dict[str, str] | None = None) -> DataFrame:
    """Rebuild gold from silver: everything, or what changed after version `since`.

    Returns (dataset, partition) of the gold partitions it rewrote: what is derived from the
    stored rows of a change, such as the next priced day rather than the next calendar day.
    Records their versions and one lineage entry.
    """
    started = now()
    versions = Versions(lake)
    log = versions.log().where(F.col("dataset").startswith("silver."))
    current = incremental.current_versions(log)
    changed = current if since is None else incremental.changed_partitions(incremental.as_of_version(log, since), current)
    changed = stored(changed, "changed")
    by = {name: changed.where(F.col("dataset") == f"silver.{name}") for name in
          ("market_prices", "macro_releases", "cot_weekly", "policy_curve")}
    done = []

    def recorded(name: str, keys: DataFrame | None) -> None:
        done.append(versions.record(name, "gold", keys))

    if since is None:
        for name, build in (("returns_daily", gold_returns), ("cot_z_weekly", gold_positions), ("policy_features", gold_policy)):
            if not by[SOURCES[name]].isEmpty():
                write_gold(lake, name, build(lake))
                recorded(name, None)
        if not by["macro_releases"].isEmpty():
            span = lake.scan("macro_releases", "silver").agg(F.min("period").alias("first"), F.max("dt").alias("last"))
            write_gold(lake, "macro_asof_monthly", gold_macro(lake, stored(span.select(
                F.explode(incremental.months_between(F.least("first", "last"), F.col("last"))).alias("month_end")), "months"), lags))
            recorded("macro_asof_monthly", None)
        every = [lake.partitions(name, "gold").select(F.lit(f"gold.{name}").alias("dataset"), F.col("key").alias("partition"))
                 for name, source in SOURCES.items() if not by[source].isEmpty()]
        reached = reduce(DataFrame.unionByName, every, lake.spark.createDataFrame([], "dataset string, partition string"))
    else:
        reached = _rebuild_reached(lake, versions, changed, by, lags, recorded)
    lineage = reduce(DataFrame.unionByName, done, changed)
    record_run(lake, "rebuild", started[:10], started, "silver", lineage)
    return reached


# Gold datasets and the silver ones they are built from.
SOURCES = {"returns_daily": "market_prices", "macro_asof_monthly": "macro_releases", "cot_z_weekly": "cot_weekly", "policy_features": "policy_curve"}


def _rebuild_reached(lake: Lake, versions: Versions, changed: DataFrame, by: dict[str, DataFrame], lags, recorded) -> DataFrame:
    """Rewrite the partitions of the impact map of `changed`, and return the map."""
    days = [dt.date.fromisoformat(d) for d in partition_list(by["market_prices"])]
    weeks = partition_list(by["cot_weekly"])
    last = state.LastPrices(lake).at(versions.latest("market_prices"))
    rows, targets, links = state.reached_returns(lake, last, days)
    scored, reports = state.scored_reports(lake, versions.log(), weeks, LOOKBACK_WEEKS) if weeks else (None, lake.scan("cot_weekly", "silver").limit(0))
    ingested = by["macro_releases"].select(F.col("partition").cast("date").alias("dt"))
    reached = stored(incremental.impacted(changed, links, reports, lake.read_keys("macro_releases", ingested, "silver"), LOOKBACK_WEEKS), "impact-map")

    def keys(name: str) -> DataFrame:
        key = dataset(name).partition
        return reached.where(F.col("dataset") == f"gold.{name}").select(F.col("partition").cast("date" if key == "dt" else "string").alias(key))

    if days:
        lake.swap("returns_daily", targets, rows, "gold")
        recorded("returns_daily", keys("returns_daily"))
    if weeks:
        lake.upsert("cot_z_weekly", scored, "gold")
        recorded("cot_z_weekly", keys("cot_z_weekly"))
    if not by["macro_releases"].isEmpty():
        months = keys("macro_asof_monthly").select(F.last_day(F.concat("month", F.lit("-01")).cast("date")).alias("month_end"))
        write_gold(lake, "macro_asof_monthly", gold_macro(lake, months, lags))
        recorded("macro_asof_monthly", keys("macro_asof_monthly"))
    if not by["policy_curve"].isEmpty():
        write_gold(lake, "policy_features", gold_policy(lake, keys("policy_features")))
        recorded("policy_features", keys("policy_features"))
    return reached


# --- generic update and backfill ------------------------------------------------------

Provider = Callable[[str, str, str], DataFrame]


def update_dataset(
    lake: Lake, name: str, fetch: Provider, start: str | None = None, end: str | None = None, default_days: int = 7,
    run_date: str | None = None,
) -> dict:
    """Fetch what lies after the latest stored partition and write it to all levels.

    `fetch(name, start, end)` returns rows of the range. The result says whether
    the dataset was updated, was up to date, or had no data in the range.
    """
    spec = dataset(name)
    until = dt.date.fromisoformat(end) if end else dt.date.today()
    if start:
        since = dt.date.fromisoformat(start)
    else:
        latest = lake.partitions(name, "gold").agg(F.max_by("key", "day").alias("key"))
        since = latest.select(incremental.next_start(F.col("key"), spec.partition)).first()[0]
        since = since or until - dt.timedelta(days=default_days)
    result = {"dataset": name, "start": since.isoformat(), "end": until.isoformat(), "rows": 0}
    if since > until:
        return {**result, "status": "up_to_date"}
    rows = fetch(name, since.isoformat(), until.isoformat())
    if rows.isEmpty():
        return {**result, "status": "no_data"}
    rows = landed(lake, name, rows, run_date or dt.date.today().isoformat(), f"{since.isoformat()}_{until.isoformat()}")
    lake.upsert(name, rows, "silver")
    lake.upsert(name, rows, "gold")
    return {**result, "status": "updated", "rows": rows.count()}


def update_all(lake: Lake, names: list[str], fetch: Provider, start: str | None = None, end: str | None = None) -> DataFrame:
    results = [update_dataset(lake, name, fetch, start, end) for name in names]
    return lake.spark.createDataFrame(
        [(r["dataset"], r["status"], r["start"], r["end"], r["rows"]) for r in results],
        "dataset string, status string, start string, end string, rows bigint",
    )


def backfill(lake: Lake, names: list[str], fetch: Provider, start: str, end: str) -> DataFrame:
    if start > end:
        raise ValueError(f"backfill start {start} lies after its end {end}")
    return update_all(lake, names, fetch, start, end)


# --- lineage --------------------------------------------------------------------------


def now() -> str:
    return dt.datetime.now(dt.timezone.utc).isoformat()


def pack_id(run_date: str, version: int = 1) -> str:
    return f"{run_date.replace('-', '')}_v{version}"


def runs_path(lake: Lake) -> str:
    return f"{lake.root}/meta/runs"


def record_run(
    lake: Lake, job: str, run_date: str, started: str, source: str, partitions: DataFrame,
    errors: list[str] | None = None, warnings: list[str] | None = None,
) -> None:
    """Append the lineage of one run: a row per partition it touched, or one without a partition where nothing changed."""
    if partitions.isEmpty():
        partitions = lake.spark.range(1).select(*[
            F.lit(None).cast(partitions.schema[c].dataType).alias(c) for c in ("path", "dataset", "partition", "fingerprint", "row_count")])
    texts = lambda items: F.array(*[F.lit(x) for x in items or []]).cast("array<string>")
    partitions.select(
        F.lit(job).alias("job"), F.lit(f"{job}_{started}").alias("run_id"),
        F.lit(run_date).cast("date").alias("run_date"), F.lit(started).alias("started_at"),
        F.lit(now()).alias("ended_at"), F.lit(f"{lake.root}/bronze/{source}").alias("input"),
        F.col("path").alias("output"), "dataset", "partition", "fingerprint", "row_count",
        texts(errors).alias("errors"), texts(warnings).alias("warnings"),
    ).write.mode("append").parquet(runs_path(lake))


def runs(lake: Lake) -> DataFrame:
    return lake.spark.read.schema(incremental.RUN_SCHEMA).parquet(runs_path(lake))

