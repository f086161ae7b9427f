"""Change detection: fingerprints, versions, impact of a change, lineage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions import scalars as S

VERSION_SCHEMA = (
    "dataset string, partition string, fingerprint string, row_count bigint, path string, written_at bigint"
)
RUN_SCHEMA = (
    "job string, run_id string, run_date date, started_at string, ended_at string, input string, output string, "
    "dataset string, partition string, fingerprint string, row_count bigint, errors array<string>, warnings array<string>"
)


def fingerprints(df: DataFrame, partition: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(partition, fingerprint, row_count), independent of row order.

    Each row is digested, and the digests of a partition are combined by a
    bitwise xor and a sum. Both combine on the map side, so a partition of any
    size costs a few numbers, never a list of its rows.
    """
    names = sorted(c for c in (columns or df.columns) if c != partition)
    digest = F.sha2(S.canonical_text(df.schema, names), 256)
    lanes = df.select(
        F.col(partition).cast("string").alias("partition"),
        S.hex_lane(digest, 1).alias("a"), S.hex_lane(digest, 16).alias("b"),
    )
    summed = lanes.groupBy("partition").agg(
        F.count(F.lit(1)).alias("row_count"), F.bit_xor("a").alias("x"),
        F.sum(F.col("b").cast("decimal(38,0)")).alias("s"),
    )
    parts = [F.col(c).cast("string") for c in ("row_count", "x", "s")]
    return summed.select("partition", F.sha2(F.concat_ws("|", *parts), 256).alias("fingerprint"), "row_count")


def keep_last(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last in `order`.

    An aggregate rather than a ranking window: repeats of one key are reduced on
    the map side, however many there are.
    """
    rest = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*key).agg(best.alias("row")).select(*key, "row.*").select(*df.columns)


def current_versions(log: DataFrame) -> DataFrame:
    """Latest entry of each (dataset, partition) in the append-only version log."""
    return keep_last(log, ["dataset", "partition"], ["written_at"])


def as_of_version(log: DataFrame, written_at: int) -> DataFrame:
    return current_versions(log.where(F.col("written_at") <= written_at))


def changed_partitions(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Current partitions that are new or whose fingerprint differs."""
    old = previous.select("dataset", "partition", F.col("fingerprint").alias("old_fingerprint"))
    joined = current.join(old, ["dataset", "partition"], "left")
    return joined.where(~F.col("fingerprint").eqNullSafe(F.col("old_fingerprint"))).drop("old_fingerprint")


def impacted(
    changed: DataFrame, price_links: DataFrame, reports: DataFrame, releases: DataFrame, lookback: int = 260, policy_on_prices: bool = False,
) -> DataFrame:
    """(dataset, partition) of the gold partitions that changed silver partitions reach, from the keys that are stored.

    A price day reaches itself and the next priced day of the keys priced there (`price_links`: dt, next_dt), which may
    be any number of calendar days away; a report reaches itself and the next `lookback` - 1 reports of its contract
    and group (`reports`: contract, group, report_date); releases reach every month from the earliest period
    among them to the last ingest day (`releases`: dt, period); a curve day reaches its own day.
    """
    def of(source: str) -> DataFrame:
        return changed.where(F.col("dataset") == source).select("partition").distinct()

    def found(target: str, keys: DataFrame) -> DataFrame:
        return keys.select(F.lit(target).alias("dataset"), F.col("partition").cast("string").alias("partition"))

    links = price_links.join(of("silver.market_prices").select(F.col("partition").cast("date").alias("dt")), "dt", "left_semi")
    frame = Window.partitionBy("contract", "group").orderBy("report_date").rowsBetween(-(lookback - 1), 0)
    weekly = reports.withColumn("partition", S.iso_week_key(F.col("report_date"))).join(
        of("silver.cot_weekly").withColumn("hit", F.lit(True)), "partition", "left").withColumn("reached", F.max("hit").over(frame))
    span = releases.join(of("silver.macro_releases").select(F.col("partition").cast("date").alias("dt")), "dt", "left_semi").agg(
        F.min("period").alias("first"), F.max("dt").alias("last")).where("first is not null")
    months = span.select(F.explode(months_between(F.least("first", "last"), F.col("last"))).alias("month_end"))
    rules = [
        found("gold.returns_daily", links.select(F.explode(F.array("dt", "next_dt")).alias("partition")).where("partition is not null")),
        found("gold.cot_z_weekly", weekly.where("reached")),
        found("gold.macro_asof_monthly", months.select(S.month_key(F.col("month_end")).alias("partition"))),
        found("gold.policy_features", of("silver.policy_curve")),
    ]
    if policy_on_prices:
        rules.append(found("gold.policy_features", of("silver.market_prices")))
    return reduce(DataFrame.unionByName, rules).distinct()


def months_between(first: Column, last: Column) -> Column:
    """Month ends from the month of `first` to the month of `last`."""
    months = F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))
    return F.transform(months, lambda m: F.last_day(m))


def next_start(latest: Column, kind: str) -> Column:
    """First day after the latest partition: next day, next Monday, next first of month."""
    if kind == "week":
        return F.date_add(S.iso_week_monday(latest), 7)
    if kind == "month":
        return F.add_months(F.concat(latest, F.lit("-01")).cast("date"), 1)
    return F.date_add(latest.cast("date"), 1)


def releases_start(latest: Column, default: str = "2010-01-01") -> Column:
    """One month before the latest release partition, to catch revisions."""
    return F.coalesce(F.add_months(latest.cast("date"), -1), F.lit(default).cast("date"))
