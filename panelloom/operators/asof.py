"""As-of alignment of sparse keyed series to a target calendar.

The calendar (the distinct days of all inputs) is numbered once; an observation
is then valid on the positions from its own up to the next observation or the
fill limit, whichever comes first. Exploding that range gives the aligned rows without building a key x day grid: a cell that stays
empty is simply absent, which is the long form of NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.scalars import month_end, release_lag_months


def calendar(df: DataFrame, date: str = "dt") -> DataFrame:
    return df.select(F.col(date).alias("dt")).where(F.col("dt").isNotNull()).distinct()


def numbered(days: DataFrame) -> DataFrame:
    """Give distinct days consecutive positions.

    The only window without a key in the library: its input is a list of
    distinct days, a few hundred rows per year of history.
    """
    order = Window.orderBy("dt")
    return days.select(
        "*",
        F.row_number().over(order).alias("pos"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("n_days"),
    )


def union_calendar(source: DataFrame, target: DataFrame, date: str = "dt") -> DataFrame:
    """Days of either side, with a flag for the target's own days."""
    both = calendar(source, date).withColumn("is_target", F.lit(False)).unionByName(
        calendar(target).withColumn("is_target", F.lit(True))
    )
    return numbered(both.groupBy("dt").agg(F.bool_or("is_target").alias("is_target")))


def target_calendar(target: DataFrame) -> DataFrame:
    return numbered(calendar(target).withColumn("is_target", F.lit(True)))


def looking_ahead(days: DataFrame, reach: int) -> DataFrame:
    """Each day with the list of itself and the next `reach` days."""
    ahead = Window.orderBy("dt").rowsBetween(0, reach)
    return days.select("dt", "pos", F.collect_list(F.struct("dt", "is_target")).over(ahead).alias("ahead"))


def fill_on(
    observed: DataFrame,
    days: DataFrame,
    key: Sequence[str],
    value: str,
    limit: int | None,
    tail: int = 0,
    date: str = "dt",
) -> DataFrame:
    """Carry each observation forward at most `limit` calendar positions.

    `tail` keeps that many further positions with a NULL value, for rolling
    windows that still reach back to the observation.
    """
    seen = observed.where(F.col(value).isNotNull()).select(*key, F.col(date).alias("dt"), value)
    after = F.lead("pos").over(Window.partitionBy(*key).orderBy("pos"))
    if limit is None:
        placed = seen.join(days.select("dt", "pos", "n_days"), "dt")
        last = F.coalesce(after - 1, F.col("n_days").cast("int"))
        spread = placed.withColumn("last", last).select(
            *key, value, F.explode(F.sequence("pos", "last")).alias("pos")
        )
        filled = spread.join(days.select("pos", "dt", "is_target"), "pos")
        return filled.where("is_target").select(*key, "dt", "pos", value)
    # A bounded reach needs one calendar lookup: the days ahead come along with it.
    placed = seen.join(looking_ahead(days, limit + tail), "dt").drop("dt")
    span = F.least(F.coalesce(after - F.col("pos"), F.size("ahead")), F.size("ahead"))
    spread = placed.withColumn("span", span).select(
        *key, value, "pos", F.posexplode(F.slice("ahead", F.lit(1), F.col("span"))).alias("offset", "day")
    )
    return spread.where("day.is_target").select(
        *key, F.col("day.dt").alias("dt"), (F.col("pos") + F.col("offset")).alias("pos"),
        F.when(F.col("offset") <= limit, F.col(value)).alias(value),
    )


def align(
    source: DataFrame,
    target: DataFrame,
    key: Sequence[str],
    value: str,
    limit: int | None = None,
    date: str = "dt",
) -> DataFrame:
    """As-of alignment over the union of both calendars (limit counts its days)."""
    days = union_calendar(source, target, date)
    return fill_on(source, days, key, value, limit, date=date).select(*key, "dt", value)


def reindex_fill(
    source: DataFrame, target: DataFrame, key: Sequence[str], value: str, limit: int | None = 3
) -> DataFrame:
    """Left join on the target calendar alone, then a row-limited fill."""
    return fill_on(source, target_calendar(target), key, value, limit).select(*key, "dt", value)


def effective_release(
    period: Column, release_date: Column, lag_text: Column | None = None, default: int = 1
) -> Column:
    lag = release_lag_months(lag_text, default) if lag_text is not None else F.lit(default)
    return F.coalesce(release_date, month_end(period, lag))


def known_at_month_end(
    releases: DataFrame,
    months: DataFrame,
    lags: dict[str, str] | None = None,
    default_lag: str = "P1M",
    vintage_cutoff: bool = False,
) -> DataFrame:
    """Value and vintage of the newest period known at each month end.

    A release counts from the first month end on or after its effective release.
    The best release so far is a running maximum, so releases are first reduced
    to one best row per series and month (map-side) and never paired with months.
    """
    default = int(default_lag[1:-1]) if default_lag.startswith("P") and default_lag.endswith("M") else 1
    lag_text = None
    if lags:
        table = F.create_map(*[F.lit(x) for pair in lags.items() for x in pair])
        lag_text = F.coalesce(F.element_at(table, F.col("series_id")), F.lit(default_lag))
    effective = effective_release(F.col("period"), F.col("release_date"), lag_text, default)
    if vintage_cutoff:
        effective = F.greatest(effective, F.col("dt_ingest"))
    newest = F.struct("period", "dt_ingest", "vintage_id", "value")
    best = (
        releases.withColumn("month_end", F.last_day(effective))
        .groupBy("series_id", "month_end")
        .agg(F.max(newest).alias("best"))
    )
    so_far = Window.partitionBy("series_id").orderBy("month_end").rowsBetween(
        Window.unboundedPreceding, 0
    )
    running = best.withColumn("best", F.max("best").over(so_far))
    wanted = months.select(F.col("month_end").alias("dt"))
    days = union_calendar(running, wanted, "month_end")
    return fill_on(running, days, ["series_id"], "best", None, date="month_end").select(
        "series_id", F.col("dt").alias("month_end"), F.col("best.value").alias("value"),
        F.col("best.vintage_id").alias("vintage_id"), F.col("best.period").alias("period"),
    )


def nearest(
    df: DataFrame, key: Sequence[str], position: str, value: str, targets: Sequence[int]
) -> DataFrame:
    """Value at the position nearest to each target (lower position on a tie), one pass."""
    picks = [
        F.min_by(value, F.struct(F.abs(F.col(position) - target), F.col(position))).alias(f"at_{target}")
        for target in targets
    ]
    return df.groupBy(*key).agg(*picks)


def latest_on_or_before(
    df: DataFrame, key: Sequence[str], date: str, columns: Sequence[str], at: str, fallback: bool = False
) -> DataFrame:
    """Row with the latest date not after `at`; optionally the last row overall."""
    row = F.struct(date, *columns)
    ok = F.col(date) <= F.lit(at).cast("date")
    chosen = F.max_by(F.when(ok, row), F.when(ok, F.col(date)))
    if fallback:
        chosen = F.coalesce(chosen, F.max_by(row, F.col(date)))
    picked = df.where(F.col(date).isNotNull()).groupBy(*key).agg(chosen.alias("row"))
    return picked.where(F.col("row").isNotNull()).select(*key, "row.*")
