"""Windows over dated panels: returns, rolling statistics, compounding, runs.

Callers pass panels with one row per (key, date). The rows of one window
partition are therefore at most the days of the calendar, not the raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.scalars import ratio

TRADING_DAYS = 252


def by_date(key: Sequence[str], order: str = "dt"):
    if not key:
        raise ValueError("a window needs at least one key column")
    return Window.partitionBy(*key).orderBy(order)


def trailing(key: Sequence[str], rows: int, order: str = "dt"):
    return by_date(key, order).rowsBetween(-(rows - 1), 0)


def running(key: Sequence[str], order: str = "dt"):
    return by_date(key, order).rowsBetween(Window.unboundedPreceding, 0)


def gated(aggregate: Column, counted: Column, minimum: int) -> Column:
    """Value of a rolling aggregate once the window holds enough non-null rows."""
    return F.when(counted >= minimum, aggregate)


def rolling_mean(value: str, window, minimum: int) -> Column:
    return gated(F.avg(value).over(window), F.count(value).over(window), minimum)


def rolling_std(value: str, window, minimum: int) -> Column:
    return gated(F.stddev_samp(value).over(window), F.count(value).over(window), minimum)


def simple_returns(
    prices: DataFrame, key: Sequence[str], price: str = "px", date: str = "dt"
) -> DataFrame:
    """Return against the previous available price of the key; first rows dropped."""
    previous = F.lag(price).over(by_date(key, date))
    return (
        prices.where(F.col(price).isNotNull())
        .withColumn("px_t_1", previous)
        .withColumn("ret", ratio(F.col(price), F.col("px_t_1")) - 1)
        .where(F.col("ret").isNotNull())
        .select(*key, date, F.col(price).alias("px_t"), "px_t_1", "ret")
    )


def first_difference(df: DataFrame, key: Sequence[str], value: str, date: str = "dt") -> DataFrame:
    return df.withColumn("diff", F.col(value) - F.lag(value).over(by_date(key, date)))


def rolling_zscore(
    df: DataFrame, key: Sequence[str], value: str, rows: int, minimum: int, date: str = "dt"
) -> DataFrame:
    """(x - rolling mean) / rolling sample deviation; NULL where the deviation is zero."""
    frame = trailing(key, rows, date)
    score = ratio(F.col(value) - F.avg(value).over(frame), F.stddev_samp(value).over(frame))
    return df.withColumn("zscore", gated(score, F.count(value).over(frame), minimum))


def net_asset_value(df: DataFrame, key: Sequence[str], ret: str = "ret", date: str = "dt") -> DataFrame:
    """Running product of 1 + r, its running peak and the drawdown from that peak."""
    growth = F.product(1 + F.col(ret)).over(running(key, date))
    peaked = df.withColumn("nav", growth)
    peaked = peaked.withColumn("peak", F.max("nav").over(running(key, date)))
    return peaked.withColumn("drawdown", ratio(F.col("nav"), F.col("peak")) - 1)


def rolling_risk(
    df: DataFrame, key: Sequence[str], ret: str = "ret", date: str = "dt", rows: int = 63, minimum: int = 20
) -> DataFrame:
    """Annualised rolling volatility and Sharpe ratio."""
    frame = trailing(key, rows, date)
    year = F.sqrt(F.lit(float(TRADING_DAYS)))
    vol = rolling_std(ret, frame, minimum)
    mean = rolling_mean(ret, frame, minimum)
    return df.withColumn("vol", vol * year).withColumn(
        "sharpe", ratio(mean, F.nullif(vol, F.lit(0.0))) * year
    )


def signal(df: DataFrame, key: Sequence[str], mode: str, ret: str = "ret") -> DataFrame:
    """Raw return, log growth, or z-score against all rows of the key."""
    value = F.col(ret)
    if mode == "log":
        return df.withColumn("signal", F.log1p(F.greatest(value, F.lit(-0.999999))))
    if mode == "zscore":
        whole = Window.partitionBy(*key)
        mean, sd = F.avg(ret).over(whole), F.stddev_samp(ret).over(whole)
        score = F.when(sd > 0, (value - mean) / sd).otherwise(value * 0.0)
        return df.withColumn("signal", score)
    if mode != "raw":
        raise ValueError(f"unknown signal mode {mode!r}")
    return df.withColumn("signal", value)


def signal_means(df: DataFrame, key: Sequence[str], date: str = "dt") -> DataFrame:
    short, long = trailing(key, 21, date), trailing(key, 63, date)
    return df.withColumn("mean_21", rolling_mean("signal", short, 5)).withColumn(
        "mean_63", rolling_mean("signal", long, 10)
    )


def change_points(df: DataFrame, key: Sequence[str], state: str, date: str = "dt") -> DataFrame:
    """Flag rows whose state differs from the previous row (the first row counts)."""
    before = F.lag(state).over(by_date(key, date))
    return df.withColumn("changed", ~F.col(state).eqNullSafe(before))


def run_lengths(df: DataFrame, key: Sequence[str], state: str, date: str = "dt") -> DataFrame:
    """Mean length of consecutive runs of each state."""
    labelled = change_points(df.where(F.col(state).isNotNull()), key, state, date)
    island = F.sum(F.col("changed").cast("int")).over(running(key, date))
    return (
        labelled.withColumn("run", island)
        .groupBy(*key, state, "run")
        .agg(F.count(F.lit(1)).alias("length"))
        .groupBy(*key, state)
        .agg(F.avg("length").alias("mean_run"))
    )


def transition_matrix(df: DataFrame, key: Sequence[str], state: str, date: str = "dt") -> DataFrame:
    """Row-normalised counts of consecutive (previous, next) states."""
    pairs = df.withColumn("from_state", F.lag(state).over(by_date(key, date))).where(
        F.col("from_state").isNotNull() & F.col(state).isNotNull()
    )
    counts = pairs.groupBy(*key, "from_state", F.col(state).alias("to_state")).agg(
        F.count(F.lit(1)).alias("n")
    )
    total = F.sum("n").over(Window.partitionBy(*key, "from_state"))
    return counts.withColumn("share", F.col("n") / total)
