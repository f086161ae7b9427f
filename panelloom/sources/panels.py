"""Keyed daily panels derived from the supplied tables.

Every panel is pre-aggregated to one row per (key, day), so the rows of one key
never exceed the number of days in the calendar however the raw rows are spread:
a key holding a third of the raw rows is combined on the map side first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions.scalars import month_end
from panelloom.sources.tables import Tables

# The assets and regimes of the default weight tables.
ASSETS = ["US10Y", "US2Y", "GOLD", "USD_index", "SP500", "OIL", "CARRY_ETF", "TIPS"]
REGIMES = ["Easing", "Reacceleration", "Stagflation", "Risk-Off"]


def pick(names: list[str], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


def prices(t: Tables) -> DataFrame:
    """(instrument, dt, px): mean order price per priority and day."""
    return (
        t.orders.select(
            F.col("o_orderpriority").alias("instrument"),
            F.col("o_orderdate").cast("date").alias("dt"),
            "o_totalprice",
        )
        .groupBy("instrument", "dt")
        .agg(F.avg("o_totalprice").alias("px"))
    )


def vendor_prices(t: Tables) -> DataFrame:
    """(vendor, instrument, dt, px): order status plays the vendor."""
    return (
        t.orders.select(
            F.col("o_orderstatus").alias("vendor"),
            F.col("o_orderpriority").alias("instrument"),
            F.col("o_orderdate").cast("date").alias("dt"),
            "o_totalprice",
        )
        .groupBy("vendor", "instrument", "dt")
        .agg(F.avg("o_totalprice").alias("px"))
    )


def asset_prices(t: Tables) -> DataFrame:
    """(asset, dt, px): mean unit price per named asset and ship day."""
    return (
        t.lineitem.select(
            pick(ASSETS, F.col("l_suppkey") % 8).alias("asset"),
            F.col("l_shipdate").cast("date").alias("dt"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        )
        .groupBy("asset", "dt")
        .agg((F.avg("unit_price") / 100 + 1000).alias("px"))
    )


def strategy(t: Tables) -> DataFrame:
    """(portfolio, dt, ret): small daily returns per return flag and ship day."""
    level = F.avg("l_extendedprice") / 53000 - 1
    return (
        t.lineitem.groupBy(
            F.col("l_returnflag").alias("portfolio"),
            F.col("l_shipdate").cast("date").alias("dt"),
        )
        .agg(F.round(level * 0.02, 9).alias("ret"))
    )


def probabilities(t: Tables) -> DataFrame:
    """(portfolio, dt, p): share of four line-number classes per flag and ship day."""
    line = t.lineitem.select(
        F.col("l_returnflag").alias("portfolio"),
        F.col("l_shipdate").cast("date").alias("dt"),
        (F.col("l_linenumber") % 4).alias("k"),
    )
    counts = [F.count_if(F.col("k") == k).alias(f"n{k}") for k in range(4)]
    share = F.array(*[F.col(f"n{k}") / F.col("n") for k in range(4)])
    return (
        line.groupBy("portfolio", "dt")
        .agg(F.count(F.lit(1)).alias("n"), *counts)
        .select("portfolio", "dt", share.alias("p"))
    )


def exact(price: str) -> F.Column:
    """A price to four decimals as a decimal: sums do not depend on the order of rows, so halves round alike everywhere."""
    return F.col(price).cast("decimal(18, 4)")


def weekly_positions(t: Tables) -> DataFrame:
    """(contract, grp, report_date, long, short): Tuesday reports from orders, exact sums rounded half away from zero."""
    report = F.date_add(F.trunc("o_orderdate", "week"), 1)
    even = F.col("o_custkey") % 2 == 0
    price = exact("o_totalprice")
    return (
        t.orders.groupBy(
            F.col("o_orderpriority").alias("contract"),
            F.col("o_orderstatus").alias("grp"),
            report.alias("report_date"),
        )
        .agg(
            F.sum(F.when(even, price).otherwise(F.lit(0))).alias("long_raw"),
            F.sum(F.when(~even, price).otherwise(F.lit(0))).alias("short_raw"),
        )
        .select(
            "contract", "grp", "report_date",
            F.round("long_raw").cast("bigint").alias("long"),
            F.round("short_raw").cast("bigint").alias("short"),
        )
    )


def releases(t: Tables) -> DataFrame:
    """(series_id, period, vintage_id, dt_ingest, release_date, value)."""
    period = month_end(F.col("l_shipdate"))
    vintage = F.col("l_linenumber")
    grouped = (
        t.lineitem.groupBy(
            F.col("l_returnflag").alias("series_id"), period.alias("period"), vintage.alias("v")
        )
        .agg((F.avg("l_extendedprice") / 7).alias("value"))
    )
    dated = F.when(
        (F.month("period") + F.col("v")) % 3 != 0,
        F.date_add("period", F.col("v") * 9),
    )
    return grouped.select(
        "series_id", "period",
        F.concat(F.lit("v"), F.col("v").cast("string")).alias("vintage_id"),
        F.last_day(F.date_add("period", F.col("v") * 11)).alias("dt_ingest"),
        dated.alias("release_date"),
        F.round("value", 4).alias("value"),
    )


def daily_curve(t: Tables) -> DataFrame:
    """(dt, tenor_days, implied_rate, source): eight days per quantity unit."""
    return (
        t.lineitem.groupBy(
            F.col("l_shipdate").cast("date").alias("dt"),
            (F.col("l_quantity").cast("bigint") * 8).alias("tenor_days"),
        )
        .agg(F.round(F.avg("l_discount"), 9).alias("implied_rate"))
        .withColumn("source", F.lit("ois"))
    )


def sequences(t: Tables) -> DataFrame:
    """(series_id, dt, x): daily log activity vector of each user."""
    return (
        t.events.groupBy(F.col("user_id").alias("series_id"), F.col("ts").cast("date").alias("dt"))
        .agg(
            F.round(F.log1p(F.sum("value")), 9).alias("x0"),
            F.log1p(F.count(F.lit(1)).cast("double")).alias("x1"),
        )
        .select("series_id", "dt", F.array("x0", "x1").alias("x"))
    )


def asset_returns(t: Tables) -> DataFrame:
    from panelloom.operators.returns import simple_returns

    return simple_returns(asset_prices(t), key=["asset"], price="px")


def states(t: Tables) -> DataFrame:
    """(portfolio, dt, p, state, label): most likely class per portfolio and day."""
    from panelloom.functions.probability import argmax_state

    scored = probabilities(t).withColumn("state", argmax_state(F.col("p")))
    return scored.withColumn("label", pick(REGIMES, F.col("state")))
