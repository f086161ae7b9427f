"""The daily feature panel in long form (dt, feature, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions import scalars as S
from panelloom.operators import asof
from panelloom.operators.curve import policy_columns
from panelloom.session import stored

# Spread features with their legs in order of preference.
SPREADS = {
    "stocks_vs_bonds": [("ret_SP500", "ret_US10Y"), ("ret_SPX_US", "ret_US10Y_US")],
    "oil_vs_stocks": [("ret_OIL", "ret_SP500")],
    "gold_vs_usd": [("ret_GOLD", "ret_USD_index")],
    "curve_slope": [("ret_US10Y", "ret_US2Y"), ("ret_US10Y_US", "ret_US2Y_US")],
}
RETURN_FILL = 3
POSITION_FILL = 7
SURPRISE_FILL = 5


def trailing_positions(key: Sequence[str], rows: int):
    """Window over the last `rows` calendar positions, present or not."""
    return Window.partitionBy(*key).orderBy("pos").rangeBetween(-(rows - 1), 0)


def mean_over(rows: int, minimum: int) -> Column:
    frame = trailing_positions(["tag"], rows)
    return F.when(F.count("ret").over(frame) >= minimum, F.avg("ret").over(frame))


def return_features(returns: DataFrame) -> DataFrame:
    """ret_, ma5_ and ma20_ features of each instrument plus the spreads."""
    tagged = returns.withColumn("tag", S.instrument_tag(F.col("instrument")))
    filled = asof.fill_on(tagged, asof.target_calendar(tagged), ["tag"], "ret", RETURN_FILL, tail=19)
    rolled = filled.withColumn("ma5", mean_over(5, 3)).withColumn("ma20", mean_over(20, 10))
    named = F.array(
        F.struct(S.prefixed("ret_", F.col("tag")).alias("feature"), F.col("ret").alias("value")),
        F.struct(S.prefixed("ma5_", F.col("tag")).alias("feature"), F.col("ma5").alias("value")),
        F.struct(S.prefixed("ma20_", F.col("tag")).alias("feature"), F.col("ma20").alias("value")),
    )
    base = rolled.select("dt", F.inline(named)).where(F.col("value").isNotNull())
    legs = filled.select("dt", S.prefixed("ret_", F.col("tag")).alias("feature"), F.col("ret").alias("value"))
    return base.unionByName(spread_features(legs))


def spread_features(features: DataFrame, spreads: dict | None = None) -> DataFrame:
    """Difference of two legs per day, from the first pair that exists at all.

    The legs of a day are gathered by one conditional aggregation, not a self
    join. Whether a leg exists is a count over the gathered days, one row each.
    """
    spreads = spreads or SPREADS
    legs = sorted({leg for pairs in spreads.values() for pair in pairs for leg in pair})
    wide = features.where(F.col("feature").isin(legs)).groupBy("dt").agg(*[
        F.max(F.when(F.col("feature") == leg, F.col("value"))).alias(leg) for leg in legs
    ])
    all_days = Window.partitionBy()
    wide = wide.select("*", *[F.count(leg).over(all_days).alias(f"n_{leg}") for leg in legs])
    points = []
    for name, pairs in spreads.items():
        value = F.lit(None).cast("double")
        for long_leg, short_leg in reversed(pairs):
            exists = (F.col(f"n_{long_leg}") > 0) & (F.col(f"n_{short_leg}") > 0)
            value = F.when(exists, F.col(long_leg) - F.col(short_leg)).otherwise(value)
        points.append(F.struct(F.lit(name).alias("feature"), value.alias("value")))
    return wide.select("dt", F.inline(F.array(*points))).where(F.col("value").isNotNull())


def positioning_features(zscores: DataFrame, target: DataFrame) -> DataFrame:
    """Mean z-score per contract and publication Thursday, filled over 7 days."""
    published = zscores.withColumn("dt", S.iso_week_thursday(F.col("week")))
    per_contract = published.groupBy(
        "dt", S.prefixed("cot_z_", S.contract_tag(F.col("contract"))).alias("feature")
    ).agg(F.avg("zscore").alias("value"))
    return asof.align(per_contract, target, ["feature"], "value", POSITION_FILL)


def policy_feature_rows(policy: DataFrame, target: DataFrame) -> DataFrame:
    wide = policy_columns(policy)
    names = [c for c in wide.columns if c != "dt"]
    return asof.align(wide.unpivot("dt", names, "feature", "value"), target, ["feature"], "value")


def monthly_surprise(macro: DataFrame) -> DataFrame:
    """(dt, value): mean over series of change / rolling deviation, clipped to 3.

    `macro` is (month_end, series_id, value). Months are numbered, so the windows
    count calendar rows of the panel even where a series has no value.
    """
    months = asof.numbered(asof.calendar(macro, "month_end"))
    placed = macro.where(F.col("value").isNotNull()).join(
        months.select(F.col("dt").alias("month_end"), "pos"), "month_end"
    )
    order = Window.partitionBy("series_id").orderBy("pos")
    consecutive = F.lag("pos").over(order) == F.col("pos") - 1
    change = F.when(consecutive, F.col("value") - F.lag("value").over(order))
    frame = trailing_positions(["series_id"], 12)
    deviation = F.when(F.count("change").over(frame) >= 3, F.stddev_samp("change").over(frame))
    surprise = S.ratio(F.col("change"), F.nullif(deviation, F.lit(0.0)))
    per_month = (
        placed.withColumn("change", change)
        .withColumn("surprise", surprise)
        .groupBy("month_end", "pos")
        .agg(F.avg("surprise").alias("surprise"))
    )
    value = S.clip(F.coalesce("surprise", F.lit(0.0)), -3.0, 3.0)
    return per_month.select(F.col("month_end").alias("dt"), value.alias("value"))


def surprise_score(macro: DataFrame, target: DataFrame) -> DataFrame:
    """Daily surprise: filled over 5 days of the union calendar, 0 elsewhere."""
    monthly = monthly_surprise(macro).withColumn("feature", F.lit("surprise_score"))
    aligned = asof.align(monthly, target, ["feature"], "value", SURPRISE_FILL)
    every_day = asof.calendar(target).join(aligned.drop("feature"), "dt", "left")
    return every_day.select(
        "dt", F.lit("surprise_score").alias("feature"), F.coalesce("value", F.lit(0.0)).alias("value")
    )


def feature_panel(
    returns: DataFrame,
    positioning: DataFrame | None = None,
    policy: DataFrame | None = None,
    macro: DataFrame | None = None,
) -> DataFrame:
    """All feature blocks on the return calendar, as one long panel.

    The inputs are stored gold tables: each is read by several blocks, so pass
    tables on disk rather than long unevaluated plans.
    """
    target = stored(asof.calendar(returns), "calendar")
    blocks = [return_features(returns)]
    if positioning is not None:
        blocks.append(positioning_features(positioning, target))
    if policy is not None:
        blocks.append(policy_feature_rows(policy, target))
    if macro is not None:
        blocks.append(surprise_score(macro, target))
    panel = blocks[0]
    for block in blocks[1:]:
        panel = panel.unionByName(block.select("dt", "feature", "value"))
    return panel


def widen(panel: DataFrame, names: Sequence[str], date: str = "dt") -> DataFrame:
    """Wide matrix for a known list of features (no pass to discover them)."""
    return panel.groupBy(date).pivot("feature", list(names)).agg(F.max("value"))


def pivot_last(
    df: DataFrame, index: str, column: str, value: str, order: str, names: Sequence[str]
) -> DataFrame:
    """Wide form with the last non-null value per cell in `order`."""
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order)))
    return df.groupBy(index).pivot(column, list(names)).agg(last)


def pivot_mean(df: DataFrame, index: str, column: str, value: str, names: Sequence[str]) -> DataFrame:
    return df.groupBy(index).pivot(column, list(names)).agg(F.avg(value))


def widen_macro(picks: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per month: each series and its vintage companion."""
    wide = picks.groupBy("month_end").pivot("series_id", list(names)).agg(
        F.first("value", True).alias("value"), F.first("vintage_id", True).alias("vintage")
    )
    renames = {f"{n}_value": n for n in names} | {f"{n}_vintage": f"{n}__vintage_id" for n in names}
    return wide.withColumnsRenamed(renames)
