"""Report tables: the data behind each chart, ready to draw."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.scalars import clip
from panelloom.operators import returns as R

HISTOGRAM_BINS = 60


def returns_nav_events(returns: DataFrame, states: DataFrame, log: DataFrame, key: Sequence[str], mode: str = "log") -> DataFrame:
    """Cumulative return, NAV, signal and its means, trade and regime-change flags."""
    curve = R.net_asset_value(returns, key)
    curve = R.signal_means(R.signal(curve, key, mode), key)
    changed = R.change_points(states, key, "state").select(*key, "dt", "changed")
    trades = log.select(*key, "dt", "do_rebalance")
    joined = curve.join(changed, [*key, "dt"], "left").join(trades, [*key, "dt"], "left")
    return joined.select(
        *key, "dt", (F.col("nav") - 1).alias("cumulative_return"), "nav", "signal", "mean_21", "mean_63",
        F.coalesce("changed", F.lit(False)).alias("regime_change"),
        F.coalesce("do_rebalance", F.lit(False)).alias("trade"),
    )


def underwater(returns: DataFrame, key: Sequence[str]) -> DataFrame:
    curve = R.rolling_risk(R.net_asset_value(returns, key), key)
    return curve.select(*key, "dt", "drawdown", "vol", "sharpe")


def probability_stack(regimes: DataFrame, key: Sequence[str], p: str = "p") -> DataFrame:
    """Clipped probabilities, one row per state, with the state path."""
    long = regimes.select(*key, "dt", "state", F.posexplode(p).alias("k", "raw"))
    return long.withColumn("prob", clip(F.coalesce("raw", F.lit(0.0)), 0.0, 1.0)).drop("raw")


def weight_diagnostics(weights: DataFrame, key: Sequence[str]) -> DataFrame:
    """Gross, net and L1 turnover per day from long weights (key, dt, asset, w)."""
    before = F.lag("w").over(Window.partitionBy(*key, "asset").orderBy("dt"))
    moved = weights.withColumn("moved", F.abs(F.col("w") - before))
    return moved.groupBy(*key, "dt").agg(
        F.sum(F.abs("w")).alias("gross"), F.sum("w").alias("net"),
        F.coalesce(F.sum("moved"), F.lit(0.0)).alias("turnover"),
    )


def top_assets(weights: DataFrame, key: Sequence[str], n: int = 10) -> DataFrame:
    """Assets with the largest mean absolute weight; names break ties."""
    mean = weights.groupBy(*key, "asset").agg(F.avg(F.abs("w")).alias("mean_abs"))
    order = Window.partitionBy(*key).orderBy(F.desc("mean_abs"), "asset")
    return mean.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def rebalance_series(log: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distance, trigger height and confidence of every decision."""
    distance = F.coalesce("distance", F.lit(0.0))
    return log.select(
        *key, "dt", distance.alias("distance"), F.when(F.col("do_rebalance"), distance).alias("trigger"),
        "max_prob", F.when(F.col("surprise_triggered"), F.lit(1.0)).alias("surprise_mark"),
    )


def labelled_returns(returns: DataFrame, states: DataFrame, key: Sequence[str]) -> DataFrame:
    return returns.join(states.select(*key, "dt", "label"), [*key, "dt"]).dropna(subset=["ret", "label"])


def box_statistics(labelled: DataFrame, key: Sequence[str]) -> DataFrame:
    found = F.percentile("ret", [0.05, 0.25, 0.5, 0.75, 0.95])
    stats = labelled.groupBy(*key, "label").agg(
        found.alias("q"), F.avg("ret").alias("mean"), F.min("ret").alias("low"),
        F.max("ret").alias("high"), F.count(F.lit(1)).alias("n"),
    )
    names = ["q05", "q25", "median", "q75", "q95"]
    return stats.select(*key, "label", *[F.col("q")[i].alias(x) for i, x in enumerate(names)], "mean", "low", "high", "n")


def histogram(returns: DataFrame, key: Sequence[str], bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width counts; the top edge belongs to the last bin."""
    edges = returns.groupBy(*key).agg(F.min("ret").alias("low"), F.max("ret").alias("high"))
    placed = returns.join(edges, list(key))
    bucket = F.least(F.width_bucket("ret", "low", "high", F.lit(bins)), F.lit(bins))
    return placed.groupBy(*key, bucket.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
