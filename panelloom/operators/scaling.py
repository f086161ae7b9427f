"""Standard scaling with statistics taken from training rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.operators.folds import FoldPlan


def fit(train: DataFrame, key: Sequence[str], value: str = "value") -> DataFrame:
    """(key, mean, sd): sample deviation, with zero replaced by one."""
    sd = F.stddev_samp(value)
    return train.groupBy(*key).agg(
        F.avg(value).alias("mean"), F.when(sd == 0, 1.0).otherwise(sd).alias("sd")
    )


def transform(df: DataFrame, stats: DataFrame, key: Sequence[str], value: str = "value") -> DataFrame:
    """(x - mean) / sd; features without statistics are dropped, NULL stays NULL."""
    return df.join(stats, list(key)).withColumn(value, (F.col(value) - F.col("mean")) / F.col("sd")).drop("mean", "sd")


def expanding_fit(
    panel: DataFrame, days: DataFrame, plan: FoldPlan, key: Sequence[str], value: str = "value"
) -> DataFrame:
    """(key, fold, mean, sd) of every expanding fold from one pass over the panel.

    Rows are summed once per (key, step block); a running sum over the blocks then
    gives each fold's statistics, so a row is never repeated per fold. Values are
    shifted by the key's own average to keep the squares well conditioned.
    """
    if not plan.expanding:
        raise ValueError("expanding_fit needs an expanding plan")
    keys = list(key)
    centre = panel.groupBy(*keys).agg(F.avg(value).alias("centre"))
    block = F.greatest(F.lit(0), F.floor((F.col("i") - plan.train) / plan.step).cast("int") + 1)
    final = F.floor((F.col("n_days") - 1 - plan.train) / plan.step).cast("int")
    shifted = F.col(value) - F.col("centre")
    sums = (
        panel.join(days, "dt")
        .join(centre, keys)
        .withColumn("fold", block)
        .withColumn("final", final)
        .groupBy(*keys, "fold", "centre", "final")
        .agg(F.count(value).alias("n"), F.sum(shifted).alias("s"), F.sum(shifted * shifted).alias("ss"))
    )
    so_far = Window.partitionBy(*keys).orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)
    running = sums.select(
        *keys, "fold", "centre", "final",
        *[F.sum(c).over(so_far).alias(c) for c in ("n", "s", "ss")],
        F.lead("fold").over(Window.partitionBy(*keys).orderBy("fold")).alias("after"),
    )
    # A fold without new rows of the key keeps the sums of the fold before it.
    spread = running.withColumn(
        "fold", F.explode(F.sequence("fold", F.greatest(F.col("fold"), F.coalesce(F.col("after") - 1, F.col("final")))))
    ).where(F.col("fold") <= F.col("final"))
    shift = F.col("s") / F.col("n")
    variance = (F.col("ss") - F.col("n") * shift * shift) / F.nullif(F.col("n") - 1, F.lit(0))
    sd = F.sqrt(F.greatest(variance, F.lit(0.0)))
    return spread.select(
        *keys, "fold", (F.col("centre") + shift).alias("mean"),
        F.when(sd == 0, 1.0).otherwise(sd).alias("sd"),
    )
