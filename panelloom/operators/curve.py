"""Rate curves: tenor picks and the policy features derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions.scalars import cut_probability
from panelloom.operators.asof import nearest

# Target tenors in days.
TENORS = (30, 90, 180, 365)


def policy_features(curve: DataFrame, key: str = "dt") -> DataFrame:
    """One row per curve day: two cut probabilities, front slope, terminal shift."""
    at = nearest(curve, [key, "source"], "tenor_days", "implied_rate", TENORS)
    front, three, six, far = (F.col(f"at_{t}") for t in TENORS)
    return at.select(
        key,
        cut_probability(three, front).alias("implied_cut_prob_3m"),
        cut_probability(six, front).alias("implied_cut_prob_6m"),
        (six - front).alias("term_front_slope"),
        (far - front).alias("terminal_shift_30d"),
        "source",
    )


def curve_from_probabilities(df: DataFrame, key: list[str]) -> DataFrame:
    """Four tenors from cut and hike probabilities, for every row at once."""
    bias = F.col("prob_hike_1m") - F.col("prob_cut_1m")
    change = F.col("implied_rate_chg_3m")
    gap = F.col("prob_cut_3m") - bias
    rates = {30: bias, 90: change, 180: change + gap * 0.5, 365: change + gap}
    points = F.array(*[
        F.struct(F.lit(t).cast("bigint").alias("tenor_days"), rate.alias("implied_rate"))
        for t, rate in rates.items()
    ])
    return df.select(*key, F.inline(points)).withColumn("source", F.lit("fedwatch"))


def policy_columns(features: DataFrame) -> DataFrame:
    """Drop the source, rename, add the net cut bias and the policy uncertainty."""
    renamed = features.drop("source").withColumnsRenamed({
        "implied_cut_prob_3m": "fw_prob_cut_3m",
        "implied_cut_prob_6m": "fw_prob_cut_6m",
        "term_front_slope": "fw_term_slope",
        "terminal_shift_30d": "fw_terminal_shift",
    })
    p = F.col("fw_prob_cut_3m")
    return renamed.withColumns({
        "fw_net_cut_bias": p - (1 - p),
        "fw_policy_uncertainty": 1 - F.abs(p),
    })
