"""Names for fitted states, from the feature means of each state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions import probability as PF
from panelloom.operators.performance import state_shares

# Feature groups, label weights (in order of preference on a tie), label texts.
FEATURE_GROUPS = {
    "rates_direction": ["ret_US10Y", "ret_GER10Y", "ret_UK10Y", "ma5_US10Y", "ma20_US10Y"],
    "growth_assets": ["ret_SP500", "ret_OIL", "ret_CARRY_ETF", "ma5_SP500"],
    "safe_havens": ["ret_GOLD", "ret_US2Y", "ret_TIPS"],
    "fx_usd": ["ret_USD_index", "gold_vs_usd"],
    "cot_bonds": ["cot_z_bonds"],
    "cot_equities": ["cot_z_sp500"],
    "cot_commodities": ["cot_z_oil", "cot_z_gold"],
    "cut_probability": ["fw_prob_cut_1m", "fw_prob_cut_3m", "fw_net_cut_bias"],
    "hike_risk": ["fw_prob_hike_1m"],
    "policy_uncert": ["fw_policy_uncertainty"],
}
LABEL_WEIGHTS = {
    "aggressive_easing": {
        "rates_direction": 1.5, "safe_havens": 1.0, "cut_probability": 2.0,
        "growth_assets": -0.5, "hike_risk": -1.0, "cot_bonds": 1.0,
    },
    "reacceleration": {
        "growth_assets": 2.0, "cot_equities": 1.5, "cot_commodities": 0.8,
        "cut_probability": -1.0, "hike_risk": 0.5, "rates_direction": -1.0,
    },
    "stagflation": {
        "cot_commodities": 2.0, "rates_direction": -1.5, "growth_assets": -1.0,
        "hike_risk": 2.0, "fx_usd": 0.5,
    },
    "risk_off_deflation": {
        "safe_havens": 2.0, "cot_bonds": 1.5, "cot_equities": -2.0,
        "growth_assets": -1.5, "fx_usd": 0.8,
    },
}
LABEL_TEXTS = {
    "aggressive_easing": ("Easing", "Market pricing: aggressive rate cuts imminent"),
    "reacceleration": (
        "Reacceleration", "Positioning implies: growth reacceleration, cuts repriced out",
    ),
    "stagflation": (
        "Stagflation",
        "Market pricing: stagflationary pressure — commodities strong, rates under pressure",
    ),
    "risk_off_deflation": (
        "Risk-Off", "Positioning implies: risk-off / deflation scare — flight to safe havens",
    ),
}


def group_scores(means: DataFrame, key: Sequence[str], groups: dict | None = None) -> DataFrame:
    """One row per state: mean of the available features of each group, 0 without any."""
    groups = groups or FEATURE_GROUPS
    scores = [
        F.coalesce(F.avg(F.when(F.col("feature").isin(names), F.col("mu"))), F.lit(0.0)).alias(group)
        for group, names in groups.items()
    ]
    used = F.count_if(F.col("feature").isin([f for names in groups.values() for f in names]) & F.col("mu").isNotNull())
    return means.groupBy(*key).agg(*scores, used.alias("n_features"))


def label_scores(scores: DataFrame, weights: dict | None = None) -> DataFrame:
    weights = weights or LABEL_WEIGHTS
    return scores.withColumns({
        label: sum((F.col(group) * w for group, w in parts.items()), F.lit(0.0))
        for label, parts in weights.items()
    })


def assign(means: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, label, description, four scores, n_features) for every state."""
    scored = label_scores(group_scores(means, key))
    choices = F.array(*[
        F.struct(
            F.col(name).alias("score"), F.lit(-i).alias("rank"),
            F.lit(LABEL_TEXTS[name][0]).alias("label"), F.lit(LABEL_TEXTS[name][1]).alias("description"),
        )
        for i, name in enumerate(LABEL_WEIGHTS)
    ])
    best = F.array_max(choices)
    return scored.withColumn("best", best).select(
        *key, "best.label", "best.description", *[F.round(n, 3).alias(n) for n in LABEL_WEIGHTS], "n_features"
    )


def supporting_features(means: DataFrame, key: Sequence[str], n: int = 5) -> DataFrame:
    """The n features of each state with the largest absolute mean."""
    order = Window.partitionBy(*key).orderBy(F.desc(F.abs("mu")), "feature")
    ranked = means.where(F.col("mu").isNotNull()).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= n)


def discriminating_features(means: DataFrame, key: Sequence[str], states: Sequence[int], n: int = 8) -> DataFrame:
    """Features whose state means differ most, with those means side by side."""
    stats = Window.partitionBy(*key, "feature")
    spread = F.greatest(F.stddev_pop("mu").over(stats), F.lit(1e-9))
    away = means.withColumn("gap", F.abs((F.col("mu") - F.avg("mu").over(stats)) / spread))
    table = away.groupBy(*key, "feature").agg(
        *[F.max(F.when(F.col("state") == s, F.col("mu"))).alias(f"S{s}_z") for s in states],
        F.avg("gap").alias("discrimination"),
    )
    order = Window.partitionBy(*key).orderBy(F.desc("discrimination"), "feature")
    return table.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def describe(decoded: DataFrame, k: int, labels: DataFrame | None = None, temperature: float = 1.0) -> DataFrame:
    """p_0.., state, label, max_prob and entropy of decoded rows."""
    hot = decoded.withColumn("p", PF.temper(F.col("p"), temperature))
    if temperature > 1.0:
        hot = hot.withColumn("state", PF.argmax_state(F.col("p")))
    if labels is not None:
        hot = hot.join(labels.select("state", "label"), "state", "left")
    kept = [c for c in hot.columns if c != "p"]
    return hot.select(
        *kept, *[F.col("p")[i].alias(f"p_{i}") for i in range(k)],
        PF.max_prob(F.col("p")).alias("max_prob"), PF.entropy(F.col("p")).alias("entropy"),
    )


def state_summary(decoded: DataFrame, means: DataFrame, key: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Per state: share of rows and the mean of every named feature."""
    wide = means.groupBy(*key, "state").pivot("feature", list(features)).agg(F.max("mu"))
    return state_shares(decoded, key, "state").join(wide, [*key, "state"], "left")


def state_means(values: DataFrame, states: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, state, feature, mu) from scaled feature rows and dated states."""
    return values.join(states, "dt").groupBy(*key, "state", "feature").agg(F.avg("value").alias("mu"))
