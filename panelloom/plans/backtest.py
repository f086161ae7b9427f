"""From a probability panel to net returns, for any set of portfolios and settings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions.probability import temper, vector
from panelloom.operators import allocation as A
from panelloom.operators import folds, performance, pnl, quality
from panelloom.plans import scoring
from panelloom.session import stored


@dataclass(frozen=True)
class Setting:
    """One parameter set; every portfolio runs under each."""

    theta: float = 0.08
    turnover_cap: float = 0.30
    temperature: float = 1.0


# The sweep grid.
SWEEP = [
    Setting(theta, cap, temperature)
    for theta in (0.05, 0.10, 0.15)
    for cap in (0.10, 0.20, 0.30)
    for temperature in (1.0, 1.25)
]


@dataclass(frozen=True)
class Rules:
    regimes: tuple[str, ...] = ("Easing", "Reacceleration", "Stagflation", "Risk-Off")
    mode: str = "soft"
    confidence: float = 0.50
    metric: str = "jsd"
    surprise_threshold: float = 1.5
    max_leverage: float = 2.0
    max_weight: float = 0.40
    long_only: bool = False
    target_net: float | None = None
    risk_free: float = 0.04
    spread_bps: float = 0.0
    costs: pnl.Costs = pnl.Costs()
    # Compare a trade with the weights before exposure rules instead of those held.
    cost_before_policy: bool = False


def trade_rows(
    probs: DataFrame, key: Sequence[str], settings: Sequence[Setting], plan: folds.FoldPlan,
    rules: Rules = Rules(), surprise: Column | None = None, test_days: DataFrame | None = None,
) -> DataFrame:
    """One row per portfolio, setting and test day, with its target weights.

    A scored panel brings the signal to trade on (`trade_p`) and the labels of the model that
    scored the day (`regimes`); otherwise the day before's probabilities stand for fixed regimes.
    """
    lagged = probs.where(F.col("trade_p").isNotNull()) if "trade_p" in probs.columns else A.lag_signal(probs, key)
    days = test_days if test_days is not None else folds.test_days(folds.positions(probs), plan)
    grid = F.inline(F.array(*[
        F.struct(
            F.lit(i).alias("setting"), F.lit(float(s.theta)).alias("theta"),
            F.lit(float(s.turnover_cap)).alias("turnover_cap"), F.lit(float(s.temperature)).alias("temperature"),
        )
        for i, s in enumerate(settings)
    ]))
    rows = lagged.drop("fold").join(days.select("dt", "fold", F.col("opens").alias("force")), "dt")
    score = surprise if surprise is not None else F.lit(0.0)
    rows = rows.withColumn("surprise", score).select("*", grid)
    rows = rows.withColumn("trade_p", temper(F.col("trade_p"), F.col("temperature")))
    if "regimes" in rows.columns:
        raw = A.weights_by_label(F.col("trade_p"), F.col("regimes"))
    elif rules.mode == "soft":
        raw = A.soft_weights(F.col("trade_p"), rules.regimes)
    else:
        raw = A.hard_weights(F.col("trade_p"), rules.regimes, rules.confidence)
    return rows.withColumn("target", A.constrain(raw, rules.max_weight, rules.max_leverage))


def run_path(rows: DataFrame, key: Sequence[str], rules: Rules = Rules()) -> DataFrame:
    """Rebalance path and the weights held after the exposure rules."""
    keys = [*key, "setting"]
    path = A.rebalance_path(rows, keys, rules.metric, rules.surprise_threshold)
    policy = A.exposure_policy(
        F.col("w"), rules.long_only, rules.target_net, rules.max_weight, rules.max_leverage
    )
    held = A.held_weights(path.withColumn("proposed", policy), keys)
    return pnl.previous_held(held, keys, vector(A.BASELINE_WEIGHTS))


def net_returns(path: DataFrame, asset_returns: DataFrame, key: Sequence[str], rules: Rules = Rules()) -> DataFrame:
    packed = pnl.pack_returns(asset_returns)
    before = "w_before" if rules.cost_before_policy else "held_before"
    return pnl.daily_pnl(
        path, packed, [*key, "setting"], rules.risk_free, rules.spread_bps, rules.costs, before
    )


def end_to_end(
    rows: DataFrame, asset_returns: DataFrame, features: Sequence[str], plan: folds.FoldPlan, rules: Rules = Rules(),
    setting: Setting = Setting(), k: int = 4, restarts: int = 5, iterations: int = 200,
) -> tuple[DataFrame, DataFrame]:
    """(daily net returns, metrics with acceptance gates) from feature rows (series_id, dt, x), one portfolio per series.

    Fit per fold, label the states of each fit, blend weights by label, walk the rebalance path,
    charge costs and financing, and measure.
    """
    scored = stored(scoring.walk_forward(rows, plan, k, restarts, iterations, len(features), features=features), "scored")
    test_days = folds.test_days(folds.positions(rows), plan)
    key = ["portfolio"]
    probs = scored.select(F.col("series_id").alias("portfolio"), "dt", "trade_p", "regimes")
    path = stored(run_path(trade_rows(probs, key, [setting], plan, rules, test_days=test_days), key, rules), "path")
    daily = stored(net_returns(path, asset_returns, key, rules), "net-returns")
    decisions = path.groupBy("portfolio").agg(
        F.sum(F.col("do_rebalance").cast("long")).alias("n_rebalances"), F.avg("max_prob").alias("avg_max_regime_prob"))
    metrics = performance.return_metrics(daily, key, risk_free=rules.risk_free).join(decisions, "portfolio")
    return daily, quality.acceptance(metrics)


def rank_settings(metrics: DataFrame, settings: Sequence[Setting], top: int | None = None) -> DataFrame:
    """Settings by Sharpe ratio, then growth."""
    named = F.array(*[
        F.struct(F.lit(s.theta).alias("theta"), F.lit(s.turnover_cap).alias("turnover_cap"),
                 F.lit(s.temperature).alias("temperature")) for s in settings
    ])[F.col("setting")]
    ranked = metrics.withColumn("s", named).select("*", "s.*").drop("s").orderBy(F.desc("sharpe"), F.desc("cagr"))
    return ranked.limit(top) if top else ranked
