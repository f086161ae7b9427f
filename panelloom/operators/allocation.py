"""Regime probabilities to constrained portfolio weights.

A portfolio's weights on one day are one ARRAY<DOUBLE> in a fixed asset order.
Blending, caps and exposure rules are then expressions within a row and need no
shuffle; the only sequential part is the rebalance path of one portfolio.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.functions.probability import array_sum, argmax_state, distance, let, max_prob, vector

# Asset order, target weights per regime and the neutral weights.
ASSETS = ("US10Y", "US2Y", "GOLD", "USD_index", "SP500", "OIL", "CARRY_ETF", "TIPS")
REGIME_WEIGHTS = {
    "Easing": (0.30, 0.10, 0.20, -0.15, -0.05, -0.10, -0.10, 0.25),
    "Reacceleration": (-0.20, -0.15, -0.05, 0.10, 0.30, 0.20, 0.20, -0.05),
    "Stagflation": (-0.20, -0.10, 0.25, 0.10, -0.15, 0.30, -0.10, 0.10),
    "Risk-Off": (0.30, 0.15, 0.20, 0.10, -0.25, -0.15, -0.20, 0.15),
}
BASELINE_WEIGHTS = (0.10, 0.05, 0.05, 0.00, 0.10, 0.00, 0.05, 0.05)
MAX_VOL_SCALE = 3.0


def regime_vectors(regimes: Sequence[str], table: dict | None = None) -> list[tuple[float, ...]]:
    table = table or REGIME_WEIGHTS
    unknown = [name for name in regimes if name not in table]
    if unknown:
        raise KeyError(f"unknown regimes {unknown}; known: {sorted(table)}")
    return [tuple(table[name]) for name in regimes]


def same_length(p: Column, n: int, value: Column) -> Column:
    message = F.concat(F.lit(f"expected {n} probabilities, got "), F.size(p).cast("string"))
    return F.when(F.size(p) == n, value).otherwise(F.raise_error(message).cast("array<double>"))


def soft_weights(p: Column, regimes: Sequence[str], table: dict | None = None) -> Column:
    """Probability-weighted blend of the regime weights."""
    rows = regime_vectors(regimes, table)
    blended = F.array(*[
        sum((p[k] * F.lit(float(row[i])) for k, row in enumerate(rows)), F.lit(0.0))
        for i in range(len(rows[0]))
    ])
    return same_length(p, len(rows), blended)


def weights_by_label(p: Column, regimes: Column, table: dict | None = None) -> Column:
    """As `soft_weights`, with the regimes of the row's own model in a column; a label may name several states."""
    table = table or REGIME_WEIGHTS
    vectors = F.create_map(*[x for name, row in table.items() for x in (F.lit(name), vector(row))])
    size = len(next(iter(table.values())))
    none = F.array_repeat(F.lit(0.0), size)
    parts = F.zip_with(p, regimes, lambda share, name: F.transform(F.try_element_at(vectors, name), lambda w: w * share))
    return F.aggregate(parts, none, lambda total, part: F.zip_with(total, part, lambda a, b: a + b))


def hard_weights(
    p: Column, regimes: Sequence[str], threshold: float = 0.5, table: dict | None = None,
    baseline: Sequence[float] = BASELINE_WEIGHTS,
) -> Column:
    """Weights of the most likely regime, or the baseline while nothing is likely enough."""
    rows = regime_vectors(regimes, table)
    chosen = F.array(*[vector(row) for row in rows])[argmax_state(p)]
    picked = F.when(max_prob(p) >= threshold, chosen).otherwise(vector(baseline))
    return same_length(p, len(rows), picked)


def gross(w: Column) -> Column:
    return array_sum(F.transform(w, lambda x: F.abs(x)))


def scale(w: Column, factor: Column) -> Column:
    return F.transform(w, lambda x: x * factor)


def cap_each(w: Column, max_weight: float, floor: float | None = None) -> Column:
    low = -max_weight if floor is None else floor
    return F.transform(w, lambda x: F.greatest(F.lit(float(low)), F.least(F.lit(float(max_weight)), x)))


def cap_gross(w: Column, max_leverage: float) -> Column:
    def capped(v: Column, total: Column) -> Column:
        factor = F.when(total > max_leverage, F.lit(float(max_leverage)) / total).otherwise(F.lit(1.0))
        return let(factor, lambda f: scale(v, f))

    return let(w, lambda v: let(gross(v), lambda total: capped(v, total)))


def cap_turnover(w: Column, previous: Column, cap: Column | float) -> Column:
    """Move only cap / turnover of the way when the full L1 move exceeds the cap."""
    limit = cap if isinstance(cap, Column) else F.lit(float(cap))

    def moved(v: Column, before: Column, size: Column) -> Column:
        part = F.zip_with(v, before, lambda a, b: b + limit / size * (a - b))
        return F.when(size > limit, part).otherwise(v)

    def sized(v: Column, before: Column) -> Column:
        size = array_sum(F.zip_with(v, before, lambda a, b: F.abs(a - b)))
        return let(size, lambda s: moved(v, before, s))

    return let(w, lambda v: let(previous, lambda before: sized(v, before)))


def constrain(w: Column, max_weight: float = 0.40, max_leverage: float = 2.0) -> Column:
    return cap_gross(cap_each(w, max_weight), max_leverage)


def volatility_target(w: Column, estimate: Column, target: float = 0.08) -> Column:
    factor = F.least(F.lit(target) / estimate, F.lit(MAX_VOL_SCALE))
    return let(F.when(estimate > 0, factor).otherwise(F.lit(1.0)), lambda f: scale(w, f))


def exposure_policy(
    w: Column, long_only: bool = False, target_net: float | None = None,
    max_weight: float = 0.40, max_leverage: float = 2.0,
) -> Column:
    """Optional long-only floor and net target, then the weight and gross caps."""
    if long_only:
        w = F.transform(w, lambda x: F.greatest(x, F.lit(0.0)))
    if target_net is not None:
        def to_net(v: Column, net: Column) -> Column:
            factor = F.when(F.abs(net) > 1e-9, F.lit(float(target_net)) / net).otherwise(F.lit(1.0))
            return let(factor, lambda f: scale(v, f))

        floored = w
        w = let(floored, lambda v: let(array_sum(v), lambda net: to_net(v, net)))
    return cap_gross(cap_each(w, max_weight, 0.0 if long_only else None), max_leverage)


# The texts of a decision, with the signs as they are recorded.
FORCED = "Forced"
SURPRISED = "Surprise-triggered (score=%.2f, dist=%.4f<Î¸)"
SHIFTED = "Distribution shift {metric}=%.4f > Î¸=%.4f"
QUIET = "No rebalance ({metric}=%.4f â‰¤ Î¸=%.4f)"


def reason_formats(metric: str) -> tuple[str, str, str]:
    return SURPRISED, SHIFTED.format(metric=metric), QUIET.format(metric=metric)


def decide(
    df: DataFrame, previous: str, current: str, threshold: float = 0.10, metric: str = "jsd",
    surprise: Column | None = None, surprise_threshold: float = 1.5,
) -> DataFrame:
    """Distance, surprise flag, decision and its reason for (previous, current) pairs."""
    score = surprise if surprise is not None else F.lit(0.0)
    scored = df.withColumn("distance", distance(F.col(previous), F.col(current), metric))
    far = F.col("distance") > threshold
    scored = scored.withColumn("surprise_triggered", F.abs(score) >= surprise_threshold)
    surprised, shifted, quiet = reason_formats(metric)
    reason = (
        F.when(F.col("surprise_triggered") & ~far, F.format_string(surprised, score, "distance"))
        .when(far, F.format_string(shifted, "distance", F.lit(float(threshold))))
        .otherwise(F.format_string(quiet, "distance", F.lit(float(threshold))))
    )
    return scored.withColumn("do_rebalance", far | F.col("surprise_triggered")).withColumn("reason", reason)


def lag_signal(probs: DataFrame, key: Sequence[str], p: str = "p") -> DataFrame:
    """Trade each day on the previous day's probabilities."""
    before = F.lag(p).over(Window.partitionBy(*key).orderBy("dt"))
    return probs.withColumn("trade_p", before).where(F.col("trade_p").isNotNull())


def _divergence(p: list[float], q: list[float], metric: str) -> float:
    """Distance of two short probability lists; plain floats beat tiny arrays here."""
    if metric == "l1":
        return sum(abs(a - b) for a, b in zip(p, q))
    total = 0.0
    for a, b in zip(p, q):
        middle = (a + b) / 2 + 1e-12
        if a > 1e-12:
            total += a * math.log(a / middle)
        if b > 1e-12:
            total += b * math.log(b / middle)
    return total / 2


def rebalance_path(
    df: DataFrame, key: Sequence[str], metric: str = "jsd", surprise_threshold: float = 1.5,
    baseline: Sequence[float] = BASELINE_WEIGHTS,
) -> DataFrame:
    """Follow each portfolio through time, rebalancing when its signal has moved.

    `df` has the key columns and dt, trade_p, target (the constrained target
    weights), surprise, force, theta and turnover_cap. The distance is taken from
    the signal at the last rebalance and turnover from the weights now held, so
    the days of one key must be walked in order. A key has one row per day of the
    calendar (checked), which bounds the group; portfolios and parameter sets are
    separate keys and run in parallel.
    """
    if metric not in ("jsd", "l1"):
        raise ValueError(f"unknown metric {metric!r}")
    kept = list(key)
    start = [float(v) for v in baseline]
    forced_text = FORCED
    surprise_text, shift_text, quiet_text = reason_formats(metric)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dt", kind="stable")
        if pdf["dt"].duplicated().any():
            raise ValueError("rebalance_path needs one row per key and day")
        signals = [p.tolist() for p in pdf["trade_p"]]
        targets = [w.tolist() for w in pdf["target"]]
        scores, forced = pdf["surprise"].tolist(), pdf["force"].tolist()
        theta, cap = float(pdf["theta"].iloc[0]), pdf["turnover_cap"].iloc[0]
        cap = math.inf if cap is None or pd.isna(cap) else float(cap)
        anchor, held = signals[0], start
        rows = []
        for p, target, score, force in zip(signals, targets, scores, forced):
            gap, surprised, reason = 0.0, False, forced_text
            if not force:
                gap = _divergence(anchor, p, metric)
                surprised = abs(score) >= surprise_threshold
                if surprised and gap <= theta:
                    reason = surprise_text % (score, gap)
                else:
                    reason = (shift_text if gap > theta else quiet_text) % (gap, theta)
            trade = bool(force or gap > theta or surprised)
            before = held
            if trade:
                move = sum(abs(t - h) for t, h in zip(target, held))
                held = target
                if move > cap:
                    held = [h + cap / move * (t - h) for t, h in zip(target, before)]
                anchor = p
            top = max(p)
            rows.append((trade, reason, gap, surprised, top, p.index(top), held, before))
        names = ["do_rebalance", "reason", "distance", "surprise_triggered", "max_prob", "dominant_state", "w", "w_before"]
        out = pd.DataFrame(rows, columns=names)
        for name in [*kept, "dt"]:
            out[name] = pdf[name].to_numpy()
        return out[[*kept, "dt", *names]]

    fields = [df.schema[name] for name in [*kept, "dt"]]
    schema = T.StructType([
        *fields,
        T.StructField("do_rebalance", T.BooleanType()),
        T.StructField("reason", T.StringType()),
        T.StructField("distance", T.DoubleType()),
        T.StructField("surprise_triggered", T.BooleanType()),
        T.StructField("max_prob", T.DoubleType()),
        T.StructField("dominant_state", T.IntegerType()),
        T.StructField("w", T.ArrayType(T.DoubleType())),
        T.StructField("w_before", T.ArrayType(T.DoubleType())),
    ])
    needed = [*kept, "dt", "trade_p", "target", "surprise", "force", "theta", "turnover_cap"]
    # The lag before this deals rows by portfolio alone, which would also serve the grouping: deal by the whole key instead,
    # so that the settings of one portfolio are walked by different tasks.
    return df.select(*needed).repartition(*kept).groupBy(*kept).applyInPandas(walk, schema)


def decision_log(path: DataFrame, key: Sequence[str]) -> DataFrame:
    return path.select(
        *key, "dt", "do_rebalance", "reason", F.round("distance", 6).alias("distance"), "surprise_triggered",
        F.round("max_prob", 4).alias("max_prob"), "dominant_state",
    )


def held_weights(df: DataFrame, key: Sequence[str], proposed: str = "proposed") -> DataFrame:
    """Weights change on rebalance days only and are carried in between."""
    so_far = Window.partitionBy(*key).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.when(F.col("do_rebalance"), F.col(proposed))
    return df.withColumn("held", F.last(fresh, True).over(so_far))


def explode_weights(df: DataFrame, key: Sequence[str], w: str = "w", assets: Sequence[str] = ASSETS) -> DataFrame:
    """Array weights to long rows (key, dt, asset, w)."""
    names = F.array(*[F.lit(a) for a in assets])
    return df.select(*key, "dt", F.inline(F.arrays_zip(names.alias("asset"), F.col(w).alias("w"))))
