"""Return, risk and rebalance metrics per portfolio."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.scalars import ratio
from panelloom.operators.returns import TRADING_DAYS, net_asset_value, run_lengths


def state_shares(df: DataFrame, key: Sequence[str], state: str) -> DataFrame:
    """(key, state, n, share): normalised frequency of each state."""
    counts = df.groupBy(*key, state).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*key))
    return counts.withColumn("share", F.col("n") / total)


def positive_or(value: Column, when: Column, default: float = 0.0) -> Column:
    return F.when(when, value).otherwise(F.lit(default))


def quantiles(df: DataFrame, key: Sequence[str], value: str, at: Sequence[float], exact: bool = True) -> DataFrame:
    """Linear-interpolated quantiles; `exact=False` uses the mergeable sketch."""
    points = [float(a) for a in at]
    found = F.percentile(value, points) if exact else F.approx_percentile(value, points, 10000)
    return df.groupBy(*key).agg(found.alias("q")).select(
        *key, *[F.col("q")[i].cast("double").alias(f"q{round(a * 100):02d}") for i, a in enumerate(points)]
    )


def drawdowns(df: DataFrame, key: Sequence[str], ret: str, date: str) -> DataFrame:
    return net_asset_value(df, key, ret, date)


def return_metrics(
    df: DataFrame, key: Sequence[str], ret: str = "ret", date: str = "dt",
    risk_free: float = 0.0, freq: int = TRADING_DAYS,
) -> DataFrame:
    """All return and tail metrics of each portfolio.

    One window pass (for the drawdown) and one aggregation; only the mean beyond
    the tail quantile needs the quantile first, so it is joined back.
    """
    daily_rf = risk_free / freq
    year = F.sqrt(F.lit(float(freq)))
    value = F.col(ret)
    nav = net_asset_value(df.where(value.isNotNull()), key, ret, date)
    base = nav.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_trading_days"),
        (F.product(1 + value) - 1).alias("total_return"),
        F.avg(ret).alias("mean"),
        F.stddev_samp(ret).alias("sd"),
        F.stddev_samp(F.when(value < daily_rf, value)).alias("downside"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg((value > 0).cast("double")).alias("hit_rate"),
        F.percentile(ret, [0.05, 0.95]).alias("q"),
    )
    tail = (
        nav.select(*key, ret)
        .join(base.select(*key, F.col("q")[0].alias("var_95")), list(key))
        .where(value <= F.col("var_95"))
        .groupBy(*key)
        .agg(F.avg(ret).alias("cvar_95"))
    )
    excess = F.col("mean") - daily_rf
    scored = base.join(tail, list(key), "left").withColumns({
        "cagr": F.pow(1 + F.col("total_return"), freq / F.col("n_trading_days")) - 1,
        "ann_vol": F.col("sd") * year,
        "sharpe": positive_or(excess / F.col("sd") * year, F.col("sd") > 0),
        "sortino": positive_or(excess / F.col("downside") * year, F.col("downside") > 0),
        "var_95": F.col("q")[0],
        "cvar_95": F.coalesce("cvar_95", F.lit(0.0)),
        "tail_ratio": positive_or(F.col("q")[1] / F.abs(F.col("q")[0]), F.col("q")[0] < 0),
    })
    calmar = positive_or(F.col("cagr") / F.abs("max_drawdown"), F.col("max_drawdown") < 0)
    return scored.withColumn("calmar", calmar).select(
        *key, "n_trading_days", "total_return", "cagr", "ann_vol", "sharpe", "sortino",
        "max_drawdown", "calmar", "hit_rate", "var_95", "cvar_95", "tail_ratio",
    )


def rebalance_metrics(log: DataFrame, key: Sequence[str], days: Column | None = None) -> DataFrame:
    """Counts and means over the decision log; forced decisions count as distance 0."""
    n = days if days is not None else F.count(F.lit(1))
    return log.groupBy(*key).agg(
        F.count_if("do_rebalance").alias("n_rebalances"),
        F.coalesce(ratio(n, F.count_if("do_rebalance")), F.lit(float("inf"))).alias("avg_rebal_freq_days"),
        F.avg("distance").alias("avg_jsd_distance"),
        F.count_if("surprise_triggered").alias("surprise_rebalances"),
        F.avg("max_prob").alias("avg_max_regime_prob"),
    )


def conditional_returns(
    returns: DataFrame, labels: DataFrame, key: Sequence[str], ret: str = "ret", date: str = "dt", freq: int = TRADING_DAYS
) -> DataFrame:
    joined = returns.join(labels.select(*key, date, "label"), [*key, date]).where(
        F.col("label").isNotNull() & F.col(ret).isNotNull()
    )
    return joined.groupBy(*key, "label").agg(
        F.avg(ret).alias("mean_daily_ret"),
        (F.avg(ret) * freq).alias("ann_ret"),
        (F.stddev_samp(ret) * F.sqrt(F.lit(float(freq)))).alias("vol"),
        F.count(F.lit(1)).alias("count"),
    )


def regime_durations(labels: DataFrame, key: Sequence[str], date: str = "dt") -> DataFrame:
    return run_lengths(labels, key, "label", date)


def alternate_metrics(
    returns: DataFrame, turnover: DataFrame, key: Sequence[str], ret: str = "ret", date: str = "dt", risk_free: float = 0.05
) -> DataFrame:
    """Second metric set: ratios on growth minus the risk-free rate, downside below zero."""
    year = F.sqrt(F.lit(float(TRADING_DAYS)))
    value = F.col(ret)
    nav = net_asset_value(returns.where(value.isNotNull()), key, ret, date)
    base = nav.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.product(1 + value).alias("growth"),
        (F.stddev_samp(ret) * year).alias("ann_vol"),
        (F.stddev_samp(F.when(value < 0, value)) * year).alias("downside"),
        F.min("drawdown").alias("max_drawdown"),
    ).withColumn("cagr", F.pow("growth", TRADING_DAYS / F.col("n_days")) - 1)
    excess = F.col("cagr") - risk_free
    traded = turnover.groupBy(*key).agg(F.avg("turnover").alias("avg_daily_turnover"))
    return base.join(traded, list(key), "left").select(
        *key, "n_days", "cagr", "ann_vol",
        F.when(F.col("ann_vol") > 0, excess / F.col("ann_vol")).alias("sharpe"),
        F.when(F.col("downside") > 0, excess / F.col("downside")).alias("sortino"),
        "max_drawdown",
        F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs("max_drawdown")).alias("calmar"),
        "avg_daily_turnover",
    )


def equal_weight_benchmark(returns: DataFrame, ret: str = "ret", date: str = "dt") -> DataFrame:
    return returns.groupBy(date).agg(F.avg(ret).alias("bench_ret"))


def versus_benchmark(
    returns: DataFrame, benchmark: DataFrame, key: Sequence[str], ret: str = "ret", date: str = "dt"
) -> DataFrame:
    """Benchmark growth, excess growth and information ratio of each portfolio."""
    joined = returns.join(benchmark, date, "left").withColumn("bench_ret", F.coalesce("bench_ret", F.lit(0.0)))
    active = F.col(ret) - F.col("bench_ret")
    year = F.sqrt(F.lit(float(TRADING_DAYS)))
    n = F.count(F.lit(1))
    sums = joined.groupBy(*key).agg(
        n.alias("n"),
        (F.product(1 + F.col("bench_ret")) - 1).alias("benchmark_total_return"),
        (F.product(1 + F.col(ret)) - 1).alias("total"),
        F.avg(active).alias("active_mean"),
        F.stddev_samp(active).alias("active_sd"),
    )
    power = TRADING_DAYS / F.col("n")
    bench = F.pow(1 + F.col("benchmark_total_return"), power) - 1
    own = F.pow(1 + F.col("total"), power) - 1
    return sums.select(
        *key, "benchmark_total_return", bench.alias("benchmark_cagr"), (own - bench).alias("alpha_cagr"),
        positive_or(F.col("active_mean") / F.col("active_sd") * year, F.col("active_sd") > 0).alias("information_ratio"),
    )
