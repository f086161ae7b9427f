"""Daily portfolio returns: asset moves, financing and trading costs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.probability import array_sum
from panelloom.operators.allocation import ASSETS, gross
from panelloom.operators.returns import TRADING_DAYS

BASIS_POINT = 1e-4


@dataclass(frozen=True)
class Costs:
    proportional_bps: float = 5.0
    impact_bps: float = 2.0
    bid_ask_bps: float = 1.0
    smallest_trade: float = 0.001


def pack_returns(returns: DataFrame, assets: Sequence[str] = ASSETS, ret: str = "ret") -> DataFrame:
    """(dt, r): one row per day with the asset returns in weight order.

    A portfolio day then needs one lookup by date instead of one per asset, and
    the packed side has a row per calendar day.
    """
    return returns.groupBy("dt").agg(
        F.array(*[F.max(F.when(F.col("asset") == a, F.col(ret))) for a in assets]).alias("r")
    )


def dot(w: Column, r: Column) -> Column:
    """Sum of weight times return; an asset without a return adds nothing."""
    return array_sum(F.zip_with(w, r, lambda a, b: a * F.coalesce(b, F.lit(0.0))))


def financing(w: Column, risk_free: float, spread_bps: float = 0.0) -> Column:
    """Only the part of gross exposure above one is borrowed."""
    daily = risk_free / TRADING_DAYS + spread_bps * BASIS_POINT / TRADING_DAYS
    return F.greatest(gross(w) - 1.0, F.lit(0.0)) * daily


def trading_cost(before: Column, after: Column, costs: Costs = Costs()) -> Column:
    """Proportional, square-root impact and fixed cost of every sizeable trade."""
    moves = F.zip_with(after, before, lambda a, b: F.abs(a - b))

    def one(move: Column) -> Column:
        bps = move * costs.proportional_bps + F.sqrt(move) * costs.impact_bps + costs.bid_ask_bps
        return F.when(move >= costs.smallest_trade, bps * BASIS_POINT).otherwise(0.0)

    return array_sum(F.transform(moves, one))


def annual_drag(turnover: Column, per_year: Column, costs: Costs = Costs()) -> Column:
    bps = turnover * costs.proportional_bps + F.sqrt(turnover) * costs.impact_bps + costs.bid_ask_bps
    return bps * BASIS_POINT * per_year


def previous_held(df: DataFrame, key: Sequence[str], baseline: Column, held: str = "held") -> DataFrame:
    before = F.lag(held).over(Window.partitionBy(*key).orderBy("dt"))
    return df.withColumn("held_before", F.coalesce(before, baseline))


def daily_pnl(
    held: DataFrame, packed: DataFrame, key: Sequence[str], risk_free: float = 0.04,
    spread_bps: float = 0.0, costs: Costs = Costs(), before: str = "held_before",
) -> DataFrame:
    """Gross return, financing, cost and net return of every portfolio day."""
    joined = held.join(packed, "dt", "left")
    w = F.col("held")
    empty = F.transform(w, lambda x: F.lit(0.0))
    moved = dot(w, F.coalesce("r", empty))
    cost = F.when(F.col("do_rebalance"), trading_cost(F.col(before), w, costs)).otherwise(0.0)
    return joined.select(
        *key, "dt", moved.alias("asset_ret"), financing(w, risk_free, spread_bps).alias("financing"),
        cost.alias("cost"),
    ).withColumn("ret", F.col("asset_ret") - F.col("financing") - F.col("cost"))
