"""Additive shocks on named features, all scenarios in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scenario:
    name: str
    description: str = ""
    shocks: dict[str, float] = field(default_factory=dict)
    start: str | None = None
    end: str | None = None


# The built-in scenarios.
SCENARIOS = {
    s.name: s
    for s in (
        Scenario(
            "rates_shock_+200bps", "Parallel shift up 200bps in all rate features",
            {"ret_US10Y": 2.0, "ret_US2Y": 2.0},
        ),
        Scenario(
            "risk_off", "Equity crash + flight-to-quality",
            {"ret_SP500": -3.0, "ret_GOLD": 2.0, "ret_US10Y": -1.5},
        ),
        Scenario(
            "hawkish-surprise", "Sudden hawkish pivot: rates spike, equities sell off, gold weakens",
            {"ret_US10Y": 3.0, "ret_US2Y": 4.0, "ret_SP500": -2.0, "ret_GOLD": -1.0, "fw_net_cut_bias": -0.5},
        ),
    )
}


def find(name: str, registry: dict[str, Scenario] | None = None) -> Scenario:
    registry = registry or SCENARIOS
    if name not in registry:
        raise KeyError(f"unknown scenario {name!r}; known: {sorted(registry)}")
    return registry[name]


def scenario_table(spark, scenarios: Sequence[Scenario]) -> DataFrame:
    rows = [(s.name, f, float(v), s.start, s.end) for s in scenarios for f, v in s.shocks.items()]
    return spark.createDataFrame(rows, "scenario string, feature string, shock double, start string, end string")


def apply_shocks(panel: DataFrame, scenarios: Sequence[Scenario]) -> DataFrame:
    """One copy of the panel per scenario, with its shocks added."""
    copies = []
    for s in scenarios:
        shock = F.lit(0.0)
        for feature, size in s.shocks.items():
            shock = F.when(F.col("feature") == feature, F.lit(float(size))).otherwise(shock)
        if s.start:
            shock = F.when(F.col("dt") >= F.lit(s.start).cast("date"), shock).otherwise(0.0)
        if s.end:
            shock = F.when(F.col("dt") <= F.lit(s.end).cast("date"), shock).otherwise(0.0)
        copies.append(F.struct(F.lit(s.name).alias("scenario"), (F.col("value") + shock).alias("value")))
    kept = [c for c in panel.columns if c != "value"]
    return panel.select(*kept, F.inline(F.array(*copies)))
