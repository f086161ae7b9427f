"""Weekly positioning reports: mapping, net positions and z-scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions.scalars import iso_week_key
from panelloom.operators.returns import rolling_zscore


def map_contracts(
    df: DataFrame, patterns: Sequence[tuple[str, str]], name: str = "contract"
) -> DataFrame:
    """Replace names by the id of the last pattern they contain; drop the rest.

    The patterns are configuration, so they travel as one literal array and the
    match stays a per-row expression without any join.
    """
    rules = F.array(*[
        F.struct(F.lit(pattern.upper()).alias("pattern"), F.lit(target).alias("target"))
        for pattern, target in patterns
    ])
    hits = F.filter(rules, lambda rule: F.contains(F.upper(F.col(name)), rule["pattern"]))
    mapped = F.try_element_at(hits, F.lit(-1))["target"]
    return df.withColumn(name, mapped).where(F.col(name).isNotNull())


def zscores(positions: DataFrame, lookback: int = 260) -> DataFrame:
    """(week, contract, group, net_pos, zscore) over each contract's own history."""
    keyed = positions.withColumn("week", iso_week_key(F.col("report_date")))
    scored = rolling_zscore(keyed, ["contract", "group"], "net_pos", lookback, 4, "report_date")
    return scored.select("week", "contract", "group", "net_pos", "zscore")
