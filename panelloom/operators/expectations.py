"""Expectations on delivered rows: one pass that marks what each row fails, so that bad rows are set aside with their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from panelloom.session import stored

REASONS = "_reasons"


def marked(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows with the names of the rules they fail, in the order of the rules. A rule that gives no answer is failed."""
    failed = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return df.withColumn(REASONS, F.array_compact(failed) if rules else F.array().cast("array<string>"))


def split(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(good rows, rejected rows with their reasons, counts): rows, rejected, and those that fail each rule.

    The rows are stored once, and counted while they are written.
    """
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("rows"), F.count_if(F.size(REASONS) > 0).alias("rejected")]
    counts += [F.count_if(F.array_contains(REASONS, name)).alias(f"failed {name}") for name in rules]
    kept = stored(marked(df, rules).observe(seen, *counts), "marked-rows")
    return kept.where(F.size(REASONS) == 0).drop(REASONS), kept.where(F.size(REASONS) > 0), dict(seen.get)
