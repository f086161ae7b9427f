"""Data-quality checks: each returns the violating rows, or flags per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.schemas import DatasetSpec


class ValidationError(ValueError):
    pass


def require_columns(df: DataFrame, spec: DatasetSpec, reject_extra: bool = False) -> None:
    missing = [c for c in spec.columns if c not in df.columns]
    if missing:
        raise ValidationError(f"missing required columns: {missing}")
    extra = sorted(set(df.columns) - set(spec.columns))
    if reject_extra and extra and not spec.open_schema:
        raise ValidationError(f"unexpected columns: {extra}")


def column_report(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """(column, status): missing, unexpected or ok, with the row count of the frame."""
    status = {c: "ok" if c in df.columns else "missing" for c in spec.columns}
    status |= {c: "ok" if spec.open_schema else "unexpected" for c in df.columns if c not in status}
    points = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(s).alias("status")) for c, s in status.items()
    ])
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.inline(points))


def uncastable(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(column, n_bad) for every declared column, counted in one pass."""
    names = {"float64": "double", "int64": "double", "date": "date", "timestamp": "timestamp"}
    checked = [c for c, k in kinds.items() if k in names and c in df.columns]
    counts = df.agg(*[
        F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(names[kinds[c]]).isNull()).alias(c)
        for c in checked
    ])
    return counts.unpivot([], checked, "column", "n_bad")


def out_of_order(df: DataFrame, seq: str, date: str = "dt") -> DataFrame:
    """Delivered rows dated before the row delivered just ahead of them.

    The sequence number is consecutive, so the previous row is an equi-join away;
    no global window is needed.
    """
    ahead = df.select((F.col(seq) + 1).alias(seq), F.col(date).alias("previous"))
    return df.select(seq, date).join(ahead, seq).where(F.col(date) < F.col("previous"))


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing_series(present: DataFrame, critical: DataFrame, column: str = "series_id") -> DataFrame:
    return critical.join(present.select(column).distinct(), column, "left_anti")


def check_critical(present: DataFrame, critical: DataFrame, threshold: int = 0, column: str = "series_id") -> None:
    missing = missing_series(present, critical, column).count()
    if missing > threshold:
        raise ValidationError(f"critical series missing: {missing} > {threshold}")


def critical_threshold(vendor: str, from_file: bool, base: int = 0) -> int:
    """One vendor may miss a single series when its data comes from the vendor itself."""
    return max(base, 1) if vendor == "fred" and not from_file else base


def partition_values(df: DataFrame, column: str) -> DataFrame:
    """(n_values, value) of a frame that must hold a single partition."""
    return df.agg(F.count_distinct(column).alias("n_values"), F.min(column).alias("value"))


def mixed_partitions(df: DataFrame, target: str, column: str) -> DataFrame:
    """Write targets whose rows hold another value than the target key, or several."""
    held = F.col(column).cast("string")
    return (
        df.groupBy(target)
        .agg(F.min(held).alias("low"), F.max(held).alias("high"))
        .where((F.col("low") != F.col(target)) | (F.col("high") != F.col(target)))
    )


def bad_template_dates(df: DataFrame, first: str = "Date") -> DataFrame:
    """Rows whose first column is not a strict YYYY-MM-DD day."""
    if not df.columns or df.columns[0] != first:
        raise ValidationError(f"first column must be {first}")
    text = F.col(first).cast("string")
    ok = F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & text.try_cast("date").isNotNull(), F.lit(False))
    return df.where(~ok)


def null_share(df: DataFrame, key: Sequence[str], value: str, limit: float = 0.20) -> DataFrame:
    share = F.avg(F.col(value).isNull().cast("double"))
    return df.groupBy(*key).agg(share.alias("null_share")).withColumn("flagged", F.col("null_share") > limit)


def flat_features(df: DataFrame, key: Sequence[str], value: str, floor: float = 1e-8) -> DataFrame:
    return df.groupBy(*key).agg(F.stddev_samp(value).alias("sd")).where(F.col("sd") < floor)


def require_zoned(df: DataFrame, column: str) -> None:
    if not isinstance(df.schema[column].dataType, T.TimestampType):
        raise ValidationError(f"{column} must be a time-zone aware timestamp")


def rare_states(df: DataFrame, key: Sequence[str], state: str, minimum: float) -> DataFrame:
    """States whose share of rows is below the minimum."""
    from panelloom.operators.performance import state_shares

    return state_shares(df, key, state).where(F.col("share") < minimum)


def acceptance(metrics: DataFrame) -> DataFrame:
    gated = metrics.withColumns({
        "max_drawdown_ok": F.coalesce("max_drawdown", F.lit(0.0)) > -0.20,
        "state_confidence_not_collapsed": F.coalesce("avg_max_regime_prob", F.lit(1.0)) < 0.995,
        "enough_rebalances": F.coalesce("n_rebalances", F.lit(0)) >= 5,
    })
    passed = F.col("max_drawdown_ok") & F.col("state_confidence_not_collapsed") & F.col("enough_rebalances")
    return gated.withColumn("all_pass", passed)
