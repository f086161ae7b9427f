"""Walk-forward folds over a numbered calendar."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.operators.asof import calendar, numbered


@dataclass(frozen=True)
class FoldPlan:
    train: int = 756
    step: int = 63
    refit_every: int = 63
    expanding: bool = True

    @property
    def refit_folds(self) -> int:
        return max(1, self.refit_every // self.step)


def positions(df: DataFrame, date: str = "dt") -> DataFrame:
    """(dt, i, n_days) with i counted from zero."""
    return numbered(calendar(df, date)).select("dt", (F.col("pos") - 1).alias("i"), "n_days")


def test_days(days: DataFrame, plan: FoldPlan) -> DataFrame:
    """(dt, fold, model_fold, opens): each day after the first training window."""
    offset = F.col("i") - plan.train
    fold = F.floor(offset / plan.step).cast("int")
    model = (F.floor(F.col("fold") / plan.refit_folds) * plan.refit_folds).cast("int")
    return (
        days.where(F.col("i") >= plan.train)
        .withColumn("fold", fold)
        .select("dt", "fold", model.alias("model_fold"), (offset % plan.step == 0).alias("opens"))
    )


def train_days(days: DataFrame, plan: FoldPlan) -> DataFrame:
    """(dt, fold): every fold whose training window holds the day.

    The folds of a day form one range, computed from its position; nothing is
    compared pairwise.
    """
    first = F.greatest(F.lit(0), F.floor((F.col("i") - plan.train) / plan.step).cast("int") + 1)
    final = F.floor((F.col("n_days") - 1 - plan.train) / plan.step).cast("int")
    last = final if plan.expanding else F.least(final, F.floor(F.col("i") / plan.step).cast("int"))
    return (
        days.withColumn("first", first)
        .withColumn("last", last)
        .where(F.col("first") <= F.col("last"))
        .select("dt", F.explode(F.sequence("first", "last")).alias("fold"))
    )


def last_train_days(days: DataFrame, plan: FoldPlan) -> DataFrame:
    """(dt, fold): the day before each refitted fold's test days."""
    after = F.col("i") + 1 - plan.train
    fold = F.floor(after / plan.step).cast("int")
    opens = (after >= 0) & (after % plan.step == 0) & (F.col("i") + 1 < F.col("n_days"))
    return days.where(opens).withColumn("fold", fold).where(F.col("fold") % plan.refit_folds == 0).select("dt", "fold")


def fold_table(days: DataFrame, plan: FoldPlan) -> DataFrame:
    """(fold, train_start, train_end, test_start, test_end, refit)."""
    trained = train_days(days, plan).groupBy("fold").agg(
        F.min("dt").alias("train_start"), F.max("dt").alias("train_end")
    )
    tested = test_days(days, plan).groupBy("fold", "model_fold").agg(
        F.min("dt").alias("test_start"), F.max("dt").alias("test_end")
    )
    return trained.join(tested, "fold").select(
        "fold", "train_start", "train_end", "test_start", "test_end",
        (F.col("fold") == F.col("model_fold")).alias("refit"),
    )
