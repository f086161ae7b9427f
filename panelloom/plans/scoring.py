"""Model fits and scores over a panel: one training frame, or every fold at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.probability import argmax_state
from panelloom.operators import folds, labels, mixture, scenarios, sequence, windowed
from panelloom.operators.performance import state_shares
from panelloom.session import stored


@dataclass
class Fitted:
    chain: sequence.Chain
    mixture: mixture.Mixture
    labels: DataFrame
    shares: DataFrame
    rare: DataFrame


def means_table(spark, chain: sequence.Chain, features: Sequence[str]) -> DataFrame:
    rows = [
        (k, name, float(chain.means[k][i])) for k in range(chain.k) for i, name in enumerate(features)
    ]
    return spark.createDataFrame(rows, "state int, feature string, mu double")


def fit_all(
    rows: DataFrame, features: Sequence[str], k: int = 4, restarts: int = 5, iterations: int = 200,
    mixture_restarts: int = 10, minimum_share: float = 0.02,
) -> Fitted:
    """Sequence model, mixture baseline, state labels, shares of the decoded states and the states seen too rarely.

    Rows are (series_id, dt, x), `features` the names of x's entries, after which states are labelled.
    """
    chain = sequence.fit(rows, k=k, restarts=restarts, iterations=iterations)
    flat = rows.withColumn("row_id", F.concat_ws("/", "series_id", "dt"))
    baseline = mixture.fit(flat, "row_id", "x", k=k, restarts=mixture_restarts)
    named = labels.assign(means_table(rows.sparkSession, chain, features), ["state"])
    shares = stored(state_shares(sequence.decode(rows, chain), ["grp"], "state").drop("grp"), "state-shares")
    return Fitted(chain, baseline, named, shares, shares.where(F.col("share") < minimum_share))


def fitted_states(spark, fitted: Fitted) -> DataFrame:
    """(model, state, weight, mu, sigma2, log_likelihood, label, share, rare): a row per state of the sequence model and class of the mixture.

    Labels, shares and rarity belong to the sequence model; a state never decoded has share 0 and is rare.
    """
    chain = sequence.parameter_table(spark, {0: fitted.chain}).select(
        F.lit("sequence").alias("model"), F.col("k").alias("state"), F.col("pi").alias("weight"), "mu", "sigma2", "log_likelihood")
    named = chain.join(fitted.labels.select("state", "label"), "state").join(fitted.shares.select("state", "share"), "state", "left")
    seldom = fitted.rare.select("state", F.lit(True).alias("seldom"))
    named = named.join(seldom, "state", "left").withColumn("rare", F.col("share").isNull() | F.col("seldom").isNotNull()).drop("seldom")
    mixed = mixture.parameter_table(spark, {0: fitted.mixture}).select(
        F.lit("mixture").alias("model"), F.col("k").alias("state"), "weight", "mu", "sigma2", "log_likelihood")
    return named.withColumn("share", F.coalesce("share", F.lit(0.0))).unionByName(mixed, allowMissingColumns=True)


def scenario_scores(
    panel: DataFrame, features: Sequence[str], models: sequence.Chain | dict[str, sequence.Chain], shocks: Sequence[scenarios.Scenario],
    filtered: bool = False,
) -> DataFrame:
    """(scenario, series_id, dt, p, state, regimes): the panel under every scenario, decoded by a fitted model in one job.

    `panel` is long: (series_id, dt, feature, value), scaled as the model's training rows were; a feature that a day lacks has no shock and counts as 0. The scenario is the
    decoder's group, so each may have a model of its own (by name). `regimes` holds the labels of that model's states.
    """
    spark, names = panel.sparkSession, [s.name for s in shocks]
    chains = {i: models[n] if isinstance(models, dict) else models for i, n in enumerate(names)}
    values = F.array(*[F.coalesce(F.max(F.when(F.col("feature") == f, F.col("value"))), F.lit(0.0)) for f in features])
    shocked = scenarios.apply_shocks(panel.where(F.col("feature").isin(list(features))), shocks)
    rows = shocked.groupBy("scenario", "series_id", "dt").agg(values.alias("x"))
    number = F.create_map(*[v for i, n in enumerate(names) for v in (F.lit(n), F.lit(i))])
    decoded = sequence.decode(
        rows.withColumn("model_fold", number[F.col("scenario")]), chains, group="model_fold", method="filtered" if filtered else "posterior")
    named = decoded.withColumn("scenario", F.array(*[F.lit(n) for n in names])[F.col("grp")])
    labelled = regimes_by_fold(spark, chains, features)
    return named.withColumnRenamed("grp", "model_fold").join(labelled, "model_fold").drop("model_fold")


def regimes_by_fold(spark, models: dict, features: Sequence[str]) -> DataFrame:
    """(model_fold, regimes): a label per state, in the order of the model's states."""
    means = [
        (int(g), k, name, float(m.means[k][i])) for g, m in models.items() for k in range(len(m.means)) for i, name in enumerate(features)
    ]
    named = labels.assign(spark.createDataFrame(means, "model_fold int, state int, feature string, mu double"), ["model_fold", "state"])
    ordered = F.array_sort(F.collect_list(F.struct("state", "label")))
    return named.groupBy("model_fold").agg(F.transform(ordered, lambda s: s["label"]).alias("regimes"))


def filled(x):
    """Missing and infinite entries count as zero."""
    infinite = float("inf")
    return F.transform(x, lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == infinite), 0.0).otherwise(v))


def walk_forward(
    rows: DataFrame, plan: folds.FoldPlan, k: int = 4, restarts: int = 3, iterations: int = 50,
    dims: int = 2, model: str = "sequence", filtered: bool = False, features: Sequence[str] | None = None,
) -> DataFrame:
    """Fit on each refitted fold's training days, score every fold's test days; the fold is a key.

    Rows are (series_id, dt, x). Each test block is decoded as a sequence of its own, so no
    block sees a later one, also where several blocks share a model. `trade_p` is what a day
    trades on: the day before, or on the first day after a refit the last training day under
    the new model, whose states may be numbered differently. Every row goes into the fits once, with its calendar
    position; each fold's window is cut out and scaled inside the pass. With `features` (the names of x) each
    row also has `regimes`, the labels of its model's states.
    """
    rows = rows.withColumn("x", filled(F.col("x")))
    days = folds.positions(rows)
    placed = stored(windowed.with_positions(rows, days), "placed-rows")
    n_days = days.agg(F.max("n_days")).first()[0] or 0
    spans = windowed.scaled_spans(placed, windowed.refit_spans(plan, n_days), dims)
    scaler = rows.sparkSession.createDataFrame(
        [(g, s.mean.tolist(), s.sd.tolist()) for g, s in spans.items()], "model_fold int, mean array<double>, sd array<double>")
    scaled_x = F.zip_with(F.zip_with("x", "mean", lambda a, b: a - b), "sd", lambda a, b: a / b)

    def scaled(frame: DataFrame) -> DataFrame:
        return frame.join(scaler, "model_fold").select("series_id", "dt", "fold", "model_fold", scaled_x.alias("x"))

    tested = folds.test_days(days, plan)
    test = scaled(rows.join(tested.select("dt", "fold", "model_fold"), "dt"))
    edge = scaled(rows.join(folds.last_train_days(days, plan).withColumn("model_fold", F.col("fold")), "dt"))
    if model == "mixture":
        models = windowed.fit_mixtures(placed, spans, k=k, restarts=restarts, iterations=iterations)
        packed = mixture.packed_table(rows.sparkSession, models, "model_fold")

        def decoded(frame: DataFrame) -> DataFrame:
            score = mixture.posterior_of(F.col("x"), F.col("log_weights"), F.col("means"), F.col("variances"))
            out = frame.join(packed, "model_fold").withColumn("p", score).withColumn("state", argmax_state(F.col("p")))
            return out.select("fold", "series_id", "dt", "p", "state")
    else:
        chains = windowed.fit_chains(placed, spans, k, restarts, iterations, dims)
        by_block = {fold: chains[fold // plan.refit_folds * plan.refit_folds] for fold in range((n_days - 1 - plan.train) // plan.step + 1)}

        def decoded(frame: DataFrame) -> DataFrame:
            out = sequence.decode(frame, by_block, group="fold", method="filtered" if filtered else "posterior")
            return out.withColumnRenamed("grp", "fold")

    scored = decoded(test).join(tested.select("dt", "model_fold", "opens"), "dt")
    before = F.lag("p").over(Window.partitionBy("series_id").orderBy("dt"))
    fresh = decoded(edge).select("series_id", "fold", F.col("p").alias("edge_p"))
    if features:
        fitted = models if model == "mixture" else chains
        scored = scored.join(regimes_by_fold(rows.sparkSession, fitted, features), "model_fold")
    return scored.withColumn("before", before).join(fresh, ["series_id", "fold"], "left").withColumn(
        "trade_p", F.when(F.col("opens") & (F.col("fold") == F.col("model_fold")), F.col("edge_p")).otherwise(F.col("before"))
    ).drop("before", "edge_p", "opens")
