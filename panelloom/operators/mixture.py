"""Diagonal Gaussian mixtures fitted by distributed EM.

Rows stay where they are: each iteration is one narrow pass that turns a
partition into parameter-sized sums, and a small aggregation of those sums. All
groups (folds) and all restarts share the pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions.probability import VARIANCE_FLOOR, log_densities, softmax, vector
from panelloom.operators.draws import SLOT_SCHEMA, spread, starting_rows, sum_slots


@dataclass
class Mixture:
    weights: np.ndarray  # (k,)
    means: np.ndarray  # (k, d)
    variances: np.ndarray  # (k, d)
    log_likelihood: float
    n: float
    iterations: int

    @property
    def free_parameters(self) -> int:
        k, d = self.means.shape
        return 2 * k * d + k - 1

    @property
    def bic(self) -> float:
        return -2 * self.log_likelihood + self.free_parameters * math.log(self.n)

    @property
    def aic(self) -> float:
        return -2 * self.log_likelihood + 2 * self.free_parameters


def row_log_density(x: np.ndarray, means: np.ndarray, variances: np.ndarray) -> np.ndarray:
    """(n, k) log density of rows under diagonal Gaussians."""
    s2 = np.maximum(variances, VARIANCE_FLOOR)
    gap = x[:, None, :] - means[None]
    return -0.5 * (np.log(2 * np.pi * s2).sum(axis=1)[None] + (gap * gap / s2[None]).sum(axis=2))


def row_log_sum(a: np.ndarray) -> np.ndarray:
    peak = a.max(axis=-1, keepdims=True)
    return (peak + np.log(np.exp(a - peak).sum(axis=-1, keepdims=True)))[..., 0]


def members(pdf: pd.DataFrame, x: str, params: dict, spans: dict | None) -> Iterator[tuple[int, np.ndarray]]:
    """(group, values) of the rows of each group, or of each span that holds their calendar position, scaled as it asks."""
    if not len(pdf):
        return
    data = np.stack(pdf[x].to_numpy()).astype(float)
    if spans is None:
        grp = pdf["grp"].to_numpy()
        yield from ((int(g), data[grp == g]) for g in np.unique(grp) if g in params)
        return
    at = pdf["i"].to_numpy()
    for g in params:
        part = data[(at >= spans[g].lo) & (at < spans[g].hi)]
        if len(part):
            yield g, spans[g].scaled(part)


def expectation(rows: DataFrame, x: str, params: dict, k: int, d: int, spans: dict | None = None) -> DataFrame:
    """Partial sums per partition: weight, first and centred second moments, likelihood.

    `params` maps group -> restart -> (weights, means, variances); its size is
    the number of parameters, never of rows.
    """
    width = 2 * d + 1
    stride = k * width + 2
    columns = ["grp" if spans is None else "i", x]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, dict[int, np.ndarray]] = {}
        for pdf in batches:
            for grp, data in members(pdf, x, params, spans):
                for restart, (weights, means, variances) in params[grp].items():
                    joint = row_log_density(data, means, variances) + np.log(weights)[None]
                    total = row_log_sum(joint)
                    share = np.exp(joint - total[:, None])
                    block = np.empty((k, width))
                    block[:, 0] = share.sum(axis=0)
                    block[:, 1 : d + 1] = share.T @ data
                    for j in range(k):
                        block[j, d + 1 :] = share[:, j] @ (data - means[j]) ** 2
                    held = sums.setdefault(grp, {}).setdefault(restart, np.zeros(stride))
                    held += np.concatenate([block.ravel(), [total.sum(), len(data)]])
        for grp, by_restart in sums.items():
            for restart, held in by_restart.items():
                slots = np.arange(stride) + restart * stride
                yield pd.DataFrame({"grp": grp, "slot": slots, "value": held}).astype(
                    {"grp": "int32", "slot": "int32"}
                )

    return rows.select(*columns).mapInPandas(add, SLOT_SCHEMA)


def maximise(block: np.ndarray, old_means: np.ndarray, reg: float):
    d = old_means.shape[1]
    mass = np.maximum(block[:, 0], 10 * np.finfo(float).eps)
    means = block[:, 1 : d + 1] / mass[:, None]
    variances = block[:, d + 1 :] / mass[:, None] - (means - old_means) ** 2
    return mass / mass.sum(), means, np.maximum(variances + reg, VARIANCE_FLOOR)


def with_group(rows: DataFrame, group: str | None) -> DataFrame:
    return rows.withColumn("grp", F.col(group).cast("int") if group else F.lit(0))


def fit_groups(
    rows: DataFrame, row_id: str, x: str, k: int = 4, restarts: int = 10, iterations: int = 500,
    tol: float = 1e-3, reg: float = 1e-6, seed: int = 42, group: str | None = None, spans: dict | None = None,
) -> dict[int, Mixture]:
    """Best of `restarts` fits for every group; stops per restart on the mean likelihood.

    With `spans` the groups are windows of the calendar position `i`, scaled each by its own statistics; no row is copied.
    """
    data = (with_group(rows, group).select("grp", row_id, x) if spans is None else rows.select("i", row_id, x)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        d = data.select(F.size(x)).first()[0]
        starts = starting_rows(data, row_id, x, k, restarts, seed, spans)
        if spans is None:
            var = spread(data, x, d)
        else:
            from panelloom.operators.windowed import moments

            starts = {g: spans[g].scaled(v) for g, v in starts.items()}
            var = {g: s * s * (max(n - 1, 0) / max(n, 1)) for g, (n, _, s) in moments(data.withColumnRenamed(x, "x"), spans, d).items()}
        params = {
            g: {
                r: (np.full(k, 1 / k), starts[g][r], np.tile(var[g] + reg, (k, 1)))
                for r in range(restarts)
            }
            for g in starts
        }
        stride, tasks = k * (2 * d + 1) + 2, data.rdd.getNumPartitions()
        active = {g: dict(by) for g, by in params.items()}
        seen: dict[tuple[int, int], float] = {}
        done: dict[tuple[int, int], int] = {}
        for step in range(iterations):
            # Finished groups (folds) need no further pass.
            open_rows = data if spans or len(active) == len(params) else data.where(F.col("grp").isin(list(active)))
            sums = sum_slots(expectation(open_rows, x, active, k, d, spans), restarts * stride, tasks * stride * sum(len(by) for by in active.values()))
            for g in list(active):
                for r in list(active[g]):
                    held = sums[g][r * stride : (r + 1) * stride]
                    block, level = held[:-2].reshape(k, -1), held[-2] / held[-1]
                    params[g][r] = maximise(block, active[g][r][1], reg)
                    done[g, r] = step + 1
                    if abs(level - seen.get((g, r), -math.inf)) < tol:
                        del active[g][r]
                    else:
                        active[g][r] = params[g][r]
                    seen[g, r] = level
                if not active[g]:
                    del active[g]
            if not active:
                break
        final = sum_slots(expectation(data, x, params, k, d, spans), restarts * stride, tasks * stride * restarts * len(params))
    finally:
        data.unpersist()
    best = {}
    for g, by in params.items():
        found = [
            Mixture(*by[r], float(final[g][(r + 1) * stride - 2]), float(final[g][(r + 1) * stride - 1]), done[g, r])
            for r in by
        ]
        finite = [m for m in found if math.isfinite(m.log_likelihood)]
        if not finite:
            raise ValueError(f"no restart of group {g} gave a finite likelihood")
        best[g] = max(finite, key=lambda m: m.log_likelihood)
    return best


def fit(rows: DataFrame, row_id: str, x: str, **options) -> Mixture:
    return fit_groups(rows, row_id, x, **options)[0]


def posterior(x: Column, model: Mixture) -> Column:
    """Class probabilities of a row as a plain expression."""
    joint = F.zip_with(
        log_densities(x, model.means, model.variances),
        vector(np.log(model.weights)),
        lambda a, b: a + b,
    )
    return softmax(joint)


def posterior_of(x: Column, log_weights: Column, means: Column, variances: Column) -> Column:
    """As `posterior`, with the parameters in array columns of the row."""
    constant = F.lit(math.log(2 * math.pi))

    def log_density(mean: Column, variance: Column) -> Column:
        terms = F.zip_with(F.zip_with(x, mean, lambda a, b: (a - b) * (a - b)), variance, lambda g, s: constant + F.ln(s) + g / s)
        return -0.5 * F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)

    return softmax(F.zip_with(F.zip_with(means, variances, log_density), log_weights, lambda a, b: a + b))


def packed_table(spark, models: dict[int, Mixture], group: str) -> DataFrame:
    """(group, log_weights, means, variances): one row of arrays per model, to be joined to the rows it scores."""
    rows = [(int(g), np.log(m.weights).tolist(), m.means.tolist(), np.maximum(m.variances, VARIANCE_FLOOR).tolist()) for g, m in models.items()]
    return spark.createDataFrame(rows, f"{group} int, log_weights array<double>, means array<array<double>>, variances array<array<double>>")


def parameter_table(spark, models: dict[int, Mixture]) -> DataFrame:
    """(grp, k, weight, mu, sigma2, log_likelihood, bic, aic)."""
    rows = [
        (int(g), j, float(m.weights[j]), m.means[j].tolist(), m.variances[j].tolist(),
         m.log_likelihood, m.bic, m.aic)
        for g, m in models.items()
        for j in range(len(m.weights))
    ]
    return spark.createDataFrame(
        rows,
        "grp int, k int, weight double, mu array<double>, sigma2 array<double>, "
        "log_likelihood double, bic double, aic double",
    )
