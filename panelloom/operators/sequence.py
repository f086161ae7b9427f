"""Gaussian hidden Markov models over many dated sequences.

A sequence has one observation per day (checked), so it is at most as long as
the calendar. Sequences are shuffled once into date-ordered partitions; every EM
iteration is then a narrow pass over the ordered rows that emits parameter-sized
sums, with all restarts and all groups (folds) sharing the pass. Rows stream
through in Arrow batches and are regrouped into whole sequences, so a task holds
one batch and the sequence at its end, never a whole partition.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.functions.probability import VARIANCE_FLOOR
from panelloom.operators.draws import SLOT_SCHEMA, spread, starting_rows, sum_slots
from panelloom.operators.mixture import with_group

# Regularisation, transition smoothing, sticky start.
REGULARISATION = 1e-4
SMOOTHING = 1e-2
STAY, LEAVE = 0.85, 0.05
BATCH_CELLS = 4_000_000
# Rows that are worth a task of their own in every pass.
TASK_ROWS = 1 << 12


@dataclass
class Chain:
    initial: np.ndarray  # (k,)
    transition: np.ndarray  # (k, k)
    means: np.ndarray  # (k, d)
    variances: np.ndarray  # (k, d)
    log_likelihood: float = float("nan")
    iterations: int = 0
    converged: bool = False

    @property
    def k(self) -> int:
        return len(self.initial)


def ordered(
    rows: DataFrame, series: str = "series_id", date: str = "dt", x: str = "x", group: str | None = None
) -> DataFrame:
    """(grp, series_id, dt, x) with every sequence in one partition, in date order."""
    slots = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = with_group(rows, group).select(
        "grp", F.col(series).alias("series_id"), F.col(date).alias("dt"), F.col(x).alias("x")
    )
    return named.repartition(slots, "grp", "series_id").sortWithinPartitions("grp", "series_id", "dt")


def gathered(placed: DataFrame) -> DataFrame:
    """Persisted sequences in no more tasks than their rows fill: hundreds of passes pay for each task, empty ones too."""
    return placed.coalesce(max(1, math.ceil(placed.count() / TASK_ROWS)))


def whole_sequences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Regroup a stream of ordered rows so that no sequence is cut between two frames."""
    rest = None
    for pdf in batches:
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        grp, name = pdf["grp"].iloc[-1], pdf["series_id"].iloc[-1]
        open_end = ((pdf["grp"] == grp) & (pdf["series_id"] == name)).to_numpy()
        rest = pdf[open_end]
        if not open_end.all():
            yield pdf[~open_end].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest.reset_index(drop=True)


def blocks(pdf: pd.DataFrame, cells_per_row: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(group, padded values, mask, row numbers) of sequences of similar length.

    A block's padded size stays within the cell limit (one sequence at least).
    """
    data = np.stack(pdf["x"].to_numpy()).astype(float)
    grp, name = pdf["grp"].to_numpy(), pdf["series_id"].to_numpy()
    opens = np.r_[True, (grp[1:] != grp[:-1]) | (name[1:] != name[:-1])]
    days = pdf["dt"].to_numpy()
    if (~opens[1:] & (days[1:] == days[:-1])).any():
        raise ValueError("a sequence holds the same day twice")
    starts = np.flatnonzero(opens)
    lengths = np.diff(np.r_[starts, len(pdf)])
    order = np.lexsort((lengths, grp[starts]))
    first = 0
    while first < len(order):
        g, last = grp[starts[order[first]]], first + 1
        while (
            last < len(order)
            and grp[starts[order[last]]] == g
            and (last + 1 - first) * lengths[order[last]] * cells_per_row <= BATCH_CELLS
        ):
            last += 1
        chosen = order[first:last]
        at = [np.arange(starts[i], starts[i] + lengths[i]) for i in chosen]
        values, mask = padded([data[i] for i in at])
        yield int(g), values, mask, np.concatenate(at)
        first = last


def starting_chain(means: np.ndarray, variance: np.ndarray) -> Chain:
    k = len(means)
    moves = np.full((k, k), LEAVE)
    np.fill_diagonal(moves, STAY)
    return Chain(
        np.full(k, 1 / k), moves / moves.sum(axis=1, keepdims=True), means.copy(),
        np.tile(variance + REGULARISATION, (k, 1)),
    )


def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(s, t, d) values and (s, t) mask of sequences of unequal length."""
    longest = max(len(s) for s in sequences)
    values = np.zeros((len(sequences), longest, sequences[0].shape[1]))
    mask = np.zeros((len(sequences), longest), dtype=bool)
    for i, s in enumerate(sequences):
        values[i, : len(s)] = s
        mask[i, : len(s)] = True
    return values, mask


def emissions(values: np.ndarray, chain: Chain) -> np.ndarray:
    """(s, t, k) log densities."""
    s2 = np.maximum(chain.variances, VARIANCE_FLOOR)
    gap = values[:, :, None, :] - chain.means
    return -0.5 * (np.log(2 * np.pi * s2).sum(axis=1) + (gap * gap / s2).sum(axis=3))


def forward(log_b: np.ndarray, mask: np.ndarray, chain: Chain):
    """Filtered state shares, step scales, scaled densities and log likelihoods."""
    peak = log_b.max(axis=2, keepdims=True)
    b = np.exp(log_b - peak)
    alpha, scales = np.empty_like(b), np.ones(mask.shape)
    for t in range(b.shape[1]):
        here = (chain.initial if t == 0 else alpha[:, t - 1] @ chain.transition) * b[:, t]
        total = here.sum(axis=1)
        live = mask[:, t]
        scales[live, t] = total[live]
        step = here / np.where(total > 0, total, 1)[:, None]
        alpha[:, t] = np.where(live[:, None], step, alpha[:, t - 1] if t else step)
    with np.errstate(divide="ignore"):
        level = np.where(mask, np.log(scales) + peak[:, :, 0], 0.0).sum(axis=1)
    return alpha, scales, b, level


def smooth(log_b: np.ndarray, mask: np.ndarray, chain: Chain):
    """Posterior shares, expected transition counts and log likelihoods."""
    alpha, scales, b, level = forward(log_b, mask, chain)
    beta = np.ones_like(alpha)
    counts = np.zeros((chain.k, chain.k))
    for t in range(b.shape[1] - 2, -1, -1):
        live = mask[:, t + 1]
        ahead = b[:, t + 1] * beta[:, t + 1] / scales[:, t + 1, None]
        beta[:, t] = np.where(live[:, None], ahead @ chain.transition.T, 1.0)
        counts += np.einsum("si,sj->ij", alpha[live, t], ahead[live]) * chain.transition
    gamma = alpha * beta
    gamma /= np.maximum(gamma.sum(axis=2, keepdims=True), 1e-300)
    return gamma * mask[:, :, None], counts, level


def best_path(log_b: np.ndarray, mask: np.ndarray, chain: Chain) -> np.ndarray:
    """Most likely state path of each sequence; the lowest state wins a tie."""
    moves = np.log(chain.transition + 1e-300)
    score = np.log(chain.initial + 1e-300) + log_b[:, 0]
    back = np.zeros(log_b.shape, dtype=int)
    for t in range(1, log_b.shape[1]):
        options = score[:, :, None] + moves[None]
        back[:, t] = options.argmax(axis=1)
        moved = options.max(axis=1) + log_b[:, t]
        score = np.where(mask[:, t, None], moved, score)
        back[:, t] = np.where(mask[:, t, None], back[:, t], np.arange(chain.k))
    states = np.zeros(mask.shape, dtype=int)
    states[:, -1] = score.argmax(axis=1)
    rows = np.arange(len(states))
    for t in range(log_b.shape[1] - 2, -1, -1):
        states[:, t] = back[rows, t + 1, states[:, t + 1]]
    return states


def expectation(rows: DataFrame, chains: dict, k: int, d: int) -> DataFrame:
    """Partial sums per partition for every (group, restart)."""
    stride = k + k * k + k * (2 * d + 1) + 1

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for pdf in whole_sequences(batches):
            for grp, values, mask, _ in blocks(pdf, k * max(d, k)):
                for restart, chain in chains[grp].items():
                    gamma, counts, level = smooth(emissions(values, chain), mask, chain)
                    block = np.empty((k, 2 * d + 1))
                    block[:, 0] = gamma.sum(axis=(0, 1))
                    block[:, 1 : d + 1] = np.einsum("stk,std->kd", gamma, values)
                    for j in range(k):
                        gap = (values - chain.means[j]) ** 2
                        block[j, d + 1 :] = np.einsum("st,std->d", gamma[:, :, j], gap)
                    held = sums.setdefault((grp, restart), np.zeros(stride))
                    held += np.concatenate(
                        [gamma[:, 0].sum(axis=0), counts.ravel(), block.ravel(), [level.sum()]]
                    )
        for (grp, restart), held in sums.items():
            slots = np.arange(stride) + restart * stride
            yield pd.DataFrame({"grp": grp, "slot": slots, "value": held}).astype(
                {"grp": "int32", "slot": "int32"}
            )

    return rows.mapInPandas(add, SLOT_SCHEMA)


def maximise(held: np.ndarray, old: Chain) -> Chain:
    k, d = old.means.shape
    first, counts = held[:k], held[k : k + k * k].reshape(k, k)
    block = held[k + k * k : -1].reshape(k, 2 * d + 1)
    mass = np.maximum(block[:, :1], 1e-300)
    means = block[:, 1 : d + 1] / mass
    variances = block[:, d + 1 :] / mass - (means - old.means) ** 2
    return Chain(
        first / first.sum(),
        (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * k),
        means,
        np.maximum(variances + REGULARISATION, VARIANCE_FLOOR),
    )


def improve(rows: DataFrame, chains: dict, iterations: int, tol: float = 1e-4, expect: Callable[[dict], DataFrame] | None = None) -> dict:
    """EM over ordered rows from given starts; each restart stops once its likelihood settles.

    Reports the likelihood of the parameters returned, from one last pass. `expect` gives the partial
    sums of the chains still active, where those of `expectation` over groups of rows are not wanted.
    """
    some = next(iter(next(iter(chains.values())).values()))
    k, d = some.means.shape
    restarts = 1 + max(r for by in chains.values() for r in by)
    stride = k + k * k + k * (2 * d + 1) + 1
    current = {g: dict(by) for g, by in chains.items()}
    active = {g: dict(by) for g, by in chains.items()}
    level: dict[tuple[int, int], float] = {}
    ended: dict[tuple[int, int], tuple[int, bool]] = {}
    tasks = rows.rdd.getNumPartitions()
    expect = expect or (lambda some: expectation(rows if len(some) == len(current) else rows.where(F.col("grp").isin(list(some))), some, k, d))
    for step in range(iterations):
        sums = sum_slots(expect(active), restarts * stride, tasks * stride * sum(len(by) for by in active.values()))
        for g in list(active):
            for r in list(active[g]):
                held = sums[g][r * stride : (r + 1) * stride]
                current[g][r] = maximise(held, active[g][r])
                settled = bool(step > 0 and abs(held[-1] - level[g, r]) < tol)
                level[g, r] = held[-1]
                ended[g, r] = (step + 1, settled)
                if settled:
                    del active[g][r]
                else:
                    active[g][r] = current[g][r]
            if not active[g]:
                del active[g]
        if not active:
            break
    final = sum_slots(expect(current), restarts * stride, tasks * stride * restarts * len(current))
    for g, by in current.items():
        for r, chain in by.items():
            chain.log_likelihood = float(final[g][(r + 1) * stride - 1])
            chain.iterations, chain.converged = ended.get((g, r), (0, False))
    return current


def best_of(chains: dict[int, Chain]) -> Chain:
    finite = [c for c in chains.values() if math.isfinite(c.log_likelihood)]
    if not finite:
        raise ValueError("no restart gave a finite likelihood")
    return max(finite, key=lambda c: c.log_likelihood)


def fit_groups(
    rows: DataFrame, series: str = "series_id", date: str = "dt", x: str = "x", k: int = 4,
    restarts: int = 5, iterations: int = 200, tol: float = 1e-4, seed: int = 42, group: str | None = None,
) -> dict[int, Chain]:
    """Best of `restarts` fits per group; series of a group share its parameters."""
    held = ordered(rows, series, date, x, group).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        placed = gathered(held)
        d = placed.select(F.size("x")).first()[0]
        row_id = F.concat_ws("/", F.col("series_id").cast("string"), F.col("dt").cast("string"))
        starts = starting_rows(placed.withColumn("row_id", row_id), "row_id", "x", k, restarts, seed)
        var = spread(placed, "x", d)
        chains = {
            g: {r: starting_chain(starts[g][r], var[g]) for r in range(restarts)} for g in starts
        }
        fitted = improve(placed, chains, iterations, tol)
    finally:
        held.unpersist()
    return {g: best_of(by) for g, by in fitted.items()}


def fit(rows: DataFrame, **options) -> Chain:
    return fit_groups(rows, **options)[0]


def decode(
    rows: DataFrame, chains: dict[int, Chain] | Chain, series: str = "series_id", date: str = "dt",
    x: str = "x", group: str | None = None, method: str = "posterior",
) -> DataFrame:
    """(grp, series, dt, p, state): smoothed, filtered, or smoothed with the best path.

    `posterior` uses the whole sequence, `filtered` only the days so far, and
    `viterbi` reports the most likely path with the smoothed shares.
    """
    if method not in ("posterior", "filtered", "viterbi"):
        raise ValueError(f"unknown method {method!r}")
    models = chains if isinstance(chains, dict) else {0: chains}
    k, d = next(iter(models.values())).means.shape

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_sequences(batches):
            for grp, values, mask, at in blocks(pdf, k * max(d, k)):
                chain = models[grp]
                log_b = emissions(values, chain)
                shares = forward(log_b, mask, chain)[0] if method == "filtered" else smooth(log_b, mask, chain)[0]
                states = best_path(log_b, mask, chain) if method == "viterbi" else shares.argmax(axis=2)
                out = pdf.loc[at, ["grp", "series_id", "dt"]]
                out["p"] = list(shares[mask])
                out["state"] = states[mask].astype("int32")
                yield out

    placed = ordered(rows, series, date, x, group)
    schema = T.StructType([
        *[placed.schema[c] for c in ("grp", "series_id", "dt")],
        T.StructField("p", T.ArrayType(T.DoubleType())),
        T.StructField("state", T.IntegerType()),
    ])
    return placed.mapInPandas(label, schema).withColumnRenamed("series_id", series)


def parameter_table(spark, chains: dict[int, Chain]) -> DataFrame:
    """(grp, k, pi, a, mu, sigma2, log_likelihood, iterations, converged)."""
    rows = [
        (int(g), j, float(c.initial[j]), c.transition[j].tolist(), c.means[j].tolist(),
         c.variances[j].tolist(), c.log_likelihood, c.iterations, c.converged)
        for g, c in chains.items()
        for j in range(c.k)
    ]
    return spark.createDataFrame(
        rows,
        "grp int, k int, pi double, a array<double>, mu array<double>, sigma2 array<double>, "
        "log_likelihood double, iterations int, converged boolean",
    )
