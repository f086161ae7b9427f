"""Models fitted on many calendar windows of the same rows.

A row has its calendar position and travels once, however many windows hold it: each pass cuts the windows out of whole
sequences inside the task, scales them with the window's own statistics and emits parameter-sized sums. All
windows and restarts of a batch are worked on together, so a step of the recursion is one array operation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions.probability import VARIANCE_FLOOR
from panelloom.operators import draws, mixture, sequence
from panelloom.operators.draws import SLOT_SCHEMA, sum_slots
from panelloom.operators.folds import FoldPlan


# Rows of whole sequences taken up together, and cells of one step's arrays, which should stay in a core's cache.
ROWS_AT_ONCE = 1 << 16
STEP_CELLS = 1 << 19


@dataclass(frozen=True)
class Span:
    """Calendar positions lo <= i < hi, and what scales the rows in it."""

    lo: int
    hi: int
    mean: np.ndarray | None = None
    sd: np.ndarray | None = None

    def scaled(self, data: np.ndarray) -> np.ndarray:
        return data if self.mean is None else (data - self.mean) / self.sd


def refit_spans(plan: FoldPlan, n_days: int) -> dict[int, Span]:
    """The training window of every fold that is fitted anew."""
    last = (n_days - 1 - plan.train) // plan.step
    return {f: Span(0 if plan.expanding else f * plan.step, plan.train + f * plan.step) for f in range(0, last + 1, plan.refit_folds)}


def moments(rows: DataFrame, spans: dict[int, Span], d: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(count, mean, sample deviation) of every dimension in every span, from one pass. Scaled values where a span scales."""
    centre = np.zeros(d)
    if all(s.mean is None for s in spans.values()):
        row = rows.agg(*[F.avg(F.col("x")[j]).alias(f"c{j}") for j in range(d)]).first()
        centre = np.array([row[j] or 0.0 for j in range(d)])
    stride = 1 + 2 * d

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {g: np.zeros(stride) for g in spans}
        for pdf in batches:
            if not len(pdf):
                continue
            data, at = np.stack(pdf["x"].to_numpy()).astype(float), pdf["i"].to_numpy()
            for g, span in spans.items():
                part = span.scaled(data[(at >= span.lo) & (at < span.hi)]) - centre
                sums[g] += np.concatenate([[len(part)], part.sum(0), (part * part).sum(0)])
        yield from slots({(g, 0): s for g, s in sums.items()}, stride)

    out = {}
    for g, held in sum_slots(rows.select("i", "x").mapInPandas(add, SLOT_SCHEMA), stride).items():
        n, shift = held[0], held[1:d + 1] / max(held[0], 1)
        square = np.maximum(held[d + 1:] - n * shift * shift, 0)
        out[g] = (n, centre + shift, np.sqrt(square / max(n - 1, 1)))
    return out


def slots(sums: dict[tuple[int, int], np.ndarray], stride: int) -> Iterator[pd.DataFrame]:
    for (grp, restart), held in sums.items():
        yield pd.DataFrame({"grp": grp, "slot": np.arange(stride) + restart * stride, "value": held}).astype({"grp": "int32", "slot": "int32"})


def scaled_spans(rows: DataFrame, spans: dict[int, Span], d: int) -> dict[int, Span]:
    """Spans with the scaler of their own rows; a deviation of zero counts as one."""
    found = moments(rows, spans, d)
    return {g: Span(s.lo, s.hi, found[g][1], np.where(found[g][2] > 0, found[g][2], 1.0)) for g, s in spans.items() if g in found}


# --- sequence model -------------------------------------------------------------------


class Parameters:
    """Those of every (span, restart) as arrays with one entry each."""

    def __init__(self, spans: dict[int, Span], chains: dict[int, dict[int, sequence.Chain]]):
        self.names = [(g, r) for g, by in chains.items() for r in by]
        every = [chains[g][r] for g, r in self.names]
        self.initial, self.transition, self.means = (np.stack([getattr(c, n) for c in every]) for n in ("initial", "transition", "means"))
        self.variances = np.maximum(np.stack([c.variances for c in every]), VARIANCE_FLOOR)
        self.lo, self.hi = (np.array([getattr(spans[g], n) for g, _ in self.names]) for n in ("lo", "hi"))
        scale = [spans[g] for g, _ in self.names]
        d = self.means.shape[2]
        self.mean = np.stack([np.zeros(d) if s.mean is None else s.mean for s in scale])
        self.sd = np.stack([np.ones(d) if s.sd is None else s.sd for s in scale])


def cuts(at: np.ndarray, starts: np.ndarray, params: Parameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row, length, parameters) of each sequence within each span that holds some of it."""
    first, length, own = [], [], []
    seen: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for c, (lo, hi) in enumerate(zip(params.lo.tolist(), params.hi.tolist())):
        if (lo, hi) not in seen:
            before = np.add.reduceat((at < lo).astype(np.int64), starts)
            seen[lo, hi] = starts + before, np.add.reduceat(((at >= lo) & (at < hi)).astype(np.int64), starts)
        a, n = seen[lo, hi]
        some = n > 0
        first.append(a[some])
        length.append(n[some])
        own.append(np.full(some.sum(), c))
    return np.concatenate(first), np.concatenate(length), np.concatenate(own)


def smoothed(values: np.ndarray, length: np.ndarray, own: np.ndarray, p: Parameters) -> np.ndarray:
    """Sufficient statistics of each cut: first day's shares, transitions, mass and moments per state, log likelihood.

    Cuts come in order of length, so those still running on a day are a slice. Days and states lead the arrays and cuts
    trail, so that a step of the recursion runs over neighbouring memory.
    """
    b_size, t_size, d = values.shape
    k = p.initial.shape[1]
    x = np.ascontiguousarray(values.transpose(2, 1, 0))
    means, variances = (np.ascontiguousarray(a[own].transpose(1, 2, 0)) for a in (p.means, p.variances))
    moves, initial = np.ascontiguousarray(p.transition[own].transpose(1, 2, 0)), p.initial[own].T
    live = np.searchsorted(length, np.arange(t_size + 1), side="right")
    mask = np.arange(t_size)[:, None] < length
    log_b = np.empty((t_size, k, b_size))
    for j in range(k):
        log_b[:, j] = -0.5 * np.log(2 * np.pi * variances[j]).sum(0)
        for e in range(d):
            log_b[:, j] -= (x[e] - means[j, e]) ** 2 * (0.5 / variances[j, e])
    peak = log_b.max(1)
    b = np.exp(log_b - peak[:, None])
    alpha, scales = np.zeros_like(b), np.ones((t_size, b_size))
    for t in range(t_size):
        s = live[t]
        here = (initial if t == 0 else (alpha[t - 1, :, None, s:] * moves[:, :, s:]).sum(0)) * b[t, :, s:]
        total = here.sum(0)
        scales[t, s:] = total
        alpha[t, :, s:] = here / np.where(total > 0, total, 1)
    with np.errstate(divide="ignore"):
        level = np.where(mask, np.log(scales) + peak, 0.0).sum(0)
    beta, counts = np.ones_like(alpha), np.zeros((k, k, b_size))
    for t in range(t_size - 2, -1, -1):
        s = live[t + 1]
        ahead = b[t + 1, :, s:] * beta[t + 1, :, s:] / scales[t + 1, s:]
        beta[t, :, s:] = (moves[:, :, s:] * ahead).sum(1)
        counts[:, :, s:] += alpha[t, :, None, s:] * ahead
    gamma = alpha * beta
    gamma /= np.maximum(gamma.sum(1, keepdims=True), 1e-300)
    block = np.empty((k, 2 * d + 1, b_size))
    for j in range(k):
        block[j, 0] = gamma[:, j].sum(0)
        for e in range(d):
            block[j, 1 + e] = (gamma[:, j] * x[e]).sum(0)
            block[j, 1 + d + e] = (gamma[:, j] * (x[e] - means[j, e]) ** 2).sum(0)
    return np.concatenate([gamma[0], (counts * moves).reshape(k * k, -1), block.reshape(-1, b_size), level[None]]).T


def whole_arrays(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(values, calendar positions, series) of whole sequences, some tens of thousands of rows at a time."""
    held: list[tuple[np.ndarray, ...]] = []

    def cut(last: bool):
        nonlocal held
        joined = tuple(np.concatenate(part) for part in zip(*held))
        name = joined[2]
        changes = np.flatnonzero(name[1:] != name[:-1]) + 1
        end = len(name) if last else changes[-1] if len(changes) else 0
        held = [tuple(part[end:] for part in joined)]
        return tuple(part[:end] for part in joined)

    waiting = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float)
        if len(flat) != batch.num_rows * d:
            raise ValueError(f"a row without {d} values")
        held.append((flat.reshape(-1, d), batch.column("i").to_numpy(zero_copy_only=False), batch.column("series_id").to_numpy(zero_copy_only=False)))
        waiting += batch.num_rows
        if waiting >= ROWS_AT_ONCE:
            out = cut(False)
            # A series longer than that waits for twice as many rows before it is looked at again.
            waiting = 0 if len(out[0]) else -len(held[0][0])
            if len(out[0]):
                yield out
    if held and len((out := cut(True))[0]):
        yield out


def chain_sums(placed: DataFrame, spans: dict[int, Span], chains: dict, k: int, d: int) -> DataFrame:
    """Partial sums per partition for every (span, restart)."""
    stride = k + k * k + k * (2 * d + 1) + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Parameters(spans, chains)
        sums = np.zeros((len(p.names), stride))
        for data, at, name in whole_arrays(batches, d):
            starts = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
            if (np.diff(at) == 0)[name[1:] == name[:-1]].any():
                raise ValueError("a sequence holds the same day twice")
            first, length, own = cuts(at, starts, p)
            order = np.argsort(length, kind="stable")
            sizes, a = length[order], 0
            while a < len(order):
                # As many cuts as their padded cells allow, one at least.
                fits = np.arange(1, len(order) - a + 1) * sizes[a:] * k * max(d, k) <= STEP_CELLS
                z = a + max(1, int(fits.sum()))
                some = order[a:z]
                rows = np.minimum(first[some, None] + np.arange(sizes[z - 1]), len(data) - 1)
                values = (data[rows] - p.mean[own[some], None]) / p.sd[own[some], None]
                values[np.arange(values.shape[1]) >= length[some, None]] = 0.0
                found = smoothed(values, length[some], own[some], p)
                if np.isfinite(found).all():
                    sums += (np.arange(len(sums))[:, None] == own[some]).astype(float) @ found
                else:
                    np.add.at(sums, own[some], found)
                a = z
        for part in slots(dict(zip(p.names, sums)), stride):
            yield pa.RecordBatch.from_pandas(part, preserve_index=False)

    return placed.select("series_id", "i", "x").mapInArrow(add, SLOT_SCHEMA)


def with_positions(rows: DataFrame, days: DataFrame) -> DataFrame:
    """(series_id, dt, x, i): every row once, with its calendar position."""
    return rows.join(days.select("dt", "i"), "dt").select("series_id", "dt", "x", "i")


def placed_rows(rows: DataFrame) -> DataFrame:
    """Whole sequences in date order, each within one partition."""
    size = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(F.lit(0).alias("grp"), "series_id", "dt", "i", "x").repartition(size, "series_id").sortWithinPartitions("series_id", "dt")


def fit_chains(rows: DataFrame, spans: dict[int, Span], k: int, restarts: int, iterations: int, d: int, tol: float = 1e-4, seed: int = 42) -> dict[int, sequence.Chain]:
    """Best of `restarts` sequence models for every span, fitted on its scaled rows (series_id, dt, i, x)."""
    held = placed_rows(rows).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        placed = sequence.gathered(held)
        row_id = F.concat_ws("/", F.col("series_id").cast("string"), F.col("dt").cast("string"))
        starts = draws.starting_rows(placed.withColumn("row_id", row_id), "row_id", "x", k, restarts, seed, spans)
        spread = {g: s * s * (max(n - 1, 0) / max(n, 1)) for g, (n, _, s) in moments(placed, spans, d).items()}
        chains = {g: {r: sequence.starting_chain(spans[g].scaled(starts[g][r]), spread[g]) for r in range(restarts)} for g in starts}
        fitted = sequence.improve(placed, chains, iterations, tol, lambda active: chain_sums(placed, spans, active, k, d))
    finally:
        held.unpersist()
    return {g: sequence.best_of(by) for g, by in fitted.items()}


def fit_mixtures(rows: DataFrame, spans: dict[int, Span], **options) -> dict[int, mixture.Mixture]:
    """Best mixture for every span, fitted on its scaled rows (series_id, dt, i, x)."""
    flat = rows.select(F.concat_ws("/", "series_id", "dt").alias("row_id"), "i", "x")
    return mixture.fit_groups(flat, "row_id", "x", spans=spans, **options)
