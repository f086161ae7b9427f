"""Hidden Markov models over sequences too long for one task: a parallel scan over blocks.

What a run of days does to the state shares is a k x k matrix, and matrices of neighbouring runs multiply: sums of
products for shares, maxima of sums for the best path. A first pass turns each block into its matrices, a fold over the
blocks of a series gives every block what comes in from both sides, and a second pass finishes each block by itself.
A task takes a part of the rows, with many short blocks or one long one, and works on all its blocks at once. Few long
blocks are cut in the same way into stretches of about the square root of their length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.operators.draws import SLOT_SCHEMA, sum_slots
from panelloom.operators.sequence import BATCH_CELLS, Chain, emissions, whole_sequences
from panelloom.session import stored

# Most rows of a task.
BLOCK_ROWS = 1 << 17
TINY = 1e-300


def stretches(x: np.ndarray, length: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log densities, densities over the row's peak, mask) of padded blocks by stretch; many blocks have one stretch each."""
    blocks, longest = x.shape[:2]
    step = longest if blocks >= math.isqrt(longest) else max(1, math.isqrt(longest))
    many = -(-longest // step)
    padded = np.zeros((blocks, many * step, chain.k))
    padded[:, :longest] = emissions(x, chain)
    mask = (np.arange(many * step) < length[:, None]).reshape(blocks, many, step)
    log_b = padded.reshape(blocks, many, step, -1)
    return log_b, np.exp(log_b - log_b.max(3, keepdims=True)), mask


def log_moves(chain: Chain) -> np.ndarray:
    return np.log(chain.transition + TINY)


def times(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Product of many (.., k) rows with one matrix."""
    return (left.reshape(-1, left.shape[-1]) @ right).reshape(left.shape)


def best_step(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Max-plus product of (.., i, l) and (l, j)."""
    return (scores[..., :, None] + moves).max(-2)


def products(log_b: np.ndarray, b: np.ndarray, mask: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray]:
    """For each stretch the matrices from its first row to its last: shares (scaled to a largest entry of 1) and scores."""
    blocks, many, length, k = b.shape
    share, score = np.tile(np.eye(k), (blocks, many, 1, 1)), np.tile(np.where(np.eye(k) > 0, 0.0, -np.inf), (blocks, many, 1, 1))
    moves = log_moves(chain)
    for t in range(1, length):
        live = mask[:, :, t, None, None]
        ahead = times(share, chain.transition) * b[:, :, t, None, :]
        share = np.where(live, ahead / np.maximum(ahead.max((2, 3), keepdims=True), TINY), share)
        score = np.where(live, best_step(score, moves) + log_b[:, :, t, None, :], score)
    return share, score


def joined(first: np.ndarray, share: np.ndarray, log_first: np.ndarray, score: np.ndarray, real: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray]:
    """The matrices of neighbouring stretches as those of one run: from its first row to its last."""
    whole, best, moves = share[:, 0], score[:, 0], log_moves(chain)
    for m in range(1, share.shape[1]):
        live = real[:, m, None, None]
        ahead = ((times(whole, chain.transition) * first[:, m, None, :])[..., None] * share[:, m, None]).sum(2)
        whole = np.where(live, ahead / np.maximum(ahead.max((1, 2), keepdims=True), TINY), whole)
        start = best_step(best, moves) + log_first[:, m, None, :]
        best = np.where(live, (start[..., None] + score[:, m, None]).max(2), best)
    return whole, best


def entries(first: np.ndarray, share: np.ndarray, log_first: np.ndarray, score: np.ndarray, real: np.ndarray, chain: Chain,
            before: np.ndarray, opening: np.ndarray, behind: np.ndarray, best_before: np.ndarray, end: np.ndarray):
    """What comes into each of neighbouring runs: shares and scores of the row before it, weights of what follows it,
    and the state its best path ends in. `opening` marks where the sequence begins, `end` is -1 where it ends.

    The first axis holds sequences that are worked on together, the second their runs, of which `real` ones exist."""
    rows, many, k = first.shape
    moves = log_moves(chain)
    alpha, scores, beta, ends = np.empty((rows, many + 1, k)), np.empty((rows, many + 1, k)), np.empty((rows, many, k)), np.empty((rows, many), int)
    alpha[:, 0], scores[:, 0], beta[:, -1] = before, best_before, behind
    for m in range(many):
        prior, start = times(alpha[:, m], chain.transition), best_step(scores[:, m], moves)
        if m == 0:
            prior[opening], start[opening] = chain.initial, np.log(chain.initial + TINY)
        at = ((prior * first[:, m])[..., None] * share[:, m]).sum(1)
        live = real[:, m, None]
        alpha[:, m + 1] = np.where(live, at / np.maximum(at.sum(1, keepdims=True), TINY), alpha[:, m])
        scores[:, m + 1] = np.where(live, ((start + log_first[:, m])[..., None] + score[:, m]).max(1), scores[:, m])
    last = np.where(end < 0, scores[:, -1].argmax(1), end)
    ends[:, -1] = last
    for m in range(many - 1, 0, -1):
        live = real[:, m]
        at = times(first[:, m] * (share[:, m] * beta[:, m, None, :]).sum(2), chain.transition.T)
        beta[:, m - 1] = np.where(live[:, None], at / np.maximum(at.sum(1, keepdims=True), TINY), behind)
        start = best_step(scores[:, m], moves) + log_first[:, m]
        state = (start + score[np.arange(rows), m, :, ends[:, m]]).argmax(1)
        ends[:, m - 1] = np.where(live, (scores[:, m] + moves[:, state].T).argmax(1), last)
    return alpha, beta, scores, ends


def finished(x: np.ndarray, length: np.ndarray, chain: Chain, before, opening, behind, best_before, end) -> dict[str, np.ndarray]:
    """Shares, smoothed shares and best paths of padded blocks, and statistics of all of them."""
    log_b, b, mask = stretches(x, length, chain)
    blocks, many, steps, k = b.shape
    moves = log_moves(chain)
    if many > 1:
        share, score = products(log_b, b, mask, chain)
        alphas, betas, scores, ends = entries(b[:, :, 0], share, log_b[:, :, 0], score, mask[:, :, 0], chain, before, opening, behind, best_before, end)
    else:
        alphas, betas, scores, ends = before[:, None], behind[:, None], best_before[:, None], end[:, None]
    # From here every stretch knows what surrounds it, and all go forward and back together.
    opens = np.zeros((blocks, many), bool)
    opens[:, 0] = opening
    opens, previous = opens.ravel(), alphas[:, :many].reshape(-1, k).copy()
    entering, start = times(previous, chain.transition), best_step(scores[:, :many].reshape(-1, k), moves)
    entering[opens], start[opens], previous[opens] = chain.initial, np.log(chain.initial + TINY), 0.0
    log_b, b, mask = log_b.reshape(-1, steps, k), b.reshape(-1, steps, k), mask.reshape(-1, steps)
    alpha, ahead, back = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    level = np.zeros(mask.shape)
    for t in range(steps):
        here = (entering if t == 0 else alpha[:, t - 1] @ chain.transition) * b[:, t]
        total = np.maximum(here.sum(1), TINY)
        level[:, t] = np.log(total) + log_b[:, t].max(1)
        alpha[:, t] = np.where(mask[:, t, None], here / total[:, None], alpha[:, t - 1] if t else here)
    beta = betas.reshape(-1, k)
    for t in range(steps - 1, -1, -1):
        back[:, t] = beta
        ahead[:, t] = b[:, t] * beta
        down = ahead[:, t] @ chain.transition.T
        beta = np.where(mask[:, t, None], down / np.maximum(down.sum(1, keepdims=True), TINY), beta)
    gamma = alpha * back
    gamma /= np.maximum(gamma.sum(2, keepdims=True), TINY)
    gamma *= mask[..., None]
    # Transitions into each row; into the first row of all there is none.
    last = np.concatenate([previous[:, None], alpha[:, :-1]], 1)
    pairs = last[..., :, None] * chain.transition * ahead[..., None, :]
    pairs /= np.maximum(pairs.sum((2, 3), keepdims=True), TINY)
    counts = pairs[mask].sum(0)
    path, point = np.zeros(mask.shape, int), np.zeros(b.shape, int)
    held = start + log_b[:, 0]
    for t in range(1, steps):
        options = held[:, :, None] + moves
        point[:, t] = np.where(mask[:, t, None], options.argmax(1), np.arange(k))
        held = np.where(mask[:, t, None], options.max(1) + log_b[:, t], held)
    path[:, -1] = ends.ravel()
    for t in range(steps - 2, -1, -1):
        path[:, t] = point[np.arange(len(point)), t + 1, path[:, t + 1]]
    whole = lambda a: a.reshape(blocks, many * steps, *a.shape[2:])[:, :x.shape[1]]
    return {"alpha": whole(alpha), "gamma": whole(gamma), "path": whole(path), "counts": counts, "level": level[mask].sum()}


def in_blocks(rows: DataFrame, series: str, date: str, x: str, block_rows: int) -> DataFrame:
    """Stored (series_id, dt, x, part, block): runs of neighbouring days, dealt by range, so that one series fills many tasks.

    A part is what a task takes: at least a block, at most `BLOCK_ROWS` rows where blocks are smaller, however many blocks there are.
    """
    # Counted, sampled for the ranges and dealt: stored first, so that whatever the rows come from is worked out once.
    named = stored(rows.select(F.col(series).alias("series_id"), F.col(date).alias("dt"), F.col(x).alias("x")), "sequence-rows")
    total, slots = named.count(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = max(1, math.ceil(total / max(block_rows, min(BLOCK_ROWS, math.ceil(total / slots)))))
    dealt = named.repartitionByRange(many, "series_id", "dt").withColumn("part", F.spark_partition_id()).sortWithinPartitions("series_id", "dt")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            if batch.num_rows:
                block = (batch.column("part")[0].as_py() << 32) + (seen + np.arange(batch.num_rows)) // block_rows
                seen += batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block, pa.int64())], names=[*batch.schema.names, "block"])

    return stored(dealt.mapInArrow(number, T.StructType([*dealt.schema, T.StructField("block", T.LongType())])), "sequence-blocks")


def codes(column: pa.ChunkedArray) -> np.ndarray:
    """Equal numbers for equal values."""
    return column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()


def vectors(column: pa.ChunkedArray) -> np.ndarray:
    """(rows, d) of lists of one length, without an object per row."""
    held = column.combine_chunks()
    if held.null_count or len(pc.unique(pc.list_value_length(held))) > 1:
        raise ValueError("vectors of a sequence are missing or of unlike lengths")
    return held.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(held), -1)


def lists(values: np.ndarray) -> pa.ListArray:
    """Rows of values as an Arrow column."""
    flat = values.reshape(len(values), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel(), pa.float64()))


class Part:
    """Rows of a task in order of series and day, and its blocks: neighbouring rows of one series and block."""

    def __init__(self, table: pa.Table):
        self.rows = table.sort_by([("series_id", "ascending"), ("dt", "ascending")])
        name, day, block = codes(self.rows["series_id"]), codes(self.rows["dt"]), self.rows["block"].to_numpy()
        same = name[1:] == name[:-1]
        if (same & (day[1:] == day[:-1])).any():
            raise ValueError("a sequence holds the same day twice")
        self.x = vectors(self.rows["x"])
        self.first = np.flatnonzero(np.r_[True, ~same | (block[1:] != block[:-1])])
        self.length = np.diff(np.r_[self.first, len(self.x)])

    def batches(self, cells_per_row: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(blocks, row numbers, padded values, lengths) of blocks of similar length, within the cell limit (one block at least)."""
        for some in batched(self.length, cells_per_row):
            at = np.minimum(self.first[some, None] + np.arange(self.length[some].max()), len(self.x) - 1)
            yield some, at, self.x[at], self.length[some]


def batched(sizes: np.ndarray, cells: int) -> Iterator[np.ndarray]:
    """Numbers of items of similar size whose padded cells stay within the limit."""
    order, a = np.argsort(sizes, kind="stable"), 0
    while a < len(order):
        fits = np.arange(1, len(order) - a + 1) * sizes[order[a:]] * cells <= BATCH_CELLS
        z = a + max(1, int(fits.sum()))
        yield order[a:z]
        a = z


def surroundings(placed: DataFrame, chain: Chain) -> DataFrame:
    """(series_id, part, block, before, opening, behind, best_before, end) of every block: one pass over the rows, one fold over the matrices."""
    k, d = chain.means.shape
    names = [placed.schema[c] for c in ("series_id", "part", "block")]
    number = T.ArrayType(T.DoubleType())

    def matrices(table: pa.Table) -> pa.Table:
        part = Part(table)
        n = len(part.first)
        first, log_first, share, score = np.empty((n, k)), np.empty((n, k)), np.empty((n, k, k)), np.empty((n, k, k))
        for some, _, x, length in part.batches(k * max(d, k)):
            log_b, b, mask = stretches(x, length, chain)
            first[some], log_first[some] = b[:, 0, 0], log_b[:, 0, 0]
            share[some], score[some] = joined(b[:, :, 0], (parts := products(log_b, b, mask, chain))[0], log_b[:, :, 0], parts[1], mask[:, :, 0], chain)
        keys = part.rows.select(["series_id", "part", "block", "dt"]).take(pa.array(part.first))
        return pa.Table.from_arrays([*keys.columns, *map(lists, (first, log_first, share, score))], names=schema.names)

    schema = T.StructType([*names, T.StructField("since", placed.schema["dt"].dataType), *[T.StructField(n, number) for n in ("first", "log_first", "share", "score")]])
    runs = stored(placed.groupBy("part").applyInArrow(matrices, schema), "block-matrices")
    # No number of partitions is given, so few matrices share a task instead of filling every partition of the shuffle.
    placed_runs = runs.withColumn("grp", F.lit(0)).repartition("series_id").sortWithinPartitions("series_id", "since")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_sequences(frames):
            name = pd.factorize(pdf["series_id"], use_na_sentinel=False)[0]
            start = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
            size = np.diff(np.r_[start, len(pdf)])
            columns = [np.stack(pdf[c].to_numpy()).astype(float) for c in ("first", "log_first", "share", "score")]
            for some in batched(size, k * k):
                at = np.minimum(start[some, None] + np.arange(size[some].max()), len(pdf) - 1)
                real = np.arange(at.shape[1]) < size[some, None]
                first, log_first, share, score = (c[at] for c in columns)
                none, n, shape = np.zeros((len(some), k)), len(some), (*at.shape, k, k)
                alpha, beta, scores, ends = entries(first, share.reshape(shape), log_first, score.reshape(shape), real, chain, none,
                                                    np.ones(n, bool), np.full((n, k), 1 / k), none, np.full(n, -1))
                opening = np.broadcast_to(np.arange(at.shape[1]) == 0, at.shape)
                out = pdf.loc[at[real], ["series_id", "part", "block"]]
                yield out.assign(before=list(alpha[:, :-1][real]), opening=opening[real], behind=list(beta[real]),
                                 best_before=list(scores[:, :-1][real]), end=ends[real].astype("int32"))

    out = T.StructType([*names, T.StructField("before", number), T.StructField("opening", T.BooleanType()), T.StructField("behind", number),
                        T.StructField("best_before", number), T.StructField("end", T.IntegerType())])
    return placed_runs.mapInPandas(fold, out)


def around(part: Part, known: pa.Table) -> tuple[np.ndarray, ...]:
    """What surrounds the blocks of a part, in their order."""
    known = known.sort_by([("series_id", "ascending"), ("block", "ascending")])
    if not np.array_equal(known["block"].to_numpy(), part.rows["block"].to_numpy()[part.first]):
        raise ValueError("blocks and their surroundings differ")
    before, behind, best_before = (vectors(known[c]) for c in ("before", "behind", "best_before"))
    return before, known["opening"].to_numpy(), behind, best_before, known["end"].to_numpy().astype(int)


def decode(
    rows: DataFrame, chain: Chain, series: str = "series_id", date: str = "dt", x: str = "x", method: str = "posterior", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(series, dt, p, state) as `sequence.decode` gives them, for series of any length: a task holds one part of the days.

    Blocks of a series are folded in one task, as k x k matrices: a thousand million days are some 8,000 of them.
    """
    if method not in ("posterior", "filtered", "viterbi"):
        raise ValueError(f"unknown method {method!r}")
    k, d = chain.means.shape
    placed = in_blocks(rows, series, date, x, block_rows)
    known = stored(surroundings(placed, chain), "block-entries")

    def label(table: pa.Table, beside: pa.Table) -> pa.Table:
        part = Part(table)
        context = around(part, beside)
        shares, states = np.empty((len(part.x), k)), np.empty(len(part.x), "int32")
        for some, at, values, length in part.batches(k * max(d, k)):
            found = finished(values, length, chain, *[c[some] for c in context])
            mask = np.arange(at.shape[1]) < length[:, None]
            own = found["alpha" if method == "filtered" else "gamma"][mask]
            shares[at[mask]] = own
            states[at[mask]] = found["path"][mask] if method == "viterbi" else own.argmax(1)
        return pa.Table.from_arrays([part.rows["series_id"], part.rows["dt"], lists(shares), pa.array(states)], names=schema.names)

    schema = T.StructType([placed.schema["series_id"], placed.schema["dt"], T.StructField("p", T.ArrayType(T.DoubleType())), T.StructField("state", T.IntegerType())])
    both = placed.groupBy("part").cogroup(known.groupBy("part"))
    return both.applyInArrow(label, schema).withColumnsRenamed({"series_id": series, "dt": date})


def statistics(placed: DataFrame, chain: Chain) -> np.ndarray:
    """The sums of one E-step over stored blocks, in the order that `sequence.maximise` takes."""
    k, d = chain.means.shape
    stride = k + k * k + k * (2 * d + 1) + 1
    known = stored(surroundings(placed, chain), "block-entries")

    def add(table: pa.Table, beside: pa.Table) -> pa.Table:
        part = Part(table)
        context, sums = around(part, beside), np.zeros(stride)
        for some, _, values, length in part.batches(k * max(d, k)):
            before, opening, *rest = (c[some] for c in context)
            found = finished(values, length, chain, before, opening, *rest)
            gamma, flat = found["gamma"].reshape(-1, k), values.reshape(-1, d)
            gap = np.stack([gamma[:, j] @ (flat - chain.means[j]) ** 2 for j in range(k)])
            block = np.concatenate([gamma.sum(0)[:, None], gamma.T @ flat, gap], 1)
            sums += np.concatenate([found["gamma"][opening, 0].sum(0), found["counts"].ravel(), block.ravel(), [found["level"]]])
        return pa.table({"grp": np.zeros(stride, "int32"), "slot": np.arange(stride, dtype="int32"), "value": sums})

    both = placed.groupBy("part").cogroup(known.groupBy("part"))
    return sum_slots(both.applyInArrow(add, SLOT_SCHEMA), stride)[0]
