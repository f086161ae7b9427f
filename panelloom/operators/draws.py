"""Starting values for model fits, drawn the same way however rows are partitioned."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.session import stored


def smallest_digests(rows: DataFrame, row_id: str, k: int, restarts: int, seed: int, spans: dict | None) -> DataFrame:
    """(grp, restart, draw, row_id): each task's k smallest digests per group and restart; ids travel, vectors don't.

    A row belongs to its group `grp`, or to every span that holds its calendar position `i`.
    """
    place = "grp" if spans is None else "i"

    def keep(batches):
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            ids, at = batch.column("row_id").to_pylist(), np.asarray(batch.column(place))
            if not ids:
                continue
            members = {int(g): np.flatnonzero(at == g) for g in np.unique(at)} if spans is None else {
                g: np.flatnonzero((at >= s.lo) & (at < s.hi)) for g, s in spans.items()}
            for r in range(restarts):
                digest = [hashlib.md5(f"{r + seed}:{i}".encode()).hexdigest() for i in ids]
                rank = np.array([int(x[:16], 16) for x in digest], np.uint64)
                for g, own in members.items():
                    if len(own) > k:
                        own = own[rank[own] <= np.partition(rank[own], k - 1)[k - 1]]
                    best = held.get((g, r), []) + [(digest[i], ids[i]) for i in own]
                    held[g, r] = sorted(best)[:k]
        found = [(g, r, draw, i) for (g, r), best in held.items() for draw, i in best]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[n] for f in found], kind) for n, kind in enumerate((pa.int32(), pa.int32(), pa.string(), pa.string()))],
            names=["grp", "restart", "draw", "row_id"])

    return rows.select(place, F.col(row_id).cast("string").alias("row_id")).mapInArrow(keep, "grp int, restart int, draw string, row_id string")


def starting_rows(rows: DataFrame, row_id: str, x: str, k: int, restarts: int, seed: int = 42, spans: dict | None = None) -> dict[int, np.ndarray]:
    """(group, restart, k, d) array: per restart the k rows with the smallest digest; row ids are unique within a group.

    Tasks return their smallest digests with ids; the vectors of the chosen ids are looked up by one join with
    that parameter-sized table. With `spans` the groups are windows of the calendar position `i`.
    """
    order = Window.partitionBy("grp", "restart").orderBy("draw", "row_id")
    picked = smallest_digests(rows, row_id, k, restarts, seed, spans).withColumn("k", F.row_number().over(order)).where(F.col("k") <= k)
    picked = stored(picked.select("grp", "restart", "k", "row_id"), "starting-rows")
    named = rows.select(*([] if spans else ["grp"]), F.col(row_id).cast("string").alias("row_id"), F.col(x).alias("x"))
    found = named.join(picked, ["row_id"] if spans else ["grp", "row_id"])
    out: dict[int, dict[int, list]] = {}
    for row in found.orderBy("grp", "restart", "k").select("grp", "restart", "x").collect():
        out.setdefault(row["grp"], {}).setdefault(row["restart"], []).append(row["x"])
    short = [(g, r) for g, byr in out.items() for r, means in byr.items() if len(means) < k]
    if short or not out:
        raise ValueError(f"fewer than {k} rows to start from")
    return {g: np.array([byr[r] for r in range(restarts)], dtype=float) for g, byr in out.items()}


def spread(rows: DataFrame, x: str, d: int) -> dict[int, np.ndarray]:
    """Population variance of every dimension per group."""
    stats = rows.groupBy("grp").agg(*[F.var_pop(F.col(x)[i]).alias(f"v{i}") for i in range(d)])
    return {row["grp"]: np.array([row[f"v{i}"] for i in range(d)], dtype=float) for row in stats.collect()}


# Partial sums of up to this many values (16 MB) are added up on the driver instead of being shuffled.
MOST_PARTIAL = 1 << 20


def sum_slots(partial: DataFrame, size: int, values: int | None = None) -> dict[int, np.ndarray]:
    """Add partial statistics (grp, slot, value) and bring the parameter-sized sums home.

    `values` bounds how many there can be: tasks times parameters. A small number saves each pass its shuffle.
    """
    if values is None or values > MOST_PARTIAL:
        partial = partial.groupBy("grp", "slot").agg(F.sum("value").alias("value"))
    found = partial.toArrow()
    grp, slot, value = (found.column(c).to_numpy() for c in ("grp", "slot", "value"))
    out: dict[int, np.ndarray] = {}
    for g in np.unique(grp):
        own = grp == g
        out[int(g)] = np.zeros(size)
        np.add.at(out[int(g)], slot[own], value[own])
    return out


SLOT_SCHEMA = "grp int, slot int, value double"
