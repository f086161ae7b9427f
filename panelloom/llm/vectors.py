"""Integer vectors in shards, and queries that meet every shard part by part.

A search deals the indexed rows into shards, shards into groups and queries into parts. Every
(group, part) pair is one task whose size is bounded on both sides, so neither the rows nor the
queries are ever held whole: rows travel once per part, queries once per group. Groups are taken in
waves of growing size, and each wave starts from the k-th score that the waves before it have found.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.session import stored

SHARD_ROWS = 4096
# Most rows of a group (32 MB at 64 components of two bytes) and most queries of a part.
GROUP_ROWS = 1 << 18
PART_QUERIES = 1 << 17
# Queries that a task works on at a time.
BLOCK_QUERIES = 1024
# Shares of the groups that are searched by the end of each wave.
WAVES = (1 / 64, 1 / 8, 1)
LEAST = -(1 << 63)
MOST = (1 << 63) - 1

WHOLE = "vec_id long, label string, width int, v binary"
FOUND = "q_id long, q_of int, w int, vec_id long, score long"


def to_whole(batches, scale: int):
    """Rows (vec_id, label, list) as integers floor(scale * x), in the narrowest width that holds a row.

    Rows with a null id, a null list, or a null or non-finite component are left out. Values beyond 64 bits saturate.
    """
    for batch in batches:
        vectors = batch.column("v")
        keep = np.flatnonzero(np.asarray(vectors.is_valid()) & np.asarray(batch.column("vec_id").is_valid()))
        vectors, rest = vectors.take(pa.array(keep)), batch.take(pa.array(keep))
        at = np.asarray(vectors.offsets, np.int64)
        values = vectors.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
        at = at - at[0] if len(at) else at
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        length = np.diff(at)
        good = bad[at[1:]] == bad[at[:-1]]
        for size in np.unique(length[good]):
            own = np.flatnonzero(good & (length == size))
            real = np.floor(values[at[own][:, None] + np.arange(size)] * scale)
            whole = np.where(real >= 2.0**63, MOST, np.where(real <= -(2.0**63), LEAST, 0))
            inner = np.abs(real) < 2.0**63
            whole[inner] = real[inner].astype(np.int64)
            high = np.maximum(whole.max(1), -(whole.min(1) + 1)) if size else np.zeros(len(own), np.int64)
            width = np.where(high < 1 << 15, 2, np.where(high < 1 << 31, 4, 8))
            for w in np.unique(width):
                some = np.flatnonzero(width == w)
                data = whole[some].astype(f"<i{w}")
                offsets = np.arange(len(some) + 1, dtype=np.int32) * np.int32(size * w)
                packed = pa.BinaryArray.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
                rows = rest.take(pa.array(own[some]))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("vec_id"), rows.column("label"), pa.array(np.full(len(some), w, np.int32)), packed], names=["vec_id", "label", "width", "v"])


def whole(df: DataFrame, key: str, vector: str, scale: int, label: Column | None = None) -> DataFrame:
    """Distinct rows (vec_id, label, width, v) of a table of vectors, as integers."""
    label = F.lit(None) if label is None else label
    given = df.select(F.col(key).cast("long").alias("vec_id"), label.cast("string").alias("label"), F.col(vector).alias("v"))
    return given.mapInArrow(lambda batches: to_whole(batches, scale), WHOLE).distinct()


def matrix(width: pa.ChunkedArray, v: pa.ChunkedArray) -> np.ndarray:
    """Rows of one length as one array of the widest width among them."""
    widths = np.asarray(width)
    size = len(v[0].as_py()) // int(widths[0])
    out = np.empty((len(widths), size), f"<i{int(widths.max())}")
    for w in np.unique(widths):
        some = np.flatnonzero(widths == w)
        out[some] = np.frombuffer(b"".join(v.take(pa.array(some)).to_pylist()), f"<i{w}").reshape(len(some), size)
    return out


def longest(points: np.ndarray) -> float:
    """An upper bound of the length of the rows."""
    return float(np.sqrt((points.astype(np.float64) ** 2).sum(1).max(initial=0))) * (1 + 1e-12)


def exact_type(a: float, b: float):
    """The fastest type in which inner products of rows no longer than a and b have no rounding."""
    most = a * b
    return np.float32 if most < 2.0**23 else np.float64 if most < 2.0**52 else np.int64


@dataclass(frozen=True)
class Index:
    """Stored shards. `shards` has a row for each: dim, grp, ids, points and the tree's own columns."""

    shards: DataFrame
    groups: int
    scale: int
    key: str
    vector: str


def dealt(rows: DataFrame, total: int) -> tuple[DataFrame, int]:
    """Rows with their shard and its group; both counts follow the number of rows."""
    shards = max(1, math.ceil(total / SHARD_ROWS))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    groups = max(math.ceil(total / GROUP_ROWS), min(shards, 2 * cores))
    shard = F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int")
    return rows.select("*", (F.octet_length("v") / F.col("width")).cast("int").alias("dim"), shard.alias("shard")).withColumn(
        "grp", F.col("shard") % groups), groups


def queries_of(index: Index, df: DataFrame, label: Column | None = None) -> DataFrame:
    """Stored query rows (q_id, q_of, label, width, v, dim, part). Rows that share an id are told apart by q_of."""
    rows = whole(df, index.key, index.vector, index.scale, label)
    own = Window.partitionBy("vec_id").orderBy("v", "label")
    parts = max(1, math.ceil(df.count() / PART_QUERIES))
    return stored(rows.select(
        F.col("vec_id").alias("q_id"), (F.row_number().over(own) - 1).alias("q_of"), "label", "width", "v",
        (F.octet_length("v") / F.col("width")).cast("int").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"), F.lit(parts).alias("parts"),
    ), "vector-queries")


def best(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each query and window, with their rank."""
    order = Window.partitionBy("q_id", "q_of", "w").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def in_waves(index: Index, queries: DataFrame, k: int, search) -> DataFrame:
    """The k first rows of every query (q_id, q_of, w), from all shards of its length.

    `queries` has q_id, q_of, w, dim, part, parts and what `search` needs. `search(query table, shard table)` returns
    FOUND rows: of the shards at hand the first k of each query that are not below (t, t_id), the k-th known so far.
    """
    found = None
    parts = queries.select("parts").first()
    parts = parts[0] if parts else 1
    own = ["q_id", "q_of", "w"]
    done = 0
    for share in WAVES:
        until = max(1, math.ceil(index.groups * share))
        if until == done:
            continue
        if found is None:
            known = queries.withColumns({"t": F.lit(LEAST), "t_id": F.lit(MOST)})
        else:
            last = best(found, k).where(F.col("rank") == k).select(*own, F.col("score").alias("t"), F.col("vec_id").alias("t_id"))
            known = queries.join(last, own, "left").fillna({"t": LEAST, "t_id": MOST})
        sent = known.withColumn("grp", F.explode(F.sequence(F.lit(done), F.lit(until - 1))))
        rows = index.shards.where((F.col("grp") >= done) & (F.col("grp") < until)).withColumn(
            "part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        keys = ["dim", "grp", "part"]
        new = stored(sent.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(search, FOUND), "vector-wave")
        found = new if found is None else found.unionByName(new)
        done = until
    return best(found, k)


class Best:
    """The first k rows so far of each query of a block, by score downwards and id upwards."""

    def __init__(self, t: np.ndarray, t_id: np.ndarray, k: int):
        self.k, self.t, self.t_id = k, t.copy(), t_id.copy()
        self.score = np.full((len(t), k), LEAST, np.int64)
        self.id = np.full((len(t), k), MOST, np.int64)

    def reached(self, scores: np.ndarray, who: np.ndarray) -> np.ndarray:
        return scores >= self.t[who][:, None]

    def add(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Offer rows (query, score, id)."""
        ok = (score > self.t[who]) | ((score == self.t[who]) & (ids <= self.t_id[who]))
        who, score, ids = who[ok], score[ok], ids[ok]
        if not len(who):
            return
        own = np.unique(who)
        all_who = np.concatenate([np.repeat(own, self.k), who])
        all_score = np.concatenate([self.score[own].ravel(), score])
        all_id = np.concatenate([self.id[own].ravel(), ids])
        # Scores may be the least long, which has no negative: they are turned over bitwise.
        order = np.lexsort((all_id, ~all_score, all_who))
        all_who, all_score, all_id = all_who[order], all_score[order], all_id[order]
        start = np.searchsorted(all_who, own)
        pick = start[:, None] + np.arange(self.k)
        self.score[own], self.id[own] = all_score[pick], all_id[pick]
        full = self.id[own, -1] < MOST
        own = own[full]
        last, last_id = self.score[own, -1], self.id[own, -1]
        better = (last > self.t[own]) | ((last == self.t[own]) & (last_id < self.t_id[own]))
        self.t[own[better]], self.t_id[own[better]] = last[better], last_id[better]

    def rows(self, q_id: np.ndarray, q_of: np.ndarray, w: np.ndarray) -> pa.Table:
        row, col = np.nonzero(self.id < MOST)
        return found_table(q_id[row], q_of[row], w[row], self.id[row, col], self.score[row, col])


def found_table(*columns) -> pa.Table:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["q_id", "q_of", "w", "vec_id", "score"])


def nothing() -> pa.Table:
    return found_table(*[np.zeros(0, np.int64)] * 5)
