"""Exact top-k by inner product: a KD-tree per shard, searched best-first with the k-th score known so far."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.vectors import BLOCK_QUERIES, Best, Index, dealt, exact_type, in_waves, longest, matrix, nothing, queries_of, whole
from panelloom.session import stored

LEAF_ROWS = 256
SHARDS = "dim int, grp int, shard int, width int, ids binary, points binary, lo binary, hi binary, least_id binary"


def cuts(rows: int) -> list[tuple[int, int]]:
    """Row ranges of the nodes, children of node i at 2i+1 and 2i+2; all leaves at one depth."""
    depth = 0
    while rows > LEAF_ROWS << depth:
        depth += 1
    out = [(0, rows)]
    for i in range((1 << depth) - 1):
        a, b = out[i]
        out += [(a, (a + b) // 2), ((a + b) // 2, b)]
    return out


def plant(points: np.ndarray, ids: np.ndarray):
    """(order of the rows, lo, hi, least id): a tree of median splits along the widest side, with each node's tight box."""
    order = np.argsort(ids, kind="stable")
    nodes = cuts(len(ids))
    inner = len(nodes) // 2
    for a, b in nodes[:inner]:
        own = points[order[a:b]]
        side = int((own.max(0).astype(np.float64) - own.min(0)).argmax()) if own.shape[1] else None
        if side is not None:
            order[a:b] = order[a:b][np.argsort(own[:, side], kind="stable")]
    rows, ids = points[order], ids[order]
    lo = np.array([rows[a:b].min(0) for a, b in nodes], rows.dtype)
    hi = np.array([rows[a:b].max(0) for a, b in nodes], rows.dtype)
    return order, lo, hi, np.array([ids[a:b].min() for a, b in nodes], np.int64)


def _build(key, table):
    dim, grp, shard = (k.as_py() for k in key)
    points, ids = matrix(table.column("width"), table.column("v")), table.column("vec_id").to_numpy()
    order, lo, hi, least = plant(points, ids)
    row = {"dim": dim, "grp": grp, "shard": shard, "width": points.dtype.itemsize, "ids": ids[order].tobytes(), "points": points[order].tobytes(),
           "lo": lo.tobytes(), "hi": hi.tobytes(), "least_id": least.tobytes()}
    return pa.table({n: pa.array([x], pa.binary() if isinstance(x, bytes) else pa.int32()) for n, x in row.items()})


class Shard:
    def __init__(self, row: dict):
        kind, dim = f"<i{row['width']}", row["dim"]
        self.ids, self.least = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["least_id"], np.int64)
        self.points = np.frombuffer(row["points"], kind).reshape(len(self.ids), dim)
        self.lo, self.hi = (np.frombuffer(row[c], kind).reshape(len(self.least), dim) for c in ("lo", "hi"))
        self.length = longest(self.points)
        # A box's far corner may be longer than any row in it.
        self.corner = longest(np.maximum(np.abs(self.lo.astype(np.float64)), np.abs(self.hi.astype(np.float64))))
        self.nodes = cuts(len(self.ids))
        self.inner = len(self.nodes) // 2

    def visit(self, points: np.ndarray, length: float, own: np.ndarray, best: Best) -> None:
        """Offer the shard's rows to a block of queries. Each turn every query takes the open node of its highest bound."""
        kind = exact_type(length, self.length)
        q, rows = points.astype(kind), self.points.astype(kind)
        # Where bounds could be rounded all nodes are open.
        sure = exact_type(length, self.corner) is not np.int64
        up, down = np.maximum(points, 0).astype(np.float64), np.minimum(points, 0).astype(np.float64)
        lo, hi = self.lo.astype(np.float64), self.hi.astype(np.float64)
        bound = lambda who, n: up[who] @ hi[n] + down[who] @ lo[n] if sure else np.full(len(who), np.inf)
        every = np.arange(len(q))
        open_ = np.full((len(q), len(self.nodes)), -np.inf)
        open_[:, 0] = bound(every, 0)
        while True:
            node = open_.argmax(1)
            value = open_[every, node]
            # A node that only ties with the k-th score helps where it holds a smaller id.
            live = (value > -np.inf) & (value >= best.t)
            useful = live & ((value > best.t) | (self.least[node] <= best.t_id))
            if not live.any():
                return
            open_[every[live], node[live]] = -np.inf
            for n in np.unique(node[useful]):
                who = np.flatnonzero(useful & (node == n))
                if n < self.inner:
                    for child in (2 * n + 1, 2 * n + 2):
                        open_[who, child] = bound(who, child)
                    continue
                a, b = self.nodes[n]
                scores = (q[who] @ rows[a:b].T).astype(np.int64)
                ok = best.reached(scores, who) & (self.ids[a:b] != own[who][:, None])
                row, col = np.nonzero(ok)
                best.add(who[row], scores[row, col], self.ids[a:b][col])


def _search(k: int):
    def search(queries, shards):
        if not queries.num_rows or not shards.num_rows:
            return nothing()
        trees = [Shard(row) for row in shards.to_pylist()]
        points = matrix(queries.column("width"), queries.column("v"))
        q_id, q_of, w, t, t_id = (queries.column(c).to_numpy() for c in ("q_id", "q_of", "w", "t", "t_id"))
        out = []
        for a in range(0, len(q_id), BLOCK_QUERIES):
            part = slice(a, a + BLOCK_QUERIES)
            best = Best(t[part], t_id[part], k)
            for tree in trees:
                tree.visit(points[part], longest(points[part]), q_id[part], best)
            out.append(best.rows(q_id[part], q_of[part], w[part]))
        return pa.concat_tables(out) if out else nothing()

    return search


def build(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> Index:
    """Index a table of vectors: floor(scale * x) per component, rows dealt into shards by hash, a stored KD-tree for each."""
    rows, groups = dealt(whole(df, key, vector, scale), df.count())
    shards = rows.groupBy("dim", "grp", "shard").applyInArrow(_build, SHARDS)
    return Index(stored(shards, "kd-shards"), groups, scale, key, vector)


def top_k(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k indexed rows of highest integer inner product for every query row: q_id, q_of, rank, vec_id, score.

    Higher scores come first, ties by smaller id; fewer than k rows where there are fewer. A row is no
    candidate of a query with its id. Rows with a null id or vector, or with a null or non-finite component,
    take no part. Rows equal in id and vector are one row; rows sharing only the id are queries of their own,
    numbered by q_of. Vectors of different length never meet; those of length 0 score 0. Values beyond 64 bits
    saturate, products beyond them wrap. Columns other than key and vector are ignored, whatever their names.
    An empty table on either side gives no rows.
    """
    given = queries_of(index, queries).withColumn("w", F.lit(0))
    return in_waves(index, given, k, _search(k)).select("q_id", "q_of", "rank", "vec_id", "score")


SQL = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
