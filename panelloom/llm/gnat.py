"""Hard negatives from a multiway hyperplane tree per shard, searched by annuli around the anchors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.vectors import (
    BLOCK_QUERIES, LEAST, MOST, Best, Index, dealt, exact_type, in_waves, longest, matrix, nothing, queries_of, whole,
)
from panelloom.session import stored

LEAF_ROWS, WAYS = 256, 16
# Distances come from exact integers; this covers the rounding of square roots and sums.
SLACK = 1e-6
SHARDS = ("dim int, grp int, shard int, width int, ids binary, points binary, labels array<string>, label binary, "
          "nodes binary, norms binary, only binary, pivots binary, near binary, far binary")


def squares(points: np.ndarray) -> np.ndarray:
    return (points.astype(np.float64) ** 2).sum(1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between all rows of a and of b."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return np.sqrt(np.maximum(squares(a)[:, None] + squares(b) - 2 * (a @ b.T), 0))


def split_points(points: np.ndarray) -> np.ndarray:
    """Rows far from each other: each next one is the farthest, among every few rows, from those already taken."""
    among = np.arange(0, len(points), max(1, len(points) // (3 * WAYS)))
    taken = [0]
    away = distances(points[among], points[among[:1]])[:, 0]
    while len(taken) < WAYS and away.max() > 0:
        taken.append(int(away.argmax()))
        away = np.minimum(away, distances(points[among], points[among[taken[-1:]]])[:, 0])
    return among[taken]


class Tree:
    """Nodes in the order of their making: rows a..b of `order`, first child and number of children (0: a leaf)."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, code: np.ndarray):
        self.points, self.code = points, code
        self.order = np.argsort(ids, kind="stable")
        self.nodes, self.pivots, self.near, self.far = [[0, len(ids), 0, 0]], [], [], []
        n = 0
        while n < len(self.nodes):
            self._split(n)
            n += 1

    def _split(self, n: int) -> None:
        a, b = self.nodes[n][:2]
        if b - a <= LEAF_ROWS:
            return
        own = self.order[a:b].copy()
        pivots = split_points(self.points[own])
        if len(pivots) < 2:
            return  # Equal rows: no hyperplane parts them.
        away = distances(self.points[own], self.points[own[pivots]])
        side = away.argmin(1)
        by = np.argsort(side, kind="stable")
        self.order[a:b], away, side = own[by], away[by], side[by]
        edge = np.searchsorted(side, np.arange(len(pivots) + 1))
        # The distance range from each split point (rows) to each subtree (columns).
        self.near.append(np.array([away[x:y].min(0) for x, y in zip(edge, edge[1:])]).T)
        self.far.append(np.array([away[x:y].max(0) for x, y in zip(edge, edge[1:])]).T)
        self.pivots.append(own[pivots])
        self.nodes[n][2:] = [len(self.nodes), len(pivots)]
        self.nodes += [[a + int(x), a + int(y), 0, 0] for x, y in zip(edge, edge[1:])]

    def row(self) -> dict:
        """The tree as bytes. Split points are kept as rows of the shard's order."""
        place = np.empty(len(self.order), np.int32)
        place[self.order] = np.arange(len(self.order))
        size, code = squares(self.points)[self.order], self.code[self.order]
        ranges = [(a, b) for a, b, _, _ in self.nodes]
        join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *[p.ravel() for p in parts]]).astype(kind).tobytes()
        return {
            "nodes": np.array(self.nodes, np.int32).tobytes(), "norms": np.array([(size[a:b].min(), size[a:b].max()) for a, b in ranges]).tobytes(),
            "only": np.array([code[a] if (code[a:b] == code[a]).all() else -1 for a, b in ranges], np.int32).tobytes(),
            "pivots": join([place[p] for p in self.pivots], np.int32), "near": join(self.near, np.float64), "far": join(self.far, np.float64)}


def _build(key, table):
    dim, grp, shard = (k.as_py() for k in key)
    points, ids = matrix(table.column("width"), table.column("v")), table.column("vec_id").to_numpy()
    labels, code = np.unique(np.array(table.column("label").to_pylist(), object), return_inverse=True)
    tree = Tree(points, ids, code)
    row = {"dim": dim, "grp": grp, "shard": shard, "width": points.dtype.itemsize, "ids": ids[tree.order].tobytes(), "points": points[tree.order].tobytes(),
           "labels": labels.tolist(), "label": code[tree.order].astype(np.int32).tobytes(), **tree.row()}
    kind = {bytes: pa.binary(), list: pa.list_(pa.string()), int: pa.int32()}
    return pa.table({n: pa.array([x], kind[type(x)]) for n, x in row.items()})


class Windows:
    """A block of searches: each has a point, a label, score bounds and the rows found for it so far."""

    def __init__(self, table: pa.Table, k: int):
        self.q_id, self.q_of, self.w, t, t_id, self.low, self.high = (table.column(c).to_numpy() for c in ("q_id", "q_of", "w", "t", "t_id", "low", "high"))
        first = np.ones(len(self.q_id), bool)
        first[1:] = (self.q_id[1:] != self.q_id[:-1]) | (self.q_of[1:] != self.q_of[:-1])
        self.point = np.cumsum(first) - 1
        some = table.take(pa.array(np.flatnonzero(first)))
        self.points = matrix(some.column("width"), some.column("v"))
        self.length, self.square = longest(self.points), squares(self.points)
        self.label = table.column("label").to_pylist()
        self.best = Best(t, t_id, k)

    def least(self, who: np.ndarray) -> np.ndarray:
        """The lowest score that still helps."""
        return np.maximum(self.low[who], self.best.t[who])


class Shard:
    def __init__(self, row: dict, same: bool):
        self.same, kind = same, f"<i{row['width']}"
        self.ids, self.label = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["label"], np.int32)
        self.points = np.frombuffer(row["points"], kind).reshape(len(self.ids), row["dim"])
        self.length = longest(self.points)
        self.labels = {x: i for i, x in enumerate(row["labels"])}
        self.nodes = np.frombuffer(row["nodes"], np.int32).reshape(-1, 4)
        self.norms, self.only = np.frombuffer(row["norms"]).reshape(-1, 2), np.frombuffer(row["only"], np.int32)
        ways = self.nodes[:, 3].astype(np.int64)
        pivots, near, far = np.frombuffer(row["pivots"], np.int32), np.frombuffer(row["near"]), np.frombuffer(row["far"])
        at, square = np.cumsum(ways) - ways, np.cumsum(ways**2) - ways**2
        self.split = {n: (pivots[at[n]:at[n] + m], *(x[square[n]:square[n] + m * m].reshape(m, m) for x in (near, far))) for n, m in enumerate(ways) if m}

    def visit(self, windows: Windows) -> None:
        kind = exact_type(windows.length, self.length)
        self.sure, self.rows, self.q = kind is not np.int64, self.points.astype(kind), windows.points.astype(kind)
        self.code = np.array([self.labels.get(x, -1) for x in windows.label], np.int32)
        self._down(0, np.arange(len(windows.point)), windows)

    def _down(self, n: int, who: np.ndarray, windows: Windows) -> None:
        a, b, child, ways = self.nodes[n]
        if self.only[n] >= 0:  # All rows have one label.
            who = who[(self.code[who] == self.only[n]) == self.same]
        if not len(who):
            return
        if not ways:
            for x in range(a, b, LEAF_ROWS):
                self._leaf(x, min(x + LEAF_ROWS, b), who, windows)
            return
        pivots, near, far = self.split[n]
        asked, of = np.unique(windows.point[who], return_inverse=True)
        if not self.sure:
            for j in range(ways):
                self._down(child + j, who, windows)
            return
        away = distances(self.q[asked], self.rows[pivots])
        # By the triangle inequality: no row of a subtree is closer to the asked point than `inner`, none farther than `outer`.
        inner = np.maximum(away[:, :, None] - far, near - away[:, :, None]).max(1) - SLACK
        outer = (away[:, :, None] + far).min(1) + SLACK
        for j in away.mean(0).argsort(kind="stable"):
            size = windows.square[windows.point[who]]
            low, high = windows.least(who), windows.high[who]
            # Scores low..high are distances of this annulus, for rows as long as the subtree's.
            most = size + self.norms[child + j, 1] - 2.0 * low
            least = size + self.norms[child + j, 0] - 2.0 * high
            meets = (most >= 0) & (inner[of, j] <= np.sqrt(np.maximum(most, 0))) & (outer[of, j] >= np.sqrt(np.maximum(least, 0)))
            self._down(child + j, who[meets], windows)

    def _leaf(self, a: int, b: int, who: np.ndarray, windows: Windows) -> None:
        asked, of = np.unique(windows.point[who], return_inverse=True)
        scores = (self.q[asked] @ self.rows[a:b].T).astype(np.int64)[of]
        ok = (scores >= windows.least(who)[:, None]) & (scores <= windows.high[who][:, None])
        row, col = np.nonzero(ok)
        fits = ((self.label[a:b][col] == self.code[who][row]) == self.same) & (self.ids[a:b][col] != windows.q_id[who][row])
        row, col = row[fits], col[fits]
        windows.best.add(who[row], scores[row, col], self.ids[a:b][col])


def _search(k: int, same: bool):
    def search(queries, shards):
        if not queries.num_rows or not shards.num_rows:
            return nothing()
        queries = queries.sort_by([(c, "ascending") for c in ("q_id", "q_of", "w")])
        trees = [Shard(row, same) for row in shards.to_pylist()]
        out = []
        for a in range(0, queries.num_rows, BLOCK_QUERIES):
            windows = Windows(queries.slice(a, BLOCK_QUERIES), k)
            for tree in trees:
                tree.visit(windows)
            out.append(windows.best.rows(windows.q_id, windows.q_of, windows.w))
        return pa.concat_tables(out)

    return search


def build(df: DataFrame, label: Column, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> Index:
    """Index a table of labelled vectors: rows dealt into shards by hash, a stored tree for each."""
    rows, groups = dealt(whole(df.where(label.isNotNull()), key, vector, scale, label), df.count())
    shards = rows.groupBy("dim", "grp", "shard").applyInArrow(_build, SHARDS)
    return Index(stored(shards, "gnat-shards"), groups, scale, key, vector)


def percent(score: str, share: int, up: bool) -> Column:
    """share percent of a score, rounded up or down without loss."""
    return F.expr(f"cast({'ceil' if up else 'floor'}(cast({score} as decimal(20, 0)) * {share} / 100) as long)")


def mine(index: Index, anchors: DataFrame, label: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """For each anchor and each of its first `positives` rows of its label, the first `negatives` rows of other
    labels whose score lies between `low` and `high` percent of the positive's: anchor_id, anchor_of, positive_id,
    positive_rank, rank, negative_id, positive_score, negative_score.

    Scores are integer inner products with the anchor; higher ones come first, ties by smaller id. Rows with
    a null id, label or vector, or with a null or non-finite component, take no part; an anchor is no row of its own
    search. Rows equal in id, label and vector are one row; anchors sharing only the id are numbered by anchor_of.
    Vectors of different length never meet. A positive whose window is empty (a negative score) or holds no row
    gives no rows, nor does an anchor without another row of its label, nor an empty table. Values beyond 64 bits
    saturate. Columns other than those named are ignored, whatever their names.
    """
    given = queries_of(index, anchors.where(label.isNotNull()), label)
    free = given.withColumns({"w": F.lit(0), "low": F.lit(LEAST), "high": F.lit(MOST)})
    found = stored(in_waves(index, free, positives, _search(positives, same=True)).select(
        "q_id", "q_of", (F.col("rank") - 1).alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    bounds = found.select("q_id", "q_of", "w", percent("positive_score", low, True).alias("low"), percent("positive_score", high, False).alias("high"))
    windows = stored(given.join(bounds.where("low <= high"), ["q_id", "q_of"]), "windows")
    return in_waves(index, windows, negatives, _search(negatives, same=False)).join(found, ["q_id", "q_of", "w"]).select(
        F.col("q_id").alias("anchor_id"), F.col("q_of").alias("anchor_of"), "positive_id", (F.col("w") + 1).alias("positive_rank"), "rank",
        F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM rows a JOIN rows c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
  n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positives JOIN scored n USING (anchor_id)
WHERE NOT n.same AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) <= 3
"""
