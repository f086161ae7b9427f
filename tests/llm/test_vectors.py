"""Searches over vectors against plain loops, with nulls, repeats, ties, odd lengths and large values."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from panelloom.llm import gnat, kdtree, vectors

SCHEMA = "vec_id long, embedding array<double>, label int, q_id long, score string, part int, t double, low long"


@pytest.fixture(autouse=True)
def small_sizes(monkeypatch):
    """Trees of many levels, and many groups, parts and blocks."""
    for module, name, value in (
        (vectors, "SHARD_ROWS", 60), (vectors, "GROUP_ROWS", 150), (vectors, "PART_QUERIES", 12), (kdtree, "BLOCK_QUERIES", 5),
        (gnat, "BLOCK_QUERIES", 7), (kdtree, "LEAF_ROWS", 6), (gnat, "LEAF_ROWS", 6), (gnat, "WAYS", 4),
    ):
        monkeypatch.setattr(module, name, value)


def given_rows():
    rng = random.Random(5)
    near = [[rng.gauss(0, 0.4) for _ in range(6)] for _ in range(9)]
    rows = []
    for i in range(430):
        base = near[i % 9] if i % 3 else near[0]
        spread = 0 if i % 4 == 0 else 0.2
        rows.append((i, [x + rng.gauss(0, spread) for x in base], rng.randrange(3)))
    rows += [
        rows[20], rows[40],  # repeated whole
        (40, [0.5] * 6, 1), (60, rows[3][1], 2),  # an id used twice
        (500, None, 1), (501, [0.1, None, 0.2, 0.1, 0.1, 0.1], 1), (502, [math.nan] * 6, 1), (503, [math.inf] * 6, 0), (None, [0.1] * 6, 1), (504, [0.2] * 6, None),
        (600, [0.5, 0.25], 1), (601, [0.5, -0.25], 1), (602, [0.4, 0.2], 2), (603, [0.1], 0), (700, [], 1), (701, [], 2), (702, [], 1),
        (800, [3e5] * 4, 1), (801, [-3e5] * 4, 2), (802, [2e5, 3e5, 1.0, 2.0], 1), (803, [2.6e5, 2e5, 1.0, 2.0], 2), (804, [1.0, 2.0, 3.0, 4.0], 1),
        (900, [1e6, 5e5, 1.0], 1), (901, [1e6, 0.0, 2.0], 1), (902, [9e5, 1e4, 2.0], 0), (903, [6e5, 1e4, 2.0], 2),
    ]
    return [(i, v, label, 1, "s", 2, 0.5, 3) for i, v, label in rows]


def whole(rows, scale):
    """Distinct rows that take part, as (id, label, integers)."""
    return sorted({(i, label, tuple(math.floor(scale * x) for x in v)) for i, v, label, *_ in rows
                   if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}, key=repr)


def numbered(rows):
    """Rows with the number of each among those of its id."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[0]].append(row)
    return {key: own for key, own in groups.items()}


def score(a, b):
    return sum(x * y for x, y in zip(a, b))


def first(rows, k):
    return sorted(rows, key=lambda r: (-r[1], r[0]))[:k]


def plain_top(rows, step, k):
    rows = sorted({(i, v) for i, _, v in whole(rows, 1024)})
    return sorted((q, rank, i, s) for q, v in rows if q % step == 0
                  for rank, (i, s) in enumerate(first([(i, score(v, u)) for i, u in rows if i != q and len(u) == len(v)], k), 1))


def plain_negatives(rows, step):
    rows = [r for r in whole(rows, 256) if r[1] is not None]
    out = []
    for a, label, v in rows:
        if a % step:
            continue
        scored = [(i, score(v, u), other == label) for i, other, u in rows if i != a and len(u) == len(v)]
        for p, ps, _ in first([r for r in scored if r[2]], 5):
            fits = [r for r in scored if not r[2] and 50 * ps <= 100 * r[1] <= 95 * ps]
            out += [(a, p, rank, n, ps, ns) for rank, (n, ns, _) in enumerate(first(fits, 3), 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(given_rows(), SCHEMA).repartition(4)


def mined(df, step=20):
    index = gnat.build(df, F.col("label"))
    return sorted(map(tuple, gnat.mine(index, df.where(F.col("vec_id") % step == 0), F.col("label")).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def test_top_k(table):
    index = kdtree.build(table)
    got = kdtree.top_k(index, table.where("vec_id % 20 = 0"), 7).select("q_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == plain_top(given_rows(), 20, 7)


def test_negatives(table):
    got = mined(table)
    assert got == plain_negatives(given_rows(), 20)
    assert len({r[0] for r in got}) > 15


def test_values_beyond_64_bits_neither_fail_nor_reach_others(spark):
    rows = [(20, [1e300, 1.0], 1), (1, [1e18, -1e300], 1), (2, [1e17, 3.0], 0), (40, [0.5, 0.5, 0.5], 1), (41, [0.5, 0.25, 0.5], 0), (42, [0.5, 0.5, 0.75], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = kdtree.top_k(kdtree.build(df), df.where("vec_id % 20 = 0"), 3).collect()
    assert [(r["vec_id"], r["score"]) for r in got if r["q_id"] == 40] == [(42, 512 * 512 * 2 + 512 * 768), (41, 512 * 512 * 2 + 512 * 256)]
    assert len(got) == 4
    assert {r[0] for r in mined(df)} <= {20, 40}


def test_floats_count_as_doubles(spark):
    df = spark.createDataFrame([(0, [0.1, 0.7]), (1, [0.3, -0.2])], "vec_id long, embedding array<float>")
    got = kdtree.top_k(kdtree.build(df), df.where("vec_id = 0"), 3).first()
    assert got["score"] == math.floor(1024 * 0.10000000149011612) * math.floor(1024 * 0.30000001192092896) + math.floor(1024 * 0.699999988079071) * math.floor(1024 * -0.20000000298023224)


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [(20, [1.0, 2.0], 1)]])
def test_nothing_to_find(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert kdtree.top_k(kdtree.build(df), df.where("vec_id % 20 = 0"), 3).collect() == []
    assert mined(df) == []


def test_one_vector_held_by_most_rows(spark):
    """Ties of a hot vector go to the smallest ids, and its rows are spread over the shards."""
    df = spark.range(900).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 < 2, F.array(F.lit(0.5), F.lit(0.5))).otherwise(
        F.array(F.lit(0.5), F.col("id") / 1000)).alias("embedding"), (F.col("id") % 2).cast("int").alias("label"))
    rows = [tuple(r) for r in df.collect()]
    index = kdtree.build(df)
    assert sorted(map(tuple, kdtree.top_k(index, df.where("vec_id % 20 = 0"), 4).select("q_id", "rank", "vec_id", "score").collect())) == plain_top(rows, 20, 4)
    sizes = [r["n"] for r in index.shards.select((F.octet_length("ids") / 8).alias("n")).collect()]
    assert max(sizes) < 4 * sum(sizes) / len(sizes)
    assert mined(df) == plain_negatives(rows, 20)


def test_boxes_and_ranges_prune(spark):
    """Of well parted rows both trees look at few."""
    import numpy as np

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(16, 8)) * 2000
    points = (np.repeat(centres, 40, 0) + rng.normal(size=(640, 8)) * 3).astype(np.int32)
    ids = np.arange(640)
    order, lo, hi, least = kdtree.plant(points, ids)
    shard = kdtree.Shard({"width": 4, "dim": 8, "ids": ids[order].tobytes(), "points": points[order].tobytes(), "lo": lo.tobytes(), "hi": hi.tobytes(), "least_id": least.tobytes()})
    best = vectors.Best(np.array([vectors.LEAST]), np.array([vectors.MOST]), 3)
    seen = []
    best.reached = lambda scores, who: seen.append(scores.size) or vectors.Best.reached(best, scores, who)
    shard.visit(points[:1], vectors.longest(points[:1]), ids[:1], best)
    assert best.score[0].tolist() == sorted((points[1:].astype(np.int64) @ points[0].astype(np.int64)).tolist(), reverse=True)[:3]
    assert sum(seen) < 200
    tree = gnat.Tree(points, ids, np.zeros(640, np.int64))
    built = gnat.Shard({"width": 4, "dim": 8, "ids": ids[tree.order].tobytes(), "points": points[tree.order].tobytes(), "labels": ["a"], "label": np.zeros(640, np.int32).tobytes(), **tree.row()}, True)
    import pyarrow as pa

    near = int(points[0].astype(np.int64) @ points[1].astype(np.int64))
    ask = pa.table({"q_id": [0], "q_of": [0], "w": [0], "t": [vectors.LEAST], "t_id": [vectors.MOST], "low": [near - 1000], "high": [near + 1000], "label": ["a"],
                    "width": [4], "v": pa.array([points[0].tobytes()], pa.binary())})
    windows = gnat.Windows(ask, 3)
    looked = []
    leaf = built._leaf
    built._leaf = lambda a, b, *rest: looked.append(b - a) or leaf(a, b, *rest)
    built.visit(windows)
    assert windows.best.id[0].tolist()[0] < vectors.MOST and sum(looked) < 200
