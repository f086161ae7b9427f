"""Sequences decoded in blocks against the same sequences decoded whole."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.operators import scan, sequence

CHAIN = sequence.Chain(np.array([0.6, 0.3, 0.1]), np.array([[0.9, 0.07, 0.03], [0.1, 0.8, 0.1], [0.25, 0.25, 0.5]]),
                       np.array([[0.0, 0.0], [1.5, -1.0], [-2.0, 2.0]]), np.array([[1.0, 0.5], [0.7, 1.2], [2.0, 1.0]]))


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(8)
    rows = [(name, dt.date(2000, 1, 1) + dt.timedelta(days=i), [float(v) for v in rng.normal((i // 9) % 3 - 1, 1.3, 2)])
            for name, n in (("long", 900), ("short", 7), ("one", 1)) for i in range(n)]
    return spark.createDataFrame(rows, "series_id string, dt date, x array<double>").repartition(5)


@pytest.mark.parametrize("method, block", [("posterior", 100), ("filtered", 37), ("viterbi", 100), ("viterbi", 5000)])
def test_blocks_decode_as_the_whole(panel, method, block):
    whole = {(r["series_id"], r["dt"]): r for r in sequence.decode(panel, CHAIN, method=method).collect()}
    got = scan.decode(panel, CHAIN, method=method, block_rows=block).collect()
    assert len(got) == len(whole)
    for row in got:
        other = whole[row["series_id"], row["dt"]]
        assert np.allclose(row["p"], other["p"], atol=1e-9) and row["state"] == other["state"]


def test_one_series_fills_many_tasks(panel):
    blocks = scan.in_blocks(panel, "series_id", "dt", "x", 100).groupBy("series_id", "block").count().collect()
    sizes = [r["count"] for r in blocks if r["series_id"] == "long"]
    assert len(sizes) >= 8 and max(sizes) < 250


def test_one_step_over_blocks(panel):
    placed = scan.in_blocks(panel, "series_id", "dt", "x", 100)
    held = scan.statistics(placed, CHAIN)
    moved = sequence.maximise(held, CHAIN)
    whole = sequence.improve(sequence.ordered(panel), {0: {0: CHAIN}}, 1)[0][0]
    for part in ("initial", "transition", "means", "variances"):
        assert np.allclose(getattr(moved, part), getattr(whole, part)), part


def test_very_unlikely_days_and_repeated_days(spark):
    rows = [("a", dt.date(2000, 1, 1) + dt.timedelta(days=i), [1e3 if i == 20 else 0.1, 0.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "series_id string, dt date, x array<double>")
    for method in ("posterior", "viterbi"):
        whole = [(r["dt"], r["state"]) for r in sequence.decode(df, CHAIN, method=method).orderBy("dt").collect()]
        assert [(r["dt"], r["state"]) for r in scan.decode(df, CHAIN, method=method, block_rows=9).orderBy("dt").collect()] == whole
    with pytest.raises(Exception, match="same day twice"):
        scan.decode(df.union(df.limit(1)), CHAIN, block_rows=100).collect()


def test_many_short_blocks_share_a_task(spark):
    """Tasks follow the rows, not the blocks: of 600 short series in blocks of 3 rows each task takes very many."""
    rows = [(f"s{i:03}", dt.date(2000, 1, 1) + dt.timedelta(days=j), [float(i % 5), float(j)]) for i in range(600) for j in range(4)]
    df = spark.createDataFrame(rows, "series_id string, dt date, x array<double>")
    placed = scan.in_blocks(df, "series_id", "dt", "x", 3)
    assert len(placed.select("part").distinct().collect()) <= 4 and placed.select("block").distinct().count() >= 800
    for method in ("viterbi", "posterior"):
        whole = {(r["series_id"], r["dt"]): r for r in sequence.decode(df, CHAIN, method=method).collect()}
        got = scan.decode(df, CHAIN, method=method, block_rows=3).collect()
        assert len(got) == len(whole)
        for row in got:
            other = whole[row["series_id"], row["dt"]]
            assert np.allclose(row["p"], other["p"], atol=1e-9) and row["state"] == other["state"]
    moved = sequence.maximise(scan.statistics(placed, CHAIN), CHAIN)
    known = sequence.improve(sequence.ordered(df), {0: {0: CHAIN}}, 1)[0][0]
    for part in ("initial", "transition", "means", "variances"):
        assert np.allclose(getattr(moved, part), getattr(known, part)), part


def test_rows_to_decode_are_worked_out_once(spark, panel):
    """Counting rows, sampling their ranges and dealing them share one pass over what the rows come from."""
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    got = scan.decode(panel.mapInArrow(watched, panel.schema), CHAIN, block_rows=100).collect()
    assert len(got) == 908 and seen.value == 908


def test_matrices_of_few_blocks_share_a_task(spark):
    """The fold takes tasks by its matrices, not one for every partition of the shuffle."""
    rows = [(i, dt.date(2000, 1, 1) + dt.timedelta(days=j), [float(i % 5), float(j)]) for i in range(600) for j in range(4)]
    df = spark.createDataFrame(rows, "series_id long, dt date, x array<double>")
    slots = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        placed = scan.in_blocks(df, "series_id", "dt", "x", 100)
        tasks = scan.surroundings(placed, CHAIN).select(F.spark_partition_id().alias("task")).distinct().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", slots)
    assert 1 <= len(tasks) <= 8
