"""Sums that end on a half, against the queries' SQL: they must not depend on the order of rows."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from panelloom.plans.compare import compare

NAMED = [
    "i10_high_water_update",
    "i5_rebuild_changed_only",
    "i8_update_positions",
    "n5_wide_net_positions",
    "s2_dataset_view",
    "s3_read_given_partitions",
    "s5_keyed_upsert",
    "w2_positioning_zscore",
]


@pytest.fixture(scope="module")
def halves(tmp_path_factory):
    """The same orders in two orders of rows; weekly sums of even customers, and daily sums, end on half a unit."""
    rng = np.random.default_rng(5)
    rows = []
    for week in [*range(4), *range(46, 54)]:
        day = dt.datetime(1998, 12, 7) + dt.timedelta(days=7 * week)
        for odd in range(2):
            cents = rng.integers(10_000_000, 50_000_000, 40)
            cents[-1] += (50 * (1 - odd) - cents.sum()) % 100
            rows += [(len(rows) + i, 2 * i + odd, "F", c / 100, day, "1-URGENT") for i, c in enumerate(cents)]
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    frame = pd.DataFrame(rows, columns=names)
    frame["o_orderdate"] = frame["o_orderdate"].astype("datetime64[us]")
    folders = [tmp_path_factory.mktemp(f"halves-{seed}") for seed in (1, 2)]
    for seed, folder in enumerate(folders):
        frame.sample(frac=1, random_state=seed).to_parquet(folder / "orders.parquet", index=False)
    return [str(f) for f in folders]


@pytest.mark.parametrize("name", NAMED)
def test_halves_round_alike(spark, halves, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{halves[1]}/orders.parquet'")
    problem = compare(entry.queries()[name](spark, halves[0]).toPandas(), con, entry.oracle_sql()[name])
    assert problem is None, problem
