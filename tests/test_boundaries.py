"""Cases at the edges: texts that could be confused, layouts that meet, blocks that must not see each other."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelloom.functions import scalars as S
from panelloom.operators import allocation as A
from panelloom.operators import folds
from panelloom.plans import backtest as B
from panelloom.plans import jobs, scoring
from panelloom.sources import files
from panelloom.sources.lake import Lake, expired


def test_row_text_tells_rows_apart(spark):
    rows = [("a,b", "c"), ("a", "b,c"), ("__NULL__", "c"), (None, "c"), ("", "a,b,c"), ("a", None), ("a", "__NULL__")]
    df = spark.createDataFrame(rows, "x string, y string")
    texts = [r[0] for r in df.select(S.canonical_text(df.schema, df.columns)).collect()]
    assert len(set(texts)) == len(rows)


def test_report_layouts_meet_in_one_folder(spark, tmp_path):
    folder = tmp_path / "reports"
    folder.mkdir()
    positional = {"Market_and_Exchange_Names": '"GOLD, X"', "Report_Date_as_YYYY-MM-DD": "2024-01-02", "Open_Interest_All": "9",
                  "Asset_Mgr_Positions_Long_All": "1", "Lev_Money_Positions_Long_All": "2", "Other_Rept_Positions_Long_All": "3"}
    (folder / "a.csv").write_text(",".join(positional.get(c, "0") for c in files.REPORT_COLUMNS) + "\n")
    (folder / "b.csv").write_text("Market_and_Exchange_Names,Report_Date_as_YYYY-MM-DD,Noncommercial_Positions_Long_All,"
                                  "Noncommercial_Positions_Short_All,Open_Interest_All\nOIL,2024-01-09,7,8,20\n")
    got = {tuple(r) for r in files.read_positions(spark, str(folder)).collect()}
    assert got == {("GOLD, X", "2024-01-02", "6.0", "0.0", "9.0"), ("OIL", "2024-01-09", "7", "8", "20")}
    (folder / "c.csv").write_text("1,2,3\n")
    with pytest.raises(Exception, match="another number of cells"):
        files.read_positions(spark, str(folder)).collect()
    (folder / "c.csv").write_text("Market_and_Exchange_Names,Else\nOIL,1\n")
    with pytest.raises(ValueError, match="unknown report layout"):
        files.read_positions(spark, str(folder))


def test_keeping_no_partition_is_refused(spark):
    parts = spark.createDataFrame([("dt=2024-01-01", dt.date(2024, 1, 1))], "partition string, day date")
    with pytest.raises(ValueError):
        expired(parts, None, 0)


def test_missing_dataset_with_derived_partition(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    keys = spark.createDataFrame([("2024-01",)], "week string")
    assert lake.read_keys("cot_weekly", keys).count() == 0
    assert lake.read_keys("cot_weekly", ["2024-01"]).count() == 0


def panel(spark, change=None):
    rows = []
    for s in range(2):
        for i in range(60):
            wave = ((i * 7 + s * 3) % 11) / 5 - 1 + (3 if (i // 6) % 2 else 0)
            if change and change[0] <= i < change[1]:
                wave = 5 - 2 * wave
            rows.append((s, dt.date(2024, 1, 1) + dt.timedelta(days=i), [wave, float((i * 5) % 7)]))
    return spark.createDataFrame(rows, "series_id int, dt date, x array<double>")


@pytest.mark.parametrize("model", ["sequence", "mixture"])
def test_later_blocks_leave_earlier_ones_alone(spark, model):
    """Two blocks share a model; changing the second must not move the first."""
    plan = folds.FoldPlan(train=30, step=10, refit_every=20)
    cut = dt.date(2024, 1, 1) + dt.timedelta(days=40)
    seen = []
    for change in (None, (40, 50)):
        out = scoring.walk_forward(panel(spark, change), plan, k=2, restarts=2, iterations=40, model=model)
        seen.append({(r["series_id"], r["dt"]): [*r["p"], *r["trade_p"]] for r in out.where(F.col("dt") < cut).collect()})
    assert len(seen[0]) == 20 and seen[0].keys() == seen[1].keys()
    # Sums over partitions may differ in the last bits.
    assert all(value == pytest.approx(seen[1][key], abs=1e-9) for key, value in seen[0].items())


def test_first_day_after_a_refit_trades_on_the_new_model(spark):
    plan = folds.FoldPlan(train=30, step=10, refit_every=10)
    rows = scoring.walk_forward(panel(spark), plan, k=2, restarts=2, iterations=40).collect()
    by = {(r["series_id"], r["dt"]): r for r in rows}
    start = dt.date(2024, 1, 1)
    for (s, day), r in by.items():
        assert r["trade_p"] is not None and abs(sum(r["trade_p"]) - 1) < 1e-9
        if (day - start).days % 10:
            assert r["trade_p"] == by[s, day - dt.timedelta(days=1)]["p"]


def test_gaps_count_as_zero(spark):
    df = spark.createDataFrame([([1.0, None, float("nan"), float("inf"), -2.0],)], "x array<double>")
    assert df.select(scoring.filled(F.col("x"))).first()[0] == [1.0, 0.0, 0.0, 0.0, -2.0]


def test_settings_of_a_portfolio_are_dealt_to_tasks_of_their_own(spark):
    rows = [("P", dt.date(2024, 1, 1) + dt.timedelta(days=i), [0.25, 0.25, 0.25, 0.25]) for i in range(20)]
    probs = spark.createDataFrame(rows, "portfolio string, dt date, p array<double>")
    plan = folds.FoldPlan(train=5, step=5, refit_every=5)
    path = B.run_path(B.trade_rows(probs, ["portfolio"], B.SWEEP, plan), ["portfolio"])
    text = path._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(portfolio#" in text and any(
        "hashpartitioning(portfolio#" in line and "setting#" in line for line in text.splitlines())


def test_reasons(spark):
    rows = [([0.7, 0.1, 0.1, 0.1], [0.1, 0.7, 0.1, 0.1], 0.0), ([0.7, 0.1, 0.1, 0.1], [0.7, 0.1, 0.1, 0.1], 2.0), ([0.7, 0.1, 0.1, 0.1], [0.7, 0.1, 0.1, 0.1], 0.0)]
    df = spark.createDataFrame(rows, "q array<double>, p array<double>, s double")
    got = [r["reason"] for r in A.decide(df, "q", "p", 0.1, "jsd", F.col("s"), 1.5).collect()]
    # The guard in the divergence puts the distance of equal vectors just below zero.
    assert got[0].startswith("Distribution shift jsd=") and got[1].startswith("Surprise-triggered (score=2.00, dist=-0.0000") and got[2].startswith("No rebalance (jsd=-0.0000")


def prices(spark, values):
    rows = [("V", day, "I", px, "USD", "I") for day, px in values]
    df = spark.createDataFrame(rows, "vendor string, dt date, instrument string, px_last double, currency string, source_id string")
    return df.withColumn("fetch_ts", F.lit("2026-02-01 00:00:00").cast("timestamp"))


def test_rebuild_names_the_partitions_it_rewrites(spark, tmp_path):
    """A changed Friday reaches Friday and the next priced day, which is Monday."""
    lake = Lake(spark, str(tmp_path / "lake"))
    days = [dt.date(2024, 1, 4), dt.date(2024, 1, 5), dt.date(2024, 1, 8), dt.date(2024, 1, 9)]
    jobs.silver_upsert(lake, "market_prices", prices(spark, [(d, 100.0 + i) for i, d in enumerate(days)]))
    everything = {tuple(r) for r in jobs.rebuild(lake).collect()}
    assert everything == {("gold.returns_daily", d.isoformat()) for d in days[1:]}
    seen = jobs.Versions(lake).log().agg(F.max("written_at")).first()[0]
    jobs.silver_upsert(lake, "market_prices", prices(spark, [(days[1], 150.0)]))
    assert {tuple(r) for r in jobs.rebuild(lake, since=seen).collect()} == {("gold.returns_daily", "2024-01-05"), ("gold.returns_daily", "2024-01-08")}
    got = {r["dt"]: r["return"] for r in lake.load("returns_daily").collect()}
    assert got[days[1]] == pytest.approx(0.5) and got[days[2]] == pytest.approx(102 / 150 - 1) and got[days[3]] == pytest.approx(103 / 102 - 1)
    runs = jobs.runs(lake).where("job = 'rebuild'").collect()
    assert {r["dataset"] for r in runs} == {"silver.market_prices", "gold.returns_daily"}


def test_a_run_without_changes_leaves_a_record(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    day = prices(spark, [(dt.date(2024, 1, 4), 100.0), (dt.date(2024, 1, 5), 101.0)])
    jobs.update_prices(lake, day, "2024-01-06")
    jobs.update_prices(lake, day, "2024-01-07")
    by_run = jobs.runs(lake).groupBy("run_date").agg(F.count("partition").alias("n"), F.count("*").alias("rows")).collect()
    assert {(r["run_date"].day, r["n"] > 0, r["rows"] > 0) for r in by_run} == {(6, True, True), (7, False, True)}


def test_deliveries_of_one_date_are_kept(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    one = spark.createDataFrame([(1,)], "x int")
    for batch in ("a", "b", "b"):
        jobs.landed(lake, "source", one, "2024-01-06", batch)
    assert spark.read.parquet(lake.land("source", one, "2024-01-06", "c")).count() == 3


def test_cells_of_a_line_are_counted_in_linear_time(spark):
    """As commas outside quotes are found by looking ahead to the end of the line, also where a quote has no pair."""
    from panelloom.sources.files import cells

    rng = random.Random(4)
    lines = ["", "a", ",", 'a,"b,c",d', '"', '","', 'a,"b', 'a,b",c', *("".join(rng.choice('a,"') for _ in range(rng.randint(1, 14))) for _ in range(500))]
    df = spark.createDataFrame([(v,) for v in lines], "value string")
    ahead = F.size(F.split("value", ',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1))
    assert df.where(cells("value") != ahead).collect() == []
    # One look-ahead per comma would take minutes on this line.
    long = spark.createDataFrame([(",".join(['"a,b"', "c"] * 100_000),)], "value string")
    assert long.select(cells("value").alias("n")).first()["n"] == 200_000


def test_a_report_line_is_parsed_once(spark, tmp_path):
    """Also where rows without values are set aside by what their cells hold."""
    (tmp_path / "a.csv").write_text(",".join(["M", "010102", "2001-01-02", *["1"] * (len(files.REPORT_COLUMNS) - 3)]) + "\n")
    frame = files.read_positions(spark, str(tmp_path))
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("from_csv(") == 1
    assert frame.count() == 1


def test_a_layout_reads_only_its_own_files(spark, tmp_path):
    """Whatever the files are called, and however many layouts there are."""
    older = "Market_and_Exchange_Names,Report_Date_as_YYYY-MM-DD,Noncommercial_Positions_Long_All,Noncommercial_Positions_Short_All,Open_Interest_All"
    for n, name in enumerate(("a", "b 1%20.csv", "c,[d].csv")):
        (tmp_path / name).write_text(",".join([f"P{n}", "010102", "2001-01-02", *["1"] * (len(files.REPORT_COLUMNS) - 3)]) + "\n")
    (tmp_path / "e %C3.csv").write_text(f"{older}\nE,2001-01-02,7,8,20\n")
    (tmp_path / "f{1}.csv").write_text(f"Market_and_Exchange_Names,Else,{older.split(',', 1)[1]}\nF,x,2001-01-02,7,8,20\n")
    frame = files.read_positions(spark, str(tmp_path))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = sorted(tuple(r)[:3] for r in frame.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == [("E", "2001-01-02", "7"), ("F", "2001-01-02", "7"), *[(f"P{n}", "2001-01-02", "3.0") for n in range(3)]]
    leaves = frame._jdf.queryExecution().executedPlan().collectLeaves()
    metrics = [leaves.apply(i).metrics() for i in range(leaves.size())]
    assert sum(m.apply("numFiles").value() for m in metrics if m.contains("numFiles")) == 5
