"""Updates read the partitions a change reaches, and no others; their results equal one computation over everything."""

import datetime as dt
import random

import pytest

from panelloom.plans import jobs, state
from panelloom.session import scratch_path
from panelloom.sources.lake import Lake

D = dt.date
PRICE_SCHEMA = "vendor string, dt date, instrument string, px_last double, currency string, source_id string, fetch_ts timestamp"
REPORT_SCHEMA = "dt_ingest date, report_date date, contract string, group string, net_pos long, long long, short long, open_interest long"


@pytest.fixture
def lake(spark, tmp_path):
    return Lake(spark, str(tmp_path / "lake"))


def prices(spark, rows):
    return spark.createDataFrame([(v, d, i, p, "USD", i, dt.datetime(2026, 1, 1)) for v, i, d, p in rows], PRICE_SCHEMA)


def reports(spark, rows):
    return spark.createDataFrame([(D(2026, 1, 1), d, c, g, n, n, 0, n) for c, g, d, n in rows], REPORT_SCHEMA)


def spoil(tmp_path, name, partition, keep):
    """Make every partition unreadable but those kept."""
    spoiled = 0
    for folder in (tmp_path / "lake" / "silver" / name).glob(f"{partition}=*"):
        if folder.name.split("=")[1] not in keep:
            for file in folder.glob("*.parquet"):
                file.write_bytes(b"unreadable")
                (folder / f".{file.name}.crc").unlink(missing_ok=True)
                spoiled += 1
    return spoiled


def gold(lake):
    return {(r["dt"], r["instrument"]): (r["return"], r["px_t"], r["px_t_1"]) for r in lake.load("returns_daily").collect()}


def full(lake):
    return {(r["dt"], r["instrument"]): (r["return"], r["px_t"], r["px_t_1"]) for r in jobs.gold_returns(lake).collect()}


DAYS = [D(2026, 1, 1) + dt.timedelta(days=i) for i in range(40)]


def test_a_new_day_reads_no_other_day(spark, lake, tmp_path):
    base = [("v", "a", d, 10.0 + i) for i, d in enumerate(DAYS[:20])] + [("v", "b", DAYS[3], 7.0), ("w", "a", DAYS[10], 5.0)]
    jobs.update_prices(lake, prices(spark, base), "2026-02-01")
    assert spoil(tmp_path, "market_prices", "dt", set()) >= 20
    jobs.update_prices(lake, prices(spark, [("v", "a", DAYS[20], 31.0), ("v", "b", DAYS[20], 14.0), ("v", "c", DAYS[20], 1.0)]), "2026-02-02")
    got = gold(lake)
    assert got[DAYS[20], "a"] == (31.0 / 29.0 - 1, 31.0, 29.0) and got[DAYS[20], "b"] == (1.0, 14.0, 7.0) and (DAYS[20], "c") not in got


def test_a_corrected_day_reads_its_neighbours(spark, lake, tmp_path):
    base = [("v", "a", d, 10.0 + i) for i, d in enumerate(DAYS)]
    jobs.update_prices(lake, prices(spark, base), "2026-02-01")
    assert spoil(tmp_path, "market_prices", "dt", {d.isoformat() for d in DAYS[8:13]}) >= 30
    rebuilt = jobs.update_prices(lake, prices(spark, [("v", "a", DAYS[10], 100.0)]), "2026-02-02")
    assert {r["partition"] for r in rebuilt.collect()} == {DAYS[10].isoformat(), DAYS[11].isoformat()}
    got = gold(lake)
    assert got[DAYS[10], "a"] == (100.0 / 19.0 - 1, 100.0, 19.0) and got[DAYS[11], "a"] == (21.0 / 100.0 - 1, 21.0, 100.0)


def test_random_deliveries_equal_a_full_rebuild(spark, lake):
    rng = random.Random(1)
    held = {}
    for run in range(5):
        rows = {}
        for _ in range(rng.choice([2, 5, 12])):
            key = (rng.choice("vw"), rng.choice("abc"), rng.choice(DAYS if run else DAYS[10:30:3]))
            rows[key] = rng.choice([0.0, *[float(rng.randrange(1, 50)) for _ in range(9)]])
        held |= rows
        jobs.update_prices(lake, prices(spark, [(*k, p) for k, p in rows.items()]), f"2026-03-{run + 1:02d}")
        assert gold(lake) == full(lake), run
    kept = {tuple(r) for r in state.LastPrices(lake).at(jobs.Versions(lake).latest("market_prices")).collect()}
    own = {}
    for (v, i, d), p in held.items():
        own.setdefault((i, v), []).append((d, p))
    assert kept == {(*k, min(x)[0], *max(x)) for k, x in own.items()}


def test_state_is_built_anew_where_prices_came_by_another_way(spark, lake):
    jobs.update_prices(lake, prices(spark, [("v", "a", DAYS[0], 1.0)]), "2026-02-01")
    jobs.silver_upsert(lake, "market_prices", prices(spark, [("v", "a", DAYS[5], 2.0)]))
    jobs.update_prices(lake, prices(spark, [("v", "a", DAYS[9], 4.0)]), "2026-02-02")
    assert gold(lake)[DAYS[9], "a"] == (1.0, 4.0, 2.0)


def test_a_row_that_lost_its_return_goes(spark, lake):
    jobs.update_prices(lake, prices(spark, [("v", "a", DAYS[0], 1.0), ("v", "a", DAYS[1], 2.0), ("v", "b", DAYS[0], 1.0), ("v", "b", DAYS[2], 2.0)]), "2026-02-01")
    jobs.update_prices(lake, prices(spark, [("v", "a", DAYS[0], 0.0)]), "2026-02-02")
    assert gold(lake) == {(DAYS[2], "b"): (1.0, 2.0, 1.0)}
    assert [r["key"] for r in lake.partitions("returns_daily").collect()] == [DAYS[2].isoformat()]


def scores(lake):
    return {(r["week"], r["contract"], r["group"]): (r["net_pos"], r["zscore"]) for r in lake.load("cot_z_weekly").collect()}


def full_scores(lake, lookback):
    return {(r["week"], r["contract"], r["group"]): (r["net_pos"], r["zscore"]) for r in jobs.gold_positions(lake, lookback).collect()}


def close(one, other):
    assert one.keys() == other.keys()
    for key in one:
        assert one[key][0] == other[key][0] and one[key][1] == pytest.approx(other[key][1]), key


WEEKS = [D(2024, 1, 2) + dt.timedelta(days=7 * i) for i in range(70)]


def test_a_new_week_reads_the_ring_only(spark, lake, tmp_path):
    rng = random.Random(2)
    base = [(c, "g", d, rng.randrange(1000)) for c in "ab" for d in WEEKS[:60] if rng.random() < 0.9]
    jobs.update_positions(lake, reports(spark, base), "2026-02-01", 6)
    expected = full_scores(lake, 6)
    close(scores(lake), expected)
    jobs.silver_upsert(lake, "cot_weekly", reports(spark, [("a", "g", WEEKS[60], 5), ("b", "g", WEEKS[60], 900)]))
    after = full_scores(lake, 6)
    assert spoil(tmp_path, "cot_weekly", "week", {"{0}-{1:02d}".format(*WEEKS[60].isocalendar())}) >= 50
    rows = reports(spark, [("a", "g", WEEKS[60], 6), ("b", "g", WEEKS[60], 900)])
    jobs.update_positions(lake, rows, "2026-02-02", 6)
    got = scores(lake)
    week = "{0}-{1:02d}".format(*WEEKS[60].isocalendar())
    assert got[week, "b", "g"] == pytest.approx(after[week, "b", "g"]) and got[week, "a", "g"][0] == 6


def test_random_reports_equal_a_full_rebuild(spark, lake):
    rng = random.Random(4)
    for run, weeks in enumerate([WEEKS[20:40], WEEKS[40:44], WEEKS[10:60:7], WEEKS[44:47], WEEKS[:3]]):
        rows = [(c, "g", d, rng.randrange(1000)) for c in "abc" for d in weeks if rng.random() < 0.7]
        jobs.update_positions(lake, reports(spark, rows), f"2026-03-{run + 1:02d}", 5)
        close(scores(lake), full_scores(lake, 5))


def test_rebuild_follows_the_impact_map(spark, lake):
    jobs.silver_upsert(lake, "market_prices", prices(spark, [("v", "a", d, 1.0 + i) for i, d in enumerate(DAYS[:10])]))
    jobs.silver_upsert(lake, "cot_weekly", reports(spark, [("a", "g", d, i * i) for i, d in enumerate(WEEKS[:12])]))
    jobs.rebuild(lake)
    seen = jobs.Versions(lake).log().agg({"written_at": "max"}).first()[0]
    jobs.silver_upsert(lake, "market_prices", prices(spark, [("v", "a", DAYS[4], 50.0)]))
    jobs.silver_upsert(lake, "cot_weekly", reports(spark, [("a", "g", WEEKS[9], 7)]))
    before = {(r["dataset"], r["partition"]): r["fingerprint"] for r in jobs.Versions(lake).log().where("dataset like 'gold%'").collect()}
    got = {tuple(r) for r in jobs.rebuild(lake, since=seen).collect()}
    week = lambda d: "{0}-{1:02d}".format(*d.isocalendar())
    assert got == {("gold.returns_daily", d.isoformat()) for d in DAYS[4:6]} | {("gold.cot_z_weekly", week(d)) for d in WEEKS[9:12]}
    now = jobs.Versions(lake)
    for name, key in (("returns_daily", "dt"), ("cot_z_weekly", "week")):
        fresh = {(f"gold.{name}", r["partition"]): r["fingerprint"] for r in jobs.incremental.fingerprints(lake.scan(name, "gold"), key).collect()}
        assert {k for k in fresh if fresh[k] != before[k]} == {k for k in got if k[0] == f"gold.{name}"}
    assert gold(lake) == full(lake) and now.latest("returns_daily", "gold") > seen
