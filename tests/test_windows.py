import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelloom.operators import asof, features
from panelloom.operators import performance as P
from panelloom.operators import returns as R
from panelloom.operators import scaling


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_returns_skip_missing_and_zero_prices(spark):
    rows = [("a", day(0), 100.0), ("a", day(1), None), ("a", day(3), 110.0), ("a", day(4), 0.0), ("a", day(5), 5.0), ("b", day(0), 1.0)]
    out = R.simple_returns(frame(spark, rows, "k string, dt date, px double"), ["k"]).orderBy("dt").collect()
    assert [(r["dt"], round(r["ret"], 9)) for r in out] == [(day(3), 0.1), (day(4), -1.0)]


def test_product_survives_total_loss(spark):
    rows = [("a", day(0), 0.5), ("a", day(1), -1.0), ("a", day(2), 0.5)]
    out = R.net_asset_value(frame(spark, rows, "k string, dt date, ret double"), ["k"]).orderBy("dt").collect()
    assert [r["nav"] for r in out] == [1.5, 0.0, 0.0]
    assert out[-1]["drawdown"] == -1.0


def test_zscore_matches_pandas(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 50, 40).astype(float)
    pdf = pd.DataFrame({"k": "a", "dt": [day(i) for i in range(40)], "v": values})
    out = R.rolling_zscore(spark.createDataFrame(pdf), ["k"], "v", 8, 4).orderBy("dt").toPandas()
    s = pd.Series(values)
    want = (s - s.rolling(8, min_periods=4).mean()) / s.rolling(8, min_periods=4).std()
    np.testing.assert_allclose(out["zscore"].to_numpy(float), want.to_numpy(), rtol=1e-9)


def test_zscore_without_deviation_is_null(spark):
    rows = [("a", day(i), 5.0) for i in range(6)]
    out = R.rolling_zscore(frame(spark, rows, "k string, dt date, v double"), ["k"], "v", 4, 2)
    assert out.where("zscore is not null").count() == 0


def pandas_align(source, target, limit):
    """Union of both calendars, row-limited forward fill, then the target days."""
    wide = source.pivot(index="dt", columns="k", values="v")
    days = sorted(set(target) | set(wide.index))
    return wide.reindex(days).ffill(limit=limit).reindex(sorted(set(target)))


@pytest.mark.parametrize("limit", [0, 1, 3, 7, None])
def test_alignment_matches_pandas(spark, limit):
    rng = np.random.default_rng(11)
    rows = [(k, day(int(n)), float(rng.normal())) for k in "abc" for n in sorted(rng.choice(80, 17, replace=False))]
    rows += [("d", day(5), None), ("d", day(200), 4.0)]
    target = [day(int(n)) for n in sorted(rng.choice(120, 60, replace=False))]
    source = frame(spark, rows, "k string, dt date, v double")
    spine = frame(spark, [(d,) for d in target], "dt date")
    got = asof.align(source, spine, ["k"], "v", limit).toPandas()
    pdf = pd.DataFrame(rows, columns=["k", "dt", "v"])
    want = pandas_align(pdf, target, limit if limit != 0 else None) if limit != 0 else (
        pdf.pivot(index="dt", columns="k", values="v").reindex(sorted(set(target)))
    )
    flat = want.stack().rename("v").reset_index()
    flat.columns = ["dt", "k", "v"]
    key = lambda f: sorted(zip(f["k"], f["dt"], f["v"].round(12)))
    assert key(got) == key(flat)


def test_rolling_features_count_calendar_rows(spark):
    """A stale instrument keeps averages while its fill and window still reach."""
    rows = [("x", day(i), 0.01 * i, 1.0, 1.0) for i in range(4)] + [("y", day(i), 0.5, 1.0, 1.0) for i in range(30)]
    ret = frame(spark, rows, "instrument string, dt date, ret double, px_t double, px_t_1 double")
    got = features.return_features(ret).where("feature = 'ma5_x'").toPandas()
    wide = pd.Series([0.01 * i for i in range(4)], index=[day(i) for i in range(4)]).reindex([day(i) for i in range(30)])
    want = wide.ffill(limit=3).rolling(5, min_periods=3).mean().dropna()
    assert sorted(got["dt"]) == sorted(want.index)
    np.testing.assert_allclose(got.sort_values("dt")["value"], want.to_numpy(), rtol=1e-12)


def test_spread_falls_back_to_second_pair(spark):
    rows = [(day(0), "ret_SPX_US", 0.03), (day(0), "ret_US10Y_US", 0.01), (day(0), "ret_SP500", 0.9)]
    out = features.spread_features(frame(spark, rows, "dt date, feature string, value double")).collect()
    assert [(r["feature"], round(r["value"], 9)) for r in out] == [("stocks_vs_bonds", 0.02)]


def test_known_at_month_end_prefers_newest_period_then_vintage(spark):
    d = dt.date
    rows = [
        ("s", d(2024, 1, 31), "v1", d(2024, 2, 5), d(2024, 2, 10), 1.0),
        ("s", d(2024, 1, 31), "v2", d(2024, 3, 5), d(2024, 2, 12), 2.0),
        ("s", d(2024, 2, 29), "v1", d(2024, 3, 6), None, 3.0),
        ("t", d(2024, 1, 31), "v1", d(2024, 2, 5), None, 9.0),
    ]
    rel = frame(spark, rows, "series_id string, period date, vintage_id string, dt_ingest date, release_date date, value double")
    months = frame(spark, [(d(2024, m, n),) for m, n in ((1, 31), (2, 29), (3, 31), (4, 30))], "month_end date")
    got = {(r["series_id"], r["month_end"].month): r["value"] for r in asof.known_at_month_end(rel, months, {"t": "P3M"}).collect()}
    assert got == {("s", 2): 2.0, ("s", 3): 3.0, ("s", 4): 3.0, ("t", 4): 9.0}
    cut = asof.known_at_month_end(rel, months, {"t": "P3M"}, vintage_cutoff=True)
    got = {(r["series_id"], r["month_end"].month): r["value"] for r in cut.collect()}
    assert got[("s", 2)] == 1.0


def test_surprise_needs_two_months(spark):
    d = dt.date
    macro = frame(spark, [(d(2024, 1, 31), "a", 1.0)], "month_end date, series_id string, value double")
    target = frame(spark, [(d(2024, 2, n),) for n in (1, 2)], "dt date")
    assert [r["value"] for r in features.surprise_score(macro, target).collect()] == [0.0, 0.0]


RETURNS = [0.01, -0.02, 0.015, 0.0, -0.005, 0.02]


def test_performance_fixture(spark):
    rows = [("p", day(i), r) for i, r in enumerate(RETURNS)]
    df = frame(spark, rows, "portfolio string, dt date, ret double")
    m = P.return_metrics(df, ["portfolio"]).first()
    want = {"total_return": 0.0196, "ann_vol": 0.2337, "sharpe": 3.5949, "max_drawdown": -0.02,
            "var_95": -0.01625, "cvar_95": -0.02, "tail_ratio": 1.1538, "hit_rate": 0.5}
    for name, value in want.items():
        assert m[name] == pytest.approx(value, abs=6e-5), name
    log = frame(
        spark,
        [("p", day(i), d, x, s, p) for i, (d, x, s, p) in enumerate([
            (True, 0.2, False, 0.8), (False, 0.0, False, 0.7), (False, 0.0, False, 0.6),
            (True, 0.3, True, 0.9), (False, 0.0, False, 0.75), (False, 0.0, False, 0.65)])],
        "portfolio string, dt date, do_rebalance boolean, distance double, surprise_triggered boolean, max_prob double",
    )
    b = P.rebalance_metrics(log, ["portfolio"]).first()
    assert (b["n_rebalances"], b["avg_rebal_freq_days"], b["surprise_rebalances"]) == (2, 3.0, 1)
    assert b["avg_jsd_distance"] == pytest.approx(0.08333, abs=1e-5)
    assert b["avg_max_regime_prob"] == pytest.approx(0.73333, abs=1e-5)
    labels = frame(spark, [("p", day(i), x) for i, x in enumerate("AABB")], "portfolio string, dt date, label string")
    cond = {r["label"]: r["mean_daily_ret"] for r in P.conditional_returns(df, labels, ["portfolio"]).collect()}
    assert cond == {"A": pytest.approx(-0.005), "B": pytest.approx(0.0075)}
    runs = {r["label"]: r["mean_run"] for r in P.regime_durations(labels, ["portfolio"]).collect()}
    assert runs == {"A": 2.0, "B": 2.0}


def test_scaler_uses_training_rows_only(spark):
    train = frame(spark, [("a", float(v)) for v in range(1, 6)] + [("b", float(v)) for v in range(10, 20, 2)]
                  + [("c", 1.0)] * 5 + [("n", 1.0), ("n", None), ("n", 3.0)], "feature string, value double")
    stats = {r["feature"]: (r["mean"], r["sd"]) for r in scaling.fit(train, ["feature"]).collect()}
    assert stats["a"] == (3.0, pytest.approx(math.sqrt(2.5)))
    assert stats["b"] == (14.0, pytest.approx(3.16227766))
    assert stats["c"] == (1.0, 1.0)
    assert stats["n"] == (2.0, pytest.approx(math.sqrt(2)))
    test = frame(spark, [("a", 6.0), ("n", None), ("unseen", 1.0)], "feature string, value double")
    out = {r["feature"]: r["value"] for r in scaling.transform(test, scaling.fit(train, ["feature"]), ["feature"]).collect()}
    assert out == {"a": pytest.approx(3 / math.sqrt(2.5)), "n": None}


def test_windows_need_a_key():
    with pytest.raises(ValueError):
        R.by_date([])


def test_trailing_window_stays_in_one_shuffle(spark):
    rows = [("a", day(i), float(i)) for i in range(5)]
    df = frame(spark, rows, "k string, dt date, ret double")
    curve = R.rolling_risk(R.net_asset_value(df, ["k"]), ["k"])
    plan = curve._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
