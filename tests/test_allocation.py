import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelloom.functions import probability as PF
from panelloom.operators import allocation as A
from panelloom.operators import folds, pnl, scaling, scenarios
from panelloom.operators.labels import assign
from panelloom.plans import backtest as B

P, Q = [0.7, 0.1, 0.1, 0.1], [0.1, 0.7, 0.1, 0.1]
REGIMES = list(A.REGIME_WEIGHTS)


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def vec(values):
    return PF.vector(values)


def test_distances(spark):
    assert one(spark, PF.distance(vec(P), vec(Q), "l1")) == pytest.approx(1.2)
    assert one(spark, PF.distance(vec(P), vec(Q))) == pytest.approx(0.253102, abs=1e-6)
    assert one(spark, PF.distance(vec(Q), vec(P))) == pytest.approx(0.253102, abs=1e-6)
    assert one(spark, PF.distance(vec(P), vec(P))) == pytest.approx(0.0, abs=1e-9)
    with pytest.raises(ValueError):
        PF.distance(vec(P), vec(Q), "cosine")


def test_entropy_and_tempering(spark):
    assert one(spark, PF.entropy(vec([0.8, 0.2]))) == pytest.approx(0.500402, abs=1e-6)
    assert one(spark, PF.temper(vec([0.8, 0.2]), 1.0)) == [0.8, 0.2]
    hot = one(spark, PF.temper(vec([0.8, 0.2]), 2.0))
    assert hot[0] == pytest.approx(2 / 3) and sum(hot) == pytest.approx(1.0)


def test_argmax_prefers_lowest_state(spark):
    assert one(spark, PF.argmax_state(vec([0.4, 0.4, 0.2]))) == 0


def test_turnover_and_leverage_caps(spark):
    moved = one(spark, A.cap_turnover(vec([0.2, 0.0, 0.8]), vec([0.5, 0.3, 0.2]), 0.30))
    assert moved == pytest.approx([0.425, 0.225, 0.35])
    capped = one(spark, A.constrain(vec([0.8, -0.8, 0.8]), 0.5, 1.5))
    assert capped == pytest.approx([0.5, -0.5, 0.5])


def test_probability_length_must_match(spark):
    with pytest.raises(PySparkException):
        one(spark, A.soft_weights(vec(P), REGIMES[:2]))
    with pytest.raises(KeyError):
        A.soft_weights(vec(P), ["Boom"])


@pytest.mark.parametrize("p, q, score, trade, flag", [(P, P, 0.0, False, False), (P, Q, 0.0, True, False), (P, P, 2.0, True, True)])
def test_decisions(spark, p, q, score, trade, flag):
    df = spark.createDataFrame([(p, q)], "a array<double>, b array<double>")
    row = A.decide(df, "a", "b", 0.10, "jsd", F.lit(score), 1.5).first()
    assert (row["do_rebalance"], row["surprise_triggered"]) == (trade, flag)


def brute_path(probs, targets, scores, forced, theta, cap):
    held, anchor, out = np.array(A.BASELINE_WEIGHTS), probs[0], []
    for p, w, s, f in zip(probs, targets, scores, forced):
        m = (anchor + p) / 2
        kl = lambda a: sum(x * math.log(x / (y + 1e-12)) for x, y in zip(a, m) if x > 1e-12)
        gap = 0.0 if f else (kl(anchor) + kl(p)) / 2
        if f or gap > theta or abs(s) >= 1.5:
            move = np.abs(w - held).sum()
            held = w if cap is None or move <= cap else held + cap / move * (w - held)
            anchor = p
        out.append((gap, held.copy()))
    return out


@pytest.mark.parametrize("cap", [0.2, None])
def test_path_matches_brute_force(spark, cap):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for name in ("x", "y"):
        probs = rng.dirichlet(np.ones(4), 40)
        targets = rng.normal(0, 0.2, (40, 8))
        scores = rng.normal(0, 1, 40)
        forced = [i % 10 == 0 for i in range(40)]
        rows += [(name, day(i), probs[i].tolist(), targets[i].tolist(), float(scores[i]), forced[i], 0.15, cap) for i in range(40)]
        want[name] = brute_path(probs, targets, scores, forced, 0.15, cap)
    schema = ("k string, dt date, trade_p array<double>, target array<double>, surprise double, force boolean, "
              "theta double, turnover_cap double")
    got = A.rebalance_path(spark.createDataFrame(rows, schema), ["k"]).orderBy("k", "dt").toPandas()
    for name, part in got.groupby("k"):
        np.testing.assert_allclose(np.stack(part["w"]), [w for _, w in want[name]], rtol=1e-12)
        np.testing.assert_allclose(part["distance"], [g for g, _ in want[name]], atol=1e-12)


def test_path_rejects_repeated_days(spark):
    rows = [("x", day(0), P, [0.0] * 8, 0.0, True, 0.1, 0.3)] * 2
    schema = ("k string, dt date, trade_p array<double>, target array<double>, surprise double, force boolean, "
              "theta double, turnover_cap double")
    with pytest.raises(PySparkException):
        A.rebalance_path(spark.createDataFrame(rows, schema), ["k"]).collect()


def test_costs_and_financing(spark):
    cost = one(spark, pnl.trading_cost(vec([0.0, 0.1]), vec([0.2, 0.1005])))
    assert cost == pytest.approx((0.2 * 5 + math.sqrt(0.2) * 2 + 1) / 1e4)
    assert one(spark, pnl.financing(vec([0.8, -0.7]), 0.0504, 25.2)) == pytest.approx(0.5 * (0.0002 + 0.00001))
    assert one(spark, pnl.financing(vec([0.5]), 0.05)) == 0.0


def test_volatility_target(spark):
    assert one(spark, A.volatility_target(vec([0.1]), F.lit(0.01))) == pytest.approx([0.3])
    assert one(spark, A.volatility_target(vec([0.1]), F.lit(None).cast("double"))) == [0.1]


def test_exposure_policy(spark):
    out = one(spark, A.exposure_policy(vec([0.3, -0.2, 0.1]), True, 1.0, 0.6, 2.0))
    assert out == pytest.approx([0.6, 0.0, 0.25])


@pytest.mark.parametrize("expanding", [True, False])
def test_folds_match_a_loop(spark, expanding):
    n, plan = 107, folds.FoldPlan(train=30, step=7, refit_every=15, expanding=expanding)
    df = spark.createDataFrame([(day(i),) for i in range(n)], "dt date")
    got = [tuple(r) for r in folds.fold_table(folds.positions(df), plan).orderBy("fold").collect()]
    want, start, test, f = [], 0, 30, 0
    while test < n:
        end = min(test + 7, n)
        want.append((f, day(start), day(test - 1), day(test), day(end - 1), f % 2 == 0))
        start += 0 if expanding else 7
        test, f = end, f + 1
    assert got == want


def test_expanding_statistics_match_per_fold_fit(spark):
    rng = np.random.default_rng(9)
    rows = [(k, day(i), float(rng.normal(100, 2))) for k in "ab" for i in range(90) if k == "a" or not 20 <= i < 60]
    rows += [("late", day(i), float(i)) for i in range(70, 90)]
    df = spark.createDataFrame(rows, "k string, dt date, value double")
    plan = folds.FoldPlan(train=30, step=7)
    days = folds.positions(df)
    fast = scaling.expanding_fit(df, days, plan, ["k"])
    slow = scaling.fit(df.join(folds.train_days(days, plan), "dt"), ["k", "fold"])
    key = lambda f: {(r["k"], r["fold"]): (r["mean"], r["sd"]) for r in f.collect()}
    a, b = key(fast), key(slow)
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-9)


def test_shocks_apply_in_window_only(spark):
    panel = spark.createDataFrame([(day(i), f, 1.0) for i in range(3) for f in ("ret_GOLD", "other")], "dt date, feature string, value double")
    s = scenarios.Scenario("s", "", {"ret_GOLD": 2.0, "absent": 5.0}, str(day(1)), str(day(1)))
    out = {(r["dt"], r["feature"]): r["value"] for r in scenarios.apply_shocks(panel, [s]).collect()}
    assert out[(day(1), "ret_GOLD")] == 3.0 and sum(out.values()) == 8.0
    with pytest.raises(KeyError):
        scenarios.find("none")


def test_labels_use_declared_order_on_ties(spark):
    means = spark.createDataFrame([(0, "unknown", 1.0), (1, "ret_GOLD", 2.0), (2, "ret_SP500", 1.0)], "state int, feature string, mu double")
    out = {r["state"]: (r["label"], r["n_features"]) for r in assign(means, ["state"]).collect()}
    assert out == {0: ("Easing", 0), 1: ("Risk-Off", 1), 2: ("Reacceleration", 1)}


def test_sweep_grid_has_eighteen_settings():
    assert len(B.SWEEP) == 18 and B.SWEEP[0] == B.Setting(0.05, 0.10, 1.0)
