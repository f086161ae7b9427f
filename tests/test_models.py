import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelloom.operators import labels, mixture, sequence, windowed
from panelloom.plans import scoring
from panelloom.operators.folds import FoldPlan


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


CHAIN = sequence.Chain(
    np.array([0.5, 0.3, 0.2]), np.array([[0.7, 0.2, 0.1], [0.1, 0.8, 0.1], [0.25, 0.25, 0.5]]),
    np.array([[0.0, 0.0], [1.5, -1.0], [-1.0, 2.0]]), np.array([[1.0, 0.5], [0.4, 1.0], [0.8, 0.8]]),
)
LENGTHS = {"a": 7, "b": 1, "c": 4}


def data():
    rng = np.random.default_rng(2)
    return {k: rng.normal(0, 1.2, (n, 2)) for k, n in LENGTHS.items()}


def rows(spark, values):
    flat = [(k, day(3 * i), x.tolist()) for k, xs in values.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(flat, "series_id string, dt date, x array<double>").repartition(3)


def density(x, k):
    v, m = CHAIN.variances[k], CHAIN.means[k]
    return math.exp(-0.5 * sum(math.log(2 * math.pi * s) + (a - b) ** 2 / s for a, b, s in zip(x, m, v)))


def enumerate_paths(xs):
    """Joint probability of every state path: the definition, not the recursion."""
    out = {}
    for path in itertools.product(range(3), repeat=len(xs)):
        p = CHAIN.initial[path[0]] * density(xs[0], path[0])
        for t in range(1, len(xs)):
            p *= CHAIN.transition[path[t - 1], path[t]] * density(xs[t], path[t])
        out[path] = p
    return out


def exact(values):
    gammas, counts, level, best = {}, np.zeros((3, 3)), 0.0, {}
    for name, xs in values.items():
        joint = enumerate_paths(xs)
        total = sum(joint.values())
        level += math.log(total)
        gamma = np.zeros((len(xs), 3))
        for path, p in joint.items():
            for t, s in enumerate(path):
                gamma[t, s] += p / total
            for a, b in zip(path, path[1:]):
                counts[a, b] += p / total
        gammas[name], best[name] = gamma, max(joint, key=joint.get)
    return gammas, counts, level, best


def test_decode_matches_enumeration(spark):
    values = data()
    gammas, _, _, best = exact(values)
    got = sequence.decode(rows(spark, values), CHAIN).orderBy("series_id", "dt").toPandas()
    for name, part in got.groupby("series_id"):
        np.testing.assert_allclose(np.stack(part["p"]), gammas[name], rtol=1e-9)
    path = sequence.decode(rows(spark, values), CHAIN, method="viterbi").orderBy("series_id", "dt").toPandas()
    for name, part in path.groupby("series_id"):
        assert tuple(part["state"]) == best[name]


def test_filtered_shares_use_the_past_only(spark):
    values = data()
    got = sequence.decode(rows(spark, values), CHAIN, method="filtered").where("series_id = 'a'").orderBy("dt").toPandas()
    for t in range(1, LENGTHS["a"] + 1):
        gamma = exact({"a": values["a"][:t]})[0]["a"]
        np.testing.assert_allclose(got["p"].iloc[t - 1], gamma[-1], rtol=1e-9)


def test_one_step_matches_enumeration(spark):
    values = data()
    gammas, counts, level, _ = exact(values)
    packed = sequence.ordered(rows(spark, values))
    zero = sequence.improve(packed, {0: {0: sequence.Chain(**{k: getattr(CHAIN, k) for k in ("initial", "transition", "means", "variances")})}}, 0)
    assert zero[0][0].log_likelihood == pytest.approx(level)
    moved = sequence.improve(packed, {0: {0: CHAIN}}, 1)[0][0]
    first = sum(g[0] for g in gammas.values())
    np.testing.assert_allclose(moved.initial, first / first.sum(), rtol=1e-9)
    smooth = (counts + 0.01) / (counts.sum(axis=1, keepdims=True) + 0.03)
    np.testing.assert_allclose(moved.transition, smooth, rtol=1e-9)
    g, x = np.concatenate([gammas[k] for k in values]), np.concatenate(list(values.values()))
    means = g.T @ x / g.sum(axis=0)[:, None]
    np.testing.assert_allclose(moved.means, means, rtol=1e-9)
    var = np.stack([(g[:, k, None] * (x - means[k]) ** 2).sum(axis=0) / g[:, k].sum() for k in range(3)]) + 1e-4
    np.testing.assert_allclose(moved.variances, var, rtol=1e-7)


def test_likelihood_rises_and_restarts_are_independent(spark):
    rng = np.random.default_rng(8)
    values = {str(i): np.concatenate([rng.normal(0, 1, (15, 2)), rng.normal(4, 1, (15, 2))]) for i in range(6)}
    packed = sequence.ordered(rows(spark, values)).persist()
    variance = np.concatenate(list(values.values())).var(axis=0)
    start = lambda s: sequence.starting_chain(np.array([values["0"][s], values["1"][-1 - s]]), variance)
    levels = [sequence.improve(packed, {0: {0: start(0)}}, n)[0][0].log_likelihood for n in (0, 1, 3, 6)]
    assert all(b >= a - 0.05 for a, b in zip(levels, levels[1:]))
    together = sequence.improve(packed, {0: {0: start(0), 1: start(1)}}, 4)[0]
    alone = sequence.improve(packed, {0: {0: start(1)}}, 4)[0][0]
    np.testing.assert_allclose(together[1].means, alone.means, rtol=1e-9)
    assert sequence.best_of(together).log_likelihood == max(c.log_likelihood for c in together.values())
    packed.unpersist()


def test_repeated_days_are_rejected(spark):
    df = spark.createDataFrame([("a", day(0), [1.0, 1.0]), ("a", day(0), [2.0, 1.0])], "series_id string, dt date, x array<double>")
    with pytest.raises(PySparkException):
        sequence.decode(df, CHAIN).collect()


def test_fit_finds_two_regimes_for_any_partitioning(spark):
    rng = np.random.default_rng(4)
    values = {str(i): np.concatenate([rng.normal(0, 0.5, (20, 2)), rng.normal(5, 0.5, (20, 2))]) for i in range(5)}
    df = rows(spark, values)
    one = sequence.fit(df.coalesce(1), k=2, restarts=3, iterations=20)
    many = sequence.fit(df.repartition(7), k=2, restarts=3, iterations=20)
    np.testing.assert_allclose(one.means, many.means, rtol=1e-6)
    assert sorted(np.round(one.means[:, 0])) == [0, 5]
    assert one.converged


def test_mixture_recovers_clusters_and_scores(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(-3, 0.5, (80, 3)), rng.normal(3, 0.5, (120, 3))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, x array<double>")
    model = mixture.fit(df, "id", "x", k=2, restarts=4, iterations=100)
    assert sorted(np.round(model.weights, 2)) == [0.4, 0.6]
    p = df.select(mixture.posterior(F.col("x"), model).alias("p")).toPandas()["p"]
    assert np.allclose([sum(v) for v in p], 1.0)
    joint = mixture.row_log_density(x, model.means, model.variances) + np.log(model.weights)
    assert model.log_likelihood == pytest.approx(mixture.row_log_sum(joint).sum())
    assert model.bic == pytest.approx(-2 * model.log_likelihood + 13 * math.log(200))
    assert model.aic == pytest.approx(-2 * model.log_likelihood + 26)


def test_mixture_groups_equal_separate_fits(spark):
    rng = np.random.default_rng(7)
    flat = [(g, g * 1000 + i, rng.normal(3 * g, 1, 2).tolist()) for g in range(3) for i in range(60)]
    df = spark.createDataFrame(flat, "g int, id int, x array<double>")
    both = mixture.fit_groups(df, "id", "x", k=2, restarts=2, iterations=12, group="g")
    for g in range(3):
        alone = mixture.fit(df.where(F.col("g") == g), "id", "x", k=2, restarts=2, iterations=12)
        np.testing.assert_allclose(both[g].means, alone.means, rtol=1e-6)


def test_describe(spark):
    df = spark.createDataFrame([(day(0), [0.8, 0.2], 0)], "dt date, p array<double>, state int")
    names = spark.createDataFrame([(0, "Easing"), (1, "Risk-Off")], "state int, label string")
    row = labels.describe(df, 2, names).first()
    assert (row["label"], row["max_prob"], row["p_1"]) == ("Easing", 0.8, 0.2)
    assert row["entropy"] == pytest.approx(0.500402, abs=1e-6)


@pytest.mark.parametrize("model", ["sequence", "mixture"])
def test_walk_forward_scores_every_test_day_once(spark, model):
    rng = np.random.default_rng(1)
    values = {str(i): rng.normal(size=(30, 2)) for i in range(4)}
    out = scoring.walk_forward(rows(spark, values), FoldPlan(20, 5, 5), k=2, restarts=1, iterations=3, model=model)
    pdf = out.toPandas()
    assert len(pdf) == 4 * 10 and set(pdf["fold"]) == {0, 1}
    assert np.allclose([sum(p) for p in pdf["p"]], 1.0)


def test_sequences_cut_by_batches_are_joined_again(spark):
    values = data() | {"long": np.random.default_rng(3).normal(size=(90, 2))}
    whole = sequence.decode(rows(spark, values), CHAIN, method="viterbi").orderBy("series_id", "dt").toPandas()
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "4")
    try:
        cut = sequence.decode(rows(spark, values), CHAIN, method="viterbi").orderBy("series_id", "dt").toPandas()
    finally:
        spark.conf.set(name, before)
    assert list(cut["state"]) == list(whole["state"])
    np.testing.assert_allclose(np.stack(cut["p"]), np.stack(whole["p"]), rtol=1e-9)


def test_spans_equal_copied_rows(spark):
    """Fits on windows cut inside the pass equal fits on rows copied and scaled per window; no row is sent twice."""
    import datetime as dt

    import numpy as np
    from pyspark.sql import functions as F

    from panelloom.operators import folds, mixture, scaling, sequence, windowed

    rng = np.random.default_rng(5)
    rows = [(f"s{s}", dt.date(2024, 1, 1) + dt.timedelta(days=i), [float(x) for x in rng.normal(i % 7, 1 + s, 2)])
            for s in range(4) for i in range(30) if rng.random() < 0.9]
    panel = spark.createDataFrame(rows, "series_id string, dt date, x array<double>")
    for plan in (folds.FoldPlan(12, 4, 8), folds.FoldPlan(10, 5, 5, expanding=False)):
        days = folds.positions(panel)
        placed = windowed.with_positions(panel, days).cache()
        assert placed.count() == len(rows)
        n_days = days.first()["n_days"]
        spans = windowed.scaled_spans(placed, windowed.refit_spans(plan, n_days), 2)
        trained = folds.train_days(days, plan).where(F.col("fold") % plan.refit_folds == 0)
        assert set(spans) == {r["fold"] for r in trained.select("fold").distinct().collect()}
        long = panel.join(trained, "dt").select("series_id", "dt", "fold", F.posexplode("x").alias("feature", "value"))
        stats = {(r["fold"], r["feature"]): (r["mean"], r["sd"]) for r in scaling.fit(long, ["feature", "fold"]).collect()}
        for g, span in spans.items():
            for j in range(2):
                assert (span.mean[j], span.sd[j]) == pytest.approx(stats[g, j])
        copied = placed.join(trained, "dt").collect()
        scaled = [(r["series_id"], r["dt"], r["fold"], spans[r["fold"]].scaled(np.array(r["x"])).tolist()) for r in copied]
        other = spark.createDataFrame(scaled, "series_id string, dt date, fold int, x array<double>")
        mine = windowed.fit_chains(placed, spans, 2, 2, 15, 2)
        plain = sequence.fit_groups(other, k=2, restarts=2, iterations=15, group="fold")
        for g, chain in plain.items():
            for part in ("initial", "transition", "means", "variances", "log_likelihood"):
                assert np.allclose(getattr(mine[g], part), getattr(chain, part)), (g, part)
        mine = windowed.fit_mixtures(placed, spans, k=2, restarts=2, iterations=10)
        plain = mixture.fit_groups(other.withColumn("row_id", F.concat_ws("/", "series_id", "dt")), "row_id", "x", k=2, restarts=2, iterations=10, group="fold")
        for g, model in plain.items():
            assert np.allclose(mine[g].means, model.means) and mine[g].log_likelihood == pytest.approx(model.log_likelihood)
        scores = placed.withColumn("model_fold", F.lit(0)).join(mixture.packed_table(spark, mine, "model_fold"), "model_fold")
        got = scores.select(mixture.posterior_of(F.col("x"), F.col("log_weights"), F.col("means"), F.col("variances")).alias("a"), mixture.posterior(F.col("x"), mine[0]).alias("b"))
        assert all(r["a"] == pytest.approx(r["b"]) for r in got.collect())


def test_drawing_starts_moves_no_vectors(spark):
    from pyspark.sql import functions as F

    from panelloom.operators import draws

    rows = spark.range(40).select(F.lit(0).alias("grp"), F.col("id").alias("row_id"), F.array(F.col("id") * 1.0).alias("x")).repartition(3)
    found = draws.smallest_digests(rows, "row_id", 3, 2, 42, None)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "x#" not in plan.split("MapInArrow")[0] and found.columns == ["grp", "restart", "draw", "row_id"]
    one, other = draws.starting_rows(rows, "row_id", "x", 3, 2), draws.starting_rows(rows.repartition(7), "row_id", "x", 3, 2)
    assert (one[0] == other[0]).all() and one[0].shape == (2, 3, 1)
    with pytest.raises(ValueError):
        draws.starting_rows(rows.limit(2), "row_id", "x", 3, 2)


def test_passes_take_whole_sequences_from_cut_batches(monkeypatch):
    """Batches end anywhere; what a pass takes up ends with a sequence, also one longer than a pass would like."""
    import pyarrow as pa

    from panelloom.operators import windowed

    names = np.repeat([1, 2, 3, 4], [5, 40, 1, 14])
    x = np.arange(120.0).reshape(60, 2)
    table = pa.table({"series_id": names, "i": np.arange(60), "x": list(x)})
    monkeypatch.setattr(windowed, "ROWS_AT_ONCE", 10)
    got = list(windowed.whole_arrays(iter(table.to_batches(max_chunksize=7)), 2))
    assert np.array_equal(np.concatenate([g[0] for g in got]), x)
    assert len(got) > 1 and sum(len(np.unique(g[2])) for g in got) == 4


def counted_tasks(monkeypatch):
    seen, improve = [], sequence.improve
    monkeypatch.setattr(sequence, "improve", lambda rows, *a: seen.append(rows.rdd.getNumPartitions()) or improve(rows, *a))
    return seen


def two_series(spark):
    rng = np.random.default_rng(4)
    return spark.createDataFrame(
        [(s, day(i), i, [float(v) for v in rng.normal(2 * ((i // 8) % 2), 0.5, 2)]) for s in ("a", "b") for i in range(40)],
        "series_id string, dt date, i int, x array<double>").repartition(3)


def test_window_passes_take_tasks_by_rows(spark, monkeypatch):
    """Few rows are one task however many partitions a shuffle has; the fit does not depend on it."""
    seen, frame, spans = counted_tasks(monkeypatch), two_series(spark), {0: windowed.Span(0, 30), 3: windowed.Span(10, 40)}
    few = windowed.fit_chains(frame, spans, 2, 2, 5, 2)
    monkeypatch.setattr(sequence, "TASK_ROWS", 1)
    many = windowed.fit_chains(frame, spans, 2, 2, 5, 2)
    assert seen == [1, int(spark.conf.get("spark.sql.shuffle.partitions"))]
    for g in spans:
        np.testing.assert_allclose(few[g].means, many[g].means, rtol=1e-9)
        assert math.isclose(few[g].log_likelihood, many[g].log_likelihood, rel_tol=1e-9)


def test_fit_passes_take_tasks_by_rows(spark, monkeypatch):
    seen, frame = counted_tasks(monkeypatch), two_series(spark)
    few = sequence.fit(frame, k=2, restarts=2, iterations=5)
    monkeypatch.setattr(sequence, "TASK_ROWS", 1)
    many = sequence.fit(frame, k=2, restarts=2, iterations=5)
    assert seen == [1, int(spark.conf.get("spark.sql.shuffle.partitions"))]
    np.testing.assert_allclose(few.means, many.means, rtol=1e-9)
    assert math.isclose(few.log_likelihood, many.log_likelihood, rel_tol=1e-9)
