"""Mixture and sequence models, decoding and state labels."""

import numpy as np
from pyspark.sql import functions as F

from panelloom.functions import probability as PF
from panelloom.operators import folds, labels, mixture, performance, pnl, scan, scenarios, sequence
from panelloom.operators.allocation import ASSETS, REGIME_WEIGHTS, weights_by_label
from panelloom.operators.draws import starting_rows
from panelloom.plans import backtest, fit_sql, scoring
from panelloom.plans.catalog.allocation import SHOCKS, Z_ASSETS, scaled_assets, values
from panelloom.plans.registry import ORACLES, query
from panelloom.plans.sql import SEQUENCES, STATES, with_, with_recursive
from panelloom.session import stored
from panelloom.sources import panels


def r(value, digits=6):
    return F.round(F.col(value) if isinstance(value, str) else value, digits)


def rounded(df, *names, digits=6):
    return df.withColumns({n: r(n, digits) for n in names})


# --- mixture --------------------------------------------------------------------------

DIMS, K, STEPS = 64, 3, 4
VECTORS = """vecs AS (SELECT vec_id, """ + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(DIMS)
) + " FROM embeddings)"


def vectors(t):
    x = F.transform(F.slice("embedding", 1, DIMS), lambda v: v.cast("double"))
    return t.embeddings.select("vec_id", x.alias("x"))


FIXED_MEANS = [[round(0.05 * ((i + 2 * k) % 5 - 2), 3) for i in range(DIMS)] for k in range(K)]
FIXED_VARS = [[round(0.01 + 0.005 * ((i + k) % 3), 3) for i in range(DIMS)] for k in range(K)]


def density_sql(k: int, xs, means, variances) -> str:
    parts = [f"-0.5 * ({float(np.log(2 * np.pi))!r} + ln({v!r}) + ({x} - ({m!r})) * ({x} - ({m!r})) / {v!r})"
             for x, m, v in zip(xs, means[k], variances[k])]
    return "(" + " + ".join(parts) + ")"


XS = [f"x{i}" for i in range(DIMS)]


@query("m2_m3_log_densities", with_(VECTORS) + ", d AS (SELECT vec_id, " + ", ".join(
    f"{density_sql(k, XS, FIXED_MEANS, FIXED_VARS)} AS l{k}" for k in range(K)) + """ FROM vecs)
SELECT vec_id, round(l0, 6) AS log_0, round(l1, 6) AS log_1, round(l2, 6) AS log_2,
  round(greatest(l0, l1, l2) + ln(exp(l0 - greatest(l0, l1, l2)) + exp(l1 - greatest(l0, l1, l2)) + exp(l2 - greatest(l0, l1, l2))), 6) AS total FROM d""")
def m2(t):
    scored = vectors(t).withColumn("l", PF.log_densities(F.col("x"), FIXED_MEANS, FIXED_VARS))
    return scored.select("vec_id", *[r(F.col("l")[k]).alias(f"log_{k}") for k in range(K)], r(PF.log_sum_exp(F.col("l"))).alias("total"))


def em_sql(steps: int) -> str:
    """The same EM, one restart, written out step by step."""
    out = [VECTORS, """draw AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || vec_id), vec_id) - 1 AS k FROM vecs),
spread AS (SELECT """ + ", ".join(f"var_pop(x{i}) + 1e-6 AS s{i}" for i in range(DIMS)) + """ FROM vecs),
p0 AS (SELECT k, 1.0 / 3 AS w, """ + ", ".join(f"x{i} AS m{i}" for i in range(DIMS)) + ", " + ", ".join(
        f"s{i}" for i in range(DIMS)) + " FROM draw, spread WHERE k < 3)"]
    for s in range(steps):
        dens = " + ".join(f"-0.5 * (ln(2 * pi() * s{i}) + (x{i} - m{i}) * (x{i} - m{i}) / s{i})" for i in range(DIMS))
        out.append(f"""j{s} AS MATERIALIZED (SELECT v.*, p.k, ln(w) + {dens} AS l FROM vecs v, p{s} p),
t{s} AS MATERIALIZED (SELECT vec_id, max(l) + ln(sum(exp(l - mx))) AS tot FROM (SELECT *, max(l) OVER (PARTITION BY vec_id) AS mx FROM j{s}) GROUP BY vec_id),
r{s} AS MATERIALIZED (SELECT j.*, exp(l - tot) AS g FROM j{s} j JOIN t{s} USING (vec_id)),
p{s + 1} AS MATERIALIZED (SELECT k, sum(g) / sum(sum(g)) OVER () AS w, """ + ", ".join(f"sum(g * x{i}) / sum(g) AS m{i}" for i in range(DIMS)) + ", " + ", ".join(
            f"sum(g * x{i} * x{i}) / sum(g) - (sum(g * x{i}) / sum(g)) ^ 2 + 1e-6 AS s{i}" for i in range(DIMS)) + f" FROM r{s} GROUP BY k)")
    dens = " + ".join(f"-0.5 * (ln(2 * pi() * s{i}) + (x{i} - m{i}) * (x{i} - m{i}) / s{i})" for i in range(DIMS))
    out.append(f"fin AS (SELECT vec_id, ln(sum(exp(ln(w) + {dens}))) AS tot FROM vecs, p{steps} GROUP BY vec_id)")
    return with_(*out)


FREE = 2 * K * DIMS + K - 1


@query("m4_m5_mixture_fit", em_sql(STEPS) + f""", ll AS (SELECT sum(tot) AS l, count(*) AS n FROM fin)
SELECT CAST(k AS INTEGER) AS k, round(w, 6) AS weight, """ + ", ".join(f"round(m{i}, 6) AS mu_{i}, round(s{i}, 6) AS var_{i}" for i in range(DIMS)) + f""",
  round(l, 4) AS log_likelihood, round(-2 * l + {FREE} * ln(n), 4) AS bic, round(-2 * l + 2 * {FREE}, 4) AS aic FROM p{STEPS}, ll""")
def m4(t):
    model = mixture.fit(vectors(t), "vec_id", "x", k=K, restarts=1, iterations=STEPS, tol=0.0)
    out = mixture.parameter_table(t.spark, {0: model})
    return out.select(
        "k", r("weight").alias("weight"), *[r(F.col("mu")[i]).alias(f"mu_{i}") for i in range(DIMS)],
        *[r(F.col("sigma2")[i]).alias(f"var_{i}") for i in range(DIMS)],
        r("log_likelihood", 4).alias("log_likelihood"), r("bic", 4).alias("bic"), r("aic", 4).alias("aic"),
    )


NUMBERED_VECTORS = "vecs AS MATERIALIZED (SELECT 0 AS g, CAST(vec_id AS VARCHAR) AS row_id, " + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(DIMS)) + " FROM embeddings)"


@query("m4_mixture_best_of_ten", with_recursive(NUMBERED_VECTORS, *fit_sql.mixture("vecs", DIMS, 4), fit_sql.mixture_shares("vecs", DIMS)) + """
SELECT CAST(row_id AS BIGINT) AS vec_id, CAST(first(c ORDER BY p DESC, c) - 1 AS INTEGER) AS state, round(max(p), 4) AS max_prob FROM scored GROUP BY row_id""")
def m4_full(t):
    """All 64 dimensions, ten restarts, to convergence; posterior of every row."""
    rows = t.embeddings.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    model = mixture.fit(rows, "vec_id", "x", k=4, restarts=10, iterations=500)
    scored = rows.withColumn("p", mixture.posterior(F.col("x"), model))
    return scored.select("vec_id", PF.argmax_state(F.col("p")).alias("state"), r(PF.max_prob(F.col("p")), 4).alias("max_prob"))


@query("m6_starting_parameters", with_(SEQUENCES) + """,
drawn AS (SELECT s, row_number() OVER (PARTITION BY s ORDER BY md5((s + 42) || ':' || series_id || '/' || dt), series_id || '/' || dt) AS k, x0, x1
  FROM sequences, range(0, 3) x(s)),
v AS (SELECT var_pop(x0) + 1e-4 AS v0, var_pop(x1) + 1e-4 AS v1 FROM sequences)
SELECT CAST(s AS INTEGER) AS restart, CAST(k - 1 AS INTEGER) AS k, round(x0, 6) AS mu_0, round(x1, 6) AS mu_1, round(v0, 6) AS var_0, round(v1, 6) AS var_1
FROM drawn, v WHERE k <= 4""")
def m6(t):
    from panelloom.operators.draws import spread

    rows = panels.sequences(t).withColumn("grp", F.lit(0)).withColumn("row_id", F.concat_ws("/", F.col("series_id").cast("string"), F.col("dt").cast("string")))
    starts = starting_rows(rows, "row_id", "x", 4, 3)[0]
    chains = [sequence.starting_chain(m, spread(rows, "x", 2)[0]) for m in starts]
    out = [
        (s, k, *[round(float(v), 6) for v in (*c.means[k], *c.variances[k])]) for s, c in enumerate(chains) for k in range(4)
    ]
    return t.spark.createDataFrame(out, "restart int, k int, mu_0 double, mu_1 double, var_0 double, var_1 double")


# --- sequences ------------------------------------------------------------------------

CHAIN = sequence.Chain(
    np.array([0.6, 0.4]), np.array([[0.8, 0.2], [0.3, 0.7]]),
    np.array([[3.0, 0.8], [4.2, 1.4]]), np.array([[0.8, 0.1], [0.6, 0.2]]),
)
SX = ["x0", "x1"]
EMIT = SEQUENCES + ", em AS (SELECT series_id, dt, x0, x1, row_number() OVER (PARTITION BY series_id ORDER BY dt) AS n, " \
    "count(*) OVER (PARTITION BY series_id) AS len, " + ", ".join(
        f"{density_sql(k, SX, CHAIN.means.tolist(), CHAIN.variances.tolist())} AS b{k}" for k in range(2)) + " FROM sequences)"
LA = [[repr(float(np.log(CHAIN.transition[i, j]))) for j in range(2)] for i in range(2)]
LP = [repr(float(np.log(p))) for p in CHAIN.initial]


def lse(a: str, b: str) -> str:
    return f"(greatest({a}, {b}) + ln(1 + exp(-abs(({a}) - ({b})))))"


FORWARD = f"""fwd AS (
  SELECT series_id, dt, n, len, b0, b1, {LP[0]} + b0 AS a0, {LP[1]} + b1 AS a1 FROM em WHERE n = 1
  UNION ALL
  SELECT e.series_id, e.dt, e.n, e.len, e.b0, e.b1, {lse(f'f.a0 + {LA[0][0]}', f'f.a1 + {LA[1][0]}')} + e.b0, {lse(f'f.a0 + {LA[0][1]}', f'f.a1 + {LA[1][1]}')} + e.b1
  FROM fwd f JOIN em e ON e.series_id = f.series_id AND e.n = f.n + 1)"""
BACKWARD = f"""bwd AS (
  SELECT series_id, n, b0, b1, 0.0::DOUBLE AS z0, 0.0::DOUBLE AS z1 FROM em WHERE n = len
  UNION ALL
  SELECT e.series_id, e.n, e.b0, e.b1, {lse(f'{LA[0][0]} + g.b0 + g.z0', f'{LA[0][1]} + g.b1 + g.z1')}, {lse(f'{LA[1][0]} + g.b0 + g.z0', f'{LA[1][1]} + g.b1 + g.z1')}
  FROM bwd g JOIN em e ON e.series_id = g.series_id AND e.n = g.n - 1)"""
GAMMA = f"""gam AS (SELECT f.series_id, f.dt, f.n, f.len, f.a0, f.a1, f.b0, f.b1, z0, z1, 1 / (1 + exp((a1 + z1) - (a0 + z0))) AS g0 FROM fwd f JOIN bwd USING (series_id, n))"""


def fixed_rows(t):
    return panels.sequences(t)


# Small blocks, so that series are split at the supplied sizes too.
BLOCK_ROWS = 333


@query("m11_posterior_decode", with_recursive(EMIT, FORWARD, BACKWARD, GAMMA) + """
SELECT series_id, dt, round(g0, 6) AS p_0, round(1 - g0, 6) AS p_1, CASE WHEN g0 >= 1 - g0 THEN 0 ELSE 1 END AS state FROM gam""")
def m11(t):
    out = sequence.decode(fixed_rows(t), CHAIN)
    return out.select("series_id", "dt", r(F.col("p")[0]).alias("p_0"), r(F.col("p")[1]).alias("p_1"), "state")


@query("m11_filtered_decode", with_recursive(EMIT, FORWARD) + """
SELECT series_id, dt, round(1 / (1 + exp(a1 - a0)), 6) AS p_0, CASE WHEN a0 >= a1 THEN 0 ELSE 1 END AS state FROM fwd""")
def m11_filtered(t):
    out = sequence.decode(fixed_rows(t), CHAIN, method="filtered")
    return out.select("series_id", "dt", r(F.col("p")[0]).alias("p_0"), "state")


@query("m11_blocks_decode", ORACLES["m11_posterior_decode"])
def m11_blocks(t):
    """The same shares from blocks of days, which split a series over tasks."""
    out = scan.decode(fixed_rows(t), CHAIN, block_rows=BLOCK_ROWS)
    return out.select("series_id", "dt", r(F.col("p")[0]).alias("p_0"), r(F.col("p")[1]).alias("p_1"), "state")


@query("m12_viterbi_path", with_recursive(EMIT, f"""vit AS (
  SELECT series_id, n, len, {LP[0]} + b0 AS d0, {LP[1]} + b1 AS d1, [0] AS path0, [1] AS path1 FROM em WHERE n = 1
  UNION ALL
  SELECT e.series_id, e.n, e.len, greatest(v.d0 + {LA[0][0]}, v.d1 + {LA[1][0]}) + e.b0, greatest(v.d0 + {LA[0][1]}, v.d1 + {LA[1][1]}) + e.b1,
    list_append(CASE WHEN v.d0 + {LA[0][0]} >= v.d1 + {LA[1][0]} THEN v.path0 ELSE v.path1 END, 0),
    list_append(CASE WHEN v.d0 + {LA[0][1]} >= v.d1 + {LA[1][1]} THEN v.path0 ELSE v.path1 END, 1)
  FROM vit v JOIN em e ON e.series_id = v.series_id AND e.n = v.n + 1)""") + """
SELECT e.series_id, e.dt, CASE WHEN d0 >= d1 THEN path0[e.n] ELSE path1[e.n] END AS state FROM vit v JOIN em e ON e.series_id = v.series_id WHERE v.n = v.len""")
def m12(t):
    return sequence.decode(fixed_rows(t), CHAIN, method="viterbi").select("series_id", "dt", "state")


@query("m12_blocks_path", ORACLES["m12_viterbi_path"])
def m12_blocks(t):
    return scan.decode(fixed_rows(t), CHAIN, method="viterbi", block_rows=BLOCK_ROWS).select("series_id", "dt", "state")


@query("m7_m8_one_em_step", with_recursive(EMIT, FORWARD, BACKWARD, GAMMA, f"""
ends AS (SELECT series_id, {lse('a0', 'a1')} AS ll FROM fwd WHERE n = len),
pairs AS (SELECT f.series_id, f.a0, f.a1, g.b0, g.b1, g.z0, g.z1, ll FROM gam f JOIN gam g ON g.series_id = f.series_id AND g.n = f.n + 1 JOIN ends e ON e.series_id = f.series_id),
xi AS (SELECT sum(exp(a0 + {LA[0][0]} + b0 + z0 - ll)) AS c00, sum(exp(a0 + {LA[0][1]} + b1 + z1 - ll)) AS c01,
  sum(exp(a1 + {LA[1][0]} + b0 + z0 - ll)) AS c10, sum(exp(a1 + {LA[1][1]} + b1 + z1 - ll)) AS c11 FROM pairs),
tot AS (SELECT sum(g0) FILTER (n = 1) / count(*) FILTER (n = 1) AS pi0, sum(g0) AS n0, sum(1 - g0) AS n1 FROM gam),
mu AS (SELECT sum(g0 * x0) / sum(g0) AS m00, sum(g0 * x1) / sum(g0) AS m01, sum((1 - g0) * x0) / sum(1 - g0) AS m10, sum((1 - g0) * x1) / sum(1 - g0) AS m11
  FROM gam JOIN sequences USING (series_id, dt)),
va AS (SELECT sum(g0 * (x0 - m00) ^ 2) / sum(g0) + 1e-4 AS v00, sum(g0 * (x1 - m01) ^ 2) / sum(g0) + 1e-4 AS v01,
  sum((1 - g0) * (x0 - m10) ^ 2) / sum(1 - g0) + 1e-4 AS v10, sum((1 - g0) * (x1 - m11) ^ 2) / sum(1 - g0) + 1e-4 AS v11
  FROM gam JOIN sequences USING (series_id, dt), mu)""") + """
SELECT 0 AS k, round(pi0, 6) AS pi, round((c00 + 0.01) / (c00 + c01 + 0.02), 6) AS a_0, round((c01 + 0.01) / (c00 + c01 + 0.02), 6) AS a_1,
  round(m00, 6) AS mu_0, round(m01, 6) AS mu_1, round(v00, 6) AS var_0, round(v01, 6) AS var_1 FROM tot, xi, mu, va
UNION ALL SELECT 1, round(1 - pi0, 6), round((c10 + 0.01) / (c10 + c11 + 0.02), 6), round((c11 + 0.01) / (c10 + c11 + 0.02), 6),
  round(m10, 6), round(m11, 6), round(v10, 6), round(v11, 6) FROM tot, xi, mu, va""")
def m7(t):
    placed = sequence.ordered(fixed_rows(t))
    moved = sequence.improve(placed, {0: {0: CHAIN}}, 1)[0][0]
    out = sequence.parameter_table(t.spark, {0: moved})
    return out.select(
        "k", r("pi").alias("pi"), *[r(F.col("a")[j]).alias(f"a_{j}") for j in range(2)],
        *[r(F.col("mu")[j]).alias(f"mu_{j}") for j in range(2)], *[r(F.col("sigma2")[j]).alias(f"var_{j}") for j in range(2)],
    )


@query("m7_m8_blocks_em_step", ORACLES["m7_m8_one_em_step"])
def m7_blocks(t):
    """The same step from blocks of days."""
    placed = scan.in_blocks(fixed_rows(t), "series_id", "dt", "x", BLOCK_ROWS)
    out = sequence.parameter_table(t.spark, {0: sequence.maximise(scan.statistics(placed, CHAIN), CHAIN)})
    return out.select(
        "k", r("pi").alias("pi"), *[r(F.col("a")[j]).alias(f"a_{j}") for j in range(2)],
        *[r(F.col("mu")[j]).alias(f"mu_{j}") for j in range(2)], *[r(F.col("sigma2")[j]).alias(f"var_{j}") for j in range(2)],
    )


KEYED_SEQUENCES = SEQUENCES + ", keyed AS MATERIALIZED (SELECT 0 AS g, series_id || '/' || dt AS row_id, * FROM sequences)"


def chain_rows(chain_names, k: int, d: int) -> str:
    """One row per state from the columns of a fit."""
    return " UNION ALL ".join(f"SELECT {c} AS k, round(pi{c}, 4) AS pi, " + ", ".join(f"round(a{c}{j}, 4) AS a_{j}" for j in range(k)) + ", " + ", ".join(
        f"round({p}{c}_{i}, 4) AS {n}_{i}" for p, n in (("m", "mu"), ("s", "var")) for i in range(d)) + f"{chain_names} FROM fitted" for c in range(k))


@query("m9_m10_sequence_fit_best_of", with_recursive(KEYED_SEQUENCES, *fit_sql.chain("keyed", 2, 3, 5, 200)) + " "
       + chain_rows(", round(ll, 3) AS log_likelihood, CAST(steps AS INTEGER) AS iterations", 3, 2))
def m9(t):
    chain = sequence.fit(panels.sequences(t), k=3, restarts=5, iterations=200)
    out = sequence.parameter_table(t.spark, {0: chain})
    return out.select(
        "k", r("pi", 4).alias("pi"), *[r(F.col("a")[j], 4).alias(f"a_{j}") for j in range(3)], *[r(F.col("mu")[i], 4).alias(f"mu_{i}") for i in range(2)],
        *[r(F.col("sigma2")[i], 4).alias(f"var_{i}") for i in range(2)], r("log_likelihood", 3).alias("log_likelihood"), "iterations",
    )


LABELS = ["Easing", "Risk-Off"]


@query("m13_j9_described_states", with_recursive(EMIT, FORWARD, BACKWARD, GAMMA) + """,
hot AS (SELECT series_id, dt, exp(ln(greatest(g0, 1e-12)) / 1.25) AS h0, exp(ln(greatest(1 - g0, 1e-12)) / 1.25) AS h1 FROM gam),
pr AS (SELECT series_id, dt, h0 / (h0 + h1) AS p0, h1 / (h0 + h1) AS p1 FROM hot)
SELECT series_id, dt, CASE WHEN p0 >= p1 THEN 0 ELSE 1 END AS state, CASE WHEN p0 >= p1 THEN 'Easing' ELSE 'Risk-Off' END AS label,
  round(p0, 6) AS p_0, round(p1, 6) AS p_1, round(greatest(p0, p1), 6) AS max_prob,
  round(-greatest(p0, 1e-12) * ln(greatest(p0, 1e-12)) - greatest(p1, 1e-12) * ln(greatest(p1, 1e-12)), 6) AS entropy FROM pr""")
def m13(t):
    names = t.spark.createDataFrame(list(enumerate(LABELS)), "state int, label string")
    out = labels.describe(sequence.decode(fixed_rows(t), CHAIN).drop("grp"), 2, names, temperature=1.25)
    return rounded(out, "p_0", "p_1", "max_prob", "entropy")


# --- labels ---------------------------------------------------------------------------

MEANS = STATES + ", " + Z_ASSETS + """, means AS (
SELECT s.portfolio, CAST(s.state AS INTEGER) AS state, z.feature, avg(z.value) AS mu FROM z JOIN states s ON s.dt = z.dt GROUP BY 1, 2, 3)"""
MKEY = ["portfolio", "state"]


def means(t):
    return labels.state_means(scaled_assets(t), panels.states(t).select("portfolio", "dt", "state"), ["portfolio"])


GROUP_ROWS = "grps(g, feature) AS (" + values((g, f) for g, names in labels.FEATURE_GROUPS.items() for f in names) + ")"
WEIGHT_ROWS = "lw(i, label, g, w) AS (" + values(
    (i, n, g, w) for i, (n, parts) in enumerate(labels.LABEL_WEIGHTS.items()) for g, w in parts.items()) + ")"
SCORED = """gs AS (SELECT m.portfolio, m.state, k.g, coalesce(avg(x.mu), 0) AS score
  FROM (SELECT DISTINCT portfolio, state FROM means) m CROSS JOIN (SELECT DISTINCT g FROM grps) k
  LEFT JOIN (SELECT portfolio, state, g, mu FROM means JOIN grps USING (feature)) x ON x.portfolio = m.portfolio AND x.state = m.state AND x.g = k.g
  GROUP BY 1, 2, 3)"""


@query("m15_group_scores", with_(MEANS, GROUP_ROWS, SCORED) + " SELECT portfolio, state, " + ", ".join(
    f"round(max(score) FILTER (g = '{g}'), 6) + 0.0 AS {g}" for g in labels.FEATURE_GROUPS) + " FROM gs GROUP BY 1, 2")
def m15(t):
    out = labels.group_scores(means(t), MKEY)
    return out.select(*MKEY, *[(r(g) + 0.0).alias(g) for g in labels.FEATURE_GROUPS])


def values_of(text) -> str:
    return "[" + ", ".join("'" + text(n).replace("'", "''") + "'" for n in labels.LABEL_WEIGHTS) + "]"


@query("m16_state_labels", with_(MEANS, GROUP_ROWS, WEIGHT_ROWS, SCORED) + """,
ls AS (SELECT portfolio, state, i, label, sum(score * w) AS s FROM gs JOIN lw USING (g) GROUP BY ALL),
best AS (SELECT portfolio, state, first(i ORDER BY s DESC, i) AS b FROM ls GROUP BY 1, 2)
SELECT b.portfolio, b.state, ['Easing', 'Reacceleration', 'Stagflation', 'Risk-Off'][b + 1] AS label,
  """ + values_of(lambda n: labels.LABEL_TEXTS[n][1]) + """[b + 1] AS description, """ + ", ".join(
    f"round(max(s) FILTER (i = {i}), 3) AS {n}" for i, n in enumerate(labels.LABEL_WEIGHTS)) + """
FROM best b JOIN ls ON ls.portfolio = b.portfolio AND ls.state = b.state GROUP BY 1, 2, b""")
def m16(t):
    return labels.assign(means(t), MKEY).drop("n_features")


ASSET_FEATURES = [f"ret_{a}" for a in ASSETS]


@query("m14_state_summary", with_(MEANS) + """,
sh AS (SELECT portfolio, CAST(state AS INTEGER) AS state, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY portfolio) AS share FROM states GROUP BY 1, 2)
SELECT sh.portfolio, sh.state, n, round(share, 6) AS share, """ + ", ".join(
    f"""round(max(mu) FILTER (feature = '{f}'), 6) AS "{f}\"""" for f in ASSET_FEATURES) + """ FROM sh LEFT JOIN means m ON m.portfolio = sh.portfolio AND m.state = sh.state GROUP BY ALL""")
def m14(t):
    out = labels.state_summary(panels.states(t), means(t), ["portfolio"], ASSET_FEATURES)
    return rounded(out, "share", *ASSET_FEATURES)


@query("t2_supporting_features", with_(MEANS) + """
SELECT portfolio, state, feature, round(mu, 6) AS mu, CAST(rn AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY portfolio, state ORDER BY abs(mu) DESC, feature) AS rn FROM means) WHERE rn <= 5""")
def t2(t):
    return rounded(labels.supporting_features(means(t), MKEY), "mu").select("portfolio", "state", "feature", "mu", "rank")


@query("t3_discriminating_features", with_(MEANS) + """,
st AS (SELECT *, abs((mu - avg(mu) OVER w) / greatest(stddev_pop(mu) OVER w, 1e-9)) AS gap FROM means WINDOW w AS (PARTITION BY portfolio, feature)),
tb AS (SELECT portfolio, feature, avg(gap) AS d, max(mu) FILTER (state = 0) AS s0, max(mu) FILTER (state = 1) AS s1, max(mu) FILTER (state = 2) AS s2,
  max(mu) FILTER (state = 3) AS s3 FROM st GROUP BY 1, 2)
SELECT portfolio, feature, round(s0, 6) AS "S0_z", round(s1, 6) AS "S1_z", round(s2, 6) AS "S2_z", round(s3, 6) AS "S3_z", round(d, 6) AS discrimination,
  CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY d DESC, feature) AS rn FROM tb) WHERE rn <= 6""")
def t3(t):
    out = labels.discriminating_features(means(t), ["portfolio"], range(4), 6)
    return rounded(out, "S0_z", "S1_z", "S2_z", "S3_z", "discrimination")


def asset_panel(t):
    """One series of daily asset returns, in the fixed asset order."""
    wide = panels.asset_returns(t).groupBy("dt").pivot("asset", list(ASSETS)).agg(F.max("ret"))
    return wide.select(F.lit("ALL").alias("series_id"), "dt", F.array(*[F.col(f"`{a}`") for a in ASSETS]).alias("x"))


@query("p_end_to_end_backtest")
def end_to_end(t):
    """Features to gates: every fold's model, labels, weights, net returns, metrics (A7-A9) and acceptance (Q13)."""
    plan = folds.FoldPlan(train=756, step=63, refit_every=252)
    rows = stored(asset_panel(t), "asset-panel")
    _, metrics = backtest.end_to_end(rows, panels.asset_returns(t), ASSET_FEATURES, plan, restarts=2)
    return metrics


def asset_sequences(t):
    """Scaled asset returns, each calendar year a sequence of its own, in long form."""
    return scaled_assets(t).select(F.year("dt").alias("series_id"), "dt", "feature", "value")


YEARS = Z_ASSETS + """, given AS MATERIALIZED (SELECT year(dt) AS series_id, dt, """ + ", ".join(
    f"max(value) FILTER (feature = '{f}') AS x{i}" for i, f in enumerate(ASSET_FEATURES)) + """ FROM z GROUP BY dt),
panel AS MATERIALIZED (SELECT 0 AS g, series_id || '/' || dt AS row_id, series_id, dt, """ + ", ".join(
    f"coalesce(x{i}, 0) AS x{i}" for i in range(len(ASSET_FEATURES))) + " FROM given)"
N_FEATURES = len(ASSET_FEATURES)


def labelled_sql() -> list[str]:
    """named: the label of each state c of the model in `fitted`."""
    cells = ", ".join(f"({c}, '{f}', m{c}_{i})" for c in range(4) for i, f in enumerate(ASSET_FEATURES))
    return [f"means AS (SELECT 0 AS portfolio, v.state, v.feature, v.mu FROM fitted, LATERAL (VALUES {cells}) v(state, feature, mu))", GROUP_ROWS, WEIGHT_ROWS, SCORED,
            "ls AS (SELECT state, i, sum(score * w) AS s FROM gs JOIN lw USING (g) GROUP BY ALL)",
            "named AS (SELECT state, ['Easing', 'Reacceleration', 'Stagflation', 'Risk-Off'][first(i ORDER BY s DESC, i) + 1] AS label FROM ls GROUP BY 1)"]


def flat(prefix: str, name: str, c: int) -> str:
    return ", ".join(f"round({prefix}{c}_{i}, 4) AS {name}_{i}" for i in range(N_FEATURES))


@query("m17_fit_all", with_recursive(
    YEARS, *fit_sql.chain("panel", N_FEATURES, 4, 5, 200), *fit_sql.tagged(fit_sql.mixture("panel", N_FEATURES, 4), "mix"), *labelled_sql(),
    *fit_sql.chain_shares("panel", 4, N_FEATURES), """parts AS (SELECT state, count(*) / sum(count(*)) OVER () AS share FROM (
  SELECT list_position([p0, p1, p2, p3], greatest(p0, p1, p2, p3)) - 1 AS state FROM scored) GROUP BY state)""",
    "flat AS (" + " UNION ALL ".join(f"SELECT {c} AS state, pi{c} AS weight, {flat('m', 'mu', c)}, {flat('s', 'var', c)}, ll FROM fitted" for c in range(4)) + ")") + f"""
SELECT 'sequence' AS model, CAST(f.state AS INTEGER) AS state, round(weight, 4) AS weight, {", ".join(f"{n}_{i}" for n in ("mu", "var") for i in range(N_FEATURES))},
  round(ll, 3) AS log_likelihood, label, round(coalesce(share, 0), 4) AS share, coalesce(share, 0) < 0.02 AS rare
FROM flat f JOIN named USING (state) LEFT JOIN parts USING (state)
UNION ALL SELECT 'mixture', CAST(c - 1 AS INTEGER), round(w, 4), {", ".join(f"round({n}{i}, 4)" for n in "ms" for i in range(N_FEATURES))}, round(ll, 3), NULL, NULL, FALSE FROM fitted_mix""")
def m17(t):
    wide = asset_sequences(t).groupBy("series_id", "dt").agg(F.array(*[
        F.coalesce(F.max(F.when(F.col("feature") == f, F.col("value"))), F.lit(0.0)) for f in ASSET_FEATURES]).alias("x"))
    fitted = scoring.fit_all(stored(wide, "asset-years"), ASSET_FEATURES)
    out = scoring.fitted_states(t.spark, fitted)
    return out.select(
        "model", "state", r("weight", 4).alias("weight"), *[r(F.col("mu")[i], 4).alias(f"mu_{i}") for i in range(N_FEATURES)],
        *[r(F.col("sigma2")[i], 4).alias(f"var_{i}") for i in range(N_FEATURES)], r("log_likelihood", 3).alias("log_likelihood"), "label", r("share", 4).alias("share"), F.coalesce("rare", F.lit(False)).alias("rare"),
    )


SHOCKED = "shocked AS MATERIALIZED (SELECT 0 AS g, s.scenario || '/' || series_id AS series_id, dt, " + ", ".join(
    f"coalesce(x{i} + coalesce(max(k.shock) FILTER (k.feature = '{f}'), 0), 0) AS x{i}" for i, f in enumerate(ASSET_FEATURES)) + """
  FROM given CROSS JOIN (SELECT DISTINCT scenario FROM shocks) s LEFT JOIN shocks k ON k.scenario = s.scenario
  GROUP BY s.scenario, series_id, dt, """ + ", ".join(f"x{i}" for i in range(N_FEATURES)) + ")"
REGIME_ROWS = "rw(label, asset, w) AS (" + values((n, a, w) for n, row in REGIME_WEIGHTS.items() for a, w in zip(ASSETS, row)) + ")"


@query("p18_fitted_scenario_run", with_recursive(
    YEARS, SHOCKS, REGIME_ROWS, *fit_sql.chain("panel", N_FEATURES, 4, 3, 50), *labelled_sql(), SHOCKED, *fit_sql.chain_shares("shocked", 4, N_FEATURES), """
sh AS (SELECT regexp_replace(series_id, '/[0-9]+$', '') AS scenario, dt, unnest([0, 1, 2, 3]) AS state, unnest([p0, p1, p2, p3]) AS p FROM scored),
wt AS (SELECT scenario, dt, asset, sum(p * w) AS w FROM sh JOIN named USING (state) JOIN rw USING (label) GROUP BY ALL),
ret AS (SELECT scenario, wt.dt, sum(w * a.ret) AS ret FROM wt JOIN asset_returns a ON a.dt = wt.dt AND a.asset = wt.asset GROUP BY ALL)""") + """
SELECT scenario, count(*) AS n_trading_days, round(avg(ret) / stddev_samp(ret) * sqrt(252), 5) AS sharpe, round(stddev_samp(ret) * sqrt(252), 5) AS ann_vol
FROM ret GROUP BY 1""")
def p18_fitted(t):
    """Shocked panels scored by a sequence model fitted on the panel as it is, its labelled states turned into weights."""
    long = stored(asset_sequences(t), "asset-years")
    wide = long.groupBy("series_id", "dt").agg(F.array(*[
        F.coalesce(F.max(F.when(F.col("feature") == f, F.col("value"))), F.lit(0.0)) for f in ASSET_FEATURES]).alias("x"))
    chain = sequence.fit(stored(wide, "asset-rows"), k=4, restarts=3, iterations=50)
    scored = scoring.scenario_scores(long, ASSET_FEATURES, chain, list(scenarios.SCENARIOS.values()))
    weighted = scored.withColumn("w", weights_by_label(F.col("p"), F.col("regimes")))
    returns = weighted.join(pnl.pack_returns(panels.asset_returns(t)), "dt").select("scenario", "dt", pnl.dot(F.col("w"), F.col("r")).alias("ret"))
    out = performance.return_metrics(stored(returns, "scenario-returns"), ["scenario"])
    return out.select("scenario", "n_trading_days", r("sharpe", 5).alias("sharpe"), r("ann_vol", 5).alias("ann_vol"))


ROLLING = folds.FoldPlan(train=15, step=5, refit_every=10, expanding=False)


def scaled_folds_sql(plan: folds.FoldPlan) -> str:
    """trained: every refitted fold's training rows, scaled by their own statistics; tested: the rows its model scores."""
    first = "0" if plan.expanding else f"f * {plan.step}"
    return f"""days AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS i, count(*) OVER () AS n_days FROM (SELECT DISTINCT dt FROM sequences)),
placed AS (SELECT s.*, i, n_days FROM sequences s JOIN days USING (dt)),
members AS (SELECT f AS g, series_id || '/' || dt AS row_id, series_id, dt, x0, x1 FROM placed, range(0, 1000) q(f)
  WHERE f % {plan.refit_folds} = 0 AND f <= (n_days - 1 - {plan.train}) // {plan.step} AND i >= {first} AND i < {plan.train} + f * {plan.step}),
scale AS (SELECT g, avg(x0) AS a0, coalesce(nullif(stddev_samp(x0), 0), 1) AS b0, avg(x1) AS a1, coalesce(nullif(stddev_samp(x1), 0), 1) AS b1 FROM members GROUP BY g),
trained AS MATERIALIZED (SELECT g, row_id, series_id, dt, (x0 - a0) / b0 AS x0, (x1 - a1) / b1 AS x1 FROM members JOIN scale USING (g)),
blocks AS (SELECT *, (i - {plan.train}) // {plan.step} AS fold, (i - {plan.train}) // {plan.step} // {plan.refit_folds} * {plan.refit_folds} AS g FROM placed WHERE i >= {plan.train}),
tested AS MATERIALIZED (SELECT b.g, fold, series_id, dt, (x0 - a0) / b0 AS x0, (x1 - a1) / b1 AS x1 FROM blocks b JOIN scale USING (g))"""


@query("p19_walk_forward_mixture_scores", with_recursive(
    SEQUENCES, scaled_folds_sql(ROLLING), *fit_sql.mixture("trained", 2, 2), fit_sql.mixture_shares("tested", 2, kept="fold, series_id, dt")) + """
SELECT series_id, dt, CAST(fold AS INTEGER) AS fold, CAST(g AS INTEGER) AS model_fold, round(max(p) FILTER (c = 1), 4) AS p_0,
  CAST(first(c ORDER BY p DESC, c) - 1 AS INTEGER) AS state FROM scored GROUP BY series_id, dt, fold, g""")
def p19_mixture(t):
    out = scoring.walk_forward(panels.sequences(t), ROLLING, k=2, restarts=10, iterations=500, dims=2, model="mixture")
    return out.select("series_id", "dt", "fold", "model_fold", r(F.col("p")[0], 4).alias("p_0"), "state")


EXPANDING = folds.FoldPlan(train=15, step=5, refit_every=5)


@query("p19_walk_forward_scores", with_recursive(
    SEQUENCES, scaled_folds_sql(EXPANDING), *fit_sql.chain("trained", 2, 2, 3, 200), *fit_sql.chain_shares("tested", 2, 2),
    "eves AS MATERIALIZED (SELECT * FROM trained QUALIFY dt = max(dt) OVER (PARTITION BY g))", *fit_sql.chain_shares("eves", 2, 2, "fresh")) + """,
opens AS (SELECT dt FROM days WHERE i >= 15 AND (i - 15) % 5 = 0),
lagged AS (SELECT *, lag(p0) OVER (PARTITION BY series_id ORDER BY dt) AS before FROM scored)
SELECT s.series_id, s.dt, CAST(s.g AS INTEGER) AS fold, round(s.p0, 4) AS p_0, CASE WHEN s.p0 >= s.p1 THEN 0 ELSE 1 END AS state,
  round(CASE WHEN o.dt IS NOT NULL THEN f.p0 ELSE before END, 4) AS trade_p_0
FROM lagged s LEFT JOIN opens o ON o.dt = s.dt LEFT JOIN fresh f ON f.g = s.g AND f.series_id = s.series_id""")
def p19(t):
    out = scoring.walk_forward(panels.sequences(t), EXPANDING, k=2, restarts=3, iterations=200, dims=2)
    return out.select("series_id", "dt", "fold", r(F.col("p")[0], 4).alias("p_0"), "state", r(F.col("trade_p")[0], 4).alias("trade_p_0"))
