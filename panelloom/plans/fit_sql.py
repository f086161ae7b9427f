"""Model fits written out as recursive SQL, to compare whole fits with (DuckDB dialect).

Every function returns common table expressions for a `WITH RECURSIVE`. The row tables hold (g, row_id, x0, x1, ...), a
row once in each group g it belongs to; a group has a model of its own.
"""

from __future__ import annotations

import math
import re

from panelloom.functions.probability import VARIANCE_FLOOR

# Constants are written as 1e-06, which the dialect reads as DOUBLE, not as DECIMAL.
LOG_2PI = f"{math.log(2 * math.pi):.17e}"


TABLES = re.compile(r"\b(drawn|spread|start|series|em|ended|judged|fitted)\b")


def tagged(parts: list[str], tag: str) -> list[str]:
    """The same expressions under table names of their own, so that two fits fit into one statement."""
    return [TABLES.sub(lambda found: f"{found[1]}_{tag}", part) for part in parts]


def double(value: float) -> str:
    return f"{value:.17e}"


def starts(source: str, d: int, k: int, restarts: int, reg: float, seed: int) -> str:
    """start: the k rows of smallest digest in each group and restart, with the group's variances."""
    xs = ", ".join(f"x{i} AS m{i}" for i in range(d))
    return f"""drawn AS (SELECT g, s AS restart, {xs}, row_number() OVER (PARTITION BY g, s ORDER BY md5((s + {seed}) || ':' || row_id), row_id) AS c
  FROM {source}, range({restarts}) q(s)),
spread AS (SELECT g, {", ".join(f"var_pop(x{i}) + {double(reg)} AS s{i}" for i in range(d))} FROM {source} GROUP BY g),
start AS (SELECT * FROM drawn JOIN spread USING (g) WHERE c <= {k})"""


def log_density(d: int) -> str:
    return "-0.5 * (" + " + ".join(f"{LOG_2PI} + ln(s{i}) + (x{i} - m{i}) * (x{i} - m{i}) / s{i}" for i in range(d)) + ")"


def columns(prefix: str, d: int) -> str:
    return ", ".join(f"{prefix}{i}" for i in range(d))


def shares(joined: str, by: str) -> str:
    """Rows with each class's share `p` and the row's log density `total`."""
    return f"""(SELECT *, exp(l - total) AS p FROM (SELECT *, top + ln(sum(exp(l - top)) OVER (PARTITION BY {by})) AS total FROM (
      SELECT *, max(l) OVER (PARTITION BY {by}) AS top FROM ({joined}))))"""


def mixture(source: str, d: int, k: int, restarts: int = 10, iterations: int = 500, tol: float = 1e-3, reg: float = 1e-6, seed: int = 42) -> list[str]:
    """fitted: (g, restart, c, w, m0.., s0.., ll, n, steps) of each group's best restart after EM has settled."""
    ms, ss = columns("m", d), columns("s", d)
    joined = f"SELECT e.*, v.row_id, {columns('x', d)}, ln(w) + {log_density(d)} AS l FROM {{params}} e JOIN {source} v ON v.g = e.g {{some}}"
    rows = "g, restart, row_id"
    moved = ", ".join(f"sum(p * x{i}) / sum(p) AS n{i}, sum(p * (x{i} - m{i}) * (x{i} - m{i})) / sum(p) AS q{i}, any_value(m{i}) AS o{i}" for i in range(d))
    return [starts(source, d, k, restarts, reg, seed), f"""em AS (
  SELECT 0 AS step, g, restart, c, {double(1 / k)} AS w, {ms}, {ss}, -1e300 AS level, FALSE AS done FROM start
  UNION ALL
  SELECT step + 1, g, restart, c, mass / sum(mass) OVER (PARTITION BY g, restart), {columns("n", d)},
    {", ".join(f"greatest(q{i} - (n{i} - o{i}) * (n{i} - o{i}) + {double(reg)}, {double(VARIANCE_FLOOR)})" for i in range(d))}, now, abs(now - level) < {double(tol)}
  FROM (SELECT any_value(step) AS step, g, restart, c, any_value(level) AS level, sum(p) AS mass, avg(total) AS now, {moved}
    FROM {shares(joined.format(params="em", some=f"WHERE NOT done AND step < {iterations}"), rows)} GROUP BY g, restart, c))""",
            "ended AS MATERIALIZED (SELECT * FROM em QUALIFY step = max(step) OVER (PARTITION BY g, restart))",
            f"""judged AS (SELECT g, restart, sum(total) AS ll, count(*) AS n
  FROM {shares(joined.format(params="ended", some=""), rows)} WHERE c = 1 GROUP BY g, restart)""",
            f"""fitted AS MATERIALIZED (SELECT g, restart, c, w, {ms}, {ss}, ll, n, step AS steps FROM ended JOIN (
  SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY g ORDER BY ll DESC, restart) = 1) USING (g, restart))"""]


def mixture_shares(source: str, d: int, name: str = "scored", kept: str = "row_id") -> str:
    """Shares p of every class c for the rows of `source` under their group's fitted mixture."""
    names = ", ".join(f"v.{c}" for c in kept.split(", "))
    joined = f"SELECT e.g, e.c, {names}, ln(w) + {log_density(d)} AS l FROM fitted e JOIN {source} v ON v.g = e.g"
    return f"{name} AS {shares(joined, 'g, ' + kept)}"


# --- sequence models ------------------------------------------------------------------


def series_lists(source: str, d: int, name: str) -> str:
    """One row per group and sequence: its days and each dimension as lists in date order."""
    lists = ", ".join(f"list(x{i} ORDER BY dt) AS v{i}" for i in range(d))
    return f"{name} AS MATERIALIZED (SELECT g, series_id, count(*) AS len, list(dt ORDER BY dt) AS days, {lists} FROM {source} GROUP BY g, series_id)"


def chain_columns(k: int, d: int) -> list[str]:
    return [f"pi{c}" for c in range(k)] + [f"a{c}{j}" for c in range(k) for j in range(k)] + [
        f"{p}{c}_{i}" for p in "ms" for c in range(k) for i in range(d)]


def smoothing(params: str, lists: str, k: int, d: int, some: str = "", kept: str = "") -> str:
    """A row per day with its shares p0.., the transition shares t00.. into the next day (null on the last) and the sequence's likelihood.

    Lists hold k shares and the total they were divided by, for one day after the other.
    """
    held = ", ".join(["e.g", *chain_columns(k, d), *kept.split(", ")] if kept else ["e.g", *chain_columns(k, d)])
    width = k + 1
    density = ", ".join("-0.5 * (" + " + ".join(
        f"{LOG_2PI} + ln(s{c}_{i}) + (v{i}[t] - m{c}_{i}) * (v{i}[t] - m{c}_{i}) / s{c}_{i}" for i in range(d)) + ")" for c in range(k))

    def scaled(parts: list[str]) -> str:
        return f"list_transform([[{', '.join(parts)}]], lambda n: list_concat(list_transform(n, lambda q: q / list_sum(n)), [list_sum(n)]))[1]"

    opening = scaled([f"pi{c} * b[1][{c + 1}]" for c in range(k)])
    ahead = scaled(["(" + " + ".join(f"acc[{i - width}] * a{i}{j}" for i in range(k)) + f") * e[{j + 1}]" for j in range(k)])
    back = scaled([" + ".join(f"a{i}{j} * e[{j + 1}] * acc[{j - width}]" for j in range(k)) for i in range(k)])
    mixed = ", ".join(f"f[(t - 1) * {width} + {c + 1}] * r[(len - t) * {width} + {c + 1}] AS u{c}" for c in range(k))
    pairs = ", ".join(
        f"CASE WHEN t < len THEN f[(t - 1) * {width} + {i + 1}] * a{i}{j} * b[t + 1][{j + 1}] * r[(len - t - 1) * {width} + {j + 1}] END AS w{i}{j}"
        for i in range(k) for j in range(k))
    total, moved = " + ".join(f"u{c}" for c in range(k)), " + ".join(f"w{i}{j}" for i in range(k) for j in range(k))
    return f"""(SELECT *, {", ".join(f"u{c} / ({total}) AS p{c}" for c in range(k))}, {", ".join(f"w{i}{j} / ({moved}) AS t{i}{j}" for i in range(k) for j in range(k))}
  FROM (SELECT *, days[t] AS dt, {", ".join(f"v{i}[t] AS x{i}" for i in range(d))}, {mixed}, {pairs}
  FROM (SELECT *, unnest(range(1, len + 1)) AS t
  FROM (SELECT *, list_reduce(list_prepend({opening}, b[2:]), lambda acc, e: list_concat(acc, {ahead})) AS f,
    list_reduce(list_prepend([{", ".join("1.0::DOUBLE" for _ in range(width))}], list_reverse(b[2:])), lambda acc, e: list_concat(acc, {back})) AS r
  FROM (SELECT *, list_transform(logs, lambda e: list_transform(e, lambda q: exp(q - list_max(e)))) AS b,
    list_sum(list_transform(logs, lambda e: list_max(e))) AS peaks
  FROM (SELECT {held}, v.* EXCLUDE (g), list_transform(range(1, len + 1), lambda t: [{density}]) AS logs
  FROM {params} e JOIN {lists} v ON v.g = e.g {some}))))))"""


def likelihood(k: int) -> str:
    """Log likelihood of a sequence, taken from its first day's row."""
    return f"sum(CASE WHEN t = 1 THEN peaks + list_sum(list_transform(range(1, len + 1), lambda z: ln(f[z * {k + 1}]))) END)"


def chain(source: str, d: int, k: int, restarts: int, iterations: int, tol: float = 1e-4, seed: int = 42) -> list[str]:
    """fitted: (g, restart, pi.., a.., m.., s.., ll, steps) of each group's best restart after EM has settled."""
    reg, soft = double(1e-4), 0.01
    names = chain_columns(k, d)
    stay = [double((0.85 if i == j else 0.05) / (0.85 + 0.05 * (k - 1))) for i in range(k) for j in range(k)]
    first = [double(1 / k)] * k + stay + [f"max(m{i}) FILTER (c = {c + 1})" for c in range(k) for i in range(d)] + [
        f"max(s{i})" for c in range(k) for i in range(d)]
    mass = [f"sum(p{c})" for c in range(k)]
    sums = [f"sum(CASE WHEN t = 1 THEN p{c} END) / count(*) FILTER (t = 1) AS n_pi{c}" for c in range(k)]
    sums += [f"coalesce(sum(t{i}{j}), 0) AS n_a{i}{j}" for i in range(k) for j in range(k)]
    sums += [f"sum(p{c} * x{i}) / {mass[c]} AS n_m{c}_{i}" for c in range(k) for i in range(d)]
    sums += [f"sum(p{c} * (x{i} - m{c}_{i}) * (x{i} - m{c}_{i})) / {mass[c]} AS q{c}_{i}, any_value(m{c}_{i}) AS o{c}_{i}" for c in range(k) for i in range(d)]
    moved = [f"n_pi{c}" for c in range(k)]
    moved += [f"(n_a{i}{j} + {soft}::DOUBLE) / (" + " + ".join(f"n_a{i}{z}" for z in range(k)) + f" + {double(soft * k)})" for i in range(k) for j in range(k)]
    moved += [f"n_m{c}_{i}" for c in range(k) for i in range(d)]
    moved += [f"greatest(q{c}_{i} - (n_m{c}_{i} - o{c}_{i}) * (n_m{c}_{i} - o{c}_{i}) + {reg}, {double(VARIANCE_FLOOR)})" for c in range(k) for i in range(d)]
    return [starts(source, d, k, restarts, 1e-4, seed), series_lists(source, d, "series"), f"""em AS (
  SELECT 0 AS step, g, restart, {", ".join(f"{v} AS {n}" for v, n in zip(first, names))}, -1e300 AS level, FALSE AS done FROM start GROUP BY g, restart
  UNION ALL
  SELECT step + 1, g, restart, {", ".join(moved)}, now, abs(now - level) < {double(tol)}
  FROM (SELECT any_value(step) AS step, g, restart, any_value(level) AS level, {likelihood(k)} AS now, {", ".join(sums)}
    FROM {smoothing("em", "series", k, d, f"WHERE NOT done AND step < {iterations}", "step, restart, level")} GROUP BY g, restart))""",
            "ended AS MATERIALIZED (SELECT * FROM em QUALIFY step = max(step) OVER (PARTITION BY g, restart))",
            f"judged AS (SELECT g, restart, {likelihood(k)} AS ll FROM {smoothing('ended', 'series', k, d, '', 'restart')} GROUP BY g, restart)",
            f"""fitted AS MATERIALIZED (SELECT g, restart, {", ".join(names)}, ll, step AS steps FROM ended JOIN (
  SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY g ORDER BY ll DESC, restart) = 1) USING (g, restart))"""]


def chain_shares(source: str, k: int, d: int, name: str = "scored", params: str = "fitted") -> list[str]:
    """Smoothed shares p0.. of every day of `source`, whose groups name the model."""
    return [series_lists(source, d, f"{name}_series"), f"{name} AS (SELECT g, series_id, dt, {columns('p', k)} FROM {smoothing(params, name + '_series', k, d)})"]
