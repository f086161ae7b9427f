"""Quality rules: fixed text measures, then a calibrated logistic regression on hashed word and character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.llm import spans

# A bounded, documented sample: about this many labelled rows, chosen by hashed id, fit the classifier.
SAMPLE_ROWS = 4000
BITS = 16
CHAR_N = 3
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Model:
    """Weights by feature, and the calibrated slope and intercept. Few enough to travel with the task."""

    word_weights: np.ndarray
    char_weights: np.ndarray
    slope: float
    intercept: float


def measures(data: np.ndarray, at: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, spans.Prefix]:
    """The five measures of every text in the buffer, with word hashes for further use."""
    n = len(at) - 1
    starts, ends, row = spans.words(data, at)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    prefix = spans.Prefix(data)
    word = prefix.of(starts, ends)
    n_words = np.bincount(row, minlength=n)

    breaks = np.flatnonzero(data == 10)
    line_start = np.concatenate([at[:-1], breaks + 1])
    line_row = np.concatenate([np.arange(n), np.searchsorted(at, breaks, "right") - 1])
    order = np.lexsort((line_start, line_row))
    line_start, line_row = line_start[order], line_row[order]
    line_end = at[line_row + 1]
    more = np.flatnonzero(line_row[1:] == line_row[:-1])
    line_end[more] = line_start[more + 1] - 1
    held = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_row, line = line_row[held], prefix.of(line_start[held], line_end[held])
    order = np.lexsort((line, line_row))
    repeated = ~spans.equal_runs(line_row[order], line[order])
    n_dup_lines = np.bincount(line_row[order][repeated], minlength=n)

    n_repeat_words = np.zeros(n, np.int64)
    if len(word) >= 5:
        with np.errstate(over="ignore"):
            value = np.zeros(len(word) - 4, np.uint64)
            for i in range(5):
                value = value * np.uint64(spans.BASE) + word[i:len(word) - 4 + i]
        first = np.flatnonzero(row[:-4] == row[4:])
        order = np.lexsort((value[first], row[first]))
        run = np.cumsum(spans.equal_runs(row[first][order], value[first][order])) - 1
        twice = first[order][np.bincount(run)[run] > 1] if len(run) else first[:0]
        edge = np.bincount(twice, minlength=len(word) + 5)[:len(word) + 5] - np.bincount(twice + 5, minlength=len(word) + 5)[:len(word) + 5]
        n_repeat_words = np.bincount(row[np.cumsum(edge)[:len(word)] > 0], minlength=n)

    found = {
        "n_words": n_words,
        "word_chars": np.bincount(row, weights=points[ends] - points[starts], minlength=n).astype(np.int64),
        "n_symbols": symbols[at[1:]] - symbols[at[:-1]],
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat_words,
    }
    return {k: v.astype(np.int64) for k, v in found.items()}, word, row, prefix


def features(prefix: spans.Prefix, at: np.ndarray, word: np.ndarray, row: np.ndarray):
    """(bin, text) of every word and of every n-gram of UTF-8 bytes inside one text."""
    gram = (prefix.fixed(CHAR_N) >> np.uint64(64 - BITS)).astype(np.int32)
    gram_row = np.repeat(np.arange(len(at) - 1), np.diff(at))[:len(gram)]
    inside = np.arange(len(gram)) + CHAR_N <= at[gram_row + 1] if len(gram) else np.zeros(0, bool)
    return (word >> np.uint64(64 - BITS)).astype(np.int32), row, gram[inside], gram_row[inside]


def mean_weight(weights: np.ndarray, bins: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    total = np.bincount(row, weights=weights[bins], minlength=n)
    return total / np.maximum(np.bincount(row, minlength=n), 1)


def _sample_features(batches):
    for batch in batches:
        for first, stop, data, at in spans.slices(batch.column("text")):
            _, word, row, prefix = measures(data, at)
            w, wr, c, cr = features(prefix, at, word, row)
            keys, values = [], []
            for i in range(stop - first):
                rows = []
                for bins, of, shift in ((w, wr, 0), (c, cr, 1 << BITS)):
                    own, n = np.unique(bins[np.searchsorted(of, i):np.searchsorted(of, i, "right")], return_counts=True)
                    rows.append((own + shift, n / max(n.sum(), 1)))
                keys.append(np.concatenate([r[0] for r in rows]).astype(np.int32))
                values.append(np.concatenate([r[1] for r in rows]).astype(np.float32))
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id").slice(first, stop - first),
                "label": batch.column("label").slice(first, stop - first),
                "bins": pa.array([k.tobytes() for k in keys], pa.binary()),
                "shares": pa.array([v.tobytes() for v in values], pa.binary()),
            })


def fit_logistic(indptr: np.ndarray, bins: np.ndarray, shares: np.ndarray, y: np.ndarray, dims: int, steps: int = 80,
                 rate: float = 0.3, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Full-batch logistic regression on sparse rows with Adam steps; classes weigh the same."""
    row = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(indptr))
    scale = 30.0
    balance = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    w, b = np.zeros(dims), 0.0
    m, v, mb, vb = np.zeros(dims), np.zeros(dims), 0.0, 0.0
    x = shares * np.float32(scale)
    for step in range(1, steps + 1):
        z = np.bincount(row, weights=w[bins] * x, minlength=len(y)) + b
        r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance
        g = np.bincount(bins, weights=r[row] * x, minlength=dims) + penalty * w / len(y)
        gb = r.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        b -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-9)
    return w * scale, b


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's slope and intercept by Newton steps, with his softened targets."""
    target = np.where(y == 1, ((y == 1).sum() + 1) / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2))
    spread = max(float(np.std(z)), 1e-9)
    x, a, b = z / spread, 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r, h = p - target, np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(h * x * x).sum() + 1e-6, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, np.array([(r * x).sum() + 1e-6 * a, r.sum()]))
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return a / spread, b


def _fit(batches):
    table = pa.Table.from_batches(list(batches), schema=pa.schema([
        ("id", pa.int64()), ("label", pa.int32()), ("bins", pa.binary()), ("shares", pa.binary())]))
    table = table.sort_by("id")
    ids, y = table["id"].to_numpy(), table["label"].to_numpy().astype(float)
    bins = [np.frombuffer(b, np.int32) for b in table["bins"].to_pylist()]
    shares = [np.frombuffer(b, np.float32) for b in table["shares"].to_pylist()]
    with np.errstate(over="ignore"):
        fold = spans.mix(ids.astype(np.uint64)) % np.uint64(5)
    dims = 2 << BITS

    def packed(keep):
        return (np.concatenate([[0], np.cumsum([len(bins[i]) for i in keep])]),
                np.concatenate([bins[i] for i in keep]), np.concatenate([shares[i] for i in keep]), y[keep])

    train, held = np.flatnonzero(fold != 0), np.flatnonzero(fold == 0)
    if min(len(set(y[train])), len(set(y[held]))) < 2:
        return
    del table
    w, b = fit_logistic(*packed(train), dims)
    ptr, k, s, target = packed(held)
    z = np.bincount(np.repeat(np.arange(len(held)), np.diff(ptr)), weights=w[k] * s, minlength=len(held)) + b
    slope, intercept = calibrate(z, target)
    yield pa.RecordBatch.from_pydict({
        "weights": pa.array([w.astype(np.float32).tobytes()], pa.binary()),
        "slope": pa.array([slope]), "intercept": pa.array([intercept + slope * b])})


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, rows: int, key: str, text: str, allowed: Column | None = None) -> DataFrame:
    """(id, label, text) of about `rows` labelled documents, by hashed id. The chosen ids are bounded by `rows`, so they
    may be broadcast and the texts of the corpus stay where they are."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    if allowed is not None:
        known = known.where(allowed)
    known = known.groupBy(F.col(key).alias("id")).agg(F.max(label).cast("int").alias("label"))
    cut = min(1.0, rows / max(known.count(), 1))
    chosen = known.where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) < int(cut * (1 << 30)))
    return documents.select(F.col(key).alias("doc"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("doc") == F.col("id")) \
        .select(F.col("id").cast("long").alias("id"), "label", "text")


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text") -> Model | None:
    """Fit on the bounded sample, four fifths for the weights and one for the calibration. None without both classes."""
    sample = labelled_sample(documents, labels, label, rows, key, text)
    rows_ = sample.mapInArrow(_sample_features, "id long, label int, bins binary, shares binary")
    got = rows_.repartition(1).mapInArrow(_fit, "weights binary, slope double, intercept double").collect()
    if not got:
        return None
    w = np.frombuffer(got[0]["weights"], np.float32)
    return Model(w[:1 << BITS], w[1 << BITS:], got[0]["slope"], got[0]["intercept"])


def scorer(model: Model | None, threshold: float, text: str):
    def run(batches):
        for batch in batches:
            parts = []
            for first, stop, data, at in spans.slices(batch.column(text)):
                found, word, row, prefix = measures(data, at)
                n = stop - first
                failed = (found["n_words"] < 10) | (100 * found["n_repeat_words"] > 20 * found["n_words"])
                p = np.ones(n)
                if model is not None:
                    w, wr, c, cr = features(prefix, at, word, row)
                    z = mean_weight(model.word_weights, w, wr, n) + mean_weight(model.char_weights, c, cr, n)
                    p = 1 / (1 + np.exp(-np.clip(model.slope * z + model.intercept, -30, 30)))
                parts.append({**found, "base_failed": failed, "probability": p, "kept": ~failed & (p >= threshold)})
            new = {k: np.concatenate([x[k] for x in parts]) for k in parts[0]} if parts else None
            if new:
                columns = [batch.column(name) for name in batch.schema.names] + [pa.array(v) for v in new.values()]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *new])

    return run


def judge(documents: DataFrame, model: Model | None, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """Adds the measures, base_failed, probability (of good quality) and kept to every document.

    A document fails at fewer than 10 words, or where over a fifth of its words stand in
    5-word windows found twice in it. Others are kept from a calibrated probability of
    `threshold`; without a model (no labels of both kinds) all others are kept. Null or
    empty text has no words and fails. Whole texts are measured, in slices of a few MB of
    many texts or one longer text. Columns named like the added ones are replaced.
    """
    added = [*MEASURES, "base_failed", "probability", "kept"]
    given = documents.drop(*added)
    kinds = [T.LongType()] * len(MEASURES) + [T.BooleanType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([*given.schema.fields, *[T.StructField(n, k) for n, k in zip(added, kinds)]])
    return given.mapInArrow(scorer(model, threshold, text), schema)
