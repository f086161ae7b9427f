"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exception phrases."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.llm.quality import calibrate, labelled_sample

# About this many labelled rows, chosen by hashed id, are read to learn from: the one bound on what is learned.
SAMPLE_ROWS = 8000
# Terms are beginnings of words of so many letters, and whole words of any length.
SHORTEST, LONGEST = 4, 12

# Characters written for the letters they resemble, and digits and signs for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ӏ": "l", "ո": "n", "ս": "u",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ſ": "s",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}


class _Folding(dict):
    """Character to folded characters, worked out once for each character that occurs."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        low = unicodedata.normalize("NFKD", char.lower())
        base = "".join(HOMOGLYPHS.get(c, c) for c in low if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
        folded = "".join(c if c.isalnum() else " " for c in base)
        self[code] = folded
        return folded


_PLAIN = _Folding()
# One or more digits or signs between letters, one or two in front of a word, and digits behind one.
_INSIDE = re.compile(r"(?<=[^\W\d_])[0134578@$!9]+(?=[^\W\d_])|(?<![^\W_])[0134578@$9]{1,2}(?=[^\W\d_])|(?<=[^\W\d_])[0134578@9]+(?![^\W_])")


def fold(text: str) -> str:
    """Lower-case words between single blanks: accents, invisible characters and homoglyphs folded to plain letters,
    digits and signs next to letters read as the letters they stand for, every other sign a blank."""
    if _SUBSTITUTED.search(text):
        text = _INSIDE.sub(lambda m: "".join(SUBSTITUTES[c] for c in m[0]), text)
    return f" {' '.join(text.translate(_PLAIN).split())} "


_SUBSTITUTED = re.compile(r"[0134578@$!9][^\W\d_]|[^\W\d_][0134578@9]")


@dataclass(frozen=True)
class Lexicon:
    """Word beginnings with weights, phrases that excuse a match inside them, and the curve from density to score."""

    terms: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, float, float] = (-3.0, 1.0, 1.0)
    automaton: list = field(default_factory=list, compare=False)

    def matcher(self):
        if not self.automaton:
            import ahocorasick

            found = ahocorasick.Automaton()
            for term, weight in self.terms.items():
                found.add_word(" " + term, (len(term), weight, ""))
            for phrase in self.exceptions:
                found.add_word(f" {phrase} ", (len(phrase), 0.0, phrase))
            if len(found):
                found.make_automaton()
            self.automaton.append(found)
        return self.automaton[0]

    def __getstate__(self):
        return {"terms": self.terms, "exceptions": self.exceptions, "curve": self.curve, "automaton": []}

    def __setstate__(self, state):
        for k, v in state.items():
            object.__setattr__(self, k, v)


def matches(lexicon: Lexicon, folded: str) -> list[tuple[int, int, float]]:
    """(start, end, weight) of lexicon entries: per word the heaviest one, none inside an exception phrase."""
    automaton = lexicon.matcher()
    if not len(automaton):
        return []
    best: dict[int, tuple[int, float]] = {}
    excused: list[tuple[int, int]] = []
    for end, (length, weight, phrase) in automaton.iter(folded):
        if phrase:
            excused.append((end - length, end))
        else:
            start = end - length + 1
            if start not in best or weight > best[start][1]:
                best[start] = (end + 1, weight)
    found = [(s, e, w) for s, (e, w) in sorted(best.items())]
    if excused:
        inside = set()
        for a, b in excused:
            inside.update(range(a, b))
        found = [m for m in found if m[0] not in inside]
    return found


def measure(lexicon: Lexicon, folded: str) -> tuple[float, int, int]:
    """Summed weight of the matches, their number, and the number of words."""
    found = matches(lexicon, folded)
    return sum(w for _, _, w in found), len(found), max(folded.count(" ") - 1, 0)


def inputs(weight: float, words: int) -> tuple[float, float]:
    """What the curve reads: the logarithms of weight per hundred words and of the weight itself."""
    return math.log1p(100.0 * weight / (words + 10.0)), math.log1p(weight)


def score_of(lexicon: Lexicon, folded: str) -> float:
    weight, _, words = measure(lexicon, folded)
    a, b, c = lexicon.curve
    x, y = inputs(weight, words)
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def _folded(texts: pa.Array):
    for value in texts:
        yield fold(value.as_py() or "")


def _beginnings(batches):
    """Per batch: in how many toxic and other sample texts each word beginning occurs."""
    for batch in batches:
        toxic, other = Counter(), Counter()
        n = [0, 0]
        for label, folded in zip(batch.column("label").to_pylist(), _folded(batch.column("text"))):
            seen = set()
            for word in set(folded.split()):
                if len(word) >= SHORTEST:
                    seen.update(word[:k] for k in range(SHORTEST, min(len(word), LONGEST) + 1))
                    seen.add(word)
            (toxic if label else other).update(seen)
            n[label] += 1
        names = list(toxic)
        yield pa.RecordBatch.from_pydict({
            "term": [*names, ""], "toxic": pa.array([*[toxic[t] for t in names], n[1]], pa.int64()),
            "other": pa.array([*[0 for t in names], n[0]], pa.int64())})
        rest = list(other)
        yield pa.RecordBatch.from_pydict({
            "term": pa.array(rest, pa.string()), "toxic": pa.array([0] * len(rest), pa.int64()),
            "other": pa.array([other[t] for t in rest], pa.int64())})


def _contexts(lexicon: Lexicon):
    """Two-word phrases around matches, with the label of their text; and each text's measures."""

    def run(batches):
        for batch in batches:
            rows = []
            for label, folded in zip(batch.column("label").to_pylist(), _folded(batch.column("text"))):
                weight, _, words = measure(lexicon, folded)
                phrases = set()
                for start, end, _ in matches(lexicon, folded):
                    stop = folded.index(" ", start)
                    word = folded[start:stop]
                    if start > 1:
                        phrases.add(f"{folded[folded.rindex(' ', 0, start - 1) + 1:start - 1]} {word}")
                    if stop + 1 < len(folded):
                        phrases.add(f"{word} {folded[stop + 1:folded.index(' ', stop + 1)]}")
                rows.append((label, weight, words, sorted(phrases)))
            yield pa.RecordBatch.from_pydict({
                "label": pa.array([r[0] for r in rows], pa.int32()), "weight": pa.array([r[1] for r in rows], pa.float64()),
                "words": pa.array([r[2] for r in rows], pa.int64()), "phrases": pa.array([r[3] for r in rows], pa.list_(pa.string()))})

    return run


def choose_terms(counts: list, n_toxic: int, n_other: int) -> dict[str, float]:
    """Beginnings far likelier in toxic texts, weighted by their log odds; a longer one only where it is clearly purer than a kept shorter one."""
    rated = []
    for term, a, b in counts:
        odds = math.log((a + 0.5) / (n_toxic - a + 0.5)) - math.log((b + 0.5) / (n_other - b + 0.5))
        error = math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        rated.append((odds - 2.0 * error, odds, term))
    kept: dict[str, float] = {}
    sure: dict[str, float] = {}
    for low, odds, term in sorted(rated, key=lambda r: (len(r[2]), -r[0], r[2])):
        above = max((sure[term[:k]] for k in range(SHORTEST, min(len(term) - 1, LONGEST) + 1) if term[:k] in sure), default=0.0)
        if low > max(0.7, above + 0.3):
            sure[term], kept[term] = low, odds
    return {t: round(kept[t], 6) for t in sorted(kept)}


def learn(documents: DataFrame, labels: DataFrame, allowed: Column | None = None, label: str = "toxic", rows: int = SAMPLE_ROWS,
          key: str = "doc_id", text: str = "text") -> Lexicon:
    """Lexicon, exception phrases and curve from a bounded sample of the labels that `allowed` lets through.

    Every term and phrase with enough evidence in the sample is kept; there are no more of them
    than its texts hold, and only those come back to the driver. Ties are kept or dropped together.
    Without toxic or without other labels, as in an empty table, the lexicon is empty and every
    score is low and equal. Repeated ids count once per row of the documents.
    """
    sample = labelled_sample(documents, labels, label, rows, key, text, allowed)
    counted = sample.mapInArrow(_beginnings, "term string, toxic long, other long").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    total = counted.where("term = ''").first()
    if total is None or not total["toxic"] or not total["other"]:
        return Lexicon({})
    lift = (F.col("toxic") + 0.5) / F.lit(float(total["toxic"])) / ((F.col("other") + 0.5) / F.lit(float(total["other"])))
    likely = counted.where("term <> '' and toxic >= 4").where(lift > 2)
    lexicon = Lexicon(choose_terms([tuple(r) for r in likely.collect()], total["toxic"], total["other"]))
    seen = sample.mapInArrow(_contexts(lexicon), "label int, weight double, words long, phrases array<string>")
    phrases = seen.select("label", F.explode("phrases").alias("phrase")).groupBy("phrase").agg(
        F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("other"))
    innocent = phrases.where("toxic = 0 and other >= 5").collect()
    lexicon = Lexicon(lexicon.terms, frozenset(r["phrase"] for r in innocent))
    points = np.array([(r["label"], *inputs(r["weight"], r["words"])) for r in sample.mapInArrow(
        _contexts(lexicon), "label int, weight double, words long, phrases array<string>").select("label", "weight", "words").collect()])
    return Lexicon(lexicon.terms, lexicon.exceptions, fit_curve(points))


def fit_curve(points: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression on the two inputs by damped Newton steps."""
    points = points[np.lexsort(points.T)]
    y, x = points[:, 0], np.column_stack([np.ones(len(points)), points[:, 1:]])
    w = np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag([1e-6, 1e-2, 1e-2])
        g = x.T @ (p - y) + np.array([0, 1e-2, 1e-2]) * w
        w -= np.clip(np.linalg.solve(h, g), -3, 3)
    return tuple(float(v) for v in w)


def score(documents: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """Adds score (0 to 1), n_matches and matched_weight to every document (columns so named are replaced).

    Whole texts are folded and matched, one at a time; a long one takes a few times its own size.
    Null or empty text has no match and gets the score of a text without one. Every row keeps
    its own score, repeated ones too; an empty table gives no rows.
    """
    added = [("score", T.DoubleType()), ("n_matches", T.LongType()), ("matched_weight", T.DoubleType())]
    given = documents.drop(*[n for n, _ in added])

    def run(batches):
        for batch in batches:
            rows = []
            for folded in _folded(batch.column(text)):
                weight, n, words = measure(lexicon, folded)
                a, b, c = lexicon.curve
                x, y = inputs(weight, words)
                rows.append((1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y)))), n, float(weight)))
            new = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.float64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in batch.schema.names], *new],
                                             names=[*batch.schema.names, *[n for n, _ in added]])

    schema = T.StructType([*given.schema.fields, *[T.StructField(n, k) for n, k in added]])
    return given.mapInArrow(run, schema)
