"""Phrases against plain counting, with nulls, odd characters, long texts, repeats and clashing columns."""

import random
import re
from collections import Counter, defaultdict

import pytest

from panelloom.llm import collocations

SCHEMA = "doc_id long, text string, lang string, prefix string, next string, a long, n long, seg int, phrase string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, longest=5, least=3, top=2000, subsumed=100):
    counts, sizes = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            sizes[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    counts[lang][tuple(words[i:i + m])] += 1
    out = []
    for lang, found in counts.items():
        frequent = {p: a for p, a in found.items() if a >= least}
        held = Counter()
        for p, a in frequent.items():
            for i in range(len(p)):
                for j in range(i + 1, len(p) + 1):
                    if j - i < len(p):
                        held[p[i:j]] = max(held[p[i:j]], a)
        rows_ = []
        for p, a in frequent.items():
            if len(p) < 2 or (p in held and 100 * held[p] >= subsumed * a):
                continue
            score, k = min((1000 * a * sizes[lang] // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, sizes[lang], -score))
    return sorted(out)


def given():
    rng = random.Random(3)
    words = ["the", "of", "new", "York", "city", "Ünï", "日本", "x\x1cy", "a", "b", "-", "it's", " ", "q\x00z"]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\r\n", "?!"]) for _ in range(rng.randrange(60)))
        if i % 4 == 0:
            text += " New york city of THE a " + "in the year of our " * (i % 7)
        rows.append((text, rng.choice(["en", "en", "de", None, "und", ""])))
    rows += [(None, "en"), ("", "en"), (" \t ", "en"), (".,;", "fr"), ("w" * 5000, "en"), ("a b " * 3000, "en"), ("y" * 3000 + " tail of the word " * 4, "de"), rows[4], rows[4]]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, t, g, "p", "n", 1, 2, 3, "f") for i, (t, g) in enumerate(rows)], SCHEMA).repartition(3)


def got(df, **more):
    return sorted(map(tuple, collocations.collocations(df, **more).collect()))


@pytest.mark.parametrize("chunk, words", [(1 << 20, 1 << 21), (37, 50), (400, 7)])
def test_collocations(spark, monkeypatch, chunk, words):
    """Whole texts, and texts cut into chunks and slices that end anywhere."""
    monkeypatch.setattr(collocations, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(collocations, "SLICE_WORDS", words)
    monkeypatch.setattr(collocations, "MERGE_ROWS", 20)
    monkeypatch.setattr(collocations, "LEAST_BUCKETS", 3)
    rows = given()
    found = got(table(spark, rows), least=3)
    assert found == plain(rows)
    assert len({r[0] for r in found}) >= 4 and max(len(r[2].split(" ")) for r in found) == 5


def test_top_rows_and_partial_subsumption(spark, monkeypatch):
    monkeypatch.setattr(collocations, "TOP_ROWS", 10)
    rows = given()
    assert got(table(spark, rows), least=2, top=6, subsumed=80) == plain(rows, least=2, top=6, subsumed=80)
    assert got(table(spark, rows), least=2, longest=3) == plain(rows, least=2, longest=3)


def test_a_filter_too_small_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "LEAST_BITS", 64)
    monkeypatch.setattr(collocations, "MOST_BITS", 64)
    rows = given()
    assert got(table(spark, rows), least=3) == plain(rows)


def test_a_hot_prefix_is_cut_into_segments(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SHARES", 5)
    rows = [(" ".join(f"hot n{j % 50}" for j in range(i, i + 40)), "en") for i in range(60)]
    assert got(table(spark, rows), least=3) == plain(rows)


def test_no_words(spark):
    assert got(table(spark, [])) == []
    assert got(table(spark, [(None, None), ("", "en")]), least=1) == []


def test_products_beyond_64_bits(spark):
    a, n, l, r = 10**15 + 7, 9 * 10**15 + 1, 10**15 + 9, 10**15 + 8
    df = spark.createDataFrame([(a, n, l, r), (100, 9 * 10**15, 100, 100)], "a long, n long, l long, r long").select(collocations.cut_score())
    assert [x[0] for x in df.collect()] == [1000 * a * n // (l * r), 1000 * 100 * 9 * 10**15 // 10**4]
