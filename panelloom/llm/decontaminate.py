"""Benchmark decontamination by a positional inverted index, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import ascii_lower, broadcast_if_small, digest_pair, text_of
from panelloom.session import stored

WINDOW = 13
# Beyond these row counts the small sides are shuffled instead of broadcast (about 32 MB each).
MOST_TERMS, MOST_WINDOWS = 500_000, 200_000
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of digits, a-z and anything beyond ASCII, A-Z lower-cased first."""
    return F.array_remove(F.split(ascii_lower(text), BETWEEN), "")


def row_key(key: str, text: str) -> list[Column]:
    """Names a row without numbering rows: its id and the digest of its text."""
    return [F.col(key).alias("id"), *[c.alias(f"t{i}") for i, c in enumerate(digest_pair(text_of(text)), 1)]]


@dataclass
class Index:
    """Windows of the items with their two rarest terms, and the training postings of those terms."""

    windows: DataFrame
    n_windows: int
    postings: DataFrame


def item_windows(benchmark: DataFrame, size: int, item: str, text: str) -> DataFrame:
    """(phrase, items): every run of `size` words; an item with fewer, but not none, is one window."""
    found = benchmark.select(F.col(item).alias("item"), words_of(text_of(text)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    return found.select("item", F.explode(F.transform(starts, lambda s: F.slice(F.col("words"), s, size))).alias("phrase")) \
        .groupBy("phrase").agg(F.collect_set("item").alias("items"))


def build_index(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, key: str = "doc_id", text: str = "text",
                item: str = "item_id", item_text: str = "text") -> Index:
    """Count the benchmark's terms in all training text, pick each window's two rarest, and store their postings.

    A posting is (row, position, the words around it), so that a phrase can be confirmed
    where it is found. Only terms some window needs are stored; common words are kept only
    where a window holds nothing rarer.
    """
    windows = stored(item_windows(benchmark, size, item, item_text).withColumn("window", F.xxhash64("phrase")), "windows")
    terms = windows.select(F.explode("phrase").alias("term")).distinct()
    n_terms, n_windows = terms.count(), windows.count()
    # Outer generators: for inner ones the optimiser adds a filter that splits every text a second time.
    counted = stored(documents.select(F.explode_outer(words_of(text_of(text))).alias("term")) \
        .join(broadcast_if_small(terms, n_terms, MOST_TERMS), "term").groupBy("term").agg(F.count("*").alias("n")), "term-counts")
    spread = windows.select("window", "phrase", F.posexplode("phrase").alias("offset", "term"))
    ranked = spread.join(counted, "term", "left").groupBy("window", "phrase").agg(
        F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offset"))), 1, 2).alias("rarest"))
    ranked = stored(ranked.where("rarest[0].n > 0").join(windows.select("window", "phrase", "items"), ["window", "phrase"]), "ranked")
    needed = ranked.select(F.explode("rarest.term").alias("term")).distinct()
    n_needed = needed.count()
    placed = documents.select(*row_key(key, text), words_of(text_of(text)).alias("words")).select(
        "*", F.posexplode_outer("words").alias("position", "term"))
    context = [F.least("position", F.lit(size - 1)).alias("before"),
               F.slice("words", F.greatest(F.col("position") - (size - 2), F.lit(1)), 2 * size - 1).alias("around")]
    keys = ["term", "id", "t1", "t2", "position"]
    if n_needed <= MOST_TERMS:
        around = placed.join(broadcast_if_small(needed, n_needed, MOST_TERMS), "term").select(*keys, *context)
    else:
        # A shuffle must carry a few words with each word, not its whole text.
        around = placed.where("term is not null").select(*keys, *context).join(needed, "term").select(*keys, "before", "around")
    return Index(ranked, n_windows, stored(around, "postings"))


def phrase_matches(index: Index) -> DataFrame:
    """(id, t1, t2, start, length, items) of every exact occurrence of a window.

    The list of the rarest term, moved back by its offset, is intersected with that of the
    second rarest; what is left is compared word by word.
    """
    near = []
    for i in (0, 1):
        term = F.coalesce(F.get("rarest", F.lit(i)), F.get("rarest", F.lit(0)))
        side = index.windows.select("window", "phrase", "items", term["term"].alias("term"), term["offset"].alias("offset"))
        near.append(index.postings.join(broadcast_if_small(side, index.n_windows, MOST_WINDOWS), "term")
                    .withColumn("start", F.col("position") - F.col("offset")).where("start >= 0"))
    exact = F.slice("around", F.col("before") - F.col("offset") + 1, F.size("phrase")) == F.col("phrase")
    first = near[0].where(F.col("before") >= F.col("offset")).where(exact)
    row = ["window", "id", "t1", "t2", "start"]
    second = near[1].select(*row)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) if c == "id" else F.col(f"a.{c}") == F.col(f"b.{c}") for c in row]
    met = first.alias("a").join(second.alias("b"), same[0] & same[1] & same[2] & same[3] & same[4], "left_semi")
    return met.select("id", "t1", "t2", "start", F.size("phrase").alias("length"), "items")


def proximity_matches(index: Index, least_share: float = 0.8) -> DataFrame:
    """Rows and positions where at least a share of a window's distinct words stand around its rarest term, in any order."""
    side = index.windows.select("window", "phrase", "items", F.col("rarest")[0]["term"].alias("term"))
    met = index.postings.join(broadcast_if_small(side, index.n_windows, MOST_WINDOWS), "term")
    share = F.size(F.array_intersect("phrase", "around")) / F.size(F.array_distinct("phrase"))
    return met.select("id", "t1", "t2", "position", "items", share.alias("share")).where(F.col("share") >= least_share)


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, key: str = "doc_id", text: str = "text",
                  item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: n_words, n_hit, item_ids and contaminated (hit words are at least a twentieth).

    A null or empty text has no words and is clean; an empty benchmark hits nothing. Rows
    sharing an id are judged each by its own text. No document text is shuffled: postings
    carry the few words a match needs. Extra columns are not read.
    """
    index = build_index(documents, benchmark, size, key, text, item, item_text)
    spans = phrase_matches(index).groupBy("id", "t1", "t2").agg(
        F.collect_set(F.struct("start", "length")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("item_ids"))
    hit = spans.select("id", "t1", "t2", "item_ids", F.size(F.array_distinct(F.flatten(F.transform(
        "spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))).cast("long").alias("n_hit"))
    counted = documents.select(*row_key(key, text), F.size(words_of(text_of(text))).cast("long").alias("n_words"))
    same = counted["id"].eqNullSafe(hit["id"]) & (counted["t1"] == hit["t1"]) & (counted["t2"] == hit["t2"])
    n_hit = F.coalesce("n_hit", F.lit(0))
    return counted.join(hit, same, "left").select(
        counted["id"], counted["t1"], counted["t2"], "n_words", n_hit.alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, list_slice(w, s, s + 12) AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(phrase) AS n FROM wins),
dw AS (
  SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, item_id, s, n FROM dw JOIN wins USING (phrase)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
