"""Frequent phrases and how strongly they hold together, counted in stripes: prefix -> counter of next words.

One pass over the texts for each phrase length. A task counts its slice of the texts into stripes; stripes of one
prefix are merged elementwise; entries that reach the least count are the phrases of that length. A phrase of m words
can only be frequent where both its (m-1)-word ends are, so the next pass keeps stripes only for words whose ends are in
a bit filter of the frequent phrases before it. The filter has a bounded size and may let too much through, never too
little: counts are exact and the least count is applied to the merged stripes.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm import spans
from panelloom.session import stored

U64 = np.uint64
BREAKS = b".,;:!?\n\x0b\x0c\r"
# A-Z lower-cased, piece ends as a dot, tabs as blanks: what is left splits at blanks.
PLAIN = bytes.maketrans(bytes(range(65, 91)) + BREAKS + b"\t", bytes(range(97, 123)) + b"." * len(BREAKS) + b" ")
CHUNK_BYTES = 1 << 20
SLICE_WORDS = 1 << 21
LEAST_BITS, MOST_BITS = 1 << 13, 1 << 28
# A prefix with over a thousandth of all words is cut into a segment for each thousandth.
SHARES = 1000
# Bytes of text for each bucket of stripes, and for each segment of the stripe of single words.
BUCKET_BYTES, LEAST_BUCKETS = 1 << 25, 64
MERGE_ROWS = 1 << 20
TOP_ROWS = 1 << 17
NO_WORD = 0

STRIPES = "bucket int, pack binary"
PHRASES = "lang string, prefix string, next string, a long"


def chunks(text: bytes):
    """The plain form of a text in runs of about `CHUNK_BYTES`, cut where a word ends."""
    plain = text.translate(PLAIN)
    at = 0
    while len(plain) - at > CHUNK_BYTES:
        cut = max(plain.rfind(b" ", at, at + CHUNK_BYTES), plain.rfind(b".", at, at + CHUNK_BYTES))
        if cut <= at:
            later = [x for x in (plain.find(b" ", at + CHUNK_BYTES), plain.find(b".", at + CHUNK_BYTES)) if x >= 0]
            if not later:
                break
            cut = min(later)
        yield plain[at:cut]
        at = cut
    yield plain[at:]


class Slice:
    """Words of some texts as numbers; `NO_WORD` stands between pieces and texts."""

    def __init__(self):
        self.code = defaultdict(lambda: len(self.code))
        self.code[b"."] = NO_WORD
        self.parts, self.langs, self.held = [], [], 0

    def add(self, plain: bytes, lang: int) -> None:
        words = plain.replace(b".", b" . ").split()
        self.put(np.fromiter(map(self.code.__getitem__, words), np.int64, len(words)), lang)

    def put(self, ids: np.ndarray, lang: int) -> None:
        self.parts.append(ids)
        self.langs.append(lang)
        self.held += len(ids)

    def words(self) -> list[bytes]:
        return list(self.code)

    def tail(self, n: int) -> list[bytes]:
        """The last n words, which a text continued in the next slice still needs."""
        last, words = [], self.words()
        for ids in reversed(self.parts):
            if len(last) >= n:
                break
            last = [*ids[-n:].tolist(), *last]
        return [words[i] for i in last[max(0, len(last) - n):]]


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))


def extend(value: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase with one more word."""
    with np.errstate(over="ignore"):
        return spans.mix(value * U64(spans.BASE) + word)


def probes(value: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = U64(bits - 1)
    return value & mask, (value >> U64(32)) & mask


class Filter:
    """Bits of the hashes of frequent phrases."""

    def __init__(self, words: np.ndarray):
        self.words, self.bits = words, len(words) * 64

    def holds(self, value: np.ndarray) -> np.ndarray:
        found = np.ones(len(value), bool)
        for at in probes(value, self.bits):
            found &= ((self.words[at >> U64(6)] >> (at & U64(63))) & U64(1)).astype(bool)
        return found


def counted(part: Slice, names: list[str], length: int, filtered: Filter | None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(columns of word numbers, lang numbers, counts, hashes of words): the distinct phrases of a slice, sorted."""
    ids = np.concatenate([np.zeros(0, np.int64), *part.parts])
    lang = np.repeat(np.array(part.langs, np.int64), [len(p) for p in part.parts]) if part.parts else ids
    word = hashes(part.words())
    n = len(ids) - length + 1
    if n <= 0:
        return [ids[:0]] * length, ids[:0], ids[:0], word
    inside = np.ones(n, bool)
    for i in range(length):
        inside &= ids[i:i + n] != NO_WORD
    at = np.flatnonzero(inside)
    if filtered is not None:
        seed = hashes([x.encode() for x in names])
        for first in (0, 1):
            value = seed[lang[at]]
            for i in range(length - 1):
                value = extend(value, word[ids[at + first + i]])
            at = at[filtered.holds(value)]
    columns = [ids[at + i] for i in range(length)]
    order = np.lexsort([*columns[::-1], lang[at]])
    columns, lang = [c[order] for c in columns], lang[at][order]
    start = np.flatnonzero(spans.equal_runs(lang, *columns)) if len(at) else at
    return [c[start] for c in columns], lang[start], np.diff(np.concatenate([start, [len(at)]])), word


def stripes(part: Slice, names: list[str], length: int, filtered: Filter | None, segments, buckets: int):
    """The stripes of a slice, those of a bucket packed into one row. `segments(lang, prefix)` tells how many a prefix has."""
    columns, lang, n, word = counted(part, names, length, filtered)
    if not len(n):
        return
    text = pa.array(part.words(), pa.binary()).cast(pa.string())
    first = np.flatnonzero(spans.equal_runs(lang, *columns[:-1]))
    take = lambda ids: text.take(pa.array(ids))
    prefix = pc.binary_join_element_wise(*[take(c[first]) for c in columns[:-1]], " ") if length > 1 else pa.array([""] * len(first))
    own = np.cumsum(spans.equal_runs(lang, *columns[:-1])) - 1
    many = np.fromiter((segments(names[i], p) for i, p in zip(lang[first], prefix.to_pylist())), np.int64, len(first))
    seg = (word[columns[-1]] % many[own].astype(U64)).astype(np.int64)
    value = hashes([x.encode() for x in names])[lang[first]]
    for c in columns[:-1]:
        value = extend(value, word[c[first]])
    bucket = (extend(value[own], seg.astype(U64)) % U64(buckets)).astype(np.int64)
    order = np.lexsort((seg, own, bucket))
    own, seg, n, nexts, bucket = own[order], seg[order], n[order], columns[-1][order], bucket[order]
    start = np.flatnonzero(spans.equal_runs(own, seg))
    offsets = pa.array(np.concatenate([start, [len(n)]]).astype(np.int32))
    rows = pa.RecordBatch.from_arrays([
        pa.array(names, pa.string()).take(pa.array(lang[first][own[start]])), prefix.take(pa.array(own[start])), pa.array(seg[start].astype(np.int32)),
        pa.ListArray.from_arrays(offsets, take(nexts)), pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int32)))],
        names=["lang", "prefix", "seg", "nexts", "counts"])
    edge = np.flatnonzero(spans.equal_runs(bucket[start]))
    sizes = np.diff(np.concatenate([edge, [len(start)]]))
    packs = [packed_rows(rows.slice(x, k)) for x, k in zip(edge.tolist(), sizes.tolist())]
    yield pa.RecordBatch.from_arrays([pa.array(bucket[start][edge].astype(np.int32)), pa.array(packs, pa.binary())], names=["bucket", "pack"])


def packed_rows(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _count(length: int, filter_, segments, buckets: int):
    """Stripes of every slice of the texts."""

    def run(batches):
        filtered = Filter(np.frombuffer(filter_.value, U64)) if filter_ is not None else None
        part, names = Slice(), {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                number = names.setdefault(lang, len(names))
                for plain in chunks(text):
                    part.add(plain, number)
                    if part.held >= SLICE_WORDS:
                        yield from stripes(part, list(names), length, filtered, segments, buckets)
                        tail, part = part.tail(length - 1), Slice()
                        # The last words go on: phrases that begin in them and end in what follows are still to be counted.
                        part.put(np.array([part.code[w] for w in tail], np.int64), number)
                part.put(np.array([NO_WORD]), number)
        yield from stripes(part, list(names), length, filtered, segments, buckets)

    return run


KEYS = ["lang", "prefix", "seg"]


def added(tables: list[pa.Table]) -> pa.Table:
    """Stripes merged elementwise: one row for each prefix, segment and next word."""
    return pa.concat_tables(tables).group_by([*KEYS, "next"]).aggregate([("n", "sum")]).rename_columns([*KEYS, "next", "n"])


def _merge(least: int, totals: bool):
    """Add up the stripes of each bucket, which come sorted by bucket; entries that reach `least`, and each segment's total if asked for."""

    def out(tables: list[pa.Table]):
        table = added(tables)
        kept = table.filter(pc.greater_equal(table.column("n"), least)).select(["lang", "prefix", "next", "n"])
        if totals:
            whole = table.group_by(KEYS).aggregate([("n", "sum")])
            kept = pa.concat_tables([kept, pa.table({"lang": whole.column("lang"), "prefix": whole.column("prefix"), "next": pa.nulls(whole.num_rows, pa.string()), "n": whole.column("n_sum")})])
        yield from kept.rename_columns(["lang", "prefix", "next", "a"]).to_batches()

    def run(batches):
        held, rows, bucket = [], 0, None
        for batch in batches:
            for own, pack in zip(batch.column("bucket").to_pylist(), batch.column("pack")):
                if held and own != bucket:
                    yield from out(held)
                    held, rows = [], 0
                bucket = own
                for given in pa.ipc.open_stream(pack.as_buffer()):
                    parent = pc.list_parent_indices(given.column("nexts"))
                    held.append(pa.table({**{k: given.column(k).take(parent) for k in KEYS}, "next": given.column("nexts").flatten(),
                                          "n": given.column("counts").flatten().cast(pa.int64())}))
                    rows += held[-1].num_rows
                if rows > MERGE_ROWS and len(held) > 1:
                    held = [added(held)]
                    rows = 0  # Of what was added since the last merge.
        if held:
            yield from out(held)

    return run


def _filter_bits(bits: int):
    def run(batches):
        for batch in batches:
            seed = hashes([x.encode() for x in batch.column("lang").to_pylist()])
            phrases = [p.split(b" ") for p in batch.column("phrase").cast(pa.binary()).to_pylist()]
            if not phrases:
                continue
            value = seed
            for i in range(len(phrases[0])):
                value = extend(value, hashes([p[i] for p in phrases]))
            at = np.concatenate(probes(value, bits))
            words, own = np.unique(at >> U64(6), return_inverse=True)
            values = np.zeros(len(words), U64)
            np.bitwise_or.at(values, own, U64(1) << (at & U64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(values.view(np.int64))], names=["word", "bits"])

    return run


def filter_of(phrases: DataFrame, rows: int) -> bytes:
    """The bits of frequent phrases of one length: ten for each, between stated bounds."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << math.ceil(math.log2(max(1, 10 * rows)))))
    found = phrases.mapInArrow(_filter_bits(bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return words.tobytes()


def frequent_phrases(documents: DataFrame, text: str = "text", lang: str = "lang", longest: int = 5, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """((lang, prefix, next, phrase, m, a) of every phrase of up to `longest` words that occurs `least` times, (lang, n) of all words)."""
    given = documents.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spark = documents.sparkSession
    size = given.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, math.ceil(size / BUCKET_BYTES))
    levels, sizes, filter_ = [], None, None
    segments = lambda lang, prefix: buckets
    for m in range(1, longest + 1):
        merged = given.mapInArrow(_count(m, filter_, segments, buckets), STRIPES).repartition("bucket") \
            .sortWithinPartitions("bucket").mapInArrow(_merge(least, m == 1), PHRASES)
        merged = stored(merged, f"phrases-{m}")
        if m == 1:
            sizes = stored(merged.where("next is null").groupBy("lang").agg(F.sum("a").alias("n")), "word-counts")
            total = sizes.agg(F.sum("n")).first()[0] or 0
        level = merged.where("next is not null").select(
            "*", (F.col("next") if m == 1 else F.concat_ws(" ", "prefix", "next")).alias("phrase"), F.lit(m).alias("m"))
        levels.append(level)
        rows = level.count()
        if not rows or m == longest:
            break
        filter_ = spark.sparkContext.broadcast(filter_of(level, rows))
        # At most `SHARES` prefixes of one length can hold over one part in `SHARES` of all words.
        share = total // SHARES + 1
        hot = {(r["lang"], r["phrase"]): r["a"] // share + 1 for r in level.where(F.col("a") > share).select("lang", "phrase", "a").collect()}
        segments = lambda lang, prefix, hot=hot: hot.get((lang, prefix), 1)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out, sizes


def cut_score() -> Column:
    """floor(1000 a n / (l r)) without rounding; the products have up to 38 digits."""
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    return F.expr(f"(cast(1000 as decimal(4, 0)) * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})")


def collocations(
    documents: DataFrame, text: str = "text", lang: str = "lang", longest: int = 5, least: int = 100, top: int = 2000, subsumed: int = 100,
) -> DataFrame:
    """The `top` phrases of two to `longest` words of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), split into pieces at `.,;:!?` and line ends, pieces into words at blanks and tabs. a is the
    number of places of the phrase, n that of all words of the language. A phrase cut after its first words has
    l and r places of its two sides and the score floor(1000 a n / (l r)); the cut of the lowest score counts, the
    earlier of equal ones. Phrases of at least `least` places are ranked by score, then a, then text, unless
    a longer one that holds them reaches `subsumed` percent of their places. Null text is empty, null language is `und`.
    Rows count each by itself, repeated or not. Very long texts are read in chunks, with a few words carried over.
    Columns other than the two named are not read. A table without words gives no rows.
    """
    phrases, sizes = frequent_phrases(documents, text, lang, longest, least)
    # A longer phrase that holds this one holds one with a word more on either side, which is at least as frequent.
    longer = phrases.where("m >= 3")
    after = F.expr("substr(phrase, locate(' ', phrase) + 1)")
    held = longer.select("lang", F.col("prefix").alias("phrase"), "a").unionByName(longer.select("lang", after.alias("phrase"), "a")) \
        .groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    candidates = phrases.where("m >= 2").select("lang", "phrase", "m", "a").join(held, ["lang", "phrase"], "left") \
        .where(F.col("longest").isNull() | (100 * F.col("longest") < subsumed * F.col("a"))).drop("longest")
    cut = candidates.withColumn("k", F.explode(F.expr("sequence(1, m - 1)"))).withColumn("first", F.expr("substring_index(phrase, ' ', k)")) \
        .withColumn("rest", F.expr("substr(phrase, length(first) + 2)"))
    counts = phrases.select("lang", "phrase", "a")
    sides = cut.join(counts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"]) \
        .join(counts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"]).join(sizes, "lang")
    scored = sides.withColumn("score", cut_score())
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("cut")).select("lang", "phrase", "cut.*")
    lowest = stored(lowest, "scored-phrases")
    # First within parts of the language, so that no task ranks a language whole.
    parts = max(1, math.ceil(lowest.count() / TOP_ROWS))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = lowest.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts))).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(
        F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\n\x0b\x0c\r]')) AS piece FROM documents
), words AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT lang, w[i:i + m - 1] AS p, m FROM starts, (SELECT unnest(range(1, 6)) AS m) WHERE i + m - 1 <= len(w)),
phrases AS (SELECT lang, array_to_string(p, ' ') AS phrase, m, any_value(p) AS p, count(*) AS a FROM grams GROUP BY lang, phrase, m HAVING count(*) >= 100),
held AS (
  SELECT lang, phrase, max(a) AS longest FROM (
    SELECT lang, array_to_string(p[i:i + s - 1], ' ') AS phrase, a FROM phrases, (SELECT unnest(range(1, 6)) AS i), (SELECT unnest(range(2, 5)) AS s) WHERE s < m AND i + s - 1 <= m
  ) GROUP BY lang, phrase
), candidates AS (SELECT c.* FROM phrases c LEFT JOIN held USING (lang, phrase) WHERE m >= 2 AND (longest IS NULL OR 100 * longest < 100 * a)),
cuts AS (
  SELECT c.lang, c.phrase, k, c.a, x.a AS l, y.a AS r, n, (1000 * c.a::HUGEINT * n::HUGEINT) // (x.a::HUGEINT * y.a::HUGEINT) AS score
  FROM candidates c JOIN (SELECT unnest(range(1, 5)) AS k) ON k < c.m
  JOIN phrases x ON x.lang = c.lang AND x.phrase = array_to_string(c.p[1:k], ' ') JOIN phrases y ON y.lang = c.lang AND y.phrase = array_to_string(c.p[k + 1:], ' ')
  JOIN sizes ON sizes.lang = c.lang
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM cuts QUALIFY rank <= 2000
"""
