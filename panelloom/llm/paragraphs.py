"""Paragraph deduplication: MinHash bands find colliding paragraphs, exact Jaccard verifies, components say what goes.

Paragraphs are lines. A passage repeated inside paragraphs that differ otherwise is found by
pieces: runs of `PIECE` words that begin at content-defined places. A passage of more than 50
words always holds such a place with a whole piece behind it, wherever it stands.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm import packed, spans
from panelloom.llm.common import broadcast_if_small, components
from panelloom.llm.sigtree import PART_MEMBERS, _edge_batches, bitmap, distinct_sets, forest, groups_of, meet, minhash_keys
from panelloom.llm.substrings import as_spark, lowest, settle_windows, unite
from panelloom.session import stored

LEAST_WORDS = 20
THRESHOLD = 0.8
RECALL = 0.999
# 27 starts + 24 words = 51: each passage of 51 words holds a chosen start and the piece behind it.
PIECE, STARTS = 24, 27
BUCKET_KEYS = 1 << 20
MOST_PARAGRAPHS = 2_000_000


def tune_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 12) -> tuple[int, int]:
    """(bands, rows): the longest bands, and so the fewest chance collisions, that still reach the recall at the threshold
    with at most `most` keys a paragraph."""
    best = (most, 1)
    for rows in range(1, 9):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands <= most:
            best = (bands, rows)
    return best


def lines_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of all lines, text of each): a line ends after its newline or with its text."""
    edge = np.unique(np.concatenate([at, np.flatnonzero(data == 10) + 1]))
    return edge, np.searchsorted(at, edge[:-1], "right") - 1


def _paragraphs(bands: int, rows: int, least: int, sets: bool):
    """One row per paragraph of enough words: document, first word, size, set digest, and its keys or its shingles."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for first, stop, data, at in spans.slices(batch.column("text")):
                starts, _, row = spans.words(data, at)
                if not len(starts):
                    continue
                edge, own = lines_of(data, at)
                before = np.searchsorted(starts, edge)
                n_words = np.diff(before)
                value, place = distinct_sets(data, edge)
                chosen = np.flatnonzero(n_words >= least)
                if not len(chosen):
                    continue
                with np.errstate(over="ignore"):
                    digest = np.add.reduceat(np.concatenate([value, np.zeros(1, np.uint64)]), np.minimum(place[:-1], len(value)))[chosen]
                doc_first = np.searchsorted(starts, at)
                shape = [pa.array(ids[first:stop][own[chosen]]), pa.array(before[chosen] - doc_first[own[chosen]]), pa.array(n_words[chosen]),
                         pa.array(np.diff(place)[chosen]), pa.array(digest.view(np.int64))]
                if sets:
                    taken = np.concatenate([value[place[c]:place[c + 1]] for c in chosen]).view(np.int64)
                    last = packed.list_column(taken, np.diff(place)[chosen])
                else:
                    last = pa.array([k.tobytes() for k in _keys_of(value, place, chosen, bands, rows)], pa.binary())
                yield pa.RecordBatch.from_arrays([*shape, last], names=["doc_id", "first_word", "n_words", "n_shingles", "node", "shingles" if sets else "keys"])

    return run


def _keys_of(value, place, chosen, bands, rows):
    """Keys of the chosen lines only: their sets are put side by side first."""
    size = np.diff(place)[chosen]
    own = np.concatenate([value[place[c]:place[c + 1]] for c in chosen])
    return minhash_keys(own, np.concatenate([[0], np.cumsum(size)]), np.arange(len(chosen)), bands, rows)


def _deal(buckets: int, bands: int):
    schema = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary())])

    def run(batches):
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.uint64)
            ids = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), bands)
            rows = [{"bucket": b, "keys": p["keys"].tobytes(), "ids": p["ids"].tobytes()}
                    for b, p in packed.runs_by((keys % np.uint64(buckets)).astype(np.int64), {"keys": keys, "ids": ids})]
            if rows:
                yield packed.batch(rows, schema)

    return run


def _collisions(table: pa.Table) -> pa.Table:
    """Pairs of distinct paragraphs that share a key: each with the first and with the next of its key's members. Of up
    to three members that is every pair; larger keys whose members this leaves apart are looked at again."""
    keys = np.concatenate([np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()])
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in table["ids"].to_pylist()])
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    begin = np.flatnonzero(spans.equal_runs(keys))
    center = ids[begin][np.cumsum(spans.equal_runs(keys)) - 1]
    same = np.zeros(len(keys), bool)
    same[1:] = keys[1:] == keys[:-1]
    before = np.concatenate([ids[:1], ids[:-1]])
    a, b = np.concatenate([center[same], before[same]]), np.concatenate([ids[same], ids[same]])
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = (a != b) & spans.equal_runs(a, b) if len(a) else np.zeros(0, bool)
    return pa.table({"a": pa.array(a[keep]), "b": pa.array(b[keep])})


def _deal_grouped(buckets: int, bands: int):
    schema = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in ("keys", "ids", "groups")]])

    def run(batches):
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.uint64)
            ids, groups = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), bands) for c in ("node", "known"))
            rows = [{"bucket": b, **{k: v.tobytes() for k, v in p.items()}}
                    for b, p in packed.runs_by((keys % np.uint64(buckets)).astype(np.int64), {"keys": keys, "ids": ids, "groups": groups})]
            if rows:
                yield packed.batch(rows, schema)

    return run


def _mixed(table: pa.Table) -> pa.Table:
    """(block, size, node, known) of keys with members that are still in different groups; a block is named by its members."""
    keys = np.concatenate([np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()])
    ids, groups = (np.concatenate([np.frombuffer(x, np.int64) for x in table[c].to_pylist()]) for c in ("ids", "groups"))
    order = np.lexsort((ids, keys))
    keys, ids, groups = keys[order], ids[order], groups[order]
    first = spans.equal_runs(keys)
    begin, own = np.flatnonzero(first), np.cumsum(first) - 1
    size = np.bincount(own)
    # Three members or fewer have met in pairs.
    open_ = (size > 3) & (np.minimum.reduceat(groups, begin) != np.maximum.reduceat(groups, begin))
    with np.errstate(over="ignore"):
        name = np.add.reduceat(spans.mix(ids.astype(np.uint64)), begin).view(np.int64)
    some = open_[own]
    return pa.table({"block": pa.array(name[own][some]), "size": pa.array(size[own][some].astype(np.int64)),
                     "node": pa.array(ids[some]), "known": pa.array(groups[some])})


def _linked(link: tuple[int, int]):
    """Links between the groups of a block, or of two parts of one: every pair is compared that no link joins already."""

    def run(batches):
        def edges():
            for table in groups_of(batches, ["block", "part"]):
                node, lists = table["node"].to_numpy(), table["shingles"].combine_chunks()
                known = np.unique(table["known"].to_numpy(), return_inverse=True)[1]
                if known.max() == 0:
                    continue
                at, values = np.asarray(lists.offsets), np.asarray(lists.values).view(np.uint64)
                sets = [values[a:b] for a, b in zip(at, at[1:])]
                for x, y in forest(np.diff(at).astype(np.int64), np.stack([bitmap(s) for s in sets]), sets, known, link):
                    yield node[x], node[y]

        yield from _edge_batches(edges())

    return run


def repeated_paragraphs(documents: DataFrame, least: int = LEAST_WORDS, threshold: float = THRESHOLD, recall: float = RECALL,
                        key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, first_word, n_words, kept_doc_id, component_id) of every paragraph that a group's first paragraph replaces."""
    bands, rows = tune_bands(threshold, recall)
    given = documents.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = stored(given.mapInArrow(_paragraphs(bands, rows, least, False),
                                    "doc_id long, first_word long, n_words long, n_shingles long, node long, keys binary"), "paragraphs")
    nodes = stored(found.groupBy("node").agg(F.min("keys").alias("keys"), F.min(F.struct("doc_id", "first_word")).alias("first"),
                                             F.count("*").alias("n")), "paragraph-sets")
    buckets = max(16, nodes.count() * bands // BUCKET_KEYS)
    pairs = nodes.select("node", "keys").mapInArrow(_deal(buckets, bands), "bucket int, keys binary, ids binary") \
        .groupBy("bucket").applyInArrow(_collisions, "a long, b long")
    pairs = stored(pairs.distinct(), "colliding")
    wanted = stored(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "wanted")
    sets = given.mapInArrow(_paragraphs(bands, rows, least, True),
                            "doc_id long, first_word long, n_words long, n_shingles long, node long, shingles array<long>")
    sets = stored(sets.join(broadcast_if_small(wanted, wanted.count(), MOST_PARAGRAPHS), "node").groupBy("node").agg(
        F.any_value("shingles").alias("shingles")), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a") \
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
    met = F.size(F.array_intersect("left", "right"))
    alike = both.where(met >= F.lit(threshold) * (F.size("left") + F.size("right") - met)).select("a", "b")
    alike = stored(alike, "alike")
    joined = stored(components(alike, "paragraph-groups"), "joined")
    # A key's first member may be like none of the others: where a key's members are not in one group yet, all of them meet.
    known = nodes.join(joined, "node", "left").select("node", "keys", F.coalesce("component", "node").alias("known"))
    mixed = known.mapInArrow(_deal_grouped(buckets, bands), "bucket int, keys binary, ids binary, groups binary") \
        .groupBy("bucket").applyInArrow(_mixed, "block long, size long, node long, known long").dropDuplicates(["block", "node"])
    mixed = stored(mixed.withColumn("parts", F.ceil(F.col("size") / PART_MEMBERS).cast("long")), "mixed")
    share = Fraction(str(threshold))
    more = meet(mixed.join(sets, "node"), "block", "parts", "node").select("block", "part", "node", "known", "shingles") \
        .mapInArrow(_linked((share.numerator, share.numerator + share.denominator)), "a long, b long")
    groups = components(alike.unionByName(more), "all-paragraph-groups")
    named = stored(nodes.join(groups, "node", "left").select("node", "first", "n", F.coalesce("component", "node").alias("component_id")), "named")
    kept = named.groupBy("component_id").agg(F.min("first").alias("kept"), F.sum("n").alias("members")).where("members > 1")
    gone = stored(named.join(stored(kept, "kept"), "component_id").select("node", "component_id", "kept"), "gone")
    return found.join(gone, "node").where("doc_id <> kept.doc_id or first_word <> kept.first_word").select(
        "doc_id", "first_word", "n_words", F.col("kept.doc_id").alias("kept_doc_id"), "component_id")


PIECES = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in ("window", "ids", "doc", "at", "shared", "lost_ids", "lost_doc", "lost_at", "from_ids", "from_doc")]])


def _settled(parts, buckets: int):
    """Rows of runs settled within the task: of equal ones only those of the smallest document go on."""
    kept, lost = with_source({k: np.concatenate([p[k] for p in parts]) for k in ("window", "doc", "at")})
    none = {"doc": np.zeros(0, np.int64), "at": np.zeros(0, np.int64), "source": np.zeros(0, np.int64)}
    gone_by = dict(packed.runs_by((lost["window"] % np.uint64(buckets)).astype(np.int64), lost))
    for bucket, run in packed.runs_by((kept["window"] % np.uint64(buckets)).astype(np.int64), kept):
        gone = gone_by.get(bucket, none)
        row = {"bucket": bucket, "window": run["window"].tobytes(), "at": run["at"].astype(np.uint32).tobytes(),
               "shared": run["shared"].tobytes(), "lost_at": gone["at"].astype(np.uint32).tobytes()}
        for name, ids in (("", run["doc"]), ("lost_", gone["doc"]), ("from_", gone["source"])):
            row[f"{name}ids"], row[f"{name}doc"] = packed.put_ids(ids)
        yield packed.batch([row], PIECES)


def _pieces(buckets: int):
    """Pieces of all texts."""

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for first, stop, data, at in spans.slices(batch.column("text")):
                part = pieces_of(data, at, ids[first:stop])
                parts.append(part)
                held += len(part["at"])
                if held >= 1 << 19:
                    yield from _settled(parts, buckets)
                    parts, held = [], 0
        if held:
            yield from _settled(parts, buckets)

    return run


def _windows(buckets: int):
    """Every run of `PIECE` words that begins at most `STARTS` words from a shared piece."""

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            seeds = batch.column("seeds")
            counts = np.diff(np.asarray(seeds.offsets))
            flat = seeds.flatten().to_numpy()
            where = np.concatenate([[0], np.cumsum(counts)])
            for first, stop, data, at in spans.slices(batch.column("text")):
                part = windows_of(data, at, ids[first:stop], np.repeat(np.arange(stop - first), counts[first:stop]), flat[where[first]:where[stop]])
                parts.append(part)
                held += len(part["at"])
                if held >= 1 << 19:
                    yield from _settled(parts, buckets)
                    parts, held = [], 0
        if held:
            yield from _settled(parts, buckets)

    return run


def windows_of(data: np.ndarray, at: np.ndarray, ids: np.ndarray, of: np.ndarray, seed: np.ndarray) -> dict[str, np.ndarray]:
    """Hash, document and first word of each run of `PIECE` words near a seed, a word of the text `of`."""
    low = spans.TO_LOWER[data]
    starts, ends, row = spans.words(low, at)
    word = spans.Prefix(low).of(starts, ends)
    edge = np.searchsorted(starts, at)
    begin = np.maximum(edge[of] + seed - STARTS, edge[of])
    end = np.minimum(edge[of] + seed + STARTS, edge[of + 1] - PIECE) + 1
    some = end > begin
    near = np.bincount(begin[some], minlength=len(word) + 1) - np.bincount(end[some], minlength=len(word) + 1)
    place = np.flatnonzero(np.cumsum(near) > 0)
    return {"window": _hashes(word, place), "doc": ids[row[place]], "at": place - edge[:-1][row[place]]}


def _hashes(word: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of the `PIECE` words from each place."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * spans.powers(spans.BASE, len(word)))])
        return spans.mix((sums[place + PIECE] - sums[place]) * spans.powers(spans.BASE_INVERSE, len(sums))[place])


def pieces_of(data: np.ndarray, at: np.ndarray, ids: np.ndarray) -> dict[str, np.ndarray]:
    """Hash, document and first word of each piece: it starts where a word pair hashes lowest among `STARTS` neighbours."""
    low = spans.TO_LOWER[data]
    starts, ends, row = spans.words(low, at)
    none = {"window": np.zeros(0, np.uint64), "doc": np.zeros(0, np.int64), "at": np.zeros(0, np.int64)}
    if len(starts) <= STARTS:
        return none
    word = spans.Prefix(low).of(starts, ends)
    with np.errstate(over="ignore"):
        pair = spans.mix(word[:-1] * np.uint64(spans.BASE) + word[1:])
        bits = np.uint64((1 << len(pair).bit_length()) - 1)
        chosen = (lowest((pair & ~bits) | np.arange(len(pair), dtype=np.uint64), STARTS) & bits).astype(np.int64)
        whole = row[:len(chosen)] == row[STARTS:STARTS + len(chosen)]
        place = np.unique(chosen[whole])
        place = place[place + PIECE <= len(word)]
        place = place[row[place] == row[place + PIECE - 1]]
    return {"window": _hashes(word, place), "doc": ids[row[place]], "at": place - np.searchsorted(starts, at[:-1])[row[place]]}


def with_source(part: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Pieces of the smallest document that holds each, with a mark on those that others hold too, and the others with
    that document's id."""
    kept, lost = settle_windows(part)
    shared = np.isin(kept["window"], lost["window"]).astype(np.uint8)
    if "shared" in kept:
        # A copy lost in any task marks every kept place of the piece.
        first = spans.equal_runs(kept["window"])
        before = np.maximum.reduceat(kept["shared"], np.flatnonzero(first))[np.cumsum(first) - 1] if len(first) else kept["shared"]
        shared |= before
    kept = {**kept, "shared": shared}
    if len(lost["at"]):
        first = np.flatnonzero(spans.equal_runs(kept["window"]))
        lost["source"] = kept["doc"][first][np.searchsorted(kept["window"][first], lost["window"])]
    else:
        lost = {**lost, "source": np.zeros(0, np.int64)}
    return kept, lost


def _equal_pieces(homes: int, seeds: bool):
    """What other documents hold too, by the document's home: the pieces lost to a smaller document, and for `seeds` the
    kept ones with copies as well."""
    schema = pa.schema([("home", pa.int32()), *[(c, pa.binary()) for c in ("ids", "doc", "at", "from_ids", "from_doc")]])

    def one(table: pa.Table) -> pa.Table:
        parts, lost = [], []
        for row in table.to_pylist():
            parts.append({"window": packed.get(row["window"], np.uint64), "doc": packed.get_ids(row["ids"], row["doc"]),
                          "at": packed.get(row["at"], np.uint32).astype(np.int64), "shared": packed.get(row["shared"], np.uint8)})
            lost.append({"doc": packed.get_ids(row["lost_ids"], row["lost_doc"]), "at": packed.get(row["lost_at"], np.uint32).astype(np.int64),
                         "source": packed.get_ids(row["from_ids"], row["from_doc"])})
        kept, gone = with_source({k: np.concatenate([p[k] for p in parts]) for k in ("window", "doc", "at", "shared")})
        if seeds:
            some = kept["shared"] > 0
            lost.append({"doc": kept["doc"][some], "at": kept["at"][some], "source": kept["doc"][some]})
        gone = {k: np.concatenate([*[p[k] for p in lost], gone[k]]) for k in ("doc", "at", "source")}
        rows = []
        for home, part in packed.runs_by((spans.mix(gone["doc"].astype(np.uint64)) % np.uint64(homes)).astype(np.int64), gone):
            row = {"home": home, "at": part["at"].astype(np.uint32).tobytes()}
            row["ids"], row["doc"] = packed.put_ids(part["doc"])
            row["from_ids"], row["from_doc"] = packed.put_ids(part["source"])
            rows.append(row)
        return pa.Table.from_batches([packed.batch(rows, schema)] if rows else [], schema=schema)

    return one, schema


def _ranges(table: pa.Table) -> pa.Table:
    """Pieces that overlap in one document are one range, with the smallest document it is held in."""
    rows = table.to_pylist()
    doc = np.concatenate([packed.get_ids(r["ids"], r["doc"]) for r in rows])
    at = np.concatenate([packed.get(r["at"], np.uint32).astype(np.int64) for r in rows])
    source = np.concatenate([packed.get_ids(r["from_ids"], r["from_doc"]) for r in rows])
    own, begin, end = unite(doc, at, at + PIECE)
    order = np.lexsort((at, doc))
    doc, at, source = doc[order], at[order], source[order]
    # Ranges and pieces are both in order of document and place, so each range's pieces stand together.
    ids = np.unique(doc)
    step = np.int64(at.max() + PIECE + 1) if len(at) else np.int64(1)
    first = np.searchsorted(np.searchsorted(ids, doc) * step + at, np.searchsorted(ids, own) * step + begin)
    return pa.table({"doc_id": pa.array(own), "first_word": pa.array(begin), "n_words": pa.array(end - begin),
                     "kept_doc_id": pa.array(np.minimum.reduceat(source, first) if len(first) else source)})


def _seeds(table: pa.Table) -> pa.Table:
    """One row per document: the places of its shared pieces."""
    rows = table.to_pylist()
    doc = np.concatenate([packed.get_ids(r["ids"], r["doc"]) for r in rows])
    at = np.concatenate([packed.get(r["at"], np.uint32).astype(np.int64) for r in rows])
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    first = np.flatnonzero(spans.equal_runs(doc))
    return pa.table({"id": pa.array(doc[first]), "seeds": packed.list_column(at, np.diff(np.concatenate([first, [len(doc)]])))})


def repeated_passages(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, first_word, n_words, kept_doc_id): word ranges made of runs of `PIECE` words that a document of smaller id holds too.

    Chosen pieces are seeds: every run of `PIECE` words near a piece that two documents share is compared. All runs of a
    repeat of 51 words are near one of its pieces, so it is returned whole, and so is a shorter repeat that holds a piece.
    """
    given = documents.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = given.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(16, total // (80 * BUCKET_KEYS))
    equal, schema = _equal_pieces(buckets, True)
    seeds = stored(given.mapInArrow(_pieces(buckets), as_spark(PIECES)).groupBy("bucket").applyInArrow(equal, as_spark(schema))
                   .groupBy("home").applyInArrow(_seeds, "id long, seeds array<long>"), "seeds")
    # A seed brings some 28 windows where pieces stand apart, and a word begins one window at most.
    n = seeds.agg(F.sum(F.size("seeds"))).first()[0] or 0
    buckets = max(16, min(28 * n, total // 4) // BUCKET_KEYS)
    equal, schema = _equal_pieces(buckets, False)
    near = given.join(seeds, given["doc_id"] == seeds["id"]).select("doc_id", "text", "seeds")
    return near.mapInArrow(_windows(buckets), as_spark(PIECES)).groupBy("bucket").applyInArrow(equal, as_spark(schema)) \
        .groupBy("home").applyInArrow(_ranges, "doc_id long, first_word long, n_words long, kept_doc_id long")


def dedup_paragraphs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What goes: one row per removed paragraph or passage.

    kind is "paragraph" (a line of at least `LEAST_WORDS` words whose 5-word shingle set has
    Jaccard 0.8 or more to another's; of each connected group the one in the smallest document
    stays) or "passage" (words [first_word, first_word + n_words) made of runs of `PIECE` words
    that stand in a document of smaller id; repeats of 51 words or more are whole). kept_doc_id is the document that keeps
    it, for a passage the smallest that holds one of its runs. Words are runs without
    ASCII white space, A-Z lower-cased, counted from the start of the text. Null or empty text
    has none; rows with a null id take no part; rows sharing an id are one document for passages
    and keep one of equal paragraphs. Repeats within one document are removed as paragraphs only.
    """
    lines = repeated_paragraphs(documents, key=key, text=text)
    passages = repeated_passages(documents, key, text)
    return lines.select("doc_id", F.lit("paragraph").alias("kind"), "first_word", "n_words", "kept_doc_id", "component_id").unionByName(
        passages.select("doc_id", F.lit("passage").alias("kind"), "first_word", "n_words", "kept_doc_id", F.lit(None).cast("long").alias("component_id")))
