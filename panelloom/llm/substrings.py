"""Removal of long byte strings that occur in an earlier document, by a logarithmic family of sparse suffix arrays.

Only some positions of a text carry a suffix: of the `LENGTH` - `ANCHOR` + 1 places in a
window of `LENGTH` bytes, the one whose next `ANCHOR` bytes hash lowest. The choice depends
on the window's bytes alone, so equal windows carry their suffix at the same place, wherever
they stand; about one byte in sixteen is kept. An entry holds the hash of the anchor (its
place in the suffix order), the hash of its whole reach (all windows that chose it), the
document and the place.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.llm import packed, spans
from panelloom.session import stored

LENGTH, ANCHOR = 50, 20
# Entries that one task holds at a time, and that one run of a suffix array may have.
BUCKET_ENTRIES, RUN_ENTRIES = 1 << 20, 1 << 20
BYTES_PER_ENTRY = 16
ENTRY = ("anchor", "reach", "doc", "row", "at", "more")
PLACE = ("doc", "row", "at", "to")
KINDS = {"anchor": np.uint64, "reach": np.uint64, "doc": np.int64, "row": np.int64, "at": np.uint32, "more": np.uint8}

# Bytes of the two hashes that are shuffled. An anchor's place among the buckets adds to its bits, and anchors that merely
# look equal cost a closer look, nothing else; anchor and reach together decide.
ANCHOR_BYTES, REACH_BYTES = 5, 6

RUNS = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in (
    "anchor", "reach", "ids", "rows", "doc", "at", "more", "lost_ids", "lost_rows", "lost_doc", "lost_at", "lost_more")]])
PLACES = pa.schema([("home", pa.int32()), ("bucket", pa.int32()), *[(c, pa.binary()) for c in (
    "lost_ids", "lost_rows", "lost_doc", "lost_at", "lost_to", "try_ids", "try_rows", "try_doc", "try_at", "try_to")]])
SPANS = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("lost_at", pa.list_(pa.int64())), ("lost_to", pa.list_(pa.int64())),
                   ("try_at", pa.list_(pa.int64())), ("try_to", pa.list_(pa.int64())), ("try_bucket", pa.list_(pa.int64()))])


def as_spark(schema: pa.Schema) -> T.StructType:
    kinds = {pa.int32(): T.IntegerType(), pa.int64(): T.LongType(), pa.binary(): T.BinaryType(), pa.list_(pa.int64()): T.ArrayType(T.LongType())}
    return T.StructType([T.StructField(f.name, kinds[f.type]) for f in schema])


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of `width` values, by doubling."""
    have, low = 1, values
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    return np.minimum(low[:len(low) - (width - have)], low[width - have:]) if width > have else low


def entries(data: np.ndarray, at: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> dict[str, np.ndarray]:
    """Suffixes of the texts in one buffer, in text order: windows [at, at + more] of the document chose each."""
    n = len(data)
    if n < LENGTH:
        return {k: np.zeros(0, kind) for k, kind in KINDS.items()}
    prefix = spans.Prefix(data)
    anchor = prefix.fixed(ANCHOR)
    bits = np.uint64(max(int(n).bit_length(), 1))
    place = np.uint64((1 << int(bits)) - 1)
    chosen = lowest((anchor & ~place) | np.arange(len(anchor), dtype=np.uint64), LENGTH - ANCHOR + 1) & place
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[:len(chosen)]
    start = np.flatnonzero(np.arange(len(chosen)) + LENGTH <= at[text + 1])
    chosen = chosen[start]
    first = np.flatnonzero(spans.equal_runs(chosen))
    begin = start[first]
    end = start[np.concatenate([first[1:], [len(start)]]) - 1] if len(start) else start
    own = text[begin]
    return {"anchor": anchor[chosen[first].astype(np.int64)], "reach": prefix.of(begin, end + LENGTH) >> np.uint64(64 - 8 * REACH_BYTES), "doc": ids[own], "row": rows[own],
            "at": (begin - at[own]).astype(np.uint32), "more": (end - begin).astype(np.uint8)}


def settle(run: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Sort entries; of equal reaches keep those of the smallest document, and return the others as lost."""
    names = ("doc", "reach", "anchor", "bucket")
    order = np.lexsort([run[k] for k in names if k in run])
    run = {k: v[order] for k, v in run.items()}
    if not len(order):
        return run, run
    first = spans.equal_runs(*[run[k] for k in names[1:] if k in run])
    smallest = run["doc"][first][np.cumsum(first) - 1]
    keep = run["doc"] == smallest
    return {k: v[keep] for k, v in run.items()}, {k: v[~keep] for k, v in run.items()}


def joined(parts: list[dict[str, np.ndarray]], names=ENTRY) -> dict[str, np.ndarray]:
    return {k: np.concatenate([p[k] for p in parts]) for k in names}


GONE = ("doc", "row", "at", "more")


def _sorted_runs(buckets: int):
    def out(parts):
        whole = joined(parts)
        # The bucket is taken from the anchor's upper bits, the lower ones are what is shuffled.
        whole["bucket"] = (whole["anchor"] >> np.uint64(8 * ANCHOR_BYTES)) % np.uint64(buckets)
        whole["anchor"] &= np.uint64((1 << (8 * ANCHOR_BYTES)) - 1)
        kept, lost = settle(whole)
        lost_by = dict(packed.runs_by(lost["bucket"].astype(np.int64), {k: lost[k] for k in GONE}))
        for bucket, run in packed.runs_by(kept["bucket"].astype(np.int64), kept):
            gone = lost_by.get(bucket, {k: np.zeros(0, KINDS[k]) for k in GONE})
            ids, rows, doc = packed.put_rows(run["doc"], run["row"])
            lost_ids, lost_rows, lost_doc = packed.put_rows(gone["doc"], gone["row"])
            yield packed.batch([{
                "bucket": bucket, "anchor": packed.put_planes(run["anchor"], ANCHOR_BYTES), "reach": packed.put_planes(run["reach"], REACH_BYTES), "ids": ids, "rows": rows, "doc": doc,
                "at": run["at"].astype(np.uint32).tobytes(), "more": run["more"].astype(np.uint8).tobytes(), "lost_ids": lost_ids,
                "lost_rows": lost_rows, "lost_doc": lost_doc, "lost_at": gone["at"].astype(np.uint32).tobytes(), "lost_more": gone["more"].astype(np.uint8).tobytes()}], RUNS)

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            ids, marks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "row"))
            for first, stop, data, at in spans.slices(batch.column("text")):
                parts.append(entries(data, at, ids[first:stop], marks[first:stop]))
                held += len(parts[-1]["at"])
                if held >= RUN_ENTRIES:
                    yield from out(parts)
                    parts, held = [], 0
        if held:
            yield from out(parts)

    return run


def places(lost: dict[str, np.ndarray], tried: dict[str, np.ndarray], homes: int, bucket: int):
    """Rows of byte ranges by the document's home, with the bucket that found them."""
    home = lambda rows: (spans.mix(rows.astype(np.uint64)) % np.uint64(homes)).astype(np.int64)
    a = dict(packed.runs_by(home(lost["row"]), lost))
    b = dict(packed.runs_by(home(tried["row"]), tried))
    none = {k: np.zeros(0, np.int64) for k in PLACE}
    out = []
    for h in sorted({*a, *b}):
        row = {"home": h, "bucket": bucket}
        for name, part in (("lost", a.get(h, none)), ("try", b.get(h, none))):
            row[f"{name}_ids"], row[f"{name}_rows"], row[f"{name}_doc"] = packed.put_rows(part["doc"], part["row"])
            row[f"{name}_at"], row[f"{name}_to"] = (part[k].astype(np.uint32).tobytes() for k in ("at", "to"))
        out.append(row)
    if out:
        yield packed.batch(out, PLACES)


def grow(levels: list, new: dict[str, np.ndarray], lost: list, settle) -> None:
    """Add a run to a family of levels: merge-scan it with levels of no more than twice its size, until sizes fall geometrically."""
    while levels and len(levels[-1]["at"]) <= 2 * len(new["at"]):
        new, gone = settle(joined([levels.pop(), new], tuple(new)))
        lost.append(gone)
    levels.append(new)


def finish(levels: list, lost: list, settle) -> None:
    """Merge all levels into one."""
    while len(levels) > 1:
        one, other = levels.pop(), levels.pop()
        new, gone = settle(joined([one, other], tuple(one)))
        lost.append(gone)
        levels.append(new)


def _family(homes: int):
    """The logarithmic family of one bucket: each run is merge-scanned with levels of no more than its size until the
    sizes fall geometrically again. What a merge finds in a smaller document is lost; in the end one level is left."""

    def run(batches):
        levels, lost, bucket = [], [], 0
        for batch in batches:
            for row in batch.to_pylist():
                bucket = row["bucket"]
                doc, mark = packed.get_rows(row["ids"], row["rows"], row["doc"])
                new = {"anchor": packed.get_planes(row["anchor"], ANCHOR_BYTES), "reach": packed.get_planes(row["reach"], REACH_BYTES), "doc": doc,
                       "row": mark, "at": packed.get(row["at"], np.uint32), "more": packed.get(row["more"], np.uint8)}
                doc, mark = packed.get_rows(row["lost_ids"], row["lost_rows"], row["lost_doc"])
                lost.append({"doc": doc, "row": mark, "at": packed.get(row["lost_at"], np.uint32), "more": packed.get(row["lost_more"], np.uint8)})
                grow(levels, new, lost, settle)
        if levels:
            finish(levels, lost, settle)
        if not levels:
            return
        last = levels[0]
        # Reaches that differ behind one anchor may still share windows: their texts must be looked at.
        group = np.cumsum(spans.equal_runs(last["anchor"])) - 1
        size = group[-1] + 1 if len(group) else 0
        low, high = np.full(size, np.iinfo(np.int64).max), np.full(size, np.iinfo(np.int64).min)
        np.minimum.at(low, group, last["doc"])
        np.maximum.at(high, group, last["doc"])
        reaches = np.bincount(group[spans.equal_runs(last["anchor"], last["reach"])], minlength=size)
        unsure = ((low < high) & (reaches > 1))[group]
        gone = joined(lost, GONE)
        yield from places({"doc": gone["doc"], "row": gone["row"], "at": gone["at"], "to": gone["at"] + gone["more"] + LENGTH},
                          {"doc": last["doc"][unsure], "row": last["row"][unsure], "at": last["at"][unsure], "to": (last["at"] + last["more"])[unsure]}, homes, bucket)

    return run


def unite(doc: np.ndarray, at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal ranges covered in each document."""
    order = np.lexsort((at, doc))
    doc, at, to = doc[order], at[order], to[order]
    if not len(doc):
        return doc, at, to
    change = spans.equal_runs(doc)
    # Ends so far within the document: lift each document above the last, so that one running maximum serves all.
    step = np.int64(max(int(to.max()), 1) + 1)
    lift = (np.cumsum(change) - 1) * step
    reach = np.maximum.accumulate(to + lift)
    first = np.ones(len(doc), bool)
    first[1:] = (at[1:] + lift[1:] > reach[:-1]) | change[1:]
    begin = np.flatnonzero(first)
    stop = np.concatenate([begin[1:], [len(doc)]]) - 1
    return doc[begin], at[begin], reach[stop] - lift[stop]


def _by_document(batches):
    """One row per document: its lost ranges united, and the window ranges still to be looked at."""
    parts = {"lost": [], "try": []}
    for batch in batches:
        for row in batch.to_pylist():
            for name, part in parts.items():
                doc, mark = packed.get_rows(row[f"{name}_ids"], row[f"{name}_rows"], row[f"{name}_doc"])
                part.append({"doc": doc, "row": mark, "bucket": np.full(len(doc), row["bucket"], np.int64), **{
                    k: packed.get(row[f"{name}_{k}"], np.uint32).astype(np.int64) for k in ("at", "to")}})
    if not parts["lost"]:
        return
    lost, tried = (joined(part, (*PLACE, "bucket")) for part in parts.values())
    # A document is an id and a row hash: two ids may have equal hashes.
    ids, rows = (np.concatenate([lost[k], tried[k]]) for k in ("doc", "row"))
    first, place = packed.distinct_rows(ids, rows)
    ids, rows = ids[first], rows[first]
    own, at, to = unite(place[:len(lost["at"])], lost["at"], lost["to"])
    tried["own"] = place[len(lost["at"]):]
    order = np.lexsort((tried["at"], tried["own"]))
    tried = {k: v[order] for k, v in tried.items()}
    count = lambda r: np.bincount(r, minlength=len(rows))
    yield pa.RecordBatch.from_arrays([
        pa.array(ids), pa.array(rows), packed.list_column(at, count(own)), packed.list_column(to, count(own)),
        packed.list_column(tried["at"], count(tried["own"])), packed.list_column(tried["to"], count(tried["own"])), packed.list_column(tried["bucket"], count(tried["own"]))], schema=SPANS)


REACHES = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in ("bytes", "size", "ids", "rows", "doc", "at")]])


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, .. for each start, as many as counted."""
    before = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


def settle_windows(part: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    order = np.lexsort((part["doc"], part["window"]))
    part = {k: v[order] for k, v in part.items()}
    if not len(order):
        return part, part
    first = spans.equal_runs(part["window"])
    keep = part["doc"] == part["doc"][first][np.cumsum(first) - 1]
    return {k: v[keep] for k, v in part.items()}, {k: v[~keep] for k, v in part.items()}


def _reaches(batches):
    """The bytes of the reaches left open, each sent to the bucket that its anchor fell into."""

    def out(parts):
        whole = joined(parts, ("bucket", "doc", "row", "at", "size", "from"))
        data = np.concatenate([p["data"] for p in parts])
        base = np.repeat(np.concatenate([[0], np.cumsum([len(p["data"]) for p in parts])[:-1]]), [len(p["at"]) for p in parts])
        whole["from"] = whole["from"] + base
        # Reaches that start alike stand together and compress.
        for bucket, run in packed.runs_by(whole["bucket"], whole):
            ids, rows, doc = packed.put_rows(run["doc"], run["row"])
            yield packed.batch([{"bucket": bucket, "bytes": data[spread(run["from"], run["size"])].tobytes(), "size": run["size"].astype(np.uint8).tobytes(),
                                 "ids": ids, "rows": rows, "doc": doc, "at": run["at"].astype(np.uint32).tobytes()}], REACHES)

    parts, held = [], 0
    for batch in batches:
        ids, marks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "row"))
        lists = [batch.column(c) for c in ("try_at", "try_to", "try_bucket")]
        counts = np.diff(np.asarray(lists[0].offsets))
        tried_at, tried_to, tried_bucket = (c.flatten().to_numpy() for c in lists)
        where = np.concatenate([[0], np.cumsum(counts)])
        for first, stop, data, at in spans.slices(batch.column("text")):
            a, b = where[first], where[stop]
            if a == b:
                continue
            text = np.repeat(np.arange(stop - first), counts[first:stop])
            parts.append({"bucket": tried_bucket[a:b], "doc": ids[first:stop][text], "row": marks[first:stop][text], "at": tried_at[a:b],
                          "size": tried_to[a:b] - tried_at[a:b] + LENGTH, "from": at[text] + tried_at[a:b], "data": data})
            held += len(data)
            if held >= 4 * spans.CHUNK_BYTES:
                yield from out(parts)
                parts, held = [], 0
    if held:
        yield from out(parts)


def _same_windows(homes: int):
    """Every window of a bucket's open reaches, settled in a family of the same kind."""

    def run(batches):
        levels, lost, bucket = [], [], 0
        for batch in batches:
            for row in batch.to_pylist():
                bucket = row["bucket"]
                doc, mark = packed.get_rows(row["ids"], row["rows"], row["doc"])
                data, size = packed.get(row["bytes"], np.uint8), packed.get(row["size"], np.uint8).astype(np.int64)
                begin = np.concatenate([[0], np.cumsum(size)[:-1]])
                n = size - LENGTH + 1
                start = spread(begin, n)
                of = np.repeat(np.arange(len(size)), n)
                part = {"window": spans.Prefix(data).of(start, start + LENGTH), "doc": doc[of], "row": mark[of],
                        "at": packed.get(row["at"], np.uint32).astype(np.int64)[of] + start - begin[of]}
                new, gone = settle_windows(part)
                lost.append(gone)
                grow(levels, new, lost, settle_windows)
        if lost:
            finish(levels, lost, settle_windows)
            gone = joined(lost, ("doc", "row", "at"))
            none = {k: np.zeros(0, np.int64) for k in PLACE}
            yield from places({**gone, "to": gone["at"] + LENGTH}, none, homes, bucket)

    return run


def _cut(batches):
    """Remaining bytes of each text and what was taken out."""
    for batch in batches:
        at_lists, to_lists = batch.column("lost_at"), batch.column("lost_to")
        rows = []
        for text, starts, ends in zip(batch.column("text"), at_lists, to_lists):
            raw = (text.as_py() or "").encode()
            at, to = np.array(starts.as_py() or [], np.int64), np.array(ends.as_py() or [], np.int64)
            _, at, to = unite(np.zeros(len(at), np.int64), at, to)
            edge = [0, *np.column_stack([at, to]).ravel().tolist(), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edge[::2], edge[1::2]))
            rows.append((len(raw), int((to - at).sum()), len(at), hashlib.sha256(kept).hexdigest(), kept))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def lost_ranges(given: DataFrame) -> DataFrame:
    """(id, mark, lost_at, lost_to): byte ranges of each of `texts_of` that a document of smaller id holds too."""
    total = given.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(16, total // (BUCKET_ENTRIES * BYTES_PER_ENTRY))
    runs = given.where("doc_id is not null").mapInArrow(_sorted_runs(buckets), as_spark(RUNS))
    found = runs.groupBy("bucket").applyInArrow(_per_group(_family(buckets), PLACES), as_spark(PLACES))
    known = stored(found.groupBy("home").applyInArrow(_per_group(_by_document, SPANS), as_spark(SPANS)), "ranges")
    # Both joins with the texts keep every text and use one key, so Spark deals the texts out once for the two;
    # a filter here would turn this join into an inner one with a shuffle of its own.
    looked = with_ranges(given, known.select("id", F.col("row").alias("mark"), "try_at", "try_to", "try_bucket"))
    same = looked.select("doc_id", "row", "text", "try_at", "try_to", "try_bucket").mapInArrow(_reaches, as_spark(REACHES)) \
        .groupBy("bucket").applyInArrow(_per_group(_same_windows(buckets), PLACES), as_spark(PLACES))
    more = same.groupBy("home").applyInArrow(_per_group(_by_document, SPANS), as_spark(SPANS))
    both = known.select("id", "row", "lost_at", "lost_to").unionByName(more.select("id", "row", "lost_at", "lost_to"))
    return both.groupBy("id", F.col("row").alias("mark")).agg(
        F.flatten(F.collect_list("lost_at")).alias("lost_at"), F.flatten(F.collect_list("lost_to")).alias("lost_to"))


def with_ranges(given: DataFrame, ranges: DataFrame) -> DataFrame:
    return given.join(ranges, (given["doc_id"] == ranges["id"]) & (given["row"] == ranges["mark"]), "left")


def texts_of(documents: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, text and a 64-bit hash that tells rows sharing an id apart (equal rows share their ranges)."""
    return documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn(
        "row", F.xxhash64("doc_id", "text"))


def _per_group(run, schema: pa.Schema):
    """A grouped map over one group's rows."""

    def one(table: pa.Table) -> pa.Table:
        out = pa.Table.from_batches(list(run(table.to_batches())), schema=schema)
        pa.default_memory_pool().release_unused()
        return out

    return one


def dedup_substrings(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Cut from each text every byte covered by a `LENGTH`-byte string that also starts in a document with a smaller id.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes). Matches never
    cross documents and are judged on the texts as given. Null text is empty; texts under
    `LENGTH` bytes are left whole. Rows sharing an id do not count against each other but
    lose what any smaller id holds; rows with a null id are left whole and count for nothing.
    Hashes are of 64 bits. A string common to any number of documents is settled within each
    run before it is shuffled, so no task gathers all its places.
    """
    given = texts_of(documents, key, text)
    return with_ranges(given, lost_ranges(given)).select("doc_id", "text", "lost_at", "lost_to").mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
