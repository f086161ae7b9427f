"""Exact Jaccard links between word-shingle sets by signature trees.

A tree's leaves are documents, each with the size of its set and a bitmap of its hashed
shingles; a node above holds the OR of its children's bitmaps and the range of their sizes.
Two trees (or one with itself) are traversed together, and a pair of nodes is dropped as soon
as the largest overlap its documents could have is too small. Trees are built per MinHash
key, so that one task never compares documents that have nothing in common.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm import packed, spans
from panelloom.llm.common import broadcast_if_small, components
from panelloom.session import stored

SHINGLE = 5
# 40 keys of 4 MinHash values: a pair at Jaccard 0.8 shares no key with probability (1 - 0.8**4)**40 < 1e-9.
BANDS, ROWS = 40, 4
BITMAP_WORDS = 32
FANOUT = 8
# A task compares at most this many shingles with as many; larger clusters are cut into parts that meet pair by pair.
PART_SHINGLES = 1 << 21
PART_MEMBERS = 1024
BUCKET_KEYS = 1 << 20
MOST_MEMBERS = 2_000_000


def distinct_sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, offsets by text): the distinct 5-word shingles of each text, ascending. Fewer words are one shingle."""
    low = spans.TO_LOWER[data]
    starts, ends, row = spans.words(low, at)
    word = spans.Prefix(low).of(starts, ends)
    n = len(at) - 1
    value, own = spans.shingles(word, row, SHINGLE)
    count = np.bincount(row, minlength=n)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        first = np.concatenate([[0], np.cumsum(count)])
        whole = np.zeros(len(short), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(SHINGLE - 1):
                has = count[short] > i
                whole[has] = whole[has] * np.uint64(spans.BASE) + word[first[short[has]] + i]
            whole = spans.mix(whole + count[short].astype(np.uint64))
        value, own = np.concatenate([value, whole]), np.concatenate([own, short])
    order = np.lexsort((value, own))
    value, own = value[order], own[order]
    keep = spans.equal_runs(own, value) if len(own) else np.zeros(0, bool)
    value, own = value[keep], own[keep]
    return value, np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))])


def bitmap(values: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITMAP_WORDS * 64, np.uint8)
    bits[(values >> np.uint64(40)) % np.uint64(BITMAP_WORDS * 64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def minhash_keys(values: np.ndarray, at: np.ndarray, rows: np.ndarray, bands: int, size: int) -> np.ndarray:
    """One key per band for each given row (none of them empty): the combined minima of `size` orders of the set."""
    keys = np.zeros((bands, len(rows)), np.uint64)
    if not len(rows):
        return keys.T
    first = at[rows]
    factor = spans.mix(np.arange(1, bands * size + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
    with np.errstate(over="ignore"):
        for b in range(bands):
            for j in range(size):
                low = np.minimum.reduceat(values * factor[b * size + j], first)
                keys[b] = spans.mix(keys[b] * np.uint64(spans.BASE) + low)
            keys[b] ^= np.uint64(b) << np.uint64(56)
    return keys.T


def _sketches(batches):
    names = ["doc_id", "n_shingles", "k1", "k2", "bitmap", "keys"]
    for batch in batches:
        for first, stop, data, at in spans.slices(batch.column("text")):
            value, edge = distinct_sets(data, at)
            n = np.diff(edge)
            full = np.flatnonzero(n > 0)
            k1, k2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            keys = [None] * len(n)
            maps = [None] * len(n)
            if len(full):
                with np.errstate(over="ignore"):
                    k1[full] = np.add.reduceat(value, edge[full])
                    k2[full] = np.add.reduceat(spans.mix(value + np.uint64(0x632BE59BD9B4E019)), edge[full])
                for i, own in zip(full, minhash_keys(value, edge, full, BANDS, ROWS)):
                    keys[i] = own.tobytes()
                    maps[i] = bitmap(value[edge[i]:edge[i + 1]]).tobytes()
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(first, stop - first), pa.array(n.astype(np.int64)), pa.array(k1.view(np.int64)),
                pa.array(k2.view(np.int64)), pa.array(maps, pa.binary()), pa.array(keys, pa.binary())], names=names)


def _key_rows(buckets: int):
    """Keys of many documents, dealt to buckets as packed columns."""
    schema = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary())])

    def run(batches):
        for batch in batches:
            ids = batch.column("rep").to_numpy(zero_copy_only=False)
            keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.uint64)
            parts = packed.runs_by((keys % np.uint64(buckets)).astype(np.int64), {"keys": keys, "ids": np.repeat(ids, BANDS)})
            rows = [{"bucket": b, "keys": p["keys"].tobytes(), "ids": p["ids"].tobytes()} for b, p in parts]
            if rows:
                yield packed.batch(rows, schema)

    return run


def _blocks(table: pa.Table) -> pa.Table:
    """(block, size, rep) of the keys that two or more documents share; the block is named by its members."""
    keys = np.concatenate([np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()])
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in table["ids"].to_pylist()])
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    keep = spans.equal_runs(keys, ids)
    keys, ids = keys[keep], ids[keep]
    group = np.cumsum(spans.equal_runs(keys)) - 1
    size = np.bincount(group)
    with np.errstate(over="ignore"):
        name = np.add.reduceat(spans.mix(ids.astype(np.uint64)), np.flatnonzero(spans.equal_runs(keys)))
    shared = size[group] > 1
    return pa.table({"block": pa.array(name[group][shared].view(np.int64)), "size": pa.array(size[group][shared].astype(np.int64)), "rep": pa.array(ids[shared])})


# Jaccard of p / q or more, as (p, p + q): here 0.8.
LINK = (4, 9)


def could_link(n_a, n_b, overlap, link=LINK):
    """q * overlap >= p * union, with the union written by sizes and overlap."""
    return link[1] * overlap >= link[0] * (n_a + n_b)


def _levels(n: np.ndarray, bits: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Nodes from the leaves' parents to the top: OR of bitmaps, size range, least number of set bits of a document."""
    first = np.arange(0, len(n), FANOUT)
    levels = [{"bits": np.bitwise_or.reduceat(bits, first), "low": np.minimum.reduceat(n, first), "high": np.maximum.reduceat(n, first),
               "set": np.minimum.reduceat(np.bitwise_count(bits).sum(1, dtype=np.int64), first)}]
    while len(levels[-1]["low"]) > FANOUT:
        below = levels[-1]
        first = np.arange(0, len(below["low"]), FANOUT)
        levels.append({"bits": np.bitwise_or.reduceat(below["bits"], first), "low": np.minimum.reduceat(below["low"], first),
                       "high": np.maximum.reduceat(below["high"], first), "set": np.minimum.reduceat(below["set"], first)})
    return levels


def _children(i: np.ndarray, j: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    a = (i[:, None, None] * FANOUT + np.arange(FANOUT)[:, None] + np.zeros((1, FANOUT), np.int64)).ravel()
    b = (j[:, None, None] * FANOUT + np.arange(FANOUT)[None, :] + np.zeros((FANOUT, 1), np.int64)).ravel()
    same = np.repeat(i == j, FANOUT * FANOUT)
    keep = (a < count) & (b < count) & (~same | (a <= b))
    return a[keep], b[keep]


def _near(level: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, link=LINK) -> np.ndarray:
    """Whether some document below i and some below j could still overlap enough."""
    low = level["low"]
    sized = could_link(low[i], low[j], np.minimum(level["high"][i], level["high"][j]), link)
    sized &= could_link(level["high"][i], low[j], level["high"][i], link) & could_link(level["high"][j], low[i], level["high"][j], link)
    out = np.zeros(len(i), bool)
    for a in range(0, len(i), 1 << 16):
        k = a + np.flatnonzero(sized[a:a + (1 << 16)])
        both = np.bitwise_count(level["bits"][i[k]] & level["bits"][j[k]]).sum(1, dtype=np.int64)
        most = np.minimum(level["high"][i[k]] - np.maximum(level["set"][i[k]] - both, 0), level["high"][j[k]] - np.maximum(level["set"][j[k]] - both, 0))
        out[k] = could_link(low[i[k]], low[j[k]], most, link)
    return out


def forest(n: np.ndarray, bits: np.ndarray, sets: list[np.ndarray] | None = None, known: np.ndarray | None = None,
           link=LINK) -> list[tuple[int, int]]:
    """Links that connect all linked documents, one fewer than the documents in each group.

    With `sets` a link is exact; without, it is one the bitmaps can't rule out. Pairs already
    connected are not looked at again, so a large group of near copies costs little more than
    its size. `known` names the group each document is in already.
    """
    order = np.argsort(n, kind="stable")
    n, bits = n[order], bits[order]
    levels = _levels(n, bits)
    top = np.arange(len(levels[-1]["low"]))
    i, j = (x.ravel() for x in np.meshgrid(top, top, indexing="ij"))
    i, j = i[i <= j], j[i <= j]
    for depth in range(len(levels) - 1, -1, -1):
        keep = _near(levels[depth], i, j, link)
        i, j = i[keep], j[keep]
        if depth:
            i, j = _children(i, j, len(levels[depth - 1]["low"]))
    near_first = np.argsort(j - i, kind="stable")
    i, j = i[near_first], j[near_first]
    group = np.arange(len(n)) if known is None else known[order]
    found = []
    first = np.arange(0, len(n), FANOUT)
    while len(i):
        low, high = np.minimum.reduceat(group, first), np.maximum.reduceat(group, first)
        open_ = ~((low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j]))
        i, j = i[open_], j[open_]
        a, b = _children(i[:64], j[:64], len(n))
        i, j = i[64:], j[64:]
        keep = (a < b) & (group[a] != group[b])
        a, b = a[keep], b[keep]
        only_a, only_b = bits[a] & ~bits[b], bits[b] & ~bits[a]
        most = np.minimum(n[a] - np.bitwise_count(only_a).sum(1, dtype=np.int64), n[b] - np.bitwise_count(only_b).sum(1, dtype=np.int64))
        keep = could_link(n[a], n[b], most, link)
        for x, y in zip(a[keep].tolist(), b[keep].tolist()):
            if group[x] == group[y]:
                continue
            if sets is None or could_link(n[x], n[y], len(np.intersect1d(sets[order[x]], sets[order[y]], assume_unique=True)), link):
                found.append((int(order[x]), int(order[y])))
                one, other = sorted((group[x], group[y]))
                group[group == other] = one
    return found


def groups_of(batches, key: list[str]):
    """Tables of consecutive rows with one key, across batches; the input is sorted by it."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in key]
        edge = np.flatnonzero(spans.equal_runs(*columns))
        if held and all(held[-1].column(k)[-1].as_py() == c[0] for k, c in zip(key, columns)):
            edge = edge[1:]
        else:
            edge = edge if held else edge[1:]
        last = 0
        for e in edge:
            if e > last:
                held.append(batch.slice(last, e - last))
            if held:
                yield pa.Table.from_batches(held)
            held, last = [], e
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _bits(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITMAP_WORDS)


def _edge_batches(edges):
    a, b = [], []
    for x, y in edges:
        a.append(min(x, y))
        b.append(max(x, y))
        if len(a) == 1 << 16:
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
            a, b = [], []
    yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _possible(batches):
    def edges():
        for table in groups_of(batches, ["block", "part"]):
            rep = table["rep"].to_numpy()
            for x, y in forest(table["n_shingles"].to_numpy(), _bits(table["bitmap"])):
                yield rep[x], rep[y]

    yield from _edge_batches(edges())


def _with_sets(batches):
    for batch in batches:
        for first, stop, data, at in spans.slices(batch.column("text")):
            value, edge = distinct_sets(data, at)
            column = [value[a:b].tobytes() for a, b in zip(edge, edge[1:])]
            yield pa.RecordBatch.from_arrays([
                batch.column("rep").slice(first, stop - first), batch.column("cluster").slice(first, stop - first),
                batch.column("parts").slice(first, stop - first), pa.array(column, pa.binary())], names=["rep", "cluster", "parts", "shingles"])


def _exact(batches):
    def edges():
        for table in groups_of(batches, ["block", "part"]):
            rep = table["rep"].to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
            n = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(n > 0)
            if len(some) > 1:
                own = [sets[i] for i in some]
                for x, y in forest(n[some], np.stack([bitmap(s) for s in own]), own):
                    yield rep[some[x]], rep[some[y]]

    yield from _edge_batches(edges())


def meet(rows: DataFrame, block: str, parts: str, member: str) -> DataFrame:
    """Adds block and part: members of a cut block are dealt to parts, and every two parts meet in one task."""
    part = F.pmod(F.xxhash64(member), F.col(parts))
    many = F.transform(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1), lambda k: F.least(k, part) * F.col(parts) + F.greatest(k, part))
    dealt = rows.withColumnRenamed(block, "block") if block != "block" else rows
    return dealt.withColumn("part", F.explode(many)).repartition("block", "part").sortWithinPartitions("block", "part")


def links(documents: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sketches, classes of equal sets, exact links that connect each component of class representatives)."""
    given = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketches = stored(given.mapInArrow(_sketches, "doc_id long, n_shingles long, k1 long, k2 long, bitmap binary, keys binary"), "sketches")
    # Equal sets are one class, named by its smallest id; copies are merged before the shuffle.
    known = sketches.where("doc_id is not null and n_shingles > 0")
    classes = stored(known.groupBy("k1", "k2", "n_shingles").agg(F.min(F.struct("doc_id", "bitmap", "keys")).alias("m")).select(
        "k1", "k2", "n_shingles", F.col("m.doc_id").alias("rep"), "m.bitmap", "m.keys"), "classes")
    buckets = max(16, classes.count() * BANDS // BUCKET_KEYS)
    dealt = classes.select("rep", "keys").mapInArrow(_key_rows(buckets), "bucket int, keys binary, ids binary")
    blocks = dealt.groupBy("bucket").applyInArrow(_blocks, "block long, size long, rep long").dropDuplicates(["block", "rep"])
    blocks = blocks.withColumn("parts", F.ceil(F.col("size") / PART_MEMBERS).cast("long"))
    signed = blocks.join(classes.select("rep", "n_shingles", "bitmap"), "rep")
    maybe = meet(signed.select("block", "parts", "rep", "n_shingles", "bitmap"), "block", "parts", "rep").mapInArrow(_possible, "a long, b long")
    clusters = stored(components(maybe, "clusters").withColumnRenamed("node", "rep").withColumnRenamed("component", "cluster"), "clusters")
    weight = clusters.join(classes.select("rep", "n_shingles"), "rep").groupBy("cluster").agg(
        F.ceil(F.sum("n_shingles") / PART_SHINGLES).cast("long").alias("parts"))
    members = stored(clusters.join(stored(weight, "weights"), "cluster"), "members")
    texts = given.join(broadcast_if_small(members, members.count(), MOST_MEMBERS), F.col("doc_id") == F.col("rep")).select("rep", "cluster", "parts", "text")
    sets = texts.mapInArrow(_with_sets, "rep long, cluster long, parts long, shingles binary")
    return sketches.select("doc_id", "n_shingles", "k1", "k2"), classes.select("k1", "k2", "rep"), \
        meet(sets, "cluster", "parts", "rep").mapInArrow(_exact, "a long, b long")


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links, its own included) of every document.

    Two documents link where 100 * shared shingles >= 80 * all shingles of both. Null or empty
    texts have no shingles and link with nothing. Rows sharing an id are one document whose
    links are those of any of its texts; rows with a null id link with nothing and have no
    component. Links are exact; a pair that just reaches the threshold is looked at with
    probability above 1 - 1e-9.
    """
    sketches, classes, exact = links(documents, key, text)
    found = components(exact, "near-duplicates")
    named = stored(classes.join(found, classes["rep"] == found["node"], "left").select(
        "k1", "k2", F.coalesce("component", "rep").alias("component_id")), "class-components")
    has = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return sketches.withColumns({"k1": F.when(has, F.col("k1")), "k2": F.when(has, F.col("k2"))}).join(named, ["k1", "k2"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
