"""Sharding by a weighted hash tree of regions, racks and shards."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelloom.llm.common import text_of

CHUNK_ROWS = 1 << 14


@dataclass(frozen=True)
class Leaf:
    """A shard's weight granted at one time. Weight added later is another grant with draws of its own."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0
    grant: int = 0


def even_tree(shards: int, racks: int = 2, per_rack: int = 2, first: int = 16) -> list[Leaf]:
    """Shards in racks and regions of fixed width. The `first` shards were set up together; each later one is a grant of its
    own, as if it had been added to them one by one, so that a tree of one more shard takes rows only into that shard."""
    width = racks * per_rack
    return [Leaf(s // width, s % width // per_rack, s, 1.0, 0 if s < first else s + 1) for s in range(shards)]


def grow(tree: list[Leaf], leaf: Leaf) -> list[Leaf]:
    """Add weight anywhere in the tree: rows move only into the new grant."""
    fresh = 1 + max((x.grant for x in tree), default=0)
    return [*tree, Leaf(leaf.region, leaf.rack, leaf.shard, leaf.weight, max(fresh, leaf.shard + 1))]


def draw(key: Column, node: tuple, weight: float) -> Column:
    """A node's exponential draw for the key: the smallest of several wins with odds by weight."""
    uniform = (F.shiftrightunsigned(F.xxhash64(key, *[F.lit(int(x)) for x in node]), 11).cast("double") + 0.5) / 2.0**53
    return -F.log(uniform) / F.lit(float(weight))


def choose(key: Column, children: dict[tuple, tuple[float, Column]]) -> Column:
    """The value below the winning child. Children of one node are compared by their draws."""
    if len(children) == 1:
        return next(iter(children.values()))[1]
    draws = [F.struct(draw(key, node, weight).alias("draw"), F.lit(i).alias("at")) for i, (node, (weight, _)) in enumerate(children.items())]
    won = F.array_min(F.array(*draws))["at"]
    chosen = None
    for i, (_, below) in enumerate(children.values()):
        chosen = F.when(won == i, below) if chosen is None else chosen.when(won == i, below)
    return chosen


def shard_of(key: Column, tree: list[Leaf]) -> Column:
    """Descend region, rack and shard. A subtree's weight is the sum of its leaves', per grant.

    Raising a weight (a new grant) pulls rows into that grant only; every other draw is unchanged.
    """
    levels: dict[tuple, dict[tuple, dict[tuple, Leaf]]] = defaultdict(lambda: defaultdict(dict))
    for leaf in tree:
        if leaf.weight > 0:
            levels[(leaf.grant, leaf.region)][(leaf.grant, leaf.region, leaf.rack)][
                (leaf.grant, leaf.region, leaf.rack, leaf.shard)] = leaf
    regions = {}
    for region, racks in levels.items():
        below = {}
        for rack, shards in racks.items():
            leaves = {node: (leaf.weight, F.lit(leaf.shard)) for node, leaf in shards.items()}
            below[rack] = (sum(w for w, _ in leaves.values()), choose(key, leaves))
        regions[region] = (sum(w for w, _ in below.values()), choose(key, below))
    return choose(key, regions)


def assign(documents: DataFrame, tree: list[Leaf], grown: list[Leaf], key: str = "doc_id", text: str = "text",
           chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Shard, slot in the shard, and shard in the grown tree of every row.

    The shard follows from the key and the tree alone (a null key is a key like any other).
    Equal rows are counted before the shuffle; a row repeated without bound is cut into parts
    of at most `chunk_rows` copies, which go to chunks of their own and are spread out again at
    the end. Slots number a shard's rows by hashed chunk, key, size, checksum and part: chunk
    totals give each chunk's first slot, and only a chunk of about `chunk_rows` parts is ever
    ordered in one task. Rows equal in key, size and checksum get neighbouring slots within a part.
    A null or empty text has no bytes; long ones are only measured, never shuffled.
    Empty tables give no rows; columns besides key and text are not read, so none can clash.
    """
    whole = text_of(text)
    rows = documents.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(whole).cast("long") + 1).alias("size"),
        F.crc32(whole).alias("text_crc32"),
    ).groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(chunk_rows).cast("long")))).withColumn(
        "copies", F.least(F.lit(chunk_rows).cast("long"), F.col("n") - F.col("part"))).drop("n")
    total = documents.count()
    chunks = max(1, -(-total // (chunk_rows * max(1, len({x.shard for x in tree})))))
    placed = rows.select(
        "*", shard_of(F.col("doc_id"), tree).alias("shard"), shard_of(F.col("doc_id"), grown).alias("grown_shard"),
        F.pmod(F.xxhash64(F.lit("chunk"), "doc_id", "size", "text_crc32", "part"), F.lit(chunks)).alias("chunk"))
    # At most shards x chunks rows: the running sum orders one row per chunk.
    first = placed.groupBy("shard", "chunk").agg(F.sum("copies").alias("n")).select(
        "shard", "chunk",
        (F.sum("n").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0))
         - F.col("n")).alias("first"))
    within = Window.partitionBy("shard", "chunk").orderBy("doc_id", "size", "text_crc32", "part")
    before = F.sum("copies").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies")
    return placed.withColumn("before", before).join(first, ["shard", "chunk"]).select(
        "doc_id", "size", "text_crc32", "shard", "grown_shard",
        F.explode(F.sequence(F.col("first") + F.col("before"), F.col("first") + F.col("before") + F.col("copies") - 1)).alias("slot"))
