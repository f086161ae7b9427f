"""Column helpers shared by the text operators."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.session import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\f\r"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. `lower` is that on pure ASCII, and much faster than a translation."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def digest_pair(text: Column) -> list[Column]:
    """128 bits of a text as two longs: an equality key that is cheap to shuffle."""
    return [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]


def broadcast_if_small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Hint a broadcast only where the counted rows stay within the bound; else leave the join to shuffle."""
    return F.broadcast(df) if rows <= most else df


def components(edges: DataFrame, label: str) -> DataFrame:
    """Connected components of undirected edges (a, b): returns (node, component), the smallest node reachable.

    Large-star and small-star steps alternate until no edge changes, so the number of
    rounds grows with the logarithm of the longest path. Each round is written to the
    shared folder: lineage stays short and a lost executor re-reads files. Neighbour
    lists are never gathered: a star is a minimum per node joined back to its edges.
    Loops and nulls are ignored; a node without edges does not appear.
    """
    current = stored(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), label)
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    previous = None
    while True:
        # Large star: every larger neighbour of a node is linked to the smallest of the node's neighbourhood.
        around = both(current)
        low = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = around.join(low, "a").where("b > a").select(F.col("low").alias("a"), "b").where("a <> b").distinct()
        # Small star: smaller neighbours and the node itself are linked to the smallest of them.
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        joined = large.join(low, "b")
        small = joined.select(F.col("low").alias("x"), F.col("a").alias("y")).unionByName(
            low.select(F.col("low").alias("x"), F.col("b").alias("y")))
        current = stored(small.where("x <> y").select(
            F.col("x").alias("a"), F.col("y").alias("b")).distinct(), label)
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == previous:
            return current.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
                current.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        previous = mark


def cached_by_process(build):
    """Keep the value a worker process builds from the same arguments."""
    return functools.lru_cache(maxsize=4)(build)
