"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, tokens."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm import decontaminate, lines, pieces, quality, sigtree
from panelloom.llm.common import broadcast_if_small
from panelloom.llm.queries import PIECE_MODEL
from panelloom.session import shared_dir, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Lists of removed ids are broadcast up to this many rows (16 bytes each), and shuffled beyond.
MOST_REMOVED = 1_000_000


def _without(docs: DataFrame, removed: DataFrame, same) -> DataFrame:
    """The documents that no removed row names."""
    return docs.join(broadcast_if_small(removed, removed.count(), MOST_REMOVED), same, "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed rules and the classifier, which learns from the labels of the documents at hand."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs, model).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share. A document left without any character goes."""
    cut = lines.dedup_lines(docs).withColumn("text", F.when(F.col("n_dropped") > 0, lines.joined()).otherwise(F.col("text")))
    changed = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", changed).where((F.col("n_dropped") == 0) | (F.col("text") != "")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id in each group of linked documents."""
    groups = sigtree.near_duplicates(docs)
    removed = stored(groups.where("component_id <> doc_id").select(F.col("doc_id").alias("removed")).distinct(), "near-copies")
    return _without(docs, removed, F.col("doc_id") == F.col("removed")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more than a twentieth of words in benchmark windows."""
    judged = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    removed = stored(judged.where("contaminated").select("id", "t1", "t2").distinct(), "contaminated")
    keyed = docs.select("*", *decontaminate.row_key("doc_id", "text"))
    same = keyed["id"].eqNullSafe(removed["id"]) & (keyed["t1"] == removed["t1"]) & (keyed["t2"] == removed["t2"])
    return _without(keyed, removed, same).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left."""
    return pieces.encode(docs, PIECE_MODEL)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

# SQL expresses neither the classifier nor the tokenizer; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents. Each stage's rows are written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir.rstrip("/")).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
