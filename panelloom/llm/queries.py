"""The registered queries of this package: operators with their production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm import collocations, decontaminate, gnat, kdtree, lines, paragraphs, pieces, quality, sharding, sigtree, substrings, toxicity, urls
from panelloom.sources.tables import Tables

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def llm_query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        LLM_QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql:
            LLM_ORACLES[name] = sql
        return build

    return register


SHARDS = 16


@llm_query("op10_weighted_tree_shards")
def op10_weighted_tree_shards(t: Tables) -> DataFrame:
    return sharding.assign(t.documents, sharding.even_tree(SHARDS), sharding.even_tree(SHARDS + 1)).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.col("grown_shard").cast("int").alias("grown_shard"))


@llm_query("op7_line_dedup", lines.SQL)
def op7_line_dedup(t: Tables) -> DataFrame:
    return lines.dedup_lines(t.documents).select("doc_id", "n_lines", "n_dropped", F.sha2(lines.joined(), 256).alias("kept_sha256"))


@llm_query("op3_benchmark_decontamination", decontaminate.SQL)
def op3_benchmark_decontamination(t: Tables) -> DataFrame:
    ids = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return decontaminate.contamination(t.documents, t.benchmark).select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "contaminated")


URL_RULES = [
    urls.Rule("allow", "org", "/"),
    urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"),
    urls.Rule("block", "com", "/de/"),
]


@llm_query("op9_url_trust")
def op9_url_trust(t: Tables) -> DataFrame:
    return urls.judge(t.pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


@llm_query("op6_quality_rules")
def op6_quality_rules(t: Tables) -> DataFrame:
    model = quality.fit(t.documents, t.labels)
    return quality.judge(t.documents.select("doc_id", "text"), model).select(
        "doc_id", *quality.MEASURES, "base_failed", "kept", "probability")


TOXIC_FROM = 0.3


@llm_query("op8_toxicity_lexicon")
def op8_toxicity_lexicon(t: Tables) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string")) % 4
    held_out = F.coalesce(remainder == 2, F.lit(False))
    lexicon = toxicity.learn(t.documents, t.labels, allowed=~held_out)
    return toxicity.score(t.documents.select("doc_id", "text"), lexicon).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "n_matches")


# The vocabulary stays where its package installs it.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@llm_query("op5_sentencepiece")
def op5_sentencepiece(t: Tables) -> DataFrame:
    return pieces.encode(t.documents, PIECE_MODEL)


@llm_query("op1_suffix_array_dedup")
def op1_suffix_array_dedup(t: Tables) -> DataFrame:
    return substrings.dedup_substrings(t.documents).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@llm_query("op2_signature_tree_jaccard")
def op2_signature_tree_jaccard(t: Tables) -> DataFrame:
    return sigtree.near_duplicates(t.documents)


@llm_query("op4_paragraph_minhash")
def op4_paragraph_minhash(t: Tables) -> DataFrame:
    return paragraphs.dedup_paragraphs(t.documents)


@llm_query("op11_gnat_hard_negatives", gnat.SQL)
def op11_gnat_hard_negatives(t: Tables) -> DataFrame:
    moved = F.col("vec_id") % 7 == 0
    label = F.when(moved, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    index = gnat.build(t.embeddings, label)
    return gnat.mine(index, t.embeddings.where("vec_id % 50 = 0"), label).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@llm_query("op12_collocation_stripes", collocations.SQL)
def op12_collocation_stripes(t: Tables) -> DataFrame:
    return collocations.collocations(t.documents)


@llm_query("op13_kdtree_topk", kdtree.SQL)
def op13_kdtree_topk(t: Tables) -> DataFrame:
    index = kdtree.build(t.embeddings)
    return kdtree.top_k(index, t.embeddings.where("vec_id % 100 = 0")).select(F.col("q_id").alias("query_id"), "rank", "vec_id", "score")
