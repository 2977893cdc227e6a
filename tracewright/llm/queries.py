"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import additive, budget, crf, gru, hilbert, huffman, pigeonhole, sigtree, suffix, urllists
from .common import read


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive.nearest(read(spark, sf_dir, "embeddings"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hilbert.hilbert_shards(read(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.identify(read(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return urllists.evaluate(urllists.demo_captures(pages), urllists.demo_entries(pages))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, lengths = huffman.encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return huffman.read_blocks(spark, path, lengths)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(read(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigtree.near_duplicates(read(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.hierarchical_mix(budget.with_tree(read(spark, sf_dir, "documents")), budget.LEVELS, budget.WEIGHTS)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru.score_documents(read(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pigeonhole.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {"op1_additive_ann": op1, "op2_hilbert_shards": op2, "op3_crf_language": op3, "op4_url_lists": op4, "op5_huffman_tokens": op5, "op6_suffix_dedup": op6, "op7_signature_tree_join": op7, "op8_hierarchical_mix": op8, "op9_gated_lm": op9, "op10_pigeonhole_leaks": op10}


def oracle_sql() -> dict[str, str]:
    return {"op4_url_lists": urllists.ORACLE, "op8_hierarchical_mix": budget.ORACLE}
