"""The corpus pipeline: language ID, near duplicates, benchmark decontamination, mixing to target weights, sharding.

Every stage takes all that its predecessor kept and returns a table like documents, the last one the shards. run() writes
each stage's rows to the shared folder and reads them again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracewright.llm import budget, crf, hilbert, pigeonhole, sigtree
from tracewright.llm.common import forget, read, small, written

#: Near duplicates here take five words and a similarity of 0.8.
SHINGLE, PERCENT = 5, 80
#: A document whose words agree on no language to this degree is rejected.
LEAST_SCORE = 0.4
#: The part of the tokens that the mixture takes; no document is taken twice.
SHARE = 0.7
SHARDS = 40


def text_key(docs: DataFrame) -> Column:
    """What a text is known by between stages (64 bits), so that rows need not go through Python or a shuffle for what is decided on their text."""
    return F.xxhash64(docs["text"])


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs but those whose text's key is in keys (a column doc_id); all columns stay as they are, whatever their names."""
    gone = small(written(keys.distinct(), "gone"))
    return docs.join(gone, text_key(docs) == gone["doc_id"], "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters (null texts too) and those whose best language has a mean marginal under LEAST_SCORE."""
    found = crf.predict(docs.select(text_key(docs).alias("doc_id"), docs["text"]), crf.train(docs), ["doc_id"])
    return without(docs, found.filter((F.col("lang_pred") == "und") | (F.col("score") < LEAST_SCORE)).select("doc_id"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the least id stays."""
    return sigtree.one_of_each(docs, PERCENT, SHINGLE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go. They are known by their text, so ids may be null or repeat."""
    found = pigeonhole.leaks(docs.select(text_key(docs).alias("doc_id"), docs["text"]), read(spark, sf_dir, "benchmark"))
    return without(docs, found.select("doc_id"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the hierarchical budgets select; the one at a leaf's end stays whole, and so do rows equal to one taken in id and text."""
    key = F.concat_ws(":", F.coalesce(docs["doc_id"].cast("string"), F.lit("null")), F.xxhash64(docs["text"]).cast("string"))
    tree = budget.with_tree(docs.select(key.alias("doc_id"), docs["lang"], docs["source"], docs["text"]))
    mixed = budget.hierarchical_mix(tree, budget.LEVELS, budget.WEIGHTS, share=SHARE, max_epochs=1)
    taken = small(written(mixed.filter("full_epochs > 0 OR part_tokens > 0").select(F.col("doc_id").alias("its_key")).distinct(), "taken"))
    return docs.join(taken, key == taken["its_key"], "left_semi")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, size, text_crc32, cell, shard, slot: runs along the Hilbert curve."""
    return hilbert.hilbert_shards(docs, SHARDS)


STAGES = [("language ID", language_id), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: Learned models and set similarity are beyond SQL; tests/llm hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
