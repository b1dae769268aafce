"""A corpus from raw documents to packed sequences: STAGES in order, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelake.llm import exact_dedup, mixing, near_dup_join, packing, registry, text_models
from curvelake.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain doesn't take for toxic. The chain is fitted on the labels of the documents at hand."""
    chain = registry.toxicity_chain(docs, table(spark, sf_dir, "labels"))
    return text_models.without_toxic(docs, chain, registry.TOXIC).select(*COLUMNS)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id."""
    return exact_dedup.kept(docs, keep="max").select(*COLUMNS)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links join the document with the smallest id."""
    return near_dup_join.kept(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files and rows in the order of the mix, with their position in it for the stage that packs."""
    mixed = mixing.mix(docs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(parts, "position").sortWithinPartitions("position").select(*COLUMNS, "position")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences in the order of the mix (of documents that have no position, in any order)."""
    got = packing.pack(docs, registry.tokenizer("word_bpe_49k.json"), position="position" if "position" in docs.columns else None)
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("exact dedup", dedup), ("n-gram Jaccard join", near_dup), ("mixing", mix), ("packing", pack)]

#: No stage but the second can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage-" + name.replace(" ", "-"))
    return docs
