"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, media_columns, mixing, near_dup_join, packing, secret_scan, text_models, token_counts, url_filter
from .common import Tables, remove, shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"), keep="max")


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_quality(spark: SparkSession, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    weights = text_models.train_quality(docs, labels, where=remainder != 0)
    got = text_models.score_quality(docs, weights)
    return got.select("doc_id", (remainder == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_near_dup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup_join.components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs).select("doc_id", "source", "block", "slot", "position")


def op7_token_counts(spark: SparkSession, sf_dir: str, limit: int = 4096) -> DataFrame:
    # A cache of its own for each call, which goes with it: what a call costs is the cost of a corpus not seen before.
    cache = f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    got = token_counts.count(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), cache)
    out = Tables(spark).last(got.withColumn("over_limit", F.col("n_tokens") > limit), "counted")
    remove(spark, cache)
    return out


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secret_scan.scan(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return got.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(secret_scan.joined(F.col("base")), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"))


#: Documents labelled "toxic" are what is rejected; low quality comes first in the chain.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


def toxicity_chain(docs: DataFrame, labels: DataFrame) -> text_models.Chain:
    return text_models.train_chain(docs, labels, {k: F.expr(v) for k, v in CATEGORIES.items()})


#: Probability from which a document is rejected.
TOXIC = 0.4


def op9_toxicity(spark: SparkSession, sf_dir: str, threshold: float = TOXIC) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = text_models.score_chain(docs, toxicity_chain(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= threshold).alias("toxic"), (F.col("p_toxic") < threshold).alias("kept"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = media_columns.decode(media_columns.encode(table(spark, sf_dir, "documents")))
    n = F.octet_length("payload")
    return got.select(
        "doc_id", "n_bytes", n.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("png").cast("long").alias("media_bytes"), F.sha2("png", 256).alias("media_sha256"), F.lower(F.hex("dct_hash")).alias("feature"),
    )


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_packing, op2_exact_dedup, op3_url_filter, op4_quality, op5_near_dup_join, op6_mixing, op7_token_counts, op8_secret_scan, op9_toxicity, op10_media_columns)}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL}
