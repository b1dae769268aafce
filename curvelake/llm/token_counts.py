"""Token counts through a digest cache.

Method: each text is reduced to the SHA-256 of its normalised content; the tokenizer's version is the SHA-256 of its model file and the
library's version. The cache is a Parquet table of (version, digest, n_tokens). Counts are stored for what it has; the distinct contents that it
lacks are encoded once each and appended. Equal texts meet by digest after a partial aggregate, so a hot text moves once a partition.

The library encodes whole texts, or, where that is provably the same, the space-separated chunks of a text once each with their counts
summed: in this model no piece has its word mark anywhere but in front, the normaliser is the identity with one mark put in front, so no merge
crosses a single space. Texts with runs of spaces, a space at an end, or the mark itself go to the library whole. The chunks' counts are kept
in a table of bounded size in each worker.

Cases: a null text counts as empty; an empty text has 0 tokens. Repeated rows give repeated results. Extra columns are not read; an empty table
gives an empty result and appends nothing. Special strings inside texts are ordinary text, as is the library's default.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, released, text_or_empty

MARK = "▁"
#: Chunks whose counts a worker keeps, of at most so many characters each: about 64 MB.
KEPT, LONGEST = 400_000, 48


def version(path: str) -> str:
    import sentencepiece

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"sentencepiece " + sentencepiece.__version__.encode()).hexdigest()


class Counter:
    """Counts of whole texts by sentencepiece."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        n = spec.normalizer_spec
        plain = not n.precompiled_charsmap and n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces
        usual = {1, 2, 3, 6}  # normal, unknown, control, byte
        self.by_chunk = plain and all(p.type in usual and MARK not in p.piece.lstrip(MARK) for p in spec.pieces)
        self.kept: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> list[int]:
        out, chunks, whole = [0] * len(texts), {}, []
        for i, x in enumerate(texts):
            if not x:
                continue
            if not self.by_chunk or x[0] == " " or x[-1] == " " or "  " in x or MARK in x:
                whole.append(i)
            else:
                chunks[i] = x.split(" ")
        kept, rest = self.kept, {}
        if len(kept) >= KEPT:
            kept.clear()
        miss = list({c for cs in chunks.values() for c in cs if c not in kept})
        for s in range(0, len(miss), 10_000):
            part = miss[s : s + 10_000]
            for c, ids in zip(part, self.model.encode(part, num_threads=1)):
                (kept if len(c) <= LONGEST and len(kept) < KEPT else rest)[c] = len(ids)
        for i, cs in chunks.items():
            out[i] = sum([kept[c] if c in kept else rest[c] for c in cs]) if rest else sum(map(kept.__getitem__, cs))
        for i in whole:
            out[i] = len(self.model.encode(texts[i]))
        return out


@functools.cache
def counter(path: str) -> Counter:
    """One for each worker process, so that later tasks find what earlier ones kept."""
    return Counter(path)


def encode_counts(path: str):
    """digest, _text -> digest, n_tokens."""

    def run(batches):
        count = counter(path)
        for part in cut(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count(part.column(1).to_pylist()), pa.int64())], names=["digest", "n_tokens"])

    return run


def cached(spark, path: str) -> DataFrame | None:
    """The cache's rows; None while nothing has been appended."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p) or not any(x.getPath().getName().endswith(".parquet") for x in fs.listStatus(p)):
        return None
    return spark.read.schema("version string, digest binary, n_tokens long").parquet(path)


def count(df: DataFrame, model: str, cache: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes and n_tokens of each row. cache: a folder that all executors share; misses are appended to it."""
    spark, v = df.sparkSession, version(model)
    t = text_or_empty(text)
    rows = df.select(F.col(id).alias(id), F.octet_length(t).cast("long").alias("n_bytes"), F.unhex(F.sha2(t, 256)).alias("digest"), t.alias("_text"))
    have = cached(spark, cache)
    want = rows.select("digest", "_text")
    if have is not None:
        want = want.join(have.where(F.col("version") == v).select("digest"), "digest", "left_anti")
    misses = want.groupBy("digest").agg(F.first("_text").alias("_text"))
    misses.mapInArrow(released(encode_counts(model)), "digest binary, n_tokens long").select(F.lit(v).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)
    counts = spark.read.schema("version string, digest binary, n_tokens long").parquet(cache).where(F.col("version") == v).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))
    return rows.drop("_text").join(counts, "digest").select(id, "n_bytes", "n_tokens")
