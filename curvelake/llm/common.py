"""What several operators share: reading tables, the shared folder, and hashing words of a batch of texts at once."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Classes of bytes: runs of a class other than 0 are words. Here words end at space and \t \n \v \f \r.
SPACED = np.ones(256, np.int8)
SPACED[[0x20, 9, 10, 11, 12, 13]] = 0
#: Letters, digits and all bytes of longer characters, against punctuation.
PUNCTUATED = np.array([0 if SPACED[b] == 0 else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], np.int8)
#: Only letters and all bytes of longer characters.
LETTERS = np.array([1 if b >= 128 or chr(b).isalpha() else 0 for b in range(256)], np.int8)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; where that is unset, a temporary one if Spark runs on this machine alone, and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="curvelake-"))
        at = spark.sparkContext.getCheckpointDir()
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and survives the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table in the shared folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Tables:
    """Intermediate tables of one operator in the shared folder, deleted when they have been used."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def add(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table: cuts the lineage, and survives the loss of executors."""
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later step reads. Other DataFrames are passed over."""
        for t in tables:
            if (found := self.paths.pop(id(t), None)) is not None:
                remove(self.spark, found[1])

    def last(self, df: DataFrame, name: str) -> DataFrame:
        """df as the one table that stays, for the caller. All others go, and shuffles that nothing refers to any more are given back."""
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.drop(*(t for t, _ in list(self.paths.values())))
        reclaim(self.spark)
        return out


def give_back() -> None:
    """Returns memory to the system that Arrow and the C library hold free in this process."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def reclaim(spark: SparkSession) -> None:
    """Gives back what the driver holds for nothing. Spark's cleaner then also deletes shuffle files of plans that nobody refers to: it acts after a collection in the driver's JVM."""
    gc.collect()
    give_back()
    spark._jvm.System.gc()


def spread_join(rows: DataFrame, few: DataFrame, key: str | list[str], by: str, salts: int) -> DataFrame:
    """rows, left-joined with few (one row a key at most). The rows of one key are spread over `salts` tasks by a hash of `by`; few is repeated as often."""
    salt = F.pmod(F.xxhash64(by, F.lit(3)), F.lit(salts)).cast("int")
    each = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", salt).join(each, [*([key] if isinstance(key, str) else key), "_salt"], "left").drop("_salt")


def released(run):
    """A function over batches that, when it has read them, gives memory back that Arrow and the C library hold: workers live on beside the next stages."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def cut(batches, rows: int = 500):
    """Batches of few rows, so that texts are copied to Python a few at a time."""
    for b in batches:
        for s in range(0, len(b), rows):
            yield b.slice(s, rows)


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def let(value: Column, use) -> Column:
    """use(value), with value computed once: an expression that a lambda names is computed again for every element."""
    return F.transform(F.array(value), use)[0]


def numbers(values) -> Column:
    """A constant array of doubles, as one small expression that Spark folds (a literal of a list has an expression for each element)."""
    return F.split(F.lit(",".join(repr(float(x)) for x in values)), ",").cast("array<double>")


#: An odd base, its inverse mod 2^64, and the multipliers of the finaliser.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 64, 256, np.uint64)
_POWERS = np.zeros(0, np.uint64)
_INVERSES = np.zeros(0, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, kept between batches."""
    global _POWERS, _INVERSES
    if len(_POWERS) <= n:
        m = max(n + (n >> 2), 1 << 20)
        up, down = np.full(m, _BASE, np.uint64), np.full(m, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _POWERS, _INVERSES = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS, _INVERSES


class Words:
    """The words of a batch of texts as arrays: the text each is of, where it starts and ends in the joined bytes, and its 64-bit hash."""

    def __init__(self, texts: list[bytes], classes: np.ndarray = SPACED):
        joined = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        kind = classes[joined]
        ends_of = np.cumsum(sizes + 1)
        kind[ends_of - 1] = 0
        flips = np.flatnonzero(np.diff(kind, prepend=np.int8(0), append=np.int8(0)))
        begins = kind[flips[:-1]] != 0
        self.start, self.end = flips[:-1][begins], flips[1:][begins]
        self.text = np.searchsorted(ends_of, self.start, "right")
        self.n = len(texts)
        up, self._down = _powers(len(joined) + 1)
        self._sums = np.zeros(len(joined) + 1, np.uint64)
        np.cumsum(_BYTE[joined] * up[: len(joined)], out=self._sums[1:])
        self.hash = self.span(self.start, self.end)
        #: words before each text, and the number of words of each
        self.first = np.searchsorted(self.text, np.arange(self.n + 1))
        self.count = np.diff(self.first)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of spans of bytes."""
        return mix((self._sums[end] - self._sums[start]) * self._down[start] + (end - start).astype(np.uint64))


def slices(texts: list[bytes], limit: int = 2 << 20, most: int = 1000):
    """Ranges of a batch, of at most `most` texts of about limit bytes: arrays over them stay small, whatever the batch."""
    begin = size = 0
    for i, x in enumerate(texts):
        if i > begin and (size + len(x) > limit or i - begin >= most):
            yield begin, i
            begin, size = i, 0
        size += len(x)
    if begin < len(texts):
        yield begin, len(texts)
