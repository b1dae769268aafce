"""Exact dedup: a tree-merge of sorted digest runs.

Method: each input partition makes sorted runs of (digest, length, check, keeper, count), with one record for each distinct text of a run; a run is held in memory and
ends at RUN records. Runs live on P nodes, P a power of the radix, and travel as packed blocks of at most BLOCK records. In binomial round k the nodes whose numbers differ
in digit k exchange parts of their runs: a record goes to the node whose digit k is that of the digest's owner, and the parts stay sorted. Each node merges all runs that
it gets in one pass (multiway): blocks come by their first digest, so what is below the next block's first digest is final and goes out, with equal verified digests made one,
keeping the one identifier that stays and the sum of the counts. After log_r(P) rounds each digest is on its owner alone. No round sorts records that were sorted
before: Spark orders blocks only, by their first digest. Memory holds one block of each run at most, and a group with a third of all rows sends a node one record a run.

"Verified": equal texts must agree in SHA-256, in length in bytes and in a second, independent 64-bit hash; rows that agree in the first only stay apart.
The identifier that stays is the smallest (keep="min") or the largest (keep="max").

Cases: a null text counts as empty, and empty texts are copies of each other. A null id is no identifier while a copy has one; of copies that all lack one, all stay. Ties (a
repeated doc_id) count as rows of the group: each is returned, and each that carries the keeper's id is kept. Texts that differ under one id are judged each for itself. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, released, spread_join, text_or_empty

RADIX = 2
#: Records of a run, and of a block, at most.
RUN, BLOCK = 200_000, 4096
#: Tasks over which the rows of one text are spread when they are joined with their group.
SALTS = 16
RECORD = np.dtype([("digest", "S32"), ("n_bytes", "<i8"), ("check", "<i8"), ("keeper", "<i8"), ("named", "<i8"), ("n", "<i8")])
BLOCKS = "node int, first binary, block binary"
GROUPS = "digest binary, n_bytes int, check long, keeper long, n long"
_KEY = ["digest", "n_bytes", "check"]


def digests(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, the SHA-256 of each text, and what verifies it."""
    t = text_or_empty(text)
    return df.select(F.col(id).alias(id), F.unhex(F.sha2(t, 256)).alias("digest"), F.octet_length(t).alias("n_bytes"), F.xxhash64(t).alias("check"))


def merged(runs: list[np.ndarray], keep: str) -> np.ndarray:
    """Sorted runs as one, with one record for each verified digest. named: how many rows have an id."""
    x = np.concatenate(runs) if len(runs) > 1 else runs[0]
    if len(runs) > 1:
        x = x[np.lexsort((x["check"], x["n_bytes"], x["digest"]))]
    if not len(x):
        return x
    new = np.ones(len(x), bool)
    new[1:] = (x["digest"][1:] != x["digest"][:-1]) | (x["n_bytes"][1:] != x["n_bytes"][:-1]) | (x["check"][1:] != x["check"][:-1])
    if new.all():
        return x
    starts = np.flatnonzero(new)
    out = x[starts].copy()
    for c, f in (("keeper", np.minimum if keep == "min" else np.maximum), ("named", np.add), ("n", np.add)):
        out[c] = f.reduceat(x[c], starts)
    return out


def _owner(x: np.ndarray, nodes: int) -> np.ndarray:
    head = np.ascontiguousarray(x["digest"]).view(np.uint8).reshape(len(x), 32)[:, :4].astype(np.int64)
    return (head @ np.array([1 << 24, 1 << 16, 1 << 8, 1])) % nodes


def _first(x: np.void) -> bytes:
    return bytes(x["digest"]).ljust(32, b"\0")


def _blocks(x: np.ndarray, to: np.ndarray):
    """A sorted run's blocks for the nodes that its records go to."""
    for node in np.unique(to):
        part = x[to == node]
        for s in range(0, len(part), BLOCK):
            b = part[s : s + BLOCK]
            yield int(node), _first(b[0]), b.tobytes()


def _batches(blocks):
    """Rows of blocks as small batches."""
    held = []
    for b in blocks:
        held.append(b)
        if len(held) >= 64:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), (pa.int32(), pa.binary(), pa.binary()))], names=["node", "first", "block"])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), (pa.int32(), pa.binary(), pa.binary()))], names=["node", "first", "block"])


def _step(x: np.ndarray, node: int, nodes: int, step: int, radix: int) -> np.ndarray:
    """Where records on a node go in a round."""
    return node + ((_owner(x, nodes) // step) % radix - (node // step) % radix) * step


def first_runs(keep: str, nodes: int, radix: int):
    """A partition's rows as sorted runs, dealt for the first round; batches are merged as they come, so copies inside a partition never pile up."""

    def run(batches):
        node, worst = TaskContext.get().partitionId() % nodes, np.iinfo(np.int64).max if keep == "min" else np.iinfo(np.int64).min

        def blocks():
            held, waiting = [], 0
            for b in batches:
                x = np.zeros(len(b), RECORD)
                x["digest"], x["n_bytes"], x["check"] = b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(2).to_numpy()
                x["keeper"], x["named"], x["n"] = b.column(3).fill_null(worst).to_numpy(), b.column(3).is_valid().to_numpy(zero_copy_only=False), 1
                held.append(merged([x[:0], x], keep))
                waiting += len(held[-1])
                if waiting > RUN:
                    held = [merged(held, keep)]
                    waiting = len(held[0])
                    if waiting > RUN // 2:
                        yield from _blocks(held[0], _step(held[0], node, nodes, 1, radix))
                        held, waiting = [], 0
            if held:
                x = merged(held, keep) if len(held) > 1 else held[0]
                yield from _blocks(x, _step(x, node, nodes, 1, radix))

        yield from _batches(blocks())

    return run


def multiway(batches, keep: str):
    """A node's blocks, by their first digest -> sorted parts with equal digests made one, in order. All below the next block's first digest is final."""
    held: list[np.ndarray] = []
    rest = 0
    for b in batches:
        for first, raw in zip(b.column(1).to_pylist(), b.column(2)):
            block = np.frombuffer(raw.as_py(), RECORD)
            if sum(map(len, held)) > BLOCK + 2 * rest:
                all_ = merged(held, keep)
                final = int(np.searchsorted(all_["digest"], np.bytes_(first)))
                if final:
                    yield all_[:final]
                held = [all_[final:]] if final < len(all_) else []
                rest = len(all_) - final
            held.append(block)
    if held:
        yield merged(held, keep)


def merge_runs(keep: str, nodes: int, step: int, radix: int):
    """A node's runs merged and dealt for the round of `step`; or, where step is none, as rows."""

    def run(batches):
        node = TaskContext.get().partitionId()
        if step < nodes:
            yield from _batches(b for x in multiway(batches, keep) for b in _blocks(x, _step(x, node, nodes, step, radix)))
            return
        for x in multiway(batches, keep):
            keeper = pa.array(x["keeper"], mask=x["named"] == 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([_first(r) for r in x], pa.binary()), pa.array(x["n_bytes"].astype(np.int32)), pa.array(x["check"]), keeper, pa.array(x["n"])], names=[*_KEY, "keeper", "n"]
            )

    return run


def merge_tree(rows: DataFrame, id: str, keep: str = "min", radix: int = RADIX, nodes: int | None = None) -> DataFrame:
    """rows: those of digests(). One row for each verified digest: digest, n_bytes, check, keeper (null where no row has an id), n."""
    want, rounds = nodes or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1
    while radix**rounds < want:
        rounds += 1
    nodes = radix**rounds
    level = rows.select(*_KEY, F.col(id).cast("long").alias("keeper")).mapInArrow(released(first_runs(keep, nodes, radix)), BLOCKS)
    for k in range(1, rounds + 1):
        level = level.repartitionById(nodes, "node").sortWithinPartitions("first").mapInArrow(released(merge_runs(keep, nodes, radix**k, radix)), BLOCKS if k < rounds else GROUPS)
    return level


def dedup(df: DataFrame, id: str = "doc_id", text: str = "text", keep: str = "min") -> DataFrame:
    """One row for each of df: id, keep_id (the row that stays), group_size, kept, text_sha256."""
    tables = Tables(df.sparkSession)
    rows = digests(df, id, text)
    # Only groups of several rows are joined; a hot one is spread.
    groups = tables.add(merge_tree(rows, id, keep).where("n > 1"), "digests")
    out = spread_join(rows, groups, _KEY, id, SALTS)
    kind = dict(df.dtypes)[id]
    keeper = F.when(F.col("n").isNull(), F.col(id)).otherwise(F.col("keeper").cast(kind))
    return out.select(
        F.col(id), keeper.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col(id).eqNullSafe(keeper).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def kept(df: DataFrame, id: str = "doc_id", text: str = "text", keep: str = "min") -> DataFrame:
    """df's rows that stay, with df's columns. What goes is named by id and digest together, so a text under an id that another text has too is judged for itself."""
    gone = dedup(df, id, text, keep).where(~F.col("kept")).select(F.col(id).alias("_gone"), F.unhex("text_sha256").alias("_digest")).distinct()
    return df.join(gone, df[id].eqNullSafe(F.col("_gone")) & (F.unhex(F.sha2(text_or_empty(df[text]), 256)) == F.col("_digest")), "left_anti")
