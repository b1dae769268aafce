"""Mixing sources to target weights by Pfair scheduling.

Method: the rows of each source are ordered by a hash and cut into blocks of a fixed number of rows. Target weights become whole parts k of about PARTS in all. In the ideal, fluid
mix all sources run together, each at k blocks a round, until it has no more; those that are left then share the slots anew. So by round u source s has had
min(k u, its blocks) blocks, and slots count t(u), the sum of these over all sources. Its j-th block (from 1) is released at slot floor(t((j - 1) / k)) and due by
slot ceil(t(j / k)); in each slot earliest-deadline-first takes among the released blocks the one that is due first. The fluid mix itself gives each block one slot's worth between its
release and deadline, so earliest-deadline-first meets all deadlines, and at any slot each source has had its ideal to within less than one block: to the end, also when sources run out,
as nothing is forgotten when they do. No row is dropped, capped or repeated.

At whole rounds the ideal is a whole number of blocks of each source, so every source is even there and rounds can be scheduled each for itself: a block's round is floor((j - 1) / k), and the
rounds are dealt to tasks, each of which reads its blocks round by round (a round has PARTS blocks and one a source at most). Nothing of the schedule is made on the driver: blocks, their
slots and the rows before them are tables, and sums over rounds are taken in two steps.

Ranks come without a global sort or a task for a whole source: each source is cut by the hash into cells of about CELL rows; the small table of
cells (one row for CELL rows) is summed up by source in two steps, and rows are ranked within their cell. The slots of the blocks that a cell has rows of are brought to the cell's row,
not rows to their blocks: so rows, with all their columns, are shuffled by cell and no second time, at any size.

Cases: a null source is a source of its own; a null id is ranked by its hash like any other. Ties and repeated rows are ranked one after the other. A
source with no target weight gets the smallest weight that was given, and one whose weight is below one part gets one part; weights of absent sources are ignored. Extra columns are passed through by `mix`; names starting with
"_mix_" are taken. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from fractions import Fraction
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, released, spread_join

CELL = 2048
BLOCK = 16
#: Parts that all weights together come to, about: the resolution of target weights.
PARTS = 1024
#: Blocks of a source that one row stands for until they are dealt to tasks; tasks over which a source's rows are spread in joins.
STRETCH, SALTS = 4096, 16


def windows(blocks: dict, parts: dict) -> list[tuple[int, int, object, int]]:
    """(release, deadline, source, i) of a round's blocks: blocks[s] <= parts[s] of source s, the i-th (from 1) of which the fluid mix runs from i - 1 to i parts[s]-ths of the round."""
    # Sources with fewer blocks than parts run out within the round.
    short = sorted((Fraction(n, parts[s]), n, parts[s]) for s, n in blocks.items() if n < parts[s])
    ends, had, rate = [e for e, _, _ in short], [0], [sum(parts[s] for s in blocks)]
    for _, n, k in short:
        had.append(had[-1] + n)
        rate.append(rate[-1] - k)

    def slots(i: int, k: int) -> tuple[int, int]:
        """t at i / k of the round, rounded down and up."""
        gone = bisect_left(ends, Fraction(i, k)) if ends else 0
        return had[gone] + rate[gone] * i // k, had[gone] - (-rate[gone] * i // k)

    return [(slots(i - 1, parts[s])[0], slots(i, parts[s])[1], s, i) for s, n in blocks.items() for i in range(1, n + 1)]


def earliest_deadline_first(jobs: list[tuple]) -> list[tuple]:
    """Jobs (release, deadline, ..) in the order in which they run, one a slot. Equal deadlines go by what follows."""
    out, ready, at = [], [], 0
    jobs = sorted(jobs)
    for slot in range(len(jobs)):
        while at < len(jobs) and jobs[at][0] <= slot:
            heapq.heappush(ready, (jobs[at][1:], jobs[at]))
            at += 1
        out.append(heapq.heappop(ready)[1])
    return out


def pfair(blocks: dict, parts: dict) -> list:
    """The source of each slot, for blocks[s] blocks of source s at parts[s] a round: all rounds one after the other, as `mix` deals them to tasks."""
    out: list = []
    names = {i: s for i, s in enumerate(blocks)}
    for u in range(max((-(-n // parts[s]) for s, n in blocks.items()), default=0)):
        has = {i: min(parts[s], blocks[s] - parts[s] * u) for i, s in names.items() if blocks[s] > parts[s] * u}
        out += [names[j[2]] for j in earliest_deadline_first(windows(has, {i: parts[names[i]] for i in has}))]
    return out


def scheduled(batches):
    """key, round, block, parts, rows of blocks by round, key and block -> key, block, round, index in the round, rows before it there."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    for u, group in groupby(rows, key=lambda r: r[1]):
        has, of = {}, {}
        parts = {}
        for key, _, block, k, n in group:
            has[key], parts[key] = has.get(key, 0) + 1, k
            of[(key, has[key])] = (block, n)
        out, before = [], 0
        for i, (_, _, key, j) in enumerate(earliest_deadline_first(windows(has, parts))):
            block, n = of[(key, j)]
            out.append((key, block, u, i, before))
            before += n
        for s in range(0, len(out), 10_000):
            cols = list(zip(*out[s : s + 10_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), *[pa.int64()] * 4))], names=["_mix_key", "block", "_mix_round", "_mix_i", "_mix_before"])


def _before(value: str, by: list[str], order: str) -> Column:
    """The sum of value over the rows before."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def running(rows: DataFrame, by: list[str], order: str, values: dict[str, str]) -> DataFrame:
    """rows (one for each by and order) with, for each value, its sum over the rows before under the name it maps to: first over groups of CELL numbers, then within them."""
    rows = rows.withColumn("_mix_group", F.floor(F.col(order) / CELL))
    groups = rows.groupBy(*by, "_mix_group").agg(*(F.sum(v).alias(f"_mix_sum_{v}") for v in values))
    groups = groups.select(*by, "_mix_group", *(_before(f"_mix_sum_{v}", by, "_mix_group").alias(f"_mix_base_{v}") for v in values))
    out = rows.join(groups, [*by, "_mix_group"])
    sums = {new: F.col(f"_mix_base_{v}") + _before(v, [*by, "_mix_group"], order) for v, new in values.items()}
    return out.select("*", *(c.alias(n) for n, c in sums.items())).drop("_mix_group", *(f"_mix_base_{v}" for v in values))


def _named(source: str) -> Column:
    """A source as a string that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def sources(df: DataFrame, weights: dict | None, power: float, source: str, block: int, parts: int) -> DataFrame:
    """_mix_key, _mix_n (rows), _mix_k (parts), _mix_blocks of each source. Without weights, a source weighs its size to the given power: 1 keeps shares, 0 makes them equal."""
    rows = df.groupBy(_named(source).alias("_mix_key")).agg(F.count("*").alias("_mix_n"))
    if weights:
        given = df.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items() if w and w > 0], f"{source} {dict(df.dtypes)[source]}, _mix_w double")
        least = given.agg(F.min("_mix_w").alias("_mix_least"))
        rows = rows.join(given.select(_named(source).alias("_mix_key"), "_mix_w"), "_mix_key", "left").join(F.broadcast(least)).withColumn("_mix_w", F.coalesce("_mix_w", "_mix_least", F.lit(1.0))).drop("_mix_least")
    else:
        rows = rows.withColumn("_mix_w", F.pow("_mix_n", F.lit(power)))
    # Shares of whole millionths of the largest weight, so that their sum doesn't depend on the order in which it is taken.
    most = rows.agg(F.max("_mix_w").alias("_mix_most"))
    rows = rows.join(F.broadcast(most)).withColumn("_mix_w", F.greatest(F.lit(1), F.round(F.col("_mix_w") / F.col("_mix_most") * 1e6)).cast("decimal(38,0)"))
    total = rows.agg(F.sum("_mix_w").alias("_mix_total"))
    k = F.greatest(F.lit(1), F.round(F.col("_mix_w").cast("double") * parts / F.col("_mix_total").cast("double"))).cast("long")
    return rows.join(F.broadcast(total)).select("_mix_key", "_mix_n", k.alias("_mix_k"), F.ceil(F.col("_mix_n") / block).alias("_mix_blocks"))


def celled(df: DataFrame, known: DataFrame, source: str, id: str) -> tuple[DataFrame, DataFrame]:
    """df with _mix_key, _mix_cell and _mix_u (a hash of the id), and its cells: _mix_key, _mix_cell, _mix_n (rows) and _mix_offset (rows of the source before them)."""
    cells = F.greatest(F.lit(1), F.ceil(F.col("_mix_n") / CELL)).alias("_mix_cells")
    uniform = F.shiftrightunsigned(F.xxhash64(F.col(id), F.lit(11)), 32)  # 32 bits
    rows = df.withColumn("_mix_key", _named(source)).withColumn("_mix_u", uniform)
    rows = spread_join(rows, known.select("_mix_key", cells), "_mix_key", "_mix_u", SALTS)
    rows = rows.withColumn("_mix_cell", F.shiftright(F.col("_mix_u") * F.col("_mix_cells"), 32)).drop("_mix_cells")
    return rows, running(rows.groupBy("_mix_key", "_mix_cell").agg(F.count("*").alias("_mix_n")), ["_mix_key"], "_mix_cell", {"_mix_n": "_mix_offset"})


def schedule(known: DataFrame, block: int) -> DataFrame:
    """_mix_key, block, slot, _mix_at (rows of the mix before it) of every block."""
    tasks = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretches = known.withColumn("_mix_s", F.explode(F.sequence(F.lit(0), F.floor((F.col("_mix_blocks") - 1) / STRETCH)))).repartition(tasks, "_mix_key", "_mix_s")
    end = F.least(F.col("_mix_blocks"), (F.col("_mix_s") + 1) * STRETCH) - 1
    blocks = stretches.withColumn("block", F.explode(F.sequence(F.col("_mix_s") * STRETCH, end)))
    rows = F.least(F.lit(block), F.col("_mix_n") - F.col("block") * block).cast("long")
    blocks = blocks.select("_mix_key", F.floor(F.col("block") / F.col("_mix_k")).alias("_mix_round"), "block", "_mix_k", rows.alias("_mix_rows"))
    by_round = blocks.repartition(tasks, "_mix_round").sortWithinPartitions("_mix_round", "_mix_key", "block")
    slots = by_round.mapInArrow(released(scheduled), "_mix_key string, block long, _mix_round long, _mix_i long, _mix_before long")
    sizes = blocks.groupBy("_mix_round").agg(F.count("*").alias("_mix_slots"), F.sum("_mix_rows").alias("_mix_rows"))
    starts = running(sizes, [], "_mix_round", {"_mix_slots": "_mix_slot", "_mix_rows": "_mix_row"}).select("_mix_round", "_mix_slot", "_mix_row")
    return slots.join(starts, "_mix_round").select("_mix_key", "block", (F.col("_mix_slot") + F.col("_mix_i")).alias("slot"), (F.col("_mix_row") + F.col("_mix_before")).alias("_mix_at"))


def mix(df: DataFrame, weights: dict | None = None, source: str = "source", id: str = "doc_id", block: int = BLOCK, power: float = 0.5, parts: int = PARTS) -> DataFrame:
    """df with block (in its source, from 0), slot (of the block, from 0) and position (of the row in the mix, from 0, gapless)."""
    df = df.drop(*({"block", "slot", "position"} - {source, id}))
    # One row a source, as a table: it is read at each step, and the input is counted once.
    known = Tables(df.sparkSession).add(sources(df, weights, power, source, block, parts), "sources")
    rows, cells = celled(df, known, source, id)
    # A cell's blocks follow each other: the i-th of its slots is that of the i-th block it has rows of.
    first, last = (F.floor(x / block) for x in (F.col("_mix_offset"), F.col("_mix_offset") + F.col("_mix_n") - 1))
    slots = cells.select("_mix_key", "_mix_cell", "_mix_offset", F.explode(F.sequence(first, last)).alias("block")).join(schedule(known, block), ["_mix_key", "block"])
    slots = slots.groupBy("_mix_key", "_mix_cell", "_mix_offset").agg(F.sort_array(F.collect_list(F.struct("block", "slot", "_mix_at"))).alias("_mix_slots"))
    slots = slots.select("_mix_key", "_mix_cell", "_mix_offset", *(F.col(f"_mix_slots.{c}").alias(n) for c, n in (("slot", "_mix_slots"), ("_mix_at", "_mix_ats"))))
    within = F.row_number().over(Window.partitionBy("_mix_key", "_mix_cell").orderBy("_mix_u", id)) - 1
    out = rows.withColumn("_mix_within", within).join(slots, ["_mix_key", "_mix_cell"])
    out = out.withColumn("_mix_rank", F.col("_mix_offset") + F.col("_mix_within")).withColumn("_mix_block", F.floor(F.col("_mix_rank") / block))
    i = (F.col("_mix_block") - F.floor(F.col("_mix_offset") / block)).cast("int")
    return out.select(*df.columns, F.col("_mix_block").alias("block"), F.get("_mix_slots", i).alias("slot"), (F.get("_mix_ats", i) + F.col("_mix_rank") % block).alias("position"))
