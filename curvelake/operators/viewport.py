"""Viewport queries: curve ranges that reach the Parquet reader, then the exact test."""

from __future__ import annotations

import functools
import operator
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.curves import Extent, level_for, merge_ranges, xz_ranges, z_ranges

FEATURE_LIMIT = 650_000
#: Up to so many ranges are a filter that readers push down; more are joined.
INLINE_RANGES = 500


def code_literal(v: int) -> Column:
    """A code as a constant: codes of 64 bits are decimals."""
    return F.lit(v) if v < 1 << 63 else F.lit(Decimal(v))


def in_ranges(code: str | Column, ranges: list[tuple[int, int]]) -> Column:
    code = F.col(code) if isinstance(code, str) else code
    if not ranges:
        raise ValueError("a curve filter needs at least one range")
    return functools.reduce(operator.or_, (code.between(code_literal(s), code_literal(e)) if s < e else code == code_literal(s) for s, e in ranges))


def filter_ranges(df: DataFrame, code: str, ranges: list[tuple[int, int]], lower: str | None = None, lowers: list[int] | None = None) -> DataFrame:
    """Rows whose code is in a range. lower, lowers: the partition column and its values, so that whole directories are skipped."""
    if not ranges:
        return df.limit(0)
    if lower and lowers:
        ends = [*lowers[1:], None]
        # Codes below the first bound are in the first partition.
        hit = [lo for i, (lo, hi) in enumerate(zip(lowers, ends)) if any((e >= lo or i == 0) and (hi is None or s < hi) for s, e in ranges)]
        df = df.where(F.col(lower).isin([Decimal(h) if h >= 1 << 63 else h for h in hit]))
    if len(ranges) <= INLINE_RANGES:
        return df.where(in_ranges(code, ranges))
    small = df.sparkSession.createDataFrame([(Decimal(s), Decimal(e)) for s, e in ranges], "_s decimal(20,0), _e decimal(20,0)")
    if ranges[-1][1] < 1 << 63:
        small = small.select(F.col("_s").cast("long").alias("_s"), F.col("_e").cast("long").alias("_e"))
    # Ranges are made on the driver, by a traversal of bounded depth, so their table is small.
    return df.where(F.col(code).between(code_literal(ranges[0][0]), code_literal(ranges[-1][1]))).join(F.broadcast(small), F.col(code).between(F.col("_s"), F.col("_e")), "left_semi")


def intersects(box: dict[str, Column] | Column, extents: list[Extent]) -> Column:
    """Closed test of a box against any of the extents."""
    get = (lambda k: box[k]) if not isinstance(box, str) else (lambda k: F.col(f"{box}.{k}"))
    tests = [(get("xmin") <= e.xmax) & (get("xmax") >= e.xmin) & (get("ymin") <= e.ymax) & (get("ymax") >= e.ymin) for e in extents]
    return functools.reduce(operator.or_, tests) if tests else F.lit(False)


def xz_query(df: DataFrame, code: str, box: Column | dict, extents: list[Extent], full: Extent, depth: int = 20) -> DataFrame:
    """Boxes that meet the extents, found through their XZ codes. Edges that only touch are found where the code's cell reaches past the edge: the ranges are planned for extents a hair larger."""
    ranges = merge_ranges([r for e in extents for r in xz_ranges(full, _grown(e, full), depth)])
    return filter_ranges(df, code, ranges).where(intersects(box, extents))


def _grown(e: Extent, full: Extent) -> Extent:
    """Larger by a billionth of the full extent, so that range planning, which looks for common area, keeps what touches."""
    dx, dy = full.width * 1e-9, full.height * 1e-9
    return Extent(e.xmin - dx, e.ymin - dy, e.xmax + dx, e.ymax + dy)


def z_query(df: DataFrame, code: str, x: str, y: str, extents: list[Extent], full: Extent, depth: int = 20) -> DataFrame:
    """Points in the extents, edges included."""
    ranges = merge_ranges([r for e in extents for r in z_ranges(full, e, depth)])
    return filter_ranges(df, code, ranges).where(intersects({"xmin": F.col(x), "xmax": F.col(x), "ymin": F.col(y), "ymax": F.col(y)}, extents))


def features(df: DataFrame, code: str, lod: str, family: str, extents: list[Extent], resolution: float, full: Extent, wkid: int = 4326, depth: int = 20, limit: int | None = FEATURE_LIMIT) -> DataFrame:
    """The query of a viewer: ranges, one leaf of the level struct, decoding, the exact test on what is shown. At most limit + 1 rows come out; more than limit means that the limit was met. Without a limit (None) all come out."""
    level = level_for(resolution, wkid)
    ranges = merge_ranges([r for e in extents for r in xz_ranges(full, _grown(e, full), depth)])
    shown = filter_ranges(df, code, ranges).withColumn("_shown", C.lod_decode(f"{lod}.{level.column}", family, level.resolution))
    found = shown.where(F.col("_shown").isNotNull()).where(intersects("_shown", extents))
    return found if limit is None else found.limit(limit + 1)


def limited(df: DataFrame, limit: int = FEATURE_LIMIT) -> DataFrame:
    """One row: the features that a limited answer has, and whether there were more. Only one row beyond the limit is read."""
    n = df.limit(limit + 1).agg(F.count("*").alias("n"))
    return n.select(F.least("n", F.lit(limit)).cast("long").alias("features"), (F.col("n") > limit).alias("limited"))
