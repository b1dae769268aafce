"""Layout analytics over row-group statistics: small tables, one row a row group or file."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.curves import Extent

EARTH = 6371008.8
TARGET_FEATURES = 200_000
DENSITY_RATIO, RETAINED_RATIO = 10.0, 0.25


def with_density(groups: DataFrame) -> DataFrame:
    """groups: n and bounds. Adds log_density, by spherical area; null where it isn't a finite number."""
    span = F.least(F.abs(F.col("xmax") - F.col("xmin")), F.lit(360.0))
    area = F.lit(EARTH**2) * F.radians(span) * F.abs(F.sin(F.radians(F.least("ymax", F.lit(90.0)))) - F.sin(F.radians(F.greatest("ymin", F.lit(-90.0)))))
    return groups.withColumn("log_density", F.when((area > 0) & (F.col("n") > 0), F.log(F.col("n") / area)))


def focus_groups(groups: DataFrame) -> DataFrame:
    """Row groups that are not much sparser than the median one; all where these would be few."""
    d = with_density(groups)
    stats = d.agg(F.median("log_density").alias("mid"), F.count("*").alias("total"))
    kept = d.join(F.broadcast(stats), F.lit(True))  # one row of statistics
    kept = kept.withColumn("dense", F.coalesce(F.col("log_density") >= F.col("mid") - math.log(DENSITY_RATIO), F.lit(False)))
    enough = d.join(F.broadcast(stats), F.lit(True)).agg(
        (F.sum((F.col("log_density") >= F.col("mid") - math.log(DENSITY_RATIO)).cast("long")) >= F.greatest(F.ceil(F.max("total") * RETAINED_RATIO), F.lit(1))).alias("enough")
    )
    return kept.join(F.broadcast(enough), F.lit(True)).where(F.col("dense") | ~F.coalesce("enough", F.lit(False)))


def focus_extent(groups: DataFrame) -> DataFrame:
    """One row: extent and features of the focus groups (longitudes as they are; see longitude_union for data across the antimeridian)."""
    return focus_groups(groups).agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"), F.sum("n").cast("long").alias("n"))


def default_extent(groups: DataFrame) -> tuple[Extent, int] | None:
    """The focus extent, shrunk about its centre towards the target number of features where there are more."""
    row = focus_extent(groups).first()
    if row["n"] is None:
        return None
    e, total = Extent(*row[:4]), groups.agg(F.sum("n")).first()[0]
    if total >= TARGET_FEATURES and row["n"] > TARGET_FEATURES:
        k = math.sqrt(TARGET_FEATURES / row["n"]) / 2
        x, y = (e.xmin + e.xmax) / 2, (e.ymin + e.ymax) / 2
        e = Extent(x - e.width * k, y - e.height * k, x + e.width * k, y + e.height * k)
    return e, row["n"]


def longitude_union(spans: list[tuple[float, float]]) -> tuple[float, float]:
    """The shortest interval of longitudes that has all spans: what the largest gap leaves. An end beyond 180 means that it crosses the antimeridian."""
    if any(b - a >= 360 for a, b in spans):
        return -180.0, 180.0
    cut = []
    for a, b in spans:
        w = (a + 180) % 360 - 180
        cut += [(w, w + b - a)] if w + b - a <= 180 else [(w, 180.0), (-180.0, w + b - a - 360)]
    merged: list[list[float]] = []
    for a, b in sorted(cut):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    gaps = [(merged[(i + 1) % len(merged)][0] + (360 if i + 1 == len(merged) else 0) - merged[i][1], i) for i in range(len(merged))]
    gap, i = max(gaps)
    if gap <= 0:
        return -180.0, 180.0
    start = merged[(i + 1) % len(merged)][0]
    end = merged[i][1]
    return start, end if end >= start else end + 360


def densest(groups: DataFrame) -> DataFrame:
    """One row: the row group whose codes spread least (ties: the first), and its middle row."""
    g = groups.withColumn("spread", F.col("maximum") - F.col("minimum"))
    best = g.agg(F.min(F.struct("spread", "row_group", "first_row", "n")).alias("b"))
    return best.select(F.col("b.row_group").alias("row_group"), F.col("b.spread").alias("spread"), (F.col("b.first_row") + F.floor(F.col("b.n") / 2)).cast("long").alias("middle_row"))
