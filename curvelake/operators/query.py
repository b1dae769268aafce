"""Viewport queries over written datasets: metadata from the footer, ranges to partitions, row groups and pages, then the exact test."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.curves import Extent, merge_ranges, viewport_extents, xz_ranges, z_ranges, zoom_resolution
from ..sources import footers, formats
from . import viewport as V


@dataclass
class Dataset:
    df: DataFrame
    display: dict
    geometry: str
    full: Extent
    partition: str | None
    lowers: list[int]


def open_dataset(spark: SparkSession, location: str) -> Dataset:
    """A dataset with display metadata in its footers. Partition folders give a column that prunes them."""
    paths = formats.parquet_files(location, recursive=True)
    kv = footers.key_values(pq.read_metadata(paths[0]))
    if "geodisplay" not in kv or "geo" not in kv:
        raise ValueError(f"{location} has no display metadata")
    d = json.loads(kv["geodisplay"])
    if "fullExtent" not in d:
        raise ValueError("the dataset has no full extent")
    parts = [p for x in paths if (p := formats.partition_of(x, location if os.path.isdir(location) else os.path.dirname(location)))]
    column = f"{parts[0][0]}_order" if parts else None
    df = footers.reader(spark, paths[0]).parquet(location if os.path.isdir(location) else paths[0])
    if d.get("encoding") == "native":
        footers.read_nested_by_row(spark)  # for good: the rows are read when the caller asks for them
    e = d["fullExtent"]
    return Dataset(df, d, json.loads(kv["geo"])["primary_column"], Extent(e["xmin"], e["ymin"], e["xmax"], e["ymax"]), column, sorted({p[1] for p in parts}))


def _name(path) -> str:
    return path if isinstance(path, str) else ".".join(path)


def plan(data: Dataset, extents: list[Extent], resolution: float) -> DataFrame:
    """Rows that meet the extents, with `shown` (wkb and bounds). Only the code, the level chosen and what the caller keeps are read."""
    d, df = data.display, data.df
    code = _name(d["code"])
    # Codes of 32 bits a side fill 64 bits without a sign: they are decimals, as they are stored.
    kind = "decimal(20,0)" if d["type"] == "z" and d["coordinatePrecision"] == 32 else "bigint"
    column = code if dict(df.dtypes)[code] == kind else "_code"
    df = df if column == code else df.withColumn(column, F.col(code).cast(kind))
    if d["type"] == "z":
        ranges = merge_ranges([r for e in extents for r in z_ranges(data.full, e, d["coordinatePrecision"])])
        x, y = F.col(_name(d["xColumn"])), F.col(_name(d["yColumn"]))
        rows = V.filter_ranges(df, column, ranges, data.partition, data.lowers).where(x.isNotNull())
        shown = F.struct(F.col(data.geometry).alias("wkb"), x.alias("xmin"), y.alias("ymin"), x.alias("xmax"), y.alias("ymax"))
        return rows.withColumn("shown", shown).where(V.intersects("shown", extents))
    ranges = merge_ranges([r for e in extents for r in xz_ranges(data.full, V._grown(e, data.full), d["maxLevel"])])
    rows = V.filter_ranges(df, column, ranges, data.partition, data.lowers)
    levels = sorted(d["levels"], key=lambda x: x["level"])
    if d["encoding"] == "esriPBF" and levels:
        level = next((x for x in levels if x["resolution"] <= resolution * 2**0.001), levels[-1])
        rows = rows.withColumn("shown", C.lod_decode(_name(level["column"]), d["geometryType"], level["resolution"], 2 + d["hasZ"] + d["hasM"]))
    elif d["encoding"] == "wkb" and levels:
        level = next((x for x in levels if x["resolution"] <= resolution * 2**0.001), levels[-1])
        payload = F.col(_name(level["column"]))
        rows = rows.withColumn("_b", C.bounds(payload)).withColumn("shown", F.when(payload.isNotNull(), F.struct(payload.alias("wkb"), "_b.*"))).drop("_b")
    else:
        rows = rows.withColumn("_b", C.bounds(data.geometry)).withColumn("shown", F.when(F.col(data.geometry).isNotNull(), F.struct(F.col(data.geometry).alias("wkb"), "_b.*"))).drop("_b")
    return rows.where(F.col("shown").isNotNull()).where(V.intersects("shown", extents))


def viewport(spark: SparkSession, location: str, bounds: tuple[float, float, float, float], zoom: float = 10, limit: int = V.FEATURE_LIMIT) -> tuple[DataFrame, bool]:
    """Features in west, south, east, north as a DataFrame (geojson and bounds), at most limit; and whether there are more."""
    data = open_dataset(spark, location)
    extents = viewport_extents(*bounds, data.full) if data.display["wkid"] == 4326 else [Extent(*bounds)]
    if not extents:
        return spark.createDataFrame([], "geojson string, xmin double, ymin double, xmax double, ymax double"), False
    rows = plan(data, extents, zoom_resolution(zoom)).select(C.as_geojson("shown.wkb").alias("geojson"), "shown.xmin", "shown.ymin", "shown.xmax", "shown.ymax")
    # Up to one row beyond the limit is counted, without what is only shown.
    return rows.limit(limit), rows.limit(limit + 1).count() > limit
