"""Dataset extents and geometry metadata: aggregates over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.curves import Extent
from ..functions.wkb import CODES, FAMILY


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def extent_row(df: DataFrame, xmin="xmin", ymin="ymin", xmax="xmax", ymax="ymax") -> DataFrame:
    """One row: the smallest and largest bounds. NaN doesn't count."""
    return df.agg(
        F.min(_finite(F.col(xmin))).alias("xmin"), F.min(_finite(F.col(ymin))).alias("ymin"), F.max(_finite(F.col(xmax))).alias("xmax"), F.max(_finite(F.col(ymax))).alias("ymax")
    )


def dataset_extent(df: DataFrame, *columns: str) -> Extent:
    row = extent_row(df, *columns).first()
    if any(v is None for v in row):
        raise ValueError("unable to determine dataset target extent")
    return Extent(*row)


def geometry_metadata(df: DataFrame, geometry: str) -> DataFrame:
    """One row: the sorted distinct types (with their dimensions) and the extent of all geometries that aren't null."""
    h, b = C.header(geometry), C.bounds(geometry)
    rows = df.where(F.col(geometry).isNotNull()).select(h.alias("h"), b.alias("b"))
    suffix = F.when(F.col("h.has_z") & F.col("h.has_m"), " ZM").when(F.col("h.has_z"), " Z").when(F.col("h.has_m"), " M").otherwise("")
    rows = rows.select(F.concat(F.col("h.type"), suffix).alias("type"), "b.*")
    ext = {k: f(_finite(F.col(k))).alias(k) for k, f in (("xmin", F.min), ("ymin", F.min), ("xmax", F.max), ("ymax", F.max))}
    return rows.agg(F.array_sort(F.collect_set("type")).alias("types"), *ext.values())


def family_of(types: list[str]) -> str:
    """The one family of some types; mixing families is refused, a type with its Multi form is not."""
    families = set()
    for t in types:
        code = CODES.get(t.split(" ")[0])
        if code not in FAMILY:
            raise ValueError(f"unsupported geometry type {t}")
        families.add(FAMILY[code])
    if len(families) != 1:
        raise ValueError(f"geometry types must be of one family, found {', '.join(sorted(types)) or 'none'}")
    return families.pop()
