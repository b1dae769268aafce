"""Rewriting a vector dataset: keys, order, levels of detail and files.

The logical plan is columns on the source table; keys are sorted before levels are encoded, so payloads are never shuffled or spilled. A single file is one
sorted task; for data beyond one machine a folder of ranges is written, with one shuffle by range and a sort within each.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import columns as C
from ..functions.curves import Extent
from ..functions.lod import levels
from ..operators import clustering, extents
from ..sinks import parquet as sink
from ..sources import arrow, footers, formats, geopackage
from ..sources.ranges import effective_rows, row_range
from . import metadata as M

#: Fixed values of the file format: the names of generated columns.
GENERATED = {"geokey", "geolod", "geodisplay"}
POINT_GENERATED = GENERATED | {"sop_geometry", "x", "y", "z", "m"}
SUPPORTED = (4326, 3857)


class RequestError(ValueError):
    pass


@dataclass
class InputOptions:
    source: str | list | pa.Table
    format: str | None = None
    start: int = 0
    num: int | None = None
    layer: str | None = None
    geometry_column: str | None = None
    in_sr: int | None = None
    declaration: arrow.GeometryDeclaration | None = None


@dataclass
class OutputOptions:
    path: str
    optimized: bool = True
    parts: int | None = None
    compression: str = "snappy"
    row_group_size: int = sink.ROW_GROUP
    page_size: int | None = None
    out_sr: int = 4326
    normalization_extent: Extent | None = None
    cluster_depth: int = 20
    covering: bool = False
    overwrite: bool = False
    strip_z: bool = False
    strip_m: bool = False
    encoding: str = "pbf"
    write_display: bool = True
    write_extensions: bool = False


@dataclass
class WriteResult:
    rows_expected: int
    rows_written: int
    files: list[str]
    warnings: list[str] = field(default_factory=list)


def _check(o: OutputOptions) -> None:
    if o.out_sr not in SUPPORTED:
        raise RequestError(f"output spatial reference {o.out_sr} is not supported; use 4326 or 3857")
    if o.row_group_size < 1 or (o.page_size is not None and o.page_size < 1):
        raise RequestError("row group and page sizes must be positive")
    if not 1 <= o.cluster_depth <= 32:
        raise RequestError("cluster depth must be from 1 to 32")
    if o.normalization_extent and not o.normalization_extent.valid():
        raise RequestError("normalization extent must be finite and have a positive area")
    if not o.optimized and o.write_extensions:
        raise RequestError("extensions need optimized output")
    if o.encoding not in M.ENCODINGS:
        raise RequestError(f"unknown encoding {o.encoding}")
    sink.check_codec(o.compression)


def open_source(spark: SparkSession, i: InputOptions) -> tuple[DataFrame, footers.SourceMetadata]:
    if not isinstance(i.source, str):
        if i.declaration is None:
            raise RequestError("Arrow input needs a geometry declaration")
        return arrow.read(spark, i.source, i.declaration)
    if formats.resolve_format(i.source, i.format) == "gpkg":
        layer = geopackage.choose(i.source, i.layer)
        system = geopackage.wkid(i.source, layer["srs_id"])
        z, m = layer["z"] == 1, layer["m"] == 1
        types = [M.typed(t, z, m) for t in geopackage.sampled_types(i.source, layer)]
        df = geopackage.read(spark, i.source, layer["name"], spark.sparkContext.defaultParallelism)
        return df, footers.SourceMetadata(layer["features"], layer["geometry"], types, None, system, system is not None)
    paths = formats.parquet_files(i.source)
    return footers.reader(spark, paths[0]).parquet(*paths), footers.read(paths, spark)


@dataclass
class Resolved:
    df: DataFrame
    column: str
    types: list[str]
    family: str
    wkid: int
    has_z: bool
    has_m: bool
    bbox: list[float] | None


def resolve(df: DataFrame, meta: footers.SourceMetadata, i: InputOptions) -> Resolved:
    """What must be known of the source: from metadata where that is whole, else from one scan."""
    column = i.geometry_column or meta.geometry_column
    if not column:
        raise RequestError("no geometry column is known; pass --geometry-column")
    if column not in df.columns:
        raise RequestError(f"no geometry column {column!r}")
    if meta.crs_known:
        if i.in_sr is not None:
            raise RequestError("the source has a spatial reference; --in-sr is for sources without one")
        wkid = meta.wkid
    else:
        wkid = i.in_sr
        if wkid is None:
            raise RequestError("the source has no spatial reference; pass --in-sr")
    if wkid not in SUPPORTED:
        raise RequestError(f"source spatial reference {wkid} can't be transformed; only 4326 and 3857 are known")
    whole = i.start == 0 and i.num is None
    same = column == meta.geometry_column
    types, bbox = (meta.types, meta.bbox) if same else ([], None)
    if not (whole and types and bbox):
        row = extents.geometry_metadata(df, column).first()
        types = list(row["types"]) or types
        bbox = [row["xmin"], row["ymin"], row["xmax"], row["ymax"]] if row["xmin"] is not None else None
    family = extents.family_of(types)
    declared = meta.types if same and meta.types else types
    z = any(footers.parse_type(t)[1] for t in declared)
    m = any(footers.parse_type(t)[2] for t in declared)
    return Resolved(df, column, types, family, wkid, z, m, bbox)


def arrow_schema(df: DataFrame) -> pa.Schema:
    return to_arrow_schema(df.schema)


def convert(spark: SparkSession, i: InputOptions, o: OutputOptions) -> WriteResult:
    _check(o)
    df, meta = open_source(spark, i)
    if not o.optimized and (o.parts or 1) > 1:
        raise RequestError("plain output has one part")
    expected = effective_rows(meta.rows, i.start, i.num)
    if i.start or i.num is not None:
        df = row_range(df, i.start, i.num, None if isinstance(i.source, str) and formats.resolve_format(i.source, i.format) == "parquet" else [])
        if i.num is not None:
            df = df.persist()  # analysis and writing must see the same rows
    try:
        r = resolve(df, meta, i)
        return _write(spark, r, meta, i, o, expected)
    finally:
        if i.num is not None:
            df.unpersist()


def _write(spark: SparkSession, r: Resolved, meta: footers.SourceMetadata, i: InputOptions, o: OutputOptions, expected: int) -> WriteResult:
    warnings: list[str] = []
    g, df = r.column, r.df
    projected = r.wkid != o.out_sr
    has_z, has_m = r.has_z and not o.strip_z, r.has_m and not o.strip_m
    point = r.family == "point"
    drop = (POINT_GENERATED if point else GENERATED) if o.optimized else set()
    reuse = bool(o.covering and meta.covering and meta.covering in df.columns and not projected and o.out_sr == 4326)
    names = [c for c in df.columns if (c not in drop or c == g) and not (c == "bbox" and (o.optimized or o.covering))]
    partition = ("z" if point else "xz") + "_order"
    parts = o.parts or 1
    kind = sink.prepare(o.path, o.parts, o.overwrite, folder=None)
    if o.optimized and kind == "folder" and partition in names:
        raise RequestError(f"the source has a column {partition}, which names the partitions")
    df = df.withColumn(g, C.strip_dims(C.to_crs(g, r.wkid, o.out_sr), o.strip_z and r.has_z, o.strip_m and r.has_m))
    if point:
        df = df.withColumn("_point", C.point_parts(g, (has_z, has_m)))
        box = {k: F.col(f"_point.{k[0]}") for k in ("xmin", "ymin", "xmax", "ymax")}
    elif reuse:
        box = {k: F.col(f"{meta.covering}.{k}") for k in ("xmin", "ymin", "xmax", "ymax")}
    else:
        df = df.withColumn("_box", C.bounds(g))
        box = {k: F.col(f"_box.{k}") for k in ("xmin", "ymin", "xmax", "ymax")}
    bounded = df.select("*", *(box[k].alias(f"_{k}") for k in box))
    explicit = o.normalization_extent
    if explicit:
        extent: Extent | None = explicit
    elif r.bbox and not projected:
        extent = Extent(*r.bbox)
    else:
        extent = None
        if o.optimized or projected:
            extent = extents.dataset_extent(bounded, "_xmin", "_ymin", "_xmax", "_ymax")
    if o.optimized and extent is None:
        raise RequestError("unable to determine dataset target extent")
    types = sorted({M.typed(footers.parse_type(t)[0], has_z, has_m) for t in r.types})
    out_cols = [F.col(f"`{c}`") for c in names]
    if o.covering:
        out_cols.append(F.when(F.col(g).isNotNull(), F.struct(*(F.col(f"_{k}").alias(k) for k in ("xmin", "ymin", "xmax", "ymax")))).alias("bbox"))
    options = sink.FileOptions(o.compression, o.row_group_size, o.page_size, o.encoding == "native", (g, o.out_sr) if o.optimized else None)
    pairs = dict(meta.pairs)
    bbox = extent.as_list() if extent else None
    staging = f"{o.path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    if not o.optimized:
        final = bounded.select(*out_cols)
        footer = pairs | {"geo": M.dumps(M.geo(g, types, o.out_sr, bbox, o.covering))}
        return _finish(final.coalesce(1), final, staging, footer, options, None, o, kind, expected, warnings)
    if point:
        stored = []
        keyed = bounded.withColumn("geokey", C.z_code(F.col("_xmin"), F.col("_ymin"), extent, o.cluster_depth))
        tail = C.point_struct(F.col("_point.x"), F.col("_point.y"), F.col("_point.z") if has_z else None, F.col("_point.m") if has_m else None).alias("sop_geometry")
        keyed = keyed.select(*out_cols, "geokey", tail)
        display = M.display_z(o.out_sr, extent, o.cluster_depth, has_z, has_m)
    else:
        if o.cluster_depth > 31:
            raise RequestError("XZ depth must be 31 or less")
        if o.write_extensions and r.family != "multipoint" and o.encoding != "pbf":
            raise RequestError("extensions need the pbf encoding")
        stored = [] if r.family == "multipoint" else levels(o.out_sr)
        keyed = bounded.select(*out_cols, C.xz_code(*(F.col(f"_{k}") for k in ("xmin", "ymin", "xmax", "ymax")), extent, o.cluster_depth).alias("geokey"))
        display = M.display_xz(o.out_sr, extent, o.cluster_depth, r.family, o.encoding, stored, has_z, has_m)
    if kind == "folder":
        lower = clustering.boundaries(keyed.select("geokey"), "geokey", parts) if parts > 1 else [int(keyed.agg(F.min("geokey")).first()[0] or 0)]
        ordered = clustering.partitioned_sort(keyed, "geokey", lower, partition)
    else:
        ordered = keyed.repartition(1).sortWithinPartitions("geokey")
    seen = None
    if stored:
        # Whether all geometries have the dimensions that metadata say, noted in the same pass.
        seen, (z, m) = Observation(), C.dimensions(g)
        other = (z != F.lit(has_z)) | (m != F.lit(has_m))
        ordered = ordered.observe(seen, F.count(F.when(other, 1)).alias("other"))
        ordered = ordered.withColumn("geolod", C.lod_struct(g, r.family, o.out_sr, o.encoding, has_z, has_m, stored))
    if kind == "folder":
        ordered = ordered.select(*[c for c in ordered.columns if c != partition], partition)
    order = M.ordering("z" if point else "xz", g, extent, o.cluster_depth) if o.write_extensions else None
    lod = M.lod(r.family, g, stored) if o.write_extensions and stored else None
    footer = pairs | {"geo": M.dumps(M.geo(g, types, o.out_sr, bbox, o.covering, order, lod))}
    if o.write_display:
        footer["geodisplay"] = M.dumps(display)
    got = _finish(ordered, ordered.drop(partition) if kind == "folder" else ordered, staging, footer, options, partition if kind == "folder" else None, o, kind, expected, warnings)
    if seen is not None and got.rows_written and seen.get["other"]:
        got.warnings.append(f"some geometries don't have the dimensions that the source's metadata say; levels are written with hasZ={has_z}, hasM={has_m}, and 0 for what is missing")
    return got


def _finish(df, shape, staging, footer, options, partition, o, kind, expected, warnings) -> WriteResult:
    import os
    import shutil

    try:
        files = sink.write(df, staging, footer, options, partition)
        if not files:
            name = "part-00000.parquet"
            sink.empty_file(os.path.join(staging, name), arrow_schema(shape), footer | sink.native_schema(shape.schema), options)
            files = [(name, 0)]
        sink.commit(staging, files, o.path, kind)
    except BaseException:
        shutil.rmtree(staging, ignore_errors=True)
        raise
    names = [o.path] if kind == "file" else [os.path.join(o.path, f) for f, _ in files]
    return WriteResult(expected, sum(n for _, n in files), sorted(names), sorted(set(warnings)))
