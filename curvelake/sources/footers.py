"""GeoParquet metadata of one or many files, from their footers alone."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq

#: Files whose footers one task reads.
RUN = 64
RESERVED = {"geo", "geodisplay", "ARROW:schema"}
NATIVE_KEY = "org.apache.spark.sql.parquet.row.metadata"
SUFFIXES = {" ZM": (True, True), " Z": (True, False), " M": (False, True)}


def parse_type(name: str) -> tuple[str, bool, bool]:
    for s, (z, m) in SUFFIXES.items():
        if name.endswith(s):
            return name.removesuffix(s), z, m
    return name, False, False


def parse_bbox(v) -> list[float] | None:
    """The first and last two of 4, 6 or 8 numbers; none where one is null."""
    if not isinstance(v, list) or len(v) not in (4, 6, 8) or any(x is None for x in v):
        return None
    half = len(v) // 2
    return [float(x) for x in (v[0], v[1], v[half], v[half + 1])]


def wkid_of(crs) -> int | None:
    """The EPSG code of a PROJJSON object; OGC:CRS84 counts as 4326."""
    if not isinstance(crs, dict) or not isinstance(crs.get("id"), dict):
        return None
    i = crs["id"]
    if str(i.get("authority")).upper() == "OGC" and str(i.get("code")).upper() == "CRS84":
        return 4326
    return int(i["code"]) if str(i.get("authority")).upper() == "EPSG" and str(i.get("code")).isdigit() else None


@dataclass
class SourceMetadata:
    rows: int = 0
    geometry_column: str | None = None
    types: list[str] = field(default_factory=list)
    bbox: list[float] | None = None
    wkid: int | None = None
    #: none: no metadata says; known: wkid, which may be of a system that isn't understood (None).
    crs_known: bool = False
    covering: str | None = None
    pairs: list[tuple[str, str]] = field(default_factory=list)

    @property
    def has_z(self) -> bool:
        return any(parse_type(t)[1] for t in self.types)

    @property
    def has_m(self) -> bool:
        return any(parse_type(t)[2] for t in self.types)


def key_values(meta) -> dict[str, str]:
    return {k.decode(): v.decode("utf-8", "replace") for k, v in (meta.metadata or {}).items()}


def _one(path: str) -> tuple[dict | None, SourceMetadata]:
    meta = pq.read_metadata(path)
    kv = key_values(meta)
    out = SourceMetadata(rows=meta.num_rows, pairs=[(k, v) for k, v in kv.items() if k not in RESERVED and not k.startswith("org.apache.spark")])
    if "geo" not in kv:
        return None, out
    geo = json.loads(kv["geo"])
    out.geometry_column = geo["primary_column"]
    col = geo["columns"][out.geometry_column]
    if col.get("encoding", "WKB").upper() != "WKB":
        raise ValueError(f"unsupported geometry encoding {col['encoding']}")
    out.types, out.bbox = sorted(set(col.get("geometry_types") or [])), parse_bbox(col.get("bbox"))
    if "crs" not in col:
        out.wkid, out.crs_known = 4326, True
    elif col["crs"] is not None:
        out.wkid, out.crs_known = wkid_of(col["crs"]), True
    box = (col.get("covering") or {}).get("bbox") or {}
    paths = [box.get(k) for k in ("xmin", "ymin", "xmax", "ymax")]
    if all(isinstance(p, list) and len(p) == 2 for p in paths) and len({p[0] for p in paths}) == 1 and [p[1] for p in paths] == ["xmin", "ymin", "xmax", "ymax"]:
        out.covering = paths[0][0]
    return geo, out


def _merge(a: tuple, b: tuple) -> tuple:
    (geo_a, x), (geo_b, y) = a, b
    if (geo_a is None) != (geo_b is None):
        raise ValueError("some files have GeoParquet metadata and some have none")
    if geo_a is not None:
        for what, p, q in (("primary column", x.geometry_column, y.geometry_column), ("coordinate reference system", (x.wkid, x.crs_known), (y.wkid, y.crs_known))):
            if p != q:
                raise ValueError(f"files differ in their {what}")
    bbox = None
    if x.bbox and y.bbox:
        bbox = [min(x.bbox[0], y.bbox[0]), min(x.bbox[1], y.bbox[1]), max(x.bbox[2], y.bbox[2]), max(x.bbox[3], y.bbox[3])]
    types = sorted({*x.types, *y.types}) if x.types and y.types else []
    pairs = x.pairs + [p for p in y.pairs if p not in x.pairs]
    return geo_a, SourceMetadata(x.rows + y.rows, x.geometry_column, types, bbox, x.wkid, x.crs_known, x.covering if x.covering == y.covering else None, pairs)


def _read(paths: list[str]) -> tuple[dict | None, SourceMetadata]:
    return reduce(_merge, map(_one, paths))


def read(paths: list[str], spark=None) -> SourceMetadata:
    """Of all files together: they must agree in column, encoding and system; types and boxes are united. Of many files the tasks of a session read the footers, by runs of neighbours, whose unions the driver unites."""
    if spark is None or len(paths) <= RUN:
        return _read(paths)[1]

    def run(batches):
        for b in batches:
            for at, some in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    geo, m = _read(some)
                    row = (at, geo is not None, json.dumps(asdict(m)), None)
                except ValueError as e:
                    row = (at, False, None, str(e))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.bool_(), pa.string(), pa.string()))], names=["run", "geo", "meta", "error"])

    runs = [(i, paths[s : s + RUN]) for i, s in enumerate(range(0, len(paths), RUN))]
    df = spark.createDataFrame(runs, "run long, paths array<string>").repartition(min(len(runs), 4 * spark.sparkContext.defaultParallelism))
    found = []
    for r in sorted(df.mapInArrow(run, "run long, geo boolean, meta string, error string").collect()):  # one row a run
        if r["error"] is not None:
            raise ValueError(r["error"])
        m = json.loads(r["meta"])
        found.append(({} if r["geo"] else None, SourceMetadata(**(m | {"pairs": [tuple(p) for p in m["pairs"]]}))))
    return reduce(_merge, found)[1]


def _spark_type(t: pa.DataType) -> pa.DataType:
    """The type as Spark's Parquet reader gives it: unsigned numbers take the next wider one."""
    wider = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0)}
    if pa.types.is_struct(t):
        return pa.struct([pa.field(f.name, _spark_type(f.type), f.nullable) for f in t])
    if pa.types.is_list(t):
        return pa.list_(_spark_type(t.value_type))
    return wider.get(t, t)


def read_nested_by_row(spark) -> str:
    """Native levels are stored by split bytes, which Spark reads by row but not in nested batches: this turns such batches off for the session and returns what was set."""
    key = "spark.sql.parquet.enableNestedColumnVectorizedReader"
    was = spark.conf.get(key)
    spark.conf.set(key, "false")
    return was


def reader(spark, path: str):
    """A reader for files like this one. Spark knows no GEOMETRY type in Parquet: where a file has one and doesn't say Spark's schema, its columns are named to the reader."""
    from pyspark.sql.pandas.types import from_arrow_schema

    meta = pq.read_metadata(path)
    kinds = [str(meta.schema.column(i).logical_type) for i in range(len(meta.schema))]
    if NATIVE_KEY in key_values(meta) or not any(k.startswith(("Geometry", "Geography")) for k in kinds):
        return spark.read
    schema = pq.read_schema(path).remove_metadata()
    plain = [pa.field(f.name, _spark_type(f.type.storage_type if isinstance(f.type, pa.BaseExtensionType) else f.type)) for f in schema]
    return spark.read.schema(from_arrow_schema(pa.schema(plain)))


def layout(paths: list[str]) -> list[dict]:
    """One row for each column chunk of each row group: its place, sizes and statistics."""
    out = []
    for path in paths:
        meta = pq.read_metadata(path)
        at = 0
        for g in range(meta.num_row_groups):
            rg = meta.row_group(g)
            for c in range(rg.num_columns):
                col = rg.column(c)
                s = col.statistics
                out.append(
                    {"file": path, "row_group": g, "first_row": at, "rows": rg.num_rows, "column": col.path_in_schema, "codec": col.compression.upper(), "compressed": col.total_compressed_size, "uncompressed": col.total_uncompressed_size,
                     "column_index": bool(col.has_column_index), "offset_index": bool(col.has_offset_index), "minimum": float(s.min) if s and s.has_min_max and isinstance(s.min, (int, float)) else None, "maximum": float(s.max) if s and s.has_min_max and isinstance(s.max, (int, float)) else None}
                )
            at += rg.num_rows
    return out


LAYOUT = "file string, row_group int, first_row long, rows long, column string, codec string, compressed long, uncompressed long, column_index boolean, offset_index boolean, minimum double, maximum double"


def layout_table(spark, paths: list[str]):
    """layout() of the files, read by the tasks."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(LAYOUT))

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist(layout([path]), schema)

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 4 * spark.sparkContext.defaultParallelism)))
    return files.mapInArrow(run, LAYOUT)


def summary(layout_df):
    """One row a file: rows, columns, row groups, codecs, bytes and the ratio of compression."""
    from pyspark.sql import functions as F

    groups = layout_df.groupBy("file", "row_group").agg(F.first("rows").alias("rows"), F.sum("compressed").alias("c"), F.sum("uncompressed").alias("u"), F.collect_set("codec").alias("codecs"))
    cols = layout_df.groupBy("file").agg(F.countDistinct("column").alias("columns"))
    out = groups.groupBy("file").agg(F.sum("rows").alias("rows"), F.count("*").alias("row_groups"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("codecs")))).alias("codecs"), F.sum("c").alias("compressed"), F.sum("u").alias("uncompressed"))
    label = F.when(F.size("codecs") > 1, "Mixed").otherwise(F.element_at("codecs", 1))
    return out.join(cols, "file").withColumn("codec", label).withColumn("ratio", F.col("uncompressed") / F.col("compressed"))
