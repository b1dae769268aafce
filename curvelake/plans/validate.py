"""Validation of clustered files: the rules of the catalogue, over footers on the driver and over rows in Spark.

Rows are checked where they are: order by a window over each file's row numbers, everything else in one pass that recomputes keys and payloads. The sampled mode looks at the first four
geometries of each file, at all whose code is null or whose coordinate columns aren't finite, at all where the dataset has no full extent, and at the payloads of the first 512 rows; mode="full" checks every geometry.
"""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions import batch as B
from ..functions import columns as C
from ..functions import lod as L
from ..functions import wkb as W
from ..functions.curves import Extent
from ..operators import clustering
from ..sources import footers, formats, pages

#: Ids of the rules, here and below; these only warn.
WARNINGS = {"SOP-META-006", "SOP-PARQUET-002", "SOP-GEOMETRY-006", "SOP-PBF-003", "SOP-PBF-004", "SOP-RANGE-001"}
SAMPLE_GEOMETRIES, SAMPLE_PAYLOADS = 4, 512


@dataclass(frozen=True, order=True)
class Finding:
    severity: str
    file: str
    row_group: int
    row: int
    column: str
    rule: str
    message: str


@dataclass
class Report:
    findings: list[Finding] = field(default_factory=list)
    files: int = 0
    rows: int = 0

    def add(self, rule: str, message: str, file: str = "", row: int = -1, column: str = "") -> None:
        self.findings.append(Finding("warning" if rule in WARNINGS else "error", file, -1, row, column, rule, message))

    @property
    def error_count(self) -> int:
        return sum(f.severity == "error" for f in self.findings)

    def has_errors(self) -> bool:
        return self.error_count > 0

    def rules(self) -> list[str]:
        return sorted({f.rule for f in self.findings})

    def ensure_valid(self) -> Report:
        if self.has_errors():
            raise ValueError(self.text())
        return self

    def text(self) -> str:
        lines = [f"{f.severity}: {f.rule} {f.file}{f' row {f.row}' if f.row >= 0 else ''}{f' {f.column}' if f.column else ''}: {f.message}" for f in sorted(self.findings)]
        return "\n".join([*lines, f"{self.files} files, {self.rows} rows: {self.error_count} errors, {len(self.findings) - self.error_count} warnings"])

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(f.severity, f.file, f.row_group, f.row, f.column, f.rule, f.message) for f in sorted(self.findings)], "severity string, file string, row_group int, row long, column string, rule string, message string")


def close(a: float, b: float) -> bool:
    return abs(a - b) <= 1e-9 * max(abs(a), abs(b), 1.0)


@dataclass
class _File:
    path: str
    name: str
    schema: pa.Schema
    geo: dict
    display: dict
    partition: tuple[str, int] | None
    rows: int = 0
    codes: tuple[int, int] | None = None

    @property
    def kind(self) -> str:
        return self.display["type"]

    @property
    def geometry(self) -> str:
        return self.geo["primary_column"]


def _leaf(schema: pa.Schema, path) -> pa.DataType | None:
    parts = [path] if isinstance(path, str) else list(path)
    if parts[0] not in schema.names:
        return None
    t = schema.field(parts[0]).type
    for p in parts[1:]:
        if not pa.types.is_struct(t) or t.get_field_index(p) < 0:
            return None
        t = t.field(p).type
    return t


def _name(path) -> str:
    return path if isinstance(path, str) else ".".join(path)


def _finite_extent(v) -> bool:
    return isinstance(v, list) and len(v) == 4 and all(isinstance(x, (int, float)) and math.isfinite(x) for x in v) and v[0] <= v[2] and v[1] <= v[3]


def _metadata(r: Report, name: str, meta, twice: set[str]) -> tuple[dict, dict] | None:
    """The file's metadata if nothing in it is an error."""
    before = r.error_count
    kv = footers.key_values(meta)
    add = lambda rule, text: r.add(rule, text, name)
    parsed: dict[str, dict] = {}
    for key in ("geo", "geodisplay"):
        if key not in kv:
            add("SOP-META-001", f"footer has no {key}")
            continue
        if key in twice:
            add("SOP-META-002", f"footer has {key} more than once")
        try:
            parsed[key] = json.loads(kv[key])
            if not isinstance(parsed[key], dict):
                raise ValueError("not an object")
        except ValueError as e:
            add("SOP-META-003", f"{key} can't be read: {e}")
    if len(parsed) < 2 or r.error_count > before:
        return None
    geo, d = parsed["geo"], parsed["geodisplay"]
    if d.get("type") not in ("z", "xz"):
        add("SOP-META-003", f"unknown display type {d.get('type')!r}")
        return None
    if geo.get("version") not in ("1.1.0", "2.0.0"):
        add("SOP-META-004", f"geo version {geo.get('version')!r}")
    if d.get("version") != "0.1":
        add("SOP-META-004", f"geodisplay version {d.get('version')!r}")
    col = (geo.get("columns") or {}).get(geo.get("primary_column"))
    if not isinstance(col, dict):
        add("SOP-META-005", "the primary column is not declared")
        return None
    types = [footers.parse_type(t) for t in col.get("geometry_types") or []]
    if col.get("encoding") != "WKB":
        add("SOP-META-005", f"encoding {col.get('encoding')!r}")
    if not types or any(W.CODES.get(t[0]) not in W.FAMILY for t in types):
        add("SOP-META-005", "geometry types are missing or unsupported")
    family = d.get("geometryType")
    if not d.get("code"):
        add("SOP-META-005", "the code column is not named")
    if "writer" not in d:
        add("SOP-META-006", "the writer is not named")
    elif not (d["writer"] or {}).get("name") or not (d["writer"] or {}).get("version"):
        add("SOP-META-005", "the writer has an empty name or version")
    if d["type"] == "z":
        if family != "point":
            add("SOP-META-005", f"Z files hold points, not {family}")
        if not (isinstance(d.get("coordinatePrecision"), int) and 1 <= d["coordinatePrecision"] <= 32):
            add("SOP-META-005", "coordinatePrecision must be from 1 to 32")
        for k, wanted in (("xColumn", True), ("yColumn", True), ("zColumn", d.get("hasZ")), ("mColumn", d.get("hasM"))):
            if bool(d.get(k)) != bool(wanted):
                add("SOP-META-005", f"{k} is {'missing' if wanted else 'not expected'}")
    else:
        if family not in ("multipoint", "polyline", "polygon"):
            add("SOP-META-005", f"XZ geometryType {family!r}")
        levels, top = d.get("levels") or [], d.get("maxLevel")
        if not (isinstance(top, int) and 1 <= top <= 31):
            add("SOP-XZ-002", f"maxLevel {top!r}")
            top = 31
        if not levels and family != "multipoint":
            add("SOP-XZ-002", "there are no levels")
        numbers, names = [x.get("level") for x in levels], [_name(x.get("column") or "") for x in levels]
        if len(set(numbers)) < len(numbers) or any(n > top for n in numbers):
            add("SOP-XZ-002", "levels are repeated or beyond maxLevel")
        if len(set(names)) < len(names) or not all(names):
            add("SOP-XZ-002", "level columns are repeated or empty")
        for x in levels:
            scale = (x.get("transform") or {}).get("scale") or []
            if not all(isinstance(v, (int, float)) and math.isfinite(v) and v > 0 for v in [x.get("resolution"), x.get("scale"), *scale]) or len(scale) != 4:
                add("SOP-XZ-002", f"level {x.get('level')} has no finite positive resolution, scale or transform")
    if types and family and {W.FAMILY.get(W.CODES.get(t[0])) for t in types} - {family}:
        add("SOP-GEOMETRY-002", "declared geometry types are not of the display's family")
    if types and any((t[1], t[2]) != (bool(d.get("hasZ")), bool(d.get("hasM"))) for t in types):
        add("SOP-GEOMETRY-003", "declared dimensions differ from hasZ and hasM")
    wkid = footers.wkid_of(col.get("crs")) if "crs" in col else 4326
    if ("wkid" in d) == ("wkt" in d):
        add("SOP-CRS-001", "exactly one of wkid and wkt must be given")
    elif "wkid" in d and (d["wkid"] not in (4326, 3857) or wkid not in (4326, 3857) or d["wkid"] != wkid):
        add("SOP-CRS-001", f"spatial references {wkid} and {d['wkid']}")
    e = d.get("fullExtent", ...)
    if e is None:
        add("SOP-META-003", "fullExtent is null")
    elif e is not ...:
        v = [e.get(k) for k in ("xmin", "ymin", "xmax", "ymax")]
        if not _finite_extent(v):
            add("SOP-EXTENT-001", "fullExtent is not finite or is reversed")
        elif col.get("bbox") and not all(close(a, b) for a, b in zip(footers.parse_bbox(col["bbox"]) or [], v)):
            add("SOP-EXTENT-001", "bbox and fullExtent differ")
    return (geo, d) if r.error_count == before else None


def _structure(r: Report, f: _File, meta) -> bool:
    before = r.error_count
    d, s = f.display, f.schema
    add = lambda rule, text, col="": r.add(rule, text, f.name, column=col)
    t = _leaf(s, f.geometry)
    if t is None or not (pa.types.is_binary(t) or pa.types.is_large_binary(t)):
        add("SOP-SCHEMA-001", "the geometry column is missing or not binary", f.geometry)
    box = (f.geo["columns"][f.geometry].get("covering") or {}).get("bbox")
    for p in (box or {}).values():
        t = _leaf(s, p)
        if t is None or not (pa.types.is_float64(t) or pa.types.is_float32(t)):
            add("SOP-SCHEMA-001", "a covering column is missing or not a number", _name(p))
    rule = "SOP-Z-001" if f.kind == "z" else "SOP-XZ-001"
    t = _leaf(s, d["code"])
    if t is None or not (t in (pa.uint64(), pa.int64()) or pa.types.is_decimal(t)):
        add(rule, "the code column is missing or not a 64-bit number", _name(d["code"]))
    for k in ("xColumn", "yColumn", "zColumn", "mColumn"):
        if d.get(k) and _leaf(s, d[k]) != pa.float64():
            add(rule, "a coordinate column is missing or not a double", _name(d[k]))
    for x in d.get("levels") or []:
        t = _leaf(s, x["column"])
        good = t is not None and (pa.types.is_list(t) if d["encoding"] == "native" else pa.types.is_binary(t))
        if not good:
            add("SOP-XZ-001", "a level column is missing or of another type", _name(x["column"]))
    if f.partition and f.partition[0] != f.kind:
        add("SOP-PARTITION-001", f"a {f.kind} file lies in a folder for {f.partition[0]}")
    code = _name(d["code"])
    for g in range(meta.num_row_groups):
        rg = meta.row_group(g)
        col = next((rg.column(c) for c in range(rg.num_columns) if rg.column(c).path_in_schema == code), None)
        if col is not None and not (col.has_column_index and col.has_offset_index):
            add("SOP-PARQUET-002", "the code column has no page index", code)
            break
    return r.error_count == before


def _collect(r: Report, df: DataFrame, rule: str, message: str, most: int = 100) -> None:
    """A bounded number of findings of a rule, by file and row; how many more there are is said."""
    rows = df.select("_file", "_row").orderBy("_file", "_row").limit(most + 1).collect()
    for x in rows[:most]:
        r.add(rule, message, x["_file"], x["_row"])
    if len(rows) > most:
        r.add(rule, f"{message} (more than {most} rows)", rows[0]["_file"])


def _found(r: Report, df: DataFrame, faults: list[tuple[str, str, Column, int]]) -> None:
    """All faults (rule, message, test, how many are listed) in one pass over the rows: of each the first by file and row, and whether there are more. Each task passes on only as many as are listed."""
    marks = F.filter(F.array(*(F.when(test, F.lit(k)) for k, (_, _, test, _) in enumerate(faults))), lambda x: x.isNotNull())
    first = Window.partitionBy("_k").orderBy("_file", "_row")
    most = max(n for _, _, _, n in faults)
    rows = df.select("_file", "_row", F.explode(marks).alias("_k")).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most + 1).orderBy("_k", "_n").collect()
    for x in rows:
        rule, message, _, n = faults[x["_k"]]
        if x["_n"] <= n:
            r.add(rule, message, x["_file"], x["_row"])
        elif x["_n"] == n + 1:
            r.add(rule, f"{message} (more than {n} rows)", x["_file"])


def _sample_ends(rows: DataFrame) -> DataFrame:
    """For each file the row of its fourth geometry, or of its last where there are fewer."""
    n = F.row_number().over(Window.partitionBy("_file").orderBy("_row"))
    return rows.withColumn("_n", n).where(F.col("_n") <= SAMPLE_GEOMETRIES).groupBy("_file").agg(F.max("_row").alias("_end"))


def _payload_check(family: str, resolution: float, has_z: bool, has_m: bool):
    """geometry, payload -> "", or the rule that the payload breaks."""
    stride = 2 + has_z + has_m

    def one(geometry: bytes | None, payload: bytes | None) -> str:
        if (geometry is None) != (payload is None):
            return "SOP-PBF-001"
        if geometry is None:
            return ""
        try:
            g = W.decode(geometry)
        except W.WkbError:
            return ""  # another rule's matter
        try:
            q = L.pbf_decode(payload, stride)
        except L.PbfError:
            return "SOP-PBF-001"
        if any(n == 0 for n in q.lengths):
            return "SOP-PBF-001"
        if len(g.xy) and not len(q.grid):
            return "SOP-PBF-002"
        grid = {tuple(v) for v in zip(L.to_grid(g.xy[:, 0], resolution, 0.0).tolist(), L.to_grid(g.xy[:, 1], resolution, 0.0).tolist())}
        if not {tuple(v) for v in q.grid[:, :2].tolist()} <= grid:
            return "SOP-PBF-001"
        if family == "polygon" and g.kind == 3 and len(q.lengths) and min(q.lengths) >= 3:
            at = 0
            for k, n in enumerate(q.lengths):
                area = W.ring_area(q.grid[at : at + n, :2].astype(float))
                if area and (area > 0) == (k == 0):
                    return "SOP-PBF-003"
                at += n
        return ""

    @arrow_udf("string")
    def check(g: pa.Array, p: pa.Array) -> pa.Array:
        rows, payloads = g.to_pylist(), p.to_pylist()
        if stride == 2 and not g.null_count and not p.null_count and (s := B.simple(rows)) and s.coords.shape[1] == 2 and s.kind != 1 and (q := B.pbf_decode(payloads)):
            return pa.array(np.array(["", "SOP-PBF-001", "", "SOP-PBF-003"])[B.payload_faults(s, q, resolution, family)])
        return pa.array([one(a, b) for a, b in zip(rows, payloads)], pa.string())

    return check


def _data(r: Report, spark: SparkSession, files: list[_File], mode: str) -> None:
    f = files[0]
    d = f.display
    names = spark.createDataFrame([(x.path, x.name) for x in files], "_path string, _file string")
    df = footers.reader(spark, f.path).option("recursiveFileLookup", "true").parquet(*[x.path for x in files])
    code = F.col(_name(d["code"])).cast("decimal(20,0)" if d.get("coordinatePrecision") == 32 else "long")
    df = df.select("*", F.regexp_replace(F.col("_metadata.file_path"), "^file:(//)?", "").alias("_path"), F.col("_metadata.row_index").alias("_row"), code.alias("_code"))
    # The driver has listed the files: their table is no larger than that list.
    df = df.join(F.broadcast(names), "_path").drop("_path")
    g = F.col(f.geometry)
    r.rows = sum(x.rows for x in files)
    rule = "SOP-Z-002" if f.kind == "z" else "SOP-XZ-003"
    _collect(r, clustering.order_violations(df.where(F.col("_code").isNotNull()).select("_file", "_row", "_code"), "_code", ["_file"], "_row"), rule, "the code is below the one before")
    extent = Extent(*(d["fullExtent"][k] for k in ("xmin", "ymin", "xmax", "ymax"))) if "fullExtent" in d else None
    number = [F.coalesce(F.abs(F.col(_name(d[k]))) < math.inf, F.lit(False)) for k in ("xColumn", "yColumn")] if f.kind == "z" else []
    some = g.isNotNull()
    if mode != "full" and extent is not None:
        df = df.join(F.broadcast(_sample_ends(df.where(some).select("_file", "_row"))), "_file", "left")
        odd = F.col("_code").isNull()
        for n in number:
            odd = odd | ~n
        some = some & (odd | F.coalesce(F.col("_row") <= F.col("_end"), F.lit(False)))
    early = F.lit(True) if mode == "full" else F.col("_row") < SAMPLE_PAYLOADS
    df = df.withColumn("_seen", some).where(F.col("_seen") | early)
    # Geometries that aren't looked at, and those that can't be read, have nulls or an error here, which no further test takes for a fault.
    df = df.withColumn("_i", C.inspect(F.when(F.col("_seen"), g)))
    family, has_z, has_m = d["geometryType"], bool(d.get("hasZ")), bool(d.get("hasM"))
    wrong = "_i.type = 'Polygon' and exists(transform(_i.rings, (x, i) -> not x.degenerate and ((x.area > 0) != (i = 0))), y -> y)"
    determinate = F.col("_i.extent").isNotNull() & ~F.col("_i.mixed")
    faults = [
        ("SOP-GEOMETRY-001", "the geometry can't be read", F.col("_i.error").isNotNull(), 100),
        ("SOP-GEOMETRY-002", "the geometry is of another family", F.col("_i.family") != family, 100),
        ("SOP-GEOMETRY-003", "the geometry has other dimensions", (F.col("_i.has_z") != has_z) | (F.col("_i.has_m") != has_m), 100),
        ("SOP-GEOMETRY-004", "finite and other coordinates are mixed", F.col("_i.mixed"), 100),
        ("SOP-GEOMETRY-005", "a ring is not closed", F.expr("exists(_i.rings, x -> not x.closed)"), 100),
        ("SOP-GEOMETRY-006", "a ring turns the wrong way", F.expr(wrong), 100),
    ]
    if extent is None:
        _found(r, df, [*faults, ("SOP-EXTENT-001", "fullExtent is missing", determinate, 1)])
        return
    x0, y0, x1, y1 = (F.element_at("_i.extent", k) for k in (1, 2, 3, 4))
    if f.kind == "z":
        df = df.withColumn("_p", C.point_parts(F.when(determinate & (F.col("_i.family") == "point"), g)))
        point = F.col("_p.x").isNotNull()
        differs = F.lit(False)
        for k in ("xColumn", "yColumn", "zColumn", "mColumn"):
            if d.get(k):
                differs = differs | ~F.col(_name(d[k])).eqNullSafe(F.col(f"_p.{k[0]}"))
        want = C.z_code(F.col("_p.x"), F.col("_p.y"), extent, d["coordinatePrecision"])
        faults += [
            ("SOP-Z-003", "coordinate columns differ from the geometry", point & differs, 100),
            ("SOP-Z-003", "coordinates are finite beside a geometry without any", F.col("_i.extent").isNull() & ~F.col("_i.mixed") & number[0] & number[1], 100),
            ("SOP-Z-004", "the code isn't that of the coordinates", point & ~F.col("_code").eqNullSafe(want.cast(df.schema["_code"].dataType)), 100),
        ]
        _found(r, df, faults)
        return
    faults.append(("SOP-XZ-004", "the code isn't that of the geometry's bounds", determinate & ~F.col("_code").eqNullSafe(C.xz_code(x0, y0, x1, y1, extent, d["maxLevel"])), 100))
    if f.geo["columns"][f.geometry].get("covering"):
        same = F.col("bbox.xmin").eqNullSafe(x0) & F.col("bbox.ymin").eqNullSafe(y0) & F.col("bbox.xmax").eqNullSafe(x1) & F.col("bbox.ymax").eqNullSafe(y1)
        faults.append(("SOP-EXTENT-001", "the covering box isn't that of the geometry", determinate & ~same, 100))
    leaves = [_name(x["column"]) for x in d["levels"]]
    if d["encoding"] == "native":
        faults += [("SOP-XZ-001", f"the level is null where the geometry isn't, or the other way round ({n})", early & (g.isNull() != F.col(n).isNull()), 10) for n in leaves]
    if d["encoding"] == "esriPBF":
        for i, x in enumerate(d["levels"]):
            # Rows whose payload isn't looked at have neither a geometry nor a payload for the check.
            df = df.withColumn(f"_bad{i}", _payload_check(family, x["resolution"], has_z, has_m)(F.when(early, g), F.when(early, F.col(leaves[i]))))
            faults += [
                (rule, f"{message} ({leaves[i]})", F.col(f"_bad{i}") == rule, 10)
                for rule, message in (("SOP-PBF-001", "the payload doesn't decode to vertices of the geometry"), ("SOP-PBF-002", "the payload is empty"), ("SOP-PBF-003", "a payload's ring turns the wrong way"))
            ]
    _found(r, df, faults)
    if d["encoding"] == "esriPBF" and leaves:
        filled = df.where(F.col("_row") < SAMPLE_PAYLOADS).groupBy("_file").agg(F.max((F.octet_length(F.col(leaves[0])) > 0).cast("int")).alias("some"), F.max("_row").alias("_row"), F.count(g).alias("n"))
        _collect(r, filled.where("n > 0 and coalesce(some, 0) = 0"), "SOP-PBF-004", "no payload in the first rows")


def _codes(meta, code: str) -> tuple[int, int] | None:
    """Least and largest code that the row groups' statistics name."""
    ends = []
    for g in range(meta.num_row_groups):
        rg = meta.row_group(g)
        col = next(rg.column(c) for c in range(rg.num_columns) if rg.column(c).path_in_schema == code)
        if col.statistics and col.statistics.has_min_max:
            ends += [int(col.statistics.min), int(col.statistics.max)]
    return (min(ends), max(ends)) if ends else None


def _opened(path: str):
    """A file's footer, its schema and the keys that its footer repeats, or why it has none."""
    try:
        return pq.read_metadata(path), pq.read_schema(path), pages.repeated_keys(path)
    except Exception as e:
        return e


def _footers(paths: list[str], ahead: int = 64):
    """Paths and what _opened gives, in order; some are read ahead at once."""
    with ThreadPoolExecutor(16) as pool:
        for s in range(0, len(paths), ahead):
            yield from zip(paths[s : s + ahead], pool.map(_opened, paths[s : s + ahead]))


def _ranges(r: Report, spark: SparkSession, files: list[_File]) -> None:
    rows = [(f.name, f.partition[1] if f.partition else None, *f.codes) for f in files if f.codes]
    if not rows:
        return
    df = spark.createDataFrame(rows, "file string, lower long, minimum long, maximum long")
    for x in clustering.range_overlaps(df).collect():  # one row a file
        r.add("SOP-RANGE-001", "the file's range of codes overlaps those before", x["file"])
    placed = df.where("lower is not null")
    bounds = placed.select("lower").distinct().withColumn("next", F.lead("lower").over(Window.orderBy("lower")))
    for x in placed.join(bounds, "lower").where("minimum < lower or maximum >= next").collect():
        r.add("SOP-PARTITION-001", "codes lie outside the partition's range", x["file"])


def validate(spark: SparkSession, location: str, mode: str = "sample") -> Report:
    import os

    r = Report()
    root = location if os.path.isdir(location) else os.path.dirname(location)
    files: list[_File] = []
    first: dict | None = None
    for path, got in _footers(formats.parquet_files(location, recursive=True)):
        r.files += 1
        name = os.path.relpath(path, root)
        if isinstance(got, Exception):
            r.add("SOP-PARQUET-001", f"can't be read: {got}", name)
            continue
        meta, schema, twice = got
        got = _metadata(r, name, meta, twice)
        if got is None:
            continue
        f = _File(os.path.abspath(path), name, schema, *got, formats.partition_of(path, root), meta.num_rows)
        this = {"kind": f.kind, "schema": [(x.name, str(x.type)) for x in schema], "metadata": (json.dumps(f.geo, sort_keys=True), json.dumps(f.display, sort_keys=True))}
        if first is None:
            first = this
        elif this["kind"] != first["kind"]:
            r.add("SOP-DATASET-001", "Z and XZ files are mixed", name)
            continue
        elif this["schema"] != first["schema"] or this["metadata"] != first["metadata"]:
            r.add("SOP-DATASET-001", "schema or metadata differ from the first file's", name)
            continue
        if _structure(r, f, meta):
            f.codes = _codes(meta, _name(f.display["code"]))
            files.append(f)
    if files:
        native = files[0].display.get("encoding") == "native"
        was = footers.read_nested_by_row(spark) if native else None
        try:
            _data(r, spark, files, mode)
        finally:
            if native:
                spark.conf.set("spark.sql.parquet.enableNestedColumnVectorizedReader", was)
        _ranges(r, spark, files)
    return r


