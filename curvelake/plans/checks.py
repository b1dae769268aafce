"""Registered queries for what a dataset's life touches besides rows: rules of the validator, formats, footers, levels in each encoding, ranges and layers.

The rules are tried on datasets of the nations, each spoilt in one way; the SQL names the rules that must be found, and no others.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import wkb as W
from ..functions.curves import Extent, in_ranges, merge_ranges, overlaps, z_ranges
from ..functions.lod import levels
from ..operators import analytics, viewport
from ..sources import footers, formats, geopackage
from . import convert as V
from . import datasets as D
from . import registry as R
from .validate import close, validate

FINEST = levels()[-1]
_RES = "(0.703125 / pow(2, 16))"


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return R.table(spark, sf_dir, "nation").select(k.cast("long").alias("id"), R.grid_x(k * 977).alias("x"), R.grid_y(k * 977).alias("y"))


def nation_file(spark: SparkSession, sf_dir: str, point: bool) -> str:
    """A clustered file of the nations, as points or as squares about them."""
    n, x, y = nations(spark, sf_dir), F.col("x"), F.col("y")
    return D.rewritten(spark, n.select("id", (C.make_point(x, y) if point else C.make_box(x - 0.5, y - 0.5, x + 0.5, y + 0.5)).alias("geometry")))


def altered(source: str, out: str, columns: dict | None = None, footer: dict | None = None, index: bool = True) -> str:
    """A copy of a file with other columns (name: function of a list) or footer entries (key: function of the entry; None drops it)."""
    t = pq.read_table(source, partitioning=None)
    for name, f in (columns or {}).items():
        i = t.schema.get_field_index(name)
        values = f(t.column(i).to_pylist())
        kind = pa.string() if isinstance(next((v for v in values if v is not None), None), str) else t.schema.field(i).type
        t = t.set_column(i, name, pa.array(values, kind))
    kv = footers.key_values(pq.read_metadata(source))
    for key, f in (footer or {}).items():
        kv[key] = json.dumps(f(json.loads(kv.get(key, "null")))) if f else None
    os.makedirs(os.path.dirname(out), exist_ok=True)
    with pq.ParquetWriter(out, t.schema.remove_metadata(), write_page_index=index, store_schema=False) as w:
        w.write_table(t)
        w.add_key_value_metadata({k: v for k, v in kv.items() if v is not None})
    return out


def _put(**entries):
    return lambda d: d | entries


def _geo(**entries):
    """Changes to the geometry column's entry."""
    return lambda d: d | {"columns": {k: v | entries for k, v in d["columns"].items()}}


def _without(*keys):
    return lambda d: {k: v for k, v in d.items() if k not in keys}


def _rings(change):
    """Each polygon's ring changed."""

    def f(values):
        rings = [change(W.decode(bytes(v)).xy.copy()) for v in values]
        return [W.encode(W.Geometry(3, False, False, xy, [len(xy)], [1])) for xy in rings]

    return f


def _hole(xy: np.ndarray) -> np.ndarray:
    xy[1, 0] = np.nan
    return xy


def _levels(change):
    return lambda rows: [{k: change(bytes(v)) for k, v in r.items()} for r in rows]


def _moved(rows):
    return [r | {"x": r["x"] + 1} for r in rows]


_LATER = lambda codes: [c + 1 for c in codes]
_BACK = lambda codes: codes[::-1]

#: case: whether the file is of points, changes to columns and to the footer, and the rules that must be found.
SPOILT = {
    "good squares": (False, {}, {}, ""),
    "good points": (True, {}, {}, ""),
    "no display metadata": (False, {}, {"geodisplay": None}, "SOP-META-001"),
    "display of an unknown type": (False, {}, {"geodisplay": _put(type="q")}, "SOP-META-003"),
    "display that isn't an object": (False, {}, {"geodisplay": lambda d: [1]}, "SOP-META-003"),
    "another version": (False, {}, {"geodisplay": _put(version="9")}, "SOP-META-004"),
    "code column not named": (False, {}, {"geodisplay": _put(code="")}, "SOP-META-005"),
    "precision beyond 32": (True, {}, {"geodisplay": _put(coordinatePrecision=40)}, "SOP-META-005"),
    "another geometry encoding": (False, {}, {"geo": _geo(encoding="other")}, "SOP-META-005"),
    "no writer": (False, {}, {"geodisplay": _without("writer")}, "SOP-META-006"),
    "another system": (False, {}, {"geodisplay": _put(wkid=3857)}, "SOP-CRS-001"),
    "reversed extent": (False, {}, {"geodisplay": _put(fullExtent={"xmin": 1, "ymin": 0, "xmax": 0, "ymax": 1})}, "SOP-EXTENT-001"),
    "extent other than the box": (False, {}, {"geo": _geo(bbox=[0, 0, 1, 1])}, "SOP-EXTENT-001"),
    "no extent": (False, {}, {"geodisplay": _without("fullExtent")}, "SOP-EXTENT-001"),
    "covering of another place": (False, {"bbox": lambda rows: [r | {"xmin": r["xmin"] + 1} for r in rows]}, {}, "SOP-EXTENT-001"),
    "declared family": (False, {}, {"geodisplay": _put(geometryType="polyline")}, "SOP-GEOMETRY-002"),
    "declared dimensions": (False, {}, {"geodisplay": _put(hasZ=True)}, "SOP-GEOMETRY-003"),
    "levels beyond the last": (False, {}, {"geodisplay": _put(maxLevel=40)}, "SOP-XZ-002"),
    "no such code column": (False, {}, {"geodisplay": _put(code="nothing")}, "SOP-XZ-001"),
    "no such column of points": (True, {}, {"geodisplay": _put(xColumn=["sop_geometry", "u"])}, "SOP-Z-001"),
    "text for geometry": (False, {"geometry": lambda values: ["POLYGON" for _ in values]}, {}, "SOP-SCHEMA-001"),
    "geometry cut short": (False, {"geometry": lambda values: [bytes(v)[:-1] for v in values]}, {}, "SOP-GEOMETRY-001"),
    # The payloads still have the vertex that the geometry has no longer.
    "a coordinate that is no number": (False, {"geometry": _rings(_hole)}, {}, "SOP-GEOMETRY-004,SOP-PBF-001"),
    "open rings": (False, {"geometry": _rings(lambda xy: xy[:-1])}, {}, "SOP-GEOMETRY-005"),
    "clockwise rings": (False, {"geometry": _rings(lambda xy: xy[::-1])}, {}, "SOP-GEOMETRY-006"),
    "squares out of order": (False, {"geokey": _BACK}, {}, "SOP-XZ-003,SOP-XZ-004"),
    "codes of other squares": (False, {"geokey": _LATER}, {}, "SOP-XZ-004"),
    "points out of order": (True, {"geokey": _BACK}, {}, "SOP-Z-002,SOP-Z-004"),
    "codes of other points": (True, {"geokey": _LATER}, {}, "SOP-Z-004"),
    "coordinates of other points": (True, {"sop_geometry": _moved}, {}, "SOP-Z-003"),
    "payloads that can't be read": (False, {"geolod": _levels(lambda v: b"\x12\x01\x05")}, {}, "SOP-PBF-001"),
    "empty payloads": (False, {"geolod": _levels(lambda v: b"")}, {}, "SOP-PBF-002,SOP-PBF-004"),
}

#: case: which datasets of several files are made, and the rules that must be found.
LAID_OUT = {
    "a repeated key": "SOP-META-002", "a file that is no Parquet": "SOP-PARQUET-001", "no page index": "SOP-PARQUET-002", "two files of one range": "SOP-RANGE-001", "files of two kinds": "SOP-DATASET-001", "files of two metadata": "SOP-DATASET-001",
    "squares in a folder of points": "SOP-PARTITION-001", "codes below the folder's": "SOP-PARTITION-001",
}


def _laid_out(case: str, squares: str, points: str, at: str) -> str:
    copy = lambda name, source=squares, **more: altered(source, os.path.join(at, name), **more)
    if case == "a repeated key":
        # Another key of the same length as geodisplay, written beside it, takes its name.
        path = copy("a.parquet", footer={"geodisplaX": lambda _: {}})
        with open(path, "rb") as f:
            data = f.read()
        with open(path, "wb") as f:
            f.write(data.replace(b"geodisplaX", b"geodisplay"))
        return path
    if case == "no page index":
        return copy("a.parquet", index=False)
    if case == "squares in a folder of points":
        copy("z_order=0/a.parquet")
    elif case == "codes below the folder's":
        copy(f"xz_order={1 << 60}/a.parquet")
    else:
        copy("a.parquet")
    if case == "a file that is no Parquet":
        with open(os.path.join(at, "b.parquet"), "wb") as f:
            f.write(b"PAR1 and no more")
    elif case == "two files of one range":
        copy("b.parquet")
    elif case == "files of two kinds":
        copy("b.parquet", points)
    elif case == "files of two metadata":
        copy("b.parquet", footer={"geodisplay": _put(writer={"name": "other", "version": "1"})})
    return at


def _rules_sql(rules: dict[str, str]) -> str:
    rows = ", ".join("('{}', '{}')".format(k.replace("'", "''"), v) for k, v in rules.items())
    return f"SELECT what, rules FROM (VALUES {rows}) t(what, rules)"


def _reports(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([(k, ",".join(validate(spark, p, "full").rules())) for k, p in paths.items()], "what string, rules string")


@R.query(_rules_sql({k: rules for k, (_, _, _, rules) in SPOILT.items()}))
def validate_rules(spark, sf_dir):
    """The rules found in each spoilt file."""
    good = {point: nation_file(spark, sf_dir, point) for point in (False, True)}
    at = D.folder(spark)
    return _reports(spark, {k: altered(good[point], os.path.join(at, f"{i}.parquet"), columns, footer) for i, (k, (point, columns, footer, _)) in enumerate(SPOILT.items())})


@R.query(_rules_sql(LAID_OUT))
def validate_layouts(spark, sf_dir):
    """The rules found in datasets of several files."""
    squares, points = nation_file(spark, sf_dir, False), nation_file(spark, sf_dir, True)
    return _reports(spark, {k: _laid_out(k, squares, points, D.folder(spark)) for k in LAID_OUT})


# Ranges


@R.query(D._POINTS_IN_VIEW)
def code_range_join(spark, sf_dir):
    """More ranges than a filter may name: they are joined, and the exact test follows."""
    ranges = z_ranges(R.FULL, R.VIEW, R.DEPTH, most=4000)
    assert len(ranges) > viewport.INLINE_RANGES
    box = {"xmin": F.col("x"), "xmax": F.col("x"), "ymin": F.col("y"), "ymax": F.col("y")}
    return viewport.filter_ranges(R.keyed_points(spark, sf_dir), "code", ranges).where(viewport.intersects(box, [R.VIEW])).select("id")


_SPANS = "SELECT n_nationkey AS id, (n_nationkey * 7 % 25) * 10 AS s, (n_nationkey * 7 % 25) * 10 + n_nationkey % 17 AS e FROM nation"


@R.query(f"WITH o AS (SELECT s, e, max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ({_SPANS})), g AS (SELECT *, sum(CASE WHEN before + 1 >= s THEN 0 ELSE 1 END) OVER (ORDER BY s, e) AS grp FROM o) SELECT min(s) AS s, max(e) AS e FROM g GROUP BY grp")
def merged_ranges(spark, sf_dir):
    """Ranges that touch or overlap made one, as planning does it."""
    k = F.col("n_nationkey").cast("long")
    rows = R.table(spark, sf_dir, "nation").select((k * 7 % 25 * 10).alias("s"), (k * 7 % 25 * 10 + k % 17).alias("e")).collect()  # one row a nation
    return spark.createDataFrame(merge_ranges([tuple(r) for r in rows]), "s long, e long")


@R.query("SELECT n_nationkey::BIGINT AS id, n_nationkey BETWEEN 3 AND 5 OR n_nationkey = 9 OR n_nationkey >= 20 AS inside, n_nationkey < 10 AND n_nationkey + 5 > 2 AS meets FROM nation")
def range_membership(spark, sf_dir):
    """Codes in ranges, by the column test and by the planner's, which must agree; and boxes that overlap with positive area."""
    ranges = [(3, 5), (9, 9), (20, 100)]
    rows = R.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id")).withColumn("inside", viewport.in_ranges("id", ranges)).collect()  # one row a nation
    assert all(in_ranges(r["id"], ranges) == r["inside"] for r in rows)
    other = Extent(2.0, 0.0, 10.0, 1.0)
    return spark.createDataFrame([(r["id"], r["inside"], overlaps(Extent(float(r["id"]), 0.0, r["id"] + 5.0, 1.0), other)) for r in rows], "id long, inside boolean, meets boolean")


# Levels in each encoding

_SNAPPED = f"round(xmin / {_RES}) * {_RES} AS x0, round(ymin / {_RES}) * {_RES} AS y0, round(xmax / {_RES}) * {_RES} AS x1, round(ymax / {_RES}) * {_RES} AS y1"


def _shapes(spark: SparkSession, sf_dir: str, encoding: str) -> DataFrame:
    df = R.boxes(spark, sf_dir).select("id", C.make_box(*R.box_columns().values()).alias("g"))
    return df.withColumn("v", C.lod_struct("g", "polygon", encoding=encoding, stored=[FINEST])[FINEST.column])


@R.query(f"WITH {R.BOXES_SQL} SELECT id, {_SNAPPED} FROM b")
def level_wkb(spark, sf_dir):
    """Bounds of the finest level as WKB."""
    return _shapes(spark, sf_dir, "wkb").withColumn("b", C.bounds("v")).select("id", *(F.col(f"b.{a}").alias(b) for a, b in (("xmin", "x0"), ("ymin", "y0"), ("xmax", "x1"), ("ymax", "y1"))))


@R.query(f"WITH {R.BOXES_SQL} SELECT id, 1::INT AS parts, 5::INT AS vertices, {_SNAPPED} FROM b")
def level_native(spark, sf_dir):
    """The finest level as lists: a counter-clockwise ring from the lower left."""
    part = F.element_at("v", 1)
    at = lambda i, k: F.element_at(part, i)[k]
    return _shapes(spark, sf_dir, "native").select("id", F.size("v").alias("parts"), F.size(part).alias("vertices"), at(1, "x").alias("x0"), at(1, "y").alias("y0"), at(3, "x").alias("x1"), at(3, "y").alias("y1"))


@R.query(f"WITH {R.BOXES_SQL} SELECT id, 'Polygon' AS kind, {_SNAPPED} FROM b")
def level_decoded(spark, sf_dir):
    """The finest payload decoded for display, and its corners through GeoJSON."""
    df = _shapes(spark, sf_dir, "pbf").withColumn("s", C.lod_decode("v", "polygon", FINEST.resolution)).withColumn("j", C.as_geojson("s.wkb"))
    corner = lambda i, k: F.get_json_object("j", f"$.coordinates[0][{i}][{k}]").cast("double")
    return df.select("id", F.get_json_object("j", "$.type").alias("kind"), corner(0, 0).alias("x0"), corner(0, 1).alias("y0"), corner(2, 0).alias("x1"), corner(2, 1).alias("y1"))


@R.query(f"""WITH {R.BOXES_SQL}, q AS (SELECT id, level, round(xmin / r) = round(xmax / r) AS thin, round(ymin / r) = round(ymax / r) AS flat FROM (SELECT *, 0.703125 / pow(2, level) AS r FROM b, range(0, 17, 2) t(level)))
SELECT id, level::BIGINT AS level, CASE WHEN thin AND flat THEN 1 WHEN thin OR flat THEN 3 ELSE 5 END::INT AS n FROM q""")
def level_vertex_counts(spark, sf_dir):
    """What each level keeps of a box: its corners, a line there and back, or its first vertex."""
    df = R.boxes(spark, sf_dir).select("id", C.make_box(*R.box_columns().values()).alias("g"))
    counts = F.array(*(F.struct(F.lit(x.level).cast("long").alias("level"), C.vertex_counts("g", x.resolution).alias("n")) for x in levels()))
    return df.select("id", F.explode(counts).alias("c")).select("id", "c.level", "c.n")


# Sources, footers and results


@R.query("SELECT location, format FROM (VALUES ('a.parquet', 'parquet'), ('b.GeoParquet', 'parquet'), ('c.gpkg', 'gpkg'), ('https://example.com/d.parquet?e=f.gpkg', 'parquet'), ('g.csv', NULL), ('h', NULL)) t(location, format)")
def format_resolution(spark, sf_dir):
    def of(location):
        try:
            return formats.resolve_format(location)
        except ValueError:
            return None

    given = ("a.parquet", "b.GeoParquet", "c.gpkg", "https://example.com/d.parquet?e=f.gpkg", "g.csv", "h")
    return spark.createDataFrame([(x, of(x)) for x in given], "location string, format string")


@R.query("SELECT count(*) AS n, 4326::INT AS wkid, 'Point' AS types, 'nations' AS title, 'nations' AS title_after, 4326::INT AS wkid_after FROM nation")
def footer_passthrough(spark, sf_dir):
    """A source's footer: entries of its own stay through a rewrite, and without a system it is longitude and latitude."""
    at = D.folder(spark)
    t = nations(spark, sf_dir).select("id", C.make_point(F.col("x"), F.col("y")).alias("geometry")).toArrow()  # one row a nation
    geo = {"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", "geometry_types": ["Point"]}}}
    source, out = os.path.join(at, "in.parquet"), os.path.join(at, "out.parquet")
    pq.write_table(t.replace_schema_metadata({"geo": json.dumps(geo), "title": "nations"}), source)
    V.convert(spark, V.InputOptions(source), V.OutputOptions(out))
    a, b = footers.read([source]), footers.read([out])
    return spark.createDataFrame([(a.rows, a.wkid, ",".join(a.types), dict(a.pairs).get("title"), dict(b.pairs).get("title"), b.wkid)], "n long, wkid int, types string, title string, title_after string, wkid_after int")


@R.query("SELECT n_nationkey::BIGINT AS id, 10::BIGINT AS expected, 10::BIGINT AS written FROM nation ORDER BY n_nationkey LIMIT 10 OFFSET 5")
def convert_row_range(spark, sf_dir):
    """A rewrite of ten rows of a file, from the sixth on, and what its result says."""
    at = D.folder(spark)
    source, out = os.path.join(at, "in"), os.path.join(at, "out.parquet")
    nations(spark, sf_dir).select("id", C.make_point(F.col("x"), F.col("y")).alias("geometry")).coalesce(1).sortWithinPartitions("id").write.parquet(source)
    got = V.convert(spark, V.InputOptions(source, geometry_column="geometry", in_sr=4326, start=5, num=10), V.OutputOptions(out))
    return spark.read.parquet(out).select("id", F.lit(got.rows_expected).cast("long").alias("expected"), F.lit(got.rows_written).cast("long").alias("written"))


@R.query("SELECT 'places' AS name, 'geom' AS geometry, 'Point' AS types, 4326::INT AS wkid, count(*) AS features, count(*) AS covered, 4::BIGINT AS splits FROM customer")
def geopackage_layers(spark, sf_dir):
    """A GeoPackage's layer: its types, its system, and its splits by row id, which have each row once."""
    path = os.path.join(D.folder(spark), "places.gpkg")
    D.geopackage_of(D.geometries(spark, sf_dir, "points"), path)
    x = geopackage.choose(path)
    cuts = geopackage.splits(path, "places", 4)
    ends = [(lo or 1, hi or x["features"] + 1) for lo, hi in cuts]
    row = (x["name"], x["geometry"], ",".join(geopackage.sampled_types(path, x)), geopackage.wkid(path, x["srs_id"]), x["features"], sum(hi - lo for lo, hi in ends), len(cuts))
    return spark.createDataFrame([row], "name string, geometry string, types string, wkid int, features long, covered long, splits long")


@R.query("SELECT spans, west, east FROM (VALUES ('over 180', 170.0::DOUBLE, 200.0::DOUBLE), ('east', 10.0, 40.0), ('world', -180.0, 180.0)) t(spans, west, east)")
def longitude_unions(spark, sf_dir):
    """The shortest interval that has all spans."""
    given = {"over 180": [(170.0, 190.0), (-175.0, -160.0)], "east": [(10.0, 20.0), (30.0, 40.0)], "world": [(-180.0, 0.0), (0.0, 180.0)]}
    return spark.createDataFrame([(k, *map(float, analytics.longitude_union(v))) for k, v in given.items()], "spans string, west double, east double")


@R.query(f"WITH {R._GROUPS_SQL} SELECT min(xmin) AS xmin, max(ymax) AS ymax, sum(n)::BIGINT AS n, true AS same FROM g")
def group_totals(spark, sf_dir):
    """Row groups united, whose bounds agree with those of the rows by the validator's relative test."""
    groups, rows = R.row_groups(spark, sf_dir), R.boxes(spark, sf_dir)
    a = groups.agg(F.min("xmin").alias("xmin"), F.max("ymax").alias("ymax"), F.sum("n").alias("n")).first()
    b = rows.agg(F.min("xmin").alias("xmin"), F.max("ymax").alias("ymax")).first()
    return spark.createDataFrame([(a["xmin"], a["ymax"], a["n"], close(a["xmin"], b["xmin"]) and close(a["ymax"], b["ymax"]))], "xmin double, ymax double, n long, same boolean")
