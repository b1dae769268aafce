"""Registered queries over datasets that are written first: rewrites read back, viewports, footers, layouts, checks and other sources.

Each call writes into a folder of its own below spark.checkpoint.dir (where that is unset, and Spark runs on this machine alone, a temporary one): the folder that the driver and the executors share.
"""

from __future__ import annotations

import os
import re
import sqlite3
import struct
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.curves import Extent, viewport_extents, zoom_resolution
from ..operators import clustering, inspect
from ..operators import query as Q
from ..sources import arrow, footers, formats, geopackage, pages
from . import convert as V
from . import registry as R
from .validate import validate


def folder(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    at = urlparse(at).path if at else tempfile.mkdtemp(prefix="curvelake-")
    path = os.path.join(at, f"datasets-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def geometries(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """id and geometry of the derived points or boxes."""
    if kind == "points":
        return R.points(spark, sf_dir).select("id", C.make_point(F.col("x"), F.col("y")).alias("geometry"))
    return R.boxes(spark, sf_dir).select("id", C.make_box(*R.box_columns().values()).alias("geometry"))


def rewritten(spark: SparkSession, df: DataFrame, parts: int | None = None, extent: Extent | None = R.FULL, **more) -> str:
    """Where a rewrite of df is, as one file or as a folder of parts."""
    at = folder(spark)
    df.write.parquet(os.path.join(at, "in"))
    out = os.path.join(at, "out" if parts else "out.parquet")
    options = V.OutputOptions(out, parts=parts, normalization_extent=extent, **({"covering": True} | more))
    V.convert(spark, V.InputOptions(os.path.join(at, "in"), geometry_column="geometry", in_sr=4326), options)
    return out


def _points_back(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("id", F.col("geokey").alias("code"), "sop_geometry.x", "sop_geometry.y", "bbox.xmin", "bbox.ymax")


_POINTS_BACK = f"WITH {R.Z_SQL} SELECT id, code, x::DOUBLE AS x, y::DOUBLE AS y, x::DOUBLE AS xmin, y::DOUBLE AS ymax FROM z"


@R.query(_POINTS_BACK)
def convert_points_single(spark, sf_dir):
    return _points_back(spark, rewritten(spark, geometries(spark, sf_dir, "points")))


@R.query(_POINTS_BACK)
def convert_points_8(spark, sf_dir):
    return _points_back(spark, rewritten(spark, geometries(spark, sf_dir, "points"), 8))


def _polygons_back(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("id", F.col("geokey").alias("code"), "bbox.xmin", "bbox.ymin", "bbox.xmax", "bbox.ymax", C.type_code("geometry").alias("type"))


_POLYGONS_BACK = f"WITH {R.XZ_SQL} SELECT id, code, xmin, ymin, xmax, ymax, 3::BIGINT AS type FROM xz"


@R.query(_POLYGONS_BACK)
def convert_polygons_single(spark, sf_dir):
    return _polygons_back(spark, rewritten(spark, geometries(spark, sf_dir, "polygons")))


@R.query(_POLYGONS_BACK)
def convert_polygons_8(spark, sf_dir):
    return _polygons_back(spark, rewritten(spark, geometries(spark, sf_dir, "polygons"), 8))


@R.query("SELECT count(*) AS n, 8::BIGINT AS files, 0::BIGINT AS out_of_order, 0::BIGINT AS out_of_bounds FROM orders")
def convert_order_8(spark, sf_dir):
    """Rows as they lie in the files of a partitioned rewrite: each file sorted by code, and each code within its folder's bounds."""
    df = spark.read.parquet(rewritten(spark, geometries(spark, sf_dir, "polygons"), 8)).select("geokey", "xz_order", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    outside = clustering.bound_violations(df, "geokey", "xz_order").agg(F.count("*").alias("out_of_bounds"))
    before = F.lag("geokey").over(Window.partitionBy("file").orderBy("row"))
    sizes = df.withColumn("bad", (F.col("geokey") < before).cast("long")).groupBy("file").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    # Each side is one row.
    return sizes.agg(F.sum("n").alias("n"), F.count("*").alias("files"), F.coalesce(F.sum("bad"), F.lit(0)).alias("out_of_order")).join(F.broadcast(outside))


@R.query(f"WITH {R.POINTS_SQL} SELECT id, x::DOUBLE AS x, y::DOUBLE AS y FROM p")
def convert_plain(spark, sf_dir):
    """A plain rewrite: the geometry as it was, without keys."""
    path = rewritten(spark, geometries(spark, sf_dir, "points"), extent=None, optimized=False)
    return spark.read.parquet(path).withColumn("p", C.point_parts("geometry")).select("id", "p.x", "p.y")


@R.query(f"WITH {R.POINTS_SQL} SELECT id, round(radians(x) * 6378137.0, 3) AS mx, round(ln(tan(pi()/4 + radians(y)/2)) * 6378137.0, 3) AS my FROM p WHERE abs(y) < 85")
def convert_to_mercator(spark, sf_dir):
    source = R.points(spark, sf_dir).where(F.abs("y") < 85).select("id", C.make_point(F.col("x"), F.col("y")).alias("geometry"))
    return spark.read.parquet(rewritten(spark, source, extent=None, out_sr=3857)).select("id", F.round("sop_geometry.x", 3).alias("mx"), F.round("sop_geometry.y", 3).alias("my"))


@R.query("SELECT c_custkey AS id, 1.5::DOUBLE AS z, 21::INT AS n FROM customer")
def convert_strips_z(spark, sf_dir):
    """With the third dimension the point has it in its columns; without, its geometry is flat."""
    source = R.points(spark, sf_dir).select("id", C.make_point(F.col("x"), F.col("y"), F.lit(1.5)).alias("geometry"))
    whole = spark.read.parquet(rewritten(spark, source)).select("id", "sop_geometry.z")
    flat = spark.read.parquet(rewritten(spark, source, strip_z=True)).select("id", F.octet_length("geometry").alias("n"))
    return whole.join(flat, "id")


# Viewports over files


def _in_view(spark: SparkSession, path: str) -> DataFrame:
    return Q.plan(Q.open_dataset(spark, path), [R.VIEW], zoom_resolution(16)).select("id")


_POINTS_IN_VIEW = f"WITH {R.POINTS_SQL} SELECT id FROM p WHERE x BETWEEN {R.VIEW.xmin} AND {R.VIEW.xmax} AND y BETWEEN {R.VIEW.ymin} AND {R.VIEW.ymax}"
_BOXES_IN_VIEW = f"WITH {R.BOXES_SQL} SELECT id FROM b WHERE {R._IN_VIEW}"


@R.query(_POINTS_IN_VIEW)
def dataset_viewport_points(spark, sf_dir):
    return _in_view(spark, rewritten(spark, geometries(spark, sf_dir, "points"), 8))


@R.query(_POINTS_IN_VIEW)
def dataset_viewport_points_depth_32(spark, sf_dir):
    """Codes of 64 bits, as decimals."""
    return _in_view(spark, rewritten(spark, geometries(spark, sf_dir, "points"), cluster_depth=32))


@R.query(_BOXES_IN_VIEW)
def dataset_viewport_polygons(spark, sf_dir):
    return _in_view(spark, rewritten(spark, geometries(spark, sf_dir, "polygons"), 8))


@R.query(_BOXES_IN_VIEW)
def dataset_viewport_wkb(spark, sf_dir):
    return _in_view(spark, rewritten(spark, geometries(spark, sf_dir, "polygons"), encoding="wkb"))


@R.query(_BOXES_IN_VIEW)
def dataset_viewport_native(spark, sf_dir):
    return _in_view(spark, rewritten(spark, geometries(spark, sf_dir, "polygons"), encoding="native"))


@R.query(f"WITH {R.BOXES_SQL}, f AS (SELECT count(*) AS n FROM b WHERE (xmax >= 150 AND xmin <= 180 OR xmax >= -180 AND xmin <= -150) AND ymin <= 60 AND ymax >= -30) SELECT least(n, 50) AS features, n > 50 AS limited FROM f")
def dataset_feature_limit(spark, sf_dir):
    """What a viewer is told of a view over the antimeridian, with a limit of 50 features."""
    rows, more = Q.viewport(spark, rewritten(spark, geometries(spark, sf_dir, "polygons"), 4), (150.0, -30.0, 210.0, 60.0), 16, 50)
    return rows.agg(F.count("*").alias("features")).withColumn("limited", F.lit(more))


# Footers, layouts and checks


@R.query(f"WITH {R.POINTS_SQL} SELECT count(*) AS n, 'Point' AS types, 4326::INT AS wkid, 'bbox' AS covering, min(x)::DOUBLE AS xmin, min(y)::DOUBLE AS ymin, max(x)::DOUBLE AS xmax, max(y)::DOUBLE AS ymax FROM p")
def dataset_metadata(spark, sf_dir):
    """What the footers of a partitioned rewrite say together."""
    m = footers.read(formats.parquet_files(rewritten(spark, geometries(spark, sf_dir, "points"), 4, extent=None), recursive=True))
    return spark.createDataFrame([(m.rows, ",".join(m.types), m.wkid, m.covering, *m.bbox)], "n long, types string, wkid int, covering string, xmin double, ymin double, xmax double, ymax double")


@R.query("SELECT count(*) AS n, ceil(count(*) / 1000.0)::BIGINT AS row_groups, 'SNAPPY' AS codec, 16::BIGINT AS columns FROM orders")
def layout_summary(spark, sf_dir):
    """Rows, row groups of 1,000 rows, codec and leaf columns (id, geometry, four of the box, the key, nine levels) of a rewrite's file."""
    path = rewritten(spark, geometries(spark, sf_dir, "polygons"), row_group_size=1000)
    return footers.summary(footers.layout_table(spark, [path])).select(F.col("rows").alias("n"), "row_groups", "codec", "columns")


def _checked(spark: SparkSession, path: str) -> DataFrame:
    report = validate(spark, path, "full")
    return spark.createDataFrame([(report.error_count, len(report.findings))], "errors long, findings long")


@R.query("SELECT 0::BIGINT AS errors, 0::BIGINT AS findings")
def validate_points(spark, sf_dir):
    return _checked(spark, rewritten(spark, geometries(spark, sf_dir, "points"), 4))


@R.query("SELECT 0::BIGINT AS errors, 0::BIGINT AS findings")
def validate_polygons(spark, sf_dir):
    return _checked(spark, rewritten(spark, geometries(spark, sf_dir, "polygons"), 4))


# Pages and byte ranges


def _paged(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    path = rewritten(spark, geometries(spark, sf_dir, "polygons"), row_group_size=1000, page_size=4096)
    return path, pages.pages(spark, [path], ["geokey", "geolod.level_0"])


@R.query("SELECT count(*) AS n, ceil(count(*) / 1000.0)::BIGINT AS row_groups, 0::BIGINT AS faults, true AS several FROM orders")
def page_topology(spark, sf_dir):
    """Rows that the pages of a level hold by the index, row groups, those whose pages can't be used, and whether there are more pages than row groups."""
    _, p = _paged(spark, sf_dir)
    level = p.where("column = 'geolod.level_0'")
    faults = inspect.topology_faults(p, "geolod.level_0").agg(F.count("*").alias("faults"))
    starts = inspect.topology(p, "geolod.level_0").agg(F.count("*").alias("starts"))
    # Each side is one row.
    sums = level.agg(F.sum("rows").alias("n"), F.countDistinct("row_group").alias("row_groups")).join(F.broadcast(faults)).join(F.broadcast(starts))
    return sums.select("n", "row_groups", "faults", (F.col("starts") > F.col("row_groups")).alias("several"))


@R.query("SELECT 7 * i AS row, floor(7 * i / 1000)::INT AS row_group FROM (SELECT unnest(range(0, (SELECT count(*) FROM orders) // 7)) AS i)")
def row_group_lookup(spark, sf_dir):
    path, _ = _paged(spark, sf_dir)
    groups = footers.layout_table(spark, [path]).select("file", "row_group", "first_row", "rows").distinct()
    n = spark.read.parquet(path).count()
    rows = spark.range(n // 7).select(F.lit(path).alias("file"), (F.col("id") * 7).alias("row"))
    return inspect.row_groups_of(rows, groups).select("row", "row_group")


@R.query("SELECT true AS whole, true AS dictionary")
def page_gaps(spark, sf_dir):
    """Pages and gaps together make up each chunk's bytes; a column with a dictionary has a gap before its first page."""
    path = rewritten(spark, geometries(spark, sf_dir, "points").select("*", (F.col("id") % 5).cast("string").alias("kind")), row_group_size=1000)
    p = pages.pages(spark, [path])
    of_pages = p.groupBy(*inspect.CHUNK).agg(F.sum("compressed").alias("held"), F.first(F.col("chunk_end") - F.col("chunk_start")).alias("all"))
    of_gaps = inspect.gaps(p).groupBy(*inspect.CHUNK).agg(F.sum(F.col("end") - F.col("start")).alias("gap"))
    both = of_pages.join(of_gaps, inspect.CHUNK, "left")
    return both.agg(F.bool_and(F.col("held") + F.coalesce("gap", F.lit(0)) == F.col("all")).alias("whole"), F.bool_and((F.col("column") != "kind") | (F.col("gap") > 0)).alias("dictionary"))


@R.query(f"WITH {R.BOXES_SQL} SELECT count(*) AS n, ceil(count(*) / 1000.0)::BIGINT AS row_groups, min(xmin)::DOUBLE AS xmin, min(ymin)::DOUBLE AS ymin, max(xmax)::DOUBLE AS xmax, max(ymax)::DOUBLE AS ymax FROM b")
def native_row_group_bounds(spark, sf_dir):
    """What the GEOMETRY type's statistics say of the row groups, together."""
    path = rewritten(spark, geometries(spark, sf_dir, "polygons"), row_group_size=1000)
    b = pages.native_bounds(spark, [path], "geometry")
    return b.agg(F.sum("n").alias("n"), F.count("*").alias("row_groups"), F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


_LOADED = "SELECT (o_orderkey % 5)::VARCHAR AS file, o_orderkey * 10 AS s, o_orderkey * 10 + o_orderkey % 17 AS e FROM orders"


@R.query(
    f"WITH h AS (SELECT DISTINCT file, unnest(range(s, e)) AS byte FROM ({_LOADED})), q AS (SELECT o_orderkey AS id, (o_orderkey % 5)::VARCHAR AS file, o_orderkey * 9 AS s, o_orderkey * 9 + o_orderkey % 90 AS e FROM orders), "
    "w AS (SELECT id, file, unnest(range(s, e)) AS byte FROM q), c AS (SELECT id, count(*) AS covered FROM w JOIN h USING (file, byte) GROUP BY id) "
    "SELECT id, coalesce(covered, 0) AS covered, CASE WHEN e > s THEN coalesce(covered, 0) / (e - s)::DOUBLE ELSE 0.0 END AS fraction FROM q LEFT JOIN c USING (id)"
)
def byte_coverage(spark, sf_dir):
    """How much of each range of bytes the loaded ranges of its file hold."""
    o, key = R.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    file = (key % 5).cast("string").alias("file")
    loaded = o.select(file, (key * 10).alias("start"), (key * 10 + key % 17).alias("end"))
    asked = o.select(key.alias("id"), file, (key * 9).alias("start"), (key * 9 + key % 90).alias("end"))
    return inspect.coverage(asked, loaded).select("id", "covered", "fraction")


@R.query("SELECT o_orderkey AS id, o_totalprice AS bytes FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def largest_first(spark, sf_dir):
    """The 25 largest, as an inspector lists them."""
    return inspect.largest(R.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("bytes")), "bytes", 25, "id")


# Other sources


def geopackage_of(rows: DataFrame, path: str) -> None:
    """A small GeoPackage of id and geometry (WKB), on the driver: what its reader is tried on."""
    con = sqlite3.connect(path)
    con.executescript(
        "create table gpkg_spatial_ref_sys (srs_name text, srs_id integer primary key, organization text, organization_coordsys_id integer, definition text, description text);"
        "insert into gpkg_spatial_ref_sys values ('WGS 84', 4326, 'EPSG', 4326, '', '');"
        "create table gpkg_contents (table_name text primary key, data_type text, identifier text, description text, last_change text, min_x real, min_y real, max_x real, max_y real, srs_id integer);"
        "create table gpkg_geometry_columns (table_name text, column_name text, geometry_type_name text, srs_id integer, z integer, m integer);"
        "insert into gpkg_contents values ('places', 'features', 'places', '', '', null, null, null, null, 4326);"
        "insert into gpkg_geometry_columns values ('places', 'geom', 'POINT', 4326, 0, 0);"
        "create table places (fid integer primary key, id integer, geom blob);"
    )
    head = b"GP\0\1" + struct.pack("<i", 4326)
    con.executemany("insert into places (id, geom) values (?, ?)", ((r["id"], head + bytes(r["geometry"])) for r in rows.toLocalIterator()))
    con.commit()
    con.close()


@R.query(f"WITH {R.POINTS_SQL} SELECT id, x::DOUBLE AS x, y::DOUBLE AS y FROM p")
def geopackage_scan(spark, sf_dir):
    path = os.path.join(folder(spark), "places.gpkg")
    geopackage_of(geometries(spark, sf_dir, "points"), path)
    df = geopackage.read(spark, path, "places", 4)
    return df.withColumn("p", C.point_parts("geom")).select(F.col("id").cast("long").alias("id"), "p.x", "p.y")


@R.query(f"WITH {R.POINTS_SQL} SELECT id, x::DOUBLE AS x, y::DOUBLE AS y FROM p")
def arrow_scan(spark, sf_dir):
    table = geometries(spark, sf_dir, "points").toArrow()
    df, _ = arrow.read(spark, table, arrow.GeometryDeclaration("geometry", ("Point",), 4326))
    return df.withColumn("p", C.point_parts("geometry")).select("id", "p.x", "p.y")


@R.query(f"WITH {R.BOXES_SQL} SELECT count(*) AS n FROM b WHERE {R._IN_VIEW}")
def viewport_extent_count(spark, sf_dir):
    """The same view asked for in longitudes a turn further east."""
    path = rewritten(spark, geometries(spark, sf_dir, "polygons"), 8)
    parts = viewport_extents(R.VIEW.xmin + 360, R.VIEW.ymin, R.VIEW.xmax + 360, R.VIEW.ymax, R.FULL)
    return Q.plan(Q.open_dataset(spark, path), parts, zoom_resolution(16)).agg(F.count("*").alias("n"))
