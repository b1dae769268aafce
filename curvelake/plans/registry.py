"""The engine's registered queries and the SQL that each must agree with.

The tables have no geometry, so points, boxes and lines are derived from keys on a dyadic grid, on which the JVM, numpy and DuckDB agree to the bit. Factors of the keys spread them over the world at every scale.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.curves import Extent, level_for, viewport_extents, zoom_resolution
from ..functions.lod import levels
from ..operators import analytics, clustering, extents, viewport

FULL = Extent(-256.0, -256.0, 256.0, 256.0)
VIEW = Extent(-100.0, -50.0, -20.0, 40.0)
DEPTH = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid_x(key: Column) -> Column:
    return F.lit(-179.0) + F.pmod(key * 7919, F.lit(358000)) / F.lit(1024.0)


def grid_y(key: Column) -> Column:
    return F.lit(-89.0) + F.pmod(key * 6007, F.lit(178000)) / F.lit(1024.0)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), grid_x(k).alias("x"), grid_y(k).alias("y"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    r = (F.lit(5) + F.pmod(k, F.lit(16))) / F.lit(1024.0)
    xy = table(spark, sf_dir, "orders").select(k.alias("id"), grid_x(k).alias("x"), grid_y(k).alias("y"), r.alias("r"))
    return xy.select("id", (F.col("x") - F.col("r")).alias("xmin"), (F.col("y") - F.col("r")).alias("ymin"), (F.col("x") + F.col("r")).alias("xmax"), (F.col("y") + F.col("r")).alias("ymax"))


def keyed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).withColumn("code", C.z_code("x", "y", FULL, DEPTH))


def keyed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).withColumn("code", C.xz_code(*map(F.col, ("xmin", "ymin", "xmax", "ymax")), FULL, DEPTH))


def box_columns() -> dict[str, Column]:
    return {k: F.col(k) for k in ("xmin", "ymin", "xmax", "ymax")}


POINTS_SQL = "p AS (SELECT c_custkey AS id, -179.0 + ((c_custkey*7919) % 358000)/1024.0 AS x, -89.0 + ((c_custkey*6007) % 178000)/1024.0 AS y FROM customer)"
BOXES_SQL = """k AS (SELECT o_orderkey AS id, -179.0::DOUBLE + ((o_orderkey*7919) % 358000)/1024.0 AS x, -89.0::DOUBLE + ((o_orderkey*6007) % 178000)/1024.0 AS y, (5 + o_orderkey % 16)/1024.0 AS r FROM orders),
b AS (SELECT id, x-r AS xmin, y-r AS ymin, x+r AS xmax, y+r AS ymax FROM k)"""
CELLS_SQL = "c AS (SELECT *, least(greatest(floor((x+256)/512*1048576), 0), 1048575)::BIGINT AS cx, least(greatest(floor((y+256)/512*1048576), 0), 1048575)::BIGINT AS cy FROM p)"
Z_SQL = f"{POINTS_SQL}, {CELLS_SQL}, z AS (SELECT id, x, y, (SELECT sum((((cx >> i::INT) & 1) << (2*i)::INT) + (((cy >> i::INT) & 1) << (2*i+1)::INT)) FROM range(0, 20) t(i))::BIGINT AS code FROM c)"
XZ_SQL = f"""{BOXES_SQL}, l AS (SELECT *, least(floor(least(log2(512/(xmax-xmin)), log2(512/(ymax-ymin))))+1, 20)::INT AS l0 FROM b),
v AS (SELECT *, l0 - CASE WHEN floor((xmax+256)/512*pow(2,l0)) - floor((xmin+256)/512*pow(2,l0)) > 1 OR floor((ymax+256)/512*pow(2,l0)) - floor((ymin+256)/512*pow(2,l0)) > 1 THEN 1 ELSE 0 END AS lv FROM l),
i AS (SELECT *, floor((xmin+256)/512*pow(2,lv))::BIGINT AS ix, floor((ymin+256)/512*pow(2,lv))::BIGINT AS iy FROM v),
xz AS (SELECT id, xmin, ymin, xmax, ymax, (SELECT coalesce(sum((((ix>>(lv-1-d)::INT)&1)+2*((iy>>(lv-1-d)::INT)&1))*((pow(4,20-d)::BIGINT-1)//3)+1),0) FROM range(0,lv) t(d))::BIGINT AS code FROM i)"""

FOUND: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None):
    def add(f):
        FOUND[f.__name__] = (f, sql)
        return f

    return add


# Keys and order


@query(f"WITH {Z_SQL} SELECT id, code FROM z")
def point_z_code(spark, sf_dir):
    return keyed_points(spark, sf_dir).select("id", "code")


@query(f"WITH {XZ_SQL} SELECT id, code FROM xz")
def bbox_xz_code(spark, sf_dir):
    return keyed_boxes(spark, sf_dir).select("id", "code")


@query(f"WITH {XZ_SQL} SELECT id, code FROM xz")
def geometry_xz_code(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return b.select("id", C.make_box(*box_columns().values()).alias("g")).select("id", C.xz_code_of("g", FULL, DEPTH).alias("code"))


@query(f"WITH {POINTS_SQL} SELECT min(x)::DOUBLE AS xmin, min(y)::DOUBLE AS ymin, max(x)::DOUBLE AS xmax, max(y)::DOUBLE AS ymax FROM p")
def dataset_extent(spark, sf_dir):
    return extents.extent_row(points(spark, sf_dir), "x", "y", "x", "y")


@query(f"WITH {Z_SQL} SELECT id, code, row_number() OVER (ORDER BY code, id) AS place FROM z")
def z_clustered_order(spark, sf_dir):
    """The place of each row in the global order, counted by range partition: a row's offset is the size of the ranges before plus its place in its own."""
    df = keyed_points(spark, sf_dir).select("id", "code")
    lower = clustering.boundaries(df, "code", 32)
    ranged = df.withColumn("lower", clustering.range_column("code", sorted(set(lower))))
    sizes = ranged.groupBy("lower").agg(F.count("*").alias("n"))
    before = sizes.select("lower", (F.sum("n").over(Window.orderBy("lower")) - F.col("n")).alias("before"))  # one row a range
    place = F.row_number().over(Window.partitionBy("lower").orderBy("code", "id"))
    return ranged.withColumn("r", place).join(F.broadcast(before), "lower").select("id", "code", (F.col("before") + F.col("r")).cast("long").alias("place"))


def _bounds_sql(n: int) -> str:
    return ", ".join(f"quantile_disc(code, {i / n!r})" for i in range(1, n))


@query(f"WITH {Z_SQL} SELECT i AS part, bound FROM (SELECT unnest(range(0, 8)) AS i, unnest([min(code), {_bounds_sql(8)}]) AS bound FROM z)")
def cluster_range_boundaries(spark, sf_dir):
    df = keyed_points(spark, sf_dir)
    return spark.createDataFrame(list(enumerate(clustering.boundaries(df, "code", 8, exact=True))), "part long, bound long")


LOWER = [0, 200_000_000_000, 400_000_000_000, 600_000_000_000, 800_000_000_000]
_CASE = "CASE WHEN code < 200000000000 THEN 0 WHEN code < 400000000000 THEN 200000000000 WHEN code < 600000000000 THEN 400000000000 WHEN code < 800000000000 THEN 600000000000 ELSE 800000000000 END"


@query(f"WITH {Z_SQL} SELECT ({_CASE})::BIGINT AS z_order, count(*) AS n, min(code) AS minimum, max(code) AS maximum FROM z GROUP BY 1")
def range_partition_counts(spark, sf_dir):
    df = keyed_points(spark, sf_dir).withColumn("z_order", clustering.range_column("code", LOWER))
    return df.groupBy("z_order").agg(F.count("*").alias("n"), F.min("code").alias("minimum"), F.max("code").alias("maximum"))


@query(f"WITH {Z_SQL} SELECT ({_CASE})::BIGINT AS z_order, count(*) AS n, 0::BIGINT AS out_of_order FROM z GROUP BY 1")
def partition_sorted_check(spark, sf_dir):
    df = clustering.partitioned_sort(keyed_points(spark, sf_dir), "code", LOWER, "z_order").select("z_order", "code", F.monotonically_increasing_id().alias("at"))
    before = F.lag("code").over(Window.partitionBy("z_order").orderBy("at"))
    return df.withColumn("bad", (F.col("code") < before).cast("long")).groupBy("z_order").agg(F.count("*").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("out_of_order"))


# Levels


@query("SELECT level::BIGINT AS level, 0.703125 / pow(2, level) AS resolution, 295829355.4545656 / pow(2, level) AS scale FROM range(0, 17, 2) t(level)")
def lod_levels(spark, sf_dir):
    return spark.createDataFrame([(x.level, x.resolution, x.scale) for x in levels()], "level long, resolution double, scale double")


@query("""SELECT zoom::BIGINT AS zoom, coalesce((SELECT min(level) FROM range(0, 17, 2) t(level) WHERE 0.703125 / pow(2, level) <= 360 / (512 * pow(2, zoom)) * pow(2, 0.001)), 16)::BIGINT AS level FROM range(0, 21) z(zoom)""")
def lod_level_choice(spark, sf_dir):
    return spark.createDataFrame([(z, level_for(zoom_resolution(z)).level) for z in range(21)], "zoom long, level long")


@query(f"WITH {POINTS_SQL} SELECT id, level::BIGINT AS level, round(x / (0.703125 / pow(2, level)))::BIGINT AS qx, round(y / (0.703125 / pow(2, level)))::BIGINT AS qy FROM p, range(0, 17, 2) t(level)")
def quantized_points(spark, sf_dir):
    df = points(spark, sf_dir).withColumn("level", F.explode(F.array(*(F.lit(x.level).cast("long") for x in levels()))))
    res = F.lit(levels()[0].resolution) / F.pow(F.lit(2.0), F.col("level"))
    return df.select("id", "level", C.quantized(F.col("x"), res).alias("qx"), C.quantized(F.col("y"), res).alias("qy"))


def event_lines(spark, sf_dir) -> DataFrame:
    """A line for each user: its events in order, one step in x for each, the value in y. A user's events are collected in one row, as its line must be."""
    ev = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("e"))
    v = F.transform("e", lambda e, i: F.struct((i / F.lit(1024.0)).alias("x"), (F.floor(e["value"]) / F.lit(1024.0)).alias("y")))
    return ev.select("user_id", C.make_line(v).alias("g"))


_LINES_SQL = "o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, floor(value)::BIGINT AS y FROM events)"


@query(f"""WITH {_LINES_SQL}, s AS (SELECT *, y - lag(y) OVER w AS d, lead(y) OVER w - y AS e FROM o WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, count(*) FILTER (d IS NULL OR e IS NULL OR d <> e)::INT AS n FROM s GROUP BY 1""")
def collinear_merge_counts(spark, sf_dir):
    """Vertices that a lossless grid keeps: those where the direction changes."""
    return event_lines(spark, sf_dir).select("user_id", C.vertex_counts("g", 1 / 1024).alias("n"))


_DP_SQL = f"""WITH RECURSIVE {_LINES_SQL}, p AS MATERIALIZED (SELECT user_id, i, i / 1024.0::DOUBLE AS x, y / 1024.0::DOUBLE AS y FROM o),
s AS (SELECT user_id, 0::BIGINT AS a, max(i)::BIGINT AS b, false AS cut FROM p GROUP BY 1
UNION ALL
SELECT user_id, unnest(CASE WHEN d > 0.0625::DOUBLE * 0.0625::DOUBLE THEN [a, k] ELSE [] END)::BIGINT, unnest(CASE WHEN d > 0.0625::DOUBLE * 0.0625::DOUBLE THEN [k, b] ELSE [] END)::BIGINT, true FROM (
SELECT user_id, a, b, max(d) AS d, min(i) FILTER (d = m) AS k FROM (
SELECT *, max(d) OVER (PARTITION BY user_id, a, b) AS m FROM (
SELECT user_id, a, b, i, (px - (ax + t * dx)) * (px - (ax + t * dx)) + (py - (ay + t * dy)) * (py - (ay + t * dy)) AS d FROM (
SELECT *, least(greatest(((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy), 0.0), 1.0) AS t FROM (
SELECT s.user_id, s.a, s.b, c.i, c.x AS px, c.y AS py, f.x AS ax, f.y AS ay, g.x - f.x AS dx, g.y - f.y AS dy
FROM s JOIN p f ON f.user_id = s.user_id AND f.i = s.a JOIN p g ON g.user_id = s.user_id AND g.i = s.b JOIN p c ON c.user_id = s.user_id AND c.i > s.a AND c.i < s.b)))) GROUP BY user_id, a, b)),
k AS (SELECT DISTINCT user_id, unnest([a, b]) AS i FROM s), v AS (SELECT user_id, i, round(x / 0.0625) AS gx, round(y / 0.0625) AS gy FROM k JOIN p USING (user_id, i)),
w AS (SELECT *, lag(gx) OVER u AS lx, lag(gy) OVER u AS ly FROM v WINDOW u AS (PARTITION BY user_id ORDER BY i)),
n AS (SELECT user_id, count(*) FILTER (lx IS NULL OR gx <> lx OR gy <> ly)::INT AS n FROM w GROUP BY 1) SELECT user_id, n FROM n"""


@query(_DP_SQL)
def dp_simplified_counts(spark, sf_dir):
    """Vertices that are left where lines are simplified before they are snapped."""
    return event_lines(spark, sf_dir).select("user_id", C.vertex_counts("g", 64 / 1024, has_z=True).alias("n"))


_LOD_SQL = "(0.703125 / pow(2, 16))"


@query(f"""WITH {BOXES_SQL}, q AS (SELECT id, round(xmin / {_LOD_SQL})::BIGINT AS x0, round(ymin / {_LOD_SQL})::BIGINT AS y0, round(xmax / {_LOD_SQL})::BIGINT AS x1, round(ymax / {_LOD_SQL})::BIGINT AS y1 FROM b)
SELECT id, '5' AS lengths, concat_ws(',', x0, y0, x0, y1, x1, y1, x1, y0, x0, y0) AS coords FROM q""")
def pbf_roundtrip(spark, sf_dir):
    """The finest level of each box, encoded, decoded: a clockwise ring on the grid."""
    df = boxes(spark, sf_dir).select("id", C.make_box(*box_columns().values()).alias("g")).withColumn("lod", C.lod_struct("g", "polygon", stored=levels()[-1:]))
    df = df.withColumn("p", C.pbf_parts("lod.level_16"))
    return df.select("id", F.array_join(F.transform("p.lengths", lambda v: v.cast("string")), ",").alias("lengths"), F.array_join(F.transform("p.coords", lambda v: v.cast("string")), ",").alias("coords"))


# Queries

_IN_VIEW = f"xmin <= {VIEW.xmax} AND xmax >= {VIEW.xmin} AND ymin <= {VIEW.ymax} AND ymax >= {VIEW.ymin}"


@query(f"WITH {BOXES_SQL} SELECT id, xmin, ymin, xmax, ymax FROM b WHERE {_IN_VIEW}")
def viewport_xz_query(spark, sf_dir):
    found = viewport.xz_query(keyed_boxes(spark, sf_dir), "code", box_columns(), [VIEW], FULL, DEPTH)
    return found.select("id", "xmin", "ymin", "xmax", "ymax")


@query(f"WITH {BOXES_SQL} SELECT id FROM b WHERE (xmax >= 150 AND xmin <= 180 OR xmax >= -180 AND xmin <= -150) AND ymin <= 60 AND ymax >= -30")
def viewport_antimeridian(spark, sf_dir):
    parts = viewport_extents(150.0, -30.0, 210.0, 60.0, FULL)
    return viewport.xz_query(keyed_boxes(spark, sf_dir), "code", box_columns(), parts, FULL, DEPTH).select("id")


@query(f"WITH {POINTS_SQL} SELECT id, x::DOUBLE AS x, y::DOUBLE AS y FROM p WHERE x BETWEEN {VIEW.xmin} AND {VIEW.xmax} AND y BETWEEN {VIEW.ymin} AND {VIEW.ymax}")
def viewport_z_query(spark, sf_dir):
    return viewport.z_query(keyed_points(spark, sf_dir), "code", "x", "y", [VIEW], FULL, DEPTH).select("id", "x", "y")


@query(f"WITH {BOXES_SQL} SELECT count(*) AS n FROM b WHERE {_IN_VIEW}")
def viewport_lod_features(spark, sf_dir):
    """Features that a viewer gets at its finest level, through level payloads. Every box here is wider than the level's grid, whose error at the edges no box of these tables meets."""
    df = keyed_boxes(spark, sf_dir).withColumn("geolod", C.lod_struct(C.make_box(*box_columns().values()), "polygon", stored=levels()[-1:]))
    return viewport.features(df, "code", "geolod", "polygon", [VIEW], zoom_resolution(16), FULL, depth=DEPTH, limit=None).agg(F.count("*").alias("n"))


@query(f"WITH {BOXES_SQL} SELECT least(count(*), 100) AS features, count(*) > 100 AS limited FROM b WHERE {_IN_VIEW}")
def feature_limit_flag(spark, sf_dir):
    return viewport.limited(viewport.xz_query(keyed_boxes(spark, sf_dir), "code", box_columns(), [VIEW], FULL, DEPTH), 100)


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_custkey LIMIT 40 OFFSET 25")
def row_range_selection(spark, sf_dir):
    from ..sources.ranges import row_range

    return row_range(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), 25, 40, ["c_custkey"])


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000 AND c_custkey >= 10 AND c_custkey < 900")
def attribute_threshold(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "customer").where((c("c_acctbal") > 5000) & (c("c_custkey") >= 10) & (c("c_custkey") < 900)).select("c_custkey", "c_acctbal")


# Well-known binary


@query(f"WITH {POINTS_SQL} SELECT id, x::DOUBLE AS x, y::DOUBLE AS y, id::DOUBLE AS z, 1::BIGINT AS type FROM p")
def wkb_point_roundtrip(spark, sf_dir):
    df = points(spark, sf_dir).select("id", C.make_point(F.col("x"), F.col("y"), F.col("id").cast("double")).alias("g"))
    return df.withColumn("p", C.point_parts("g")).select("id", "p.x", "p.y", "p.z", C.type_code("g").alias("type"))


@query(f"WITH {BOXES_SQL} SELECT id, xmin, ymin, xmax, ymax FROM b")
def wkb_bounds(spark, sf_dir):
    df = boxes(spark, sf_dir).select("id", C.make_box(*box_columns().values()).alias("g")).withColumn("b", C.bounds("g"))
    return df.withColumn("bbox", C.covering("g", F.col("b"))).select("id", "bbox.*")


@query(f"WITH {BOXES_SQL} SELECT 'Polygon' AS types, 'polygon' AS family, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM b")
def geometry_type_resolution(spark, sf_dir):
    df = boxes(spark, sf_dir).select(C.make_box(*box_columns().values()).alias("g"))
    got = extents.geometry_metadata(df, "g")
    family = F.when(F.forall("types", lambda t: t.startswith("Polygon") | t.startswith("MultiPolygon")), "polygon")
    return got.select(F.array_join("types", ",").alias("types"), family.alias("family"), "xmin", "ymin", "xmax", "ymax")


@query("SELECT c_custkey AS id, 29::INT AS n_full, 21::INT AS n_flat, 1001::BIGINT AS type_full, 'Point' AS type_flat FROM customer")
def strip_dimensions(spark, sf_dir):
    df = points(spark, sf_dir).select("id", C.make_point(F.col("x"), F.col("y"), F.lit(1.5)).alias("g")).withColumn("f", C.strip_dims("g", True, False))
    code = F.conv(F.concat(*(F.hex(F.substring("g", i, 1)) for i in (5, 4, 3, 2))), 16, 10).cast("long")
    return df.select("id", F.octet_length("g").alias("n_full"), F.octet_length("f").alias("n_flat"), code.alias("type_full"), C.header("f")["type"].alias("type_flat"))


# Reference systems


@query(f"WITH {POINTS_SQL} SELECT id, round(radians(x) * 6378137.0, 3) AS mx, round(ln(tan(pi()/4 + radians(y)/2)) * 6378137.0, 3) AS my FROM p")
def web_mercator_points(spark, sf_dir):
    df = points(spark, sf_dir).where(F.abs("y") < 85).select("id", C.make_point(F.col("x"), F.col("y")).alias("g"))
    rest = points(spark, sf_dir).where(F.abs("y") >= 85)  # beyond the square world only the formula applies
    got = df.withColumn("p", C.point_parts(C.to_crs("g", 4326, 3857))).select("id", F.round("p.x", 3).alias("mx"), F.round("p.y", 3).alias("my"))
    mx, my = C.mercator(F.col("x"), F.col("y"))
    return got.union(rest.select("id", F.round(mx, 3), F.round(my, 3)))


@query(f"WITH {POINTS_SQL} SELECT count(*) AS n FROM p WHERE NOT abs(ln(tan(pi()/4 + radians(y)/2)) * 6378137.0) <= 20037508.342789244")
def mercator_domain_violations(spark, sf_dir):
    return points(spark, sf_dir).where(C.outside_mercator(F.col("x"), F.col("y"))).agg(F.count("*").alias("n"))


# Validation


@query(f"WITH {Z_SQL}, o AS (SELECT id, id // 100 AS f, code, lag(code) OVER (PARTITION BY id // 100 ORDER BY id) AS previous FROM z) SELECT id, f, code, previous FROM o WHERE code < previous")
def code_order_violations(spark, sf_dir):
    df = keyed_points(spark, sf_dir).withColumn("f", F.floor(F.col("id") / 100))
    return clustering.order_violations(df.select("id", "f", "code"), "code", ["f"], "id")


@query(f"""WITH {Z_SQL}, g AS (SELECT (id % 5) * 200000000000 AS lower, min(code) AS least, max(code) AS most FROM z GROUP BY 1), n AS (SELECT *, lead(lower) OVER (ORDER BY lower) AS next_lower FROM g)
SELECT lower::BIGINT AS lower, least, most, next_lower::BIGINT AS next_lower FROM n WHERE least < lower OR most >= next_lower""")
def partition_bound_violations(spark, sf_dir):
    df = keyed_points(spark, sf_dir).withColumn("lower", F.pmod("id", F.lit(5)) * F.lit(200_000_000_000))
    return clustering.bound_violations(df, "code", "lower")


@query(f"""WITH {Z_SQL}, g AS (SELECT id // 50 AS file, min(code) AS minimum, max(code) AS maximum FROM z GROUP BY 1),
o AS (SELECT *, max(maximum) OVER (ORDER BY minimum, maximum, file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g) SELECT file, minimum, maximum, before FROM o WHERE minimum <= before""")
def range_overlaps(spark, sf_dir):
    files = keyed_points(spark, sf_dir).groupBy(F.floor(F.col("id") / 50).alias("file")).agg(F.min("code").alias("minimum"), F.max("code").alias("maximum"))
    return clustering.range_overlaps(files)


@query(f"WITH {BOXES_SQL} SELECT id, round((xmax-xmin)*(ymax-ymin), 9) AS area, true AS closed, true AS counter_clockwise FROM b")
def ring_area_winding(spark, sf_dir):
    df = boxes(spark, sf_dir).select("id", C.make_box(*box_columns().values()).alias("g")).withColumn("i", C.inspect("g"))
    ring = F.element_at("i.rings", 1)
    return df.select("id", F.round(ring["area"], 9).alias("area"), ring["closed"].alias("closed"), (ring["area"] > 0).alias("counter_clockwise"))


# Layout analytics


def row_groups(spark, sf_dir) -> DataFrame:
    b = keyed_boxes(spark, sf_dir).withColumn("row_group", F.floor(F.col("id") / 100))
    return b.groupBy("row_group").agg(F.count("*").alias("n"), *(f(k).alias(k) for k, f in (("xmin", F.min), ("ymin", F.min), ("xmax", F.max), ("ymax", F.max))), F.min("code").alias("minimum"), F.max("code").alias("maximum"), F.min("id").alias("first_row"))


_GROUPS_SQL = f"{XZ_SQL}, g AS (SELECT id // 100 AS row_group, count(*) AS n, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax, min(code) AS minimum, max(code) AS maximum, min(id) AS first_row FROM xz GROUP BY 1)"


@query(f"""WITH {_GROUPS_SQL}, d AS (SELECT *, ln(n / (6371008.8*6371008.8 * radians(least(abs(xmax-xmin), 360)) * abs(sin(radians(least(ymax, 90))) - sin(radians(greatest(ymin, -90)))))) AS ld FROM g),
m AS (SELECT median(ld) AS mid, count(*) AS total FROM d), kk AS (SELECT d.*, ld >= mid - ln(10) AS dense, total FROM d, m), e AS (SELECT count(*) FILTER (dense) >= greatest(ceil(max(total) * 0.25), 1) AS enough FROM kk)
SELECT min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax, sum(n)::BIGINT AS n FROM kk, e WHERE dense OR NOT enough""")
def row_group_focus_extent(spark, sf_dir):
    return analytics.focus_extent(row_groups(spark, sf_dir))


@query(f"WITH {_GROUPS_SQL} SELECT row_group, maximum - minimum AS spread, (first_row + n // 2)::BIGINT AS middle_row FROM g ORDER BY maximum - minimum, row_group LIMIT 1")
def densest_group(spark, sf_dir):
    return analytics.densest(row_groups(spark, sf_dir))


@query("SELECT o_orderkey, (((o_orderkey % 65536) << 32) | (o_custkey % 4294967296))::BIGINT AS object_id FROM orders")
def object_id_packing(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "orders").select("o_orderkey", C.object_id(c("o_orderkey") % 65536, c("o_custkey") % 4294967296).alias("object_id"))


from . import checks, datasets  # noqa: E402, F401  (they register the queries over written datasets)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in FOUND.items() if sql}
