"""Registered queries against DuckDB, and whole rewrites: written, checked, queried, and broken on purpose."""

import json
import os
import sqlite3
import struct

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from curvelake import cli
from curvelake.functions import columns as C
from curvelake.functions import wkb as W
from curvelake.functions.curves import Extent
from curvelake.operators import analytics, inspect, query, viewport
from curvelake.plans import convert as V
from curvelake.plans import registry, validate
from curvelake.sinks import parquet as sink
from curvelake.sources import arrow, footers, formats, geopackage, pages

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rel = duck.sql(registry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    want = duck.sql(f"select {', '.join(cols)} from ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, want))


def shapes(n=300, seed=1, family="polygon"):
    rnd = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x, y, r = rnd.uniform(-170, 170), rnd.uniform(-80, 80), rnd.uniform(0.01, 2)
        a = np.linspace(0, 2 * np.pi, 40)
        ring = np.column_stack([x + r * np.cos(a), y + r * np.sin(a)])
        ring[-1] = ring[0]
        kind = {"polygon": 3, "polyline": 2, "multipoint": 4, "point": 1}[family]
        rows.append(W.encode(W.Geometry(kind, False, False, ring[:1] if kind == 1 else ring, [1 if kind == 1 else 40], [1] if kind == 3 else [])))
    rows[n // 2] = None
    return pa.table({"id": pa.array(range(n), pa.int32()), "geometry": pa.array(rows, pa.binary()), "geokey": ["stale"] * n, "u": pa.array(range(n), pa.int64())})


TYPES = {"polygon": "Polygon", "polyline": "LineString", "multipoint": "MultiPoint", "point": "Point"}


def rewrite(spark, table, family, path, **more):
    return V.convert(spark, V.InputOptions(table, declaration=arrow.GeometryDeclaration("geometry", (TYPES[family],), 4326)), V.OutputOptions(str(path), **more))


@pytest.mark.parametrize("family", TYPES)
@pytest.mark.parametrize("parts", [None, 4])
def test_rewrite(spark, tmp_path, family, parts):
    out = tmp_path / ("out" if parts else "out.parquet")
    got = rewrite(spark, shapes(family=family), family, out, parts=parts, covering=True, overwrite=True, row_group_size=64, write_extensions=True)
    assert got.rows_written == got.rows_expected == 300 and len(got.files) == (parts or 1)
    for f in got.files:
        keys = pq.read_table(f, columns=["geokey"], partitioning=None)["geokey"].to_pylist()
        assert keys == sorted(keys)
        m = pq.read_metadata(f)
        assert max(m.row_group(g).num_rows for g in range(m.num_row_groups)) <= 64 and m.row_group(0).column(0).has_offset_index
        assert pq.read_schema(f).names == ["id", "geometry", "u", "bbox", "geokey", *({"point": ["sop_geometry"], "multipoint": []}.get(family, ["geolod"]))]
    for mode in ("sample", "full"):
        report = validate.validate(spark, str(out), mode)
        assert report.findings == [], report.text()
    table = spark.read.parquet(str(out))
    assert table.where("geometry is null and bbox is null and geokey = 0").count() == 1
    rows, limited = query.viewport(spark, str(out), (-60.0, -40.0, 70.0, 45.0), 14)
    box = table.where("bbox.xmin <= 70 and bbox.xmax >= -60 and bbox.ymin <= 45 and bbox.ymax >= -40").count()
    assert abs(rows.count() - box) <= 1 and not limited
    assert query.viewport(spark, str(out), (-60.0, -40.0, 70.0, 45.0), 14, 5)[1]
    if parts:
        with pytest.raises(FileExistsError):
            rewrite(spark, shapes(), "polygon", out, parts=2)


def test_extensions_and_warnings(spark, tmp_path):
    """Extensions name their geometry column and each level's transform; geometries that aren't as their metadata say are told of."""
    out = str(tmp_path / "a.parquet")
    got = rewrite(spark, shapes(), "polygon", out, write_extensions=True)
    assert got.warnings == []
    geo = json.loads(footers.key_values(pq.read_metadata(out))["geo"])
    e = geo["columns"]["geometry"]["bbox"]
    assert geo["ordering"] == {"type": "xz", "geometry_column": "geometry", "extent": e, "max_level": 20}
    lod = geo["lod"]
    assert (lod["geometry_column"], lod["encoding"], lod["orientation"]) == ("geometry", "pbf", "clockwise") and len(lod["levels"]) == 9
    x = lod["levels"][0]
    assert set(x) == {"column", "resolution", "transform"} and x["transform"] == {"scale": [x["resolution"], x["resolution"], 0.0001, 0.0001], "translate": [0.0] * 4}
    declared = V.InputOptions(shapes(), declaration=arrow.GeometryDeclaration("geometry", ("Polygon", "Polygon Z"), 4326))
    got = V.convert(spark, declared, V.OutputOptions(str(tmp_path / "b.parquet")))
    assert len(got.warnings) == 1 and "hasZ=True" in got.warnings[0]


def test_viewport_at_every_depth(spark, tmp_path):
    table = shapes(family="point")
    for depth in (1, 20, 31, 32):
        out = str(tmp_path / f"{depth}.parquet")
        rewrite(spark, table, "point", out, cluster_depth=depth)
        got = query.viewport(spark, out, (-60.0, -40.0, 70.0, 45.0), 14)[0].count()
        want = spark.read.parquet(out).where("sop_geometry.x between -60 and 70 and sop_geometry.y between -40 and 45").count()
        assert got == want > 0, depth


def test_again_from_files(spark, tmp_path):
    a, b, c = (str(tmp_path / x) for x in ("a.parquet", "b.parquet", "c.parquet"))
    rewrite(spark, shapes(), "polygon", a, covering=True)
    meta = footers.read([a])
    assert meta.types == ["Polygon"] and meta.covering == "bbox" and meta.wkid == 4326 and meta.rows == 300
    for encoding, path in (("wkb", b), ("native", c)):
        V.convert(spark, V.InputOptions(a), V.OutputOptions(path, encoding=encoding))
        assert validate.validate(spark, path).findings == []
    split = pq.read_metadata(c).row_group(0)
    assert any("BYTE_STREAM_SPLIT" in split.column(i).encodings for i in range(split.num_columns))
    V.convert(spark, V.InputOptions(a, start=10, num=50), V.OutputOptions(b, overwrite=True, out_sr=3857, normalization_extent=None))
    t = pq.read_table(b)
    assert len(t) == 50 and footers.read([b]).wkid == 3857 and validate.validate(spark, b).error_count == 0
    V.convert(spark, V.InputOptions(a), V.OutputOptions(c, optimized=False, overwrite=True, covering=True))
    assert pq.read_table(c)["id"].to_pylist() == pq.read_table(a)["id"].to_pylist() and "geodisplay" not in footers.key_values(pq.read_metadata(c))
    details = footers.summary(footers.layout_table(spark, [a])).first()
    assert details["rows"] == 300 and details["codec"] == "SNAPPY" and details["columns"] == pq.read_metadata(a).num_columns


@pytest.mark.parametrize(
    "change, message",
    [({"out_sr": 2154}, "spatial reference"), ({"row_group_size": 0}, "positive"), ({"cluster_depth": 33}, "depth"), ({"normalization_extent": Extent(0, 0, 0, 1)}, "extent"), ({"optimized": False, "write_extensions": True}, "extensions"),
     ({"compression": "zip"}, "compression"), ({"encoding": "svg"}, "encoding"), ({"parts": 2}, "one part")],
)
def test_requests_are_checked_first(spark, tmp_path, change, message):
    with pytest.raises(ValueError, match=message):
        rewrite(spark, shapes(20), "polygon", tmp_path / "x.parquet", **change)
    assert not list(tmp_path.iterdir())


def test_reference_systems(spark, tmp_path):
    src = str(tmp_path / "plain.parquet")
    pq.write_table(shapes(20), src)
    with pytest.raises(ValueError, match="geometry-column"):
        V.convert(spark, V.InputOptions(src, in_sr=4326), V.OutputOptions(str(tmp_path / "a.parquet")))
    with pytest.raises(ValueError, match="in-sr"):
        V.convert(spark, V.InputOptions(src, geometry_column="geometry"), V.OutputOptions(str(tmp_path / "a.parquet")))
    assert V.convert(spark, V.InputOptions(src, geometry_column="geometry", in_sr=4326), V.OutputOptions(str(tmp_path / "a.parquet"))).rows_written == 20
    with pytest.raises(ValueError, match="has a spatial reference"):
        V.convert(spark, V.InputOptions(str(tmp_path / "a.parquet"), in_sr=4326), V.OutputOptions(str(tmp_path / "b.parquet")))
    pole = pa.table({"geometry": pa.array([struct.pack("<BIdd", 1, 1, 0.0, 90.0)], pa.binary())})
    with pytest.raises(Exception, match="Web Mercator"):
        rewrite(spark, pole, "point", tmp_path / "c.parquet", out_sr=3857)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.parquet", "plain.parquet"]
    there = spark.createDataFrame([(W.encode(W.Geometry(1, False, False, np.array([[-117.2, 34.05]]), [1])),)], "g binary")
    p = there.select(C.point_parts(C.to_crs(C.to_crs("g", 4326, 3857), 3857, 4326)).alias("p")).first()["p"]
    assert abs(p["x"] + 117.2) < 1e-9 and abs(p["y"] - 34.05) < 1e-9


def changed(path, out, columns=None, footer=None):
    """A copy with changed columns or footer entries (None removes one)."""
    t = pq.read_table(path, partitioning=None)
    for name, f in (columns or {}).items():
        i = t.schema.names.index(name)
        t = t.set_column(i, name, f(t[name]))
    kv = footers.key_values(pq.read_metadata(path))
    for key, f in (footer or {}).items():
        v = f(json.loads(kv[key])) if f else None
        kv[key] = json.dumps(v) if v is not None else None
    with pq.ParquetWriter(out, t.schema.remove_metadata(), write_page_index=True, store_schema=False) as w:
        w.write_table(t)
        w.add_key_value_metadata({k: v for k, v in kv.items() if v is not None})


def put(key, value):
    return lambda d: d | {key: value}


BROKEN = [
    ({}, {"geodisplay": None}, "SOP-META-001"), ({}, {"geodisplay": put("type", "q")}, "SOP-META-003"), ({}, {"geodisplay": put("version", "9")}, "SOP-META-004"), ({}, {"geodisplay": put("code", "")}, "SOP-META-005"),
    ({}, {"geodisplay": lambda d: {k: v for k, v in d.items() if k != "writer"}}, "SOP-META-006"), ({}, {"geodisplay": put("wkid", 3857)}, "SOP-CRS-001"), ({}, {"geodisplay": put("fullExtent", {"xmin": 1, "ymin": 0, "xmax": 0, "ymax": 1})}, "SOP-EXTENT-001"),
    ({}, {"geodisplay": put("code", "nothing")}, "SOP-XZ-001"), ({}, {"geodisplay": put("maxLevel", 40)}, "SOP-XZ-002"), ({}, {"geodisplay": put("hasZ", True)}, "SOP-GEOMETRY-003"), ({}, {"geodisplay": put("geometryType", "polyline")}, "SOP-GEOMETRY-002"),
    ({"geokey": lambda c: pa.chunked_array([c.to_pylist()[::-1]])}, {}, "SOP-XZ-003"), ({"geokey": lambda c: pa.chunked_array([[v + 1 for v in c.to_pylist()]])}, {}, "SOP-XZ-004"),
    ({"geometry": lambda c: pa.chunked_array([[v and v[:-1] for v in c.to_pylist()]])}, {}, "SOP-GEOMETRY-001"),
    ({"geometry": lambda c: pa.chunked_array([[v and W.encode(W.Geometry(3, False, False, W.decode(v).xy[::-1], [40], [1])) for v in c.to_pylist()]])}, {}, "SOP-GEOMETRY-006"),
    ({"geometry": lambda c: pa.chunked_array([[v and W.encode(W.Geometry(3, False, False, W.decode(v).xy[:-1], [39], [1])) for v in c.to_pylist()]])}, {}, "SOP-GEOMETRY-005"),
]


@pytest.mark.parametrize("columns, footer, rule", BROKEN, ids=[b[2] + str(i) for i, b in enumerate(BROKEN)])
def test_validator_finds(spark, tmp_path, columns, footer, rule):
    good, bad = str(tmp_path / "good.parquet"), str(tmp_path / "bad.parquet")
    rewrite(spark, shapes(60), "polygon", good)
    columns = {k: (lambda c, f=f: pa.array(f(c).to_pylist(), c.type)) for k, f in columns.items()}
    changed(good, bad, columns, footer)
    report = validate.validate(spark, bad)
    assert rule in report.rules(), report.text()
    assert {f.severity for f in report.findings if f.rule == rule} == {"warning" if rule in validate.WARNINGS else "error"}


def test_validator_on_payloads_and_ranges(spark, tmp_path):
    good, out = str(tmp_path / "good.parquet"), tmp_path / "many"
    rewrite(spark, shapes(60), "polygon", good)
    out.mkdir()
    swap = lambda c: pa.array([{k: (v and b"\x12\x01\x05") for k, v in r.items()} for r in c.to_pylist()], c.type)
    changed(good, str(out / "a.parquet"), {"geolod": swap})
    assert validate.validate(spark, str(out)).rules() == ["SOP-PBF-001"]
    empty = lambda c: pa.array([{k: (v and b"") for k, v in r.items()} for r in c.to_pylist()], c.type)
    changed(good, str(out / "a.parquet"), {"geolod": empty})
    assert validate.validate(spark, str(out)).rules() == ["SOP-PBF-002", "SOP-PBF-004"]
    changed(good, str(out / "a.parquet"))
    changed(good, str(out / "b.parquet"))
    assert validate.validate(spark, str(out)).rules() == ["SOP-RANGE-001"]
    (out / "xz_order=99999999999999").mkdir()
    os.rename(out / "b.parquet", out / "xz_order=99999999999999" / "b.parquet")
    assert "SOP-PARTITION-001" in validate.validate(spark, str(out)).rules()
    (out / "c.parquet").write_bytes(b"PAR1")
    report = validate.validate(spark, str(out))
    assert "SOP-PARQUET-001" in report.rules() and report.table(spark).count() == len(report.findings)
    with pytest.raises(ValueError, match="SOP-"):
        report.ensure_valid()


@pytest.fixture
def gpkg(tmp_path):
    path = str(tmp_path / "x.gpkg")
    db = sqlite3.connect(path)
    db.executescript("""
        CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT); CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INT, z INT, m INT);
        CREATE TABLE gpkg_spatial_ref_sys (srs_id INT, organization TEXT, organization_coordsys_id INT); INSERT INTO gpkg_spatial_ref_sys VALUES (4326, 'EPSG', 4326);
        CREATE TABLE places (fid INTEGER PRIMARY KEY, geometry BLOB, name TEXT, size INTEGER, ok BOOLEAN); CREATE TABLE other (fid INTEGER PRIMARY KEY, geometry BLOB);
        INSERT INTO gpkg_contents VALUES ('places', 'features'); INSERT INTO gpkg_geometry_columns VALUES ('places', 'geometry', 'GEOMETRY', 4326, 0, 0);
    """)
    head = b"GP\0\x03" + struct.pack("<I", 4326) + struct.pack("<4d", 0, 0, 0, 0)
    for i in range(40):
        blob = b"GP\0\x11" + struct.pack("<I", 4326) if i == 7 else head + struct.pack("<BIdd", 1, 1, i, -i)
        db.execute("INSERT INTO places (geometry, name, size, ok) VALUES (?, ?, ?, ?)", (None if i == 9 else blob, f"n{i}", i, i % 2))
    db.commit()
    db.close()
    return path


def test_geopackage(spark, gpkg, tmp_path):
    df = geopackage.read(spark, gpkg, parts=3)
    assert df.columns == ["geometry", "name", "size", "ok"] and df.count() == 40 and df.where("geometry is null").count() == 2
    assert len(geopackage.splits(gpkg, "places", 3)) == 3 and sorted(r["size"] for r in df.collect()) == list(range(40))
    out = str(tmp_path / "o.parquet")
    assert V.convert(spark, V.InputOptions(gpkg), V.OutputOptions(out)).rows_written == 40
    assert validate.validate(spark, out).findings == []
    with pytest.raises(ValueError, match=r"no layer.*\n- places \(geometry: GEOMETRY, features: 40\)"):
        geopackage.choose(gpkg, "nothing")


def test_formats(tmp_path):
    assert formats.resolve_format(str(tmp_path)) == "parquet" and formats.resolve_format("http://h/a/B.PARQUET?x=1.gpkg") == "parquet" and formats.parse_format("GeoPackage") == "gpkg"
    with pytest.raises(ValueError, match="--input-format"):
        formats.resolve_format("a.shp")
    assert formats.partition_of("/d/z_order=5/x.parquet", "/d") == ("z", 5)
    with pytest.raises(ValueError, match="more than one"):
        formats.partition_of("/d/z_order=5/xz_order=6/x.parquet", "/d")
    assert footers.parse_bbox([1, 2, 3, 4, 5, 6]) == [1, 2, 4, 5] and footers.parse_bbox([1, None, 2, 3]) is None and footers.parse_type("Point ZM") == ("Point", True, True)
    with pytest.raises(ValueError, match="kind"):
        (tmp_path / "f").mkdir() or sink.prepare(str(tmp_path), None, True, folder=False)


def test_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (float("nan"), 1.0), (1e9, -1e9)], "x double, y double")
    full = Extent(0, 0, 4, 4)
    assert [r[0] for r in df.select(C.z_code("x", "y", full, 2)).collect()] == [9, 0, 2, 5]
    assert [int(r[0]) for r in df.select(C.z_code("x", "y", full, 32)).collect()][:2] == [int("1001" + "0" * 60, 2), 0]
    assert analytics.longitude_union([(170, 175), (-178, -170)]) == (170, 190) and analytics.longitude_union([(0, 10), (5, 20)]) == (0, 20)
    groups = spark.createDataFrame([(0, 300_000, 0.0, 0.0, 1.0, 1.0), (1, 10, 50.0, 50.0, 90.0, 80.0)], "row_group int, n long, xmin double, ymin double, xmax double, ymax double")
    extent, n = analytics.default_extent(groups)
    assert n == 300_010 or n == 300_000
    assert extent.width <= 90


def test_command_line(spark, tmp_path, capsys):
    src, out = str(tmp_path / "in.parquet"), str(tmp_path / "out.parquet")
    rewrite(spark, shapes(50), "polygon", src)
    assert cli.main(["write", src, "-o", out, "--covering", "--no-progress"]) == 0
    assert cli.main(["validate", out]) == 0 and "0 errors" in capsys.readouterr().out
    assert cli.main(["query", out, "--extent=-180,-90,180,90", "--zoom", "12"]) == 0
    assert all(json.loads(x)["geometry"]["type"] == "Polygon" for x in capsys.readouterr().out.splitlines())
    assert cli.main(["write", src, "-o", out]) == 1 and "overwrite" in capsys.readouterr().err
    assert cli.main(["write", src, "-o", out, "-w", "--num", "0"]) == 1


def test_entry_without_the_optional_part():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "viewport_xz_query" in e.queries()
    assert F is not None


def test_lod_features_are_all_counted(spark, monkeypatch):
    """The registered query counts, whatever a viewer's limit is."""
    limited = viewport.features
    monkeypatch.setattr(limited, "__defaults__", tuple(3 if v == viewport.FEATURE_LIMIT else v for v in limited.__defaults__))
    at = SF.replace("sf0.001", "sf0.01")  # the small table has none in the view
    want = registry.queries()["viewport_xz_query"](spark, at).count()
    assert want > 4 and registry.queries()["viewport_lod_features"](spark, at).first()["n"] == want


def test_viewport_says_that_the_feature_limit_was_met(spark, tmp_path, monkeypatch):
    out, world = str(tmp_path / "a.parquet"), (-180.0, -90.0, 180.0, 90.0)
    rewrite(spark, shapes(60), "polygon", out)
    n = query.viewport(spark, out, world, 14)[0].count()
    for limit, flag in ((5, True), (n - 1, True), (n, False), (n + 1, False)):
        monkeypatch.setattr(viewport, "FEATURE_LIMIT", limit)
        rows, limited = query.viewport(spark, out, world, 14, limit)
        assert (rows.count(), limited) == (min(n, limit), flag)


def test_geometry_type_and_native_bounds(spark, tmp_path):
    out = str(tmp_path / "a.parquet")
    rewrite(spark, shapes(), "polygon", out, row_group_size=100, out_sr=4326)
    meta = pq.read_metadata(out)
    assert str(meta.schema.column(1).logical_type) == "Geometry(crs=srid:4326)" and pq.read_schema(out).field("geometry").type == pa.binary()
    got = pages.native_bounds(spark, [out], "geometry").orderBy("row_group").collect()
    assert [r["n"] for r in got] == [100, 100, 100]
    first = spark.read.parquet(out).select("_metadata.row_index", C.bounds("geometry").alias("b")).where("row_index < 100").agg(F.min("b.xmin"), F.max("b.ymax")).first()
    assert (got[0]["xmin"], got[0]["ymax"]) == tuple(first)
    # A file of another writer doesn't say Spark's schema: unsigned keys become decimals, as without the type.
    t = pq.read_table(out, partitioning=None)
    t = t.set_column(t.schema.names.index("geokey"), "geokey", t["geokey"].cast(pa.uint64()))
    other = str(tmp_path / "b.parquet")
    kind = sink.FileOptions(geometry=("geometry", 4326))
    with sink.open_writer(other, t.schema, kind) as w:
        w.write_table(sink.annotated(t, kind))
        w.add_key_value_metadata({k: v for k, v in footers.key_values(meta).items() if not k.startswith("org.apache")})
    assert dict(query.open_dataset(spark, other).df.dtypes)["geokey"] == "decimal(20,0)"
    world = (-180.0, -90.0, 180.0, 90.0)
    assert query.viewport(spark, other, world, 14)[0].count() == query.viewport(spark, out, world, 14)[0].count() > 0
    assert validate.validate(spark, other).findings == []
    assert V.convert(spark, V.InputOptions(other), V.OutputOptions(str(tmp_path / "c.parquet"))).rows_written == 300
    assert pages.native_bounds(spark, [str(tmp_path / "c.parquet")], "u").count() == 0


def test_repeated_keys(spark, tmp_path):
    out, twice = str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")
    rewrite(spark, shapes(60), "polygon", out)
    assert pages.repeated_keys(out) == set() and pages.footer(out)[3] == 60
    data = open(out, "rb").read()
    # Another key of the same length as geodisplay, written beside it, takes its name.
    t = pq.read_table(out, partitioning=None)
    with sink.open_writer(twice, t.schema, sink.FileOptions()) as w:
        w.write_table(t)
        w.add_key_value_metadata(footers.key_values(pq.read_metadata(out)) | {"geodisplaX": "{}"})
    data = open(twice, "rb").read()
    open(twice, "wb").write(data.replace(b"geodisplaX", b"geodisplay"))
    assert pages.repeated_keys(twice) == {"geodisplay"}
    assert "SOP-META-002" in validate.validate(spark, twice).rules()
    open(twice, "wb").write(b"PAR1")
    with pytest.raises(ValueError, match="no Parquet file"):
        pages.footer(twice)


def test_native_levels_and_indeterminate_points(spark, tmp_path):
    out, bad = str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")
    rewrite(spark, shapes(), "polygon", out, encoding="native")
    assert validate.validate(spark, out, "full").findings == []
    shown = query.viewport(spark, out, (-180.0, -90.0, 180.0, 90.0), 14)[0].collect()
    assert len(shown) > 250 and all(W.decode(r["wkb"]).kind == 3 for r in shown if "wkb" in r.asDict())
    changed(out, bad, {"geometry": lambda c: pa.chunked_array([[v if i != 5 else None for i, v in enumerate(c.to_pylist())]], pa.binary())})
    assert "SOP-XZ-001" in validate.validate(spark, bad, "full").rules()
    points, none = str(tmp_path / "p.parquet"), W.encode(W.Geometry(1, False, False, np.array([[np.nan, np.nan]]), [1]))
    rewrite(spark, shapes(family="point"), "point", points)
    assert validate.validate(spark, points, "full").findings == []
    changed(points, bad, {"geometry": lambda c: pa.chunked_array([[none if i == 3 else v for i, v in enumerate(c.to_pylist())]], pa.binary())})
    assert "SOP-Z-003" in validate.validate(spark, bad, "full").rules()


def test_footers_by_tasks(spark, tmp_path, monkeypatch):
    """Many files' footers are read by the tasks, with the result that reading one after the other has."""
    out = str(tmp_path / "out")
    rewrite(spark, shapes(60), "polygon", out, parts=6)
    paths = sorted(str(p) for p in (tmp_path / "out").rglob("*.parquet"))
    whole = footers.read(paths)
    monkeypatch.setattr(footers, "RUN", 2)
    assert len(paths) > 2 and footers.read(paths, spark) == whole and whole.rows == 60
    pq.write_table(pa.table({"a": [1]}), str(tmp_path / "out" / "zz.parquet"))
    with pytest.raises(ValueError, match="some files have"):
        footers.read([*paths, str(tmp_path / "out" / "zz.parquet")], spark)
    table = footers.layout_table(spark, paths).collect()
    assert sorted(map(tuple, table)) == sorted(tuple(r.values()) for r in footers.layout(paths))


def test_sampled_rows(spark, tmp_path):
    """Sampling sees codes that are null wherever they are, the first geometries beyond any nulls, and all geometries where there is no extent."""
    good, bad = str(tmp_path / "good.parquet"), str(tmp_path / "bad.parquet")
    rewrite(spark, shapes(60), "polygon", good)
    codes = lambda c: pa.array([None if i == 20 else v for i, v in enumerate(c.to_pylist())], c.type)
    changed(good, bad, {"geokey": codes})
    assert "SOP-XZ-004" in validate.validate(spark, bad).rules()
    cut = lambda keep: lambda c: pa.array([v and (v if i < keep else v[:-1]) for i, v in enumerate(c.to_pylist())], c.type)
    changed(good, bad, {"geometry": cut(30)}, {"geodisplay": lambda d: {k: v for k, v in d.items() if k != "fullExtent"}})
    assert validate.validate(spark, bad).rules() == ["SOP-EXTENT-001", "SOP-GEOMETRY-001"]
    t = pq.read_table(good, partitioning=None)
    late = [None] * 600 + [v and v[:-1] for v in t["geometry"].to_pylist()]
    rows = t.slice(0, 1).take(pa.array([0] * 600))
    long = pa.concat_tables([rows, t])
    long = long.set_column(long.schema.get_field_index("geometry"), "geometry", pa.array(late, pa.binary()))
    with pq.ParquetWriter(bad, long.schema.remove_metadata(), write_page_index=True, store_schema=False) as w:
        w.write_table(long)
        w.add_key_value_metadata(footers.key_values(pq.read_metadata(good)))
    found = [f for f in validate.validate(spark, bad).findings if f.rule == "SOP-GEOMETRY-001"]
    assert len(found) == 4 and min(f.row for f in found) >= 600


def test_listed_findings_are_few(spark, tmp_path):
    good, bad = str(tmp_path / "good.parquet"), str(tmp_path / "bad.parquet")
    rewrite(spark, shapes(260), "polygon", good)
    changed(good, bad, {"geometry": lambda c: pa.array([v and v[:-1] for v in c.to_pylist()], c.type)})
    found = [f for f in validate.validate(spark, bad, "full").findings if f.rule == "SOP-GEOMETRY-001"]
    assert len(found) == 101 and sum("more than 100" in f.message for f in found) == 1


def test_page_operators(spark, tmp_path):
    out = str(tmp_path / "a.parquet")
    rewrite(spark, shapes(), "polygon", out, encoding="native", row_group_size=100, page_size=512)
    p = pages.pages(spark, [out])
    assert p.where("page is null").count() == 0 and p.where("repeated").select("column").distinct().count() == 18
    key = p.where("column = 'geokey'").orderBy("first_row").collect()
    assert sum(r["rows"] for r in key) == 300 and int.from_bytes(key[0]["minimum"], "little") == 0 and key[0]["nulls"] == 0
    for column in ("geokey", "geolod.level_0.list.element.list.element.x"):
        assert inspect.topology_faults(p, column).count() == 0 and inspect.topology(p, column).count() >= 3
    shifted = p.where("column = 'geokey'").withColumn("first_row", F.when(F.col("row_group") == 1, F.col("first_row") + 1).otherwise(F.col("first_row")))
    assert [r["row_group"] for r in inspect.topology_faults(shifted, "geokey").collect()] == [1]
    none = p.where("column = 'geokey'").withColumn("page", F.lit(None).cast("int")).withColumn("first_row", F.lit(None).cast("long"))
    assert {r["fault"] for r in inspect.topology_faults(none, "geokey").collect()} == {"no page offsets"}
    table = spark.createDataFrame([("f", 0, 0, 10), ("f", 1, 10, 5), ("g", 0, 0, 3)], "file string, row_group int, first_row long, rows long")
    rows = spark.createDataFrame([("f", 0, "a"), ("f", 9, "b"), ("f", 10, "c"), ("f", 15, "d"), ("g", 2, "e"), ("h", 0, "f"), ("f", 9, "b")], "file string, row long, t string")
    assert sorted((r["t"], r["row_group"]) for r in inspect.row_groups_of(rows, table).collect()) == [("a", 0), ("b", 0), ("b", 0), ("c", 1), ("d", None), ("e", 0), ("f", None)]
    loaded = spark.createDataFrame([("f", 0, 5), ("f", 5, 8), ("f", 20, 30), ("f", 22, 25), ("f", 40, 40)], "file string, start long, end long")
    assert sorted(map(tuple, inspect.merged(loaded).collect())) == [("f", 0, 8), ("f", 20, 30)]
    asked = spark.createDataFrame([("f", 4, 24), ("f", 9, 9), ("f", 8, 20), ("g", 0, 4), ("f", -5, 100)], "file string, start long, end long")
    assert {(r["file"], r["start"]): (r["covered"], r["fraction"]) for r in inspect.coverage(asked, loaded).collect()} == {("f", 4): (8, 0.4), ("f", 9): (0, 0.0), ("f", 8): (0, 0.0), ("g", 0): (0, 0.0), ("f", -5): (18, 18 / 105)}
    assert inspect.overlapping(loaded, 8, 21).count() == 1 and inspect.coverage(asked, loaded.limit(0)).agg(F.sum("covered")).first()[0] == 0
    display = [json.loads(footers.key_values(pq.read_metadata(out))["geodisplay"])]
    assert inspect.common_levels(display) == [0, 2, 4, 6, 8, 10, 12, 14, 16] and inspect.common_levels([]) == []
    assert inspect.common_levels([*display, display[0] | {"levels": display[0]["levels"][1:3]}]) == [2, 4]
