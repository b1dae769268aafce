"""Column functions over geometry: plain expressions where those can say it, Arrow UDFs over well-known binary where not."""

from __future__ import annotations

import json
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from . import batch as B
from . import lod as L
from . import wkb as W
from .curves import MERCATOR_EDGE, Extent, xz_codes, z_codes

BBOX = T.StructType([T.StructField(k, T.DoubleType()) for k in ("xmin", "ymin", "xmax", "ymax")])
RADIUS = 6378137.0


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _mapped(values: pa.Array, f):
    """f over a binary array's values; null stays null."""
    return [f(v.as_py()) if v.is_valid else None for v in values]


# Keys


def _spread(v: Column) -> Column:
    """The bits of v moved to the even places: its binary digits read as base 4. One small expression, so that filters on a derived key stay small too."""
    return F.conv(F.bin(v), 4, 10).cast("long")


def z_cell(v: Column, lo: float, hi: float, depth: int) -> Column:
    if depth == 0 or abs(hi - lo) < 2.220446049250313e-16:
        return F.lit(0).cast("long")
    cell = (v - lo) / F.lit(hi - lo) * 2.0**depth
    inside = F.greatest(F.least(cell, F.lit(2.0**depth - 1)), F.lit(0.0))
    return F.when(F.isnan(v), F.lit(0).cast("long")).otherwise(inside.cast("long"))


def z_code(x: str | Column, y: str | Column, extent: Extent, depth: int = 20) -> Column:
    """Morton key of a point; 0 where a coordinate is null. A bigint up to depth 31; at depth 32, whose keys need 64 bits, a decimal(20,0)."""
    x, y = _col(x), _col(y)
    if depth <= 31:
        code = _spread(z_cell(x, extent.xmin, extent.xmax, depth)).bitwiseOR(F.shiftleft(_spread(z_cell(y, extent.ymin, extent.ymax, depth)), 1))
        return F.coalesce(F.when(x.isNotNull() & y.isNotNull(), code), F.lit(0).cast("long"))

    @arrow_udf(T.DecimalType(20, 0))
    def wide(a: pa.Array, b: pa.Array) -> pa.Array:
        codes = z_codes(a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False), extent, depth)
        ok = pa.compute.and_(a.is_valid(), b.is_valid()).to_numpy(zero_copy_only=False)
        return pa.array([Decimal(int(c)) if k else Decimal(0) for c, k in zip(codes, ok)], pa.decimal128(20, 0))

    return wide(x, y)


def xz_code(xmin: Column, ymin: Column, xmax: Column, ymax: Column, extent: Extent, depth: int = 20) -> Column:
    """XZ key of a box; 0 where a bound is null."""

    @arrow_udf(T.LongType())
    def code(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        v = [x.to_numpy(zero_copy_only=False) for x in (a, b, c, d)]
        some = ~np.isnan(np.column_stack(v)).any(axis=1) if len(v[0]) else np.zeros(0, bool)
        out = np.zeros(len(v[0]), np.int64)
        out[some] = xz_codes(*(x[some] for x in v), extent, depth)
        return pa.array(out)

    return code(*(_col(c).cast("double") for c in (xmin, ymin, xmax, ymax)))


def xz_code_of(geometry: str | Column, extent: Extent, depth: int = 20) -> Column:
    b = bounds(geometry)
    return xz_code(b["xmin"], b["ymin"], b["xmax"], b["ymax"], extent, depth)


# Well-known binary


@arrow_udf(BBOX)
def _bounds(g: pa.Array) -> pa.Array:
    f = B.decode(g.to_pylist())
    b, null = B.bounds(f), f.kinds == 0
    bare = ~null
    bare[f.owner[f.sizes > 0]] = False
    if bare.any():
        raise ValueError("geometry missing bounding rectangle")
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(b[:, i])) for i in range(4)], ["xmin", "ymin", "xmax", "ymax"], mask=pa.array(null))


def bounds(geometry: str | Column) -> Column:
    """Bounding box; null for a null geometry."""
    return _bounds(_col(geometry))


def covering(geometry: str | Column, box: Column) -> Column:
    """The bbox column: null where the geometry is."""
    return F.when(_col(geometry).isNotNull(), F.struct(*(box[k].alias(k) for k in ("xmin", "ymin", "xmax", "ymax"))))


def point_parts(geometry: str | Column, dims: tuple[bool, bool] | None = None) -> Column:
    """struct<x,y,z,m> of a point; a null geometry gives a struct of nulls. dims: the Z and M that the point must have."""

    @arrow_udf("struct<x:double,y:double,z:double,m:double>")
    def parts(g: pa.Array) -> pa.Array:
        def one(data: bytes):
            if dims is not None and W.header(data)[1:] != dims:
                raise ValueError("point WKB dimensions do not match GeoParquet metadata")
            return W.point(data)

        some = B.simple(g.drop_null().to_pylist())
        if some and some.kind == 1 and (dims is None or dims == (some.has_z, some.has_m)):
            there = np.flatnonzero(g.is_valid().to_numpy(zero_copy_only=False))
            out, at = np.full((len(g), 4), np.nan), [0, 1, *([2] if some.has_z else []), *([3] if some.has_m else [])]
            out[np.ix_(there, at)] = some.coords
            null = np.ones((len(g), 4), bool)
            null[np.ix_(there, at)] = False
            return pa.StructArray.from_arrays([pa.array(out[:, i].copy(), mask=null[:, i].copy()) for i in range(4)], list("xyzm"))
        rows = [r or (None,) * 4 for r in _mapped(g, one)]
        return pa.array([dict(zip("xyzm", r)) for r in rows], pa.struct([(k, pa.float64()) for k in "xyzm"]))

    return parts(_col(geometry))


def point_struct(x: Column, y: Column, z: Column | None = None, m: Column | None = None) -> Column:
    """The packed point column: null where x is."""
    fields = [c.alias(n) for n, c in (("x", x), ("y", y), ("z", z), ("m", m)) if c is not None]
    return F.when(x.isNotNull(), F.struct(*fields))


@arrow_udf(T.StructType([T.StructField("type", T.StringType()), T.StructField("has_z", T.BooleanType()), T.StructField("has_m", T.BooleanType())]))
def _header(g: pa.Array) -> pa.Array:
    def one(data: bytes):
        k, z, m = W.header(data)
        return {"type": W.NAMES[k], "has_z": z, "has_m": m}

    some = B.simple(g.drop_null().to_pylist())
    if some:
        null, n = g.is_null(), len(g)
        return pa.StructArray.from_arrays([pa.array(np.full(n, v)) for v in (W.NAMES[some.kind], some.has_z, some.has_m)], ["type", "has_z", "has_m"], mask=null)
    return pa.array(_mapped(g, one), pa.struct([("type", pa.string()), ("has_z", pa.bool_()), ("has_m", pa.bool_())]))


def header(geometry: str | Column) -> Column:
    return _header(_col(geometry))


def type_code(geometry: str | Column) -> Column:
    """The type code of little-endian WKB (1..7) as a plain expression; null for other byte orders."""
    g = _col(geometry)
    code = F.conv(F.concat(*(F.hex(F.substring(g, i, 1)) for i in (5, 4, 3, 2))), 16, 10).cast("long")
    return F.when(F.hex(F.substring(g, 1, 1)) == "01", code.bitwiseAND(F.lit(0x0FFFFFFF)) % 1000)


def dimensions(geometry: str | Column) -> tuple[Column, Column]:
    """Whether little-endian WKB has Z and M, by its type code (thousands, or the two highest bits); null for other byte orders."""
    g = _col(geometry)
    code = F.conv(F.concat(*(F.hex(F.substring(g, i, 1)) for i in (5, 4, 3, 2))), 16, 10).cast("long")
    thousands, little = F.floor(code.bitwiseAND(F.lit(0x0FFFFFFF)) / 1000), F.hex(F.substring(g, 1, 1)) == "01"
    return F.when(little, thousands.isin(1, 3) | (code.bitwiseAND(F.lit(0x80000000)) != 0)), F.when(little, thousands.isin(2, 3) | (code.bitwiseAND(F.lit(0x40000000)) != 0))


def make_point(x: Column, y: Column, z: Column | None = None, m: Column | None = None) -> Column:
    """ISO WKB points from coordinates."""
    has_z, has_m = z is not None, m is not None
    head = np.frombuffer(b"\x01" + (1 + 1000 * has_z + 2000 * has_m).to_bytes(4, "little"), np.uint8)

    @arrow_udf(T.BinaryType())
    def build(*cols: pa.Array) -> pa.Array:
        xy = np.column_stack([c.to_numpy(zero_copy_only=False) for c in cols]).astype("<f8")
        raw = np.concatenate([np.tile(head, (len(xy), 1)), xy.view(np.uint8).reshape(len(xy), -1)], axis=1) if len(xy) else np.zeros((0, 5), np.uint8)
        return pa.array([r.tobytes() for r in raw], pa.binary())

    return build(*[c for c in (x, y, z, m) if c is not None])


def make_box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """ISO WKB polygons of boxes: one closed counter-clockwise ring."""
    head = np.frombuffer(b"\x01\x03\x00\x00\x00\x01\x00\x00\x00\x05\x00\x00\x00", np.uint8)

    @arrow_udf(T.BinaryType())
    def build(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        x0, y0, x1, y1 = (v.to_numpy(zero_copy_only=False) for v in (a, b, c, d))
        xy = np.column_stack([x0, y0, x1, y0, x1, y1, x0, y1, x0, y0]).astype("<f8")
        raw = np.concatenate([np.tile(head, (len(xy), 1)), xy.view(np.uint8).reshape(len(xy), -1)], axis=1) if len(xy) else np.zeros((0, 5), np.uint8)
        return pa.array([r.tobytes() for r in raw], pa.binary())

    return build(xmin, ymin, xmax, ymax)


def make_line(vertices: Column) -> Column:
    """ISO WKB line strings from array<struct<x,y>>."""

    @arrow_udf(T.BinaryType())
    def build(v: pa.Array) -> pa.Array:
        flat, off = v.flatten(), v.offsets.to_numpy()
        xy = np.column_stack([flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)]).astype(float)
        off = off - off[0]
        return pa.array([W.encode(W.Geometry(2, False, False, xy[a:b], [b - a])) for a, b in zip(off[:-1], off[1:])], pa.binary())

    return build(vertices)


def strip_dims(geometry: str | Column, strip_z: bool, strip_m: bool) -> Column:
    if not strip_z and not strip_m:
        return _col(geometry)

    @arrow_udf(T.BinaryType())
    def stripped(g: pa.Array) -> pa.Array:
        return pa.array(_mapped(g, lambda d: W.strip(d, strip_z, strip_m)), pa.binary())

    return stripped(_col(geometry))


# Reference systems: spherical Mercator in closed form


def mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.radians(x) * RADIUS, F.log(F.tan(F.radians(y) / 2 + F.lit(np.pi / 4))) * RADIUS


def _project(xy: np.ndarray, source: int, target: int) -> np.ndarray:
    out = xy.copy()
    with np.errstate(all="ignore"):
        if (source, target) == (4326, 3857):
            out[:, 0] = np.radians(xy[:, 0]) * RADIUS
            out[:, 1] = np.log(np.tan(np.pi / 4 + np.radians(xy[:, 1]) / 2)) * RADIUS
        elif (source, target) == (3857, 4326):
            out[:, 0] = np.degrees(xy[:, 0] / RADIUS)
            out[:, 1] = np.degrees(2 * np.arctan(np.exp(xy[:, 1] / RADIUS)) - np.pi / 2)
        elif source != target:
            raise ValueError(f"no transformation from EPSG:{source} to EPSG:{target}")
    return out


def to_crs(geometry: str | Column, source: int, target: int) -> Column:
    """Reprojected geometry. In EPSG:3857 what is not finite or lies beyond the square world is refused; the same system other than that is left alone."""
    if source == target and target != 3857:
        return _col(geometry)

    @arrow_udf(T.BinaryType())
    def projected(g: pa.Array) -> pa.Array:
        def one(data: bytes) -> bytes:
            geo = W.decode(data)
            geo.xy = _project(geo.xy, source, target)
            if target == 3857 and len(geo.xy):
                edge = np.abs(geo.xy[:, :2]).max()
                empty = geo.kind == 1 and np.isnan(geo.xy[:, :2]).all()
                if not empty and not edge <= MERCATOR_EDGE:
                    raise ValueError("geometry lies outside the Web Mercator domain")
            return W.encode(geo)

        return pa.array(_mapped(g, one), pa.binary())

    return projected(_col(geometry))


def outside_mercator(x: Column, y: Column) -> Column:
    """Whether a point's projection would be refused."""
    mx, my = mercator(x, y)
    return ~F.coalesce((F.abs(mx) <= MERCATOR_EDGE) & (F.abs(my) <= MERCATOR_EDGE) & ~F.isnan(mx) & ~F.isnan(my), F.lit(False))


# Levels of detail


def _lod_type(encoding: str, has_z: bool, has_m: bool, stored: list[L.Level]) -> tuple[str, pa.DataType]:
    names = ["x", "y", *(["z"] if has_z else []), *(["m"] if has_m else [])]
    if encoding == "native":
        one = "array<array<struct<" + ",".join(f"{n}:double" for n in names) + ">>>"
        arrow = pa.list_(pa.list_(pa.struct([(n, pa.float64()) for n in names])))
    else:
        one, arrow = "binary", pa.binary()
    return "struct<" + ",".join(f"{x.column}:{one}" for x in stored) + ">", pa.struct([(x.column, arrow) for x in stored])


def lod_struct(geometry: str | Column, family: str, wkid: int = 4326, encoding: str = "pbf", has_z: bool = False, has_m: bool = False, stored: list[L.Level] | None = None) -> Column:
    """struct<level_0, level_2, ...>: all levels of a geometry, which is decoded once. Polygons in protocol buffers have their rings turned to clockwise first."""
    stored = stored or L.levels(wkid)
    kind, arrow = _lod_type(encoding, has_z, has_m, stored)

    @arrow_udf(kind)
    def lods(g: pa.Array) -> pa.Array:
        if encoding == "pbf" and not has_z and not has_m:
            parts: dict[str, list] = {x.column: [] for x in stored}
            for s in range(0, len(g), 2000):
                for k, v in B.pbf_levels(g.slice(s, 2000).to_pylist(), family, stored).items():
                    parts[k] += v
            return pa.StructArray.from_arrays([pa.array(v, pa.binary()) for v in parts.values()], list(parts))
        if not has_z and not has_m and family in ("polyline", "polygon") and (encoding == "native" or B.simple(g.drop_null().to_pylist())):
            f = B.flat_of(g.to_pylist(), family)
            if encoding == "native":
                return pa.StructArray.from_arrays([B.native_level(f, x.resolution, family).cast(arrow.field(x.column).type) for x in stored], [x.column for x in stored])
            return pa.StructArray.from_arrays([pa.array(B.wkb_level(f, x.resolution, family), pa.binary()) for x in stored], [x.column for x in stored])

        def one(data: bytes):
            geo = W.decode(data)
            if geo.family != family:
                raise ValueError(f"expected {family} geometry, found {W.NAMES[geo.kind]}")
            if encoding == "pbf" and family == "polygon":
                geo = L.clockwise(geo)
            out = {}
            for x in stored:
                q = L.quantize(geo, x.resolution, has_z=has_z, has_m=has_m)
                out[x.column] = L.pbf_encode(q) if encoding == "pbf" else L.to_wkb(q, geo.kind, x.resolution, has_z, has_m) if encoding == "wkb" else L.to_native(q, x.resolution, has_z, has_m)
            return out

        return pa.array([r or {x.column: None for x in stored} for r in _mapped(g, one)], arrow)

    return lods(_col(geometry))


def lod_decode(payload: str | Column, family: str, resolution: float, stride: int = 2) -> Column:
    """struct<wkb, xmin, ymin, xmax, ymax> of a payload: what would be shown; null where nothing is."""

    @arrow_udf("struct<wkb:binary,xmin:double,ymin:double,xmax:double,ymax:double>")
    def shown(p: pa.Array) -> pa.Array:
        if family == "polygon" and stride == 2:
            q = B.pbf_decode(p.drop_null().to_pylist())
            if q is not None and (rings := B.shown_rings(q, resolution)):
                there = p.is_valid().to_numpy(zero_copy_only=False)
                wkb, box = pa.array(rings[0], pa.binary()), rings[1]
                out = pa.StructArray.from_arrays([wkb, *(pa.array(box[:, i].copy()) for i in range(4))], ["wkb", "xmin", "ymin", "xmax", "ymax"], mask=wkb.is_null())
                return out.take(pa.array(np.cumsum(there) - 1, mask=~there))

        def one(data: bytes):
            g = L.decoded(data, family, resolution, stride=stride)
            if g is None:
                return None
            lo, hi = g.xy.min(axis=0), g.xy.max(axis=0)
            return {"wkb": W.encode(g), "xmin": lo[0], "ymin": lo[1], "xmax": hi[0], "ymax": hi[1]}

        return pa.array(_mapped(p, one), pa.struct([("wkb", pa.binary()), *((k, pa.float64()) for k in ("xmin", "ymin", "xmax", "ymax"))]))

    return shown(_col(payload))


@arrow_udf(T.StructType([T.StructField("lengths", T.ArrayType(T.IntegerType())), T.StructField("coords", T.ArrayType(T.LongType()))]))
def _pbf(p: pa.Array) -> pa.Array:
    def one(data: bytes):
        q = L.pbf_decode(data)
        return {"lengths": q.lengths, "coords": q.grid.ravel().tolist()}

    q = None if p.null_count else B.pbf_decode(p.to_pylist())
    if q is not None:
        parts, ends = np.append(0, np.cumsum(q.parts)), np.append(0, np.cumsum(q.sizes))
        lengths = pa.ListArray.from_arrays(pa.array(parts, pa.int32()), pa.array(q.sizes, pa.int32()))
        return pa.StructArray.from_arrays([lengths, pa.ListArray.from_arrays(pa.array(ends[parts] * 2, pa.int32()), pa.array(q.grid.ravel()))], ["lengths", "coords"])
    return pa.array(_mapped(p, one), pa.struct([("lengths", pa.list_(pa.int32())), ("coords", pa.list_(pa.int64()))]))


def pbf_parts(payload: str | Column) -> Column:
    """Lengths and absolute grid coordinates of an XY payload."""
    return _pbf(_col(payload))


def quantized(v: Column, scale: float, translate: float = 0.0) -> Column:
    """Grid coordinate of a number: halves away from zero."""
    return F.round((v - translate) / scale).cast("long")


def vertex_counts(geometry: str | Column, resolution: float, has_z: bool = False) -> Column:
    """Vertices left at a level."""

    @arrow_udf(T.IntegerType())
    def counts(g: pa.Array) -> pa.Array:
        if not has_z and not g.null_count:
            f = B.decode(g.to_pylist())
            if len(f.families) == 1:
                return pa.array(B.vertex_counts(f, resolution, *f.families), pa.int32())
        return pa.array(_mapped(g, lambda d: len(L.quantize(W.decode(d), resolution, has_z=has_z).grid)), pa.int32())

    return counts(_col(geometry))


@arrow_udf(T.StringType())
def _geojson(g: pa.Array) -> pa.Array:
    return pa.array(_mapped(g, lambda d: json.dumps(L.geojson(W.decode(d)))), pa.string())


def as_geojson(geometry: str | Column) -> Column:
    return _geojson(_col(geometry))


_RING = T.StructType([T.StructField("closed", T.BooleanType()), T.StructField("area", T.DoubleType()), T.StructField("degenerate", T.BooleanType())])
INSPECTION = T.StructType(
    [
        T.StructField("type", T.StringType()), T.StructField("family", T.StringType()), T.StructField("has_z", T.BooleanType()), T.StructField("has_m", T.BooleanType()),
        T.StructField("extent", T.ArrayType(T.DoubleType())), T.StructField("mixed", T.BooleanType()), T.StructField("rings", T.ArrayType(_RING)),
        T.StructField("ring_counts", T.ArrayType(T.IntegerType())), T.StructField("error", T.StringType()),
    ]
)


def _inspected(g: pa.Array, s: B.Simple, ring: pa.DataType) -> pa.Array:
    """The inspection of a batch of simple geometries, column by column."""
    got, null = B.inspect(s), g.is_null()
    there = g.is_valid().to_numpy(zero_copy_only=False)
    place = pa.array(np.cumsum(there) - 1, mask=~there)
    extents = np.concatenate([got["low"], got["high"]], axis=1)
    n, polygon = len(s.sizes), s.kind == 3
    each = np.arange(n + 1) if polygon else np.zeros(n + 1, int)
    rings = [pa.array(got[k] if polygon else np.zeros(0, t)) for k, t in (("closed", bool), ("area", float), ("degenerate", bool))]
    columns = {
        "type": pa.array(np.full(n, W.NAMES[s.kind])), "family": pa.array(np.full(n, W.FAMILY[s.kind])), "has_z": pa.array(np.full(n, s.has_z)), "has_m": pa.array(np.full(n, s.has_m)),
        "extent": pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 4, pa.int32()), pa.array(extents.ravel()), mask=pa.array(~got["some"])), "mixed": pa.array(got["mixed"]),
        "rings": pa.ListArray.from_arrays(pa.array(each, pa.int32()), pa.StructArray.from_arrays(rings, fields=list(ring))),
        "ring_counts": pa.ListArray.from_arrays(pa.array(each, pa.int32()), pa.array(np.ones(n * polygon), pa.int32())), "error": pa.nulls(n, pa.string()),
    }
    return pa.StructArray.from_arrays([c.take(place) for c in columns.values()], list(columns), mask=null)


@arrow_udf(INSPECTION)
def _inspect(g: pa.Array) -> pa.Array:
    def one(data: bytes):
        try:
            return W.inspect(data) | {"error": None}
        except ValueError as e:
            return {"error": str(e)}

    ring = pa.struct([("closed", pa.bool_()), ("area", pa.float64()), ("degenerate", pa.bool_())])
    some = B.simple(g.drop_null().to_pylist())
    if some:
        return _inspected(g, some, ring)
    kind = pa.struct([("type", pa.string()), ("family", pa.string()), ("has_z", pa.bool_()), ("has_m", pa.bool_()), ("extent", pa.list_(pa.float64())), ("mixed", pa.bool_()), ("rings", pa.list_(ring)), ("ring_counts", pa.list_(pa.int32())), ("error", pa.string())])
    return pa.array(_mapped(g, one), kind)


def inspect(geometry: str | Column) -> Column:
    return _inspect(_col(geometry))


def object_id(file_id: Column, row_id: Column) -> Column:
    """File number (16 bits) and row number (32 bits) in one."""
    return F.shiftleft(file_id.cast("long"), 32).bitwiseOR(row_id.cast("long"))
