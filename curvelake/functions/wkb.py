"""Well-known binary: ISO and extended headers in, ISO little-endian out, with numpy for coordinates."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

NAMES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}
CODES = {v: k for k, v in NAMES.items()}
FAMILY = {1: "point", 4: "multipoint", 2: "polyline", 5: "polyline", 3: "polygon", 6: "polygon"}
MEMBER = {4: 1, 5: 2, 6: 3}
DEEPEST = 64
_Z, _M, _SRID, _BBOX = 0x80000000, 0x40000000, 0x20000000, 0x10000000


class WkbError(ValueError):
    pass


@dataclass
class Geometry:
    """Coordinates (n x (2 + Z + M)) of all parts one after the other, the parts' lengths, and for polygons how many rings each has. A multipoint is one part."""

    kind: int
    has_z: bool
    has_m: bool
    xy: np.ndarray
    lengths: list[int]
    rings: list[int] = field(default_factory=list)

    @property
    def family(self) -> str:
        return FAMILY[self.kind]

    def parts(self) -> list[np.ndarray]:
        return np.split(self.xy, np.cumsum(self.lengths)[:-1]) if self.lengths else []


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise WkbError("unexpected end of WKB")
        self.at += n
        return self.data[self.at - n : self.at]

    def header(self) -> tuple[str, int, bool, bool]:
        order = self.take(1)[0]
        if order > 1:
            raise WkbError(f"invalid WKB byte order {order}")
        e = "<" if order else ">"
        (code,) = struct.unpack(e + "I", self.take(4))
        if code & _BBOX:
            raise WkbError("WKB bounding boxes are not supported")
        z, m = bool(code & _Z), bool(code & _M)
        if code & _SRID:
            self.take(4)
        thousands, kind = divmod(code & 0x0FFFFFFF, 1000)
        if thousands > 3 or (thousands and (z or m)):
            raise WkbError(f"unknown WKB geometry type {code}")
        if thousands:
            z, m = thousands in (1, 3), thousands in (2, 3)
        return e, kind, z, m

    def count(self, e: str) -> int:
        return struct.unpack(e + "I", self.take(4))[0]

    def coords(self, e: str, n: int, dims: int) -> np.ndarray:
        return np.frombuffer(self.take(8 * n * dims), e + "f8").reshape(n, dims).astype("<f8")


def header(data: bytes) -> tuple[int, bool, bool]:
    """Type code 1..7 and the dimensions, without reading further."""
    _, kind, z, m = _Reader(data).header()
    if kind not in NAMES:
        raise WkbError(f"unknown WKB geometry type {kind}")
    return kind, z, m


def _body(r: _Reader, depth: int, want: int | None) -> tuple[int, bool, bool, list, list[int]]:
    """Type, dimensions, parts and rings of each polygon; a collection's members have their own dimensions and are returned as tuples."""
    if depth > DEEPEST:
        raise WkbError("WKB nesting is too deep")
    e, kind, z, m = r.header()
    if want is not None and kind != want:
        raise WkbError(f"unexpected WKB member type {kind}")
    dims = 2 + z + m
    if kind == 1:
        return kind, z, m, [r.coords(e, 1, dims)], []
    if kind == 2:
        return kind, z, m, [r.coords(e, r.count(e), dims)], []
    if kind == 3:
        rings = [r.coords(e, r.count(e), dims) for _ in range(r.count(e))]
        return kind, z, m, rings, [len(rings)]
    if kind in MEMBER:
        members = [_body(r, depth + 1, MEMBER[kind]) for _ in range(r.count(e))]
        if any((x[1], x[2]) != (z, m) for x in members):
            raise WkbError("WKB members have other dimensions than their parent")
        parts = [p for x in members for p in x[3]]
        if kind == 4:
            parts = [np.concatenate(parts)] if parts else []
        return kind, z, m, parts, [n for x in members for n in x[4]]
    if kind == 7:
        return kind, z, m, [_body(r, depth + 1, None) for _ in range(r.count(e))], []
    raise WkbError(f"unknown WKB geometry type {kind}")


def decode(data: bytes) -> Geometry:
    """A geometry that can be processed; collections are refused and bytes after it too."""
    r = _Reader(data)
    kind, z, m, parts, rings = _body(r, 0, None)
    if r.at != len(data):
        raise WkbError("trailing bytes after WKB geometry")
    if kind == 7:
        raise WkbError("unsupported geometry type GeometryCollection")
    if kind == 1 and np.isnan(parts[0][0, :2]).all():
        parts = [parts[0][:1]]
    xy = np.concatenate(parts) if parts else np.zeros((0, 2 + z + m))
    return Geometry(kind, z, m, xy, [len(p) for p in parts], rings)


def point(data: bytes) -> tuple[float, float, float | None, float | None]:
    """x, y, z and m of a point. Bytes after it aren't looked at."""
    r = _Reader(data)
    e, kind, z, m = r.header()
    if kind != 1:
        raise WkbError(f"expected a point, found {NAMES.get(kind, kind)}")
    c = r.coords(e, 1, 2 + z + m)[0].tolist()
    return c[0], c[1], c[2] if z else None, c[-1] if m else None


def _write(kind: int, z: bool, m: bool, parts: list, rings: list[int], keep: list[int], out: list[bytes], dims: tuple[bool, bool]) -> None:
    def head(k: int) -> bytes:
        return struct.pack("<BI", 1, k + 1000 * dims[0] + 2000 * dims[1])

    def run(c: np.ndarray) -> bytes:
        return struct.pack("<I", len(c)) + np.ascontiguousarray(c[:, keep], "<f8").tobytes()

    if kind == 1:
        out.append(head(1) + np.ascontiguousarray(parts[0][:1, keep], "<f8").tobytes())
    elif kind == 2:
        out.append(head(2) + (run(parts[0]) if parts else struct.pack("<I", 0)))
    elif kind == 3:
        out.append(head(3) + struct.pack("<I", len(parts)) + b"".join(map(run, parts)))
    elif kind == 4:
        points = parts[0] if parts else np.zeros((0, len(keep)))
        out.append(head(4) + struct.pack("<I", len(points)) + b"".join(head(1) + np.ascontiguousarray(p[keep], "<f8").tobytes() for p in points))
    elif kind == 5:
        out.append(head(5) + struct.pack("<I", len(parts)) + b"".join(head(2) + run(p) for p in parts))
    elif kind == 6:
        out.append(head(6) + struct.pack("<I", len(rings)))
        at = 0
        for n in rings:
            out.append(head(3) + struct.pack("<I", n) + b"".join(map(run, parts[at : at + n])))
            at += n


def encode(g: Geometry) -> bytes:
    """ISO little-endian WKB."""
    out: list[bytes] = []
    _write(g.kind, g.has_z, g.has_m, g.parts(), g.rings, list(range(2 + g.has_z + g.has_m)), out, (g.has_z, g.has_m))
    return b"".join(out)


def strip(data: bytes, strip_z: bool, strip_m: bool) -> bytes:
    """Without Z or M, collections included; a plain copy where neither is asked for."""
    if not strip_z and not strip_m:
        return data
    r = _Reader(data)
    out: list[bytes] = []

    def go(body) -> None:
        kind, z, m, parts, rings = body
        dims = z and not strip_z, m and not strip_m
        keep = [0, 1] + ([2] if dims[0] else []) + ([2 + z] if dims[1] else [])
        if kind == 7:
            out.append(struct.pack("<BII", 1, 7 + 1000 * dims[0] + 2000 * dims[1], len(parts)))
            for p in parts:
                go(p)
        else:
            _write(kind, z, m, parts, rings, keep, out, dims)

    go(_body(r, 0, None))
    if r.at != len(data):
        raise WkbError("trailing bytes after WKB geometry")
    return b"".join(out)


def bounds(data: bytes) -> tuple[float, float, float, float]:
    """Of all coordinates; a NaN counts only where there is nothing else."""
    xy = decode(data).xy
    if not len(xy):
        raise WkbError("geometry missing bounding rectangle")
    lo, hi = np.fmin.reduce(xy[:, :2]), np.fmax.reduce(xy[:, :2])
    return float(lo[0]), float(lo[1]), float(hi[0]), float(hi[1])


def ring_area(ring: np.ndarray) -> float:
    """Signed; counter-clockwise is positive. Taken about the first vertex, so that far-away rings keep their digits."""
    if len(ring) < 3:
        return 0.0
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float(np.dot(x[:-1], y[1:]) - np.dot(x[1:], y[:-1]) + x[-1] * y[0] - x[0] * y[-1]) / 2


def inspect(data: bytes) -> dict:
    """What a validator asks of a geometry."""
    g = decode(data)
    finite = np.isfinite(g.xy[:, :2]).all(axis=1) if len(g.xy) else np.zeros(0, bool)
    good = g.xy[finite]
    rings = []
    if g.family == "polygon":
        for p in g.parts():
            area = ring_area(p)
            rings.append({"closed": bool(len(p) and (p[0, :2] == p[-1, :2]).all()), "area": area, "degenerate": len(p) < 4 or abs(area) <= np.finfo(float).eps})
    extent = [float(v) for v in (*good[:, :2].min(axis=0), *good[:, :2].max(axis=0))] if len(good) else None
    return {"type": NAMES[g.kind], "family": g.family, "has_z": g.has_z, "has_m": g.has_m, "extent": extent, "mixed": bool(finite.any() and not finite.all()), "rings": rings, "ring_counts": g.rings}
