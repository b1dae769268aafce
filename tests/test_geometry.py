"""Codecs, levels of detail and curve keys against fixed values and independent scalar versions."""

import math
import random
import struct

import numpy as np
import pytest

from curvelake.functions import batch as B
from curvelake.functions import curves as K
from curvelake.functions import lod as L
from curvelake.functions import wkb as W


def geometry(kind, has_z=False, has_m=False, seed=0):
    rnd = np.random.default_rng(seed)
    dims = 2 + has_z + has_m
    if kind == 1:
        parts, rings = [rnd.uniform(-9, 9, (1, dims))], []
    elif kind in (2, 4):
        parts, rings = [rnd.uniform(-9, 9, (5, dims))], []
    elif kind == 5:
        parts, rings = [rnd.uniform(-9, 9, (n, dims)) for n in (2, 4)], []
    else:
        parts = [np.vstack([p, p[:1]]) for p in (rnd.uniform(-9, 9, (4, dims)) for _ in range(3))]
        parts, rings = (parts[:2], [2]) if kind == 3 else (parts, [1, 2])
    return W.Geometry(kind, has_z, has_m, np.concatenate(parts), [len(p) for p in parts], rings)


@pytest.mark.parametrize("kind", range(1, 7))
@pytest.mark.parametrize("dims", [(False, False), (True, False), (False, True), (True, True)])
def test_wkb_round_trip_and_strip(kind, dims):
    g = geometry(kind, *dims)
    data = W.encode(g)
    back = W.decode(data)
    assert (back.kind, back.has_z, back.has_m, back.lengths, back.rings) == (kind, *dims, g.lengths, g.rings) and (back.xy == g.xy).all()
    flat = W.decode(W.strip(data, True, True))
    assert (flat.xy == g.xy[:, :2]).all() and not flat.has_z and not flat.has_m
    assert W.strip(data, False, False) is data
    for cut in (1, 5, len(data) - 1):
        with pytest.raises(W.WkbError, match="unexpected end|byte order"):
            W.decode(data[:cut])
    with pytest.raises(W.WkbError, match="trailing"):
        W.decode(data + b"\0")


def test_wkb_headers():
    assert W.header(struct.pack(">BI", 0, 1)) == (1, False, False)
    assert W.header(struct.pack("<BII", 1, 0xE0000003, 4326)) == (3, True, True)
    assert W.point(struct.pack(">BII", 0, 0x60000001, 4326) + struct.pack(">ddd", 1, 2, 3)) == (1.0, 2.0, None, 3.0)
    for bad in (b"\x02\x01\0\0\0", struct.pack("<BI", 1, 0x10000001), struct.pack("<BI", 1, 4001), struct.pack("<BI", 1, 99)):
        with pytest.raises(W.WkbError):
            W.header(bad)
    with pytest.raises(W.WkbError, match="GeometryCollection"):
        W.decode(struct.pack("<BII", 1, 7, 0))
    deep = struct.pack("<BII", 1, 7, 1) * 70 + struct.pack("<BII", 1, 7, 0)
    with pytest.raises(W.WkbError, match="deep"):
        W.decode(deep)
    with pytest.raises(W.WkbError, match="member"):
        W.decode(struct.pack("<BII", 1, 4, 1) + struct.pack("<BII", 1, 2, 0))
    with pytest.raises(W.WkbError, match="bounding"):
        W.bounds(struct.pack("<BII", 1, 2, 0))
    assert W.bounds(struct.pack("<BIIdddd", 1, 2, 2, math.nan, 1.0, 5.0, 2.0)) == (5.0, 1.0, 5.0, 2.0)


def test_inspection():
    ring = np.array([[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], float)
    i = W.inspect(W.encode(W.Geometry(3, False, False, np.vstack([ring, ring[::-1] / 2]), [5, 5], [2])))
    assert [r["area"] for r in i["rings"]] == [16.0, -4.0] and all(r["closed"] for r in i["rings"]) and i["extent"] == [0, 0, 4, 4]
    open_ = W.inspect(W.encode(W.Geometry(3, False, False, ring[:-1], [4], [1])))
    assert not open_["rings"][0]["closed"]


def test_rounding_and_grid():
    v = np.array([0.5, -0.5, 1.5, -1.5, 2.4, 0.49999999999999994])
    assert L.round_half_away(v).tolist() == [1, -1, 2, -2, 2, 0]
    assert L.to_grid(np.array([np.nan, np.inf, -np.inf]), 1.0, 0.0).tolist() == [0, 2**63 - 1, -(2**63)]


def scalar_merge(points):
    out, direction = [points[0]], None
    for p in points[1:]:
        d = (p[0] - out[-1][0], p[1] - out[-1][1]) if direction is None else (p[0] - last[0], p[1] - last[1])  # noqa: F821
        if d == (0, 0):
            continue
        if direction and direction[0] * d[1] == d[0] * direction[1] and direction[0] * d[0] + direction[1] * d[1] > 0:
            out[-1] = p
        else:
            out.append(p)
            direction = d
        last = p  # noqa: F841
    return out


def test_straight_runs_are_merged():
    rnd = random.Random(1)
    for _ in range(300):
        pts = [(0, 0)]
        for _ in range(rnd.randrange(0, 30)):
            pts.append((pts[-1][0] + rnd.randrange(-1, 2), pts[-1][1] + rnd.randrange(-1, 2)))
        assert [tuple(v) for v in L.merge_straight(np.array(pts, np.int64)).tolist()] == scalar_merge(pts)
    far = np.array([[0, 0], [1 << 40, 1 << 40], [1 << 41, 1 << 41], [1 << 40, 1 << 40]], np.int64)
    assert len(L.merge_straight(far)) == 3  # turning back is kept


def test_simplification_stays_within_tolerance():
    rnd = np.random.default_rng(2)
    for closed in (False, True):
        p = np.cumsum(rnd.normal(size=(400, 2)), axis=0)
        if closed:
            p = np.vstack([p, p[:1]])
        keep = L.simplify(p, 2.0)
        assert keep[0] == 0 and keep[-1] == len(p) - 1 and len(keep) >= (4 if closed else 2)
        for a, b in zip(keep[:-1], keep[1:]):
            assert L._deviation(p, a, b)[1] <= 4.0
    line = np.array([[0, 0], [1, 1.0], [2, 0]])
    assert L.simplify(line, 1.0).tolist() == [0, 2]  # a deviation equal to the tolerance goes


def test_parts_that_collapse():
    ring = np.array([[0, 0], [1e-9, 0], [1e-9, 1e-9], [0, 0]]) + 5.0
    g = W.Geometry(6, False, False, np.vstack([ring, ring * 1e3, ring]), [4, 4, 4], [1, 2])
    q = L.quantize(g, 1.0)
    assert q.lengths == [1] and q.rings == [1] and q.grid.tolist() == [[5, 5]]
    z = L.quantize(geometry(2), 1.0, has_z=True)
    assert z.grid.shape[1] == 3 and not z.grid[:, 2].any()


def test_pbf_fixed_bytes_and_oddities():
    grid = np.array([[256, 256], [258, 256], [258, 258], [256, 258], [256, 256], [56, 56], [58, 56], [58, 58], [56, 58], [56, 56]])
    data = L.pbf_encode(L.Quantized(grid, [5, 5], [2]))
    assert L._packed(data[6:]).tolist() == [512, 512, 4, 0, 0, 4, 3, 0, 0, 3, 112, 112, 4, 0, 0, 4, 3, 0, 0, 3]
    back = L.pbf_decode(data)
    assert back.lengths == [5, 5] and (back.grid == grid).all()
    unpacked = b"\x10\x02" + b"".join(b"\x18" + bytes([v]) for v in (2, 4, 2, 2))
    assert L.pbf_decode(b"\x08\x05" + unpacked + b"\x25abcd" + b"\x29abcdefgh" + b"\x32\x01x").grid.tolist() == [[1, 2], [2, 3]]
    for bad in (b"\x12\x05\x01", b"\x12\x01\x02\x1a\x01\x02", b"\x1b", b"\x10" + b"\xff" * 10 + b"\x01"):
        with pytest.raises(L.PbfError):
            L.pbf_decode(bad)
    big = L.pbf_encode(L.Quantized(np.array([[-(2**60), 2**60]]), [1], []))
    assert L.pbf_decode(big).grid.tolist() == [[-(2**60), 2**60]]
    with pytest.raises(L.PbfError, match="safe"):
        L.pbf_decode(big, safe=True)


def test_batches_equal_single_geometries():
    rnd = np.random.default_rng(3)
    for family, kinds in (("polyline", (2, 5)), ("polygon", (3, 6)), ("multipoint", (4,))):
        rows = []
        for i in range(80):
            g = geometry(kinds[i % len(kinds)], seed=i)
            g.xy = g.xy * 10.0 ** -float(rnd.integers(0, 6))
            rows.append(None if i % 9 == 4 else W.encode(g))
        got = B.pbf_levels(rows, family, L.levels())
        for x in L.levels():
            want = [r and L.pbf_encode(L.quantize(L.clockwise(W.decode(r)) if family == "polygon" else W.decode(r), x.resolution)) for r in rows]
            assert got[x.column] == want
        box = B.bounds(B.decode(rows))
        assert all(np.isnan(b).all() if r is None else tuple(b) == W.bounds(r) for r, b in zip(rows, box))


def test_decoded_shapes():
    ring = np.array([[0, 0], [0, 4], [4, 4], [4, 0], [0, 0]])
    q = L.Quantized(np.vstack([ring, ring[::-1] // 2, ring + 10]), [5, 5, 5], [])
    g = L.decoded(L.pbf_encode(q), "polygon", 1.0)
    assert g.kind == 6 and g.rings == [2, 1] and W.ring_area(g.parts()[0]) > 0
    assert L.decoded(L.pbf_encode(L.Quantized(ring[:1], [1], [])), "polygon", 1.0) is None
    line = L.decoded(L.pbf_encode(L.Quantized(ring[:3], [2, 1], [])), "polyline", 1.0)
    assert L.geojson(line) == {"type": "LineString", "coordinates": [[0.0, 0.0], [0.0, 4.0]]}


def test_levels():
    x = L.levels()
    assert len(x) == 9 and (x[0].resolution, x[0].scale) == (0.703125, 295829355.4545656) and (x[1].level, x[1].resolution, x[1].scale) == (2, 0.17578125, 73957338.8636414)
    assert K.level_for(0.703125).level == 0 and K.level_for(1e-9).level == 16


def code(box, full, g):
    return int(K.xz_codes(*(np.array([v]) for v in box), K.Extent(*full), g)[0])


@pytest.mark.parametrize(
    "box, full, g, want",
    [((0, 0, 1, 1), (0, 0, 8, 8), 1, 1), ((7, 7, 8, 8), (0, 0, 8, 8), 1, 4), ((0, 0, 0.9, 0.9), (0, 0, 8, 8), 2, 2), ((0, 0, 8, 8), (0, 0, 8, 8), 3, 0), ((3, 4.2, 4.9, 4.9), (0, 0, 8, 8), 3, 51),
     ((-117.0992242, 34.0448088, -117.085404, 34.0545866), (-117.3150315, 33.989629, -116.9566474, 34.1729119), 20, 555482436952), ((1, 1, 1, 5), (0, 0, 8, 8), 9, 0)],
)
def test_xz_codes(box, full, g, want):
    assert code(box, full, g) == want


@pytest.mark.parametrize("x, y, full, p, want", [(-180, -90, (-180, -90, 180, 90), 4, 0), (180, 90, (-180, -90, 180, 90), 2, 15), (0, 0, (-180, -90, 180, 90), 1, 3), (0.2, 0, (0, 0, 1, 1), 2, 0), (0.25, 0, (0, 0, 1, 1), 2, 1), (1, 1, (0, 0, 1, 1), 2, 15), (math.nan, 1, (0, 0, 1, 1), 2, 10)])
def test_z_codes(x, y, full, p, want):
    assert int(K.z_codes([x], [y], K.Extent(*full), p)[0]) == want


#: Query extent in 0..10, deepest level, ranges.
RANGES = [
    ((0, 0, 10, 10), 0, [(0, 0)]), ((0, 0, 10, 10), 1, [(0, 4)]), ((0, 0, 4.9, 4.9), 1, [(0, 1)]), ((0, 0, 5, 4.9), 1, [(0, 1)]), ((0, 0, 5.000001, 4.9), 1, [(0, 2)]), ((0, 0, 4.9, 5), 1, [(0, 1)]),
    ((0, 0, 4.9, 5.000001), 1, [(0, 1), (3, 3)]), ((5, 5, 10, 10), 2, [(0, 1), (5, 6), (9, 11), (13, 13), (15, 20)]), ((4.9, 5, 10, 10), 2, [(0, 1), (4, 6), (9, 20)]), ((4.5, 0, 5.5, 0.25), 2, [(0, 3), (6, 7)]),
    ((0, 0, 5, 5), 3, [(0, 21)]), ((0, 0, 5, 5), 4, [(0, 85)]), ((0, 0, 5, 5), 8, [(0, 21845)]), ((0, 0, 5, 5), 12, [(0, 5592405)]), ((0, 0, 5, 5), 20, [(0, 366503875925)]), ((-2, -2, -1, -1), 20, []),
]


@pytest.mark.parametrize("query, g, want", RANGES)
def test_xz_ranges(query, g, want):
    assert K.xz_ranges(K.Extent(0, 0, 10, 10), K.Extent(*query), g) == want


def test_ranges_miss_nothing():
    rnd = random.Random(5)
    full = K.Extent(-180, -90, 180, 90)
    for _ in range(400):
        x, y = rnd.uniform(-180, 170), rnd.uniform(-90, 80)
        q = K.Extent(x, y, x + rnd.uniform(0.01, 10), y + rnd.uniform(0.01, 10))
        bx, by = rnd.uniform(q.xmin - 1, q.xmax), rnd.uniform(q.ymin - 1, q.ymax)
        box = (bx, by, bx + rnd.uniform(0, 5), by + rnd.uniform(0, 5))
        if K.overlaps(K.Extent(*box), q):
            assert K.in_ranges(code(box, full.as_list(), 20), K.xz_ranges(full, q, 20))
        p = rnd.uniform(q.xmin, q.xmax), rnd.uniform(q.ymin, q.ymax)
        assert K.in_ranges(int(K.z_codes([p[0]], [p[1]], full, 20)[0]), K.z_ranges(full, q, 20))


def test_viewports():
    full = K.Extent(-180, -90, 180, 90)
    assert K.viewport_extents(170, -10, 190, 10, full) == [K.Extent(170, -10, 180, 10), K.Extent(-180, -10, -170, 10)]
    assert K.viewport_extents(-400, -100, 400, 100, full) == [full]
    assert K.viewport_extents(0, 95, 10, 99, full) == []
    assert K.normal_longitude(180) == -180 and K.merge_ranges([(5, 6), (0, 2), (3, 3)]) == [(0, 3), (5, 6)]
