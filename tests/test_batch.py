"""Batches of simple geometries and payloads against the functions that read them one by one."""

import numpy as np
import pyarrow as pa
import pytest

from curvelake.functions import batch as B
from curvelake.functions import columns as C
from curvelake.functions import lod as L
from curvelake.functions import wkb as W
from curvelake.plans import validate as V

UNKNOWN = b"\x20\x01"  # a field that no payload of ours has: it is read by itself


def ring(rng, n, radius):
    a = np.sort(rng.random(n - 1)) * 2 * np.pi
    p = np.column_stack([np.cos(a), np.sin(a)]) * radius + rng.normal(size=2)
    return W.encode(W.Geometry(3, False, False, np.vstack([p, p[:1]]), [n], [1]))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    out = [ring(rng, int(rng.integers(4, 60)), rng.random() * 50) for _ in range(200)]
    return [*out[:7], None, *out[7:], None]


def test_simple_geometries(rows):
    rng = np.random.default_rng(2)
    for z, m in ((0, 0), (1, 0), (0, 1), (1, 1)):
        points = [W.encode(W.Geometry(1, bool(z), bool(m), rng.random((1, 2 + z + m)), [1])) for _ in range(9)]
        s = B.simple(points)
        assert (s.kind, s.has_z, s.has_m) == (1, z, m) and [tuple(c) for c in s.coords.tolist()] == [tuple(v for v in W.point(p) if v is not None) for p in points]
    some = [r for r in rows if r is not None]
    assert B.simple([]) is None and B.simple([*some, points[0]]) is None and B.simple([*some, some[0] + b"\0"]) is None and B.simple([some[0][:-1]]) is None
    big = W.encode(W.Geometry(3, False, False, np.zeros((8, 2)), [4, 4], [2]))
    assert B.simple([some[0], big]) is None
    f = B.decode([big, some[0], None])
    assert f.sizes.tolist()[:2] == [4, 4] and f.owner.tolist() == [0, 0, 1] and f.kinds.tolist() == [3, 3, 0]


def test_inspection(spark, rows):
    odd = W.encode(W.Geometry(3, False, False, np.array([[0, 0], [np.nan, 1], [1, 1], [0.0, 0]]), [4], [1]))
    bare = W.encode(W.Geometry(3, False, False, np.full((4, 2), np.nan), [4], [1]))
    given = [*rows, odd, bare]
    got = C._inspect.func(pa.array(given, pa.binary())).to_pylist()
    for r, x in zip(given, got):
        if r is None:
            assert x is None
            continue
        want = W.inspect(r)
        a, b = want.pop("rings")[0], x.pop("rings")[0]
        assert x.pop("error") is None and x == want and (a["closed"], a["degenerate"]) == (b["closed"], b["degenerate"])
        assert a["area"] == pytest.approx(b["area"], abs=1e-9, nan_ok=True)
    line = W.encode(W.Geometry(2, False, False, np.array([[0.0, 1], [2, 3]]), [2]))
    assert C._inspect.func(pa.array([line], pa.binary())).to_pylist() == [W.inspect(line) | {"error": None}]


@pytest.mark.parametrize("level", L.levels(), ids=lambda x: x.column)
def test_levels_and_payloads(spark, rows, level):
    f, some = B.flat_of(rows, "polygon"), [r for r in rows if r is not None]
    wkb, native, counts = B.wkb_level(f, level.resolution, "polygon"), B.native_level(f, level.resolution, "polygon").to_pylist(), B.vertex_counts(f, level.resolution, "polygon")
    for r, a, b, n in zip(rows, wkb, native, counts):
        if r is None:
            assert a is None and b is None and n == 0
            continue
        q = L.quantize(W.decode(r), level.resolution)
        assert L.to_wkb(q, 3, level.resolution) == a and L.to_native(q, level.resolution) == b and len(q.grid) == n
    payloads = [p for p in B.pbf_levels(rows, "polygon", [level])[level.column] if p is not None]
    got = B.pbf_decode(payloads)
    assert got.grid.tolist() == [v for p in payloads for v in L.pbf_decode(p).grid.tolist()] and got.sizes.tolist() == [n for p in payloads for n in L.pbf_decode(p).lengths]
    assert B.pbf_decode([*payloads, payloads[0] + UNKNOWN]) is None and B.pbf_decode([payloads[0][:-1]]) is None and B.pbf_decode([b""]) is None
    if (rings := B.shown_rings(got, level.resolution)) is not None:
        for p, x, box in zip(payloads, *rings):
            g = L.decoded(p, "polygon", level.resolution)
            assert (x is None) == (g is None) and (g is None or (W.encode(g) == x and box.tolist() == [*g.xy.min(axis=0), *g.xy.max(axis=0)]))
    check = V._payload_check("polygon", level.resolution, False, False).func
    turned = [L.pbf_encode(L.quantize(W.decode(r), level.resolution)) for r in some]
    for given in (payloads, payloads[1:] + payloads[:1], turned):
        whole = check(pa.array(some, pa.binary()), pa.array(given, pa.binary())).to_pylist()
        assert whole == check(pa.array(some, pa.binary()), pa.array([p + UNKNOWN for p in given], pa.binary())).to_pylist()


def test_points_and_headers(spark, rows):
    flat = [W.encode(W.Geometry(1, False, True, np.array([[1.0, 2, 3]]), [1])), None, W.encode(W.Geometry(1, False, True, np.array([[np.nan, np.nan, np.nan]]), [1]))]
    df = spark.createDataFrame([(x,) for x in flat], "g binary").coalesce(1)
    got = df.select(C.point_parts("g").alias("p"), C.header("g").alias("h")).collect()
    assert got[0]["p"].asDict() == {"x": 1.0, "y": 2.0, "z": None, "m": 3.0} and got[1]["p"]["x"] is None and np.isnan(got[2]["p"]["x"])
    assert got[0]["h"].asDict() == {"type": "Point", "has_z": False, "has_m": True} and got[1]["h"] is None
    with pytest.raises(Exception, match="dimensions"):
        df.select(C.point_parts("g", (True, False))).collect()
