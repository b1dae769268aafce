"""Whole Arrow batches of geometries as flat arrays: decoding, bounds and XY protocol-buffer levels without a Python call for each vertex or part."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from . import wkb as W
from .lod import LEAST_VERTICES, Level, _zigzag, to_grid


@dataclass
class Flat:
    """xy of all vertices; for each part its vertices and its geometry; the number of geometries. Null geometries have no parts."""

    xy: np.ndarray
    sizes: np.ndarray
    owner: np.ndarray
    n: int
    families: set[str]
    kinds: np.ndarray


@dataclass
class Simple:
    """Little-endian ISO geometries of one simple type (points, lines, polygons of one ring), all with as many dimensions: coordinates of all vertices, and the vertices of each geometry."""

    kind: int
    has_z: bool
    has_m: bool
    coords: np.ndarray
    sizes: np.ndarray


def simple(rows: list[bytes]) -> Simple | None:
    """All geometries in a few views of their joined bytes, whatever their lengths; None where one is of another make, which is read by itself."""
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    if not len(rows) or size.min() < 21:
        return None
    raw = np.frombuffer(b"".join(rows), np.uint8)
    at = np.cumsum(size) - size
    first = raw[at[:, None] + np.arange(5)]
    if first[0, 0] != 1 or not (first == first[0]).all():
        return None
    thousands, kind = divmod(int.from_bytes(first[0, 1:].tobytes(), "little"), 1000)
    head = {1: 5, 2: 9, 3: 13}.get(kind)
    if head is None or thousands > 3:
        return None

    def number(skip: int) -> np.ndarray:
        return np.ascontiguousarray(raw[(at + skip)[:, None] + np.arange(4)]).view("<u4").ravel().astype(np.int64)

    dims = (2, 3, 3, 4)[thousands]
    m = np.ones(len(rows), np.int64) if kind == 1 else number(head - 4)
    if (kind == 3 and (number(5) != 1).any()) or not m.all() or (head + 8 * dims * m != size).any():
        return None
    body = np.ones(len(raw), bool)
    body[(at[:, None] + np.arange(head)).ravel()] = False
    return Simple(kind, thousands in (1, 3), thousands in (2, 3), raw[body].view("<f8").reshape(-1, dims), m)


def decode(rows: list[bytes | None]) -> Flat:
    some = [r for r in rows if r is not None]
    if s := simple(some):
        there = np.fromiter((r is not None for r in rows), bool, len(rows))
        return Flat(np.ascontiguousarray(s.coords[:, :2]), s.sizes, np.flatnonzero(there), len(rows), {W.FAMILY[s.kind]}, np.where(there, s.kind, 0))
    xy, sizes, owner, families, kinds = [np.zeros((0, 2))], [], [], set(), np.zeros(len(rows), np.int64)
    for i, r in enumerate(rows):
        if r is None:
            continue
        g = W.decode(r)
        xy.append(g.xy[:, :2])
        sizes += g.lengths
        owner += [i] * len(g.lengths)
        families.add(g.family)
        kinds[i] = g.kind
    return Flat(np.concatenate(xy), np.array(sizes, np.int64), np.array(owner, np.int64), len(rows), families, kinds)


def bounds(f: Flat) -> np.ndarray:
    """n x 4; NaN rows for null geometries. A NaN coordinate counts only where there is nothing else."""
    out = np.full((f.n, 4), np.nan)
    vertices = np.repeat(f.owner, f.sizes)
    if not len(vertices):
        return out
    starts = np.flatnonzero(np.diff(vertices, prepend=-1))
    own = vertices[starts]
    out[own, :2] = np.fmin.reduceat(f.xy, starts)
    out[own, 2:] = np.fmax.reduceat(f.xy, starts)
    return out


def turned(f: Flat) -> Flat:
    """Each part reversed."""
    ends = np.cumsum(f.sizes)
    at = np.arange(len(f.xy))
    first = np.repeat(ends - f.sizes, f.sizes)
    return Flat(f.xy[np.repeat(ends, f.sizes) - 1 - (at - first)], f.sizes, f.owner, f.n, f.families, f.kinds)


def _varint_bytes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, and how many each has."""
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        more = (v >> np.uint64(7 * k)) > 0
        if not more.any():
            break
        size += more
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(v) else 0, np.uint8)
    begin = end - size
    for k in range(int(size.max(initial=0))):
        on = size > k
        out[begin[on] + k] = ((v[on] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(size[on] > k + 1, np.uint8(128), np.uint8(0))
    return out, size


def _small_varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def snapped(f: Flat, resolution: float, family: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a level keeps: grid coordinates, the part of each, and the vertices of each part. Straight runs are merged, short parts dropped, and the first vertex stays alone where nothing is left."""
    grid = np.column_stack([to_grid(f.xy[:, 0], resolution, 0.0), to_grid(f.xy[:, 1], resolution, 0.0)]) if len(f.xy) else np.zeros((0, 2), np.int64)
    part = np.repeat(np.arange(len(f.sizes)), f.sizes)
    source_first = np.append(0, np.cumsum(f.sizes)[:-1]) if len(f.sizes) else np.zeros(0, np.int64)
    if family in ("polyline", "polygon") and len(grid):
        opens = np.zeros(len(grid), bool)
        opens[source_first[f.sizes > 0]] = True
        moved = np.append(True, (grid[1:] != grid[:-1]).any(axis=1)) | opens
        g, p, first = grid[moved], part[moved], opens[moved]
        step = np.diff(g, axis=0, prepend=g[:1])
        a, b = step[:-1], step[1:]
        if len(step) > 1 and np.abs(step).max() >= 1 << 30:
            a, b = a.astype(object), b.astype(object)
        on = (~first[:-1]) & (~first[1:])
        on &= ((a[:, 0] * b[:, 1] == b[:, 0] * a[:, 1]) & (a[:, 0] * b[:, 0] + a[:, 1] * b[:, 1] > 0)).astype(bool)
        keep = np.append(~on, True)
        g, p = g[keep], p[keep]
        sizes = np.bincount(p, minlength=len(f.sizes))
        good = sizes >= LEAST_VERTICES[family]
        g, p = g[good[p]], p[good[p]]
        sizes = np.where(good, sizes, 0)
        lost = np.setdiff1d(np.unique(f.owner[f.sizes > 0]), f.owner[sizes > 0])
        if len(lost):  # geometries with nothing left keep their first vertex
            where = np.searchsorted(f.owner, lost)
            while (f.sizes[where] == 0).any():
                where = where + (f.sizes[where] == 0)
            sizes[where] = 1
            p = np.append(p, where)
            g = np.concatenate([g, grid[source_first[where]]])
            order = np.argsort(p, kind="stable")
            g, p = g[order], p[order]
        return g, p, sizes
    return grid, part, f.sizes.copy()


def vertex_counts(f: Flat, resolution: float, family: str) -> np.ndarray:
    """Vertices of each geometry that a level keeps."""
    _, _, sizes = snapped(f, resolution, family)
    return np.bincount(f.owner, sizes, f.n).astype(np.int64)


def pbf_level(f: Flat, resolution: float, family: str) -> list[bytes | None]:
    """The payload of each geometry at a level."""
    g, p, sizes = snapped(f, resolution, family)
    delta = g.copy()
    if len(g):
        same = np.append(False, p[1:] == p[:-1])
        delta[same] -= g[np.flatnonzero(same) - 1]
    body, size = _varint_bytes(_zigzag(np.ascontiguousarray(delta.ravel())))
    ends = np.append(0, np.cumsum(size))
    per_vertex = np.searchsorted(f.owner[p] if len(p) else p, np.arange(f.n + 1)) * 2
    body, cut = body.tobytes(), ends[per_vertex]
    kept = sizes > 0
    lengths, lsize = _varint_bytes(sizes[kept].astype(np.uint64))
    lends = np.append(0, np.cumsum(lsize))
    lcut = lends[np.searchsorted(f.owner[kept], np.arange(f.n + 1))]
    lengths = lengths.tobytes()
    out: list[bytes | None] = []
    for i in range(f.n):
        if not f.kinds[i]:
            out.append(None)
            continue
        a, b = lengths[lcut[i] : lcut[i + 1]], body[cut[i] : cut[i + 1]]
        out.append((b"\x12" + _small_varint(len(a)) + a if a else b"") + (b"\x1a" + _small_varint(len(b)) + b if b else b""))
    return out


def wkb_level(f: Flat, resolution: float, family: str) -> list[bytes | None]:
    """The level's world coordinates as WKB, for lines and polygons of one part."""
    g, _, sizes = snapped(f, resolution, family)
    body, ends = (g * resolution).astype("<f8").tobytes(), np.append(0, np.cumsum(sizes)) * 16
    heads = {2: b"\1\2\0\0\0", 3: b"\1\3\0\0\0\1\0\0\0"}
    out: list[bytes | None] = [None] * f.n
    for k, (i, n) in enumerate(zip(f.owner.tolist(), sizes.tolist())):
        out[i] = heads[f.kinds[i]] + n.to_bytes(4, "little") + body[ends[k] : ends[k + 1]]
    return out


def native_level(f: Flat, resolution: float, family: str) -> pa.Array:
    """The level's world coordinates as lists of parts of vertices."""
    g, _, sizes = snapped(f, resolution, family)
    xy, kept = g * resolution, sizes > 0
    vertices = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, i])) for i in (0, 1)], ["x", "y"])
    parts = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes[kept])), pa.int32()), vertices)
    offsets = np.searchsorted(f.owner[kept], np.arange(f.n + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts, mask=pa.array(f.kinds == 0))


def flat_of(rows: list[bytes | None], family: str) -> Flat:
    f = decode(rows)
    if f.families - {family}:
        raise ValueError(f"expected {family} geometry, found {', '.join(sorted(f.families))}")
    return f


def pbf_levels(rows: list[bytes | None], family: str, stored: list[Level]) -> dict[str, list[bytes | None]]:
    f = flat_of(rows, family)
    if family == "polygon":
        f = turned(f)
    return {x.column: pbf_level(f, x.resolution, family) for x in stored}


def inspect(s: Simple) -> dict[str, np.ndarray]:
    """What a validator asks of each of some simple geometries: bounds of the finite vertices (NaN where there are none), mixed, and of polygons closed, area and degenerate."""
    xy, ends = s.coords[:, :2], np.cumsum(s.sizes)
    starts = ends - s.sizes
    finite = np.isfinite(xy).all(axis=1)
    n = np.add.reduceat(finite.astype(np.int64), starts)
    out = {"mixed": (n > 0) & (n < s.sizes), "some": n > 0}
    out["low"] = np.minimum.reduceat(np.where(finite[:, None], xy, np.inf), starts)
    out["high"] = np.maximum.reduceat(np.where(finite[:, None], xy, -np.inf), starts)
    if s.kind == 3:
        with np.errstate(invalid="ignore"):
            rel = xy - np.repeat(xy[starts], s.sizes, axis=0)
            after = np.roll(rel, -1, axis=0)
            after[ends - 1] = 0.0
            out["area"] = np.add.reduceat(rel[:, 0] * after[:, 1] - after[:, 0] * rel[:, 1], starts) / 2
            out["area"][s.sizes < 3] = 0.0
            out["degenerate"] = (s.sizes < 4) | (np.abs(out["area"]) <= np.finfo(float).eps)
        out["closed"] = (xy[starts] == xy[ends - 1]).all(axis=1)
    return out


@dataclass
class Payloads:
    """Decoded XY payloads: grid coordinates of all vertices, the vertices of each part, the parts of each payload."""

    grid: np.ndarray
    sizes: np.ndarray
    parts: np.ndarray


def _prefix(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at += 1
        if b < 128:
            return value, at
        shift += 7


def _numbers(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
    """Varints of all bodies, and how many each has; None where one isn't whole or is of more than nine bytes."""
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    cut = np.cumsum([0, *map(len, bodies)])
    last = raw < 128
    full = cut[1:] > cut[:-1]
    if not len(raw) or not last[cut[1:][full] - 1].all():
        return None
    end = np.flatnonzero(last)
    begin = np.append(0, end[:-1] + 1)
    size = end - begin + 1
    if size.max() > 9:
        return None
    place = np.arange(len(raw)) - np.repeat(begin, size)
    values = np.add.reduceat((raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64), begin)
    return values, np.diff(np.append(0, np.cumsum(last))[cut])


def pbf_decode(rows: list[bytes]) -> Payloads | None:
    """Payloads as the engine writes them (lengths, then coordinates, nothing else), all at once; None where one is of another make, which is read by itself."""
    lengths, coords = [], []
    try:
        for r in rows:
            if r[0] != 0x12:
                return None
            n, at = _prefix(r, 1)
            lengths.append(r[at : at + n])
            if r[at + n] != 0x1A:
                return None
            m, k = _prefix(r, at + n + 1)
            coords.append(r[k:])
            if len(r) - k != m:
                return None
    except IndexError:
        return None
    a, b = _numbers(lengths), _numbers(coords)
    if a is None or b is None:
        return None
    sizes, parts = a[0].astype(np.int64), a[1]
    first = np.append(0, np.cumsum(parts))
    vertices = np.diff(np.append(0, np.cumsum(sizes))[first])
    if (b[1] != 2 * vertices).any() or (sizes <= 0).any():
        return None
    v = b[0]
    steps = ((v >> np.uint64(1)) ^ (np.uint64(0) - (v & np.uint64(1)))).view(np.int64).reshape(-1, 2)
    total = np.cumsum(steps, axis=0)
    starts = np.cumsum(sizes) - sizes
    return Payloads(total - np.repeat((total - steps)[starts], sizes, axis=0), sizes, parts)


def _areas(xy: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Signed areas of parts, taken about their first vertices."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    rel = xy - np.repeat(xy[starts], sizes, axis=0)
    after = np.roll(rel, -1, axis=0)
    after[ends - 1] = 0
    return np.add.reduceat(rel[:, 0] * after[:, 1] - after[:, 0] * rel[:, 1], starts) / 2


def shown_rings(q: Payloads, resolution: float) -> tuple[list[bytes | None], np.ndarray] | None:
    """WKB and bounds of payloads of one closed ring each, turned to the usual order; None for a ring that can't be drawn. None for all where a payload has more parts or an open ring."""
    ends = np.cumsum(q.sizes)
    starts = ends - q.sizes
    if (q.parts != 1).any() or (q.grid[starts] != q.grid[ends - 1]).any():
        return None
    xy = q.grid * resolution + 0.0
    drawn = (q.sizes >= 4) & (_areas(xy, q.sizes) < 0)
    at = np.arange(len(xy)) - np.repeat(starts, q.sizes)
    body, cut = xy[np.repeat(ends, q.sizes) - 1 - at].astype("<f8").tobytes(), np.append(0, ends) * 16
    out = [b"\1\3\0\0\0\1\0\0\0" + n.to_bytes(4, "little") + body[cut[i] : cut[i + 1]] if d else None for i, (n, d) in enumerate(zip(q.sizes.tolist(), drawn.tolist()))]
    return out, np.concatenate([np.minimum.reduceat(xy, starts), np.maximum.reduceat(xy, starts)], axis=1)


def payload_faults(s: Simple, q: Payloads, resolution: float, family: str) -> np.ndarray:
    """For each geometry and its payload: 0 good, 1 a vertex that the geometry hasn't on the grid, 3 a first ring that turns counter-clockwise or another that doesn't."""
    own = np.repeat(np.arange(len(s.sizes)), s.sizes)
    part_of = np.repeat(np.arange(len(q.parts)), q.parts)
    theirs = np.repeat(part_of, q.sizes)
    grid = np.column_stack([to_grid(s.coords[:, 0], resolution, 0.0), to_grid(s.coords[:, 1], resolution, 0.0)])
    who, x, y = np.append(own, theirs), np.append(grid[:, 0], q.grid[:, 0]), np.append(grid[:, 1], q.grid[:, 1])
    late = np.append(np.zeros(len(own), bool), np.ones(len(theirs), bool))
    order = np.lexsort((late, y, x, who))
    who, x, y, late = who[order], x[order], y[order], late[order]
    fresh = np.append(True, (who[1:] != who[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
    alone = late[fresh][np.cumsum(fresh) - 1]  # a vertex of a payload only
    out = np.zeros(len(s.sizes), np.int64)
    if family == "polygon" and s.kind == 3:
        least = np.minimum.reduceat(q.sizes, np.cumsum(q.parts) - q.parts)
        area = _areas(q.grid.astype(float), q.sizes)
        outer = np.append(True, part_of[1:] != part_of[:-1])
        wrong = (area != 0) & ((area > 0) == outer)
        out[part_of[wrong & (least >= 3)[part_of]]] = 3
    out[who[alone]] = 1
    return out
