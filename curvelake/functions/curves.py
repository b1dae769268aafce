"""Space-filling curves: keys of points and boxes, and the ranges of keys that a viewport needs."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from .lod import levels

MERCATOR_EDGE = 20037508.342789244
EPSILON = 2.220446049250313e-16


@dataclass(frozen=True)
class Extent:
    xmin: float
    ymin: float
    xmax: float
    ymax: float

    @property
    def width(self) -> float:
        return self.xmax - self.xmin

    @property
    def height(self) -> float:
        return self.ymax - self.ymin

    def valid(self) -> bool:
        return all(map(math.isfinite, (self.xmin, self.ymin, self.xmax, self.ymax))) and self.width > 0 and self.height > 0

    def as_list(self) -> list[float]:
        return [self.xmin, self.ymin, self.xmax, self.ymax]


WORLD = {4326: Extent(-180.0, -90.0, 180.0, 90.0), 3857: Extent(-MERCATOR_EDGE, -MERCATOR_EDGE, MERCATOR_EDGE, MERCATOR_EDGE)}


def elements(g: int, depth: int) -> int:
    """Cells in a subtree whose root is at depth + 1, down to level g."""
    return (4 ** (g - depth) - 1) // 3


# Points


def z_cells(v: np.ndarray, lo: float, hi: float, depth: int) -> np.ndarray:
    v = np.asarray(v, float)
    if depth == 0 or abs(hi - lo) < EPSILON:
        return np.zeros(len(v), np.uint64)
    with np.errstate(invalid="ignore"):
        cell = np.trunc((v - lo) / (hi - lo) * 2.0**depth)
    return np.clip(np.where(np.isnan(cell), 0, cell), 0, 2.0**depth - 1).astype(np.uint64)


def interleave(x: np.ndarray, y: np.ndarray, depth: int) -> np.ndarray:
    """x in the even bits, y in the odd ones."""
    out = np.zeros(len(x), np.uint64)
    for i in range(depth):
        b = np.uint64(i)
        out |= ((x >> b) & np.uint64(1)) << np.uint64(2 * i) | ((y >> b) & np.uint64(1)) << np.uint64(2 * i + 1)
    return out


def z_codes(x, y, extent: Extent, depth: int) -> np.ndarray:
    return interleave(z_cells(x, extent.xmin, extent.xmax, depth), z_cells(y, extent.ymin, extent.ymax, depth), depth)


# Boxes


def xz_levels(xmin, ymin, xmax, ymax, extent: Extent, g: int) -> np.ndarray:
    """The level of each box's cell: so fine that the cell and its upper and right neighbours cover it."""
    w, h = xmax - xmin, ymax - ymin
    with np.errstate(divide="ignore", invalid="ignore"):
        fit = np.floor(np.minimum(np.log2(extent.width / w), np.log2(extent.height / h)))
        level = np.minimum(np.where(np.isnan(fit), 0, np.maximum(fit, 0)) + 1, g)
        level = np.where((w > 0) & (h > 0), level, 0).astype(np.int64)
        cw, ch = extent.width / 2.0**level, extent.height / 2.0**level
        nx = np.floor((xmax - extent.xmin) / cw) - np.floor((xmin - extent.xmin) / cw)
        ny = np.floor((ymax - extent.ymin) / ch) - np.floor((ymin - extent.ymin) / ch)
    return np.where((nx > 1) | (ny > 1), np.maximum(level - 1, 0), level)


def xz_codes(xmin, ymin, xmax, ymax, extent: Extent, g: int) -> np.ndarray:
    """Sequence codes. Every box is bisected at once; one that has reached its level rests."""
    xmin, ymin, xmax, ymax = (np.asarray(v, float) for v in (xmin, ymin, xmax, ymax))
    level = xz_levels(xmin, ymin, xmax, ymax, extent, g)
    n = len(xmin)
    lox, hix, loy, hiy = (np.full(n, v) for v in (extent.xmin, extent.xmax, extent.ymin, extent.ymax))
    code = np.zeros(n, np.int64)
    for d in range(int(level.max(initial=0))):
        on = level > d
        cx, cy = (lox + hix) / 2, (loy + hiy) / 2
        right, up = xmin >= cx, ymin >= cy
        lox, hix = np.where(right, cx, lox), np.where(right, hix, cx)
        loy, hiy = np.where(up, cy, loy), np.where(up, hiy, cy)
        code += np.where(on, (right + 2 * up.astype(np.int64)) * elements(g, d) + 1, 0)
    return code


# Ranges


def merge_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, with those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and out[-1][1] + 1 >= s:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def in_ranges(code: int, ranges: list[tuple[int, int]]) -> bool:
    import bisect

    i = bisect.bisect_right(ranges, (code, float("inf"))) - 1
    return i >= 0 and ranges[i][0] <= code <= ranges[i][1]


def overlaps(a: Extent, b: Extent) -> bool:
    """With positive area."""
    return a.xmax > b.xmin and a.xmin < b.xmax and a.ymax > b.ymin and a.ymin < b.ymax


def query_level(full: Extent, query: Extent, g: int) -> int:
    return min(math.floor(min(math.log2(full.width / query.width), math.log2(full.height / query.height))) + 1, g)


def xz_ranges(full: Extent, query: Extent, g: int, finer: int = 4) -> list[tuple[int, int]]:
    """Inclusive ranges of the codes of boxes that may overlap the query."""
    deepest = min(query_level(full, query, g) + finer, g)
    found: list[tuple[int, int]] = []

    def visit(cell: Extent, code: int, depth: int) -> None:
        reach = Extent(cell.xmin, cell.ymin, cell.xmax + cell.width, cell.ymax + cell.height)
        if not overlaps(reach, query):
            return
        covered = query.xmin <= reach.xmin and query.ymin <= reach.ymin and query.xmax >= reach.xmax and query.ymax >= reach.ymax
        if covered or depth == deepest:
            found.append((code, code + sum(3 * elements(g, d) + 1 for d in range(depth, g))))
            return
        found.append((code, code))
        mx, my = (cell.xmin + cell.xmax) / 2, (cell.ymin + cell.ymax) / 2
        for q in range(4):
            x = (mx, cell.xmax) if q & 1 else (cell.xmin, mx)
            y = (my, cell.ymax) if q & 2 else (cell.ymin, my)
            visit(Extent(x[0], y[0], x[1], y[1]), code + q * elements(g, depth) + 1, depth + 1)

    visit(full, 0, 0)
    return merge_ranges(found)


def z_ranges(full: Extent, query: Extent, depth: int, most: int = 64) -> list[tuple[int, int]]:
    """Inclusive ranges of the codes of points that may lie in the query (edges included). Cells are split level by level while there are at most `most` of them."""
    lo = [int(z_cells(np.array([v]), a, b, depth)[0]) for v, a, b in ((query.xmin, full.xmin, full.xmax), (query.ymin, full.ymin, full.ymax))]
    hi = [int(z_cells(np.array([v]), a, b, depth)[0]) for v, a, b in ((query.xmax, full.xmin, full.xmax), (query.ymax, full.ymin, full.ymax))]
    if query.xmin > query.xmax or query.ymin > query.ymax:
        return []
    done: list[tuple[int, int]] = []
    cells, level = [(0, 0)], 0
    while cells:
        size = 1 << (depth - level)
        code = lambda x, y: int(interleave(np.array([x], np.uint64), np.array([y], np.uint64), depth)[0])
        split = []
        for x, y in cells:
            if x > hi[0] or y > hi[1] or x + size - 1 < lo[0] or y + size - 1 < lo[1]:
                continue
            inside = lo[0] <= x and x + size - 1 <= hi[0] and lo[1] <= y and y + size - 1 <= hi[1]
            if inside or size == 1:
                done.append((code(x, y), code(x, y) + size * size - 1))
            else:
                split.append((x, y))
        if 4 * len(split) + len(done) > most:
            done += [(code(x, y), code(x, y) + size * size - 1) for x, y in split]
            break
        half, level = size >> 1, level + 1
        cells = [(x + i * half, y + j * half) for x, y in split for i in (0, 1) for j in (0, 1)]
    return merge_ranges(done)


# Viewports


def normal_longitude(v: float) -> float:
    """In [-180, 180)."""
    return (v + 180) % 360 - 180


def viewport_extents(west: float, south: float, east: float, north: float, full: Extent) -> list[Extent]:
    """A viewport clipped to the data's extent: two where it crosses the antimeridian, one where it spans the world, none where nothing is left."""
    south, north = max(south, full.ymin), min(north, full.ymax)
    if south >= north:
        return []
    span = min(abs(east - west), 360.0)
    if span >= 360:
        return [Extent(full.xmin, south, full.xmax, north)]
    w = normal_longitude(west)
    sides = [(w, w + span)] if w + span <= 180 else [(w, 180.0), (-180.0, w + span - 360)]
    clipped = [(max(a, full.xmin), min(b, full.xmax)) for a, b in sides]
    return [Extent(a, south, b, north) for a, b in clipped if a < b]


def zoom_resolution(zoom: float) -> float:
    return 360 / (512 * 2**zoom)


def level_for(resolution: float, wkid: int = 4326):
    """The first stored level, coarse to fine, that is fine enough; else the finest."""
    stored = levels(wkid)
    return next((x for x in stored if x.resolution <= resolution * 2**0.001), stored[-1])


