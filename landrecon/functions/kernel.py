"""Array geometry for Arrow functions: what has no closed column form.

Each function sees one Arrow batch, turns the nested point lists into flat coordinate arrays and
works on whole groups of same-sized shapes at a time. Overlap is measured, never constructed: a
plane sweep cuts both shapes at every vertex and crossing height, and between two cuts every edge
is straight, so the width at mid height times the slab height is exact. Inside and outside follow
the even-odd rule, which covers holes, several parts and self-crossing rings alike.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landrecon.functions import geo

PARTS_TYPE = T.ArrayType(T.ArrayType(T.ArrayType(
    T.StructType().add("x", T.DoubleType()).add("y", T.DoubleType()))))
_BLOCK = 2_000_000  # array cells worked on at a time


# --- Arrow batches to flat arrays ---------------------------------------------------------

def _counts(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def _chunked(column: pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


class Shapes:
    """Coordinates of a column of ``parts``: point arrays plus the row and ring of each point."""

    def __init__(self, parts: pa.Array):
        parts = _chunked(parts)
        self.rows = len(parts)
        polys = parts.flatten()
        rings = polys.flatten()
        pts = rings.flatten()
        row_of_poly = np.repeat(np.arange(self.rows), _counts(parts))
        row_of_ring = np.repeat(row_of_poly, _counts(polys))
        per_ring = _counts(rings)
        self.ring = np.repeat(np.arange(len(rings)), per_ring)
        self.row = row_of_ring[self.ring] if len(self.ring) else np.zeros(0, dtype=int)
        self.x = pc.struct_field(pts, 0).to_numpy(zero_copy_only=False).astype(float)
        self.y = pc.struct_field(pts, 1).to_numpy(zero_copy_only=False).astype(float)

    def project(self, epsg: np.ndarray) -> None:
        """Move to UTM metres of the zone given per row; rows without a zone stay as they are."""
        code = epsg[self.row]
        ok = np.isfinite(code)
        if ok.any():
            lon0 = (code[ok] % 100) * 6.0 - 183.0
            self.x[ok], self.y[ok] = utm_forward(self.x[ok], self.y[ok], lon0)

    def flat_metres(self, lat: np.ndarray, metres_per_degree: float) -> None:
        self.x = self.x * metres_per_degree * np.cos(np.radians(lat[self.row]))
        self.y = self.y * metres_per_degree

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """``(row, [x1, y1, x2, y2])`` of every segment, rows in order."""
        if len(self.x) < 2:
            return np.zeros(0, dtype=int), np.zeros((0, 4))
        same = self.ring[1:] == self.ring[:-1]
        e = np.stack([self.x[:-1], self.y[:-1], self.x[1:], self.y[1:]], axis=1)[same]
        return self.row[:-1][same], e


def utm_forward(lon: np.ndarray, lat: np.ndarray, lon0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.sin(np.radians(lat))
    t = np.sinh(np.arctanh(s) - geo.CONFORMAL * np.arctanh(geo.CONFORMAL * s))
    d = np.radians(lon - lon0)
    xi, eta = np.arctan2(t, np.cos(d)), np.arctanh(np.sin(d) / np.sqrt(1 + t * t))
    e, n = eta.copy(), xi.copy()
    for j, a in enumerate(geo.ALPHA, 1):
        e += a * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        n += a * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
    k = geo.UTM_SCALE * geo.UTM_RADIUS
    return geo.UTM_EASTING + k * e, k * n


def _padded(row: np.ndarray, edges: np.ndarray, wanted: np.ndarray, width: int) -> np.ndarray:
    """Edges of the wanted rows as ``[len(wanted), width, 4]``, missing ones NaN."""
    out = np.full((len(wanted), width, 4), np.nan)
    start = np.searchsorted(row, wanted, "left")
    stop = np.searchsorted(row, wanted, "right")
    for k in range(int((stop - start).max(initial=0))):
        has = start + k < stop
        out[has, k] = edges[start[has] + k]
    return out


def _groups(na: np.ndarray, nb: np.ndarray):
    """Row groups whose edge counts round up to the same sizes."""
    def up(n: np.ndarray) -> np.ndarray:
        return np.where(n <= 4, 4, 2 ** np.ceil(np.log2(np.maximum(n, 1))).astype(int))

    keys = np.stack([up(na), up(nb)], axis=1)
    for key in np.unique(keys, axis=0):
        yield np.flatnonzero((keys == key).all(axis=1)), int(key[0]), int(key[1])


# --- sweep --------------------------------------------------------------------------------

def _crossing_heights(e: np.ndarray) -> np.ndarray:
    """Heights where two edges of the same row cross properly, NaN elsewhere."""
    n = e.shape[1]
    i, j = np.triu_indices(n, 1)
    p, q = e[:, i], e[:, j]
    rx, ry = p[..., 2] - p[..., 0], p[..., 3] - p[..., 1]
    sx, sy = q[..., 2] - q[..., 0], q[..., 3] - q[..., 1]
    den = rx * sy - ry * sx
    with np.errstate(divide="ignore", invalid="ignore"):
        dx, dy = q[..., 0] - p[..., 0], q[..., 1] - p[..., 1]
        t = (dx * sy - dy * sx) / den
        u = (dx * ry - dy * rx) / den
        hit = (den != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        return np.where(hit, p[..., 1] + t * ry, np.nan)


def _sweep(ea: np.ndarray, eb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Even-odd areas of A, B and both for padded edge arrays ``[P, n, 4]`` and ``[P, m, 4]``."""
    e = np.concatenate([ea, eb], axis=1)
    p, n = len(e), ea.shape[1]
    width = e.shape[1]
    heights = [e[..., 1], e[..., 3]]
    pairs = width * (width - 1) // 2
    if p * pairs <= 8 * _BLOCK:
        heights.append(_crossing_heights(e))
    else:
        heights.append(_crossing_heights_blocked(e))
    ys = np.sort(np.concatenate(heights, axis=1), axis=1)
    used = int(np.isfinite(ys).sum(axis=1).max(initial=0))
    ys = ys[:, :max(used, 2)]
    low, high = np.minimum(e[..., 1], e[..., 3]), np.maximum(e[..., 1], e[..., 3])
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = (e[..., 2] - e[..., 0]) / (e[..., 3] - e[..., 1])
    total = np.zeros((3, p))
    step = max(1, _BLOCK // max(1, p * width))
    for s in range(0, ys.shape[1] - 1, step):
        lower, upper = ys[:, s:s + step], ys[:, s + 1:s + 1 + step]
        lower = lower[:, :upper.shape[1]]
        h = np.nan_to_num(upper - lower)
        mid = ((upper + lower) / 2)[..., None]
        with np.errstate(invalid="ignore"):
            spans = (low[:, None] <= mid) & (mid < high[:, None])
            x = np.where(spans, e[:, None, :, 0] + (mid - e[:, None, :, 1]) * slope[:, None], np.inf)
        order = np.argsort(x, axis=2)
        x = np.take_along_axis(x, order, axis=2)
        live = np.isfinite(x)
        in_a = np.cumsum((order < n) & live, axis=2) % 2
        in_b = np.cumsum((order >= n) & live, axis=2) % 2
        with np.errstate(invalid="ignore"):
            dx = np.where(live[..., 1:], x[..., 1:] - np.where(live, x, 0)[..., :-1], 0.0)
        for k, inside in enumerate((in_a, in_b, in_a & in_b)):
            total[k] += ((dx * inside[..., :-1]).sum(axis=2) * h).sum(axis=1)
    return total[0], total[1], total[2]


def _crossing_heights_blocked(e: np.ndarray) -> np.ndarray:
    """As above for long outlines, one edge against all later ones at a time."""
    found = [[] for _ in range(len(e))]
    for i in range(e.shape[1] - 1):
        p, q = e[:, i:i + 1], e[:, i + 1:]
        rx, ry = p[..., 2] - p[..., 0], p[..., 3] - p[..., 1]
        sx, sy = q[..., 2] - q[..., 0], q[..., 3] - q[..., 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            den = rx * sy - ry * sx
            dx, dy = q[..., 0] - p[..., 0], q[..., 1] - p[..., 1]
            t, u = (dx * sy - dy * sx) / den, (dx * ry - dy * rx) / den
            hit = (den != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        for r, c in zip(*np.nonzero(hit)):
            found[r].append(p[r, 0, 1] + t[r, c] * ry[r, 0])
    out = np.full((len(e), max(1, max(map(len, found)))), np.nan)
    for r, values in enumerate(found):
        out[r, :len(values)] = values
    return out


def overlap_areas(a: Shapes, b: Shapes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Areas of each row's A, B and their overlap."""
    ra, ea = a.edges()
    rb, eb = b.edges()
    na, nb = np.bincount(ra, minlength=a.rows), np.bincount(rb, minlength=b.rows)
    out = np.zeros((3, a.rows))
    for rows, wa, wb in _groups(na, nb):
        live = rows[(na[rows] > 0) & (nb[rows] > 0)]
        step = max(1, _BLOCK // ((wa + wb) ** 2))
        for s in range(0, len(live), step):
            part = live[s:s + step]
            pa_, pb_ = _padded(ra, ea, part, wa), _padded(rb, eb, part, wb)
            shift = np.tile(pa_[:, 0, :2], 2)[:, None, :]
            out[:, part] = _sweep(pa_ - shift, pb_ - shift)
    return out[0], out[1], out[2]


# --- distances ----------------------------------------------------------------------------

def _point_segment(px, py, e):
    """Distance of points ``[..., k, 1]`` to segments ``[..., 1, m, 4]``."""
    dx, dy = e[..., 2] - e[..., 0], e[..., 3] - e[..., 1]
    length = dx * dx + dy * dy
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(length > 0, ((px - e[..., 0]) * dx + (py - e[..., 1]) * dy) / length, 0.0)
    t = np.clip(t, 0, 1)
    return np.hypot(px - (e[..., 0] + t * dx), py - (e[..., 1] + t * dy))


def _inside(px, py, e):
    """Even-odd containment of points ``[..., k, 1]`` in the shape of segments ``[..., 1, m, 4]``."""
    with np.errstate(divide="ignore", invalid="ignore"):
        spans = (np.minimum(e[..., 1], e[..., 3]) <= py) & (py < np.maximum(e[..., 1], e[..., 3]))
        x = e[..., 0] + (py - e[..., 1]) * (e[..., 2] - e[..., 0]) / (e[..., 3] - e[..., 1])
        return ((spans & (px < x)).sum(axis=-1) % 2).astype(bool)


def _side(o, x, y):
    """On which side of the line of segment ``o`` a point lies; 0 on it."""
    return np.sign((o[..., 2] - o[..., 0]) * (y - o[..., 1]) - (o[..., 3] - o[..., 1]) * (x - o[..., 0]))


def _cross(e, f):
    """Whether segments ``[..., n, 1, 4]`` and ``[..., 1, m, 4]`` cross, each with its ends on both sides of the other."""
    a, b = _side(e, f[..., 0], f[..., 1]), _side(e, f[..., 2], f[..., 3])
    c, d = _side(f, e[..., 0], e[..., 1]), _side(f, e[..., 2], e[..., 3])
    return (a * b < 0) & (c * d < 0)


def _reach(e, f) -> tuple:
    """Ends of segments ``f`` along the longer axis of segments ``e``, and the range of ``e`` there."""
    tall = np.abs(e[..., 3] - e[..., 1]) > np.abs(e[..., 2] - e[..., 0])
    f0, f1 = np.where(tall, f[..., 1], f[..., 0]), np.where(tall, f[..., 3], f[..., 2])
    e0, e1 = np.where(tall, e[..., 1], e[..., 0]), np.where(tall, e[..., 3], e[..., 2])
    return f0, f1, np.minimum(e0, e1), np.maximum(e0, e1)


def _with_points(shapes: Shapes) -> tuple[np.ndarray, np.ndarray]:
    """Edges, plus a zero-length one for every row that has points but no segment."""
    row, edges = shapes.edges()
    ring_size = np.bincount(shapes.ring) if len(shapes.ring) else np.zeros(0, dtype=int)
    lone = ring_size[shapes.ring] == 1 if len(shapes.ring) else np.zeros(0, dtype=bool)
    dots = np.stack([shapes.x, shapes.y, shapes.x, shapes.y], axis=1)[lone]
    row = np.concatenate([row, shapes.row[lone]])
    edges = np.concatenate([edges, dots])
    order = np.argsort(row, kind="stable")
    return row[order], edges[order]


def shape_distance(other: Shapes, polygon: Shapes) -> np.ndarray:
    """Distance of points or lines to a polygon, 0 inside, NaN where a side is missing."""
    ra, ea = _with_points(other)
    rb, eb = polygon.edges()
    na, nb = np.bincount(ra, minlength=other.rows), np.bincount(rb, minlength=polygon.rows)
    out = np.full(other.rows, np.nan)
    for rows, wa, wb in _groups(na, nb):
        live = rows[(na[rows] > 0) & (nb[rows] > 0)]
        step = max(1, _BLOCK // (wa * wb))
        for s in range(0, len(live), step):
            part = live[s:s + step]
            e, f = _padded(ra, ea, part, wa), _padded(rb, eb, part, wb)
            shift = np.tile(f[:, 0, :2], 2)[:, None, :]
            e, f = e - shift, f - shift
            e4, f4 = e[:, :, None], f[:, None, :]
            inside = np.zeros(len(part), dtype=bool)
            best = np.full(len(part), np.inf)
            for k in (0, 2):
                d = _point_segment(e4[..., k], e4[..., k + 1], f4)
                best = np.fmin(best, np.nanmin(d.reshape(len(part), -1), axis=1))
                d = _point_segment(f4[..., k], f4[..., k + 1], e4)
                best = np.fmin(best, np.nanmin(d.reshape(len(part), -1), axis=1))
                inside |= _inside(e4[..., k], e4[..., k + 1], f4).any(axis=1)
            inside |= _cross(e4, f4).any(axis=(1, 2))
            out[part] = np.where(inside, 0.0, best)
    return out


def line_relation(line: Shapes, polygon: Shapes) -> np.ndarray:
    """Per row: 0 apart, 1 touching or crossing the outline, 2 wholly inside it."""
    d = shape_distance(line, polygon)
    ra, ea = _with_points(line)
    rb, eb = polygon.edges()
    na, nb = np.bincount(ra, minlength=line.rows), np.bincount(rb, minlength=polygon.rows)
    out = np.where(d == 0, 1, 0)
    for rows, wa, wb in _groups(na, nb):
        live = rows[(na[rows] > 0) & (nb[rows] > 0)]
        step = max(1, _BLOCK // (wa * wb))
        for s in range(0, len(live), step):
            part = live[s:s + step]
            e, f = _padded(ra, ea, part, wa), _padded(rb, eb, part, wb)
            e4, f4 = e[:, :, None], f[:, None, :]
            real = np.isfinite(e[..., 0])
            ends, deep = np.ones(len(part), dtype=bool), np.zeros(len(part), dtype=bool)
            for fx, fy in ((e4[..., 0], e4[..., 1]), (e4[..., 2], e4[..., 3]),
                           ((e4[..., 0] + e4[..., 2]) / 2, (e4[..., 1] + e4[..., 3]) / 2)):
                gap = np.where(np.isfinite(fx) & np.isfinite(f4[..., 0]), _point_segment(fx, fy, f4), np.inf)
                on_edge = gap.min(axis=2) == 0
                inside = _inside(fx, fy, f4)
                ends &= (inside | on_edge | ~real).all(axis=1)
                deep |= (inside & ~on_edge & real).any(axis=1)
            whole = ends & deep & ~_cross(e4, f4).any(axis=(1, 2))
            out[part] = np.where(whole & (out[part] == 1), 2, out[part])
    return out


# --- validity -----------------------------------------------------------------------------

def _self_crosses(edges: np.ndarray, ring: np.ndarray) -> bool:
    """Whether two edges cross or run along each other, or a vertex lies inside an edge of its own ring."""
    n = len(edges)
    block = max(1, _BLOCK // max(1, n))
    for s in range(0, n, block):
        e, f = edges[s:s + block, None], edges[None]
        later = np.arange(n)[None] > np.arange(s, min(s + block, n))[:, None]
        f0, f1, low, high = _reach(e, f)
        starts_on, ends_on = _side(e, f[..., 0], f[..., 1]) == 0, _side(e, f[..., 2], f[..., 3]) == 0
        along = starts_on & ends_on & (np.maximum(low, np.minimum(f0, f1)) < np.minimum(high, np.maximum(f0, f1)))
        touches = starts_on & (low < f0) & (f0 < high) & (ring[s:s + block, None] == ring[None])
        if (((_cross(e, f) | along) & later) | touches).any():
            return True
    return False


def _spikes(x: np.ndarray, y: np.ndarray) -> bool:
    """A ring that touches itself at a repeated vertex with crossing sides, or folds back."""
    dx, dy = np.diff(x), np.diff(y)
    nx, ny = np.roll(dx, -1), np.roll(dy, -1)
    return bool(((dx * ny - dy * nx == 0) & (dx * nx + dy * ny < 0)).any())


def validity(parts: pa.Array) -> list[str]:
    """``ok``, ``self_intersection`` or ``invalid_geometry`` per polygon row."""
    shapes = Shapes(parts)
    kinds = []
    order = np.searchsorted(shapes.row, np.arange(shapes.rows + 1))
    nested = _chunked(parts)
    for r in range(shapes.rows):
        sel = slice(order[r], order[r + 1])
        x, y, ring = shapes.x[sel], shapes.y[sel], shapes.ring[sel]
        if not len(x):
            kinds.append("ok")
            continue
        kinds.append(_row_validity(x, y, ring, [len(p) for p in nested[r].as_py()]))
    return kinds


def _row_validity(x, y, ring, rings_per_poly) -> str:
    if not (np.isfinite(x).all() and np.isfinite(y).all()):
        return "invalid_geometry"
    ids = np.unique(ring)
    pieces = [(x[ring == i], y[ring == i]) for i in ids]
    edges = []
    for px, py in pieces:
        keep = np.concatenate([[True], (np.diff(px) != 0) | (np.diff(py) != 0)])
        px, py = px[keep], py[keep]
        if len(px) < 4 or px[0] != px[-1] or py[0] != py[-1]:
            return "invalid_geometry"
        if _spikes(px, py) or len({*zip(px[:-1], py[:-1])}) < len(px) - 1:
            return "self_intersection"
        edges.append(np.stack([px[:-1], py[:-1], px[1:], py[1:]], axis=1))
    if _self_crosses(np.concatenate(edges), np.repeat(np.arange(len(edges)), [len(e) for e in edges])):
        return "self_intersection"
    first = 0
    shells = []
    for count in rings_per_poly:
        for hole in range(first + 1, first + count):
            hx, hy = pieces[hole][0][:-1], pieces[hole][1][:-1]
            shell = edges[first]
            inside = _inside(hx[:, None], hy[:, None], shell[None])
            near = _point_segment(hx[:, None], hy[:, None], shell[None]).min(axis=1) == 0
            if not (inside | near).all():
                return "invalid_geometry"
        shells.append(first)
        first += count
    for i in shells:
        for j in shells:
            if i == j:
                continue
            px, py = pieces[j][0][:-1], pieces[j][1][:-1]
            on_edge = _point_segment(px[:, None], py[:, None], edges[i][None]).min(axis=1) == 0
            holes = [edges[k] for k in range(i, i + rings_per_poly[shells.index(i)])]
            if (_inside(px[:, None], py[:, None], np.concatenate(holes)[None]) & ~on_edge).any():
                return "invalid_geometry"
    return "ok"


def repaired(x: np.ndarray, y: np.ndarray, ring: np.ndarray, rings_per_poly: list[int]) -> list:
    """Even-odd area of broken rings as simple trapezoid-free faces traced from noded edges.

    A shell or a hole that repeats an earlier one counts once.
    """
    segs, seen = [], set()
    shells = {0, *np.cumsum(rings_per_poly).tolist()}
    for k, i in enumerate(np.unique(ring)):
        px, py = x[ring == i], y[ring == i]
        if px[0] != px[-1] or py[0] != py[-1]:
            px, py = np.append(px, px[0]), np.append(py, py[0])
        seg = np.stack([px[:-1], py[:-1], px[1:], py[1:]], axis=1)
        laid = k in shells, frozenset(min((a, b, c, d), (c, d, a, b)) for a, b, c, d in seg.tolist())
        if laid not in seen:
            seen.add(laid)
            segs.append(seg)
    e = np.concatenate(segs)
    e = e[(e[:, 0] != e[:, 2]) | (e[:, 1] != e[:, 3])]
    return _trace(_odd_boundary(_node(e)))


def _node(e: np.ndarray) -> list:
    """Split edges at every crossing and touching point."""
    cuts = [[(0.0, tuple(s[:2])), (1.0, tuple(s[2:]))] for s in e]
    for i in range(len(e)):
        rx, ry = e[i, 2] - e[i, 0], e[i, 3] - e[i, 1]
        q = e[i + 1:]
        sx, sy = q[:, 2] - q[:, 0], q[:, 3] - q[:, 1]
        dx, dy = q[:, 0] - e[i, 0], q[:, 1] - e[i, 1]
        den = rx * sy - ry * sx
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (dx * sy - dy * sx) / den, (dx * ry - dy * rx) / den
            hit = (den != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        for k in np.flatnonzero(hit):
            j = i + 1 + k
            at = _snapped(e[i], e[j], t[k], u[k])
            cuts[i].append((t[k], at))
            cuts[j].append((u[k], at))
        length = rx * rx + ry * ry
        for k in np.flatnonzero((den == 0) & (dx * ry - dy * rx == 0)):
            j = i + 1 + k
            for end in (tuple(e[j, :2]), tuple(e[j, 2:])):
                t_end = ((end[0] - e[i, 0]) * rx + (end[1] - e[i, 1]) * ry) / length
                if 0 < t_end < 1:
                    cuts[i].append((t_end, end))
            other = sx[k] ** 2 + sy[k] ** 2
            for end in (tuple(e[i, :2]), tuple(e[i, 2:])):
                u_end = ((end[0] - e[j, 0]) * sx[k] + (end[1] - e[j, 1]) * sy[k]) / other
                if 0 < u_end < 1:
                    cuts[j].append((u_end, end))
    pieces = []
    for c in cuts:
        pts = [p for _, p in sorted(c, key=lambda v: v[0])]
        pieces += [(a, b) for a, b in zip(pts, pts[1:]) if a != b]
    return pieces


def _snapped(a, b, t, u):
    """A crossing point, taken from an end point where it falls on one."""
    for seg, v in ((a, t), (b, u)):
        if v == 0.0:
            return tuple(seg[:2])
        if v == 1.0:
            return tuple(seg[2:])
    return (a[0] + t * (a[2] - a[0]), a[1] + t * (a[3] - a[1]))


def _odd_boundary(pieces: list) -> list:
    """Pieces laid an odd number of times, turned so that the inside is on their left."""
    seen: dict = {}
    for a, b in pieces:
        key = (a, b) if a <= b else (b, a)
        seen[key] = seen.get(key, 0) + 1
    once = [k for k, n in seen.items() if n % 2]
    if not once:
        return []
    e = np.array([[*a, *b] for a, b in once])
    out = []
    for a, b in once:
        mx, my = (a[0] + b[0]) / 2, (a[1] + b[1]) / 2
        nx, ny = -(b[1] - a[1]), b[0] - a[0]
        if abs(b[1] - a[1]) >= abs(b[0] - a[0]):
            with np.errstate(divide="ignore", invalid="ignore"):
                spans = (np.minimum(e[:, 1], e[:, 3]) <= my) & (my < np.maximum(e[:, 1], e[:, 3]))
                xs = e[:, 0] + (my - e[:, 1]) * (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
            left_is_low = nx < 0
            below = (spans & (xs < mx - 1e-12 * max(1.0, abs(mx)))).sum()
            inside_low = below % 2 == 1
        else:
            with np.errstate(divide="ignore", invalid="ignore"):
                spans = (np.minimum(e[:, 0], e[:, 2]) <= mx) & (mx < np.maximum(e[:, 0], e[:, 2]))
                ys = e[:, 1] + (mx - e[:, 0]) * (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
            left_is_low = ny < 0
            below = (spans & (ys < my - 1e-12 * max(1.0, abs(my)))).sum()
            inside_low = below % 2 == 1
        out.append((a, b) if inside_low == left_is_low else (b, a))
    return out


def _trace(directed: list) -> list:
    """Closed faces of a left-inside boundary, as ``parts`` of shells with their holes."""
    leaving: dict = {}
    for a, b in directed:
        leaving.setdefault(a, []).append(b)
    rings = []
    while leaving:
        start = min(leaving)
        path, at, came = [start], start, None
        while True:
            options = leaving[at]
            nxt = options[0] if came is None or len(options) == 1 else _sharpest_left(came, at, options)
            options.remove(nxt)
            if not options:
                del leaving[at]
            came, at = at, nxt
            path.append(at)
            if at in path[:-1]:
                k = path.index(at)
                rings.append(path[k:])
                path = path[:k + 1]
                came = path[-2] if len(path) > 1 else None
            if len(path) == 1 and (at == start):
                break
            if at not in leaving:
                break
    shells, holes = [], []
    for r in rings:
        a = np.array(r)
        twice = (a[:-1, 0] * a[1:, 1] - a[1:, 0] * a[:-1, 1]).sum()
        (shells if twice > 0 else holes).append((abs(twice), r))
    shells.sort()
    parts = [[r] for _, r in shells]
    for _, h in holes:
        hx, hy = np.mean([p[0] for p in h[:2]]), np.mean([p[1] for p in h[:2]])
        for k, (_, r) in enumerate(shells):
            a = np.array(r)
            e = np.concatenate([a[:-1], a[1:]], axis=1)[None]
            if _inside(np.array([[hx]]), np.array([[hy]]), e)[0]:
                parts[k].append(h)
                break
    return parts


def _sharpest_left(came, at, options):
    back = np.arctan2(came[1] - at[1], came[0] - at[0])

    def turn(p):
        out = np.arctan2(p[1] - at[1], p[0] - at[0])
        return (back - out) % (2 * np.pi) or 2 * np.pi

    return min(options, key=turn)


# --- Arrow functions ----------------------------------------------------------------------

def _floats(values: np.ndarray) -> pa.Array:
    return pa.array(values, type=pa.float64(), from_pandas=True)


@F.arrow_udf(T.DoubleType())
def _iou_udf(a: pa.Array, b: pa.Array, epsg: pa.Array) -> pa.Array:
    zone = _chunked(epsg).to_numpy(zero_copy_only=False).astype(float)
    left, right = Shapes(a), Shapes(b)
    left.project(zone)
    right.project(zone)
    area_a, area_b, both = overlap_areas(left, right)
    union = area_a + area_b - both
    with np.errstate(divide="ignore", invalid="ignore"):
        return _floats(np.where(union > 0, np.clip(both / union, 0, 1), 0.0))


@F.arrow_udf(T.DoubleType())
def _distance_udf(other: pa.Array, polygon: pa.Array, epsg: pa.Array, lat: pa.Array,
                  scale: pa.Array) -> pa.Array:
    zone = _chunked(epsg).to_numpy(zero_copy_only=False).astype(float)
    left, right = Shapes(other), Shapes(polygon)
    left.project(zone)
    right.project(zone)
    flat = ~np.isfinite(zone)
    if flat.any():
        at = _chunked(lat).to_numpy(zero_copy_only=False).astype(float)
        unit = np.where(flat, _chunked(scale).to_numpy(zero_copy_only=False), 1.0)
        for s in (left, right):
            s.x = s.x * np.where(flat[s.row], unit[s.row] * np.cos(np.radians(at[s.row])), 1.0)
            s.y = s.y * np.where(flat[s.row], unit[s.row], 1.0)
    return _floats(shape_distance(left, right))


@F.arrow_udf(T.IntegerType())
def _line_relation_udf(line: pa.Array, polygon: pa.Array) -> pa.Array:
    return pa.array(line_relation(Shapes(line), Shapes(polygon)), type=pa.int32())


@F.arrow_udf(T.StringType())
def _validity_udf(parts: pa.Array) -> pa.Array:
    return pa.array(validity(parts), type=pa.string())


@F.arrow_udf(PARTS_TYPE)
def _repair_udf(parts: pa.Array, broken: pa.Array) -> pa.Array:
    shapes = Shapes(parts)
    flags, nested = _chunked(broken).to_pylist(), _chunked(parts)
    cut = np.searchsorted(shapes.row, np.arange(shapes.rows + 1))
    out = []
    for r, flag in enumerate(flags):
        sel = slice(cut[r], cut[r + 1])
        faces = None
        if flag and cut[r + 1] > cut[r]:
            faces = repaired(shapes.x[sel], shapes.y[sel], shapes.ring[sel], [len(p) for p in nested[r].as_py()])
        out.append(None if faces is None else
                   [[[{"x": p[0], "y": p[1]} for p in ring] for ring in poly] for poly in faces])
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    return pa.array(out, type=pa.list_(pa.list_(pa.list_(point))))


def _zone(epsg: Column | None) -> Column:
    return F.lit(None).cast("int") if epsg is None else epsg.cast("int")


def iou(a: Column, b: Column, epsg: Column | None = None) -> Column:
    """Overlap ratio of two polygon columns, in the UTM zone ``epsg`` or on flat coordinates."""
    return F.coalesce(_iou_udf(a["parts"], b["parts"], _zone(epsg)), F.lit(0.0))


def distance_m(other: Column, polygon: Column, epsg: Column | None = None,
               lat: Column | None = None, metres_per_degree: float = 111320.0) -> Column:
    """Metres from a point or line to a polygon, 0 inside."""
    at = F.lit(0.0) if lat is None else lat
    return _distance_udf(other["parts"], polygon["parts"], _zone(epsg), at.cast("double"),
                         F.lit(metres_per_degree))


def line_relation_to(line: Column, polygon: Column) -> Column:
    return _line_relation_udf(line["parts"], polygon["parts"])


def validity_of(geom: Column) -> Column:
    """``ok``, ``self_intersection`` or ``invalid_geometry``; only polygons can be broken here."""
    polygonal, plain = geo.is_polygonal(geom), F.coalesce(_plain_box(geom["parts"]), F.lit(False))
    return F.when(polygonal, F.when(plain, F.lit("ok")).otherwise(_validity_udf(F.when(polygonal & ~plain, geom["parts"]))))


def _plain_box(parts: Column) -> Column:
    """Whether the only ring is a closed box along the axes with an area, which no batch need look at."""
    ring = F.get(F.get(parts, F.lit(0)), F.lit(0))
    p = [F.get(ring, F.lit(i)) for i in range(5)]
    same = lambda axis, *pairs: [p[a][axis] == p[b][axis] for a, b in pairs]
    flat_first = same("y", (0, 1), (2, 3)) + same("x", (1, 2), (3, 0))
    steep_first = same("x", (0, 1), (2, 3)) + same("y", (1, 2), (3, 0))
    box = reduce(Column.__and__, flat_first) | reduce(Column.__and__, steep_first)
    area = (p[0]["x"] - p[2]["x"]) * (p[0]["y"] - p[2]["y"])
    return ((F.size(parts) == 1) & (F.size(F.get(parts, F.lit(0))) == 1) & (F.size(ring) == 5) & (p[0] == p[4]) & box
            & (F.abs(area) > 0) & (F.abs(area) < F.lit(float("inf"))))


def repair(geom: Column, broken: Column) -> Column:
    """Broken polygons rebuilt from the even-odd area of their rings; null for all others."""
    parts = _repair_udf(F.when(broken, geom["parts"]), broken)
    return F.when(broken & (F.size(parts) > 0),
                  F.struct(F.lit("MultiPolygon").alias("kind"), parts.alias("parts")))
