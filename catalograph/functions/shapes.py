"""Lines and rings, inside tasks: NumPy over a row's rings, called from Arrow UDFs (see ``relations``).

Geodetic edges are great-circle arcs between unit vectors. Cartesian edges are straight in
longitude and latitude. A ring is closed and counter-clockwise: its inside lies to its left.
"""

from __future__ import annotations

import numpy as np

EPS = 1e-10


def vectors(points) -> np.ndarray:
    """Unit vectors of (lon, lat) degrees."""
    p = np.radians(np.asarray(points, float).reshape(-1, 2))
    c = np.cos(p[:, 1])
    return np.stack([c * np.cos(p[:, 0]), c * np.sin(p[:, 0]), np.sin(p[:, 1])], 1)


def cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cross products of vectors; broadcasts. For few vectors much quicker than NumPy's."""
    a, b = np.asarray(a), np.asarray(b)
    out = np.empty(np.broadcast_shapes(a.shape, b.shape))
    (x, y, z), (u, v, w) = (a[..., 0], a[..., 1], a[..., 2]), (b[..., 0], b[..., 1], b[..., 2])
    out[..., 0], out[..., 1], out[..., 2] = y * w - z * v, z * u - x * w, x * v - y * u
    return out


def norm(a: np.ndarray, keepdims: bool = False) -> np.ndarray:
    """Lengths of vectors."""
    out = np.sqrt(a[..., 0] ** 2 + a[..., 1] ** 2 + a[..., 2] ** 2)
    return out[..., None] if keepdims else out


def _angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arctan2(norm(cross(a, b)), (a * b).sum(-1))


#: How far from an arc, in radians, a point still counts as on it: some 6 mm on the ground.
ON_ARC = 1e-9


def on_arc(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether points lie on arcs, within :data:`ON_ARC` of the arc itself; broadcasts."""
    n = cross(a, b)
    size = norm(n, True)
    n = n / np.maximum(size, 1e-15)
    between = ((cross(a, p) * n).sum(-1) >= 0) & ((cross(p, b) * n).sum(-1) >= 0) & (size[..., 0] > 1e-15)
    return (between & (np.abs((n * p).sum(-1)) < ON_ARC)) | (_angle(a, p) < ON_ARC) | (_angle(p, b) < ON_ARC)


def arcs_cross(a, b, c, d) -> np.ndarray:
    """Whether arcs a-b and c-d share a point; broadcasts."""
    n, m = cross(a, b), cross(c, d)
    line = cross(n, m)
    size = norm(line, True)
    same = size[..., 0] < 1e-12
    x = line / np.where(size < 1e-12, 1, size)
    hit = (on_arc(x, a, b) & on_arc(x, c, d)) | (on_arc(-x, a, b) & on_arc(-x, c, d))
    touch = on_arc(a, c, d) | on_arc(b, c, d) | on_arc(c, a, b) | on_arc(d, a, b)
    return np.where(same, touch, hit | touch)


def ring_winds(v: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Turns of a geodetic ring around each point, seen from the point: 1 inside a counter-clockwise ring."""
    east = cross([0.0, 0.0, 1.0], points)
    size = norm(east, True)
    east = np.where(size < 1e-12, [1.0, 0.0, 0.0], east / np.maximum(size, 1e-15))
    north = cross(points, east)
    t = np.arctan2(north @ v.T, east @ v.T)
    # an arc turns by the difference of directions, the short way: no great-circle arc passes the point's axis twice
    step = (np.diff(t, axis=1) + np.pi) % (2 * np.pi) - np.pi
    return step.sum(1) / (2 * np.pi)


#: Pairs of a point and an edge that are tested at once.
BLOCK = 200_000


def geodetic_covers_points(ring, points) -> np.ndarray:
    """Which points lie in or on a geodetic ring.

    The ring's turns around a point and around its antipode are 1 or 0 together: a point inside
    sees the ring go round once more than its antipode does.
    """
    v, p = vectors(ring), vectors(points)
    block = max(1, BLOCK // len(v))
    if len(p) > block:
        return np.concatenate([geodetic_covers_points(ring, points[i : i + block]) for i in range(0, len(p), block)])
    out = on_arc(p[:, None], v[:-1], v[1:]).any(1)
    # the ring separates the point from its antipode or circles both; inside is to the left
    maybe = np.flatnonzero(~out & (ring_winds(v, p) >= 0.5))
    out[maybe] = _left_most(v, p[maybe])
    return out


def geodetic_covers(ring, point) -> bool:
    """A point in or on a geodetic ring."""
    return bool(geodetic_covers_points(ring, [point])[0])


def _left_most(v: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether each point lies left of its nearest edge."""
    a, b = v[:-1], v[1:]
    n = cross(a, b)
    n /= np.maximum(norm(n, True), 1e-15)
    side = p @ n.T
    foot = p[:, None] - side[..., None] * n
    foot /= np.maximum(norm(foot, True), 1e-15)
    ends = np.minimum(_angle(a, p[:, None]), _angle(b, p[:, None]))
    d = np.where(on_arc(foot, a, b), np.arcsin(np.clip(np.abs(side), 0, 1)), ends)
    near = d <= d.min(1, keepdims=True) + 1e-12
    out = side[np.arange(len(p)), near.argmax(1)] > 0
    for k in np.flatnonzero(near.sum(1) > 1):
        # the nearest point is a corner: left of both edges at a convex corner, of either at a reflex one
        i, j = np.flatnonzero(near[k])[[0, -1]]
        if j - i > 1:
            i, j = j, i
        left = side[k, i] > 0, side[k, j] > 0
        out[k] = all(left) if cross(n[i], n[j]) @ b[i] > 0 else any(left)
    return out


def cartesian_covers(ring, point) -> bool:
    """A point in or on a cartesian ring, by crossings of a ray to the east."""
    r = np.asarray(ring, float)
    x, y = point
    a, b = r[:-1], r[1:]
    cross = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) - (b[:, 1] - a[:, 1]) * (x - a[:, 0])
    inside_box = (np.minimum(a, b) - EPS <= [x, y]).all(1) & (np.maximum(a, b) + EPS >= [x, y]).all(1)
    if (inside_box & (np.abs(cross) < EPS)).any():
        return True
    span = (a[:, 1] > y) != (b[:, 1] > y)
    dy = np.where(span, b[:, 1] - a[:, 1], 1)
    return bool((span & (x < (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / dy + a[:, 0])).sum() % 2)


def segments_cross(a, b, c, d) -> np.ndarray:
    """Whether straight segments share a point; broadcasts."""
    def side(p, q, r):
        return (q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0])

    def on(p, q, r):
        lo, hi = np.minimum(p, q) - EPS, np.maximum(p, q) + EPS
        return (np.abs(side(p, q, r)) < EPS) & ((r >= lo) & (r <= hi)).all(-1)

    proper = (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)
    return proper | on(a, b, c) | on(a, b, d) | on(c, d, a) | on(c, d, b)


def _clockwise(ring, kind: str) -> bool:
    r = np.asarray(ring, float)
    return float(((r[1:, 0] - r[:-1, 0]) * (r[1:, 1] + r[:-1, 1])).sum()) > 0


def box_ring(west, north, east, south):
    """A box as a cartesian ring; one that crosses the antimeridian goes beyond 180."""
    e = east + 360 if west > east else east
    return [(west, south), (e, south), (e, north), (west, north), (west, south)]


def shape_box(rings, kind: str) -> tuple[float, float, float, float]:
    """West, north, east, south around a ring or line; arcs reach past their ends, poles take all longitudes."""
    r = np.asarray(rings[0], float)
    lon, lat = r[:, 0], r[:, 1]
    north, south = lat.max(), lat.min()
    if kind == "geodetic" and len(r) > 1:
        v = vectors(r)
        n = cross(v[:-1], v[1:])
        size = norm(n)
        n = n[size > 1e-12] / size[size > 1e-12, None]
        for sign in (1, -1):
            top = np.array([0, 0, 1.0]) - n * n[:, 2:3]
            size_of = norm(top, True)
            top = sign * top / np.maximum(size_of, 1e-15)
            hit = on_arc(top, v[:-1][size > 1e-12], v[1:][size > 1e-12])
            if hit.any():
                z = np.degrees(np.arcsin(np.clip(top[hit, 2], -1, 1)))
                north, south = max(north, z.max()), min(south, z.min())
        closed = np.allclose(v[0], v[-1]) and len(r) > 3
        if closed:
            if geodetic_covers(r, (0, 90)):
                return -180.0, 90.0, 180.0, float(south)
            if geodetic_covers(r, (0, -90)):
                return -180.0, float(north), 180.0, -90.0
        # the largest gap between longitudes lies outside
        u = np.sort(np.unique(np.mod(lon, 360)))
        gaps = np.diff(np.concatenate([u, [u[0] + 360]]))
        k = int(gaps.argmax())
        west, east = u[(k + 1) % len(u)], u[k]
        wrap = lambda x: x - 360 if x > 180 else x
        return float(wrap(west)), float(north), float(wrap(east)), float(south)
    return float(lon.min()), float(north), float(lon.max()), float(south)


def shape_errors(kind: str, coord_sys: str, rings, box=None) -> list[str]:
    """What is wrong with a shape."""
    out = []
    for ring in rings or []:
        r = np.asarray(ring, float)
        if (np.abs(r[:, 0]) > 180).any() or (np.abs(r[:, 1]) > 90).any():
            out.append("coordinates out of bounds")
            continue
        if kind == "polygon" and not np.allclose(r[0], r[-1]):
            out.append("ring is not closed")
        inner = r[:-1] if kind == "polygon" and len(r) > 1 else r
        if kind in ("polygon", "line"):
            if len(np.unique(np.round(inner, 9), axis=0)) < len(inner):
                out.append("duplicate points")
            elif coord_sys == "geodetic":
                v = vectors(r)
                if (np.abs((v[:-1] * v[1:]).sum(1) + 1) < 1e-12).any():
                    out.append("consecutive antipodal points")
        if kind == "polygon" and "duplicate points" not in out:
            n = len(r) - 1
            if n > 3:
                i, j = np.triu_indices(n, 2)
                far = ~((i == 0) & (j == n - 1))
                i, j = i[far], j[far]
                v = vectors(r) if coord_sys == "geodetic" else r
                test = arcs_cross if coord_sys == "geodetic" else segments_cross
                if len(i) and test(v[i], v[i + 1], v[j], v[j + 1]).any():
                    out.append("ring crosses itself")
    if kind == "box" and box is not None and box[1] < box[3]:
        out.append("box is upside down")
    if kind == "circle" and rings and abs(rings[0][0][1]) == 90:
        out.append("circle centre on a pole")
    return out


def simplify(ring, tolerance: float):
    """Douglas-Peucker: keep the points that lie further than ``tolerance`` degrees from the outline."""
    p = np.asarray(ring, float)
    keep = np.zeros(len(p), bool)
    keep[[0, -1]] = True
    if len(p) > 3 and np.allclose(p[0], p[-1]):  # a ring needs a third fixed point
        keep[int(((p - p[0]) ** 2).sum(1).argmax())] = True
    marks = np.flatnonzero(keep)
    stack = list(zip(marks[:-1], marks[1:]))
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        a, d = p[i], p[j] - p[i]
        q = p[i + 1 : j] - a
        length = np.hypot(*d)
        off = np.hypot(q[:, 0], q[:, 1]) if length < 1e-15 else np.abs(d[0] * q[:, 1] - d[1] * q[:, 0]) / length
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[i + 1 + k] = True
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return [tuple(x) for x in p[keep]]
