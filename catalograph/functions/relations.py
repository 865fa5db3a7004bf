"""Relations of shapes that may be of different systems: points, lines, boxes and polygons, inside tasks.

Each shape keeps its own edges. A geodetic shape has great-circle arcs, a cartesian one and a box
straight segments in longitude and latitude, so a box's parallels are no great circles whatever they
meet. Where arcs meet segments the crossing is solved for: on a meridian as an arc, on a parallel in
closed form, on a slope by its roots. Two shapes share a point if edges meet or one holds a point of
the other. One covers another if the inner one's outline, cut wherever the outlines meet, lies in the
outer one piece by piece, and no piece of the outer one's rings runs through the inside of the inner one.

Longitudes count modulo 360, so a ring or box may run beyond 180. Edges belong to their shape.
"""

from __future__ import annotations

import functools

import numpy as np

from . import shapes as sh

#: Degrees within which a point counts as on a straight edge, and the least part of an edge that is a piece.
NEAR, LEAST = 1e-9, 1e-9
#: Degrees of a sloped segment in which an arc meets it twice at most.
STEP = 1.0


def lonlat(v: np.ndarray) -> np.ndarray:
    """Degrees of unit vectors."""
    return np.degrees(np.stack([np.arctan2(v[..., 1], v[..., 0]), np.arcsin(np.clip(v[..., 2], -1, 1))], -1))


class Path:
    """Edges of lines or rings, as arcs or straight segments."""

    def __init__(self, rings, arcs: bool):
        self.arcs = arcs
        rings = [np.asarray(r, float).reshape(-1, 2) for r in rings]
        self.corners = np.concatenate(rings) if rings else np.zeros((0, 2))
        ends = [(r[:-1], r[1:]) for r in rings if len(r) > 1]
        a = np.concatenate([e[0] for e in ends]) if ends else np.zeros((0, 2))
        b = np.concatenate([e[1] for e in ends]) if ends else np.zeros((0, 2))
        self.a, self.b = (sh.vectors(a), sh.vectors(b)) if arcs else (a, b)

    def __len__(self):
        return len(self.a)

    def at(self, i: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Degrees of the points at parts ``t`` of edges ``i``."""
        a, b, t = self.a[i], self.b[i], t[:, None]
        if not self.arcs:
            return a + t * (b - a)
        angle = sh._angle(a, b)[:, None]
        size = np.maximum(np.sin(angle), 1e-15)
        return lonlat(np.where(angle < 1e-12, a, (np.sin((1 - t) * angle) * a + np.sin(t * angle) * b) / size))

    def part(self, i: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Where points (degrees) that lie on edges ``i`` do so, 0 to 1."""
        a, b = self.a[i], self.b[i]
        if self.arcs:
            return np.clip(sh._angle(a, sh.vectors(p)) / np.maximum(sh._angle(a, b), 1e-15), 0, 1)
        d = b - a
        off = p - a
        off[:, 0] -= 360 * np.round((off[:, 0] - d[:, 0] / 2) / 360)
        return np.clip((off * d).sum(1) / np.maximum((d * d).sum(1), 1e-30), 0, 1)

    def holds(self, p: np.ndarray) -> np.ndarray:
        """(points, edges): which points (degrees) lie on which edges."""
        if self.arcs:
            return sh.on_arc(sh.vectors(p)[:, None], self.a[None], self.b[None])
        a, d = self.a[None], (self.b - self.a)[None]
        off = p[:, None] - a
        off[..., 0] -= 360 * np.round((off[..., 0] - d[..., 0] / 2) / 360)
        t = np.clip((off * d).sum(-1) / np.maximum((d * d).sum(-1), 1e-30), 0, 1)
        return np.abs(off - t[..., None] * d).max(-1) <= NEAR


def _arcs_meet(a, b, c, d):
    """Pairs (i, j) and points where arcs a-b and c-d cross."""
    line = sh.cross(sh.cross(a, b)[:, None], sh.cross(c, d)[None])
    size = sh.norm(line, True)
    x = line / np.maximum(size, 1e-15)
    out = []
    for v in (x, -x):
        hit = (size[..., 0] > 1e-15) & sh.on_arc(v, a[:, None], b[:, None]) & sh.on_arc(v, c[None], d[None])
        i, j = np.nonzero(hit)
        out.append((i, j, lonlat(v[i, j])))
    return out


def _segments_meet(a, b, c, d):
    """Pairs and points where straight segments cross, in any of the three turns that can matter."""
    r, s = (b - a)[:, None], (d - c)[None]
    den = r[..., 0] * s[..., 1] - r[..., 1] * s[..., 0]
    safe = np.where(np.abs(den) < 1e-15, 1, den)
    out = []
    for turn in (-360.0, 0.0, 360.0):
        off = c[None] + [turn, 0.0] - a[:, None]
        t = (off[..., 0] * s[..., 1] - off[..., 1] * s[..., 0]) / safe
        u = (off[..., 0] * r[..., 1] - off[..., 1] * r[..., 0]) / safe
        i, j = np.nonzero((np.abs(den) >= 1e-15) & (t >= -1e-12) & (t <= 1 + 1e-12) & (u >= -1e-12) & (u <= 1 + 1e-12))
        out.append((i, j, (a[i] + t[i, j][:, None] * (b - a)[i])))
    return out


def _parallel_meets(a, b, c, d):
    """Pairs and points where arcs cross pieces of parallels: A cos(lon) + B sin(lon) + C = 0."""
    n = sh.cross(a, b)
    lat = np.radians(c[:, 1])
    size = np.hypot(n[:, 0], n[:, 1])[:, None]
    value = -n[:, 2:3] * np.tan(lat)[None] / np.maximum(size, 1e-300)
    real = (size > 1e-15) & (np.abs(value) <= 1 + 1e-13) & (np.abs(c[:, 1]) < 90)[None]
    turn = np.arccos(np.clip(np.where(real, value, 0), -1, 1))
    base = np.arctan2(n[:, 1], n[:, 0])[:, None]
    west, width = np.minimum(c[:, 0], d[:, 0]), np.abs(d[:, 0] - c[:, 0])
    out = []
    for lon in (base + turn, base - turn):
        past = np.mod(np.degrees(lon) - west[None] + NEAR, 360)
        i, j = np.nonzero(real & (past <= width[None] + 2 * NEAR))
        p = np.stack([np.degrees(lon[i, j]), c[j, 1]], 1)
        on = sh.on_arc(sh.vectors(p), a[i], b[i])
        out.append((i[on], j[on], p[on]))
    return out


def _slope_meets(a, b, c, d):
    """Pairs and points where arcs cross one sloped segment c-d: roots of the height over the arc's plane."""
    n = sh.cross(a, b)
    steps = int(np.ceil(np.abs(d - c).max() / STEP)) + 1
    t = np.linspace(0, 1, steps + 1)

    def height(i, t):
        return (n[i] * sh.vectors(c + t[:, None] * (d - c))).sum(1)

    def rise(i, t, e=1e-6):
        return height(i, np.minimum(t + e, 1)) - height(i, np.maximum(t - e, 0))

    def root(f, i, lo, hi):
        sign = np.sign(f(i, lo))
        for _ in range(60):
            mid = (lo + hi) / 2
            left = np.sign(f(i, mid)) == sign
            lo, hi = np.where(left, mid, lo), np.where(left, hi, mid)
        return (lo + hi) / 2

    h = n @ sh.vectors(c + t[:, None] * (d - c)).T
    i, k = np.nonzero(h[:, :-1] * h[:, 1:] <= 0)
    found = [(i, root(height, i, t[k], t[k + 1]))]
    i, k = np.nonzero(h[:, :-1] * h[:, 1:] > 0)  # both ends on one side: a turn between them may reach the other
    turns = rise(i, t[k]) * rise(i, t[k + 1]) < 0 if len(i) else np.zeros(0, bool)
    i, k = i[turns], k[turns]
    top = root(rise, i, t[k], t[k + 1])
    over = height(i, top) * h[i, k] <= 1e-18
    i, k, top = i[over], k[over], top[over]
    found += [(i, root(height, i, t[k], top)), (i, root(height, i, top, t[k + 1]))]
    out = []
    for i, at in found:
        p = c + at[:, None] * (d - c)
        on = sh.on_arc(sh.vectors(p), a[i], b[i]) if len(i) else np.zeros(0, bool)
        out.append((i[on], np.zeros(on.sum(), int), p[on]))
    return out


def _mixed_meet(arcs: Path, segments: Path):
    """Pairs (arc, segment) and points where they cross."""
    c, d = segments.a, segments.b
    out = []
    upright, level = np.abs(d[:, 0] - c[:, 0]) < 1e-12, np.abs(d[:, 1] - c[:, 1]) < 1e-12
    for at, meet in ((np.flatnonzero(upright), lambda c, d: _arcs_meet(arcs.a, arcs.b, sh.vectors(c), sh.vectors(d))), (np.flatnonzero(level & ~upright), lambda c, d: _parallel_meets(arcs.a, arcs.b, c, d))):
        if len(at):
            out += [(i, at[j], p) for i, j, p in meet(c[at], d[at])]
    for k in np.flatnonzero(~upright & ~level):
        out += [(i, np.full(len(i), k), p) for i, _, p in _slope_meets(arcs.a, arcs.b, c[k], d[k])]
    return out


def cuts(p: Path, q: Path) -> tuple[np.ndarray, np.ndarray]:
    """Edges of ``p`` and parts of them (0 to 1) where ``q`` meets them: crossings, and corners that lie on the other."""
    if not len(p) or not len(q):
        return np.zeros(0, int), np.zeros(0)
    step = max(1, sh.BLOCK // len(q))
    if len(p) > step:  # so that no array of pairs is large
        some = []
        for k in range(0, len(p), step):
            own = Path([], p.arcs)
            own.a, own.b = p.a[k : k + step], p.b[k : k + step]
            i, t = cuts(own, q)
            some.append((i + k, t))
        return np.concatenate([s[0] for s in some]), np.concatenate([s[1] for s in some])
    if p.arcs and q.arcs:
        met = [(i, x) for i, _, x in _arcs_meet(p.a, p.b, q.a, q.b)]
    elif not p.arcs and not q.arcs:
        met = [(i, x) for i, _, x in _segments_meet(p.a, p.b, q.a, q.b)]
    elif p.arcs:
        met = [(i, x) for i, _, x in _mixed_meet(p, q)]
    else:
        met = [(j, x) for _, j, x in _mixed_meet(q, p)]
    corners = lonlat(q.a) if q.arcs else q.a, lonlat(q.b) if q.arcs else q.b
    for x in corners:
        k, i = np.nonzero(p.holds(x))
        met.append((i, x[k]))
    out = [(i, p.part(i, np.array(x))) for i, x in met if len(i)]
    for end, x in ((0.0, lonlat(p.a) if p.arcs else p.a), (1.0, lonlat(p.b) if p.arcs else p.b)):
        i = np.flatnonzero(q.holds(x).any(1))
        out.append((i, np.full(len(i), end)))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def pieces(p: Path, q: Path) -> np.ndarray:
    """A point (degrees) inside each piece of ``p``'s edges as ``q`` cuts them."""
    i, t = cuts(p, q)
    i, t = np.concatenate([i, np.arange(len(p)), np.arange(len(p))]), np.concatenate([t, np.zeros(len(p)), np.ones(len(p))])
    order = np.lexsort((t, i))
    i, t = i[order], t[order]
    own = (i[1:] == i[:-1]) & (t[1:] - t[:-1] > LEAST)
    return p.at(i[1:][own], (t[1:] + t[:-1])[own] / 2)


class Figure:
    """A shape {kind, coord_sys, rings} ready to be related."""

    def __init__(self, kind: str, coord_sys: str, rings):
        self.kind, self.geodetic = kind, coord_sys == "geodetic" and kind != "box"
        self.rings = [np.asarray(r, float).reshape(-1, 2) for r in rings]
        first = self.rings[0]
        self.area = kind in ("polygon", "box")
        if kind == "box":
            (self.west, self.south), (self.east, self.north) = first.min(0), first.max(0)
            w, e, s, n = self.west, self.east, self.south, self.north
            sides = []
            if e - w < 360:  # a box all around has no sides
                sides += [[(w, s), (w, n)], [(e, s), (e, n)]]
            sides += [[(w, y), (e, y)] for y in (s, n) if abs(y) < 90]
            self.path = Path(sides, False)
        else:
            self.path = Path(self.rings if kind != "point" else [], self.geodetic)
        self.some = first[:1]
        if self.geodetic and self.area:
            self.holes = [h[::-1] if sh._clockwise(h, "geodetic") else h for h in self.rings[1:]]

    @functools.cached_property
    def cap(self) -> tuple[np.ndarray, float]:
        """A circle on the sphere around the shape: its centre, and its radius in radians (pi: no circle is known)."""
        i = np.repeat(np.arange(len(self.path)), 5)
        edge = self.path.at(i, np.tile(np.linspace(0, 1, 5), len(self.path)))
        v = sh.vectors(np.concatenate([edge, self.path.corners if len(self.path.corners) else self.some]))
        middle = v.sum(0)
        size = float(np.sqrt(middle @ middle))
        if size < 0.2 * len(v):
            return v[0], np.pi
        middle /= size
        gap = sh._angle(v.reshape(-1, 3)[: len(edge)].reshape(-1, 5, 3)[:, :-1], v[: len(edge)].reshape(-1, 5, 3)[:, 1:]).max() if len(edge) else 0.0
        radius = float(sh._angle(v, middle).max() + gap)
        if radius > 1.4:
            return middle, np.pi
        if self.area and self.geodetic:  # its inside lies to the left: in the circle, or all but the circle
            a, b = self.path.a[: len(self.rings[0]) - 1], self.path.b[: len(self.rings[0]) - 1]
            if sh.cross(a, b).sum(0) @ middle <= 0:
                return middle, np.pi
        if self.kind == "box" and self.covers_points(lonlat(-middle[None]))[0]:
            return middle, np.pi
        return middle, radius

    def far(self, other: Figure) -> bool:
        """Whether two shapes lie apart by their circles alone."""
        (a, r), (b, s) = self.cap, other.cap
        return r + s < np.pi and float(np.arccos(np.clip(a @ b, -1, 1))) > r + s + 1e-6

    def on_edge(self, p: np.ndarray) -> np.ndarray:
        return self.path.holds(p).any(1) if len(self.path) else np.zeros(len(p), bool)

    def covers_points(self, p: np.ndarray) -> np.ndarray:
        """Which points lie in the shape, its edges included."""
        p = np.asarray(p, float).reshape(-1, 2)
        if self.kind == "point":
            return (sh._angle(sh.vectors(p), sh.vectors(self.some)) < sh.ON_ARC)
        if self.kind == "line":
            return self.on_edge(p)
        if self.kind == "box":
            past = np.mod(p[:, 0] - self.west + NEAR, 360)
            lon = (past <= self.east - self.west + 2 * NEAR) | (self.east - self.west >= 360)
            pole = (np.abs(p[:, 1]) >= 90 - NEAR) & (np.where(p[:, 1] > 0, self.north, -self.south) >= 90 - NEAR)
            return ((p[:, 1] <= self.north + NEAR) & (p[:, 1] >= self.south - NEAR) & lon) | pole
        if self.geodetic:
            out = sh.geodetic_covers_points(self.rings[0], p)
            for hole in self.holes:
                at = np.flatnonzero(out)
                out[at] &= ~sh.geodetic_covers_points(hole, p[at]) if len(at) else True
        else:
            out = _planar(self.rings[0], p)
            for hole in self.rings[1:]:
                out &= ~_planar(hole, p)
        return out | self.on_edge(p)

    def inside(self, p: np.ndarray) -> np.ndarray:
        """Which points lie in the shape but not on its edges."""
        return self.covers_points(p) & ~self.on_edge(p)


def _planar(ring: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Which points a cartesian ring holds, by crossings of a ray to the east, turned to the ring's longitudes."""
    a, b = ring[:-1][None], ring[1:][None]
    out = np.zeros(len(p), bool)
    for turn in (-360.0, 0.0, 360.0):
        x, y = p[:, :1] + turn, p[:, 1:]
        span = (a[..., 1] > y) != (b[..., 1] > y)
        dy = np.where(span, b[..., 1] - a[..., 1], 1)
        out |= ((span & (x < (b[..., 0] - a[..., 0]) * (y - a[..., 1]) / dy + a[..., 0])).sum(1) % 2).astype(bool)
    return out


def intersects(a: Figure, b: Figure) -> bool:
    """Whether two shapes share a point."""
    if a.kind == "point" or b.kind == "point":
        a, b = (a, b) if b.kind == "point" else (b, a)
        return bool(a.covers_points(b.some)[0])
    if a.far(b):
        return False
    if len(cuts(a.path, b.path)[0]):
        return True
    return bool((a.area and a.covers_points(b.some)[0]) or (b.area and b.covers_points(a.some)[0]))


def covers(a: Figure, b: Figure) -> bool:
    """Whether all of b lies in a."""
    if b.kind == "point" or a.kind == "point":
        return bool(a.covers_points(b.path.corners if len(b.path.corners) else b.some).all())
    if a.far(b) or not a.covers_points(b.path.corners if len(b.path.corners) else b.some).all():
        return False
    if not a.covers_points(pieces(b.path, a.path)).all():
        return False
    if not b.area:
        return True
    if not a.area:
        return False
    return not b.inside(pieces(a.path, b.path)).any()
