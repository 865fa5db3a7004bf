"""Orbit tracks: swaths of granules, and the equator crossings from which a pass sees an area.

Circular orbits over a turning sphere. Seconds after the ascending equator crossing at longitude L,
with u = 2 pi t / period the angle along the track, latitude is asin(sin i sin u) and longitude
L + atan2(cos i sin u, cos u) - earth turn x t.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spatial import shape_covers_point

EARTH_M = 6378137.0
#: Degrees that the earth turns in a second, against the stars.
TURN = 360.0 / 86164.0905


def track(lon: float, inclination: float, period_s: float, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longitude and latitude in degrees, t seconds after the ascending crossing at ``lon``."""
    i, u = np.radians(inclination), 2 * np.pi * np.asarray(t, float) / period_s
    lat = np.degrees(np.arcsin(np.clip(np.sin(i) * np.sin(u), -1, 1)))
    x = lon + np.degrees(np.arctan2(np.cos(i) * np.sin(u), np.cos(u))) - TURN * np.asarray(t, float)
    return (x + 180) % 360 - 180, lat


def _unit(lon, lat) -> np.ndarray:
    a, b = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)], -1)


def edges(lon: float, inclination: float, period_s: float, width_m: float, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left and right swath edge points, (lon, lat) rows, at times t."""
    t = np.asarray(t, float)
    here = _unit(*track(lon, inclination, period_s, t))
    ahead = _unit(*track(lon, inclination, period_s, t + 1.0))
    side = np.cross(here, ahead)
    side /= np.linalg.norm(side, axis=-1, keepdims=True)
    half = width_m / 2 / EARTH_M
    out = []
    for sign in (1, -1):  # the track's left is along the cross product
        v = here * np.cos(half) + sign * side * np.sin(half)
        out.append(np.stack([np.degrees(np.arctan2(v[..., 1], v[..., 0])), np.degrees(np.arcsin(np.clip(v[..., 2], -1, 1)))], -1))
    return out[0], out[1]


def swaths(lon, inclination, period_min, width_km, t0, t1, step: float = 300.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rings of the ground that passes see, for arrays of passes at once: (pass, points, points (lon, lat)).

    A pass from t0 to t1 seconds after its crossing has a ring for each revolution: its left edge
    forth, its right edge back, closed. The first result names each ring's pass, the second counts
    its points.
    """
    lon, inclination, period, width, t0, t1 = (np.asarray(v, float) for v in (lon, inclination, np.multiply(period_min, 60.0), np.multiply(width_km, 1000.0), t0, t1))
    rounds = np.maximum(0, np.ceil((t1 - t0) / period - 1e-12)).astype(int)
    own = np.repeat(np.arange(len(lon)), rounds)
    turn = np.arange(len(own)) - np.repeat(np.cumsum(rounds) - rounds, rounds)
    start = t0[own] + turn * period[own]
    stop = np.minimum(start + period[own], t1[own])
    n = np.ceil((stop - start) / step - 1e-9).astype(int) + 1  # moments of a ring, its last included
    ring = np.repeat(np.arange(len(own)), n)
    k = np.arange(len(ring)) - np.repeat(np.cumsum(n) - n, n)
    t = np.where(k == n[ring] - 1, stop[ring], start[ring] + k * step)
    at = own[ring]
    left, right = edges(lon[at], inclination[at], period[at], width[at, None], t)
    points = np.empty((2 * n.sum() + len(n), 2))
    begin = np.cumsum(2 * n + 1) - (2 * n + 1)
    points[begin[ring] + k] = left
    points[begin[ring] + 2 * n[ring] - 1 - k] = right
    points[begin + 2 * n] = points[begin]
    return own, 2 * n + 1, points


def swath_rings(lon: float, inclination: float, period_min: float, width_km: float, t0: float, t1: float, step: float = 300.0) -> list[list[tuple[float, float]]]:
    """Rings of the ground seen from t0 to t1 seconds after the crossing, one for each revolution."""
    _, size, points = swaths([lon], [inclination], [period_min], [width_km], [t0], [t1], step)
    return [list(map(tuple, p)) for p in np.split(points, np.cumsum(size)[:-1])] if len(size) else []


RINGS = T.ArrayType(T.ArrayType(T.StructType([T.StructField(c, T.DoubleType()) for c in ("lon", "lat")])))


def swath_polygons(df: DataFrame, step: float = 300.0) -> DataFrame:
    """``df`` with ``swath``, rings of each granule's ground; null where a value is missing.

    Columns: crossing_lon, crossing_time, start_date, end_date, and orbit parameters inclination,
    period (minutes) and swath_width (km). A batch's granules are worked out together.
    """
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6

    @F.arrow_udf(RINGS)
    def rings(lon: pa.Array, inc: pa.Array, period: pa.Array, width: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        given = np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (lon, inc, period, width, a, b)])
        known = np.isfinite(given).all(1) & (given[:, 2] > 0)
        own, size, points = swaths(*given[known].T, step)
        flat = pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], names=["lon", "lat"])
        inner = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), flat)
        count = np.zeros(len(given), np.int64)
        np.add.at(count, np.flatnonzero(known)[own], 1)
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), inner, mask=pa.array(~known))

    t = seconds("crossing_time")
    return df.withColumn("swath", rings("crossing_lon", "inclination", "period", "swath_width", seconds("start_date") - t, seconds("end_date") - t))


#: Moments at which a pass is looked at: first all of its half turn, then the part where it is near. Points at once.
COARSE, FINE, ROWS = 2001, 3001, 32


def crossings(lat, inclination, period_min, width_km, ascending) -> tuple[np.ndarray, np.ndarray]:
    """Crossing longitudes (first, last; wrapping if first > last) of passes whose swath sees a point at longitude 0.

    Arrays of points and orbits at once; nan if no pass sees the point, -180 and 180 if every pass does.
    The longitudes that the swath of a pass crossing at longitude 0 sees on the point's circle of
    latitude give the crossings by a shift. They are as exact as a pass moves between two moments.
    """
    lat, inclination, period, half = (np.asarray(v, float) for v in (lat, inclination, np.multiply(period_min, 60.0), np.degrees(np.multiply(width_km, 1000.0) / 2 / EARTH_M)))
    ascending = np.asarray(ascending, bool)
    top = np.where(inclination <= 90, inclination, 180 - inclination)
    a, b = np.full(len(lat), np.nan), np.full(len(lat), np.nan)
    every = (np.abs(lat) >= 180 - top - half) & (top + half > 90) & (np.abs(lat) <= top + half)
    a[every], b[every] = -180.0, 180.0
    rest = np.flatnonzero((np.abs(lat) <= top + half) & ~every)
    for i in range(0, len(rest), ROWS):
        at = rest[i : i + ROWS]
        a[at], b[at] = _crossings(lat[at], inclination[at], period[at], half[at], ascending[at])
    return a, b


def _crossings(lat, inclination, period, half, ascending):
    column = lambda v: v[:, None]
    target, widest = np.sin(np.radians(lat)), np.radians(half)

    def offsets(t: np.ndarray):
        """At each moment the swath is the arc across the track; where it cuts the circle of latitude."""
        here = _unit(*track(0.0, column(inclination), column(period), t))
        ahead = _unit(*track(0.0, column(inclination), column(period), t + 1.0))
        side = np.cross(here, ahead)
        side /= np.linalg.norm(side, axis=-1, keepdims=True)
        r = np.hypot(here[..., 2], side[..., 2])
        base, off = np.arctan2(side[..., 2], here[..., 2]), np.arccos(np.clip(column(target) / np.maximum(r, 1e-15), -1, 1))
        turn = lambda d: (d + np.pi) % (2 * np.pi) - np.pi
        return here, side, r >= np.abs(column(target)), (turn(base + off), turn(base - off))

    def moments(first, last, n: int) -> np.ndarray:
        return column(first) + column(last - first) * np.linspace(0, 1, n)

    start, stop = np.where(ascending, -period / 4, period / 4), np.where(ascending, period / 4, 3 * period / 4)
    t = moments(start, stop, COARSE)
    _, _, ok, both = offsets(t)
    near = ok & (np.minimum(*np.abs(both)) <= column(1.2 * widest + 0.02))
    rows = np.arange(len(lat))
    first, last = t[rows, near.argmax(1)], t[rows, COARSE - 1 - near[:, ::-1].argmax(1)]
    here, side, ok, both = offsets(moments(np.maximum(start, first - 6.0), np.minimum(stop, last + 6.0), FINE))  # finer where it matters
    seen = []
    for d in both:
        v = here * np.cos(d)[..., None] + side * np.sin(d)[..., None]
        hit = ok & (np.abs(d) <= column(widest)) & column(near.any(1))
        # a pass crossing at c sees the point if the track at 0 sees longitude -c
        seen.append(np.where(hit, np.mod(-np.degrees(np.arctan2(v[..., 1], v[..., 0])), 360), np.nan))
    cross = np.sort(np.concatenate(seen, 1), 1)  # what isn't seen comes last
    n = np.isfinite(cross).sum(1)
    end = np.maximum(n - 1, 0)
    gaps = np.full(cross.shape, -1.0)
    gaps[:, :-1] = np.nan_to_num(np.diff(cross, axis=1), nan=-1.0)
    gaps[rows, end] = cross[rows, 0] + 360 - cross[rows, end]
    k = np.nan_to_num(gaps, nan=-1.0).argmax(1)  # the largest gap lies between the last crossing and the first
    one = (n == 1) | (gaps[rows, k] < 1e-9)
    wrap = lambda v: (v + 180) % 360 - 180
    a = np.where(one, cross[:, 0], cross[rows, (k + 1) % np.maximum(n, 1)])
    b = np.where(one, cross[:, 0], cross[rows, k])
    return np.where(n > 0, wrap(a), np.nan), np.where(n > 0, wrap(b), np.nan)


def crossing_range(lon: float, lat: float, inclination: float, period_min: float, width_km: float, ascending: bool) -> tuple[float, float] | None:
    """:func:`crossings` of one point: a range of longitudes, or None if no pass sees it."""
    a, b = crossings([lat], [inclination], [period_min], [width_km], [ascending])
    if np.isnan(a[0]):
        return None
    if (a[0], b[0]) == (-180.0, 180.0):
        return -180.0, 180.0
    return float((a[0] + lon + 180) % 360 - 180), float((b[0] + lon + 180) % 360 - 180)


def merge_circular(ranges: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Union of longitude ranges as sorted ranges that don't wrap."""
    flat = []
    for a, b in ranges:
        flat += [(a, b)] if a <= b else [(a, 180.0), (-180.0, b)]
    out: list[list[float]] = []
    for a, b in sorted(flat):
        if out and a <= out[-1][1] + 1e-6:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(r) for r in out]


def area_points(areas: DataFrame) -> DataFrame:
    """Points on each outline at most ``gap`` degrees apart and of a grid inside it, each as a row.

    ``areas``: ring, gap, and columns that come back with lon and lat. An outline of one point is
    that point, and one of three or fewer has no inside.
    """
    keys = [c for c in areas.columns if c not in ("ring", "gap")]
    steps = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int")))
    x, y = (lambda p: F.col(p)["lon"]), (lambda p: F.col(p)["lat"])

    first = areas.select(*keys, F.col("ring")[0]["lon"].alias("lon"), F.col("ring")[0]["lat"].alias("lat"))
    # of each side the points after its first
    sides = areas.where(F.size("ring") > 1).select(*keys, "gap", F.explode(F.arrays_zip(F.expr("slice(ring, 1, size(ring) - 1)").alias("a"), F.expr("slice(ring, 2, size(ring) - 1)").alias("b"))).alias("s"))
    sides = sides.select(*keys, "gap", F.col("s")["a"].alias("a"), F.col("s")["b"].alias("b"))
    sides = sides.withColumn("n", F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(x("b") - x("a")), F.abs(y("b") - y("a"))) / F.col("gap"))))
    sides = sides.select("*", steps(F.col("n") - 1).alias("k")).withColumn("k", (F.col("k") + 1) / F.col("n"))
    outline = sides.select(*keys, (x("a") + (x("b") - x("a")) * F.col("k")).alias("lon"), (y("a") + (y("b") - y("a")) * F.col("k")).alias("lat"))

    box = {f"{f}_{c}": getattr(F, f"array_{f}")(f"ring.{c}") for c in ("lon", "lat") for f in ("min", "max")}
    grid = areas.where(F.size("ring") > 3).withColumns(box)
    for c in ("lon", "lat"):
        n = F.ceil((F.col(f"max_{c}") - F.col(f"min_{c}")) / F.col("gap") - 0.5)
        grid = grid.withColumn("n", n).where("n > 0").withColumn("k", steps(F.col("n") - 1)).withColumn(c, F.col(f"min_{c}") + (F.col("k") + 0.5) * F.col("gap"))

    inner = F.struct(F.lit("polygon").alias("kind"), F.lit("cartesian").alias("coord_sys"), F.array("ring").alias("rings"))
    grid = grid.where(shape_covers_point(inner, F.col("lon"), F.col("lat"))).select(*keys, "lon", "lat")
    return first.unionByName(outline).unionByName(grid)


ORBIT = ["inclination", "period", "swath_width"]
#: Points along a side of the squares whose ranges are merged first.
CELL = 64


def orbit_ranges(areas: DataFrame, orbits: DataFrame) -> DataFrame:
    """(area_id, inclination, period, swath_width, ascending, lon_min, lon_max, lat_min, lat_max) for each area and different orbit.

    Areas are outlines (area_id, ring). The union of the ranges of dense points of the area, closer
    together than the swath is wide. Each different orbit is worked out once, in a row for each
    latitude and direction.
    """
    kinds = orbits.select(*ORBIT).dropna().where("swath_width > 0").distinct()
    gap = F.lit(0.9) * F.degrees(F.col("swath_width") * 1000.0 / EARTH_M)
    outlines = areas.select("area_id", "ring", F.array_min("ring.lat").alias("lat_min"), F.array_max("ring.lat").alias("lat_max"))
    points = area_points(outlines.join(kinds, how="cross").withColumn("gap", gap)).withColumn("gap", gap)
    points = points.withColumn("ascending", F.explode(F.array(F.lit(True), F.lit(False))))

    @F.arrow_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("a", "b")]))
    def sees(lat: pa.Array, inc: pa.Array, period: pa.Array, width: pa.Array, up: pa.Array) -> pa.Array:
        a, b = crossings(*(c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (lat, inc, period, width)), up.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(v, pa.float64(), mask=np.isnan(v)) for v in (a, b)], names=["a", "b"])

    sees = sees.asNondeterministic()  # else the filter and each use of its result work it out again

    # ranges at a latitude differ by a shift; they are few bytes, but much work for each, so their tasks aren't coalesced
    by = ["lat", *ORBIT, "ascending"]
    tasks = int(areas.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lats = points.select(*by).distinct().repartition(tasks, *by).withColumn("r", sees(*by)).where("r.a is not null and not isnan(r.a)")
    every = (F.col("r.a") == -180) & (F.col("r.b") == 180)
    at = lambda c: F.when(every, F.col(c)).otherwise(F.pmod(F.col("lon") + F.col(c) + 180, F.lit(360.0)) - 180)

    @F.pandas_udf("array<struct<a:double,b:double>>")
    def merged(some: pd.Series) -> pd.Series:
        return pd.Series([[{"a": a, "b": b} for a, b in merge_circular([(r["a"], r["b"]) for r in rs])] for rs in some])

    key = ["area_id", "lat_min", "lat_max", *ORBIT, "ascending"]
    seen = points.join(lats, by).withColumn("r", F.struct(at("r.a").alias("a"), at("r.b").alias("b")))
    near = [F.floor(F.col(c) / F.col("gap") / CELL).alias(f"cell_{c}") for c in ("lon", "lat")]
    cells = seen.groupBy(*key, *near).agg(F.collect_list("r").alias("rs")).select(*key, F.explode(merged("rs")).alias("r"))
    whole = cells.groupBy(*key).agg(F.collect_list("r").alias("rs")).select(*key, F.explode(merged("rs")).alias("r"))
    return whole.select("area_id", *ORBIT, "ascending", F.col("r.a").alias("lon_min"), F.col("r.b").alias("lon_max"), "lat_min", "lat_max")


def crossing_ranges(areas: DataFrame, orbits: DataFrame) -> DataFrame:
    """(area_id, collection_id, ascending, lon_min, lon_max, lat_min, lat_max) for each area and collection.

    Orbits are collections with inclination, period and swath_width; they get their :func:`orbit_ranges` by a join.
    """
    return orbits.select("collection_id", *ORBIT).join(orbit_ranges(areas, orbits), ORBIT).select("area_id", "collection_id", "ascending", "lon_min", "lon_max", "lat_min", "lat_max")


#: Degrees of a bin of crossing longitudes.
BIN = 10


def orbit_search(granules: DataFrame, areas: DataFrame, orbits: DataFrame) -> DataFrame:
    """:func:`orbit_join` of granules with the :func:`crossing_ranges` of areas and collections.

    Ranges are gathered in bins once for all collections of the same orbits (those of a collection's
    rows together), so that what granules meet grows with different orbits and not with collections.
    """
    name = F.concat_ws(" ", *[F.col(c) + 0.0 for c in ORBIT])
    own = orbits.dropna(subset=ORBIT).groupBy("collection_id").agg(F.concat_ws(",", F.array_sort(F.collect_set(name))).alias("_orbits"))
    kinds = own.select("_orbits").distinct().withColumn("_orbit", F.explode(F.split("_orbits", ",")))
    ranges = kinds.join(orbit_ranges(areas, orbits).withColumn("_orbit", name), "_orbit")
    return orbit_join(granules.join(own, "collection_id"), ranges, "_orbits").drop("_orbits")


def orbit_join(granules: DataFrame, ranges: DataFrame, by: str = "collection_id") -> DataFrame:
    """(area_id, and granule columns) of granules whose pass sees an area: a range join by collection, or by another column.

    Granules have crossing_lon and the circular latitudes start_clat and end_clat that they cover.
    Ascending passes over latitudes [a, b] lie at circular latitudes [a, b], descending ones at
    [180 - b, 180 - a], each also a turn later or earlier. A range of longitudes with its first beyond
    its last wraps.

    A granule crosses at one longitude and so is in one bin; an area's ranges are gathered for each bin
    of each collection that they touch (few: they are merged by then). So a granule meets an area at
    most once, equal granules each come back, and a collection's granules are spread over its bins.
    """
    last = 360 // BIN - 1
    at = lambda c: F.greatest(F.lit(0), F.least(F.floor((F.col(c) + 180) / BIN).cast("int"), F.lit(last)))
    bins = F.when(F.col("lon_min") <= F.col("lon_max"), F.sequence(at("lon_min"), at("lon_max"))).otherwise(F.array_union(F.sequence(at("lon_min"), F.lit(last)), F.sequence(F.lit(0), at("lon_max"))))
    lo = F.when(F.col("ascending"), F.col("lat_min")).otherwise(180 - F.col("lat_max"))
    hi = F.when(F.col("ascending"), F.col("lat_max")).otherwise(180 - F.col("lat_min"))
    known = ranges.where(F.col("lon_min").isNotNull() & F.col("lon_max").isNotNull())
    seen = known.select("area_id", by, F.explode(bins).alias("_bin"), F.struct(F.col("lon_min").alias("a"), F.col("lon_max").alias("b"), lo.alias("lo"), hi.alias("hi")).alias("r"))
    seen = seen.groupBy("area_id", by, "_bin").agg(F.collect_list("r").alias("_seen"))

    def meets(r: Column) -> Column:
        x = F.col("crossing_lon")
        inside = F.when(r["a"] <= r["b"], (x >= r["a"]) & (x <= r["b"])).otherwise((x >= r["a"]) | (x <= r["b"]))
        lat = F.lit(False)
        for turn in (-360, 0, 360):
            lat = lat | ((F.col("start_clat") <= r["hi"] + turn) & (F.col("end_clat") >= r["lo"] + turn))
        return inside & lat

    both = granules.withColumn("_bin", at("crossing_lon")).join(seen, [by, "_bin"])
    return both.where(F.exists("_seen", meets)).select("area_id", *granules.columns)
