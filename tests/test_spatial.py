"""Boxes, rings, tiles, joins, orbits."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalograph.functions import boxes as bx, relations as rl, shapes as sh
from catalograph.operators import orbit as ob, spatial as sp
from catalograph.plans import QUERIES

NORTH = [(0, 60), (90, 60), (180, 60), (-90, 60), (0, 60)]
SOUTH = [(0, -60), (-90, -60), (180, -60), (90, -60), (0, -60)]
ANTI = [(170, -10), (-170, -10), (-170, 10), (170, 10), (170, -10)]
PLAIN = [(10, 10), (30, 10), (30, 30), (10, 30), (10, 10)]
HOLE = [(18, 18), (18, 22), (22, 22), (22, 18), (18, 18)]


@pytest.mark.parametrize(
    "ring, inside, outside",
    [(NORTH, [(30, 80), (-150, 89), (12, 90)], [(30, 20), (0, -90), (10, 22)]), (SOUTH, [(30, -80), (0, -90)], [(0, 90), (10, 22)]), (ANTI, [(180, 0), (-180, 5), (175, -9)], [(160, 0), (0, 0), (-160, 5)]), (PLAIN, [(10, 22), (20, 20), (10, 10)], [(9, 20), (-160, -20), (31, 20)])],
)
def test_points_in_geodetic_rings(ring, inside, outside):
    assert all(sh.geodetic_covers(ring, p) for p in inside)
    assert not any(sh.geodetic_covers(ring, p) for p in outside)


def test_small_rings_agree():
    rng = random.Random(4)
    for _ in range(400):
        c = (rng.uniform(-150, 150), rng.uniform(-50, 50))
        angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(7))
        ring = [(c[0] + 0.02 * math.cos(a), c[1] + 0.02 * math.sin(a)) for a in angles]
        ring.append(ring[0])
        p = (c[0] + rng.uniform(-0.01, 0.01), c[1] + rng.uniform(-0.01, 0.01))
        if max(b - a for a, b in zip(angles, angles[1:] + [angles[0] + 2 * math.pi])) < 2.5:
            assert sh.geodetic_covers(ring, p) == sh.cartesian_covers(ring, p)


def test_shape_boxes_reach_past_their_ends():
    w, n, e, s = sh.shape_box([[(-60, 50), (60, 50)]], "geodetic")
    assert n > 60 and (w, e, s) == (-60, 60, pytest.approx(50))
    assert sh.shape_box([NORTH], "geodetic")[:3] == (-180.0, 90.0, 180.0)
    assert sh.shape_box([ANTI], "geodetic")[0::2] == (170.0, -170.0)


@pytest.mark.parametrize("kind, rings, want", [("polygon", [[(0, 0), (1, 1), (1, 0), (0, 1), (0, 0)]], "ring crosses itself"), ("polygon", [[(0, 0), (1, 0), (1, 1)]], "ring is not closed"), ("line", [[(0, 0), (0, 0)]], "duplicate points"), ("line", [[(0, 0), (180, 0)]], "consecutive antipodal points"), ("point", [[(200, 0)]], "coordinates out of bounds"), ("circle", [[(0, 90)]], "circle centre on a pole")])
def test_shape_errors(kind, rings, want):
    assert want in sh.shape_errors(kind, "geodetic" if kind == "line" else "cartesian", rings)


def box(*v):
    return bx.box(*[F.lit(float(x)) for x in v])


def ask(spark, c):
    return spark.range(1).select(c).first()[0]


def test_boxes(spark):
    anti, pole, world = box(170, 10, -170, -10), box(45, 90, 55, 70), box(-180, 90, 180, -90)
    points = [(anti, 180, 0, True), (anti, -175, 5, True), (anti, 0, 0, False), (pole, 0, 90, True), (pole, 50, 80, True), (pole, 60, 80, False), (world, 10, 22, True)]
    assert [ask(spark, bx.box_covers_point(b, F.lit(float(x)), F.lit(float(y)))) for b, x, y, _ in points] == [p[3] for p in points]
    pairs = [(anti, box(-175, 0, -160, -5)), (pole, box(-100, 90, -90, 80)), (anti, box(0, 5, 10, 0)), (anti, world)]
    got = [ask(spark, bx.box_intersects(a, b)) for a, b in pairs]
    assert got == [True, True, False, True] == [ask(spark, bx.box_intersects(b, a)) for a, b in pairs]
    assert tuple(ask(spark, bx.box_union(box(170, 5, 175, 0), box(-178, 2, -170, -3)))) == (170.0, 5.0, -170.0, -3.0)
    assert ask(spark, bx.box_world_share(world)) == pytest.approx(100) and ask(spark, bx.box_world_share(box(-180, 90, 180, 0))) == pytest.approx(50)
    assert ask(spark, bx.box_covers_box(anti, box(175, 5, -175, -5))) and not ask(spark, bx.box_covers_box(box(0, 5, 10, 0), anti))


def test_circles(spark):
    ring = ask(spark, bx.circle_to_polygon(F.lit(179.5), F.lit(10.0), F.lit(100000.0), 32))
    assert len(ring) == 33 and ring[0] == ring[-1] and all(-180 <= p["lon"] <= 180 for p in ring)
    far = [ask(spark, bx.distance(F.lit(179.5), F.lit(10.0), F.lit(p["lon"]), F.lit(p["lat"]))) for p in ring[:4]]
    assert all(abs(d * 6378137 / 6367435 - 100000) < 1 for d in far)
    assert sh.geodetic_covers([(p["lon"], p["lat"]) for p in ring], (-179.9, 10.1))


def test_spatial_join_equals_brute_force(spark):
    rng = random.Random(5)

    def some(n):
        out = []
        for i in range(n):
            w, s = rng.uniform(-180, 180), rng.uniform(-90, 80)
            e, n_ = w + rng.uniform(0, 60), min(90.0, s + rng.uniform(0, 30))
            out.append((i, (w, n_ if i % 7 else 90.0, e - 360 if e > 180 else e, s)))
        return out

    def meets(a, b):
        if (a[1] == b[1] == 90) or (a[3] == b[3] == -90):
            return True
        parts = lambda q: [(q[0], q[2])] if q[0] <= q[2] else [(q[0], 180), (-180, q[2])]
        return a[3] <= b[1] and b[3] <= a[1] and any(p[0] <= q[1] and q[0] <= p[1] for p in parts(a) for q in parts(b))

    left, right = some(80), some(60)
    t = "struct<west:double,north:double,east:double,south:double>"
    got = sp.spatial_join(spark.createDataFrame(left, f"i int, box {t}"), spark.createDataFrame(right, f"j int, area_box {t}"))
    assert sorted((r["i"], r["j"]) for r in got.collect()) == sorted((i, j) for i, a in left for j, b in right if meets(a, b))


@pytest.mark.parametrize("few,heap,deals", [(10_000, 65_536, 64), (0, 7, 3)])
def test_equal_boxes_meet_once(spark, monkeypatch, few, heap, deals):
    """Many rows with few boxes, equal rows, nulls and poles give all pairs; boxes meet before their rows do, and pairs are dealt."""
    for name, value in (("FEW", few), ("HEAP", heap), ("DEALS", deals)):
        monkeypatch.setattr(sp, name, value, raising=False)
    t = "struct<west:double,north:double,east:double,south:double>"
    boxes = [(170.0, 10.0, -170.0, -10.0), (-180.0, 90.0, 180.0, -90.0), (0.0, 5.0, 3.0, 1.0), (-0.0, 5.0, 3.0, 1.0), (20.0, 90.0, 30.0, 80.0), (50.0, 50.0, 51.0, 49.0), None, (1.0, None, 2.0, 0.0)]
    right = [(j % 40, boxes[j % 8]) for j in range(300)]
    left = [(i % 90, (w := float(i * 7 % 350 - 178), 90.0 if i % 11 == 0 else w / 2 + 1, w + 2, w / 2)) for i in range(100)] + [(500, None)]

    def meets(a, b):
        if a is None or b is None or None in b:
            return False
        if a[1] == b[1] == 90 or a[3] == b[3] == -90:
            return True
        parts = lambda q: [(q[0], q[2])] if q[0] <= q[2] else [(q[0], 180), (-180, q[2])]
        return a[3] <= b[1] and b[3] <= a[1] and any(p[0] <= q[1] and q[0] <= p[1] for p in parts(a) for q in parts(b))

    df = sp.spatial_join(spark.createDataFrame(left, f"i int, box {t}"), spark.createDataFrame(right, f"j int, area_box {t}"))
    assert df.columns == ["i", "box", "j", "area_box"]
    got = sorted((r["i"], r["j"]) for r in df.collect())
    assert got == sorted((i, j) for i, a in left for j, b in right if meets(a, b)) and len(got) > len(set(got)) > 100
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 2 and "partial_count" in plan and "ShuffledHashJoin" in plan


def test_pairs_of_a_box_are_written_small(spark, tmp_path, monkeypatch):
    """Written pairs have runs of a left row and short cycles of right ones: under a byte each, and no column of plain values."""
    monkeypatch.setattr(sp, "DEALS", 4)  # as many left rows of a deal as in large tables
    t = "struct<west:double,north:double,east:double,south:double>"
    box = lambda k: F.struct((k * 20 - 100.0).alias("west"), F.lit(10.0).alias("north"), (k * 20 - 90.0).alias("east"), F.lit(0.0).alias("south")).cast(t)
    i = F.col("id")
    left = spark.range(1500).select((i * 7919).alias("i"), box(i % 10).alias("box"))
    right = spark.range(40_000).select((i * 104_729).alias("j"), box(i % 10).alias("area_box"))
    out = sp.spatial_join(left, right).select("i", "j")
    out.write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert tuple(got.agg(F.count("*"), F.count_distinct("i"), F.count_distinct("j"), F.count_distinct(F.expr("i / 7919 % 10 - j / 104729 % 10"))).first()) == (6_000_000, 1500, 40_000, 1)
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 6_000_000


def test_tiles(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5), (2, -179.0, 89.0), (3, 100.0, -45.0)], "id int, lon double, lat double")
    df = df.withColumn("shape", sp.point_shape(F.col("lon"), F.col("lat"))).withColumn("t", sp.tile_of(F.col("lon"), F.col("lat")))
    for r in sp.assign_tiles(df).collect():
        assert r["t"] in r["tiles"]


def test_swaths_of_many_passes_at_once():
    """Each ring of a batch is what the pass alone gives, with none, one and several revolutions."""
    rng = random.Random(8)
    passes = [(rng.uniform(-180, 180), rng.uniform(60, 120), 96.7, rng.uniform(50, 2000), t := rng.uniform(-3000, 3000), t + rng.choice([0, 299, 300, 301, 1800, 5802, 5803, 20000, -5])) for _ in range(60)]
    own, size, points = ob.swaths(*zip(*passes))
    rings = np.split(points, np.cumsum(size)[:-1])
    for i, (lon, inc, period, width, a, b) in enumerate(passes):
        mine = [r for r, k in zip(rings, own) if k == i]
        assert len(mine) == max(0, math.ceil((b - a) / (period * 60) - 1e-12))
        for turn, ring in enumerate(mine):
            start = a + turn * period * 60
            stop = min(start + period * 60, b)
            n = (len(ring) - 1) // 2
            assert n == math.ceil((stop - start) / 300 - 1e-9) + 1 and (ring[0] == ring[-1]).all()
            for k, t in enumerate([*np.arange(start, stop - 1e-6, 300), stop]):
                here = ob._unit(*ob.track(lon, inc, period * 60, np.array([t])))[0]
                for p in (ring[k], ring[2 * n - 1 - k]):  # both edges lie half a swath off the track
                    assert np.arccos(np.clip(ob._unit(*p) @ here, -1, 1)) * ob.EARTH_M == pytest.approx(width * 500, rel=1e-3)


def test_swath_column(spark):
    import datetime as dt

    t = dt.datetime(2020, 1, 1)
    df = spark.createDataFrame([(1, 10.0, t, t, t + dt.timedelta(hours=4), 94.0, 96.7, 400.0), (2, None, t, t, t, 94.0, 96.7, 400.0), (3, 10.0, t, t, t, 94.0, 96.7, 400.0)], "k int, crossing_lon double, crossing_time timestamp_ntz, start_date timestamp_ntz, end_date timestamp_ntz, inclination double, period double, swath_width double")
    a, b, c = ob.swath_polygons(df).orderBy("k").collect()
    assert [[tuple(p) for p in r] for r in a["swath"]] == ob.swath_rings(10.0, 94.0, 96.7, 400.0, 0, 4 * 3600) and len(a["swath"]) == 3
    assert b["swath"] is None and c["swath"] == []


def test_geojson_of_all_types(spark, tmp_path):
    """Each geometry type, rings turned, ids of the feature or its place; a file of features a line gives the same."""
    import json

    square, hole = [[0, 0], [0, 4], [4, 4], [4, 0], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]
    geometry = [
        ("Polygon", [square, hole]), ("MultiPolygon", [[square], [hole]]), ("LineString", [[0, 0], [1, 1, 9]]), ("MultiLineString", [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]),
        ("Point", [5, 6]), ("MultiPoint", [[5, 6], [7, 8]]), ("GeometryCollection", None),
    ]
    features = [{"type": "Feature", **({"id": f"f{i}"} if i % 2 else {}), "properties": {"a": "{"}, "geometry": {"type": t, "coordinates": c}} for i, (t, c) in enumerate(geometry)] + [{"type": "Feature", "geometry": None}]
    (tmp_path / "one.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(f) for f in features))
    (tmp_path / "single.json").write_text(json.dumps(features[1]))
    plain = lambda df: sorted((r["area_id"], r["shape"]["kind"], [[tuple(p) for p in ring] for ring in r["shape"]["rings"]]) for r in df.collect())
    got = plain(sp.read_areas(spark, str(tmp_path / "one.json")))
    turn = lambda ring: [tuple(map(float, p[:2])) for p in ring]
    ccw = turn(square[::-1])
    want = sorted([
        ("0", "polygon", [ccw, turn(hole[::-1])]), ("f1", "polygon", [ccw]), ("f1", "polygon", [turn(hole)]), ("2", "line", [[(0.0, 0.0), (1.0, 1.0)]]), ("f3", "line", [[(0.0, 0.0), (1.0, 1.0)]]), ("f3", "line", [[(2.0, 2.0), (3.0, 3.0)]]),
        ("4", "point", [[(5.0, 6.0)]]), ("f5", "point", [[(5.0, 6.0)]]), ("f5", "point", [[(7.0, 8.0)]]),
    ])
    assert got == want
    lines = plain(sp.read_areas(spark, str(tmp_path / "lines.json"), lines=True))
    assert [r[1:] for r in lines if r[0][0] == "f"] == [r[1:] for r in want if r[0][0] == "f"]
    assert plain(sp.read_areas(spark, str(tmp_path / "single.json"))) == [r for r in want if r[0] == "f1"]


def test_geojson_areas(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text('{"type":"FeatureCollection","features":[{"type":"Feature","id":"x","geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[0,1],[1,1],[1,0],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}},{"type":"Feature","geometry":null}]}')
    rows = sp.read_areas(spark, str(p)).collect()
    assert [r["area_id"] for r in rows] == ["x", "x"]
    ring = [(q["lon"], q["lat"]) for q in rows[0]["shape"]["rings"][0]]
    assert ring[1] == (1.0, 0.0)  # turned counter-clockwise


def test_simplify(spark):
    ring = [(math.cos(a), math.sin(a)) for a in np.linspace(0, 2 * math.pi, 400)]
    ring[-1] = ring[0]
    df = spark.range(1).select(sp.polygon(ring, "cartesian").alias("shape"))
    r = sp.simplify_areas(df, 60).first()
    assert r["simplified"] and 4 <= len(r["shape"]["rings"][0]) <= 60


def test_swath_holds_its_track():
    lon, lat = ob.track(20.0, 94.0, 96.7 * 60, np.array([0.0, 300.0, 600.0]))
    assert lat[0] == pytest.approx(0) and lon[0] == pytest.approx(20)
    ring = ob.swath_rings(20.0, 94.0, 96.7, 400.0, 0, 900)[0]
    assert sh.geodetic_covers(ring, (lon[1], lat[1])) or sh.geodetic_covers(ring[::-1], (lon[1], lat[1]))


def test_crossing_ranges_see_what_swaths_cover():
    """A pass sees a point if and only if its crossing lies in the range."""
    inc, period, width, p = 94.0, 96.7, 600.0, (30.0, 25.0)
    for up in (True, False):
        a, b = ob.crossing_range(*p, inc, period, width, up)
        t = np.linspace(-period * 15, period * 15, 3001) if up else np.linspace(period * 15, period * 45, 3001)
        half = math.degrees(width * 1000 / 2 / ob.EARTH_M)
        for lon in np.arange(-180, 180, 3.0):
            x, y = ob.track(lon, inc, period * 60, t)
            near = np.degrees(np.arccos(np.clip(ob._unit(x, y) @ ob._unit(*p), -1, 1))).min()
            inside = a <= lon <= b if a <= b else (lon >= a or lon <= b)
            if abs(near - half) > 0.2:
                assert inside == (near < half), (up, lon, near, half, a, b)
    assert ob.crossing_range(0, 89.9, 60.0, 96.7, 400.0, True) is None


def test_crossings_of_many_points_are_those_of_each():
    """A batch of points and orbits gives what each gives alone; ranges hold the tracks that come near, by distance."""
    rng = random.Random(11)
    rows = [(rng.uniform(-90, 90), rng.uniform(40, 140), rng.uniform(90, 110), rng.choice([5.0, 300.0, 2500.0]), rng.random() < 0.5) for _ in range(70)]
    a, b = ob.crossings(*zip(*rows))
    kinds = set()
    for k, (lat, inc, period, width, up) in enumerate(rows):
        got = ob.crossing_range(0.0, lat, inc, period, width, up)
        assert (got is None) == np.isnan(a[k]) and (got is None or got == pytest.approx((a[k], b[k]), abs=1e-9))
        top = min(inc, 180 - inc) + np.degrees(width * 500 / ob.EARTH_M)
        assert (got is None) == (abs(lat) > top) or abs(abs(lat) - top) < 0.05
        kinds.add(None if got is None else got == (-180.0, 180.0))
    assert kinds == {None, False, True} or kinds == {None, False}


def test_narrow_swaths_over_a_line(spark):
    """A 5 km swath misses no pass over a line, by the distance of tracks from the line."""
    line, inc, period, width = [(10.0, 20.0), (10.6, 20.0)], 94.0, 96.7, 5.0
    areas = spark.createDataFrame([("L", line)], "area_id string, ring array<struct<lon:double,lat:double>>")
    orbits = spark.createDataFrame([("C", inc, period, width)], "collection_id string, inclination double, period double, swath_width double")
    got = [(r["lon_min"], r["lon_max"]) for r in ob.crossing_ranges(areas, orbits).where("ascending").collect()]
    t = np.linspace(310.0, 345.0, 3501)
    x, y = ob.track(0.0, inc, period * 60, t)
    at = x[np.abs(y - 20.0).argmin()]
    dense = ob._unit(np.linspace(10.0, 10.6, 301), np.full(301, 20.0))
    half = width * 1000 / 2 / ob.EARTH_M
    for lon in np.linspace(9.9, 10.7, 60) - at:
        tx, ty = ob.track(lon, inc, period * 60, t)
        near = np.arccos(np.clip((ob._unit(tx, ty) @ dense.T).max(), -1, 1))
        if abs(near - half) > 0.1 * half:
            assert any(a <= lon <= b for a, b in got) == (near < half), (lon, near, half, got)


def test_points_beside_an_arc_are_not_on_it():
    """A point 5e-4 degrees outside a geodetic edge is outside, one on the edge inside."""
    ring = [(-30, -20), (40, -25), (50, 30), (0, 45), (-35, 20), (-30, -20)]
    assert not sh.geodetic_covers(ring, (34, 38))
    assert sh.geodetic_covers(ring, (34, 37.999))
    a, b = sh.vectors([(50, 30)])[0], sh.vectors([(0, 45)])[0]
    mid = (a + b) / np.linalg.norm(a + b)
    assert sh.on_arc(mid, a, b) and sh.on_arc(a, a, b) and sh.on_arc(a, a, a) and not sh.on_arc(-mid, a, b) and not sh.on_arc(-a, a, b)


def test_shapes_are_dealt_over_tasks_and_worked_out_once(spark):
    """A table in one part goes to several tasks, and equal shapes give equal results, nulls and other shapes between them."""
    one = spark.range(400).coalesce(1).selectExpr("id", "cast(id % 5 * 30 - 80 as double) as x", "cast(id % 3 * 20 - 40 as double) as y")
    assert sp.spread(one, "id").rdd.getNumPartitions() >= 16
    for name in ("sp8_box_meets_cap", "sp8_notch_and_hole", "sp8_polygons_meet", "sp8_antimeridian", "sp9_line_meets_box", "sp9_arcs_meet_box", "sp10_shape_box", "sp12_shape_errors", "sp16_simplify_areas", "jn17_tile_shapes"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan, name
    ring = "array(named_struct('lon', x, 'lat', y), named_struct('lon', x + 20, 'lat', y), named_struct('lon', x + 20, 'lat', y + 8), named_struct('lon', x, 'lat', y + 8), named_struct('lon', x, 'lat', y))"
    shaped = one.selectExpr("id", f"case when id % 7 <> 0 then named_struct('kind', 'polygon', 'coord_sys', case when id % 2 = 0 then 'cartesian' else 'geodetic' end, 'rings', array({ring})) end as shape")
    rows = sp.assign_tiles(shaped).select("id", "shape", "tiles").collect()
    assert len(rows) == 400 and {r["tiles"] is None for r in rows if r["id"] % 7 == 0} == {True}
    for r in rows:
        if r["tiles"] is not None:
            f = rl.Figure(r["shape"]["kind"], r["shape"]["coord_sys"], [[(p["lon"], p["lat"]) for p in g] for g in r["shape"]["rings"]])
            assert [36 * t["v"] + t["h"] for t in r["tiles"]] == list(sp.tiles_of(f))
    box = sp.polygon([(-30, -20), (40, -25), (50, 30), (0, 45), (-35, 20), (-30, -20)])
    met = {r["id"]: r["met"] for r in shaped.select("id", sp.shape_intersects(box, "shape").alias("met")).collect()}
    assert all((met[i] is None) == (i % 7 == 0) for i in met) and len({(i % 30, met[i]) for i in met if i % 7}) == 30


def test_results_kept_for_equal_shapes_are_those_asked_for():
    kept, calls = sp._Kept(2), []
    for k in (1, 1, 2, 3, 1):
        assert kept.of(k, lambda: calls.append(k) or k * 10) == k * 10 and len(kept) <= 2
    assert calls == [1, 2, 3, 1]
