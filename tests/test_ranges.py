"""Joins of time ranges and of crossing longitudes against brute force."""

import datetime as dt
import random
import time

import pytest

from catalograph.operators import joins as jn, orbit as ob
from catalograph.plans import QUERIES, SQL

D = dt.datetime


def _frames(spark, left, right):
    return spark.createDataFrame(left, "i int, start_date timestamp_ntz, end_date timestamp_ntz"), spark.createDataFrame(right, "j int, from_date timestamp_ntz, to_date timestamp_ntz")


def _some(rng, n, base, most):
    out = []
    for i in range(n):
        a = base + dt.timedelta(hours=rng.randrange(24 * 900))
        e = rng.choice([None, a, a + dt.timedelta(hours=rng.randrange(24 * most)), a + dt.timedelta(days=rng.randrange(3000)), D(9999, 12, 31), a - dt.timedelta(days=1)])
        out.append((i, None if rng.random() < 0.05 else a, e))
    return out


@pytest.mark.parametrize("inclusive", [True, False])
def test_time_ranges(spark, inclusive):
    rng = random.Random(7)
    left, right = _some(rng, 90, D(1999, 6, 1), 40), _some(rng, 80, D(2000, 1, 1), 5)
    left += left[:6] + [(500, D(1, 1, 1), D(1, 1, 2)), (501, D(1, 1, 1), None), (502, D(2000, 1, 1), D(2000, 1, 1))]  # equal rows, the earliest day, an instant
    right += right[:4] + [(600, D(2000, 1, 1), D(2000, 1, 1)), (601, D(9999, 12, 31), None)]

    def meet(x, y):
        if x[1] is None or y[1] is None or (x[2] and x[2] < x[1]) or (y[2] and y[2] < y[1]):
            return False
        pairs = [(x[1], y[2]), (y[1], x[2])]
        return all(e is None or (s <= e if inclusive else s < e) for s, e in pairs)

    l, r = _frames(spark, left, right)  # noqa: E741
    got = sorted((x["i"], x["j"]) for x in jn.temporal_join(l, r, inclusive=inclusive).collect())
    assert got == sorted((x[0], y[0]) for x in left for y in right if meet(x, y))
    assert jn.temporal_join(l.limit(0), r).count() == 0 == jn.temporal_join(l, r.limit(0)).count()


def test_open_rows_do_not_ask_for_the_latest_time(spark):
    """Open rows take as many rows of the join whether the other side ends in 2001 or in 9999."""
    left = [(i, D(2000, 1, 1) + dt.timedelta(minutes=i), None) for i in range(20_000)]
    took, nodes = [], []
    for end in (D(2001, 1, 1), D(9999, 12, 31)):
        l, r = _frames(spark, left, [(1, D(2000, 6, 1), end)])  # noqa: E741
        began = time.time()
        assert jn.temporal_join(l, r).count() == 20_000
        took.append(time.time() - began)
        nodes.append(l.select(jn.F.size(jn._since(jn._day("start_date"))).alias("n")).agg(jn.F.max("n")).first()[0])
    assert nodes[0] == nodes[1] <= 3 * jn.DEPTH + 1
    assert took[1] < 3 * took[0] + 2


def test_pairs_of_one_day_are_many_tasks(spark, monkeypatch):
    """All ranges on one day, closed and open: no task forms most of the pairs; equal rows, a column that must be equal, and sides of times only."""
    for name, value in (("SIDE", 200), ("HEAP", 7)):
        monkeypatch.setattr(jn, name, value, raising=False)
    left = [(i % 900, D(2000, 1, 1), D(2000, 1, 2) if i % 3 else None) for i in range(1000)]
    right = [(j % 700, D(2000, 1, 1), D(2000, 1, 3) if j % 5 else None) for j in range(800)]
    l, r = _frames(spark, left, right)  # noqa: E741
    tasks = jn.temporal_join(l, r).groupBy(jn.F.spark_partition_id()).count().collect()
    assert sum(x["count"] for x in tasks) == 800_000 and max(x["count"] for x in tasks) < 400_000
    assert jn.temporal_join(l.drop("i"), r.drop("j")).count() == 800_000
    l, r = l.withColumn("p", jn.F.expr("nullif(i % 4, 3)")), r.withColumn("q", jn.F.expr("nullif(j % 4, 3)"))
    got = sorted((x["i"], x["j"]) for x in jn.temporal_join(l, r, by=("p", "q")).collect())
    assert got == sorted((i, j) for i, _, _ in left for j, _, _ in right if i % 4 == j % 4 != 3)


def test_crossing_longitudes(spark):
    """Several ranges of an area, both directions, wrapped ranges, equal granules: one row for each granule and area."""
    rng = random.Random(1)
    ranges = []
    for area in range(4):
        for up in (True, False):
            for _ in range(rng.randrange(4)):
                a = rng.uniform(-180, 180)
                ranges.append((f"A{area}", rng.choice(["C", "D"]), up, a, (a + rng.uniform(0, 120) + 180) % 360 - 180, -10.0 + area * 5, 10.0 + area * 5))
    ranges += [("A0", "C", True, -180.0, 180.0, -5.0, 5.0), ("A0", "C", True, -180.0, 180.0, -5.0, 5.0), ("A9", "C", True, None, None, 0.0, 1.0)]
    granules = [(rng.choice(["C", "D", "E"]), k, rng.choice([-180.0, 180.0, rng.uniform(-180, 180)]), (s := rng.uniform(-90, 270)), s + rng.uniform(0, 60)) for k in range(150)]
    granules += granules[:20] + granules[:5] + [("C", 900, None, 0.0, 10.0)]
    g = spark.createDataFrame(granules, "collection_id string, k int, crossing_lon double, start_clat double, end_clat double")
    r = spark.createDataFrame(ranges, "area_id string, collection_id string, ascending boolean, lon_min double, lon_max double, lat_min double, lat_max double")

    def sees(x, y):
        if x[0] != y[1] or x[2] is None or y[3] is None:
            return False
        inside = y[3] <= x[2] <= y[4] if y[3] <= y[4] else x[2] >= y[3] or x[2] <= y[4]
        lo, hi = (y[5], y[6]) if y[2] else (180 - y[6], 180 - y[5])
        return inside and any(x[3] <= hi + t and x[4] >= lo + t for t in (-360, 0, 360))

    want = sorted((a, x[1]) for x in granules for a in {y[0] for y in ranges} if any(y[0] == a and sees(x, y) for y in ranges))
    assert sorted((x["area_id"], x["k"]) for x in ob.orbit_join(g, r).collect()) == want and len(want) > len(set(want)) > 15


def test_orbits_are_searched_once_for_all_their_collections(spark, monkeypatch):
    """What granules meet has a row for each different orbit, not for each collection; granules of several or unknown orbits are right."""
    met, join = [], ob.orbit_join
    monkeypatch.setattr(ob, "orbit_join", lambda g, r, *by: (met.append(r), join(g, r, *by))[1])
    QUERIES["jn15_orbit_join"](spark, "/root/testdata/sf0.001")
    key = next(c for c in met[0].columns if c in ("collection_id", "_orbits"))
    assert met[0].select(key).distinct().count() <= 50  # sizes of parts; there are 200 parts
    rng = random.Random(3)
    kinds = [(94.0, 96.7, 300.0), (94.0, 96.7, 600.0), (60.0, 100.0, 300.0), (-0.0, 96.7, 300.0), (94.0, None, 300.0), (94.0, 96.7, 0.0)]
    orbits = [(c, *kinds[c % 6]) for c in range(24)] + [(0, *kinds[1]), (0, *kinds[1]), (1, *kinds[2]), (4, *kinds[0]), (None, *kinds[0])]
    granules = [(rng.choice([*range(26), None]), k, rng.uniform(-180, 180), -20.0, 100.0) for k in range(3000)]
    granules += granules[:1000]
    areas = spark.createDataFrame([(a, [(x, 10.0), (x + 8, 10.0), (x + 8, 16.0), (x, 16.0), (x, 10.0)]) for a, x in enumerate((-60.0, 175.0))], "area_id int, ring array<struct<lon:double,lat:double>>")
    g = spark.createDataFrame(granules, "collection_id int, k int, crossing_lon double, start_clat double, end_clat double")
    o = spark.createDataFrame(orbits, "collection_id int, inclination double, period double, swath_width double")
    got = ob.orbit_search(g, areas, o)
    assert got.columns == ["area_id", *g.columns]
    rows = sorted((r["area_id"], r["k"]) for r in got.collect())
    assert rows == sorted((r["area_id"], r["k"]) for r in join(g, ob.crossing_ranges(areas, o)).collect()) and len(rows) > len(set(rows)) > 30 and {r[0] for r in rows} == {0, 1}


def test_overlaps_counted_without_pairs(spark):
    """As many as the join pairs, of odd ranges too, and no row is dealt to nodes or paired."""
    rng = random.Random(11)
    left, right = _some(rng, 150, D(1999, 6, 1), 40), _some(rng, 120, D(2000, 1, 1), 5)
    left += left[:9] + [(501, D(1, 1, 1), None), (502, D(2000, 1, 1), D(2000, 1, 1))]
    right += [(600, D(2000, 1, 1), D(2000, 1, 1)), (601, D(9999, 12, 31), None)]
    l, r = _frames(spark, left, right)  # noqa: E741
    pairs = {x["j"]: x["count"] for x in jn.temporal_join(l, r).groupBy("j").count().collect()}
    counted = jn.overlap_counts(l, r)
    assert {x["j"]: x["n"] for x in counted.collect()} == {j: pairs.get(j, 0) for j, _, _ in right}
    assert jn.overlap_counts(l.limit(0), r).where("n <> 0").count() == 0
    plan = QUERIES["jn16_overlap_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_large_sides_are_not_broadcast(spark):
    """Sizes that the optimizer guesses don't count the nodes; only quarters, which are few, are broadcast, and then granules aren't shuffled."""
    def plan(name):
        return QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()

    assert "Broadcast" not in plan("jn16_temporal_join_whole")
    few = plan("jn16_temporal_join")
    assert "SortMergeJoin" not in few and not [x for x in few.splitlines() if "Exchange hashpartitioning(_key" in x or "Exchange hashpartitioning(_rkey" in x]


def test_merged_ranges_of_equal_times_by_sql():
    """The SQL orders rows once: two windows that each break ties as they like can put one of two equal ranges into the island before."""
    assert SQL["wn7_merge_ranges"].count("ORDER BY start_date") == 1
    assert SQL["wn7_merge_ranges"].count("ORDER BY i ROWS") == 2
