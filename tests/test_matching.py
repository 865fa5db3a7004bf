"""Subscriptions as data and access rules by kind, against brute force."""

import datetime as dt
import random

from pyspark.sql import functions as F

from catalograph.functions import numbers as nu
from catalograph.operators import access as ac, joins as jn

D = dt.datetime
ATOMS = f"concept_id long, subscriber_id string, collection_id string, atoms array<{jn.ATOM}>, last_notified_at timestamp_ntz"
CHANGES = "concept_id string, collection_id string, revision_date timestamp_ntz, platform string, tags array<string>, cloud double, size int"


def test_cells_meet_exactly_in_ranges(spark):
    rng = random.Random(0)
    numbers = [0.0, -0.0, 1.0, 4.0**15, -(4.0**15), 1e13, -1e13, 1e300] + [rng.uniform(-1, 1) * 10 ** rng.randint(-6, 11) for _ in range(60)]
    ranges = [(None, None), (None, 5.0), (-3.0, None), (2.0, 2.0), (3.0, 2.0), (-1e13, 0.0)] + [tuple(sorted(rng.sample(numbers, 2))) for _ in range(60)] + [(x, x + abs(x) * 1e-7) for x in numbers]
    x = spark.createDataFrame([(i, v) for i, v in enumerate(numbers)], "i int, x double").withColumn("c", F.explode(nu.point_cells(F.col("x"))))
    r = spark.createDataFrame([(j, *v) for j, v in enumerate(ranges)], "j int, low double, high double")
    cells = r.withColumn("c", F.explode(nu.range_cells(F.col("low"), F.col("high"))))
    assert cells.groupBy("j").count().agg(F.max("count")).first()[0] <= 2
    got = sorted((m["i"], m["j"]) for m in x.join(cells, "c").where("(low is null or x >= low) and (high is null or x <= high)").collect())
    assert got == sorted((i, j) for i, v in enumerate(numbers) for j, (a, b) in enumerate(ranges) if (a is None or v >= a) and (b is None or v <= b))


def _atom(rng):
    kind = rng.randrange(5)
    low = rng.choice([None, rng.uniform(0, 50)])
    high = rng.choice([None, (low or 0) + rng.choice([0.001, 5.0, 60.0])])
    return [("platform", rng.choice(["Terra", "AQUA", "x"]), None, None), ("tags", rng.choice(["a", "B", "c"]), None, None), ("cloud", None, low, high), ("size", None, low, high), ("absent", rng.choice(["v", None]), None, 1.0)][kind]


def _subscriptions(rng, n):
    rows = [(i, "u", rng.choice(["C", "C", "C", "D", "E"]), rng.choice([None, [], *[[_atom(rng) for _ in range(rng.randint(1, 3))] for _ in range(4)]]), rng.choice([None, D(2020, 1, 5)])) for i in range(n)]
    return rows + rows[:7]  # equal rows


def _changes(rng, n):
    rows = [(f"G{i}", rng.choice(["C", "D", "F"]), D(2020, 1, rng.randint(1, 9)), rng.choice(["terra", "Aqua", None]), rng.choice([None, [], ["A", "a"], ["b", None, "C"]]), rng.choice([None, rng.uniform(0, 100)]), rng.randint(0, 60)) for i in range(n)]
    return rows + rows[:5]


def _meets(change, sub):
    row = dict(zip(("concept_id", "collection_id", "revision_date", "platform", "tags", "cloud", "size"), change))
    if row["collection_id"] != sub[2] or (sub[4] and row["revision_date"] <= sub[4]):
        return False
    for field, value, low, high in sub[3] or []:
        x = row.get(field)
        if value is not None:
            own = x if isinstance(x, list) else [x]
            if not isinstance(x, (str, list)) or value.lower() not in [v.lower() for v in own if v is not None]:
                return False
        elif not isinstance(x, (int, float)) or (low is not None and x < low) or (high is not None and x > high):
            return False
    return True


def test_subscriptions_against_brute_force(spark):
    rng = random.Random(5)
    subs, changes = _subscriptions(rng, 150), _changes(rng, 90)
    got = jn.match_subscriptions(spark.createDataFrame(changes, CHANGES), spark.createDataFrame(subs, ATOMS))
    want = sorted((c[0], s[0]) for c in changes for s in subs if _meets(c, s))
    assert sorted((r["concept_id"], r["subscription_id"]) for r in got.collect()) == want and len(want) > 500


def test_many_subscriptions_of_one_collection(spark):
    """A hundred thousand subscriptions to a collection: only those that a change meets are looked at."""
    n = 100_000
    i = F.col("id")
    atoms = F.when(i % 2 == 0, F.array(F.struct(F.lit("platform").alias("field"), F.concat(F.lit("P"), i).alias("value"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))))
    atoms = atoms.otherwise(F.array(F.struct(F.lit("cloud").alias("field"), F.lit(None).cast("string").alias("value"), i.cast("double").alias("low"), (i + 1.5).alias("high"))))
    subs = spark.range(n).select(i.alias("concept_id"), F.lit("u").alias("subscriber_id"), F.lit("C").alias("collection_id"), atoms.alias("atoms"), F.lit(None).cast("timestamp_ntz").alias("last_notified_at"))
    changes = spark.createDataFrame([(f"G{k}", "C", D(2020, 1, 1), f"p{2 * k}", None, 2.0 * k + 1.25, 1) for k in range(2000)], CHANGES)
    found = jn.match_subscriptions(changes, subs).cache()
    assert found.count() == 4000 and {r["subscription_id"] for r in found.where("concept_id = 'G7'").collect()} == {14, 15}
    found.unpersist()


RULES = "acl_id long, provider_id string, entry_titles array<string>, concept_ids array<string>, access struct<min:double,max:double,include_undefined:boolean>, temporal struct<start:timestamp_ntz,stop:timestamp_ntz,mask:string>, permissions array<struct<group_id:string,user_type:string,grants array<string>>>"
RULES = RULES.replace("grants array", "grants:array")
RECORDS = "concept_id string, provider_id string, entry_title string, access_value double, start_date timestamp_ntz, end_date timestamp_ntz"


def test_rules_against_brute_force(spark):
    rng = random.Random(2)
    day = lambda: D(2000, 1, 1) + dt.timedelta(days=rng.randrange(900))
    pick = lambda some: rng.choice([None, None, rng.sample(some, rng.randint(0, 3))])
    rules = []
    for k in range(140):
        low = rng.choice([None, rng.uniform(0, 5)])
        access = rng.choice([None, (low, rng.choice([None, (low or 0) + rng.uniform(0, 3)]), rng.choice([None, True, False]))])
        a = day()
        temporal = rng.choice([None, (a, a + dt.timedelta(days=rng.randrange(-5, 300)), rng.choice(["intersect", "disjoint", "contains", None]))])
        rules.append((k, rng.choice("PQ"), pick(["t1", "t2", "t3", "t4"]), pick([f"G{i}" for i in range(8)]), access, temporal, []))
    records = [(f"G{i}", rng.choice("PQR"), rng.choice(["t1", "t2", "t9", None]), rng.choice([None, rng.uniform(0, 8)]), rng.choice([None, a := day()]), rng.choice([None, a + dt.timedelta(days=rng.randrange(-3, 400))])) for i in range(60)]
    now = D(2003, 1, 1)

    def ok(x, r):
        _, p, titles, ids, access, t, _ = r
        if x[1] != p or not ((titles is None and ids is None) or x[2] in (titles or []) and x[2] is not None or x[0] in (ids or [])):
            return False
        low, high, undefined = access or (None, None, None)
        if (low, high, undefined) != (None, None, None):
            if x[3] is None:
                if not undefined:
                    return False
            elif (low is None and high is None) or (low is not None and x[3] < low) or (high is not None and x[3] > high):
                return False
        if t and t[2]:
            if x[4] is None:
                return False
            end = x[5] or now
            meets, inside = x[4] <= t[1] and end >= t[0], t[0] <= x[4] <= t[1] and t[0] <= end <= t[1]
            return {"intersect": meets, "disjoint": not meets, "contains": inside}[t[2]]
        return True

    got = ac.rules_for(spark.createDataFrame(records, RECORDS), spark.createDataFrame(rules, RULES), now=now)
    want = sorted((x[0], r[0]) for x in records for r in rules if ok(x, r))
    assert sorted((r["concept_id"], r["acl_id"]) for r in got.collect()) == want and len(want) > 300


def test_many_rules_of_one_provider(spark):
    """Ten thousand rules of a provider, for titles, ids and ranges, give out only what they match."""
    none = "cast(null as struct<start:timestamp_ntz,stop:timestamp_ntz,mask:string>)"
    rules = spark.range(10_000).selectExpr(
        "id as acl_id", "'P' as provider_id", "case when id % 3 = 0 then array('t' || id) end as entry_titles", "case when id % 3 = 1 then array('G' || id) end as concept_ids",
        "case when id % 3 = 2 then named_struct('min', cast(id as double), 'max', id + 0.5, 'include_undefined', false) end as access", f"{none} as temporal", "array(named_struct('group_id', 'g', 'user_type', cast(null as string), 'grants', array('read'))) as permissions",
    )
    records = spark.range(3000).selectExpr("'G' || id as concept_id", "'P' as provider_id", "'t' || id as entry_title", "id + 0.25 as access_value", "cast(null as timestamp_ntz) as start_date", "cast(null as timestamp_ntz) as end_date")
    found = ac.rules_for(records, rules)
    assert found.count() == 3000 and found.where("substr(concept_id, 2) <> acl_id").count() == 0
    assert ac.permitted(records, rules, ["g"]).count() == 3000 and ac.permitted(records, rules, ["h"]).count() == 0


def test_changes_are_dealt_to_what_is_asked_for(spark):
    """Changes go to the keys that their collection's subscriptions have and to no others; a large collection's changes are split."""
    changes = spark.createDataFrame([(i % 2, i, float(i % 50), "abc"[i % 3]) for i in range(3000)], "collection_id long, k long, x double, name string")
    changes = changes.withColumn("revision_date", F.lit("2024-01-01").cast("timestamp_ntz"))
    some = [(i, "u", 0, [("x", None, float(i % 50), None)] if i % 3 else [("name", "B", None, None)], None) for i in range(1200)] + [(5000, "u", 1, [("x", None, 10.0, 12.0)], None)]
    found = jn.match_subscriptions(changes, spark.createDataFrame(some, ATOMS))
    want = sum(1 for i in range(3000) if i % 2 == 0 for s in range(1200) if (i % 50 >= s % 50 if s % 3 else "abc"[i % 3] == "b")) + sum(1 for i in range(3000) if i % 2 and 10 <= i % 50 <= 12)
    assert found.count() == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(flatten(") == 1  # once, not once for each kind of key
    assert "_part" in plan


def test_equal_subscriptions_meet_a_change_once(spark, monkeypatch):
    """Subscriptions that ask for the same are a few rows of the index, all given out; many changes of a collection are split even for one subscription."""
    sides, spread = [], getattr(jn, "spread", None)
    monkeypatch.setattr(jn, "spread", lambda df, *by: (sides.append(df), spread(df, *by))[1], raising=False)
    monkeypatch.setattr(jn, "BATCH", 100, raising=False)
    ranges = [[("x", None, 10.0, None), ("x", None, None, 12.0), ("name", "B", None, None)], [("x", None, None, None), ("name", "a", None, None), ("name", "A", None, None)], [("name", "a", None, None), ("name", "b", None, None)], [("x", "1", None, None)]]
    some = [(i % 1900, "u", i % 2, ranges[i // 2 % 4], None) for i in range(2000)]
    changes = spark.createDataFrame([(0, i, float(i % 50) if i % 7 else None, "abc"[i % 3]) for i in range(1000)], "collection_id long, k long, x double, name string")
    changes = changes.withColumn("revision_date", F.lit("2024-01-01").cast("timestamp_ntz"))
    found = jn.match_subscriptions(changes, spark.createDataFrame(some, ATOMS.replace("collection_id string", "collection_id long")))
    want = [(i, s[0]) for i in range(1000) for s in some if s[2] == 0 and i % 7 and (s[3] is ranges[0] and 10 <= i % 50 <= 12 and i % 3 == 1 or s[3] is ranges[1] and i % 3 == 0)]
    assert sorted((r["k"], r["subscription_id"]) for r in found.collect()) == sorted(want) and len(want) > 10_000
    index, dealt = sides
    assert index.select("_part").distinct().count() >= 10 and index.where("_part = 0").count() <= 8
