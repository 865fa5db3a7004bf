"""Streams give what batches give."""

import datetime as dt
import json

from catalograph.operators.revisions import upsert_latest
from catalograph.streaming import events as st, targets as tg

SCHEMA = "concept_id string, revision_id int, deleted boolean, v string"
ROWS = [("a", 2, False, "a2"), ("b", 1, False, "b1"), ("a", 1, False, "a1"), ("b", 2, True, "b2"), ("c", 5, True, "c5"), ("c", 6, False, "c6"), ("a", 2, False, "a2")]


def _files(spark, tmp_path):
    src = str(tmp_path / "in")
    for r in ROWS:
        spark.createDataFrame([r], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    return src


def _table(spark, path, buckets=3):
    return tg.TargetTable(spark, str(path), spark.createDataFrame([], SCHEMA).schema, ["concept_id"], tg.newest(["concept_id"], "revision_id"), buckets)


def test_upsert_equals_batch(spark, tmp_path):
    src = _files(spark, tmp_path)
    target = _table(spark, tmp_path / "t")
    for _ in range(2):  # a restart finds nothing new
        st.stream_upsert(st.read_events(spark, src, target.schema, 2), target, str(tmp_path / "cp")).awaitTermination()
    want = upsert_latest(spark.createDataFrame([], SCHEMA), spark.createDataFrame(ROWS, SCHEMA), ["concept_id"], "revision_id")
    assert sorted(map(tuple, target.read().collect())) == sorted(map(tuple, want.collect()))
    before = target.version()
    target.apply(spark.createDataFrame([("z", 1, False, "z")], SCHEMA), before)
    assert target.read().count() == 3 and target.version() == before  # a batch that runs again changes nothing


def test_deletes_come_back(spark, tmp_path):
    src = _files(spark, tmp_path)
    target = _table(spark, tmp_path / "t")
    st.stream_upsert(st.read_events(spark, src, target.schema, 1), target, str(tmp_path / "cp")).awaitTermination()
    live, gone = st.live(target)
    assert sorted(r["v"] for r in live.collect()) == ["a2", "c6"] and [r["v"] for r in gone.collect()] == ["b2"]


def _size(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    """One percent of the keys costs about one percent of the bytes; other buckets' files stay as they are."""
    schema = "concept_id long, revision_id int, v string"
    keys = ["concept_id"]
    target = tg.TargetTable(spark, str(tmp_path / "t"), spark.createDataFrame([], schema).schema, keys, tg.newest(keys, "revision_id"), 4)
    from pyspark.sql import functions as F

    rows = lambda n, rev: spark.range(n).select(F.col("id").alias("concept_id"), F.lit(rev).alias("revision_id"), F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"-{rev}")), 512).alias("v"))
    target.apply(rows(100_000, 1), 0)
    base = _size(tmp_path / "t")
    target.apply(rows(1_000, 2), 1)
    assert _size(tmp_path / "t") - base < 0.02 * base
    assert target.read().groupBy("revision_id").count().orderBy("revision_id").collect() == [(1, 99_000), (2, 1_000)]
    target.apply(rows(500, 1), 2)  # late: loses
    assert target.read().where("revision_id = 2").count() == 1_000
    target.apply(rows(1, 3), 3)
    touched = [k for k, v in target.manifest()["buckets"].items() if "delta-3" in v]
    assert len(touched) == 1


def test_buckets_are_compacted_alone(spark, tmp_path, monkeypatch):
    import random

    monkeypatch.setattr(tg, "MANY", 2)
    rng = random.Random(0)
    target, held = _table(spark, tmp_path / "t", 4), []
    for n in range(9):
        rows = [(rng.choice("abcdefghij") + ("" if n % 2 else "x"), rng.randrange(6), rng.random() < 0.3, str(rng.random())) for _ in range(rng.randrange(5))]
        held.append(rows)
        target.apply(spark.createDataFrame(rows, SCHEMA), n)
    want = {}
    for rows in held:
        own = {}
        for r in sorted(rows, key=lambda r: (r[1], json.dumps({"revision_id": r[1], "deleted": r[2], "v": r[3]}, separators=(",", ":")))):
            own[r[0]] = r
        for k, r in own.items():
            if k not in want or r[1] >= want[k][1]:
                want[k] = r
    assert sorted(map(tuple, target.read().collect())) == sorted(want.values())
    folders = target.manifest()["buckets"]
    assert any(f.startswith("base-") for own in folders.values() for f in own) and all(len(own) <= 3 for own in folders.values())
    left = {x.name for x in (tmp_path / "t").iterdir() if x.name.startswith(("delta-", "base-"))}
    assert left >= {f for own in folders.values() for f in own} and len(left) <= 9


def test_a_reader_keeps_its_version(spark, tmp_path):
    target = _table(spark, tmp_path / "t")
    target.apply(spark.createDataFrame([("a", 1, False, "a1")], SCHEMA), 0)
    seen = target.read()
    target.apply(spark.createDataFrame([("a", 2, False, "a2"), ("b", 1, False, "b1")], SCHEMA), 1)
    assert [r["v"] for r in seen.collect()] == ["a1"] and sorted(r["v"] for r in target.read().collect()) == ["a2", "b1"]
    target.apply(spark.createDataFrame([], SCHEMA), 2)
    assert target.version() == 2 and target.read().count() == 2


def test_bounds_only_widen(spark, tmp_path):
    schema = "collection_id string, start_date timestamp_ntz, end_date timestamp_ntz"
    target = tg.TargetTable(spark, str(tmp_path / "t"), spark.createDataFrame([], schema).schema, ["collection_id"], tg.widest(["collection_id"]), 2)
    day = lambda n: dt.datetime(2020, 1, n)
    batches = [[("A", day(5), day(6)), ("B", day(1), None)], [("A", day(2), day(3)), ("B", day(2), day(9))], [("A", day(4), day(8)), ("C", day(1), day(1))]]
    for n, rows in enumerate(batches):
        target.apply(spark.createDataFrame(rows, schema), n)
    assert sorted(map(tuple, target.read().collect())) == [("A", day(2), day(8)), ("B", day(1), None), ("C", day(1), day(1))]


def test_notify_modes_and_permission(spark):
    ev = spark.createDataFrame([("G1", "C", 1, False), ("G1", "C", 2, True)], "concept_id string, collection_id string, revision_id int, deleted boolean")
    subs = spark.createDataFrame([("S1", "u", "C", "e", ["New"]), ("S2", "w", "C", "e", ["New", "Delete"])], "concept_id string, subscriber_id string, collection_id string, endpoint string, modes array<string>")
    got = sorted((r["subscription_id"], r["mode"]) for r in st.notify(ev, subs).collect())
    assert got == [("S1", "New"), ("S2", "Delete"), ("S2", "New")]
    ok = spark.createDataFrame([("w", "C")], "subscriber_id string, collection_id string")
    assert {r["subscription_id"] for r in st.notify(ev, subs, ok).collect()} == {"S2"}


def test_digest_advances(spark):
    now = dt.datetime(2020, 1, 10)
    ch = spark.createDataFrame([("G1", "C", dt.datetime(2020, 1, 9, 12)), ("G2", "C", dt.datetime(2020, 1, 1))], "concept_id string, collection_id string, revision_date timestamp_ntz")
    subs = spark.createDataFrame([("S1", "C", None), ("S2", "C", dt.datetime(2019, 12, 31))], "concept_id string, collection_id string, last_notified_at timestamp_ntz")
    found, new = st.digest(ch, subs, now)
    assert {r["subscription_id"]: r["ids"] for r in found.collect()} == {"S1": ["G1"], "S2": ["G1", "G2"]}
    assert st.digest(ch, new, dt.datetime(2020, 1, 11))[0].count() == 0


def test_failing_batches_go_to_the_table(spark, tmp_path):
    calls = []

    def bad(df, n):
        calls.append(n)
        raise RuntimeError("no")

    st.with_retry(bad, str(tmp_path / "dead"), tries=2)(spark.createDataFrame(ROWS[:2], SCHEMA), 7)
    assert calls == [7, 7] and st.failed(spark, str(tmp_path / "dead")).where("batch = 7 and error = 'no'").count() == 2


def test_digest_stream_goes_on_after_a_restart(spark, tmp_path):
    """A stream stopped and started again: each period's digest once, with each record's last revision."""
    schema = "concept_id string, collection_id string, revision_id int, revision_date timestamp"
    at = lambda h, m=0: dt.datetime(2020, 1, 1, h, m)
    subs = spark.createDataFrame([("S1", "C"), ("S1", "C"), ("S2", "C"), ("S3", "D")], "concept_id string, collection_id string")
    parts = [
        [("G1", "C", 1, at(0, 5)), ("G2", "C", 1, at(0, 10)), ("G9", "X", 1, at(0, 20))],
        [("G1", "C", 2, at(0, 50)), ("G3", "D", 1, at(1, 5))],
        [("G1", "C", 3, at(1, 30)), ("G2", "C", 2, at(4))],
        [("G4", "D", 1, at(9)), ("G1", "C", 9, at(0, 1))],  # the last is too late
    ]
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        e = st.read_events(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
        out = st.digest_stream(e, subs)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((r["subscription_id"], r["since"].hour, r["concept_id"], r["revision_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("S1", 0, "G1", 2), ("S1", 0, "G2", 1), ("S1", 1, "G1", 3), ("S1", 4, "G2", 2), ("S2", 0, "G1", 2), ("S2", 0, "G2", 1), ("S2", 1, "G1", 3), ("S2", 4, "G2", 2), ("S3", 1, "G3", 1)]
