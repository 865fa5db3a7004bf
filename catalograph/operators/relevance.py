"""Relevance tests: positions, gains, boost tuning, tests from click logs."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


#: Positions that one task ranks at most.
STEP = 10_000


def ranks(df: DataFrame, group: str, bucket: list[Column], order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's rank from 1 in its group by ``order``.

    ``bucket`` never falls along ``order``: rows are ranked within a bucket and moved up by the rows
    of the buckets before, so a large group is spread over its buckets.
    """
    d = df.withColumn("_b", F.struct(*bucket))
    n = d.groupBy(F.col(group).alias("_g"), F.col("_b").alias("_of")).agg(F.count("*").alias("_n"))
    before = W.partitionBy("_g").orderBy("_of").rowsBetween(W.unboundedPreceding, -1)
    n = n.select("_g", "_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    d = d.withColumn("_in", F.row_number().over(W.partitionBy(group, "_b").orderBy(*order)))
    d = d.join(n, F.col(group).eqNullSafe(F.col("_g")) & F.col("_b").eqNullSafe(F.col("_of")))
    return d.withColumn(name, (F.col("_in") + F.col("_before")).cast("int")).drop("_b", "_g", "_of", "_before", "_in")


#: Buckets that equal scores are spread over by id, and ids that their bounds are drawn from, at most about.
SPREAD, DRAWN = 64, 4096


def id_bucket(df: DataFrame, key: str) -> Column:
    """A number that never falls along the ids of ``df``, equal for about one in ``SPREAD`` of them.

    Its bounds are ids drawn by a hash, so the same rows give the same buckets.
    """
    n = df.count()
    some = df.select(key).where(F.pmod(F.xxhash64(key), F.lit(max(1, n // DRAWN))) == 0).distinct().orderBy(key).limit(2 * DRAWN).collect()
    ids = [r[0] for r in some if r[0] is not None]
    bounds = sorted({ids[len(ids) * k // SPREAD] for k in range(1, SPREAD)}) if ids else []
    kind = df.schema[key].dataType
    return F.size(F.filter(F.array(*[F.lit(b).cast(kind) for b in bounds]), lambda b: b <= F.col(key))) if bounds else F.lit(0)


def _expected(expected: DataFrame) -> DataFrame:
    """(test_id, place from 1, concept_id) of expected records, given so or as an array in order."""
    if "place" in expected.columns:
        return expected.select("test_id", "place", "concept_id")
    return expected.select("test_id", F.posexplode("concept_ids").alias("place", "concept_id")).withColumn("place", F.col("place") + 1)


def rank_positions(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(test_id, place, position): where each expected record came back, 0 if it didn't.

    ``results``: test_id, concept_id, position from 1; ``expected``: test_id, and place and
    concept_id, or concept_ids in order. Positions count among the test's expected records, so
    that irrelevant hits don't move them.
    """
    e = _expected(expected)
    found = results.join(e, ["test_id", "concept_id"]).select("test_id", "concept_id", "position")
    found = ranks(found, "test_id", [F.floor(F.col("position") / STEP).alias("at")], [F.col("position")], "_pos").select("test_id", "concept_id", "_pos")
    return e.join(found, ["test_id", "concept_id"], "left").select("test_id", "place", F.coalesce("_pos", F.lit(0)).alias("position"))


def relevance_metrics(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(test_id, dcg, rr, passed): gain over ideal gain, and reciprocal rank of the top record.

    In the order that results came back, the record expected at place p of n gains n + 1 - p,
    divided by log2(rank + 1).
    """
    pos = rank_positions(results, expected)
    n = _expected(expected).groupBy("test_id").agg(F.count("*").alias("n"))
    log2 = lambda c: F.log(c + 1) / F.log(F.lit(2.0))
    gain = F.when(F.col("position") > 0, (F.col("n") + 1 - F.col("place")) / log2(F.col("position"))).otherwise(0.0)
    ideal = (F.col("n") + 1 - F.col("place")) / log2(F.col("place"))
    m = pos.join(n, "test_id").groupBy("test_id").agg(
        F.sum(gain).alias("g"), F.sum(ideal).alias("i"), F.max(F.when((F.col("place") == 1) & (F.col("position") > 0), 1.0 / F.col("position"))).alias("rr"),
        F.bool_and(F.col("position") == F.col("place")).alias("passed"),
    )
    return m.select("test_id", F.when(F.col("i") > 0, F.col("g") / F.col("i")).otherwise(0.0).alias("dcg"), F.coalesce("rr", F.lit(0.0)).alias("rr"), "passed")


def relevance_summary(metrics: DataFrame) -> DataFrame:
    """One row: tests, passed, mean gain, mean gain of failed tests, mean reciprocal rank."""
    return metrics.agg(F.count("*").alias("tests"), F.count_if("passed").alias("passed"), F.avg("dcg").alias("dcg"), F.avg(F.when(~F.col("passed"), F.col("dcg"))).alias("failed_dcg"), F.avg("rr").alias("mrr"))


def top_n(results: DataFrame, tests: DataFrame) -> DataFrame:
    """(test_id, ok): whether the test's record is among its first n results."""
    t = tests.select("test_id", "concept_id", "n").join(results, ["test_id", "concept_id"], "left")
    return t.select("test_id", F.coalesce(F.col("position") <= F.col("n"), F.lit(False)).alias("ok"))


def boost_grid(field: str, low: float, high: float, step: float, base: dict) -> list[dict]:
    """Boost sets that sweep one field."""
    n = int(round((high - low) / step))
    return [base | {field: round(low + i * step, 6)} for i in range(n + 1)]


def random_boosts(fields: list[str], tries: int, low: float = 1.0, high: float = 4.0, seed: int = 0) -> list[dict]:
    rng = random.Random(seed)
    return [{f: round(rng.uniform(low, high), 2) for f in fields} for _ in range(tries)]


def tune_boosts(candidates: DataFrame, expected: DataFrame, hits: dict[str, Column], grid: list[dict]) -> DataFrame:
    """(grid_id, dcg) of each boost set, best first; the first best of equal ones.

    ``candidates``: test_id, concept_id and the columns of ``hits``, a boolean column for each
    boosted field. Scores of a pair under all sets come from one pass over the candidates. Ranks are
    counted within one score and a range of ids, and moved up by what comes before, so no task ranks
    a whole test, though most of its scores may be equal.
    """
    scores = F.array(*[_score(hits, b).alias("s") for b in grid])
    each = candidates.select("test_id", "concept_id", F.posexplode(scores).alias("grid_id", "score"))
    keyed = each.withColumn("_run", F.concat_ws("#", "grid_id", "test_id"))
    keyed = ranks(keyed, "_run", [(-F.col("score")).alias("s"), id_bucket(candidates, "concept_id").alias("at")], [F.desc("score"), F.col("concept_id")], "position")
    keyed = keyed.select(F.col("_run").alias("test_id"), "concept_id", "position")
    each_set = F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))).alias("grid_id")
    want = _expected(expected).select("*", each_set).select(F.concat_ws("#", "grid_id", "test_id").alias("test_id"), "place", "concept_id")
    m = relevance_metrics(keyed, want)
    return m.groupBy(F.split("test_id", "#")[0].cast("int").alias("grid_id")).agg(F.avg("dcg").alias("dcg")).orderBy(F.desc("dcg"), "grid_id")


def _score(hits: dict[str, Column], boosts: dict) -> Column:
    out = F.lit(1.0)
    for f, hit in hits.items():
        out = out * F.when(F.coalesce(hit, F.lit(False)), F.lit(float(boosts.get(f, 1.0)))).otherwise(1.0)
    return out


def tests_from_logs(df: DataFrame) -> DataFrame:
    """(search, chosen, top): clicks below the top hit, paired with the top record; repeats dropped.

    ``df``: search, chosen, rank (from 1), results (ids as shown).
    """
    d = df.where("rank > 1").select("search", "chosen", F.get("results", F.lit(0)).alias("top"))
    return d.where("top is not null and top != chosen").dropDuplicates(["search", "chosen", "top"])
