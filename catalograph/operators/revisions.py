"""Revisions of records: latest, old, visible, deleted; retention; differences; versioned upsert."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Revisions that each concept type keeps; others keep DEFAULT_KEEP. Fixed values.
KEEP = {"collection": 10, "granule": 1, "variable": 10, "service": 10, "tool": 10}
DEFAULT_KEEP = 10
#: Days after which tombstones go.
TOMBSTONE_DAYS = 365


def latest_revisions(df: DataFrame, key: str = "concept_id", revision: str = "revision_id") -> DataFrame:
    """The row of each key with the highest revision: one aggregation, no sort of a key's history."""
    rest = [c for c in df.columns if c != key]
    top = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(revision)).alias("r"))
    return top.select(key, *[F.col("r")[c].alias(c) for c in rest]).select(*df.columns)


def highest_visible(df: DataFrame, key: str = "concept_id") -> DataFrame:
    """The highest revision of each key that isn't a tombstone."""
    return latest_revisions(df.where("not deleted"), key)


def old_revisions(df: DataFrame, keep: int | Column | None = None) -> DataFrame:
    """Revisions beyond the newest ``keep`` of each concept; by type if there is a type column."""
    if keep is None:
        table = F.create_map(*[F.lit(x) for kv in KEEP.items() for x in kv])
        keep = F.coalesce(table[F.col("concept_type")], F.lit(DEFAULT_KEEP)) if "concept_type" in df.columns else F.lit(DEFAULT_KEEP)
    keep = keep if isinstance(keep, Column) else F.lit(keep)
    w = W.partitionBy("concept_id").orderBy(F.desc("revision_id"))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") > keep).drop("_n")


def transaction_conflicts(df: DataFrame) -> DataFrame:
    """Revisions whose transaction is not above those of all earlier revisions of their concept."""
    w = W.partitionBy("concept_id").orderBy("revision_id").rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("prior_max", F.max("transaction_id").over(w)).where("transaction_id <= prior_max")


def change_mode(df: DataFrame) -> DataFrame:
    """New, Update or Delete for each revision."""
    return df.withColumn("mode", F.when(F.col("deleted"), "Delete").when(F.col("revision_id") == 1, "New").otherwise("Update"))


def diff_revisions(df: DataFrame, key: str = "concept_id", columns: list[str] | None = None) -> DataFrame:
    """Each revision with the columns of the one before it, ``old_``-named."""
    w = W.partitionBy(key).orderBy("revision_id")
    columns = columns or [c for c in df.columns if c != key]
    return df.select("*", *[F.lag(c).over(w).alias(f"old_{c}") for c in columns])


def concepts_between(df: DataFrame, start, end, field: str = "revision_date") -> DataFrame:
    """Rows with start <= date < end."""
    a, b = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
    return df.where((F.col(field) >= a) & (F.col(field) < b))


def deleted_collections(df: DataFrame, start, end) -> DataFrame:
    """Highest visible revision of records tombstoned in the range and not visible now."""
    gone = concepts_between(df.where("deleted"), start, end).select("concept_id").distinct()
    visible = latest_revisions(df).where("not deleted").select("concept_id")
    return highest_visible(df).join(gone.join(visible, "concept_id", "left_anti"), "concept_id", "left_semi")


def deleted_granules(df: DataFrame, since, **where) -> DataFrame:
    """Records whose latest revision is a tombstone since a date; a later ingest takes them off."""
    last = latest_revisions(df).where("deleted").where(F.col("revision_date") >= F.lit(since).cast("timestamp_ntz"))
    for k, v in where.items():
        last = last.where(F.col(k) == F.lit(v))
    return last


def expire(df: DataFrame, now) -> DataFrame:
    """New tombstone revisions for latest, live records whose delete_time has passed."""
    now = F.lit(now).cast("timestamp_ntz")
    due = latest_revisions(df).where(~F.col("deleted") & (F.col("delete_time") < now))
    return due.withColumns({"revision_id": F.col("revision_id") + 1, "revision_date": now, "deleted": F.lit(True), "delete_time": F.lit(None).cast("timestamp_ntz")})


def purge(df: DataFrame, now, keep: int | None = None, days: int = TOMBSTONE_DAYS) -> DataFrame:
    """``df`` less old revisions and less tombstones past ``days`` with all revisions before them."""
    limit = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    w = W.partitionBy("concept_id")
    newest_first = w.orderBy(F.desc("revision_id"))
    table = F.create_map(*[F.lit(x) for kv in KEEP.items() for x in kv])
    if keep is not None:
        n = F.lit(keep)
    elif "concept_type" in df.columns:
        n = F.coalesce(table[F.col("concept_type")], F.lit(DEFAULT_KEEP))
    else:
        n = F.lit(DEFAULT_KEEP)
    stale = F.max(F.when(F.col("deleted") & (F.col("revision_date") < limit), F.col("revision_id"))).over(w)
    return (
        df.withColumns({"_n": F.row_number().over(newest_first), "_stale": stale})
        .where((F.col("_n") <= n) & (F.col("_stale").isNull() | (F.col("revision_id") > F.col("_stale"))))
        .drop("_n", "_stale")
    )


def duplicates(df: DataFrame, field: str, key: str = "concept_id") -> DataFrame:
    """Values of ``field`` that several live records have, with their number and ids."""
    return (
        latest_revisions(df).where("not deleted").where(F.col(field).isNotNull()).groupBy(field)
        .agg(F.count("*").alias("n"), F.array_sort(F.collect_set(key)).alias("ids")).where("n > 1")
    )


def upsert_latest(base: DataFrame, updates: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Versioned upsert: a higher version replaces, an equal one replaces too, a lower one never does.

    Of several updates with one version, the greatest by all columns wins, so replays give the same.
    """
    rest = [c for c in base.columns if c not in keys]
    both = base.withColumn("_src", F.lit(0)).unionByName(updates.select(*base.columns).withColumn("_src", F.lit(1)))
    order = F.struct(F.col(version), F.col("_src"), F.to_json(F.struct(*rest)))
    top = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return top.select(*keys, *[F.col("r")[c].alias(c) for c in rest]).select(*base.columns)


def removed_items(df: DataFrame, old: str, new: str) -> Column:
    """Names in ``old`` but not in ``new``, without case."""
    low = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), F.lower)
    return F.array_sort(F.array_except(low(old), low(new)))


def merge_ranges(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Overlapping ranges of a key merged; no end is open; ranges that only touch stay apart."""
    far = F.lit("9999-12-31").cast("timestamp_ntz")
    d = df.withColumn("_e", F.coalesce(F.col(end), far))
    w = W.partitionBy(key).orderBy(start, "_e")
    reach = F.max("_e").over(w.rowsBetween(W.unboundedPreceding, -1))
    d = d.withColumn("_new", F.when(reach.isNull() | (F.col(start) >= reach), 1).otherwise(0))
    d = d.withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = d.groupBy(key, "_island").agg(F.min(start).alias(start), F.nullif(F.max("_e"), far).alias(end))
    return out.drop("_island")


def changed_rules(old: DataFrame, new: DataFrame, group: str = "provider_id") -> DataFrame:
    """Groups whose set of rows changed: an order-free hash of each side, compared."""
    def summed(df: DataFrame, name: str) -> DataFrame:
        cols = sorted(c for c in df.columns if c != group)
        return df.groupBy(group).agg(F.sum(F.xxhash64(*[F.col(c).cast("string") for c in cols]).cast("decimal(38,0)")).alias(name), F.count("*").alias(f"n_{name}"))

    both = summed(old, "a").join(summed(new, "b"), group, "full")
    return both.where(~(F.col("a").eqNullSafe(F.col("b")) & F.col("n_a").eqNullSafe(F.col("n_b")))).select(group)
