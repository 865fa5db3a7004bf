"""Change events as Structured Streaming: upserts, deletes, notifications, digests, derived records, bounds.

A late revision is not dropped by time: it loses to a higher version in the target table. Only
de-duplication of replayed events keeps operator state, bounded by a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.facets import granule_bounds
from ..operators.revisions import change_mode
from .targets import TargetTable


def read_events(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Change events from a folder of Parquet files."""
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(path)


def dedupe_events(events: DataFrame, delay: str = "1 hour", time: str = "ts", keys=("concept_id", "revision_id")) -> DataFrame:
    """Replays of one revision within the delay come once."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def _run(events: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str):
    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_upsert(events: DataFrame, target: TargetTable, checkpoint: str):
    """Apply events to the target whatever their order; returns the running query.

    With a target of the :func:`~.targets.newest` rule a late revision loses to a higher one. Deletes
    are revisions too: a target with a ``deleted`` column holds live and deleted records, and both
    change with one manifest, so no reader misses a record between them (see :func:`live`).
    """
    return _run(events, lambda batch, n: target.apply(batch, n), checkpoint)


def live(target: TargetTable) -> tuple[DataFrame, DataFrame]:
    """The live and the deleted records of a target, as one batch left both; a deleted one may come back."""
    rows = target.read()
    return rows.where("not deleted"), rows.where("deleted")


def notify(events: DataFrame, subs: DataFrame, permitted: DataFrame | None = None) -> DataFrame:
    """A row for each change, endpoint and subscriber whose subscription covers its collection and mode.

    Works on streams and batches. ``permitted``: (subscriber_id, collection_id) pairs with read
    permission; None leaves the check off.
    """
    s = subs.select(F.col("concept_id").alias("subscription_id"), "subscriber_id", "collection_id", "endpoint", F.col("modes").alias("_modes"))
    out = change_mode(events).join(s, "collection_id").where(F.array_contains("_modes", F.col("mode")))
    if permitted is not None:
        ok = permitted.select("subscriber_id", "collection_id")
        out = out.join(ok, ["subscriber_id", "collection_id"], "left_semi")
    return out.drop("_modes")


def digest(changes: DataFrame, subs: DataFrame, now, lookback_hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """(subscription_id, ids) of records revised since each subscription's last run, and the subscriptions with their time advanced."""
    now = F.lit(now).cast("timestamp_ntz")
    since = F.coalesce("last_notified_at", now - F.make_dt_interval(F.lit(0), F.lit(lookback_hours)))
    s = subs.select(F.col("concept_id").alias("subscription_id"), "collection_id", since.alias("_since"))
    found = changes.join(s, "collection_id").where((F.col("revision_date") > F.col("_since")) & (F.col("revision_date") <= now))
    out = found.groupBy("subscription_id").agg(F.array_sort(F.collect_set("concept_id")).alias("ids"))
    return out, subs.withColumn("last_notified_at", now)


def digest_stream(events: DataFrame, subs: DataFrame, period: str = "1 hour", delay: str = "10 minutes", time: str = "revision_date") -> DataFrame:
    """(subscription_id, since, until, concept_id, revision_id): digests as a stream, a row for each record of a digest.

    Each subscription's digest covers a period of the clock and comes once, when the watermark says
    that no change of it is still to come; a record revised several times comes with its highest
    revision. The state is one row for each subscription and record of an open period, spread by both,
    so no subscription is one group. Restarted from its checkpoint the stream goes on where it was, and
    with a file or table sink no digest is written twice. Changes later than ``delay`` are left to
    :func:`digest`. Works on batches too, where every period is given out.
    """
    s = subs.select(F.col("concept_id").alias("subscription_id"), "collection_id").distinct()
    found = events.withWatermark(time, delay).join(s, "collection_id")
    w = F.window(time, period).alias("w")
    out = found.groupBy(w, "subscription_id", "concept_id").agg(F.max("revision_id").alias("revision_id"))
    return out.select("subscription_id", F.col("w.start").alias("since"), F.col("w.end").alias("until"), "concept_id", "revision_id")


def derive_granules(events: DataFrame, config: DataFrame) -> DataFrame:
    """Changes of derived records that a change of their source brings; deletes carry over."""
    c = config.select("collection_id", "virtual_collection_id", "ur_from", "ur_to")
    d = events.join(c, "collection_id")
    return d.select(F.col("virtual_collection_id").alias("collection_id"), F.replace("granule_ur", F.col("ur_from"), F.col("ur_to")).alias("granule_ur"), F.col("granule_ur").alias("source_ur"), "revision_id", "deleted")


def stream_bounds(events: DataFrame, target: TargetTable, checkpoint: str):
    """Temporal bounds of collections that only widen with each batch of granules: a target of the :func:`~.targets.widest` rule."""
    return _run(events, lambda batch, n: target.apply(granule_bounds(batch), n), checkpoint)


def cascade_deletes(deletes: DataFrame, links: DataFrame, now) -> DataFrame:
    """Tombstone revisions of the live links at either end of deleted records."""
    live = links.where("not deleted")
    ids = deletes.where("deleted").select("concept_id")
    a = live.join(ids.select(F.col("concept_id").alias("source_id")), "source_id", "left_semi")
    b = live.join(ids.select(F.col("concept_id").alias("associated_id")), "associated_id", "left_semi")
    both = a.unionByName(b).dropDuplicates(["source_id", "associated_id"])
    return both.withColumns({"revision_id": F.col("revision_id") + 1, "deleted": F.lit(True), "revision_date": F.lit(now).cast("timestamp_ntz")})


def with_retry(each: Callable[[DataFrame, int], None], dead_letters: str, tries: int = 3) -> Callable[[DataFrame, int], None]:
    """A batch function that runs again on failure, and writes a batch that keeps failing to a table.

    The table is partitioned by batch, so a batch that is run again replaces its own rows.
    """
    def run(batch: DataFrame, n: int) -> None:
        error = None
        for _ in range(tries):
            try:
                each(batch, n)
                return
            except Exception as e:  # noqa: BLE001  any failure of the batch goes to the table
                error = str(e)[:500]
        batch.withColumn("error", F.lit(error)).write.mode("overwrite").parquet(f"{dead_letters}/batch={n}")

    return run


def failed(spark: SparkSession, dead_letters: str) -> DataFrame | None:
    """Events that wait for another try."""
    try:
        return spark.read.parquet(dead_letters)
    except AnalysisException:
        return None


def windowed_counts(events: DataFrame, window: str = "1 hour", delay: str = "2 hours", time: str = "ts", kind: Column | None = None) -> DataFrame:
    """Events of each kind in tumbling windows, closed by a watermark on a stream."""
    kind = F.col("event_type") if kind is None else kind
    return events.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), kind.alias("kind")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")
