"""Bulk edits of list fields and links, their statuses, tags and associations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

OPS = ("add", "replace_all", "remove", "replace", "update")


def _matches(find: dict):
    def test(x: Column) -> Column:
        hit = F.lit(True)
        for k, v in find.items():
            hit = hit & F.coalesce(x[k] == F.lit(v), F.lit(False))
        return hit

    return test


def bulk_edit(df: DataFrame, field: str, op: str, find: dict | None = None, value: list[dict] | dict | None = None) -> DataFrame:
    """Edit an array of structs: add, replace all, find and remove, replace or update; then drop repeats.

    Adds ``edited``: false where nothing matched, and the row is as it was. A null list is empty
    for adding and replacing all, and matches nothing otherwise. An emptied list is null.
    """
    if op not in OPS:
        raise ValueError(f"unknown edit: {op}")
    inner = df.schema[field].dataType.elementType
    values = [value] if isinstance(value, dict) else list(value or [])

    def struct(v: dict, over: Column | None = None) -> Column:
        names = inner.fieldNames()
        return F.struct(*[(F.lit(v[n]) if n in v else over[n] if over is not None else F.lit(None)).cast(inner[n].dataType).alias(n) for n in names])

    new = F.array(*[struct(v) for v in values]) if values else F.array().cast(df.schema[field].dataType)
    old = F.col(field)
    have = F.coalesce(old, F.array().cast(df.schema[field].dataType))
    if op == "add":
        out, hit = F.concat(have, new), F.lit(True)
    elif op == "replace_all":
        out, hit = new, F.lit(True)
    else:
        test = _matches(find or {})
        hit = F.coalesce(F.exists(old, test), F.lit(False))
        if op == "remove":
            out = F.filter(have, lambda x: ~test(x))
        elif op == "replace":
            out = F.flatten(F.transform(have, lambda x: F.when(test(x), new).otherwise(F.array(x))))
        else:
            out = F.transform(have, lambda x: F.when(test(x), struct(values[0], x)).otherwise(x))
    out = F.array_distinct(out)
    return df.withColumn("edited", hit).withColumn(field, F.when(hit, F.when(F.size(out) > 0, out)).otherwise(old))


#: Granule edits: event type to (list column, list operation, filter of the entries concerned).
_LINK = {"resource": "resource_links", "access": "access_links", "browse": "browse_links", "related": "related_urls"}
EVENTS = {f"{op}_field:{name}": (column, {"update": "update", "append": "add", "remove": "remove"}[op]) for name, column in _LINK.items() for op in ("update", "append", "remove")}
SCALAR_EVENTS = {"update_field:checksum": "checksum", "update_field:size": "size", "update_field:format": "format", "update_field:mime_type": "mime_type"}
SPECIAL_EVENTS = ("update_field:additional_file", "update_field:s3_link", "append_to_field:s3_link", "update_field:opendap_link", "update_type:opendap_link", "update_field:related_url_type")


def granule_edit(granules: DataFrame, instructions: DataFrame) -> DataFrame:
    """Apply link and field edits keyed by granule UR; one instruction for each granule.

    ``instructions``: granule_ur, event_type, url, new_url (and value for plain fields). Links are
    arrays of structs with a ``url``. Adds ``edited``.
    """
    i = instructions.select("granule_ur", "event_type", "url", "new_url", "value")
    d = granules.join(i, "granule_ur", "left")
    edited = F.lit(False)
    out: dict[str, Column] = {}
    for column in set(_LINK.values()) & set(granules.columns):
        old = F.coalesce(F.col(column), F.array().cast(granules.schema[column].dataType))
        names = granules.schema[column].dataType.elementType.fieldNames()
        event = lambda op: F.col("event_type") == next(k for k, v in EVENTS.items() if v == (column, op))  # noqa: B023, E731
        has = F.exists(old, lambda x: x["url"] == F.col("url"))
        made = F.struct(*[(F.col("new_url") if n == "url" else F.lit(None)).cast(granules.schema[column].dataType.elementType[n].dataType).alias(n) for n in names])
        changed = F.transform(old, lambda x: F.when(x["url"] == F.col("url"), x.withField("url", F.col("new_url"))).otherwise(x))
        new = F.when(event("update") & has, changed).when(event("add"), F.array_distinct(F.concat(old, F.array(made)))).when(event("remove") & has, F.filter(old, lambda x: x["url"] != F.col("url")))
        edited = edited | new.isNotNull()
        out[column] = F.coalesce(new, F.col(column))
    for event_type, column in SCALAR_EVENTS.items():
        if column in granules.columns:
            hit = F.coalesce(F.col("event_type") == event_type, F.lit(False))
            edited = edited | hit
            out[column] = F.when(hit, F.col("value").cast(granules.schema[column].dataType)).otherwise(F.col(column))
    if {"s3_links", "opendap_links"} & set(granules.columns):
        for kind in ("s3_link", "opendap_link"):
            column = kind + "s"
            if column in granules.columns:
                split = F.split("value", r"\s*,\s*")
                replace = F.coalesce(F.col("event_type") == f"update_field:{kind}", F.lit(False))
                append = F.coalesce(F.col("event_type") == f"append_to_field:{kind}", F.lit(False))
                edited = edited | replace | append
                out[column] = F.when(replace, split).when(append, F.array_distinct(F.concat(F.coalesce(F.col(column), F.array().cast("array<string>")), split))).otherwise(F.col(column))
    d = d.withColumn("edited", F.coalesce(edited, F.lit(False)))
    return d.withColumns(out).drop("event_type", "url", "new_url", "value")


def edit_status(instructions: DataFrame, concepts: DataFrame, edited: DataFrame, key: str = "granule_ur") -> DataFrame:
    """(key, status, message): updated, skipped (nothing matched) or failed (missing or deleted)."""
    c = concepts.select(key, F.col("deleted").alias("_gone"))
    e = edited.select(key, F.col("edited").alias("_done"))
    d = instructions.select(key).join(c, key, "left").join(e, key, "left")
    failed = F.col("_gone").isNull() | F.col("_gone")
    return d.select(
        key,
        F.when(failed, "FAILED").when(F.col("_done"), "UPDATED").otherwise("SKIPPED").alias("status"),
        F.when(F.col("_gone").isNull(), "does not exist").when(F.col("_gone"), "has been deleted").when(~F.coalesce("_done", F.lit(False)), "no matching entry").alias("message"),
    )


def task_status(rows: DataFrame) -> DataFrame:
    """(task_id, status, counts): complete when nothing is pending."""
    n = rows.groupBy("task_id").agg(F.count_if(F.col("status") == "PENDING").alias("pending"), F.count_if(F.col("status") == "UPDATED").alias("updated"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.count_if(F.col("status") == "SKIPPED").alias("skipped"))
    return n.withColumn("status", F.when(F.col("pending") > 0, "IN_PROGRESS").otherwise("COMPLETE"))


def check_instructions(df: DataFrame, key: str = "granule_ur") -> DataFrame:
    """(key, error) of blank and repeated keys."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    blank = F.col(key).isNull() | (F.trim(key) == "")
    return n.withColumn("error", F.when(blank, "blank").when(F.col("n") > 1, "repeated")).where("error is not null").select(key, "error")


def link(links: DataFrame, pairs: DataFrame, now) -> DataFrame:
    """``links`` with a new live revision for each pair (source_id, associated_id)."""
    return _revise(links, pairs, now, False)


def unlink(links: DataFrame, pairs: DataFrame, now) -> DataFrame:
    """``links`` with a tombstone for each pair that is linked."""
    return _revise(links, pairs, now, True)


def _revise(links: DataFrame, pairs: DataFrame, now, gone: bool) -> DataFrame:
    keys = ["source_id", "associated_id"]
    last = links.groupBy(*keys).agg(F.max("revision_id").alias("_r"), F.max_by("deleted", "revision_id").alias("_d"))
    p = pairs.select(*keys).distinct().join(last, keys, "inner" if gone else "left")
    if gone:
        p = p.where("not _d")
    new = p.select(*keys, (F.coalesce("_r", F.lit(0)) + 1).cast(links.schema["revision_id"].dataType).alias("revision_id"), F.lit(gone).alias("deleted"), F.lit(now).cast("timestamp_ntz").alias("revision_date"))
    return links.unionByName(new, allowMissingColumns=True)


def tag_by_query(collections: DataFrame, links: DataFrame, pred: Column, tag: str, now, op: str = "link") -> DataFrame:
    """Link or unlink a tag to every collection that meets ``pred``."""
    pairs = collections.where(pred).select(F.lit(tag).alias("source_id"), F.col("concept_id").alias("associated_id"))
    return (link if op == "link" else unlink)(links, pairs, now)


def latest_links(links: DataFrame) -> DataFrame:
    w = W.partitionBy("source_id", "associated_id").orderBy(F.desc("revision_id"))
    return links.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").where("not deleted")
