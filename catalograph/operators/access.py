"""Access rules: which records which principals may see.

A rule (``acls``) names its provider, whether it applies to collections or granules, optional entry
titles and concept ids, an access-value range, a temporal range with a mask, and permissions (group
or user type, grants).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import point_cells, range_cells
from .joins import temporal_join


def access_value_ok(value: Column, low: Column, high: Column, undefined: Column) -> Column:
    """A value in the rule's range, or none where the rule includes undefined; no rule permits all."""
    none = low.isNull() & high.isNull() & undefined.isNull()
    ranged = low.isNotNull() | high.isNotNull()
    inside = ranged & (low.isNull() | (value >= low)) & (high.isNull() | (value <= high))
    return none | F.when(value.isNull(), F.coalesce(undefined, F.lit(False))).otherwise(F.coalesce(inside, F.lit(False)))


def temporal_rule_ok(start: Column, end: Column, rule_start: Column, rule_stop: Column, mask: Column, now: Column) -> Column:
    """Record times by the rule's mask: intersect, disjoint (its negation) or contains; no end is now."""
    stop = F.coalesce(end, now)
    meets = (start <= rule_stop) & (stop >= rule_start)
    inside = start.between(rule_start, rule_stop) & stop.between(rule_start, rule_stop)
    by = F.when(mask == "intersect", meets).when(mask == "disjoint", ~meets).when(mask == "contains", inside)
    return mask.isNull() | (start.isNotNull() & F.coalesce(by, F.lit(False)))


def collection_rule_ok(title: Column, concept: Column, titles: Column, ids: Column) -> Column:
    """Named by title or id, or the rule names none."""
    open_ = titles.isNull() & ids.isNull()
    return open_ | F.coalesce(F.array_contains(titles, title), F.lit(False)) | F.coalesce(F.array_contains(ids, concept), F.lit(False))


def granting(acls: DataFrame, sids: list[str], permission: str) -> DataFrame:
    """Rules that grant ``permission`` to any of the principals (group ids, or guest / registered)."""
    who = F.array(*[F.lit(s) for s in sids]) if sids else F.array().cast("array<string>")
    hit = F.exists("permissions", lambda p: F.array_contains(who, F.coalesce(p["group_id"], p["user_type"])) & F.array_contains(p["grants"], permission))
    return acls.where(hit)


def _key(kind: str, text: Column | None = None, cell: Column | None = None) -> Column:
    """What a rule and a record may meet on: a title, an id, a cell of access values, no value, or anything."""
    return F.struct(
        F.lit(kind).alias("kind"), F.coalesce(text.cast("string"), F.lit("")).alias("text") if text is not None else F.lit("").alias("text"),
        (cell["level"] if cell is not None else F.lit(0)).alias("level"), (cell["cell"] if cell is not None else F.lit(0).cast("long")).alias("cell"),
    )


KEYS = "array<struct<kind:string,text:string,level:int,cell:bigint>>"


def _paired(records: DataFrame, acls: DataFrame, now) -> DataFrame:
    """Records with the rules (``r_`` columns) that let them through, each pair once.

    Rules meet records by what they name: titles, ids, and cells of access-value ranges, in one
    equi-join within the provider, and times that must meet by the tree of days. Only rules that ask
    for none of these meet all records of their provider, which they permit. So a provider's many
    rules add what they match. Each pair that is found is held against the whole rule.
    """
    now = F.lit(now).cast("timestamp_ntz")
    rules = acls.select(*[F.col(c).alias(f"r_{c}") for c in acls.columns])
    names = [*records.columns, *rules.columns]
    in_title = F.coalesce(F.array_contains("r_entry_titles", F.col("entry_title")), F.lit(False))
    empty = F.array().cast(KEYS)

    low, high, undefined = F.col("r_access.min"), F.col("r_access.max"), F.col("r_access.include_undefined")
    each = lambda some, make: F.coalesce(F.transform(some, make), empty)
    named = F.concat(each(F.array_distinct(F.array_compact("r_entry_titles")), lambda t: _key("title", t)), each(F.array_distinct(F.array_compact("r_concept_ids")), lambda i: _key("id", i)))
    ranged = F.when(low.isNotNull() | high.isNotNull(), F.transform(range_cells(low.cast("double"), high.cast("double")), lambda c: _key("value", cell=c))).otherwise(empty)
    absent = F.when(F.coalesce(undefined, F.lit(False)), F.array(_key("absent"))).otherwise(empty)
    timely = F.coalesce(F.col("r_temporal.mask").isin("intersect", "contains") & (F.col("r_temporal.start") <= F.col("r_temporal.stop")), F.lit(False))
    whole = low.isNull() & high.isNull() & undefined.isNull()
    open_ = F.when(~whole, F.concat(ranged, absent)).when(timely, empty).otherwise(F.array(_key("any")))
    asked = rules.withColumn("_key", F.explode(F.when(F.col("r_entry_titles").isNotNull() | F.col("r_concept_ids").isNotNull(), named).otherwise(open_)))

    value = F.col("access_value").cast("double")
    title = F.when(F.col("entry_title").isNotNull(), F.array(_key("title", F.col("entry_title")))).otherwise(empty)
    cells = F.when(value.isNull(), F.array(_key("absent"))).otherwise(F.transform(point_cells(value), lambda c: _key("value", cell=c)))
    own = records.withColumn("_own", F.explode(F.concat(title, F.array(_key("id", F.col("concept_id")), _key("any")), cells)))
    found = own.join(asked, (F.col("provider_id") == F.col("r_provider_id")) & (F.col("_own") == F.col("_key")))
    found = found.where((F.col("_key.kind") != "id") | ~in_title).select(*names)

    stop = F.coalesce("end_date", now)
    timed = records.withColumns({"_from": F.least("start_date", stop), "_to": F.greatest("start_date", stop)}).where(F.col("start_date").isNotNull())
    spans = rules.where(F.col("r_entry_titles").isNull() & F.col("r_concept_ids").isNull() & whole & timely).withColumns({"_since": F.col("r_temporal.start"), "_until": F.col("r_temporal.stop")})
    found = found.unionByName(temporal_join(timed, spans, ("_from", "_to"), ("_since", "_until"), by=("provider_id", "r_provider_id"), hint=None).select(*names))
    return found.where(
        collection_rule_ok(F.col("entry_title"), F.col("concept_id"), F.col("r_entry_titles"), F.col("r_concept_ids"))
        & access_value_ok(F.col("access_value"), low, high, undefined)
        & temporal_rule_ok(F.col("start_date"), F.col("end_date"), F.col("r_temporal.start"), F.col("r_temporal.stop"), F.col("r_temporal.mask"), now)
    )


def permitted(records: DataFrame, acls: DataFrame, sids: list[str], permission: str = "read", now="2100-01-01", key: str = "concept_id") -> DataFrame:
    """Records that some rule permits to the principals."""
    ok = _paired(records, granting(acls, sids, permission), now).select(key)
    return records.join(ok, key, "left_semi")


def rules_for(records: DataFrame, acls: DataFrame, now="2100-01-01") -> DataFrame:
    """(concept_id, acl_id) of the rules that could permit each record."""
    return _paired(records, acls, now).select("concept_id", F.col("r_acl_id").alias("acl_id"))


def granted_permissions(records: DataFrame, acls: DataFrame, sids: list[str], management: list[str] = (), now="2100-01-01") -> DataFrame:
    """Sorted permissions of the principals on each record; ``management``: providers that they manage."""
    who = F.array(*[F.lit(s) for s in sids])
    pairs = _paired(records, acls, now).select("concept_id", F.explode("r_permissions").alias("p")).where(F.array_contains(who, F.coalesce(F.col("p.group_id"), F.col("p.user_type"))))
    got = pairs.select("concept_id", F.explode("p.grants").alias("g"))
    if management:
        own = records.where(F.col("provider_id").isin(list(management))).select("concept_id", F.explode(F.array(F.lit("delete"), F.lit("update"))).alias("g"))
        got = got.unionByName(own)
    sets = got.groupBy("concept_id").agg(F.array_sort(F.collect_set("g")).alias("permissions"))
    return records.select("concept_id").join(sets, "concept_id", "left").withColumn("permissions", F.coalesce("permissions", F.array().cast("array<string>")))


def permitted_groups(records: DataFrame, acls: DataFrame, now="2100-01-01") -> DataFrame:
    """Distinct groups and user types that may read each record."""
    pairs = _paired(records, acls, now).select("concept_id", F.explode("r_permissions").alias("p")).where(F.array_contains("p.grants", "read"))
    return pairs.groupBy("concept_id").agg(F.array_sort(F.collect_set(F.coalesce(F.col("p.group_id"), F.col("p.user_type")))).alias("groups"))


def buckets_for(collections: DataFrame, sids: list[str], providers: list[str] | None = None) -> DataFrame:
    """Distinct storage prefixes of collections that any of the principals may read."""
    c = collections.where(F.col("provider_id").isin(providers)) if providers else collections
    return c.where(F.arrays_overlap("permitted_groups", F.array(*[F.lit(s) for s in sids]))).select(F.explode("prefixes").alias("prefix")).distinct()
