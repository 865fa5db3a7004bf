"""Autocomplete suggestions and small maintenance reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import drop_anti_values, variable_fingerprint


def build_suggestions(df: DataFrame, fields: dict[str, list[str]], groups: str = "permitted_groups") -> DataFrame:
    """(type, value, fields, public, groups): values of collections for autocomplete.

    ``fields``: suggestion type to column path; several columns of a hierarchy join by ``:``, and
    the last one is the value. Public if any collection with it is open to guests.
    """
    parts = []
    for kind, cols in fields.items():
        path = F.array_compact(F.array(*cols))
        parts.append(F.struct(F.lit(kind).alias("type"), F.element_at(path, -1).alias("value"), F.array_join(path, ":").alias("fields")))
    d = df.select(F.col(groups).alias("_g"), F.explode(F.array(*parts)).alias("s")).select("s.*", "_g").where("value is not null")
    d = drop_anti_values(d, "value")
    g = d.groupBy("type", "value", "fields").agg(F.bool_or(F.array_contains("_g", "guest")).alias("public"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_g")))).alias("groups"))
    return g


def prune_suggestions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Suggestions of ``old`` that ``new`` no longer has."""
    return old.join(new.select("type", "fields"), ["type", "fields"], "left_anti")


def refresh_fingerprints(df: DataFrame, name: Column, units: Column, dimensions: Column) -> DataFrame:
    """Variables whose stored fingerprint is missing or stale, with the new one."""
    new = variable_fingerprint(name, units, dimensions)
    return df.withColumn("new_fingerprint", new).where(~F.col("fingerprint").eqNullSafe(F.col("new_fingerprint")))


def visibility_lag(events: DataFrame, docs: DataFrame) -> DataFrame:
    """Seconds from a revision's event to its indexed document."""
    d = events.join(docs.select("concept_id", "revision_id", "indexed_at"), ["concept_id", "revision_id"])
    return d.select("concept_id", "revision_id", ((F.unix_micros(F.col("indexed_at").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6).alias("seconds"))


def range_buckets(rules: list[dict]) -> list[tuple[str, float, float]]:
    """Range facet buckets from humanizer texts; the upper edge counts as inside."""
    from ..functions.filters import parse_resolution

    out = []
    for r in rules:
        low, high = parse_resolution(r["source_value"])
        out.append((r["source_value"], low, float("inf") if high is None else high + 1e-9))
    return sorted(out, key=lambda x: x[1])
