"""Flat search documents of collections, granules and other records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filters import wildcard_regex

FORMAT_FIELDS = {
    "reference": ["concept_id", "revision_id", "provider_id", "native_id"],
    "csv": ["granule_ur", "producer_id", "start_date", "end_date", "links", "cloud_cover", "day_night", "size"],
    "json": ["concept_id", "revision_id", "provider_id", "start_date", "end_date", "shapes", "links"],
}


def build_granule_docs(granules: DataFrame, collections: DataFrame) -> DataFrame:
    """Granules with their parent's fields, lower-case names, flags, and fallbacks.

    Cloud cover falls back to the CLOUD_COVERAGE attribute, the readable name to the UR, the
    creation time to the revision date.
    """
    c = collections.select(F.col("concept_id").alias("collection_id"), F.col("entry_title").alias("collection_title"), F.col("short_name").alias("short_name"), F.col("version_id").alias("version_id"))
    attribute = F.get(F.filter("attributes", lambda a: F.upper(a["name"]) == "CLOUD_COVERAGE"), F.lit(0))["value"].try_cast("double")
    g = granules.join(c, "collection_id", "left")
    return g.withColumns(
        {
            "granule_ur_lowercase": F.lower("granule_ur"),
            "short_name_lowercase": F.lower("short_name"),
            "downloadable": F.coalesce(F.exists("links", lambda x: x["type"] == "GET DATA"), F.lit(False)),
            "browsable": F.coalesce(F.exists("links", lambda x: x["type"] == "GET RELATED VISUALIZATION"), F.lit(False)),
            "cloud_cover": F.coalesce("cloud_cover", attribute),
            "readable_name": F.coalesce("producer_id", "granule_ur"),
            "created_at": F.coalesce("created_at", "revision_date"),
        }
    )


def build_collection_docs(collections: DataFrame, temporal: DataFrame | None = None) -> DataFrame:
    """Collections with a parsed version, lower-case names, facet words and flags."""
    from ..functions.text import keyword_words
    from .sorting import version_key

    d = collections if temporal is None else collections.join(temporal, "concept_id", "left")
    return d.withColumns(
        {
            "parsed_version": version_key(F.col("version_id")),
            "short_name_lowercase": F.lower("short_name"),
            "entry_id": F.when(F.col("version_id").isin("Not provided", ""), F.col("short_name")).otherwise(F.concat_ws("_", "short_name", "version_id")),
            "keyword": keyword_words([F.col(c) for c in ("entry_title", "short_name", "version_id", "summary")]),
            "has_tags": F.coalesce(F.cardinality("tags") > 0, F.lit(False)),
        }
    )


def build_tombstone_docs(df: DataFrame) -> DataFrame:
    """Deleted revisions by their key fields alone."""
    return df.where("deleted").select("concept_id", "revision_id", "provider_id", "native_id", "revision_date", F.lit(True).alias("deleted"), "short_name", "version_id")


def select_fields(df: DataFrame, fmt: str) -> DataFrame:
    """The columns that a result format needs."""
    return df.select(*[c for c in FORMAT_FIELDS[fmt] if c in df.columns])


def attribute_docs(granules: DataFrame, collections: DataFrame) -> DataFrame:
    """Granule attributes with a value column for each type, typed by the parent; unknown ones carry an error."""
    types = collections.select(F.col("concept_id").alias("collection_id"), F.explode("attributes").alias("p")).select("collection_id", F.lower("p.name").alias("_n"), F.upper("p.type").alias("type"), F.col("p.group").alias("group"))
    g = granules.select("granule_id", "collection_id", F.explode("attributes").alias("a")).select("granule_id", "collection_id", F.col("a.name").alias("name"), F.lower("a.name").alias("_n"), F.col("a.value").alias("value"))
    d = g.join(types, ["collection_id", "_n"], "left")
    t, v = F.col("type"), F.col("value")
    return d.select(
        "granule_id", "name", "group", "type",
        F.when(t.isin("STRING", "BOOLEAN", "TIME_STRING", "DATE_STRING", "DATETIME_STRING"), v).alias("string_value"),
        F.when(t == "FLOAT", v.try_cast("double")).alias("float_value"),
        F.when(t == "INT", v.try_cast("bigint")).alias("int_value"),
        F.when(t == "DATETIME", v.try_cast("timestamp_ntz")).alias("datetime_value"),
        F.when(t == "DATE", v.try_cast("date").cast("timestamp_ntz")).alias("date_value"),
        F.when(t == "TIME", F.concat(F.lit("1970-01-01 "), v).try_cast("timestamp_ntz")).alias("time_value"),
        F.when(t.isNull(), F.lit("attribute unknown to parent")).alias("error"),
    )


LEVELS = ["category", "topic", "term", "variable_level_1", "variable_level_2", "variable_level_3", "detailed_variable"]


def clean_keyword(c: Column) -> Column:
    """Trimmed upper-case text; "Not provided" and blanks are null."""
    v = F.upper(F.trim(c))
    return F.when(~v.isin("NOT PROVIDED", ""), v)


def science_keyword_docs(df: DataFrame, field: str = "science_keywords") -> DataFrame:
    return df.withColumn(field, F.transform(field, lambda k: F.struct(*[clean_keyword(k[x]).alias(x) for x in LEVELS])))


def science_keyword_facet_fields(df: DataFrame, field: str = "science_keywords") -> DataFrame:
    """An array for each keyword level, without nulls and repeats."""
    return df.withColumns({level: F.array_distinct(F.filter(F.transform(field, _level(level)), lambda x: x.isNotNull())) for level in LEVELS})


def _level(name: str):
    return lambda k: clean_keyword(k[name])


def expand_pass_tiles(tiles: Column) -> Column:
    """A full tile stands for its left and right ones too: 2F gives 2F, 2L, 2R."""
    full = lambda t: F.transform(F.array(F.lit("F"), F.lit("L"), F.lit("R")), lambda s: F.concat(t.substr(F.lit(1), F.length(t) - 1), s))
    return F.flatten(F.transform(tiles, lambda t: F.when(t.rlike(r"^\d+F$"), full(t)).otherwise(F.array(t))))


def index_json_paths(df: DataFrame, paths: dict[str, str], field: str = "metadata") -> DataFrame:
    """Configured JSON paths of a document as columns."""
    return df.withColumns({name: F.get_json_object(field, path) for name, path in paths.items()})


def filter_tags(df: DataFrame, patterns: list[str], field: str = "tags") -> DataFrame:
    """Tags whose key matches a wildcard pattern."""
    regexes = [wildcard_regex(p.lower()) for p in patterns]

    def keep(k: Column, _v: Column) -> Column:
        hit = F.lit(False)
        for r in regexes:
            hit = hit | F.lower(k).rlike(r)
        return hit

    return df.withColumn(field, F.map_filter(field, keep))


def collection_temporal(df: DataFrame, now, ongoing_days: int = 30) -> DataFrame:
    """Start, end, ongoing date (3000-01-01 if open or ended lately), granule range with a recent end open."""
    now = F.lit(now).cast("timestamp_ntz")
    ago = lambda n: now - F.make_dt_interval(F.lit(n))
    far = F.lit("3000-01-01").cast("timestamp_ntz")
    recent = (F.col("granule_end") >= ago(3)) & (F.col("granule_end") < now)
    return df.withColumns(
        {
            "ongoing": F.when(F.col("end_date").isNull() | (F.col("end_date") > ago(ongoing_days)), far).otherwise(F.col("end_date")),
            "granule_end": F.when(~F.coalesce(recent, F.lit(False)), F.col("granule_end")),
        }
    )


FEATURES = {"reformat": "formats", "transform": "transforms", "combine": "aggregations", "variable": "variable_subset", "spatial": "spatial_subset", "temporal": "temporal_subset"}


def service_features(links: DataFrame, services: DataFrame) -> DataFrame:
    """Per collection, whether any of its services can do each thing, overall and by service type.

    ``services``: concept_id, type, and a boolean or array column for each capability.
    """
    types = dict(services.dtypes)
    can = lambda c: (F.coalesce(F.size(F.array_distinct(c)), F.lit(0)) > (1 if c == "formats" else 0)) if types[c].startswith("array") else F.coalesce(F.col(c), F.lit(False))
    s = services.select(F.col("concept_id").alias("service_id"), "type", *[can(c).alias(f"has_{k}") for k, c in FEATURES.items() if c in types])
    flags = [f"has_{k}" for k, c in FEATURES.items() if c in types]
    pairs = links.select(F.col("collection_id"), "service_id").join(s, "service_id")
    by_type = pairs.groupBy("collection_id", "type").agg(*[F.bool_or(f).alias(f) for f in flags])
    return by_type.groupBy("collection_id").agg(*[F.bool_or(f).alias(f) for f in flags], F.array_sort(F.collect_list(F.struct("type", *flags))).alias("by_type"))
