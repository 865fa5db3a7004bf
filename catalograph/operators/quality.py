"""Data quality rules: each adds an array of messages, empty where all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _messages(*rules: tuple[Column, str | Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), m if isinstance(m, Column) else F.lit(m)) for c, m in rules]))


def check_temporal(granules: DataFrame, collections: DataFrame) -> DataFrame:
    """A granule's time against its collection's: the first of five kinds of error."""
    c = collections.select(F.col("concept_id").alias("collection_id"), F.col("start_date").alias("c_start"), F.col("end_date").alias("c_end"))
    s, e, cs, ce = (F.col(x) for x in ("start_date", "end_date", "c_start", "c_end"))
    error = (
        F.when(cs.isNull() & s.isNotNull(), "parent has no temporal")
        .when(s < cs, "starts before parent")
        .when(s > ce, "starts after parent's end")
        .when(e > ce, "ends after parent's end")
        .when(ce.isNotNull() & e.isNull(), "no end but parent has one")
        .when(s > e, "starts after its own end")
    )
    return granules.join(c, "collection_id").withColumn("error", error).drop("c_start", "c_end")


def check_spatial_repr(granules: DataFrame, collections: DataFrame) -> DataFrame:
    """Geometry is required for geodetic and cartesian, orbit for orbit, and forbidden without spatial."""
    c = collections.select(F.col("concept_id").alias("collection_id"), F.col("spatial_repr").alias("r"))
    shape, orbit, r = F.col("has_shape"), F.col("has_orbit"), F.col("r")
    error = (
        F.when(r.isin("GEODETIC", "CARTESIAN") & ~shape, "geometry required")
        .when((r == "ORBIT") & ~orbit, "orbit required")
        .when((r.isNull() | (r == "NO_SPATIAL")) & (shape | orbit), "spatial forbidden")
        .when((r == "ORBIT") & shape, "geometry forbidden")
    )
    return granules.join(c, "collection_id").withColumn("error", error).drop("r")


def check_references(granules: DataFrame, collections: DataFrame, fields: list[str]) -> DataFrame:
    """Names in list fields that the parent lacks, without case: messages ``field: names``."""
    c = collections.select(F.col("concept_id").alias("collection_id"), *[F.transform(F.coalesce(F.col(f), F.array().cast("array<string>")), F.lower).alias(f"p_{f}") for f in fields])
    rules = []
    for f in fields:
        lost = F.array_sort(F.array_except(F.transform(F.coalesce(F.col(f), F.array().cast("array<string>")), F.lower), F.col(f"p_{f}")))
        rules.append((F.size(lost) > 0, F.concat(F.lit(f"{f}: "), F.array_join(lost, ", "))))
    return granules.join(c, "collection_id").withColumn("errors", _messages(*rules)).drop(*[f"p_{f}" for f in fields])


def check_collection_ref(granules: DataFrame, collections: DataFrame) -> DataFrame:
    """Identifiers that a granule gives for its collection match it; at least one kind is given."""
    keys = ["entry_title", "entry_id", "short_name", "version_id"]
    c = collections.select(F.col("concept_id").alias("collection_id"), *[F.col(k).alias(f"p_{k}") for k in keys])
    none = F.col("entry_title").isNull() & F.col("entry_id").isNull() & (F.col("short_name").isNull() | F.col("version_id").isNull())
    rules = [(none, "no collection reference")] + [(F.col(k) != F.col(f"p_{k}"), f"{k} differs") for k in keys]
    return granules.join(c, "collection_id").withColumn("errors", _messages(*rules)).drop(*[f"p_{k}" for k in keys])


def check_grid(df: DataFrame, grid: str = "grid", bounds: str = "bounds") -> DataFrame:
    """2-D coordinates inside the parent's bounds of the same grid."""
    g, b = F.col(grid), F.col(bounds)
    rules = [(b.isNull() & g.isNotNull(), "grid unknown to parent")]
    for axis in ("1", "2"):
        for end in ("start", "end"):
            v = g[f"{end}_{axis}"]
            rules.append(((v < b[f"min_{axis}"]) | (v > b[f"max_{axis}"]), f"{end}_{axis} out of bounds"))
    return df.withColumn("errors", _messages(*rules))


_TYPES = {"FLOAT": "double", "INT": "int", "BOOLEAN": "boolean", "DATE": "date", "DATETIME": "timestamp_ntz"}


def attribute_errors(kind: Column, value: Column, low: Column, high: Column) -> Column:
    """A value parses as its type and lies in the range; ranges only where order makes sense."""
    bad = F.lit(False)
    for name, t in _TYPES.items():
        bad = bad | ((kind == name) & value.isNotNull() & value.try_cast(t).isNull())
    outside = F.lit(False)
    for name in ("FLOAT", "INT", "DATE", "DATETIME"):
        t = _TYPES[name]
        v = value.try_cast(t)
        outside = outside | ((kind == name) & (F.coalesce(v < low.try_cast(t), F.lit(False)) | F.coalesce(v > high.try_cast(t), F.lit(False))))
    ranged = kind.isin("STRING", "BOOLEAN") & (low.isNotNull() | high.isNotNull())
    return _messages((bad, "value does not parse"), (outside, "value out of range"), (ranged, "range not allowed"))


def check_attributes(granules: DataFrame, collections: DataFrame) -> DataFrame:
    """Granule attributes (name, value) against the parent's (name, type, range): rows with errors."""
    c = collections.select(F.col("concept_id").alias("collection_id"), F.explode("attributes").alias("p")).select("collection_id", F.lower("p.name").alias("_n"), F.col("p.type").alias("type"), F.col("p.range_begin").alias("lo"), F.col("p.range_end").alias("hi"))
    g = granules.select("granule_id", "collection_id", F.explode("attributes").alias("a")).select("granule_id", "collection_id", F.col("a.name").alias("name"), F.lower("a.name").alias("_n"), F.col("a.value").alias("value"))
    out = g.join(c, ["collection_id", "_n"], "left")
    errors = F.when(F.col("type").isNull(), F.array(F.lit("attribute unknown to parent"))).otherwise(attribute_errors(F.col("type"), F.col("value"), F.col("lo"), F.col("hi")))
    return out.withColumn("errors", errors).where(F.size("errors") > 0).select("granule_id", "name", "errors")


def check_unique(df: DataFrame, path: Column, name: str) -> DataFrame:
    """Names that a record has twice."""
    seen = F.array_distinct(F.filter(path, lambda x: F.size(F.filter(path, lambda y: y == x)) > 1))
    return df.withColumn("errors", _messages((F.size(seen) > 0, F.concat(F.lit(f"{name} must be unique: "), F.array_join(F.array_sort(seen), ", ")))))


def check_keywords(df: DataFrame, keywords: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows whose keywords the vocabulary doesn't have, without case."""
    k = keywords.select(*[F.lower(v).alias(f"_k{i}") for i, v in enumerate(on.values())]).distinct()
    return df.join(k, [F.lower(c).eqNullSafe(k[f"_k{i}"]) for i, c in enumerate(on)], "left_anti")


def check_collection_update(new: DataFrame, granules: DataFrame) -> DataFrame:
    """(concept_id, rule, n): granules that a collection's new date range would leave outside."""
    c = new.select(F.col("concept_id").alias("collection_id"), F.col("start_date").alias("cs"), F.col("end_date").alias("ce"))
    g = granules.join(c, "collection_id")
    found = g.groupBy("collection_id").agg(
        F.count_if(F.col("start_date") < F.col("cs")).alias("early"),
        F.count_if(F.col("ce").isNotNull() & (F.col("end_date").isNull() | (F.col("end_date") > F.col("ce")))).alias("late"),
    )
    pairs = F.array(F.struct(F.lit("starts before").alias("rule"), F.col("early").alias("n")), F.struct(F.lit("ends after").alias("rule"), F.col("late").alias("n")))
    return found.select(F.col("collection_id").alias("concept_id"), F.explode(pairs).alias("x")).select("concept_id", "x.*").where("n > 0")


def check_names_kept(diff: DataFrame, granules: DataFrame, old: str, new: str, used: str) -> DataFrame:
    """(concept_id, name, n): names that an update takes from a collection while granules use them."""
    gone = diff.select(F.col("concept_id").alias("collection_id"), F.explode(F.array_except(F.transform(old, F.lower), F.transform(new, F.lower))).alias("name"))
    use = granules.select("collection_id", F.explode(F.array_distinct(F.transform(used, F.lower))).alias("name"))
    return use.join(gone.distinct(), ["collection_id", "name"]).groupBy(F.col("collection_id").alias("concept_id"), "name").agg(F.count("*").alias("n"))


def check_dates(df: DataFrame, now) -> DataFrame:
    """End before start, start in the future, an end flagged as running but past."""
    now = F.lit(now).cast("timestamp_ntz")
    s, e = F.col("start_date"), F.col("end_date")
    return df.withColumn("errors", _messages((s > e, "start after end"), (s > now, "start in the future"), (F.col("ends_at_present") & (e < now), "running but ended")))


def check_standard_product(df: DataFrame, providers: DataFrame, consortium: str) -> DataFrame:
    """Standard products come from providers of the consortium and aren't near-real-time."""
    p = providers.select("provider_id", F.array_contains(F.transform("consortiums", F.lower), consortium.lower()).alias("_in"))
    d = df.join(p, "provider_id", "left")
    std = F.coalesce("standard_product", F.lit(False))
    nrt = F.lower("data_type").rlike("^(near[-_ ]real[-_ ]time|nrt)$")
    return d.withColumn("errors", _messages((std & ~F.coalesce("_in", F.lit(False)), "provider not in consortium"), (std & nrt, "near-real-time"))).drop("_in")


def check_unique_concepts(df: DataFrame, fields: list[str], key: str = "concept_id") -> DataFrame:
    """(fields, ids): combinations that several live records share."""
    return df.groupBy(*fields).agg(F.array_sort(F.collect_set(key)).alias("ids")).where(F.size("ids") > 1)


def check_revisions(df: DataFrame, most: int = 2_000_000_000) -> DataFrame:
    """Identifier, type and provider agree; revision in range; required fields there."""
    t = F.regexp_extract("concept_id", r"^([A-Z]+)\d+-", 1)
    p = F.regexp_extract("concept_id", r"^[A-Z]+\d+-(.+)$", 1)
    prefix = F.create_map(*[F.lit(x) for kv in {"collection": "C", "granule": "G", "variable": "V", "service": "S", "tool": "TL", "tag": "T"}.items() for x in kv])
    return df.withColumn("errors", _messages((F.col("native_id").isNull(), "native id missing"), (F.col("revision_id") > most, "revision too high"), (F.col("revision_id") < 1, "revision too low"), (t != prefix[F.col("concept_type")], "id of another type"), (p != F.col("provider_id"), "id of another provider")))


def check_links(links: DataFrame, concepts: DataFrame) -> DataFrame:
    """Links whose target is missing or deleted, and links with and without revision to one target."""
    c = concepts.select(F.col("concept_id").alias("associated_id"), F.col("deleted").alias("_gone"))
    rest = [x for x in links.columns if x not in ("source_id", "associated_id")]
    pair, live = W.partitionBy("source_id", "associated_id"), ~F.col("deleted") & F.col("source_id").isNotNull() & F.col("associated_id").isNotNull()
    revision = F.col("associated_revision")
    d = links.withColumns({"_with": F.count_if(live & revision.isNotNull()).over(pair), "_without": F.count_if(live & revision.isNull()).over(pair)})
    d = d.join(c, "associated_id", "left")
    return d.withColumn("errors", _messages((F.col("_gone").isNull(), "target does not exist"), (F.col("_gone"), "target is deleted"), ((F.col("_with") > 0) & (F.col("_without") > 0), "linked with and without revision"))).select("source_id", "associated_id", *rest, "errors")
