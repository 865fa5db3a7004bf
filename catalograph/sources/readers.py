"""Readers of catalog tables, metadata documents, usage reports, vocabularies and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fields by which each record type can be found.
FIND_FIELDS = {
    "collection": {"concept_id", "provider_id", "native_id", "entry_id", "entry_title", "short_name", "version_id"},
    "granule": {"concept_id", "provider_id", "native_id", "granule_ur", "parent_collection_id"},
}
COMMON_FIELDS = {"concept_id", "provider_id", "native_id"}


def read_concepts(spark: SparkSession, path: str, concept_type: str, providers: list[str] | None = None) -> DataFrame:
    """Revisions of one type, of some providers: provider is a partition column, so others aren't read."""
    df = spark.read.parquet(path).where(F.col("concept_type") == concept_type)
    return df.where(F.col("provider_id").isin(list(providers))) if providers is not None else df


def find_concepts(df: DataFrame, concept_type: str, **params) -> DataFrame:
    """Rows with exactly these field values (several: any of them); unknown fields are refused."""
    unknown = set(params) - FIND_FIELDS.get(concept_type, COMMON_FIELDS)
    if unknown:
        raise ValueError(f"cannot find {concept_type} by {', '.join(sorted(unknown))}")
    for k, v in params.items():
        df = df.where(F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == F.lit(v))
    return df


def get_concepts(df: DataFrame, pairs: DataFrame, allow_missing: bool = False) -> DataFrame:
    """The rows of (concept_id, revision_id) pairs; a missing pair is an error unless allowed."""
    keys = ["concept_id", "revision_id"]
    if not allow_missing:
        lost = pairs.select(*keys).join(df.select(*keys), keys, "left_anti").limit(5).collect()
        if lost:
            raise LookupError("no such revisions: " + ", ".join(f"{r[0]}-{r[1]}" for r in lost))
    return df.join(pairs.select(*keys).distinct(), keys, "left_semi")


def parse_metadata(df: DataFrame, schema: T.StructType, field: str = "metadata") -> DataFrame:
    """JSON metadata as typed columns; documents that don't fit go to ``quarantine``."""
    inner = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    d = df.withColumn("_m", F.from_json(field, inner, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    d = d.withColumn("quarantine", F.when(F.col("_m").isNull() | F.col("_m._bad").isNotNull(), F.col(field)))
    return d.select(*[c for c in d.columns if c != "_m"], *[F.col(f"_m.{f.name}").alias(f.name) for f in schema.fields])


GRANULE_XML = """GranuleUR string, InsertTime string, LastUpdate string, DeleteTime string, Collection struct<DataSetId:string,ShortName:string,VersionId:string>,
DataGranule struct<SizeMBDataGranule:double,ProducerGranuleId:string,DayNightFlag:string,ProductionDateTime:string>,
Temporal struct<RangeDateTime:struct<BeginningDateTime:string,EndingDateTime:string>,SingleDateTime:string>,
Spatial struct<HorizontalSpatialDomain:struct<Geometry:struct<BoundingRectangle:array<struct<WestBoundingCoordinate:double,NorthBoundingCoordinate:double,EastBoundingCoordinate:double,SouthBoundingCoordinate:double>>,Point:array<struct<PointLongitude:double,PointLatitude:double>>>>>,
Platforms struct<Platform:array<struct<ShortName:string,Instruments:struct<Instrument:array<struct<ShortName:string>>>>>>,
AdditionalAttributes struct<AdditionalAttribute:array<struct<Name:string,Values:struct<Value:array<string>>>>>,
OnlineAccessURLs struct<OnlineAccessURL:array<struct<URL:string,MimeType:string>>>, CloudCover double, RestrictionFlag double"""


def parse_granule_xml(df: DataFrame, field: str = "metadata") -> DataFrame:
    """Granule XML as the granule columns; a document that doesn't parse has nulls."""
    from ..functions.dates import parse_datetime

    g = df.withColumn("_g", F.from_xml(field, GRANULE_XML.replace("\n", " ")))
    at = lambda p: F.col(f"_g.{p}")
    return g.withColumns(
        {
            "granule_ur": at("GranuleUR"), "collection_title": at("Collection.DataSetId"), "short_name": at("Collection.ShortName"), "version_id": at("Collection.VersionId"),
            "producer_id": at("DataGranule.ProducerGranuleId"), "day_night": at("DataGranule.DayNightFlag"), "size": at("DataGranule.SizeMBDataGranule"),
            "start_date": parse_datetime(F.coalesce(at("Temporal.SingleDateTime"), at("Temporal.RangeDateTime.BeginningDateTime"))),
            "end_date": parse_datetime(F.coalesce(at("Temporal.SingleDateTime"), at("Temporal.RangeDateTime.EndingDateTime"))),
            "cloud_cover": at("CloudCover"), "access_value": at("RestrictionFlag"),
            "platforms": F.transform(at("Platforms.Platform"), lambda p: p["ShortName"]),
            "attributes": F.transform(at("AdditionalAttributes.AdditionalAttribute"), lambda a: F.struct(a["Name"].alias("name"), F.get(a["Values"]["Value"], F.lit(0)).alias("value"))),
            "links": F.transform(at("OnlineAccessURLs.OnlineAccessURL"), lambda u: F.struct(u["URL"].alias("href"), F.lit("GET DATA").alias("type"), u["MimeType"].alias("mime_type"))),
            "boxes": F.transform(at("Spatial.HorizontalSpatialDomain.Geometry.BoundingRectangle"), lambda b: F.struct(b["WestBoundingCoordinate"].alias("west"), b["NorthBoundingCoordinate"].alias("north"), b["EastBoundingCoordinate"].alias("east"), b["SouthBoundingCoordinate"].alias("south"))),
        }
    ).drop("_g")


def usage_rows(df: DataFrame, strict: bool = False) -> DataFrame:
    """Usage report rows (Product, ProductVersion, Hosts): commas stripped from counts, long versions dropped.

    Rows without a product or with a count that is no number are dropped, or with ``strict`` an error.
    """
    hosts = F.regexp_replace("Hosts", ",", "").try_cast("bigint")
    version = F.col("ProductVersion")
    d = df.select(F.col("Product").alias("short_name"), F.when(F.length(version) <= 20, version).alias("version"), hosts.alias("access_count"), F.col("Hosts").alias("_raw"))
    bad = F.col("short_name").isNull() | (F.trim("short_name") == "") | F.col("access_count").isNull()
    if strict and (row := d.where(bad).first()):
        raise ValueError(f"bad usage row: {row['short_name']}, {row['_raw']}")
    return d.where(~bad).drop("_raw")


def read_usage_csv(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """A usage report by its header; other columns are ignored."""
    return usage_rows(spark.read.csv(path, header=True, multiLine=True, escape='"'), strict)


# Columns of each vocabulary file.
SCHEMES = {
    "providers": ["level_0", "level_1", "level_2", "level_3", "short_name", "long_name", "url", "uuid"],
    "platforms": ["basis", "category", "sub_category", "short_name", "long_name", "uuid"],
    "instruments": ["category", "class", "type", "subtype", "short_name", "long_name", "uuid"],
    "projects": ["bucket", "short_name", "long_name", "uuid"],
    "spatial": ["category", "type", "subregion_1", "subregion_2", "subregion_3", "uuid"],
    "science": ["category", "topic", "term", "variable_level_1", "variable_level_2", "variable_level_3", "detailed_variable", "uuid"],
    "formats": ["short_name", "long_name", "description", "uuid"],
}


def read_keywords(spark: SparkSession, path: str, scheme: str) -> DataFrame:
    """A vocabulary file: two heading lines, then rows; rows without an id are dropped, blanks are null."""
    cols = SCHEMES[scheme]
    df = spark.read.csv(path, schema=", ".join(f"{c} string" for c in cols), escape='"', multiLine=True)
    d = df.where(F.col("uuid").rlike("^[0-9a-fA-F-]{8,}$"))
    return d.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) for c in cols], F.lit(scheme).alias("scheme"))


def read_area_features(spark: SparkSession, path: str) -> DataFrame:
    from ..operators.spatial import read_areas

    return read_areas(spark, path)


def json_field(c: Column, path: str, kind: str = "string") -> Column:
    return F.get_json_object(c, path).try_cast(kind)
