"""Result formats: CSV, STAC items, open-data records, references, holdings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _date(c: str):
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def to_collection_csv(df: DataFrame) -> DataFrame:
    """Eight columns of text for each collection."""
    return df.select(
        F.col("provider_id").alias("Data Provider"), F.col("short_name").alias("Short Name"), F.col("version_id").alias("Version"), F.col("entry_title").alias("Entry Title"),
        F.col("processing_level").alias("Processing Level"), F.array_join(F.transform("platforms", lambda p: p["short_name"]), ",").alias("Platforms"),
        _date("start_date").alias("Start Time"), _date("end_date").alias("End Time"),
    )


def to_granule_csv(df: DataFrame) -> DataFrame:
    """Nine columns of text for each granule."""
    links = lambda kind: F.array_join(F.transform(F.filter("links", lambda x: x["type"] == kind), lambda x: x["href"]), ",")
    return df.select(
        F.col("granule_ur").alias("Granule UR"), F.col("producer_id").alias("Producer Granule ID"), _date("start_date").alias("Start Time"), _date("end_date").alias("End Time"),
        links("GET DATA").alias("Online Access URLs"), links("GET RELATED VISUALIZATION").alias("Browse URLs"), F.col("cloud_cover").cast("string").alias("Cloud Cover"),
        F.col("day_night").alias("Day/Night"), F.col("size").cast("string").alias("Size"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def to_stac(df: DataFrame, root: str = "https://example.org") -> DataFrame:
    """(concept_id, item): a STAC item for each granule with a box (west, north, east, south)."""
    b = F.col("box")
    crosses = b["west"] > b["east"]
    corner = lambda x, y: F.array(x, y)
    ring = lambda w, e: F.array(F.array(corner(w, b["south"]), corner(e, b["south"]), corner(e, b["north"]), corner(w, b["north"]), corner(w, b["south"])))
    # coordinates of the two kinds lie at different depths, so each has an item of its own type
    single = F.struct(ring(b["west"], b["east"]).alias("coordinates"), F.lit("Polygon").alias("type"))
    split = F.struct(F.array(ring(b["west"], F.lit(180.0)), ring(F.lit(-180.0), b["east"])).alias("coordinates"), F.lit("MultiPolygon").alias("type"))
    same = F.col("end_date").isNull() | (F.col("end_date") == F.col("start_date"))
    times = F.struct(F.when(same, _date("start_date")).alias("datetime"), F.when(~same, _date("start_date")).alias("start_datetime"), F.when(~same, _date("end_date")).alias("end_datetime"), F.col("cloud_cover").alias("eo:cloud_cover"))
    assets = F.map_from_entries(F.transform(F.filter("links", lambda x: x["href"].isNotNull()), lambda x, i: F.struct(F.when(x["type"] == "GET DATA", F.concat(F.lit("data"), i.cast("string"))).otherwise(F.concat(F.lit("browse"), i.cast("string"))), F.struct(x["href"].alias("href"), x["mime_type"].alias("type")))))
    item = lambda geometry: F.struct(
        F.lit("Feature").alias("type"), F.lit("1.0.0").alias("stac_version"), F.col("concept_id").alias("id"), F.col("collection_id").alias("collection"), geometry.alias("geometry"),
        F.array(b["west"], b["south"], b["east"], b["north"]).alias("bbox"), times.alias("properties"), assets.alias("assets"),
        F.array(F.struct(F.lit("self").alias("rel"), F.concat(F.lit(root + "/items/"), F.col("concept_id")).alias("href"))).alias("links"),
    )
    return df.where("box is not null").select("concept_id", F.when(crosses, F.to_json(item(split))).otherwise(F.to_json(item(single))).alias("item"))


def to_opendata(df: DataFrame, tag: str) -> DataFrame:
    """(concept_id, record): an open-data record for each collection with the tag."""
    d = df.where(F.map_contains_key("tags", tag))
    time = F.when(F.col("start_date").isNotNull(), F.concat(_date("start_date"), F.lit("/"), F.coalesce(_date("end_date"), F.lit("..."))))
    b = F.col("box")
    spatial = F.when(b.isNotNull(), F.concat_ws(" ", b["west"], b["south"], b["east"], b["north"]))
    record = F.struct(
        F.lit("dcat:Dataset").alias("@type"), F.col("entry_title").alias("title"), F.col("summary").alias("description"), F.array_sort(F.array_distinct(F.flatten(F.transform("science_keywords", lambda k: F.array_compact(F.array(k["topic"], k["term"])))))).alias("keyword"),
        F.col("concept_id").alias("identifier"), F.lit("public").alias("accessLevel"), time.alias("temporal"), spatial.alias("spatial"), F.array(F.lit("en-US")).alias("language"),
    )
    return d.select("concept_id", F.to_json(record).alias("record"))


def to_refs(df: DataFrame, name: str = "entry_title") -> DataFrame:
    return df.select("concept_id", "revision_id", F.col(name).alias("name"))


def to_holdings_csv(df: DataFrame) -> DataFrame:
    """Provider, title, id and number of granules."""
    return df.select(F.col("provider_id").alias("Provider Id"), F.col("entry_title").alias("Entry Title"), F.col("concept_id").alias("Concept Id"), F.col("granule_count").alias("Granule Count"))
