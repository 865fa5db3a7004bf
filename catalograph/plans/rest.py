"""Queries on the driver's tables for operators that no other query runs alone: readers, filters, dates, shapes, edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as bx, dates, filters as fl, text as tx
from ..operators import access as ac, documents as dc, edits as ed, facets as fc, granule_edits as gd, orbit as ob, spatial as sp, suggest as sg
from ..sources import adapters as ad, readers as rd
from ..sources.adapters import inside_arcs, sql
from ..streaming import events as st
from .builder import build_filter, script_sort
from .more import AREA, _scratch
from .registry import query

DAYS = lambda n: F.make_dt_interval(F.lit(n))


# ---------------------------------------------------------------- sources


def _concepts(spark, d):
    """Granules and collections as one table of concepts by type and provider, in the shared folder; each task writes what it reads."""
    g = ad.granules(spark, d).select(F.lit("granule").alias("concept_type"), F.concat(F.lit("P"), F.col("provider_id") % 5).alias("provider_id"), F.concat_ws("-", "order_id", "line", "collection_id").alias("concept_id"))
    c = ad.collections(spark, d).select(F.lit("collection").alias("concept_type"), F.concat(F.lit("P"), F.col("concept_id") % 5).alias("provider_id"), F.col("concept_id").cast("string"))
    path = _scratch(spark)
    g.union(c).write.partitionBy("concept_type", "provider_id").parquet(path)
    return path


@query("src1_read_concepts", sql("SELECT 'P' || provider_id % 5 AS provider_id, order_id || '-' || line || '-' || collection_id AS concept_id FROM granules WHERE provider_id % 5 IN (1, 3)", "granules"))
def _(spark, d):
    return rd.read_concepts(spark, _concepts(spark, d), "granule", ["P1", "P3"]).select("provider_id", "concept_id")


@query("st1_all_providers", sql("SELECT 'P' || concept_id % 5 AS provider_id, CAST(concept_id AS VARCHAR) AS concept_id FROM collections", "collections"))
def _(spark, d):
    return rd.read_concepts(spark, _concepts(spark, d), "collection").select("provider_id", "concept_id")


@query("src6_granule_xml", sql("""SELECT 'G' || order_id || '.' || line AS granule_ur, start_date, coalesce(end_date, start_date) AS end_date, size, CASE WHEN cloud_cover > 0 THEN cloud_cover END AS cloud_cover,
    CASE WHEN line > 3 THEN 'A,' || flag ELSE flag END AS platforms, lon AS west FROM granules""", "granules"))
def _(spark, d):
    g = ad.granules(spark, d)
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c.cast("string"), F.lit(f"</{name}>"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    single = tag("SingleDateTime", iso(F.col("start_date")))
    spread = tag("RangeDateTime", F.concat(tag("BeginningDateTime", iso(F.col("start_date"))), tag("EndingDateTime", iso(F.col("end_date")))))
    platform = lambda c: tag("Platform", tag("ShortName", c))
    box = F.concat(tag("WestBoundingCoordinate", F.col("lon")), tag("NorthBoundingCoordinate", F.col("lat")), tag("EastBoundingCoordinate", F.col("lon")), tag("SouthBoundingCoordinate", F.col("lat")))
    body = F.concat(
        tag("GranuleUR", F.concat(F.lit("G"), "order_id", F.lit("."), "line")), tag("DataGranule", tag("SizeMBDataGranule", F.col("size"))), tag("Temporal", F.coalesce(spread, single)),
        tag("Spatial", tag("HorizontalSpatialDomain", tag("Geometry", tag("BoundingRectangle", box)))), tag("Platforms", F.concat(F.when(F.col("line") > 3, platform(F.lit("A"))).otherwise(""), platform(F.col("flag")))),
        F.when(F.col("cloud_cover") > 0, tag("CloudCover", F.col("cloud_cover"))).otherwise(""),
    )
    x = rd.parse_granule_xml(g.select(tag("Granule", body).alias("metadata")))
    return x.select("granule_ur", "start_date", "end_date", "size", "cloud_cover", F.array_join("platforms", ",").alias("platforms"), F.get("boxes", F.lit(0))["west"].alias("west"))


@query("src8_read_keywords", "SELECT p_brand AS basis, p_type AS category, CASE WHEN p_size % 2 = 0 THEN 'even, \"' || p_size || '\"' END AS sub_category, p_name AS short_name, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS uuid, 'platforms' AS scheme FROM part")
def _(spark, d):
    p = ad.read(spark, d, "part")
    sub = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('even, "'), "p_size", F.lit('"'))).otherwise(" ")
    rows = p.select("p_brand", "p_type", sub, "p_name", F.lit("long").alias("l"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"))
    heads = p.where("p_partkey = 0").select(*[F.lit(x) for x in ("Basis", "Category", "Sub_Category", "Short_Name", "Long_Name", "UUID")])
    path = _scratch(spark)
    heads.union(rows).write.csv(path, escape='"')
    return rd.read_keywords(spark, path, "platforms").select("basis", "category", "sub_category", "short_name", "uuid", "scheme")


@query("src9_read_areas", "SELECT CAST(s_suppkey AS VARCHAR) AS area_id, CASE WHEN s_nationkey % 2 = 0 THEN 'polygon' ELSE 'line' END AS kind, CASE WHEN s_nationkey % 2 = 0 THEN 4 ELSE 2 END AS points, CAST(s_suppkey % 170 + 2 AS DOUBLE) AS second_lon FROM supplier WHERE s_nationkey % 5 <> 4")
def _(spark, d):
    s = ad.read(spark, d, "supplier").withColumns({"x": F.col("s_suppkey") % 170, "y": F.col("s_suppkey") % 80})
    # a ring that runs clockwise, to be turned: its second point comes to be the lower right one
    ring = F.format_string('{"type":"Polygon","coordinates":[[[%1$d,%2$d],[%3$d,%4$d],[%3$d,%2$d],[%1$d,%2$d]]]}', "x", "y", F.col("x") + 2, F.col("y") + 2)
    line = F.format_string('{"type":"LineString","coordinates":[[%1$d,%2$d],[%3$d,%4$d]]}', "x", "y", F.col("x") + 2, F.col("y") + 2)
    shape = F.when(F.col("s_nationkey") % 5 == 4, "null").when(F.col("s_nationkey") % 2 == 0, ring).otherwise(line)
    feature = F.format_string('{"type":"Feature","id":"%d","properties":{},"geometry":%s}', "s_suppkey", shape)
    files = s.groupBy(F.floor(F.col("s_suppkey") / 200)).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list(feature), ","), F.lit("]}")).alias("value"))
    path = _scratch(spark)
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    ring0 = F.col("shape.rings")[0]
    return rd.read_area_features(spark, path).select("area_id", F.col("shape.kind").alias("kind"), F.size(ring0).alias("points"), ring0[1]["lon"].alias("second_lon"))


# ---------------------------------------------------------------- documents


@query("prj4_select_fields", sql("SELECT 'G' || order_id || '.' || line AS granule_ur, start_date, end_date, cloud_cover, size FROM granules", "granules"))
def _(spark, d):
    g = ad.granules(spark, d).withColumn("granule_ur", F.concat(F.lit("G"), "order_id", F.lit("."), "line"))
    return dc.select_fields(g, "csv")


@query("prj7_keyword_facet_fields", "SELECT p_partkey, upper(p_type) AS category, upper(p_brand) || CASE WHEN p_size % 2 = 0 THEN '' ELSE ',SECOND' END AS topic, CASE WHEN p_size % 3 = 0 THEN '' ELSE upper(trim(p_name)) END AS term FROM part")
def _(spark, d):
    none = F.lit(None).cast("string")
    rest = [none.alias(x) for x in dc.LEVELS[3:]]
    one = F.struct(F.col("p_type").alias("category"), F.col("p_brand").alias("topic"), F.when(F.col("p_size") % 3 == 0, "Not provided").otherwise(F.concat(F.lit(" "), "p_name")).alias("term"), *rest)
    two = F.struct(F.lower("p_type").alias("category"), F.when(F.col("p_size") % 2 == 0, F.lower("p_brand")).otherwise("second").alias("topic"), none.alias("term"), *rest)
    out = dc.science_keyword_facet_fields(ad.read(spark, d, "part").withColumn("science_keywords", F.array(one, two)))
    return out.select("p_partkey", *[F.array_join(x, ",").alias(x) for x in dc.LEVELS[:3]])


@query("prj8_pass_tiles", sql("SELECT order_id, line, CASE WHEN flag = 'R' THEN line || 'F,' || line || 'L,' || line || 'R,9R' ELSE line || 'L,9R' END AS tiles FROM granules", "granules"))
def _(spark, d):
    g = ad.granules(spark, d)
    tiles = F.array(F.concat("line", F.when(F.col("flag") == "R", "F").otherwise("L")), F.lit("9R"))
    return g.select("order_id", "line", F.array_join(dc.expand_pass_tiles(tiles), ",").alias("tiles"))


@query("prj12_service_features", """SELECT l_partkey AS collection_id, bool_or(s_suppkey % 3 = 2) AS has_reformat, bool_or(s_suppkey % 4 > 0) AS has_variable, bool_or(s_nationkey > 12) AS has_spatial, count(DISTINCT s_nationkey % 2) AS types
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""")
def _(spark, d):
    s = ad.read(spark, d, "supplier")
    names = lambda n: F.transform(F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(1), n.cast("int")), lambda i: i.cast("string"))
    services = s.select(F.col("s_suppkey").alias("concept_id"), (F.col("s_nationkey") % 2).cast("string").alias("type"), names(F.col("s_suppkey") % 3).alias("formats"), names(F.col("s_suppkey") % 4).alias("variable_subset"), (F.col("s_nationkey") > 12).alias("spatial_subset"))
    links = ad.read(spark, d, "lineitem").select(F.col("l_partkey").alias("collection_id"), F.col("l_suppkey").alias("service_id"))
    return dc.service_features(links, services).select("collection_id", "has_reformat", "has_variable", "has_spatial", F.size("by_type").cast("long").alias("types"))


# ---------------------------------------------------------------- filters


@query("flt1_match_all_none", "SELECT 'all' AS kind, o_orderkey FROM orders")
def _(spark, d):
    o = ad.read(spark, d, "orders").select("o_orderkey")
    return o.where(fl.match_all()).select(F.lit("all").alias("kind"), "o_orderkey").union(o.where(fl.match_none()).select(F.lit("none"), "o_orderkey"))


@query("flt20_nested_any", sql("SELECT concept_id FROM collections WHERE lower(level) = 'promo' OR lower(platform) = 'promo' OR (version % 7 = 0)", "collections"))
def _(spark, d):
    other = F.struct(F.when(F.col("version") % 7 == 0, "Promo").alias("level"), F.lit("x").alias("platform"))
    return ad.collections(spark, d).withColumn("names", F.array(F.struct("level", "platform"), other)).where(fl.nested_any("names", "PROMO", ["level", "platform"])).select("concept_id")


@query("flt26_operational_only", sql("SELECT concept_id FROM collections WHERE version % 3 = 1", "collections"))
def _(spark, d):
    c = ad.collections(spark, d).withColumn("progress", F.when(F.col("version") % 3 == 1, "Active").when(F.col("version") % 3 == 2, "COMPLETE"))
    return c.where(fl.operational_only()).where(fl.operational_only(False)).select("concept_id")


@query("flt28_measurements", sql("SELECT concept_id FROM collections WHERE lower(level) = 'promo' AND platform = 'Brand#7' AND version % 2 = 0", "collections"))
def _(spark, d):
    c = ad.collections(spark, d).withColumn("measurements", F.array(F.struct(F.col("level").alias("object"), F.col("platform").alias("quantity")), F.struct(F.lit("sea").alias("object"), F.when(F.col("version") % 2 == 0, "salt").alias("quantity"))))
    return c.where(fl.measurement_match([{"object": "promo", "quantity": "brand#7"}, {"object": "SEA", "quantity": "salt"}])).select("concept_id")


@query("flt38_equator_longitude", sql("SELECT order_id, line FROM granules WHERE lon >= 100 OR lon <= -120", "granules"))
def _(spark, d):
    g = ad.granules(spark, d).withColumn("orbit_domains", F.array(F.struct(F.col("lon").alias("equator_lon"))))
    return g.where(fl.equator_longitude(100, -120)).select("order_id", "line")


@query("flt40_spatial_groups", sql("""SELECT order_id, line FROM granules WHERE lat + half >= -20 AND lat - half <= 40 AND ((lon + half >= -30 AND lon - half <= 0) OR (lon + half >= 40 AND lon - half <= 90))
    AND lon BETWEEN -20 AND 60 AND lat BETWEEN -10 AND 70""", "granules"))
def _(spark, d):
    g = ad.granules(spark, d).withColumns({"b_west": F.col("lon") - F.col("half"), "b_east": F.col("lon") + F.col("half"), "b_north": F.col("lat") + F.col("half"), "b_south": F.col("lat") - F.col("half")})
    boxes = [fl.mbr_overlap("b_", -30, 40, 0, -20), fl.mbr_overlap("b_", 40, 40, 90, -20)]
    point = bx.box_covers_point(bx.box(*[F.lit(float(x)) for x in (-20, 70, 60, -10)]), F.col("lon"), F.col("lat"))
    return g.where(fl.spatial_any(boxes, [point])).select("order_id", "line")


@query("ud1_registered_filter", sql("SELECT concept_id FROM collections WHERE version % 7 = 0 OR version % 11 = 0", "collections"))
def _(spark, d):
    fl.register_filter("multiple_of", lambda c, v: F.col(c) % int(v) == 0)
    return ad.collections(spark, d).where(build_filter({"version": ["7", "11"]}, "collection", fields={"version": ("multiple_of", "version")})).select("concept_id")


@query("ud3_script_sort", sql("SELECT concept_id, (version * 13) % 17 AS sort_key FROM collections ORDER BY 2 DESC, 1", "collections"))
def _(spark, d):
    c = ad.collections(spark, d)
    return script_sort(c.select("concept_id", ((F.col("version") * 13) % 17).alias("sort_key")), F.col("sort_key"), down=True)


# ---------------------------------------------------------------- access rules


@query("pm1_access_value", sql("SELECT order_id, line, flag FROM granules WHERE (flag = 'A' AND access_value BETWEEN 0.02 AND 0.05) OR (flag = 'N' AND line = 1) OR flag = 'R'", "granules"))
def _(spark, d):
    none, f = F.lit(None).cast("double"), F.col("flag")
    value = F.when((F.col("line") != 1) | (f == "A"), F.col("access_value"))
    ok = ac.access_value_ok(value, F.when(f == "A", 0.02).otherwise(none), F.when(f == "A", 0.05).otherwise(none), F.when(f == "N", F.lit(True)))
    return ad.granules(spark, d).where(ok).select("order_id", "line", "flag")


@query("pm2_temporal_rule", sql("""SELECT order_id, line, flag FROM (SELECT *, coalesce(end_date, TIMESTAMP '2002-01-01') AS e, TIMESTAMP '1997-01-01' AS a, TIMESTAMP '1998-01-01' AS b FROM granules)
    WHERE CASE flag WHEN 'A' THEN start_date <= b AND e >= a WHEN 'R' THEN NOT (start_date <= b AND e >= a) ELSE start_date BETWEEN a AND b AND e BETWEEN a AND b END""", "granules"))
def _(spark, d):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    mask = F.when(F.col("flag") == "A", "intersect").when(F.col("flag") == "R", "disjoint").otherwise("contains")
    ok = ac.temporal_rule_ok(F.col("start_date"), F.col("end_date"), at("1997-01-01"), at("1998-01-01"), mask, at("2002-01-01"))
    return ad.granules(spark, d).where(ok).select("order_id", "line", "flag")


@query("pm3_collection_rule", sql("SELECT concept_id FROM collections WHERE version % 3 = 0 OR short_name = 'red widget' OR concept_id IN (3, 4, 5)", "collections"))
def _(spark, d):
    c = ad.collections(spark, d)
    rules = lambda a: F.when(F.col("version") % 3 != 0, a)
    ok = ac.collection_rule_ok(F.col("short_name"), F.col("concept_id"), rules(F.array(F.lit("red widget"))), rules(F.array(*[F.lit(i).cast("long") for i in (3, 4, 5)])))
    return c.where(ok).select("concept_id")


# ---------------------------------------------------------------- text, dates


@query("tx3_query_keywords", "SELECT 'words' AS kind, p_partkey FROM part WHERE lower(p_name) LIKE '%widget%' AND lower(p_type) = 'promo' UNION ALL SELECT 'phrase', p_partkey FROM part WHERE lower(p_name) = 'small ring'")
def _(spark, d):
    p = ad.read(spark, d, "part")
    words = tx.keyword_words([F.col("p_name"), F.col("p_type")])
    phrases = F.transform(tx.keyword_phrases([F.col("p_name")]), lambda x: F.trim(x))
    every = fl.all_of(*[F.array_contains(words, w) for w in tx.query_keywords("  Promo   WIDGET ")["words"]])
    phrase = fl.all_of(*[F.array_contains(phrases, w) for w in tx.query_keywords('"Small Ring"')["phrase"]])
    return p.where(every).select(F.lit("words").alias("kind"), "p_partkey").union(p.where(phrase).select(F.lit("phrase"), "p_partkey"))


@query("tx8_expand_aliases", "SELECT p_partkey, p_type || CASE p_type WHEN 'PROMO' THEN ',PR1,PR2' WHEN 'ECONOMY' THEN ',ECO' ELSE '' END AS names FROM part")
def _(spark, d):
    rule = lambda a, b, f="type": {"type": "alias", "field": f, "source_value": a, "replacement_value": b}
    rules = [rule("PR1", "PROMO"), rule("PR2", "PROMO"), rule("ECO", "ECONOMY"), rule("other", "PROMO", "platform"), {"type": "trim_whitespace", "field": "type"}]
    return ad.read(spark, d, "part").select("p_partkey", F.array_join(tx.expand_aliases(F.array("p_type"), rules, "type"), ",").alias("names"))


@query("tx13_service_links", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN 'https://x.cloud.example/' || o_orderkey END AS cloud, CASE o_orderkey % 4 WHEN 0 THEN 'https://here.example/' || o_orderkey WHEN 2 THEN 's3://bucket/' || o_orderkey WHEN 3 THEN 'http://there.example/' || o_orderkey END AS on_premises,
    CASE o_orderkey % 4 WHEN 1 THEN 'at most one cloud and one on-premises link' WHEN 2 THEN 'an S3 link is not a service link' END AS error FROM orders""")
def _(spark, d):
    k = F.col("o_orderkey")
    at = lambda s: F.concat(F.lit(s), k)
    urls = F.when(k % 4 == 0, F.array(at("https://here.example/"), at("https://x.cloud.example/"))).when(k % 4 == 1, F.array(at("https://x.cloud.example/"), at("https://y.cloud.example:443/"))).when(k % 4 == 2, F.array(at("s3://bucket/"))).otherwise(F.array(at("http://there.example/")))
    return ad.read(spark, d, "orders").select("o_orderkey", tx.classify_links(urls, r"[^/:]+\.cloud\.example").alias("x")).select("o_orderkey", "x.*")


@query("tx14_limit_text", "SELECT o_orderkey, substr(o_orderpriority, 1, 4) AS short FROM orders")
def _(spark, d):
    return ad.read(spark, d, "orders").select("o_orderkey", tx.limit_text(F.col("o_orderpriority"), 4).alias("short"))


@query("dt2_collection_dates", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate - to_days(2) ELSE o_orderdate END AS first_date,
    CASE WHEN o_orderstatus <> 'O' AND o_orderpriority NOT LIKE '1%' THEN o_orderdate + to_days(CASE WHEN o_orderkey % 2 = 0 THEN 20 ELSE 10 END) END AS last_date FROM orders""")
def _(spark, d):
    t, even = F.col("o_orderdate"), F.col("o_orderkey") % 2 == 0
    span = lambda a, b: F.array(F.struct(a.alias("start"), b.alias("end")))
    ranges = span(t, F.when(F.col("o_orderstatus") != "O", t + DAYS(10)))
    periodic, present = F.when(even, span(t - DAYS(2), t + DAYS(20))), F.when(F.col("o_orderpriority").startswith("1"), F.lit(True))
    return ad.read(spark, d, "orders").select("o_orderkey", dates.collection_start(F.array(t + DAYS(3)), ranges, periodic).alias("first_date"), dates.collection_end(F.array(t + DAYS(3)), ranges, periodic, present).alias("last_date"))


@query("dt3_granule_dates", sql("SELECT order_id, line, CASE WHEN line = 1 THEN start_date + to_days(1) ELSE start_date END AS first_date, CASE WHEN line = 1 THEN start_date + to_days(1) ELSE end_date END AS last_date FROM granules", "granules"))
def _(spark, d):
    single = F.when(F.col("line") == 1, F.col("start_date") + DAYS(1))
    return ad.granules(spark, d).select("order_id", "line", dates.granule_start(single, F.col("start_date")).alias("first_date"), dates.granule_end(single, F.col("end_date")).alias("last_date"))


@query("mt4_range_buckets", sql("""SELECT label, n FROM (SELECT '0 to 1 km' AS label, count(*) FILTER (version BETWEEN 0 AND 10) AS n FROM collections UNION ALL SELECT '1 km to 3 km', count(*) FILTER (version BETWEEN 10 AND 30) FROM collections
    UNION ALL SELECT '5 km to 10 km', count(*) FILTER (version BETWEEN 50 AND 100) FROM collections) WHERE n > 0""", "collections"))
def _(spark, d):
    c = ad.collections(spark, d).withColumn("metres", (F.col("version") * 100).cast("double"))
    return fc.facet_ranges(c, "metres", sg.range_buckets([{"source_value": x} for x in ("5 km to 10 km", "0 to 1 km", "1 km to 3 km")]))


# ---------------------------------------------------------------- edits, streams


@query("js6_link_unlink", """SELECT DISTINCT l_partkey AS source_id, l_suppkey AS associated_id, 1 AS revision_id FROM lineitem WHERE l_partkey % 3 <> 0
    UNION ALL SELECT DISTINCT l_partkey, l_suppkey, 3 FROM lineitem WHERE l_partkey % 6 = 0 UNION ALL SELECT DISTINCT l_partkey, -1, 1 FROM lineitem""")
def _(spark, d):
    pairs = ad.read(spark, d, "lineitem").select(F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("associated_id")).distinct()
    links = pairs.withColumns({"revision_id": F.lit(1), "deleted": F.lit(False), "revision_date": F.lit("2020-01-01").cast("timestamp_ntz")})
    gone = ed.unlink(links, pairs.where("source_id % 3 = 0"), "2020-01-02")
    back = ed.link(gone, pairs.where("source_id % 6 = 0").union(pairs.select("source_id", F.lit(-1).cast("long"))), "2020-01-03")
    return ed.latest_links(back).select("source_id", "associated_id", "revision_id")


@query("sm4_permitted_notices", sql("SELECT concept_id, revision_id, c_custkey AS subscription_id FROM revisions JOIN customer ON c_custkey = concept_id WHERE NOT deleted AND c_nationkey % 2 = 0 AND revision_id > 1", "revisions"))
def _(spark, d):
    e = ad.revisions(spark, d).withColumn("collection_id", F.col("concept_id"))
    c = ad.read(spark, d, "customer")
    subs = c.select(F.col("c_custkey").alias("concept_id"), F.concat(F.lit("u"), "c_custkey").alias("subscriber_id"), F.col("c_custkey").alias("collection_id"), F.lit("mail").alias("endpoint"), F.array(F.lit("Update")).alias("modes"))
    permitted = c.where("c_nationkey % 2 = 0").select(F.concat(F.lit("u"), "c_custkey").alias("subscriber_id"), F.col("c_custkey").alias("collection_id"))
    return st.notify(e, subs, permitted).select("concept_id", "revision_id", "subscription_id")


@query("sm10_retry_table", "SELECT event_id, CAST(event_id % 3 AS INTEGER) AS batch, 'no' AS error FROM events WHERE event_id % 3 <> 1")
def _(spark, d):
    path = _scratch(spark)

    def each(batch, n: int) -> None:
        if n != 1:
            raise RuntimeError("no")

    e = ad.read(spark, d, "events")
    for n in (0, 1, 2, 2):  # the last batch comes twice, and is kept once
        st.with_retry(each, path, tries=2)(e.where(F.col("event_id") % 3 == n), n)
    return st.failed(spark, path).select("event_id", "batch", "error")


@query("js2_link_edits", """SELECT o_orderkey AS granule_ur, k < 8 AND k <> 4 AS edited, CASE k WHEN 4 THEN 'a direct link must start with s3://, but was http://bad' END AS message,
    CASE k WHEN 0 THEN 'http://b,s3://old' WHEN 1 THEN a || ',s3://old,http://c' WHEN 2 THEN 's3://old' WHEN 3 THEN 's3://n,s3://m,' || a WHEN 5 THEN a || ',s3://old,https://opendap.cloud.x/' || o_orderkey WHEN 6 THEN a || ',s3://old,s3://m' ELSE a || ',s3://old' END AS urls,
    CASE k WHEN 7 THEN 'm,-' ELSE CASE WHEN k IN (2) THEN '-' WHEN k IN (1, 3, 5, 6) THEN '-,-,-' ELSE '-,-' END END AS mime_types FROM (SELECT o_orderkey, o_orderkey % 9 AS k, 'http://a/' || o_orderkey AS a FROM orders)""")
def _(spark, d):
    """Edits of links by eight events over all orders, some broken, some with nothing asked."""
    key = F.col("o_orderkey")
    k, own = key % 9, F.concat(F.lit("http://a/"), key)
    o = ad.read(spark, d, "orders").select("o_orderkey")
    link = lambda url, kind: F.struct(url.alias("url"), F.lit(kind).alias("type"), *[F.lit(None).cast("string").alias(n) for n in ("subtype", "mime_type", "description")])
    g = o.select(key.alias("granule_ur"), F.array(link(own, "GET DATA"), link(F.lit("s3://old"), gd.DIRECT)).alias("related_urls"), F.lit(None).cast(f"array<struct<{gd.FILE}>>").alias("files"))
    given = lambda **v: F.array(F.struct(*[v.get(n, F.lit(None)).cast("string").alias(n) for n in ("url", "from", "to", "type", "subtype", "mime_type", "description")]))
    names = ["update_field:relatedurl", "append_to_field:relatedurl", "remove_field:relatedurl", "update_field:s3link", "update_field:s3link", "append_to_field:opendaplink", "append_to_field:s3link", "update_field:mimetype"]
    links = F.when(k == 0, given(**{"from": own, "to": F.lit("http://b")})).when(k == 1, given(url=F.lit("http://c"))).when(k == 2, given(url=own)).when(k == 7, given(url=own, mime_type=F.lit("m")))
    value = F.when(k == 3, "s3://n, s3://n,s3://m").when(k == 4, "s3://n,http://bad").when(k == 5, F.concat(F.lit("https://opendap.cloud.x/"), key)).when(k == 6, "s3://old,s3://m")
    i = o.where(k < 8).select(key.alias("granule_ur"), F.element_at(F.array(*[F.lit(n) for n in names]), (k + 1).cast("int")).alias("event_type"), links.alias("links"), value.alias("value"), F.lit(None).cast(f"array<struct<{gd.FILE}>>").alias("files"))
    e = gd.edit_links_and_files(g, i)
    return e.select("granule_ur", "edited", "message", F.array_join("related_urls.url", ",").alias("urls"), F.array_join(F.transform("related_urls", lambda x: F.coalesce(x["mime_type"], F.lit("-"))), ",").alias("mime_types"))


# ---------------------------------------------------------------- guards

_LIMIT = "CASE " + " ".join(f"WHEN longest <= {most} THEN {n}" for most, n in fl.KEYWORD_LIMITS) + " ELSE 0 END"


@query("flt42_query_guards", f"""SELECT doc_id, CASE WHEN n > 30 THEN n || ' keywords with wildcards, 30 allowed' WHEN n > {_LIMIT} THEN n || ' keywords with wildcards, ' || {_LIMIT} || ' allowed as the longest has ' || longest || ' characters' END AS problem FROM
    (SELECT doc_id, len(wild) AS n, list_max(list_transform(wild, lambda t: length(t))) AS longest FROM (SELECT doc_id, list_filter(regexp_split_to_array(replace(replace(coalesce(text, ''), 'qu', 'q*'), 'z', '?'), '\\s+'), lambda t: contains(t, '*') OR contains(t, '?')) AS wild FROM documents))""")
def _(spark, d):
    """Keyword texts of saved queries (texts of documents, with wildcards for some letters) against the limits."""
    text = F.replace(F.replace("text", F.lit("qu"), F.lit("q*")), F.lit("z"), F.lit("?"))
    return ad.read(spark, d, "documents").select("doc_id", fl.keyword_problem(text).alias("problem"))


# ---------------------------------------------------------------- shapes

_XY = "CAST(p_partkey * 7 % 340 - 170 AS DOUBLE) AS x, CAST(p_partkey * 3 % 160 - 80 AS DOUBLE) AS y"


def _places(spark, d):
    """Parts with a place, x and y."""
    k = F.col("p_partkey")
    return ad.read(spark, d, "part").select("p_partkey", (k * 7 % 340 - 170).cast("double").alias("x"), (k * 3 % 160 - 80).cast("double").alias("y"))


def _shape_places(spark, d):
    """Places for shapes, dealt over all cores."""
    return sp.spread(_places(spark, d), "p_partkey")


def _ring(*points):
    x, y = F.col("x"), F.col("y")
    return F.array(*[F.struct((x + a).alias("lon"), (y + b).alias("lat")) for a, b in points])


def _made(kind: str, ring, coord_sys: str = "cartesian"):
    return F.struct(F.lit(kind).alias("kind"), F.lit(coord_sys).alias("coord_sys"), F.array(ring).alias("rings"))


POLAR = [(0, 55), (120, 60), (-120, 50), (0, 55)]
FLAT = [(-100, -40), (60, -70), (150, 30), (-20, 70), (-100, -40)]


@query("sp4_box_algebra", """SELECT p_partkey, NOT c AND x >= -30 AND e <= 40 AND y >= -30 AND y + 10 <= 50 AS covered, CASE WHEN c THEN 2 ELSE 1 END AS parts,
    CASE WHEN y <= 50 AND y + 10 >= -30 AND x <= 40 AND x + 20 >= -30 THEN 1 ELSE 0 END AS shared, greatest(y + 10, 50) AS north FROM
    (SELECT *, x + 20 > 180 AS c, CASE WHEN x + 20 > 180 THEN x - 340 ELSE x + 20 END AS e FROM (SELECT p_partkey, """ + _XY + " FROM part))")
def _(spark, d):
    east = F.when(F.col("x") + 20 > 180, F.col("x") - 340).otherwise(F.col("x") + 20)
    p = _places(spark, d).withColumn("b", bx.box(F.col("x"), F.col("y") + 10, east, F.col("y")))
    area, b = bx.box(*[F.lit(float(v)) for v in (-30, 50, 40, -30)]), F.col("b")
    return p.select("p_partkey", bx.box_covers_box(area, b).alias("covered"), F.size(bx.box_split(b)).alias("parts"), F.size(bx.box_intersections(area, b)).alias("shared"), bx.box_union(area, b)["north"].alias("north"))


@query("sp6_geodetic_ring", sql(f"SELECT order_id, line FROM granules WHERE {inside_arcs(POLAR)}", "granules"))
def _(spark, d):
    g = ad.granules(spark, d).where("lat >= 0")  # the ring lies in the north
    return g.where(sp.shape_covers_point(sp.polygon(POLAR), F.col("lon"), F.col("lat"))).select("order_id", "line")


@query("sp7_cartesian_ring", sql("SELECT order_id, line FROM granules WHERE " + " AND ".join(f"({c - a}) * (lat - ({b})) - ({e - b}) * (lon - ({a})) >= 0" for (a, b), (c, e) in zip(FLAT, FLAT[1:])), "granules"))
def _(spark, d):
    g = ad.granules(spark, d).where("lon between -100 and 150 and lat between -70 and 70")  # the box test first
    return g.where(sp.shape_covers_point(sp.polygon(FLAT, "cartesian"), F.col("lon"), F.col("lat"))).select("order_id", "line")


@query("sp9_line_meets_box", """SELECT p_partkey FROM (SELECT p_partkey, """ + _XY + """ FROM part) WHERE x + 8 >= -60 AND x <= 70 AND y + 8 >= -40 AND y <= 55
    AND 130 * (y + 40) - 95 * (x + 8 + 60) <= 0 AND 130 * (y + 8 + 40) - 95 * (x + 60) >= 0""")
def _(spark, d):
    line = F.struct(F.lit("line").alias("kind"), F.lit("cartesian").alias("coord_sys"), F.array(F.array(*[F.struct(F.lit(float(a)).alias("lon"), F.lit(float(b)).alias("lat")) for a, b in ((-60, -40), (70, 55))])).alias("rings"))
    box = sp.box_shape(bx.box(F.col("x"), F.col("y") + 8, F.col("x") + 8, F.col("y")))
    return _shape_places(spark, d).where(sp.shape_intersects(line, box)).select("p_partkey")


def _corner(lon: str, lat: str) -> str:
    """SQL: a point's unit vector as three numbers."""
    return f"cos(radians({lat})) * cos(radians({lon})) AS vx, cos(radians({lat})) * sin(radians({lon})) AS vy, sin(radians({lat})) AS vz"


CAP = [(0, 60), (90, 60), (180, 60), (-90, 60), (0, 60)]
_ARC = "degrees(atan(tan(radians(60)) / cos(radians(45)) * cos(radians({0} - floor({0} / 90) * 90 - 45))))"  # latitude of the cap's side at a longitude
_BOX = _XY.replace(" AS x", " + 0.2 AS x").replace(" AS y", " + 0.3 AS y")


@query("sp8_box_meets_cap", f"""SELECT p_partkey, n >= least(a, b, CASE WHEN floor(x / 90) < floor((x + 8) / 90) THEN 60 ELSE 90 END) AS met,
    y >= greatest(a, b, CASE WHEN floor((x + 45) / 90) < floor((x + 53) / 90) THEN {_ARC.format(45)} ELSE -90 END) AS covered
    FROM (SELECT *, {_ARC.format("x")} AS a, {_ARC.format("(x + 8)")} AS b, least(y + 14, 90) AS n FROM (SELECT p_partkey, {_BOX} FROM part))""")
def _(spark, d):
    """Boxes against a geodetic polygon around a pole: parallels against arcs."""
    p = _shape_places(spark, d).withColumns({"x": F.col("x") + 0.2, "y": F.col("y") + 0.3})
    box = sp.box_shape(bx.box(F.col("x"), F.least(F.col("y") + 14, F.lit(90.0)), F.col("x") + 8, F.col("y")))
    return p.select("p_partkey", sp.shape_intersects(sp.polygon(CAP), box).alias("met"), sp.shape_covers(sp.polygon(CAP), box).alias("covered"))


@query("sp8_polygons_meet", f"""WITH c AS (SELECT p_partkey, k, lon, lat, {_corner("lon", "lat")} FROM
    (SELECT p_partkey, k, x / 2 + CASE WHEN k IN (1, 2) THEN 6 ELSE 0 END AS lon, y / 2 + CASE WHEN k IN (2, 3) THEN 6 ELSE 0 END AS lat FROM (SELECT p_partkey, {_BOX} FROM part), range(4) r(k))),
    i AS (SELECT p_partkey, bool_or(inside) AS any_in, bool_and(inside) AS all_in FROM (SELECT p_partkey, {inside_arcs(AREA)} AS inside FROM c) GROUP BY 1),
    s AS (SELECT a.p_partkey, a.vx AS ax, a.vy AS ay, a.vz AS az, b.vx AS bx, b.vy AS by_, b.vz AS bz FROM c a JOIN c b ON a.p_partkey = b.p_partkey AND b.k = (a.k + 1) % 4),
    o AS (SELECT i, {_corner("lon", "lat")} FROM (VALUES {", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(AREA))}) t(i, lon, lat)),
    t AS (SELECT a.vx AS cx, a.vy AS cy, a.vz AS cz, b.vx AS dx, b.vy AS dy, b.vz AS dz FROM o a JOIN o b ON b.i = a.i + 1),
    x AS (SELECT DISTINCT p_partkey FROM (SELECT *, ay * bz - az * by_ AS nx, az * bx - ax * bz AS ny, ax * by_ - ay * bx AS nz, cy * dz - cz * dy AS mx, cz * dx - cx * dz AS my, cx * dy - cy * dx AS mz FROM s, t)
      WHERE (nx * cx + ny * cy + nz * cz) * (nx * dx + ny * dy + nz * dz) < 0 AND (mx * ax + my * ay + mz * az) * (mx * bx + my * by_ + mz * bz) < 0 AND (ax + bx) * (cx + dx) + (ay + by_) * (cy + dy) + (az + bz) * (cz + dz) > 0)
    SELECT i.p_partkey, any_in OR x.p_partkey IS NOT NULL AS met, all_in AS covered FROM i LEFT JOIN x USING (p_partkey)""")
def _(spark, d):
    """Geodetic polygons against a geodetic polygon."""
    p = _shape_places(spark, d).withColumns({"x": (F.col("x") + 0.2) / 2, "y": (F.col("y") + 0.3) / 2})
    own = _made("polygon", _ring((0, 0), (6, 0), (6, 6), (0, 6), (0, 0)), "geodetic")
    return p.select("p_partkey", sp.shape_intersects(sp.polygon(AREA), own).alias("met"), sp.shape_covers(sp.polygon(AREA), own).alias("covered"))


NOTCHED = [(-100, -60), (100, -60), (100, 60), (30, 60), (30, 0), (-10, 0), (-10, 60), (-100, 60), (-100, -60)]
HOLE = [(-70, -40), (-70, -10), (-40, -10), (-40, -40), (-70, -40)]


@query("sp8_notch_and_hole", f"""SELECT p_partkey, x <= 100 AND x + 8 >= -100 AND y <= 60 AND y + 8 >= -60 AND NOT (x > -10 AND x + 8 < 30 AND y > 0) AND NOT (x > -70 AND x + 8 < -40 AND y > -40 AND y + 8 < -10) AS met,
    x >= -100 AND x + 8 <= 100 AND y >= -60 AND y + 8 <= 60 AND NOT (x < 30 AND x + 8 > -10 AND y + 8 > 0) AND NOT (x < -40 AND x + 8 > -70 AND y < -10 AND y + 8 > -40) AS covered FROM (SELECT p_partkey, {_BOX} FROM part)""")
def _(spark, d):
    """Cartesian squares against a polygon with a notch and a hole."""
    p = _shape_places(spark, d).withColumns({"x": F.col("x") + 0.2, "y": F.col("y") + 0.3})
    area, own = sp.polygon(NOTCHED, "cartesian", [HOLE]), _made("polygon", _ring((0, 0), (8, 0), (8, 8), (0, 8), (0, 0)))
    return p.select("p_partkey", sp.shape_intersects(area, own).alias("met"), sp.shape_covers(area, own).alias("covered"))


@query("sp8_antimeridian", f"""SELECT p_partkey, lo <= 210 AND lo + 6 >= 160 AND y <= 30 AND y + 6 >= -30 AS met, lo >= 160 AND lo + 6 <= 210 AND y >= -30 AND y + 6 <= 30 AS covered
    FROM (SELECT p_partkey, (p_partkey * 7) % 100 + 130.25 AS lo, y FROM (SELECT p_partkey, {_BOX} FROM part))""")
def _(spark, d):
    """Cartesian squares about the antimeridian, some of them beyond 180, against a box across it."""
    p = _shape_places(spark, d).withColumns({"x": F.col("p_partkey") * 7 % 100 + 130.25, "y": F.col("y") + 0.3})
    p = p.withColumn("x", F.when(F.col("x") >= 180, F.col("x") - 360).otherwise(F.col("x")))  # a square across it ends beyond 180
    area, own = sp.box_shape(bx.box(*[F.lit(float(v)) for v in (160, 30, -150, -30)])), _made("polygon", _ring((0, 0), (6, 0), (6, 6), (0, 6), (0, 0)))
    return p.select("p_partkey", sp.shape_intersects(area, own).alias("met"), sp.shape_covers(area, own).alias("covered"))


@query("jn17_tile_shapes", f"""SELECT DISTINCT p_partkey, CAST(h AS INTEGER) AS h, CAST(v AS INTEGER) AS v FROM (SELECT p_partkey, v, unnest(range(CAST(least(floor((CASE WHEN w >= 0 THEN w * c0 ELSE w * c1 END + 180) / 10), 35) AS BIGINT), CAST(least(floor((CASE WHEN e >= 0 THEN e * c1 ELSE e * c0 END + 180) / 10), 35) AS BIGINT) + 1)) AS h
    FROM (SELECT *, least(cos(radians(lo)), cos(radians(hi))) AS c0, greatest(cos(radians(lo)), cos(radians(hi))) AS c1 FROM (SELECT p_partkey, v, w, w + 20 AS e, greatest(s, 80 - 10 * v) AS lo, least(s + 8, 90 - 10 * v) AS hi
      FROM (SELECT p_partkey, x * 0.9 + 0.37 AS w, y + 0.41 AS s FROM (SELECT p_partkey, {_XY} FROM part)), range(18) r(v)) WHERE lo < hi))""")
def _(spark, d):
    """Tiles of polygons."""
    p = _places(spark, d).withColumns({"x": F.col("x") * 0.9 + 0.37, "y": F.col("y") + 0.41})
    t = sp.assign_tiles(p.withColumn("shape", _made("polygon", _ring((0, 0), (20, 0), (20, 8), (0, 8), (0, 0)))))
    return t.select("p_partkey", F.explode("tiles").alias("t")).select("p_partkey", "t.h", "t.v")


@query("sp10_shape_box", """SELECT p_partkey, x AS west, CASE WHEN x + 60 > 180 THEN x - 300 ELSE x + 60 END AS east, round(CASE WHEN y > 0 THEN degrees(atan(tan(radians(y)) / cos(radians(30)))) ELSE y END, 6) AS north,
    round(CASE WHEN y < 0 THEN degrees(atan(tan(radians(y)) / cos(radians(30)))) ELSE y END, 6) AS south FROM (SELECT p_partkey, """ + _XY + " FROM part)")
def _(spark, d):
    far = F.when(F.col("x") + 60 > 180, F.col("x") - 300).otherwise(F.col("x") + 60)
    ring = F.array(F.struct(F.col("x").alias("lon"), F.col("y").alias("lat")), F.struct(far.alias("lon"), F.col("y").alias("lat")))
    b = _shape_places(spark, d).select("p_partkey", sp.shape_box(_made("line", ring, "geodetic")).alias("b"))
    return b.select("p_partkey", *[F.round(f"b.{c}", 6).alias(c) for c in ("west", "east", "north", "south")])


@query("sp12_shape_errors", "SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN 'ring is not closed' WHEN 2 THEN 'duplicate points' WHEN 3 THEN 'ring crosses itself' WHEN 4 THEN 'coordinates out of bounds' ELSE '' END AS errors FROM part")
def _(spark, d):
    k = F.col("p_partkey") % 5
    ring = (
        F.when(k == 1, _ring((0, 0), (8, 0), (8, 8), (0, 8))).when(k == 2, _ring((0, 0), (8, 0), (8, 0), (8, 8), (0, 0))).when(k == 3, _ring((0, 0), (8, 8), (8, 0), (0, 8), (0, 0)))
        .when(k == 4, _ring((0, 0), (8, 0), (8, 200), (0, 0))).otherwise(_ring((0, 0), (8, 0), (8, 8), (0, 8), (0, 0)))
    )
    return _shape_places(spark, d).select("p_partkey", F.array_join(sp.shape_errors(_made("polygon", ring)), "; ").alias("errors"))


@query("sp13_shapes_doc", "SELECT p_partkey, least(x, x / 2 - 3) AS west, greatest(y + 4, y / 2 + 1) AS north, greatest(x + 5, x / 2) AS east, least(y, y / 2) AS south FROM (SELECT p_partkey, x / 2 AS x, y FROM (SELECT p_partkey, " + _XY + " FROM part))")
def _(spark, d):
    p = _places(spark, d).withColumn("x", F.col("x") / 2)
    x, y = F.col("x"), F.col("y")
    return sp.shapes_doc(p.withColumn("boxes", F.array(bx.box(x, y + 4, x + 5, y), bx.box(x / 2 - 3, y / 2 + 1, x / 2, y / 2)))).select("p_partkey", "box.*")


@query("sp14_crossing_ranges")
def _(spark, d):
    s = ad.read(spark, d, "supplier").select(F.col("s_nationkey").alias("area_id"), (F.col("s_nationkey") * 13.0 - 160).alias("x"), (F.col("s_nationkey") * 5.0 - 60).alias("y")).distinct()
    areas = s.select("area_id", _ring((0, 0), (8, 0), (8, 6), (0, 6), (0, 0)).alias("ring"))
    orbits = ad.collections(spark, d).select(F.col("concept_id").alias("collection_id"), F.lit(94.0).alias("inclination"), F.lit(96.7).alias("period"), (F.lit(300.0) + F.col("version")).alias("swath_width"))
    return ob.crossing_ranges(areas, orbits)


@query("sp16_simplify_areas", "SELECT p_partkey, 5 AS points, true AS simplified FROM part")
def _(spark, d):
    ring = _ring((0, 0), (4, 0), (8, 0), (8, 4), (8, 8), (4, 8), (0, 8), (0, 4), (0, 0))
    out = sp.simplify_areas(_places(spark, d).withColumn("shape", _made("polygon", ring)), 5)
    return out.select("p_partkey", F.size(F.col("shape.rings")[0]).alias("points"), "simplified")


@query("st5_area_tiles", "SELECT DISTINCT CAST(least(floor((x * cos(radians(y)) + 180) / 10), 35) AS INTEGER) AS h, CAST(least(floor((90 - y) / 10), 17) AS INTEGER) AS v FROM (SELECT x + 0.37 AS x, y + 0.41 AS y FROM (SELECT " + _XY + " FROM part))")
def _(spark, d):
    return sp.area_tiles(_places(spark, d).withColumn("shape", sp.point_shape(F.col("x") + 0.37, F.col("y") + 0.41)))
