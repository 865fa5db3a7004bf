"""More queries on the driver's tables: documents, links, vocabularies, quality, sinks, boxes."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import boxes as bx, dates, filters as fl, numbers as nu, text as tx
from ..operators import documents as dc, edits as ed, facets as fc, joins as jn, quality as dq, relevance as rl, revisions as rv, sorting as so, suggest as sg
from ..sources import adapters as ad, sinks as sk
from ..sources.adapters import sql
from .registry import query

TS = lambda s: F.lit(s).cast("timestamp_ntz")


# ---------------------------------------------------------------- filters on nested and odd fields


@query("flt11_num_eq", sql("SELECT order_id, line FROM granules WHERE size = 17", "granules"))
def _(spark, d):
    return ad.granules(spark, d).where(fl.num_eq("size", 17)).select("order_id", "line")


@query("flt24_readable_name", "SELECT o_orderkey FROM orders WHERE lower(o_orderpriority) LIKE '5-%' OR lower(o_orderstatus) LIKE '5-%'")
def _(spark, d):
    return ad.read(spark, d, "orders").where(fl.readable_name("5-*", "o_orderstatus", "o_orderpriority", pattern=True)).select("o_orderkey")


@query("flt25_data_type", sql("SELECT concept_id FROM collections WHERE version % 3 <> 1", "collections"))
def _(spark, d):
    c = ad.collections(spark, d).withColumn("data_type", F.when(F.col("version") % 3 == 0, "SCIENCE_QUALITY").when(F.col("version") % 3 == 1, "OTHER"))
    return c.where(fl.collection_data_type("science_quality")).select("concept_id")


@query("flt27_tag_match", sql("SELECT concept_id FROM collections WHERE lower(platform) LIKE 'brand#1%' AND lower(level) = 'promo'", "collections"))
def _(spark, d):
    c = ad.collections(spark, d).withColumn("tags", F.array(F.struct(F.col("platform").alias("key"), F.col("level").alias("value"), F.lit("me").alias("originator"))))
    return c.where(fl.tag_match(key="BRAND#1*", value="promo", originator="Me")).select("concept_id")


@query("flt29_pass_match", sql("SELECT order_id, line FROM granules WHERE line = 3 AND size BETWEEN 10 AND 20", "granules"))
def _(spark, d):
    g = ad.granules(spark, d).withColumn("passes", F.array(F.struct(F.col("line").alias("pass"), F.array(F.concat(F.col("size").cast("int").cast("string"), F.lit("L"))).alias("tiles"))))
    return g.where(fl.pass_match([{"pass": 3, "tiles": [f"{i}L" for i in range(10, 21)]}])).select("order_id", "line")


@query("flt31_resolution_range", sql("SELECT concept_id FROM collections WHERE version * 100 BETWEEN 500 AND 2000", "collections"))
def _(spark, d):
    return ad.collections(spark, d).withColumn("resolutions", F.array((F.col("version") * 100).cast("double"))).where(fl.resolution_range("500 meters to 2 km")).select("concept_id")


@query("flt36_grid_match", sql("SELECT order_id, line FROM granules WHERE size >= 5 AND size - 3 <= 9 AND line = 2", "granules"))
def _(spark, d):
    g = ad.granules(spark, d).withColumn("grid", F.struct(F.lit("WRS").alias("name"), (F.col("size") - 3).alias("start_1"), F.col("size").alias("end_1"), F.col("line").cast("double").alias("start_2"), F.lit(None).cast("double").alias("end_2")))
    return g.where(fl.grid_match("wrs", fl.parse_grid("5-9,2"))).select("order_id", "line")


@query("flt37_orbits", sql("SELECT order_id, line FROM granules WHERE line <= 5 AND line + 2 >= 4 AND (lon >= 150 OR lon <= -150)", "granules"))
def _(spark, d):
    g = ad.granules(spark, d).withColumn("orbit_domains", F.array(F.struct(F.lit(None).cast("int").alias("orbit_number"), F.col("line").alias("start_orbit"), (F.col("line") + 2).alias("stop_orbit"), F.col("lon").alias("equator_lon"), F.col("start_date").alias("equator_time"))))
    return g.where(fl.orbit_number(4, 5) & fl.equator_longitude(150, -150)).select("order_id", "line")


@query("flt39_equator_date", sql("SELECT order_id, line FROM granules WHERE start_date BETWEEN TIMESTAMP '1997-05-01' AND TIMESTAMP '1997-05-20'", "granules"))
def _(spark, d):
    g = ad.granules(spark, d).withColumn("orbit_domains", F.array(F.struct(F.col("start_date").alias("equator_time"))))
    return g.where(fl.equator_date("1997-05-01", "1997-05-20")).select("order_id", "line")


@query("flt41_mbr_overlap", sql("SELECT order_id, line FROM granules WHERE lat + half >= -20 AND lat - half <= 20 AND (lon - half <= 40 AND lon + half >= 10)", "granules"))
def _(spark, d):
    g = ad.granules(spark, d).withColumns({"b_west": F.col("lon") - F.col("half"), "b_east": F.col("lon") + F.col("half"), "b_north": F.col("lat") + F.col("half"), "b_south": F.col("lat") - F.col("half")})
    return g.where(fl.mbr_overlap("b_", 10, 20, 40, -20)).select("order_id", "line")


# ---------------------------------------------------------------- joins


@query("src4_find_associations", "SELECT DISTINCT l_partkey AS source_id, l_suppkey AS associated_id FROM lineitem WHERE l_partkey = 7 OR l_suppkey = 7")
def _(spark, d):
    links = ad.read(spark, d, "lineitem").select(F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("associated_id")).distinct()
    return jn.find_associations(links, 7)


@query("jn3_by_concept_ids", sql("SELECT order_id, line, collection_id FROM granules WHERE order_id IN (5, 6, 7, 8, 9, 10) AND collection_id IN (SELECT concept_id FROM collections WHERE concept_id < 900)", "granules", "collections"))
def _(spark, d):
    return jn.by_concept_ids(ad.granules(spark, d), [5, 6, 7, 8, 9, 10], list(range(900)), key="order_id").select("order_id", "line", "collection_id")


@query("jn9_generic_associations", "SELECT id AS concept_id, count(*) AS n FROM (SELECT DISTINCT 'P' || l_partkey AS id, 'S' || l_suppkey AS o FROM lineitem UNION SELECT DISTINCT 'S' || l_suppkey, 'P' || l_partkey FROM lineitem) GROUP BY 1")
def _(spark, d):
    li = ad.read(spark, d, "lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("source_id"), F.concat(F.lit("S"), "l_suppkey").alias("associated_id")).distinct()
    links = li.withColumns({"source_type": F.lit("part"), "associated_type": F.lit("supplier"), "deleted": F.lit(False)})
    ids = li.select(F.col("source_id").alias("concept_id")).union(li.select("associated_id")).distinct()
    n = F.aggregate(F.map_values("associations"), F.lit(0), lambda a, x: a + F.size(x))
    return jn.with_generic_associations(ids, links).select("concept_id", n.cast("long").alias("n"))


@query("jn11_lookup_location", "SELECT c_custkey, r_name AS category, n_name AS type FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    c, n, r = (ad.read(spark, d, t) for t in ("customer", "nation", "region"))
    words = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").cast("string").alias("uuid"), F.col("r_name").alias("category"), F.col("n_name").alias("type"))
    named = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select("c_custkey", F.lower("n_name").alias("location"))
    return jn.lookup_location(named, words, ["category", "type"]).select("c_custkey", "category", "type")


@query("jn13_with_orbit", sql("SELECT order_id, line, version * 2.0 AS swath FROM granules JOIN collections ON collection_id = concept_id", "granules", "collections"))
def _(spark, d):
    c = ad.collections(spark, d).select("concept_id", F.struct((F.col("version") * 2.0).alias("swath_width")).alias("orbit"))
    return jn.with_orbit(ad.granules(spark, d), c).select("order_id", "line", F.col("orbit_parameters.swath_width").alias("swath"))


@query("jn19_virtual_products", sql("SELECT order_id, line, 'AST_V' || substr(short_name, 1, 3) || order_id AS virtual_ur FROM granules JOIN collections ON collection_id = concept_id WHERE flag = 'R' AND short_name LIKE 'red%'", "granules", "collections"))
def _(spark, d):
    c = ad.collections(spark, d).select(F.col("concept_id").alias("collection_id"), "short_name")
    g = ad.granules(spark, d).join(c, "collection_id").withColumns({"provider_id": F.lit("P"), "granule_ur": F.concat(F.lit("AST_S"), F.substring("short_name", 1, 3), "order_id"), "attributes": F.create_map(F.lit("flag"), F.col("flag"))})
    config = c.where("short_name like 'red%'").select(F.lit("P").alias("provider_id"), F.col("short_name").alias("source_short_name"), F.lit("V").alias("virtual_short_name"), F.lit("flag").alias("match_field"), F.lit("R").alias("match_value"), F.lit("AST_S").alias("ur_from"), F.lit("AST_V").alias("ur_to")).distinct()
    return jn.to_virtual(g, config).select("order_id", "line", "virtual_ur")


def _atom(field: str, value=None, low=None, high=None):
    return F.struct(F.lit(field).alias("field"), *[(F.lit(None) if x is None else x).cast(t).alias(n) for n, x, t in (("value", value, "string"), ("low", low, "double"), ("high", high, "double"))])


@query("jn21_match_subscriptions", sql("SELECT r.concept_id, r.revision_id, c.c_custkey AS subscription_id FROM revisions r JOIN customer c ON c.c_custkey = r.concept_id WHERE r.revision_date > TIMESTAMP '2024-01-20' AND (c.c_mktsegment <> 'BUILDING' OR r.value > 20)", "revisions"))
def _(spark, d):
    r = ad.revisions(spark, d).withColumn("collection_id", F.col("concept_id"))
    atoms = F.when(F.col("c_mktsegment") == "BUILDING", F.array(_atom("value", low=F.lit(math.nextafter(20.0, 21.0)))))
    s = ad.read(spark, d, "customer").select(F.col("c_custkey").alias("concept_id"), F.lit("u").alias("subscriber_id"), F.col("c_custkey").alias("collection_id"), atoms.alias("atoms"), TS("2024-01-20").alias("last_notified_at"))
    return jn.match_subscriptions(r, s, ["value"]).select("concept_id", "revision_id", "subscription_id")


@query("jn21_subscription_atoms", sql("""SELECT r.concept_id, r.revision_id, c.c_custkey AS subscription_id FROM revisions r JOIN customer c ON c.c_custkey % 10 = r.concept_id % 10
    WHERE (c.c_nationkey % 5 = 0 OR r.event_type = CASE c.c_nationkey % 5 WHEN 1 THEN 'click' WHEN 2 THEN 'error' WHEN 3 THEN 'view' ELSE 'purchase' END)
    AND (c.c_nationkey % 3 = 0 OR r.value BETWEEN c.c_custkey % 97 AND c.c_custkey % 97 + c.c_nationkey)
    AND (c.c_nationkey % 4 <> 1 OR r.revision_id >= 40) AND (c.c_nationkey % 6 <> 5 OR r.revision_date > TIMESTAMP '2024-01-15')""", "revisions"))
def _(spark, d):
    """Every customer subscribes by values, ranges, both or neither, a tenth of them to a collection of its own."""
    r = ad.revisions(spark, d).withColumn("collection_id", F.col("concept_id") % 10)
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    kind = F.when(n % 5 == 1, "CLICK").when(n % 5 == 2, "error").when(n % 5 == 3, "View").otherwise("purchase")
    atoms = F.array_compact(F.array(F.when(n % 5 != 0, _atom("event_type", kind)), F.when(n % 3 != 0, _atom("value", low=k % 97, high=k % 97 + n)), F.when(n % 4 == 1, _atom("revision_id", low=F.lit(40)))))
    s = ad.read(spark, d, "customer").select(k.alias("concept_id"), F.lit("u").alias("subscriber_id"), (k % 10).alias("collection_id"), atoms.alias("atoms"), F.when(n % 6 == 5, TS("2024-01-15")).alias("last_notified_at"))
    return jn.match_subscriptions(r, s, ["event_type", "value", "revision_id"]).select("concept_id", "revision_id", "subscription_id")


@query("st4_intersect_ids", sql("SELECT concept_id FROM collections WHERE version > 25 AND level = 'PROMO' AND short_name LIKE '%ring%'", "collections"))
def _(spark, d):
    c = ad.collections(spark, d)
    return jn.intersect_ids(c.where("version > 25"), c.where("level = 'PROMO'"), c.where("short_name like '%ring%'"))


# ---------------------------------------------------------------- facets, windows, orders


@query("ag6_facet_cycle", sql("SELECT CAST(size AS INTEGER) AS pass, count(DISTINCT order_id) AS n FROM granules WHERE line = 2 GROUP BY 1", "granules"))
def _(spark, d):
    g = ad.granules(spark, d).select(F.col("order_id").alias("concept_id"), F.col("line").alias("cycle"), F.array(F.struct(F.col("size").cast("int").alias("pass"))).alias("passes"))
    return fc.facet_cycle(g, 2)


_AG25 = """SELECT '[' || string_agg('{"value":"' || p_brand || '","below":' || ts || '}', ',' ORDER BY p_brand) || ']' AS tree FROM (SELECT p_brand, '[' || string_agg('{"value":"' || p_type || '","below":[' || ns || ']}', ',' ORDER BY p_type) || ']' AS ts FROM
    (SELECT p_brand, p_type, string_agg('{"value":"' || p_name || '","below":[]}', ',' ORDER BY p_name) AS ns FROM (SELECT DISTINCT p_brand, p_type, p_name FROM part) GROUP BY 1, 2) GROUP BY 1)"""


@query("ag25_keyword_tree", _AG25)
@query("ag25_keyword_tree_whole", _AG25)
def _(spark, d):
    return fc.keyword_tree(ad.read(spark, d, "part"), ["p_brand", "p_type", "p_name"])


@query("ag25_keyword_nodes", """WITH k AS (SELECT DISTINCT list_filter([p_brand, CASE WHEN p_size % 7 <> 0 THEN p_type END, p_name], lambda x: x IS NOT NULL) AS p FROM part),
    n AS (SELECT p[1:d] AS path, d AS depth, count(*) AS leaves FROM k, range(1, 4) r(d) WHERE d <= len(p) GROUP BY 1, 2)
    SELECT array_to_string(n.path, '|') AS path, CAST(n.depth AS INTEGER) AS depth, n.path[-1] AS value, count(b.path) AS children, n.leaves FROM n LEFT JOIN n b ON b.depth = n.depth + 1 AND b.path[1:n.depth] = n.path GROUP BY n.path, n.depth, n.leaves""")
def _(spark, d):
    p = ad.read(spark, d, "part").withColumn("p_type", F.when(F.col("p_size") % 7 != 0, F.col("p_type")))  # some without that level
    return fc.keyword_nodes(p, ["p_brand", "p_type", "p_name"]).withColumn("path", F.array_join("path", "|"))


@query("wn8_rank_positions", """SELECT source AS test_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS place, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INTEGER) AS position FROM documents JOIN labels USING (doc_id) WHERE quality = 0""")
def _(spark, d):
    from .more import _tests

    return rl.rank_positions(*_tests(spark, d))


@query("so2_default_sort", sql("SELECT provider_id, start_date, concept_id FROM (SELECT provider_id, start_date, order_id * 10 + line AS concept_id FROM granules) ORDER BY provider_id, start_date, concept_id", "granules"))
def _(spark, d):
    g = ad.granules(spark, d).select("provider_id", "start_date", (F.col("order_id") * 10 + F.col("line")).alias("concept_id"))
    return so.sort_by(g, so.default_sort("granule"), "granule")


@query("so5_has_granules_order", sql("SELECT concept_id FROM collections ORDER BY concept_id IN (SELECT collection_id FROM granules WHERE size > 49) DESC, concept_id", "collections", "granules"))
def _(spark, d):
    has = ad.granules(spark, d).where("size > 49").select(F.col("collection_id").alias("concept_id"), F.lit(True).alias("h")).distinct()
    c = ad.collections(spark, d).join(has, "concept_id", "left").withColumn("has_granules", F.coalesce("h", F.lit(False)))
    return c.orderBy(so.has_granules_order(), "concept_id").select("concept_id")


# ---------------------------------------------------------------- documents and sinks


@query("prj1_granule_docs", sql("SELECT order_id, line, coalesce(CASE WHEN flag <> 'N' THEN cloud_cover END, size) AS cloud_cover, lower(c.short_name) AS short_name_lowercase, flag = 'A' AS downloadable FROM granules LEFT JOIN collections c ON collection_id = c.concept_id", "granules", "collections"))
def _(spark, d):
    g = ad.granules(spark, d)
    g = g.withColumns({"granule_ur": F.concat_ws("-", "order_id", "line"), "producer_id": F.lit(None).cast("string"), "created_at": F.col("start_date"), "revision_date": F.col("start_date"), "cloud_cover": F.when(F.col("flag") != "N", F.col("cloud_cover")),
                       "attributes": F.array(F.struct(F.lit("Cloud_Coverage").alias("name"), F.col("size").cast("string").alias("value"))), "links": F.array(F.struct(F.lit("u").alias("href"), F.when(F.col("flag") == "A", "GET DATA").otherwise("OTHER").alias("type")))})
    c = ad.collections(spark, d).select("concept_id", F.col("short_name").alias("entry_title"), "short_name", F.col("version").cast("string").alias("version_id"))
    return dc.build_granule_docs(g, c).select("order_id", "line", "cloud_cover", "short_name_lowercase", "downloadable")


@query("prj2_collection_docs", sql("SELECT concept_id, CAST(version AS VARCHAR) AS parsed_version, short_name || '_00' || version AS entry_id FROM collections", "collections"))
def _(spark, d):
    c = ad.collections(spark, d).select("concept_id", "short_name", F.concat(F.lit("00"), "version").alias("version_id"), F.col("level").alias("entry_title"), F.lit(None).cast("string").alias("summary"), F.create_map(F.lit("a"), F.lit("b")).alias("tags"))
    return dc.build_collection_docs(c).select("concept_id", "parsed_version", "entry_id")


@query("prj3_tombstones", sql("SELECT concept_id, revision_id, revision_date FROM revisions WHERE deleted", "revisions"))
def _(spark, d):
    r = ad.revisions(spark, d).withColumns({c: F.lit("x") for c in ("provider_id", "native_id", "short_name", "version_id")})
    return dc.build_tombstone_docs(r).select("concept_id", "revision_id", "revision_date")


@query("prj6_science_keywords", sql("SELECT concept_id, CASE WHEN level <> 'PROMO' THEN upper(trim(level)) END AS topic FROM collections", "collections"))
def _(spark, d):
    levels = [F.when(F.col("level") == "PROMO", " Not provided").otherwise(F.lower("level")).alias(x) if x == "topic" else F.lit("e").alias(x) for x in dc.LEVELS]
    c = ad.collections(spark, d).select("concept_id", F.array(F.struct(*levels)).alias("science_keywords"))
    return dc.science_keyword_docs(c).select("concept_id", F.col("science_keywords")[0]["topic"].alias("topic"))


@query("prj10_filter_tags", sql("SELECT concept_id, platform AS kept FROM collections WHERE lower(platform) LIKE 'brand#1%'", "collections"))
def _(spark, d):
    c = ad.collections(spark, d).select("concept_id", F.create_map(F.col("platform"), F.lit(1), F.lit("zz"), F.lit(2)).alias("tags"))
    return dc.filter_tags(c, ["Brand#1*"]).where(F.cardinality("tags") > 0).select("concept_id", F.map_keys("tags")[0].alias("kept"))


@query("snk1_granule_csv", sql("""SELECT order_id || '-' || line AS "Granule UR", strftime(start_date, '%Y-%m-%dT%H:%M:%SZ') AS "Start Time", 'u' AS "Online Access URLs", '' AS "Browse URLs" FROM granules""", "granules"))
def _(spark, d):
    g = ad.granules(spark, d).withColumns({"granule_ur": F.concat_ws("-", "order_id", "line"), "producer_id": F.lit(None).cast("string"), "day_night": F.lit("DAY"), "links": F.array(F.struct(F.lit("u").alias("href"), F.lit("GET DATA").alias("type")))})
    return sk.to_granule_csv(g).select("Granule UR", "Start Time", "Online Access URLs", "Browse URLs")


@query("snk5_holdings", sql("""SELECT platform AS "Provider Id", short_name AS "Entry Title", c.concept_id AS "Concept Id", count(g.collection_id) AS "Granule Count" FROM collections c LEFT JOIN granules g ON g.collection_id = c.concept_id GROUP BY 1, 2, 3""", "collections", "granules"))
def _(spark, d):
    c = ad.collections(spark, d).select("concept_id", F.col("platform").alias("provider_id"), F.col("short_name").alias("entry_title"))
    return sk.to_holdings_csv(fc.provider_holdings(c, ad.granules(spark, d)))


# ---------------------------------------------------------------- dates, numbers, boxes


@query("dt1_parse_datetime", "SELECT event_id, date_trunc('second', ts) AS t FROM events")
def _(spark, d):
    form = F.element_at(F.array(*[F.date_format("ts", f) for f in ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")]), (F.col("event_id") % 3 + 1).cast("int"))
    return ad.read(spark, d, "events").select("event_id", dates.parse_datetime(form).alias("t"))


@query("nu2_resolutions", sql("SELECT concept_id, CASE WHEN version % 3 = 0 THEN '0.0' WHEN version % 3 = 1 THEN '' ELSE CAST(version * 1000.0 AS VARCHAR) END AS metres FROM collections WHERE version < 1000", "collections").replace("CAST(version * 1000.0 AS VARCHAR)", "CAST(CAST(version * 1000 AS DOUBLE) AS VARCHAR)"))
def _(spark, d):
    r = F.struct(F.col("version").cast("double").alias("x"), F.col("version").cast("double").alias("y"), F.lit("Kilometers").alias("unit"), F.when(F.col("version") % 3 == 1, "Scan Extremes").alias("angle"), (F.col("version") % 3 == 0).alias("point"))
    return ad.collections(spark, d).select("concept_id", F.array_join(F.transform(nu.resolutions(F.array(r)), lambda x: x.cast("string")), ",").alias("metres"))


@query("sp2_box_covers_point", sql("SELECT order_id, line FROM granules WHERE lat BETWEEN -30 AND 40 AND (lon >= 100 OR lon <= -100)", "granules"))
def _(spark, d):
    b = bx.box(F.lit(100.0), F.lit(40.0), F.lit(-100.0), F.lit(-30.0))
    return ad.granules(spark, d).where(bx.box_covers_point(b, F.col("lon"), F.col("lat"))).select("order_id", "line")


@query("sp11_circle_covers_point", sql("SELECT order_id, line FROM granules WHERE 2 * 6367435.0 * asin(sqrt(least(1.0, pow(sin((radians(lat) - radians(10.0)) / 2), 2) + cos(radians(10.0)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(20.0)) / 2), 2)))) <= 2500000", "granules"))
def _(spark, d):
    return ad.granules(spark, d).where(bx.circle_covers_point(F.lit(20.0), F.lit(10.0), F.lit(2_500_000.0), F.col("lon"), F.col("lat"))).select("order_id", "line")


# ---------------------------------------------------------------- quality and maintenance


@query("dq2_spatial_repr", sql("SELECT order_id, line, CASE WHEN version % 3 = 0 AND flag <> 'A' THEN 'geometry required' WHEN version % 3 = 1 AND flag <> 'R' THEN 'orbit required' WHEN version % 3 = 2 AND flag IN ('A', 'R') THEN 'spatial forbidden' END AS error FROM granules JOIN collections ON collection_id = concept_id", "granules", "collections"))
def _(spark, d):
    c = ad.collections(spark, d).select("concept_id", F.when(F.col("version") % 3 == 0, "GEODETIC").when(F.col("version") % 3 == 1, "ORBIT").otherwise("NO_SPATIAL").alias("spatial_repr"))
    g = ad.granules(spark, d).withColumns({"has_shape": F.col("flag") == "A", "has_orbit": F.col("flag") == "R"})
    return dq.check_spatial_repr(g, c).select("order_id", "line", "error")


@query("dq4_collection_ref", sql("SELECT order_id, line, CASE WHEN flag = 'N' THEN 'no collection reference' WHEN flag = 'R' THEN 'short_name differs' ELSE '' END AS errors FROM granules", "granules"))
def _(spark, d):
    c = ad.collections(spark, d).select("concept_id", F.lit("t").alias("entry_title"), F.lit("i").alias("entry_id"), F.lit("s").alias("short_name"), F.lit("1").alias("version_id"))
    name = F.when(F.col("flag") == "R", "other").when(F.col("flag") == "A", "s")
    g = ad.granules(spark, d).withColumns({"entry_title": F.lit(None).cast("string"), "entry_id": F.lit(None).cast("string"), "short_name": name, "version_id": F.when(F.col("flag") != "N", "1")})
    return dq.check_collection_ref(g, c).select("order_id", "line", F.array_join("errors", ",").alias("errors"))


@query("dq5_check_grid", sql("SELECT order_id, line, CASE WHEN size > 40 THEN 'start_1 out of bounds' ELSE '' END AS errors FROM granules", "granules"))
def _(spark, d):
    one = F.lit(1.0)
    g = ad.granules(spark, d).withColumns({"grid": F.struct(F.col("size").alias("start_1"), one.alias("end_1"), one.alias("start_2"), one.alias("end_2")), "bounds": F.struct(one.alias("min_1"), F.lit(40.0).alias("max_1"), one.alias("min_2"), one.alias("max_2"))})
    return dq.check_grid(g).select("order_id", "line", F.array_join("errors", ",").alias("errors"))


@query("dq11_standard_product", sql("SELECT provider_id, CASE WHEN consortium <> 'ASIA' THEN 'provider not in consortium' ELSE '' END AS errors FROM providers", "providers"))
def _(spark, d):
    p = ad.providers(spark, d)
    c = p.select("provider_id", F.lit(True).alias("standard_product"), F.lit("SCIENCE_QUALITY").alias("data_type"))
    return dq.check_standard_product(c, p.select("provider_id", F.array("consortium").alias("consortiums")), "asia").select("provider_id", F.array_join("errors", ",").alias("errors"))


@query("dq13_check_revisions", sql("SELECT concept_id, revision_id, CASE WHEN revision_id > 60 THEN 'revision too high' ELSE '' END AS errors FROM (SELECT 'C' || concept_id || '-P' AS concept_id, revision_id FROM revisions)", "revisions"))
def _(spark, d):
    r = ad.revisions(spark, d).select(F.concat(F.lit("C"), "concept_id", F.lit("-P")).alias("concept_id"), "revision_id", F.lit("collection").alias("concept_type"), F.lit("P").alias("provider_id"), F.lit("n").alias("native_id"))
    return dq.check_revisions(r, 60).select("concept_id", "revision_id", F.array_join("errors", ",").alias("errors"))


@query("mt6_refresh_fingerprints", "SELECT p_partkey FROM part WHERE p_size % 4 <> 0")
def _(spark, d):
    none = F.array().cast("array<struct<Name:string,Size:int,Type:string>>")
    fp = tx.variable_fingerprint(F.col("p_name"), F.col("p_brand"), none)
    p = ad.read(spark, d, "part").withColumn("fingerprint", F.when(F.col("p_size") % 4 == 0, fp).when(F.col("p_size") % 4 == 1, "stale"))
    return sg.refresh_fingerprints(p, F.col("p_name"), F.col("p_brand"), none).select("p_partkey")


@query("js2_granule_edit", sql("SELECT order_id || '-' || line AS granule_ur, CASE WHEN flag = 'A' THEN 'new' ELSE 'old' END AS url, flag = 'A' AS edited FROM (SELECT order_id, line, min(flag) AS flag FROM granules GROUP BY 1, 2)", "granules"))
def _(spark, d):
    g = ad.granules(spark, d).groupBy("order_id", "line").agg(F.min("flag").alias("flag")).select(F.concat_ws("-", "order_id", "line").alias("granule_ur"), "flag", F.array(F.struct(F.lit("old").alias("url"))).alias("access_links"))
    i = g.where("flag = 'A'").select("granule_ur", F.lit("update_field:access").alias("event_type"), F.lit("old").alias("url"), F.lit("new").alias("new_url"), F.lit(None).cast("string").alias("value"))
    return ed.granule_edit(g, i).select("granule_ur", F.col("access_links")[0]["url"].alias("url"), "edited")


@query("wn2_old_revisions_keep1", sql("SELECT concept_id, count(*) AS n FROM (SELECT concept_id FROM revisions QUALIFY row_number() OVER (PARTITION BY concept_id ORDER BY revision_id DESC) > 1) GROUP BY 1", "revisions"))
def _(spark, d):
    return rv.old_revisions(ad.revisions(spark, d), 1).groupBy("concept_id").agg(F.count("*").alias("n"))


@query("tx2_keyword_phrases", sql("SELECT concept_id, lower(short_name) AS phrase FROM collections", "collections"))
def _(spark, d):
    p = tx.keyword_phrases([F.col("short_name")])
    return ad.collections(spark, d).where(F.array_contains(p, F.concat(F.lit(" "), F.lower("short_name"), F.lit(" ")))).select("concept_id", F.lower("short_name").alias("phrase"))


@query("sm0_windowed_events", "SELECT date_trunc('hour', ts) AS start, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    from ..streaming.events import windowed_counts

    e = ad.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_counts(e).withColumn("start", F.col("start").cast("timestamp_ntz"))


