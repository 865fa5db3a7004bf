"""Queries on the driver's tables: revisions, filters, joins, facets, counts, timelines, orders."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, filters as fl
from ..operators import facets as fc, joins as jn, revisions as rv, sorting as so, timeline as tl
from ..sources import adapters as ad
from ..sources.adapters import sql
from .registry import query

YEAR_98 = (dt.datetime(1998, 1, 1), dt.datetime(1998, 12, 31))
R = ["concept_id", "revision_id", "revision_date", "deleted", "transaction_id"]
RS = ", ".join(R)
G = ["collection_id", "provider_id", "order_id", "line", "start_date", "end_date", "access_value"]
GS = ", ".join(G)


@query(
    "flagship_live_granules",
    sql("""SELECT c.concept_id, c.short_name, count(g.collection_id) AS granule_count FROM collections c LEFT JOIN
        (SELECT collection_id FROM granules WHERE start_date <= TIMESTAMP '1998-12-31' AND (end_date IS NULL OR end_date >= TIMESTAMP '1998-01-01') AND cloud_cover <= 5) g
        ON g.collection_id = c.concept_id WHERE lower(c.level) = 'promo' GROUP BY 1, 2 ORDER BY granule_count DESC, c.concept_id""", "collections", "granules"),
)
def flagship_live_granules(spark: SparkSession, d: str) -> DataFrame:
    """Granules in a time range of matching collections, counted for each, zero-filled, ordered."""
    c = ad.collections(spark, d).where(fl.string_eq("level", "promo")).select("concept_id", "short_name")
    pred = fl.temporal_intersects(*YEAR_98) & fl.num_range("cloud_cover", None, 5)
    return fc.granule_counts(c, ad.granules(spark, d), pred).orderBy(F.desc("granule_count"), "concept_id")


# ---------------------------------------------------------------- revisions


@query("wn1_latest_revisions", sql(f"SELECT {RS} FROM revisions QUALIFY row_number() OVER (PARTITION BY concept_id ORDER BY revision_id DESC) = 1", "revisions"))
def _(spark, d):
    return rv.latest_revisions(ad.revisions(spark, d).select(*R))


@query("wn2_old_revisions", sql(f"SELECT {RS} FROM revisions QUALIFY row_number() OVER (PARTITION BY concept_id ORDER BY revision_id DESC) > 10", "revisions"))
def _(spark, d):
    return rv.old_revisions(ad.revisions(spark, d).select(*R))


@query("wn3_highest_visible", sql(f"SELECT {RS} FROM revisions WHERE NOT deleted QUALIFY row_number() OVER (PARTITION BY concept_id ORDER BY revision_id DESC) = 1", "revisions"))
def _(spark, d):
    return rv.highest_visible(ad.revisions(spark, d).select(*R))


@query("wn4_transaction_conflicts", sql("""SELECT * FROM (SELECT concept_id, revision_id, t AS transaction_id, max(t) OVER (PARTITION BY concept_id ORDER BY revision_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_max
    FROM (SELECT concept_id, revision_id, (transaction_id * 7919) % 10007 AS t FROM revisions)) WHERE transaction_id <= prior_max""", "revisions"))
def _(spark, d):
    r = ad.revisions(spark, d).select("concept_id", "revision_id", (F.col("transaction_id") * 7919 % 10007).alias("transaction_id"))
    return rv.transaction_conflicts(r)


@query("wn7_merge_ranges", sql("""SELECT collection_id, min(start_date) AS start_date, nullif(max(e), TIMESTAMP '9999-12-31') AS end_date FROM (
    SELECT *, sum(CASE WHEN reach IS NULL OR start_date >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY collection_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, max(e) OVER (PARTITION BY collection_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (
    SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY start_date NULLS FIRST, e) AS i FROM (
    SELECT collection_id, start_date, coalesce(end_date, TIMESTAMP '9999-12-31') AS e FROM granules)))) GROUP BY collection_id, island""", "granules"))
def _(spark, d):
    return rv.merge_ranges(ad.granules(spark, d).select("collection_id", "start_date", "end_date"), "collection_id", "start_date", "end_date")


@query("wn9_change_mode", sql("SELECT CASE WHEN deleted THEN 'Delete' WHEN revision_id = 1 THEN 'New' ELSE 'Update' END AS mode, count(*) AS n FROM revisions GROUP BY 1", "revisions"))
def _(spark, d):
    return rv.change_mode(ad.revisions(spark, d)).groupBy("mode").agg(F.count("*").alias("n"))


@query("jn20_diff_revisions", sql("""SELECT concept_id, revision_id, value, lag(value) OVER w AS old_value, event_type, lag(event_type) OVER w AS old_event_type FROM revisions WINDOW w AS (PARTITION BY concept_id ORDER BY revision_id)""", "revisions"))
def _(spark, d):
    r = ad.revisions(spark, d).select("concept_id", "revision_id", "value", "event_type")
    return rv.diff_revisions(r, columns=["value", "event_type"])


@query("src3_concepts_between", sql(f"SELECT {RS} FROM revisions WHERE revision_date >= TIMESTAMP '2024-01-05' AND revision_date < TIMESTAMP '2024-01-12'", "revisions"))
def _(spark, d):
    return rv.concepts_between(ad.revisions(spark, d).select(*R), "2024-01-05", "2024-01-12")


@query("st2_deleted_collections", sql("""SELECT v.concept_id, v.revision_id FROM (SELECT * FROM revisions WHERE NOT deleted QUALIFY row_number() OVER (PARTITION BY concept_id ORDER BY revision_id DESC) = 1) v
    WHERE v.concept_id IN (SELECT concept_id FROM revisions WHERE deleted AND revision_date >= TIMESTAMP '2024-01-10' AND revision_date < TIMESTAMP '2024-02-01')
    AND v.concept_id NOT IN (SELECT concept_id FROM (SELECT * FROM revisions QUALIFY row_number() OVER (PARTITION BY concept_id ORDER BY revision_id DESC) = 1) WHERE NOT deleted)""", "revisions"))
def _(spark, d):
    return rv.deleted_collections(ad.revisions(spark, d), "2024-01-10", "2024-02-01").select("concept_id", "revision_id")


@query("st3_deleted_granules", sql("""SELECT concept_id, revision_id, revision_date FROM (SELECT * FROM revisions QUALIFY row_number() OVER (PARTITION BY concept_id ORDER BY revision_id DESC) = 1)
    WHERE deleted AND revision_date >= TIMESTAMP '2024-01-20'""", "revisions"))
def _(spark, d):
    return rv.deleted_granules(ad.revisions(spark, d), "2024-01-20").select("concept_id", "revision_id", "revision_date")


@query("mt1_expire", sql("""SELECT concept_id, CAST(revision_id + 1 AS INTEGER) AS revision_id, TIMESTAMP '2024-02-01' AS revision_date, true AS deleted FROM (SELECT * FROM revisions QUALIFY row_number() OVER (PARTITION BY concept_id ORDER BY revision_id DESC) = 1)
    WHERE NOT deleted AND revision_date + to_days(2) < TIMESTAMP '2024-02-01'""", "revisions"))
def _(spark, d):
    r = ad.revisions(spark, d).select("concept_id", "revision_id", "revision_date", "deleted").withColumn("delete_time", F.col("revision_date") + F.make_dt_interval(F.lit(2)))
    return rv.expire(r, "2024-02-01").drop("delete_time")


@query("mt2_purge", sql(f"""SELECT {RS} FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY revision_id DESC) AS n,
    max(CASE WHEN deleted AND revision_date < TIMESTAMP '2025-01-25' - to_days(365) THEN revision_id END) OVER (PARTITION BY concept_id) AS stale FROM revisions)
    WHERE n <= 10 AND (stale IS NULL OR revision_id > stale)""", "revisions"))
def _(spark, d):
    return rv.purge(ad.revisions(spark, d).select(*R), "2025-01-25")


@query("ag21_duplicates", sql("""SELECT short_name, count(*) AS n, array_to_string(list_sort(list(concept_id)), ',') AS ids FROM collections GROUP BY 1 HAVING count(*) > 1""", "collections"))
def _(spark, d):
    c = ad.collections(spark, d).withColumns({"revision_id": F.lit(1), "deleted": F.lit(False)})
    return rv.duplicates(c, "short_name").withColumn("ids", F.array_join("ids", ","))


@query("snk6_upsert_latest", sql("""SELECT concept_id, revision_id, value, transaction_id FROM revisions QUALIFY row_number() OVER (PARTITION BY concept_id ORDER BY revision_id DESC) = 1""", "revisions"))
def _(spark, d):
    r = ad.revisions(spark, d).select("concept_id", "revision_id", "value", "transaction_id")
    even = r.where("transaction_id % 2 = 0")
    return rv.upsert_latest(rv.latest_revisions(even), r.where("transaction_id % 2 = 1"), ["concept_id"], "revision_id")


@query("st6_removed_items", sql("""SELECT concept_id, revision_id, CASE WHEN lower(old) <> lower(event_type) THEN lower(old) ELSE '' END AS removed FROM (
    SELECT concept_id, revision_id, event_type, lag(event_type) OVER (PARTITION BY concept_id ORDER BY revision_id) AS old FROM revisions) WHERE old IS NOT NULL""", "revisions"))
def _(spark, d):
    r = rv.diff_revisions(ad.revisions(spark, d).select("concept_id", "revision_id", F.array("event_type").alias("names")), columns=["names"]).where("old_names is not null")
    return r.select("concept_id", "revision_id", F.array_join(rv.removed_items(r, "old_names", "names"), ",").alias("removed"))


# ---------------------------------------------------------------- filters


def _filter(name: str, where, sql_where: str, what: str = "granules", cols=None):
    cols = cols or {"granules": G, "collections": ["concept_id", "short_name", "version", "platform", "level"], "revisions": R}[what]

    @query(name, sql(f"SELECT {', '.join(cols)} FROM {what} WHERE {sql_where}", what))
    def _(spark, d):
        return getattr(ad, what)(spark, d).where(where()).select(*cols)


_filter("flt2_groups", lambda: fl.any_of(fl.all_of(fl.num_eq("cloud_cover", 0), fl.string_eq("flag", "a")), fl.all_of(fl.num_range("access_value", 0.08, None), fl.string_eq("flag", "R"))), "(cloud_cover = 0 AND lower(flag) = 'a') OR (access_value >= 0.08 AND lower(flag) = 'r')")
_filter("flt3_negate", lambda: fl.negate(fl.date_range("end_date", "1995-01-01", None)), "NOT coalesce(end_date >= TIMESTAMP '1995-01-01', false)")
_filter("flt4_string_eq", lambda: fl.string_eq("platform", "brand#12"), "lower(platform) = 'brand#12'", "collections")
_filter("flt5_string_like", lambda: fl.string_like("platform", "brand#1?") & fl.string_like("short_name", "*ring*"), "lower(platform) LIKE 'brand#1_' AND lower(short_name) LIKE '%ring%'", "collections")
_filter("flt6_string_in", lambda: fl.string_in("level", ["Promo", "STANDARD"]), "lower(level) IN ('promo', 'standard')", "collections")
_filter("flt7_multi_value", lambda: fl.multi_value("short_name", ["*red*", "*widget*"], "and", fl.string_like), "lower(short_name) LIKE '%red%' AND lower(short_name) LIKE '%widget%'", "collections")
_filter("flt8_exclude", lambda: fl.exclude(fl.string_eq("level", "promo"), fl.num_range("version", 1, 25)), "NOT (lower(level) = 'promo') OR NOT (version BETWEEN 1 AND 25)", "collections")
_filter("flt9_boolean", lambda: fl.boolean_eq("deleted", "true") & fl.boolean_eq("deleted", "unset"), "deleted", "revisions")
_filter("flt10_missing", lambda: fl.missing("end_date") & fl.exists("start_date"), "end_date IS NULL AND start_date IS NOT NULL")
_filter("flt12_num_range", lambda: fl.num_range("access_value", 0.02, 0.06, exclusive=True), "access_value > 0.02 AND access_value < 0.06")
_filter("flt13_num_range_param", lambda: fl.num_range_param("version", "10,") & fl.num_range_param("version", ",20"), "version >= 10 AND version <= 20", "collections")
_filter("flt14_range_intersects", lambda: fl.range_intersects(F.col("lat") - F.col("half"), F.col("lat") + F.col("half"), 10, 12), "(lat - half BETWEEN 10 AND 12) OR (lat + half BETWEEN 10 AND 12) OR (lat - half <= 10 AND lat + half >= 12)")
_filter("flt15_string_range", lambda: fl.string_range("short_name", "green", "plum"), "short_name >= 'green' AND short_name <= 'plum'", "collections")
_filter("flt16_date_range", lambda: fl.date_range("start_date", "1997-02-03", "1997-03-04T12:00:00Z"), "start_date >= TIMESTAMP '1997-02-03' AND start_date <= TIMESTAMP '1997-03-04 12:00:00'")
_filter("flt17_multi_date_range", lambda: fl.multi_date_range("start_date", ["1996-01-01,1996-01-31", "1997-01-01/P1M"]), "(start_date BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-01-31') OR (start_date BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-02-01')")
_filter("flt18_updated_since", lambda: fl.updated_since("revision_date", "2024-01-25T06:00:00Z"), "revision_date >= TIMESTAMP '2024-01-25 06:00:00'", "revisions")
_filter("flt32_temporal", lambda: fl.temporal_intersects(dt.datetime(1998, 3, 1), dt.datetime(1998, 3, 10)), "start_date IS NOT NULL AND start_date <= TIMESTAMP '1998-03-10' AND (end_date IS NULL OR end_date >= TIMESTAMP '1998-03-01')")
_filter("flt34_temporal_facet", lambda: fl.temporal_facet_filter("start_date", 1999, 2), "start_date >= TIMESTAMP '1999-02-01' AND start_date <= TIMESTAMP '1999-02-28 23:59:59.999'")

_P = dates.periodic_windows(dt.datetime(1995, 6, 1), dt.datetime(1999, 6, 1), 350, 20, dt.datetime(2000, 1, 1))
_filter("flt33_temporal_periodic", lambda: fl.temporal_periodic(dt.datetime(1995, 6, 1), dt.datetime(1999, 6, 1), 350, 20, dt.datetime(2000, 1, 1)), " OR ".join(f"(start_date <= TIMESTAMP '{b}' AND (end_date IS NULL OR end_date >= TIMESTAMP '{a}'))" for a, b in _P))


@query("flt19_nested_match", sql("""SELECT order_id, count(*) AS n FROM granules WHERE lower(flag) = 'a' AND line = 3 GROUP BY 1""", "granules"))
def _(spark, d):
    g = ad.granules(spark, d).groupBy("order_id").agg(F.collect_list(F.struct("flag", "line")).alias("parts"))
    hit = g.where(fl.nested_match("parts", flag="a", line=3))
    return hit.select("order_id", F.size(F.filter("parts", lambda e: (e["flag"] == "A") & (e["line"] == 3))).cast("long").alias("n"))


@query("flt21_keyword_match", """SELECT doc_id FROM documents WHERE list_has_all(string_split_regex(lower(text), '\\s+'), ['the', 'and', 'of'])""")
def _(spark, d):
    return ad.read(spark, d, "documents").where(fl.keyword_match(F.split(F.lower("text"), r"\s+"), "the And of")).select("doc_id")


@query("flt22_keyword_phrase", """SELECT doc_id FROM documents WHERE regexp_matches(lower(' ' || text || ' '), ' of the ')""")
def _(spark, d):
    return ad.read(spark, d, "documents").where(fl.keyword_phrase(F.array(F.concat(F.lit(" "), "text", F.lit(" "))), '"of the"')).select("doc_id")


@query("flt23_match_prefix", """SELECT p_partkey FROM part WHERE regexp_matches(lower(p_name), '(^|\\s)red\\s+wi')""")
def _(spark, d):
    return ad.read(spark, d, "part").where(fl.match_prefix("p_name", "Red wi")).select("p_partkey")


@query("flt30_attribute_match", """SELECT event_id FROM events WHERE CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) BETWEEN 10 AND 20""")
def _(spark, d):
    e = ad.read(spark, d, "events").withColumn("attributes", F.array(F.struct(F.lit("K").alias("name"), F.get_json_object("props", "$.k").cast("double").alias("float_value"))))
    return e.where(fl.attribute_match("float,k,10,20")).select("event_id")


# ---------------------------------------------------------------- joins


@query("jn1_granules_of", sql(f"SELECT {GS} FROM granules WHERE collection_id IN (SELECT concept_id FROM collections WHERE lower(platform) = 'brand#7')", "granules", "collections"))
def _(spark, d):
    return jn.granules_of(ad.granules(spark, d).select(*G), ad.collections(spark, d), fl.string_eq("platform", "Brand#7"))


@query("jn2_inherit_match", sql("""SELECT g.collection_id, g.order_id, g.line FROM granules g LEFT JOIN collections c ON c.concept_id = g.collection_id
    WHERE coalesce(CASE WHEN g.flag = 'N' THEN g.size END, CAST(c.version AS DOUBLE)) > 45""", "granules", "collections"))
def _(spark, d):
    g = ad.granules(spark, d).withColumn("v", F.when(F.col("flag") == "N", F.col("size")))
    c = ad.collections(spark, d).withColumn("v", F.col("version").cast("double"))
    return jn.inherit_match(g, c, "v", lambda x: x > 45).select("collection_id", "order_id", "line")


@query("jn4_collections_with_granules", sql("SELECT concept_id, short_name FROM collections WHERE concept_id IN (SELECT collection_id FROM granules WHERE start_date >= TIMESTAMP '2001-06-01')", "granules", "collections"))
def _(spark, d):
    return jn.collections_with_granules(ad.collections(spark, d).select("concept_id", "short_name"), ad.granules(spark, d), F.col("start_date") >= F.lit("2001-06-01").cast("timestamp_ntz"))


@query("jn5_without_granules", sql("SELECT concept_id, short_name FROM collections WHERE concept_id NOT IN (SELECT collection_id FROM granules WHERE size > 49)", "granules", "collections"))
def _(spark, d):
    return jn.has_granules(ad.collections(spark, d).select("concept_id", "short_name"), ad.granules(spark, d).where("size > 49"), False)


@query("jn6_granules_or_consortium", sql("""SELECT provider_id, name FROM providers WHERE lower(consortium) = 'asia' OR provider_id IN (SELECT provider_id FROM granules WHERE size > 49.5 AND access_value = 0)""", "granules", "providers"))
def _(spark, d):
    p = ad.providers(spark, d).select(F.col("provider_id").alias("concept_id"), "name", F.array("consortium").alias("consortiums"))
    g = ad.granules(spark, d).where("size > 49.5 and access_value = 0").select(F.col("provider_id").alias("collection_id"))
    return jn.has_granules_or_consortium(p, g, ["Asia"]).select(F.col("concept_id").alias("provider_id"), "name")


@query("jn7_related_items", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000)""")
def _(spark, d):
    inner = ad.read(spark, d, "customer").where("c_mktsegment = 'BUILDING' and c_acctbal > 5000")
    return jn.related_items(ad.read(spark, d, "orders"), inner, "o_custkey", "c_custkey").select("o_orderkey", "o_totalprice")


_JN8 = """SELECT p_partkey AS concept_id, array_to_string(list_sort(list_distinct(list(s_name))), '|') AS names, count(DISTINCT s_suppkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    GROUP BY 1"""


@query("jn8_with_associations", _JN8)
@query("jn8_with_associations_whole", _JN8)
def _(spark, d):
    """All links of all collections."""
    return _services(*(ad.read(spark, d, t) for t in ("lineitem", "part", "supplier")))


def _services(lineitem: DataFrame, part: DataFrame, supplier: DataFrame) -> DataFrame:
    links = lineitem.select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("associated_id")).distinct().withColumn("deleted", F.lit(False))
    c, t = part.select(F.col("p_partkey").alias("concept_id")), supplier.select(F.col("s_suppkey").alias("concept_id"), F.col("s_name").alias("name"))
    out = jn.with_associations(c, links, t, "services").where("services is not null")
    return out.select("concept_id", F.array_join(F.array_sort(F.transform("services", lambda s: s["name"])), "|").alias("names"), F.size("services").cast("long").alias("n"))


@query("jn12_usage_score", sql("SELECT c.concept_id, CAST(coalesce(sum(m.access_count), 0) AS BIGINT) AS usage FROM collections c LEFT JOIN usage_metrics m ON c.short_name = m.short_name AND (m.version = CAST(c.version AS VARCHAR)) GROUP BY 1", "collections", "usage_metrics"))
def _(spark, d):
    return jn.usage_score(ad.collections(spark, d), ad.usage_metrics(spark, d)).select("concept_id", "usage")


@query("jn10_lookup_keywords", """SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def _(spark, d):
    s, n, r = (ad.read(spark, d, t) for t in ("supplier", "nation", "region"))
    words = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.upper("n_name").alias("k_name"), "n_name", "r_name")
    df = s.join(F.broadcast(n.select("n_nationkey", F.lower("n_name").alias("given"))), s.s_nationkey == n.n_nationkey).select("s_suppkey", "given")
    return jn.lookup_keywords(df, words, {"given": "k_name"}).select("s_suppkey", "n_name", "r_name")


@query("jn16_temporal_join", sql("""SELECT g.collection_id, g.order_id, g.line, o.a AS from_date, o.n_orders FROM granules g JOIN
    (SELECT date_trunc('quarter', o_orderdate)::TIMESTAMP AS a, date_trunc('quarter', o_orderdate)::TIMESTAMP + INTERVAL 3 MONTH - INTERVAL 1 DAY AS b, count(*) AS n_orders FROM orders GROUP BY 1, 2) o
    ON g.start_date <= o.b AND o.a <= coalesce(g.end_date, TIMESTAMP '9999-01-01')""", "granules"))
def _(spark, d):
    """All granules and the quarters of all orders."""
    start = F.date_trunc("quarter", "o_orderdate").cast("timestamp_ntz")
    o = ad.read(spark, d, "orders").groupBy(start.alias("from_date")).agg(F.count("*").alias("n_orders"))
    o = o.withColumn("to_date", (F.add_months("from_date", 3) - F.lit(1)).cast("timestamp_ntz"))
    g = ad.granules(spark, d).select("collection_id", "order_id", "line", "start_date", "end_date")
    return jn.temporal_join(g, o, hint="broadcast").select("collection_id", "order_id", "line", "from_date", "n_orders")  # quarters are few


@query("jn16_temporal_join_whole")
def _(spark, d):
    """All granules and all orders. No SQL: DuckDB would compare all pairs."""
    return _overlaps(ad.granules(spark, d).select("collection_id", "order_id", "line", "start_date", "end_date"), ad.read(spark, d, "orders"))


def _overlaps(g: DataFrame, orders: DataFrame) -> DataFrame:
    o = orders.select("o_orderkey", F.col("o_orderdate").alias("from_date"), (F.col("o_orderdate") + F.make_dt_interval(F.lit(3))).alias("to_date"))
    return jn.temporal_join(g, o).select("collection_id", "order_id", "line", "o_orderkey")


@query("jn16_overlap_counts", sql("""SELECT o_orderkey, CAST(coalesce(started.n, 0) - coalesce(ended.n, 0) AS BIGINT) AS n_granules FROM
    (SELECT o_orderkey, o_orderdate + INTERVAL 3 DAY AS b, o_orderdate AS a FROM orders) o
    ASOF LEFT JOIN (SELECT start_date AS t, sum(count(*)) OVER (ORDER BY start_date) AS n FROM granules GROUP BY 1) started ON o.b >= started.t
    ASOF LEFT JOIN (SELECT end_date AS t, sum(count(*)) OVER (ORDER BY end_date) AS n FROM granules WHERE end_date IS NOT NULL GROUP BY 1) ended ON o.a > ended.t""", "granules"))
def _(spark, d):
    """Granules that each order's three days overlap, of all granules and all orders: the whole join, counted without its pairs."""
    o = ad.read(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("from_date"), (F.col("o_orderdate") + F.make_dt_interval(F.lit(3))).alias("to_date"))
    return jn.overlap_counts(ad.granules(spark, d).select("start_date", "end_date"), o, name="n_granules").select("o_orderkey", "n_granules")


# ---------------------------------------------------------------- facets and counts

_FACET_FIELDS = ["platform", "level", "version"]


@query("ag1_facet", sql(" UNION ALL ".join(f"SELECT '{f}' AS field, CAST({f} AS VARCHAR) AS value, count(*) AS n FROM collections GROUP BY {f}" for f in _FACET_FIELDS), "collections"))
def _(spark, d):
    return fc.facet(ad.collections(spark, d), _FACET_FIELDS)


@query("ag2_facet_tree", sql("""SELECT consortium, NULL AS nation, NULL AS name, 1 AS depth, count(*) AS n FROM providers GROUP BY 1 UNION ALL SELECT consortium, nation, NULL, 2, count(*) FROM providers GROUP BY 1, 2
    UNION ALL SELECT consortium, nation, name, 3, count(*) FROM providers GROUP BY 1, 2, 3""", "providers"))
def _(spark, d):
    return fc.facet_tree(ad.providers(spark, d), ["consortium", "nation", "name"], "provider_id")


@query("ag3_facet_prioritized", sql("SELECT platform, avg(version) AS priority, count(*) AS n FROM collections GROUP BY 1 ORDER BY priority DESC, n DESC, platform LIMIT 5", "collections"))
def _(spark, d):
    return fc.facet_prioritized(ad.collections(spark, d), "platform", "version", 5)


_RANGES = [("0 to 5", 0.0, 5.0), ("5 to 20", 5.0, 20.0), ("20 to 45", 20.0, 45.0), ("above", 90.0, 1e9)]


@query("ag4_facet_ranges", sql(" UNION ALL ".join(f"SELECT '{n}' AS label, count(*) AS n FROM granules WHERE size >= {a} AND size < {b} HAVING count(*) > 0" for n, a, b in _RANGES), "granules"))
def _(spark, d):
    return fc.facet_ranges(ad.granules(spark, d), "size", _RANGES)


@query("ag5_facet_temporal", sql("SELECT CAST(month(start_date) AS INTEGER) AS part, count(*) AS n FROM granules WHERE year(start_date) = 1997 GROUP BY 1", "granules"))
def _(spark, d):
    return fc.facet_temporal(ad.granules(spark, d), "start_date", 1997)


@query("ag7_facets_multiselect", sql("""SELECT 'platform' AS field, platform AS value, count(*) AS n FROM collections WHERE level = 'PROMO' AND version > 20 GROUP BY platform
    UNION ALL SELECT 'level', level, count(*) FROM collections WHERE platform IN ('Brand#1', 'Brand#2') AND version > 20 GROUP BY level
    UNION ALL SELECT 'version', CAST(version AS VARCHAR), count(*) FROM collections WHERE platform IN ('Brand#1', 'Brand#2') AND level = 'PROMO' GROUP BY version""", "collections"))
def _(spark, d):
    chosen = {"platform": fl.string_in("platform", ["Brand#1", "Brand#2"]), "level": fl.string_eq("level", "promo"), "version": fl.num_range("version", 20, None, exclusive=True)}
    return fc.facets_multiselect(ad.collections(spark, d), chosen, _FACET_FIELDS)


@query("ag8_with_zero_terms", sql("""SELECT 'level' AS field, level AS value, count(*) AS n FROM collections WHERE level <> 'PROMO' GROUP BY level UNION ALL SELECT 'level', 'PROMO', 0""", "collections"))
def _(spark, d):
    found = fc.facet(ad.collections(spark, d).where("level <> 'PROMO'"), ["level"])
    return fc.with_zero_terms(found, [("level", "PROMO"), ("level", "standard")])


@query("ag9_facet_nodes", sql("""SELECT consortium AS title, count(*) AS "count", consortium = 'ASIA' AS applied, count(DISTINCT nation) AS children FROM providers GROUP BY 1""", "providers"))
def _(spark, d):
    levels = ["consortium", "nation", "name"]
    out = fc.facet_nodes(fc.facet_tree(ad.providers(spark, d), levels), levels, ["asia"])
    return out.select("title", "count", "applied", F.size("children").cast("long").alias("children"))


@query("ag10_granule_counts", sql("SELECT concept_id, (SELECT count(*) FROM granules g WHERE g.collection_id = c.concept_id AND g.cloud_cover <= 2) AS granule_count FROM collections c", "collections", "granules"))
def _(spark, d):
    return fc.granule_counts(ad.collections(spark, d).select("concept_id"), ad.granules(spark, d), F.col("cloud_cover") <= 2)


@query("ag11_counts_by_provider", sql("SELECT provider_id, collection_id, count(*) AS n FROM granules GROUP BY 1, 2", "granules"))
def _(spark, d):
    return fc.counts_by_provider(ad.granules(spark, d))


@query("ag12_provider_holdings", sql("SELECT c.concept_id, c.short_name, count(g.collection_id) AS granule_count FROM collections c LEFT JOIN granules g ON g.collection_id = c.concept_id GROUP BY 1, 2", "collections", "granules"))
def _(spark, d):
    return fc.provider_holdings(ad.collections(spark, d).select("concept_id", "short_name"), ad.granules(spark, d))


@query("ag13_granule_bounds", sql("SELECT collection_id, min(start_date) AS start_date, CASE WHEN NOT bool_or(end_date IS NULL) THEN max(end_date) END AS end_date FROM granules GROUP BY 1", "granules"))
def _(spark, d):
    return fc.granule_bounds(ad.granules(spark, d))


@query("ag14_merge_bounds", sql("""SELECT collection_id, least(os, ns) AS start_date, CASE WHEN had IS NULL THEN ne WHEN got IS NULL THEN oe WHEN oe IS NOT NULL AND ne IS NOT NULL THEN greatest(oe, ne) END AS end_date,
    NOT (os IS NOT DISTINCT FROM least(os, ns) AND oe IS NOT DISTINCT FROM (CASE WHEN had IS NULL THEN ne WHEN got IS NULL THEN oe WHEN oe IS NOT NULL AND ne IS NOT NULL THEN greatest(oe, ne) END) AND had IS NOT NULL) AS changed
    FROM (SELECT collection_id, min(start_date) AS os, CASE WHEN NOT bool_or(end_date IS NULL) THEN max(end_date) END AS oe, true AS had FROM granules WHERE flag = 'A' GROUP BY 1)
    FULL JOIN (SELECT collection_id, min(start_date) AS ns, CASE WHEN NOT bool_or(end_date IS NULL) THEN max(end_date) END AS ne, true AS got FROM granules WHERE flag = 'R' AND size > 40 GROUP BY 1) USING (collection_id)""", "granules"))
def _(spark, d):
    g = ad.granules(spark, d)
    return fc.merge_bounds(fc.granule_bounds(g.where("flag = 'A'")), fc.granule_bounds(g.where("flag = 'R' and size > 40")))


@query("ag16_type_counts", sql("SELECT provider_id, count(*) AS n FROM granules GROUP BY 1", "granules"))
def _(spark, d):
    return fc.type_counts(ad.granules(spark, d), "provider_id")


@query("ag17_aggregate_usage", sql("SELECT short_name, version, CAST(sum(access_count) AS BIGINT) AS access_count FROM usage_metrics GROUP BY 1, 2", "usage_metrics"))
def _(spark, d):
    return fc.aggregate_usage(ad.usage_metrics(spark, d))


@query("ag23_partition_balance", sql("SELECT collection_id, count(*) AS n, count(*) >= (SELECT count(*) FROM granules) * 0.0007 AS own FROM granules GROUP BY 1", "granules"))
def _(spark, d):
    return fc.partition_balance(ad.granules(spark, d), 0.0007)


def _timeline_sql(unit: str) -> str:
    return sql(f"""SELECT collection_id, greatest(s, TIMESTAMP '1997-01-01') AS start, CASE WHEN lft <> 0 OR e IS NULL THEN TIMESTAMP '1998-06-01' ELSE least(e + INTERVAL 1 {unit}, TIMESTAMP '1998-06-01') END AS "end", CAST(n AS BIGINT) AS n FROM (
    SELECT collection_id, span, min(s) AS s, arg_max(e, s) AS e, arg_max(lft, s) AS lft, sum(n) AS n FROM (
    SELECT *, sum(CASE WHEN prev_e IS NULL OR date_diff('{unit}', prev_e, s) <> 1 THEN 1 ELSE 0 END) OVER (PARTITION BY collection_id ORDER BY s) AS span FROM (
    SELECT *, lag(e) OVER (PARTITION BY collection_id ORDER BY s) AS prev_e FROM (
    SELECT collection_id, closed, min(t) AS s, max(CASE WHEN c < 0 THEN t END) AS e, sum(greatest(c, 0)) AS n, sum(c) AS lft FROM (
    SELECT *, coalesce(sum(CASE WHEN running = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY collection_id ORDER BY t, c DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM (
    SELECT *, sum(c) OVER (PARTITION BY collection_id ORDER BY t, c DESC ROWS UNBOUNDED PRECEDING) AS running FROM (
    SELECT collection_id, date_trunc('{unit}', start_date) AS t, count(*) AS c FROM g GROUP BY 1, 2 UNION ALL SELECT collection_id, date_trunc('{unit}', end_date), -count(*) FROM g WHERE end_date IS NOT NULL GROUP BY 1, 2)))
    GROUP BY 1, 2))) GROUP BY 1, 2)""".replace("FROM g ", "FROM (SELECT * FROM granules WHERE start_date <= TIMESTAMP '1998-06-01' AND (end_date IS NULL OR end_date >= TIMESTAMP '1997-01-01')) "), "granules")


for _unit in ("month", "day"):

    @query(f"ag15_timeline_{_unit}", _timeline_sql(_unit))
    def _(spark, d, unit=_unit):
        return tl.timeline(ad.granules(spark, d), unit, dt.datetime(1997, 1, 1), dt.datetime(1998, 6, 1))


# ---------------------------------------------------------------- orders


@query("so1_sort_page", sql("SELECT concept_id, short_name, version FROM collections ORDER BY version DESC, short_name, concept_id LIMIT 20 OFFSET 40", "collections"))
def _(spark, d):
    c = ad.collections(spark, d).select("concept_id", "short_name", "version")
    return so.page(so.sort_by(c, ["-version", "+short_name"], "granule"), 20, num=3)


@query("so4_version_key", "SELECT event_id, CAST(event_id AS VARCHAR) AS k FROM events")
def _(spark, d):
    return ad.read(spark, d, "events").select("event_id", so.version_key(F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("k"))


@query("so7_page_after", sql("SELECT concept_id, short_name, version FROM collections WHERE version < 30 OR (version = 30 AND concept_id > 500) ORDER BY version DESC, concept_id LIMIT 25", "collections"))
def _(spark, d):
    return so.page_after(ad.collections(spark, d).select("concept_id", "short_name", "version"), ["-version", "+concept_id"], [30, 500], 25)


@query("so9_natural_key", sql("SELECT platform, CAST(row_number() OVER (ORDER BY CAST(regexp_extract(platform, '([0-9]+)', 1) AS INTEGER)) AS INTEGER) AS place FROM (SELECT DISTINCT platform FROM collections)", "collections"))
def _(spark, d):
    from pyspark.sql.window import Window as W

    return ad.collections(spark, d).select("platform").distinct().select("platform", F.row_number().over(W.orderBy(so.natural_key(F.col("platform")))).alias("place"))


@query("tx6_bins", sql("SELECT concept_id, floor(floor(price / 2 / 0.2 + 0.5) * 0.2 * 100 + 0.5) / 100 AS score_bin, floor(floor(price / 400.0 + 0.5) * 400 * 100 + 0.5) / 100 AS usage_bin FROM collections", "collections"))
def _(spark, d):
    return ad.collections(spark, d).select("concept_id", so.bin_score(F.col("price")).alias("score_bin"), so.bin_usage(F.col("price")).alias("usage_bin"))


@query("so8_relevance_sort", sql("""SELECT concept_id, short_name FROM collections ORDER BY floor(price / 400.0 + 0.5) DESC, level DESC, concept_id""", "collections"))
def _(spark, d):
    c = ad.collections(spark, d).select("concept_id", "short_name", F.col("price").alias("usage"), F.lit(None).cast("timestamp_ntz").alias("end_date"), F.col("level").alias("processing_level"))
    return so.relevance_sort(c, dt.datetime(2024, 1, 1), score=None).select("concept_id", "short_name")


@query("so10_autocomplete", sql("""SELECT type, value FROM (SELECT DISTINCT 'short_name' AS type, short_name AS value FROM collections UNION SELECT DISTINCT 'level', level FROM collections)
    WHERE regexp_matches(lower(value), '(^|[\\s/:>-])sm') ORDER BY CASE WHEN lower(value) = 'sm' THEN 2 WHEN lower(value) LIKE 'sm%' THEN 1 ELSE 0 END + 1 DESC, type, value LIMIT 10""", "collections"))
def _(spark, d):
    c = ad.collections(spark, d)
    s = c.select(F.lit("short_name").alias("type"), F.col("short_name").alias("value")).union(c.select(F.lit("level"), "level")).distinct()
    return so.autocomplete(s, "sm").select("type", "value")
