"""Queries on the driver's tables: text, relevance, access, quality, edits, numbers, spatial, orbits, streams, documents."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions import boxes as bx
from ..functions import dates, numbers as nu, text as tx
from ..functions import filters as fl
from ..functions.sql import register_functions
from ..operators import access as ac, documents as dc, edits as ed, facets as fc, joins as jn, orbit as ob, quality as dq, relevance as rl, revisions as rv, sorting as so, spatial as sp, suggest as sg
from ..sources import adapters as ad, readers as rd, sinks as sk
from ..sources.adapters import inside_arcs, sql
from ..streaming import events as st, targets as tg
from .builder import Query, build_filter, script_filter
from .registry import query

TS = lambda s: F.lit(s).cast("timestamp_ntz")

# ---------------------------------------------------------------- builder


@query("flt43_build_filter", sql("""SELECT concept_id, short_name, level FROM collections WHERE (lower(short_name) LIKE '%ring%' OR lower(level) = 'promo') AND NOT (lower(platform) IN ('brand#1', 'brand#2'))""", "collections"))
def _(spark, d):
    spec = {"and": [{"or": [{"short_name": "*ring*"}, {"level": "PROMO"}]}, {"not": {"platform": ["Brand#1", "Brand#2"]}}]}
    fields = {"short_name": ("string", "short_name"), "level": ("string", "level"), "platform": ("string", "platform")}
    return ad.collections(spark, d).where(build_filter(spec, "collection", {"short_name": {"pattern": True}}, fields)).select("concept_id", "short_name", "level")


@query("query_granule_search", sql("""SELECT collection_id, order_id, line, start_date FROM granules WHERE cloud_cover <= 3 AND start_date <= TIMESTAMP '1998-02-01' AND (end_date IS NULL OR end_date >= TIMESTAMP '1998-01-01')
    AND collection_id IN (SELECT concept_id FROM collections WHERE lower(short_name) LIKE 'red%') ORDER BY start_date, collection_id, order_id, line LIMIT 50""", "granules", "collections"))
def _(spark, d):
    q = Query(ad.granules(spark, d).select("collection_id", "order_id", "line", "start_date", "end_date", "cloud_cover"), "granule")
    q.where({"cloud_cover": ",3", "temporal": "1998-01-01,1998-02-01"})
    q.df = jn.granules_of(q.df, ad.collections(spark, d), fl.string_like("short_name", "red*"))
    return q.order("+start_date", "+collection_id", "+order_id", "+line").page(50).select("collection_id", "order_id", "line", "start_date")


@query("ud2_script_filter", "SELECT o_orderkey FROM orders WHERE CAST(floor(o_totalprice) AS BIGINT) % 7 = 3")
def _(spark, d):
    o = ad.read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return o.where(script_filter(lambda p: (p // 1).astype("int64") % 7 == 3, "o_totalprice")).select("o_orderkey")


@query("ud4_sql_functions", "SELECT p_partkey, floor(floor(p_retailprice / 400 + 0.5) * 400 * 100 + 0.5) / 100 AS usage_bin, p_size * 1000.0 AS metres FROM part")
def _(spark, d):
    register_functions(spark)
    p = ad.read(spark, d, "part")
    return p.selectExpr("p_partkey", "bin_usage(p_retailprice) AS usage_bin", "to_meters(CAST(p_size AS DOUBLE), 'Kilometers') AS metres")


# ---------------------------------------------------------------- text


@query("tx1_keyword_words", """SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(string_split(lower(p_name || ' ' || p_brand), ' '), string_split(replace(lower(p_name || ' ' || p_brand), '#', ' '), ' ')))), ' ') AS words FROM part""")
def _(spark, d):
    return ad.read(spark, d, "part").select("p_partkey", F.array_join(tx.keyword_words([F.col("p_name"), F.col("p_brand")]), " ").alias("words"))


@query("tx5_keyword_score", sql("""SELECT concept_id, (CASE WHEN lower(short_name) LIKE '%ring%' AND lower(short_name) LIKE '%red%' THEN 2.2 ELSE 1.0 END) * (CASE WHEN regexp_matches(lower(platform), '^red ring$') THEN 1.0 ELSE 1.0 END)
    * (CASE WHEN lower(short_name) = 'red ring' THEN 1.4 ELSE 1.0 END) AS score FROM collections""", "collections"))
def _(spark, d):
    c = ad.collections(spark, d).withColumn("entry_title", F.col("short_name"))
    return c.select("concept_id", tx.keyword_score(c.drop("version", "level"), ["red", "ring"]).alias("score"))


_RULES = [
    {"order": 10, "type": "alias", "field": "platform", "source_value": "Brand#1", "replacement_value": "  first   brand ", "reportable": True},
    {"order": 20, "type": "trim_whitespace", "field": "platform"},
    {"order": 30, "type": "capitalize", "field": "platform", "source_value": "first brand"},
    {"order": 40, "type": "ignore", "field": "platform", "source_value": "Brand#2"},
    {"order": 50, "type": "priority", "field": "platform", "source_value": "First Brand", "priority": 7},
]


@query("tx7_humanize", sql("""SELECT concept_id, CASE platform WHEN 'Brand#1' THEN 'First Brand' WHEN 'Brand#2' THEN NULL ELSE platform END AS value, CASE platform WHEN 'Brand#1' THEN 7 WHEN 'Brand#2' THEN -1 ELSE 0 END AS priority FROM collections""", "collections"))
def _(spark, d):
    h = tx.humanize(F.col("platform"), _RULES, "platform")
    return ad.collections(spark, d).select("concept_id", h["value"].alias("value"), F.coalesce(h["priority"], F.lit(-1)).alias("priority"))


@query("mt3_humanizer_report", sql("SELECT DISTINCT concept_id, 'platform' AS field, 'Brand#1' AS original, 'First Brand' AS humanized FROM collections WHERE platform = 'Brand#1'", "collections"))
def _(spark, d):
    return tx.humanizer_report(ad.collections(spark, d), _RULES, {"platform": "platform"}, ["concept_id"])


@query("tx9_split_formats", """SELECT doc_id, f FROM (SELECT doc_id, unnest([lang || '0', source, 'x' || lang]) AS f FROM documents)""")
def _(spark, d):
    t = ad.read(spark, d, "documents").select("doc_id", F.concat(F.col("lang"), F.lit("0 / "), F.col("source"), F.lit(", and x"), F.col("lang")).alias("t"))
    return t.select("doc_id", F.explode(tx.split_formats(F.col("t"))).alias("f"))


@query("tx10_highlight", """SELECT doc_id, len(regexp_extract_all(text, '(?is).{0,20}\\b(?:idiot|scum)\\b.{0,20}')) AS n FROM documents WHERE regexp_matches(text, '(?i)\\b(idiot|scum)\\b')""")
def _(spark, d):
    t = ad.read(spark, d, "documents").where(F.col("text").rlike(r"(?i)\b(idiot|scum)\b"))
    return t.select("doc_id", F.size(tx.highlight(F.col("text"), ["idiot", "scum"], length=50, count=100000)).cast("long").alias("n"))


@query("tx11_fingerprint", """SELECT p_partkey, md5(lower(trim(p_name)) || '|' || lower(trim(p_brand)) || '|["{:Name ' || lower(p_type) || ', :Size ' || p_size || ', :Type null}"]') AS fingerprint FROM part""")
def _(spark, d):
    dims = F.array(F.struct(F.col("p_type").alias("Name"), F.col("p_size").alias("Size"), F.lit(None).cast("string").alias("Type")))
    return ad.read(spark, d, "part").select("p_partkey", tx.variable_fingerprint(F.col("p_name"), F.col("p_brand"), dims).alias("fingerprint"))


@query("tx12_anti_values", """SELECT p_partkey, p_type FROM part WHERE p_size % 5 <> 0""")
def _(spark, d):
    p = ad.read(spark, d, "part").withColumn("v", F.when(F.col("p_size") % 5 == 0, F.element_at(F.array(F.lit("None"), F.lit(" not provided "), F.lit(" ")), (F.col("p_size") % 3 + 1).cast("int"))).otherwise(F.col("p_type")))
    return tx.drop_anti_values(p, "v").select("p_partkey", "p_type")


@query("mt5_suggestions", sql("""SELECT 'platform' AS type, platform AS value, level || ':' || platform AS fields, bool_or(version > 25) AS public, array_to_string(list_sort(list_distinct(list(CASE WHEN version > 25 THEN 'guest' ELSE 'g1' END))), ',') AS groups FROM collections GROUP BY 2, 3""", "collections"))
def _(spark, d):
    c = ad.collections(spark, d).withColumn("permitted_groups", F.array(F.when(F.col("version") > 25, "guest").otherwise("g1")))
    return sg.build_suggestions(c, {"platform": ["level", "platform"]}).withColumn("groups", F.array_join("groups", ","))


# ---------------------------------------------------------------- relevance


def _by_length(docs):
    """Documents of each source as results, longest first."""
    bucket = [(-F.col("n_chars")).alias("length"), F.floor(F.col("doc_id") / rl.STEP).alias("ids")]
    r = docs.select(F.col("source").alias("test_id"), "doc_id", "n_chars")
    return rl.ranks(r, "test_id", bucket, [F.desc("n_chars"), F.col("doc_id")], "position").select("test_id", F.col("doc_id").alias("concept_id"), "position")


def _tests(spark, d):
    j = ad.read(spark, d, "documents").join(ad.read(spark, d, "labels"), "doc_id")
    e = j.where("quality = 0").select(F.col("source").alias("test_id"), F.col("doc_id").alias("concept_id"))
    expected = rl.ranks(e, "test_id", [F.floor(F.col("concept_id") / rl.STEP).alias("ids")], [F.col("concept_id")], "place")
    return _by_length(j), expected


_RL = """WITH j AS (SELECT source AS t, doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id)),
e AS (SELECT t, doc_id, row_number() OVER (PARTITION BY t ORDER BY doc_id) AS place, count(*) OVER (PARTITION BY t) AS n, row_number() OVER (PARTITION BY t ORDER BY n_chars DESC, doc_id) AS pos FROM j WHERE quality = 0)
SELECT t AS test_id, sum((n + 1 - place) / (ln(pos + 1) / ln(2.0))) / sum((n + 1 - place) / (ln(place + 1) / ln(2.0))) AS dcg, max(CASE WHEN place = 1 THEN 1.0 / pos ELSE 0 END) AS rr, bool_and(pos = place) AS passed FROM e GROUP BY t"""


@query("rl1_relevance_metrics", _RL)
def _(spark, d):
    return rl.relevance_metrics(*_tests(spark, d))


@query("ag24_relevance_summary", f"SELECT count(*) AS tests, count(*) FILTER (passed) AS passed, avg(dcg) AS dcg, avg(dcg) FILTER (NOT passed) AS failed_dcg, avg(rr) AS mrr FROM ({_RL})")
def _(spark, d):
    return rl.relevance_summary(rl.relevance_metrics(*_tests(spark, d)))


@query("rl4_top_n", """SELECT doc_id % 50 AS test_id, bool_or(pos <= 3) AS ok FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS pos FROM documents) GROUP BY 1""")
def _(spark, d):
    docs = ad.read(spark, d, "documents")
    r = _by_length(docs).select(F.col("concept_id").alias("test_id"), "concept_id", "position")
    t = docs.select(F.col("doc_id").alias("test_id"), F.col("doc_id").alias("concept_id"), F.lit(3).alias("n"))
    return rl.top_n(r, t).groupBy((F.col("test_id") % 50).alias("test_id")).agg(F.bool_or("ok").alias("ok"))


@query("rl2_tune_boosts", """WITH g(grid_id, en) AS (VALUES (0, 1.0), (1, 1.5), (2, 2.0)),
e AS (SELECT grid_id, source AS t, row_number() OVER (PARTITION BY grid_id, source ORDER BY doc_id) AS place, count(*) OVER (PARTITION BY grid_id, source) AS n,
  row_number() OVER (PARTITION BY grid_id, source ORDER BY CASE WHEN lang = 'en' THEN en ELSE 1.0 END * CASE WHEN n_chars > 2000 THEN 1.5 ELSE 1.0 END DESC, doc_id) AS pos
  FROM documents JOIN labels USING (doc_id) CROSS JOIN g WHERE quality = 0),
m AS (SELECT grid_id, t, sum((n + 1 - place) / (ln(pos + 1) / ln(2.0))) / sum((n + 1 - place) / (ln(place + 1) / ln(2.0))) AS dcg FROM e GROUP BY 1, 2)
SELECT grid_id, avg(dcg) AS dcg FROM m GROUP BY 1""")
def _(spark, d):
    c = ad.read(spark, d, "documents").join(ad.read(spark, d, "labels"), "doc_id").select(F.col("source").alias("test_id"), F.col("doc_id").alias("concept_id"), F.col("lang").alias("lang"), "n_chars")
    hits = {"english": F.col("lang") == "en", "long": F.col("n_chars") > 2000}
    return rl.tune_boosts(c, _tests(spark, d)[1], hits, rl.boost_grid("english", 1.0, 2.0, 0.5, {"long": 1.5}))


@query("rl3_tests_from_logs", """SELECT DISTINCT o_custkey AS search, o_orderkey AS chosen, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS top FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) > 1""")
def _(spark, d):
    from pyspark.sql.window import Window as W

    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = ad.read(spark, d, "orders").select(F.col("o_custkey").alias("search"), F.col("o_orderkey").alias("chosen"), F.row_number().over(w).alias("rank"), F.array(F.first("o_orderkey").over(w)).alias("results"))
    return rl.tests_from_logs(o)


# ---------------------------------------------------------------- access


def _acls(spark, d):
    n = ad.read(spark, d, "nation")
    perm = F.array(F.struct(F.concat(F.lit("g"), F.col("n_regionkey")).alias("group_id"), F.lit(None).cast("string").alias("user_type"), F.array(F.lit("read"), F.lit("order")).alias("grants")))
    return n.select(
        F.col("n_nationkey").alias("acl_id"), F.col("n_nationkey").cast("long").alias("provider_id"), F.lit(None).cast("array<string>").alias("entry_titles"), F.lit(None).cast("array<long>").alias("concept_ids"),
        F.struct(F.lit(0.02).alias("min"), (F.lit(0.03) + F.col("n_regionkey") * 0.01).alias("max"), F.lit(False).alias("include_undefined")).alias("access"),
        F.struct(TS("1996-01-01").alias("start"), TS("1999-01-01").alias("stop"), F.when(F.col("n_nationkey") % 2 == 0, "contains").otherwise("intersect").alias("mask")).alias("temporal"), perm.alias("permissions"),
    )


def _records(spark, d):
    o = ad.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("concept_id")).agg((F.min("l_suppkey") % 25).alias("provider_id"), F.min("l_tax").alias("access_value"), F.min("l_shipdate").alias("start_date"), F.max("l_shipdate").alias("end_date"))
    return o.withColumn("entry_title", F.lit("t"))


_ACCESS = """r AS (SELECT l_orderkey AS concept_id, min(l_suppkey) % 25 AS provider_id, min(l_tax) AS v, min(l_shipdate) AS s, max(l_shipdate) AS e FROM lineitem GROUP BY 1),
ok AS (SELECT r.concept_id, n_nationkey AS acl_id, n_regionkey FROM r JOIN nation ON provider_id = n_nationkey WHERE v >= 0.02 AND v <= 0.03 + n_regionkey * 0.01
AND CASE WHEN n_nationkey % 2 = 0 THEN s BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-01-01' AND e BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-01-01' ELSE s <= TIMESTAMP '1999-01-01' AND e >= TIMESTAMP '1996-01-01' END)"""


@query("jn18_permitted", f"WITH {_ACCESS} SELECT concept_id FROM ok WHERE n_regionkey IN (1, 3)")
def _(spark, d):
    return ac.permitted(_records(spark, d), _acls(spark, d), ["g1", "g3"]).select("concept_id")


@query("pm4_rules_for", f"WITH {_ACCESS} SELECT concept_id, acl_id FROM ok")
def _(spark, d):
    return ac.rules_for(_records(spark, d), _acls(spark, d))


@query("ag18_granted_permissions", f"WITH {_ACCESS} SELECT r.concept_id, CASE WHEN ok.concept_id IS NOT NULL AND r.provider_id = 2 THEN 'delete,order,read,update' WHEN r.provider_id = 2 THEN 'delete,update' WHEN ok.concept_id IS NOT NULL THEN 'order,read' ELSE '' END AS permissions FROM r LEFT JOIN (SELECT concept_id FROM ok WHERE n_regionkey IN (1, 2)) ok USING (concept_id)")
def _(spark, d):
    return ac.granted_permissions(_records(spark, d), _acls(spark, d), ["g1", "g2"], [2]).withColumn("permissions", F.array_join("permissions", ","))


@query("ag19_permitted_groups", f"WITH {_ACCESS} SELECT concept_id, 'g' || n_regionkey AS groups FROM ok")
def _(spark, d):
    return ac.permitted_groups(_records(spark, d), _acls(spark, d)).withColumn("groups", F.array_join("groups", ","))


@query("ag20_buckets", sql("SELECT DISTINCT 's3://' || platform AS prefix FROM collections WHERE version IN (3, 5)", "collections"))
def _(spark, d):
    c = ad.collections(spark, d).select(F.lit("p").alias("provider_id"), F.array(F.concat(F.lit("g"), F.col("version"))).alias("permitted_groups"), F.array(F.concat(F.lit("s3://"), F.col("platform"))).alias("prefixes"))
    return ac.buckets_for(c, ["g3", "g5"])


@query("pm5_changed_rules", sql("SELECT DISTINCT provider_id FROM granules WHERE size = 50 AND access_value = 0.05", "granules"))
def _(spark, d):
    g = ad.granules(spark, d).select("provider_id", "order_id", "line", "size", "access_value")
    return rv.changed_rules(g, g.withColumn("access_value", F.when((F.col("size") == 50) & (F.col("access_value") == 0.05), 0.5).otherwise(F.col("access_value"))))


# ---------------------------------------------------------------- quality


@query("dq1_check_temporal", sql("""SELECT g.collection_id, order_id, line, CASE WHEN start_date < cs THEN 'starts before parent' WHEN start_date > ce THEN 'starts after parent''s end' WHEN end_date > ce THEN 'ends after parent''s end'
    WHEN ce IS NOT NULL AND end_date IS NULL THEN 'no end but parent has one' WHEN start_date > end_date THEN 'starts after its own end' END AS error FROM granules g
    JOIN (SELECT concept_id, TIMESTAMP '1995-01-01' + to_days(CAST(version AS INTEGER)) AS cs, CASE WHEN version % 2 = 0 THEN TIMESTAMP '2000-01-01' END AS ce FROM collections) c ON g.collection_id = c.concept_id""", "granules", "collections"))
def _(spark, d):
    c = ad.collections(spark, d).select("concept_id", (TS("1995-01-01") + F.make_dt_interval(F.col("version"))).alias("start_date"), F.when(F.col("version") % 2 == 0, TS("2000-01-01")).alias("end_date"))
    return dq.check_temporal(ad.granules(spark, d), c).select("collection_id", "order_id", "line", "error")


@query("dq3_check_references", sql("""SELECT order_id, line, CASE WHEN lower(g.flag) <> lower(substr(c.level, 1, 1)) THEN 'names: ' || lower(g.flag) ELSE '' END AS errors FROM granules g JOIN collections c ON g.collection_id = c.concept_id""", "granules", "collections"))
def _(spark, d):
    g = ad.granules(spark, d).withColumn("names", F.array("flag"))
    c = ad.collections(spark, d).withColumn("names", F.array(F.col("level").substr(1, 1)))
    return dq.check_references(g, c, ["names"]).select("order_id", "line", F.array_join("errors", ";").alias("errors"))


@query("dq6_attribute_errors", """SELECT event_id, CASE WHEN value > 30 THEN 'value out of range' ELSE '' END AS errors FROM events""")
def _(spark, d):
    e = ad.read(spark, d, "events")
    return e.select("event_id", F.array_join(dq.attribute_errors(F.lit("FLOAT"), F.col("value").cast("string"), F.lit("-1e9"), F.lit("30")), ",").alias("errors"))


@query("dq7_check_unique", """SELECT o_custkey, CASE WHEN count(DISTINCT o_orderpriority) < count(*) THEN 1 ELSE 0 END AS bad FROM orders GROUP BY 1""")
def _(spark, d):
    o = ad.read(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("names"))
    return dq.check_unique(o, F.col("names"), "priority").select("o_custkey", F.size("errors").alias("bad"))


@query("dq8_check_keywords", sql("SELECT concept_id, platform FROM collections WHERE platform NOT IN (SELECT platform FROM collections WHERE version = 7)", "collections"))
def _(spark, d):
    c = ad.collections(spark, d).select("concept_id", "platform", "version")
    return dq.check_keywords(c, c.where("version = 7").select(F.upper("platform").alias("k")), {"platform": "k"}).select("concept_id", "platform")


@query("dq9_check_collection_update", sql("""SELECT collection_id AS concept_id, rule, n FROM (SELECT collection_id, 'starts before' AS rule, count(*) FILTER (start_date < TIMESTAMP '1994-06-01') AS n FROM granules GROUP BY 1
    UNION ALL SELECT collection_id, 'ends after', count(*) FILTER (end_date IS NULL OR end_date > TIMESTAMP '2001-06-01') FROM granules GROUP BY 1) WHERE n > 0""", "granules"))
def _(spark, d):
    c = ad.collections(spark, d).select("concept_id", TS("1994-06-01").alias("start_date"), TS("2001-06-01").alias("end_date"))
    return dq.check_collection_update(c, ad.granules(spark, d))


@query("dq10_check_dates", sql("SELECT order_id, line, CASE WHEN start_date > TIMESTAMP '2001-01-01' THEN 'start in the future' ELSE '' END AS errors FROM granules", "granules"))
def _(spark, d):
    g = ad.granules(spark, d).withColumn("ends_at_present", F.lit(False))
    return dq.check_dates(g, "2001-01-01").select("order_id", "line", F.array_join("errors", ",").alias("errors"))


@query("dq12_check_unique_concepts", sql("SELECT short_name, version, array_to_string(list_sort(list(concept_id)), ',') AS ids FROM collections GROUP BY 1, 2 HAVING count(*) > 1", "collections"))
def _(spark, d):
    return dq.check_unique_concepts(ad.collections(spark, d), ["short_name", "version"]).withColumn("ids", F.array_join("ids", ","))


@query("dq14_check_links", """SELECT l_partkey AS source_id, l_suppkey AS associated_id, CASE WHEN s_suppkey IS NULL THEN 'target does not exist' WHEN s_acctbal < 0 THEN 'target is deleted' ELSE '' END AS errors FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 10 <> 0) ON l_suppkey = s_suppkey""")
def _(spark, d):
    links = ad.read(spark, d, "lineitem").select(F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("associated_id")).distinct().withColumns({"deleted": F.lit(False), "associated_revision": F.lit(None).cast("int")})
    c = ad.read(spark, d, "supplier").where("s_suppkey % 10 <> 0").select(F.col("s_suppkey").alias("concept_id"), (F.col("s_acctbal") < 0).alias("deleted"))
    return dq.check_links(links, c).select("source_id", "associated_id", F.array_join("errors", ",").alias("errors"))


# ---------------------------------------------------------------- edits


@query("js1_bulk_edit", sql("SELECT concept_id, CASE WHEN platform = 'Brand#3' THEN 'Brand#99' ELSE platform END AS platform, platform = 'Brand#3' AS edited FROM collections", "collections"))
def _(spark, d):
    c = ad.collections(spark, d).select("concept_id", F.array(F.struct(F.col("platform").alias("name"), F.col("level").alias("kind"))).alias("platforms"))
    out = ed.bulk_edit(c, "platforms", "update", {"name": "Brand#3"}, {"name": "Brand#99"})
    return out.select("concept_id", F.col("platforms")[0]["name"].alias("platform"), "edited")


@query("js3_edit_status", """SELECT o_orderkey AS granule_ur, CASE WHEN o_orderkey % 10 = 0 THEN 'FAILED' WHEN o_orderstatus = 'F' THEN 'FAILED' WHEN o_orderkey % 3 = 0 THEN 'UPDATED' ELSE 'SKIPPED' END AS status FROM orders""")
def _(spark, d):
    o = ad.read(spark, d, "orders").select(F.col("o_orderkey").alias("granule_ur"), F.col("o_orderstatus").alias("s"))
    concepts = o.where("granule_ur % 10 <> 0").select("granule_ur", (F.col("s") == "F").alias("deleted"))
    return ed.edit_status(o, concepts, o.select("granule_ur", (F.col("granule_ur") % 3 == 0).alias("edited"))).select("granule_ur", "status")


@query("ag22_task_status", """SELECT o_custkey AS task_id, CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'IN_PROGRESS' ELSE 'COMPLETE' END AS status, count(*) FILTER (o_orderstatus = 'F') AS failed FROM orders GROUP BY 1""")
def _(spark, d):
    o = ad.read(spark, d, "orders").select(F.col("o_custkey").alias("task_id"), F.when(F.col("o_orderstatus") == "P", "PENDING").when(F.col("o_orderstatus") == "F", "FAILED").otherwise("UPDATED").alias("status"))
    return ed.task_status(o).select("task_id", "status", "failed")


@query("js4_check_instructions", """SELECT CAST(o_custkey AS VARCHAR) AS granule_ur, 'repeated' AS error FROM orders WHERE o_custkey > 0 GROUP BY o_custkey HAVING count(*) > 1 UNION ALL SELECT ' ', 'blank' FROM orders WHERE o_custkey = 0 HAVING count(*) > 0""")
def _(spark, d):
    return ed.check_instructions(ad.read(spark, d, "orders").select(F.when(F.col("o_custkey") == 0, " ").otherwise(F.col("o_custkey").cast("string")).alias("granule_ur")))


@query("js5_tag_by_query", sql("SELECT 'T1' AS source_id, concept_id AS associated_id, CAST(CASE WHEN version > 40 THEN 2 ELSE 1 END AS INTEGER) AS revision_id FROM collections WHERE lower(level) = 'promo'", "collections"))
def _(spark, d):
    c = ad.collections(spark, d)
    links = c.where("version > 40 and level = 'PROMO'").select(F.lit("T1").alias("source_id"), F.col("concept_id").alias("associated_id"), F.lit(1).alias("revision_id"), F.lit(False).alias("deleted"), TS("2024-01-01").alias("revision_date"))
    out = ed.latest_links(ed.tag_by_query(c, links, fl.string_eq("level", "promo"), "T1", "2024-02-01"))
    return out.select("source_id", "associated_id", "revision_id")


# ---------------------------------------------------------------- numbers and spatial


@query("nu1_to_meters", """SELECT p_partkey, p_size * CASE p_size % 5 WHEN 0 THEN 111195.0 WHEN 1 THEN 1000.0 WHEN 2 THEN 1609.344 WHEN 3 THEN 1852.001 ELSE 1.0 END AS metres FROM part""")
def _(spark, d):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("Decimal Degrees", "Kilometers", "Statute Miles", "Nautical Miles", "Meters")]), (F.col("p_size") % 5 + 1).cast("int"))
    return ad.read(spark, d, "part").select("p_partkey", nu.to_meters(F.col("p_size"), unit).alias("metres"))


@query("nu3_circular_latitude", sql("""SELECT order_id, line, a - 360 * floor(a / 360) AS start, a - 360 * floor(a / 360) + CASE WHEN b - a - 360 * floor((b - a) / 360) = 0 THEN 360 ELSE b - a - 360 * floor((b - a) / 360) END AS "end"
    FROM (SELECT order_id, line, CASE WHEN flag = 'A' THEN 180 - lat ELSE lat END AS a, CASE WHEN flag = 'R' THEN 180 - lon / 2 ELSE lon / 2 END AS b FROM granules)""", "granules"))
def _(spark, d):
    g = ad.granules(spark, d)
    c = nu.circular_latitude(F.col("lat"), F.when(F.col("flag") == "A", "D").otherwise("A"), F.col("lon") / 2, F.when(F.col("flag") == "R", "D").otherwise("A"))
    return g.select("order_id", "line", c["start"].alias("start"), c["end"].alias("end"))


@query("nu4_concept_seq", "SELECT o_orderkey, o_orderkey * 3 AS seq FROM orders")
def _(spark, d):
    return ad.read(spark, d, "orders").select("o_orderkey", nu.concept_seq(F.concat(F.lit("G"), F.col("o_orderkey") * 3, F.lit("-PROV1"))).alias("seq"))


@query("sp1_distance", sql("""SELECT order_id, line, round(2 * 6367435.0 * asin(sqrt(least(1.0, pow(sin((radians(10.0) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(10.0)) * pow(sin((radians(20.0) - radians(lon)) / 2), 2)))), 2) AS metres FROM granules""", "granules"))
def _(spark, d):
    return ad.granules(spark, d).select("order_id", "line", F.round(bx.distance(F.col("lon"), F.col("lat"), F.lit(20.0), F.lit(10.0)), 2).alias("metres"))


def _box():
    w, e = F.col("lon") - F.col("half"), F.col("lon") + F.col("half")
    return bx.box(F.when(w < -180, w + 360).otherwise(w), F.least(F.col("lat") + F.col("half"), F.lit(90.0)), F.when(e > 180, e - 360).otherwise(e), F.greatest(F.col("lat") - F.col("half"), F.lit(-90.0)))


_BOX = """g AS (SELECT order_id, line, CASE WHEN lon - half < -180 THEN lon - half + 360 ELSE lon - half END AS w, least(lat + half, 90.0) AS n, CASE WHEN lon + half > 180 THEN lon + half - 360 ELSE lon + half END AS e, greatest(lat - half, -90.0) AS s FROM granules)"""


@query("sp3_box_intersects", sql(f"SELECT order_id, line FROM g WHERE s <= 15 AND n >= -5 AND CASE WHEN w > e THEN true ELSE w <= -170 OR e >= 175 END", "granules").replace(" SELECT order_id, line FROM g", f", {_BOX} SELECT order_id, line FROM g"))
def _(spark, d):
    q = bx.box(F.lit(175.0), F.lit(15.0), F.lit(-170.0), F.lit(-5.0))
    return ad.granules(spark, d).withColumn("box", _box()).where(bx.box_intersects(F.col("box"), q)).select("order_id", "line")


@query("sp5_box_world_share", sql(f"SELECT order_id, line, round(CASE WHEN w > e THEN 360 - w + e ELSE e - w END / 360 * (sin(radians(n)) - sin(radians(s))) / 2 * 100, 6) AS share FROM g", "granules").replace(" SELECT order_id, line, round", f", {_BOX} SELECT order_id, line, round"))
def _(spark, d):
    return ad.granules(spark, d).withColumn("box", _box()).select("order_id", "line", F.round(bx.box_world_share(F.col("box")), 6).alias("share"))


@query("jn14_spatial_join", sql("""SELECT g.order_id, g.line, a.s_suppkey FROM g JOIN (SELECT s_suppkey, (s_suppkey * 7) % 350 - 178.0 AS w, (s_suppkey * 3) % 150 - 70.0 AS n FROM supplier) a
    ON g.s <= a.n AND g.n >= a.n - 4 AND CASE WHEN g.w > g.e THEN a.w <= g.e OR a.w + 3 >= g.w ELSE g.w <= a.w + 3 AND a.w <= g.e END""", "granules").replace(" SELECT g.order_id", f", {_BOX} SELECT g.order_id"))
def _(spark, d):
    a = ad.read(spark, d, "supplier").select("s_suppkey", bx.box((F.col("s_suppkey") * 7 % 350 - 178).cast("double"), (F.col("s_suppkey") * 3 % 150 - 70).cast("double"), (F.col("s_suppkey") * 7 % 350 - 175).cast("double"), (F.col("s_suppkey") * 3 % 150 - 74).cast("double")).alias("area_box"))
    g = ad.granules(spark, d).select("order_id", "line", _box().alias("box"))
    return sp.spatial_join(g, a).select("order_id", "line", "s_suppkey")


@query("jn17_tiles", sql("""SELECT order_id, line, CAST(least(floor((lon * cos(radians(lat)) + 180) / 10), 35) AS INTEGER) AS h, CAST(least(floor((90 - lat) / 10), 17) AS INTEGER) AS v FROM granules""", "granules"))
def _(spark, d):
    t = sp.tile_of(F.col("lon"), F.col("lat"))
    return ad.granules(spark, d).select("order_id", "line", t["h"].alias("h"), t["v"].alias("v"))


AREA = [(-30, -20), (40, -25), (50, 30), (0, 45), (-35, 20), (-30, -20)]


@query("sp8_polygon_search", sql(f"SELECT order_id, line, lon, lat FROM granules WHERE lon BETWEEN -60 AND 60 AND lat BETWEEN -50 AND 60 AND {inside_arcs(AREA)}", "granules"))
def _(spark, d):
    area = sp.polygon(AREA)
    g = ad.granules(spark, d).select("order_id", "line", "lon", "lat")
    near = g.where("lon between -60 and 60 and lat between -50 and 60")  # the box test first
    return near.where(sp.shape_covers_point(area, F.col("lon"), F.col("lat")))


@query("jn15_orbit_join")
def _(spark, d):
    pt = lambda x, y: F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat"))
    r = ad.read(spark, d, "region")
    lon = F.col("r_regionkey") * 30.0 - 60
    p = lambda dx, dy: F.struct((lon + dx).alias("lon"), F.lit(float(dy)).alias("lat"))
    areas = r.select(F.col("r_regionkey").alias("area_id"), F.array(p(0, 10), p(8, 10), p(8, 16), p(0, 16), p(0, 10)).alias("ring"))
    orbits = ad.collections(spark, d).select(F.col("concept_id").alias("collection_id"), F.lit(94.0).alias("inclination"), F.lit(96.7).alias("period"), (F.lit(300.0) + F.col("version")).alias("swath_width"))
    g = ad.granules(spark, d).select("collection_id", "order_id", "line", F.col("lon").alias("crossing_lon"), F.lit(-50.0).alias("start_clat"), (F.col("lat") / 2 + 60).alias("end_clat"))
    return ob.orbit_search(g, areas, orbits).select("area_id", "collection_id", "order_id", "line")


@query("sp15_swath_polygons")
def _(spark, d):
    g = ad.granules(spark, d).select("order_id", "line", F.col("lon").alias("crossing_lon"), F.col("start_date").alias("crossing_time"), "start_date", (F.col("start_date") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(30))).alias("end_date"))
    g = g.withColumns({"inclination": F.lit(94.0), "period": F.lit(96.7), "swath_width": F.lit(400.0)})
    return ob.swath_polygons(g).select("order_id", "line", F.size("swath").alias("rings"), F.size(F.col("swath")[0]).alias("points"))


_TRACK = """cos(radians({lat})) * cos(radians({lon})) AS {p}x, cos(radians({lat})) * sin(radians({lon})) AS {p}y, sin(radians({lat})) AS {p}z"""
_LAT = "degrees(asin(sin(radians(94)) * sin(2 * pi() * ({t}) / 5802)))"
_LON = "lon + degrees(atan2(cos(radians(94)) * sin(2 * pi() * ({t}) / 5802), cos(2 * pi() * ({t}) / 5802))) - 360 / 86164.0905 * ({t})"


@query("sp15_swath_sums", sql(f"""SELECT order_id, line, CAST(count(*) + 1 AS INTEGER) AS points, round(sum(vx) + max(fx), 4) + 0.0 AS x, round(sum(vy) + max(fy), 4) + 0.0 AS y, round(sum(vz) + max(fz), 4) + 0.0 AS z FROM
    (SELECT *, CASE WHEN t = 0 AND side = 1 THEN vx END AS fx, CASE WHEN t = 0 AND side = 1 THEN vy END AS fy, CASE WHEN t = 0 AND side = 1 THEN vz END AS fz FROM
      (SELECT *, hx * c + side * nx / n * s AS vx, hy * c + side * ny / n * s AS vy, hz * c + side * nz / n * s AS vz FROM
        (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS n, cos(200000 / 6378137.0) AS c, sin(200000 / 6378137.0) AS s FROM
          (SELECT *, hy * az - hz * ay AS nx, hz * ax - hx * az AS ny, hx * ay - hy * ax AS nz FROM
            (SELECT rid, order_id, line, t, {_TRACK.format(lat=_LAT.format(t="t"), lon=_LON.format(t="t"), p="h")}, {_TRACK.format(lat=_LAT.format(t="t + 1"), lon=_LON.format(t="t + 1"), p="a")}
             FROM (SELECT row_number() OVER () AS rid, order_id, line, lon FROM granules), (SELECT 300.0 * i AS t FROM range(7) r(i)))), (VALUES (1), (-1)) w(side)))) GROUP BY rid, order_id, line""", "granules"))
def _(spark, d):
    """Swaths of half an hour of all granules: their points, summed up as vectors."""
    g = ad.granules(spark, d).select("order_id", "line", F.col("lon").alias("crossing_lon"), F.col("start_date").alias("crossing_time"), "start_date", (F.col("start_date") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(30))).alias("end_date"))
    ring = F.col("swath")[0]
    r = ob.swath_polygons(g.withColumns({"inclination": F.lit(94.0), "period": F.lit(96.7), "swath_width": F.lit(400.0)})).select("order_id", "line", ring.alias("ring"))
    flat = lambda p: F.cos(F.radians(p["lat"]))
    total = lambda f: F.round(F.aggregate("ring", F.lit(0.0), lambda a, p: a + f(p)), 4) + 0.0
    return r.select("order_id", "line", F.size("ring").alias("points"), total(lambda p: flat(p) * F.cos(F.radians(p["lon"]))).alias("x"), total(lambda p: flat(p) * F.sin(F.radians(p["lon"]))).alias("y"), total(lambda p: F.sin(F.radians(p["lat"]))).alias("z"))


# ---------------------------------------------------------------- documents, sources, sinks


@query("prj5_attribute_docs", """SELECT event_id AS granule_id, 'k' AS name, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS int_value FROM events""")
def _(spark, d):
    e = ad.read(spark, d, "events")
    g = e.select(F.col("event_id").alias("granule_id"), F.lit(1).alias("collection_id"), F.array(F.struct(F.lit("k").alias("name"), F.get_json_object("props", "$.k").alias("value"))).alias("attributes"))
    c = e.where("event_id = 0").select(F.lit(1).alias("concept_id"), F.array(F.struct(F.lit("K").alias("name"), F.lit("int").alias("type"), F.lit(None).cast("string").alias("group"))).alias("attributes"))
    return dc.attribute_docs(g, c).select("granule_id", "name", "int_value")


@query("prj9_json_paths", "SELECT event_id, CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS VARCHAR) AS k FROM events")
def _(spark, d):
    return dc.index_json_paths(ad.read(spark, d, "events"), {"k": "$.k"}, "props").select("event_id", "k")


@query("prj11_collection_temporal", sql("""SELECT collection_id, CASE WHEN end_date IS NULL OR end_date > TIMESTAMP '2001-12-01' - to_days(30) THEN '3000-01-01' ELSE strftime(end_date, '%Y-%m-%d') END AS ongoing FROM
    (SELECT collection_id, CASE WHEN NOT bool_or(end_date IS NULL) THEN max(end_date) END AS end_date FROM granules GROUP BY 1)""", "granules"))
def _(spark, d):
    b = fc.granule_bounds(ad.granules(spark, d)).withColumn("granule_end", F.col("end_date"))
    return dc.collection_temporal(b, "2001-12-01").select("collection_id", F.date_format("ongoing", "yyyy-MM-dd").alias("ongoing"))


@query("src2_find_concepts", sql("SELECT concept_id, short_name FROM collections WHERE short_name IN ('red ring', 'small ring')", "collections"))
def _(spark, d):
    return rd.find_concepts(ad.collections(spark, d), "collection", short_name=["red ring", "small ring"]).select("concept_id", "short_name")


@query("src5_parse_metadata", """SELECT event_id, CAST(CASE WHEN event_id % 7 <> 0 THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) ELSE -1 END AS INTEGER) AS k, event_id % 7 = 0 AS bad FROM events""")
def _(spark, d):
    from pyspark.sql import types as T

    e = ad.read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.lit("{broken")).otherwise(F.col("props")).alias("metadata"))
    out = rd.parse_metadata(e, T.StructType([T.StructField("k", T.IntegerType())]))
    return out.select("event_id", F.coalesce("k", F.lit(-1)).alias("k"), F.col("quarantine").isNotNull().alias("bad"))


@query("src7_usage_rows", sql("SELECT short_name, version, access_count * 1000 AS access_count FROM usage_metrics", "usage_metrics"))
def _(spark, d):
    u = ad.usage_metrics(spark, d).select(F.col("short_name").alias("Product"), F.col("version").alias("ProductVersion"), F.format_number(F.col("access_count") * 1000, 0).alias("Hosts"))
    return rd.usage_rows(u)


@query("src11_get_concepts", sql("SELECT concept_id, revision_id, value FROM revisions WHERE revision_id = 3", "revisions"))
def _(spark, d):
    r = ad.revisions(spark, d)
    return rd.get_concepts(r, r.where("revision_id = 3").select("concept_id", "revision_id")).select("concept_id", "revision_id", "value")


@query("snk3_refs", sql("SELECT concept_id, version AS revision_id, short_name AS name FROM collections", "collections"))
def _(spark, d):
    return sk.to_refs(ad.collections(spark, d).withColumnRenamed("version", "revision_id"), "short_name")


@query("snk2_stac", sql(f"SELECT order_id || '-' || line AS id, round(w, 6) AS west, CASE WHEN w > e THEN 'MultiPolygon' ELSE 'Polygon' END AS kind FROM g", "granules").replace(" SELECT order_id || ", f", {_BOX} SELECT order_id || "))
def _(spark, d):
    g = ad.granules(spark, d).select(F.concat_ws("-", "order_id", "line").alias("concept_id"), "collection_id", _box().alias("box"), "start_date", "end_date", "cloud_cover", F.array(F.struct(F.lit("http://x").alias("href"), F.lit("GET DATA").alias("type"), F.lit("a/b").alias("mime_type"))).alias("links"))
    s = sk.to_stac(g)
    j = lambda p: F.get_json_object("item", p)
    return s.select(j("$.id").alias("id"), F.round(j("$.bbox[0]").cast("double"), 6).alias("west"), j("$.geometry.type").alias("kind"))


@query("dt4_temporal_overlap", sql("""SELECT order_id, line, round(greatest(0, epoch(least(coalesce(end_date, TIMESTAMP '2002-01-01'), TIMESTAMP '1998-01-01')) - epoch(greatest(start_date, TIMESTAMP '1997-01-01'))) / (365 * 86400.0), 6) AS share FROM granules""", "granules"))
def _(spark, d):
    r = F.struct(F.col("start_date").alias("start"), F.col("end_date").alias("end"))
    share = dates.temporal_overlap(r, [(dt.datetime(1997, 1, 1), dt.datetime(1998, 1, 1))], dt.datetime(2002, 1, 1))
    return ad.granules(spark, d).select("order_id", "line", F.round(share, 6).alias("share"))


# ---------------------------------------------------------------- streams


def _scratch(spark) -> str:
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _stream(spark, d, name: str = "events"):
    path = f"{d}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return st.read_events(spark, path + "*", schema)


@query("sm1_stream_upsert", "SELECT user_id AS concept_id, event_id AS revision_id, value, event_type = 'error' AS deleted FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def _(spark, d):
    root = _scratch(spark)
    e = _stream(spark, d).select(F.col("user_id").alias("concept_id"), F.col("event_id").alias("revision_id"), "value", (F.col("event_type") == "error").alias("deleted"))
    target = tg.TargetTable(spark, f"{root}/target", e.schema, ["concept_id"], tg.newest(["concept_id"], "revision_id"), buckets=4)
    st.stream_upsert(e, target, f"{root}/checkpoint").awaitTermination()
    return target.read()


@query("sm2_stream_deletes", "SELECT user_id AS concept_id, event_id AS revision_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type = 'error'")
def _(spark, d):
    root = _scratch(spark)
    e = _stream(spark, d).select(F.col("user_id").alias("concept_id"), F.col("event_id").alias("revision_id"), (F.col("event_type") == "error").alias("deleted"))
    target = tg.TargetTable(spark, f"{root}/target", e.schema, ["concept_id"], tg.newest(["concept_id"], "revision_id"), buckets=4)
    st.stream_upsert(e, target, f"{root}/checkpoint").awaitTermination()
    return st.live(target)[1].select("concept_id", "revision_id")


_SM3 = sql("""SELECT r.concept_id, r.revision_id, c.c_custkey AS subscription_id, CASE WHEN deleted THEN 'Delete' WHEN revision_id = 1 THEN 'New' ELSE 'Update' END AS mode FROM revisions r JOIN customer c ON c.c_custkey // 10 = r.concept_id
    WHERE deleted OR revision_id = 1""", "revisions")


@query("sm3_notify", _SM3)
@query("sm3_notify_whole", _SM3)
def _(spark, d):
    """Every customer subscribes, ten to a collection; every collection is one concept."""
    r = ad.revisions(spark, d).withColumn("collection_id", F.col("concept_id"))
    key = F.col("c_custkey")
    s = ad.read(spark, d, "customer").select(key.alias("concept_id"), F.col("c_name").alias("subscriber_id"), F.floor(key / 10).alias("collection_id"), F.lit("q").alias("endpoint"), F.array(F.lit("New"), F.lit("Delete")).alias("modes"))
    return st.notify(r, s).select("concept_id", "revision_id", "subscription_id", "mode")


@query("sm5_digest", sql("""SELECT c.c_custkey AS subscription_id, count(DISTINCT r.concept_id) AS n FROM revisions r JOIN customer c ON c.c_custkey = r.concept_id WHERE r.revision_date > TIMESTAMP '2024-01-20' AND r.revision_date <= TIMESTAMP '2024-01-22' GROUP BY 1""", "revisions"))
def _(spark, d):
    r = ad.revisions(spark, d).withColumn("collection_id", F.col("concept_id"))
    s = ad.read(spark, d, "customer").select(F.col("c_custkey").alias("concept_id"), F.col("c_custkey").alias("collection_id"), F.lit(None).cast("timestamp_ntz").alias("last_notified_at"))
    found, _ = st.digest(r, s, "2024-01-22", 48)
    return found.select("subscription_id", F.size("ids").cast("long").alias("n"))


@query("sm5_digest_stream", """WITH e AS (SELECT c_custkey AS subscription_id, time_bucket(INTERVAL 6 HOUR, ts) AS since, user_id AS concept_id, event_id AS revision_id FROM events JOIN customer ON c_custkey // 10 = user_id % 10)
    SELECT subscription_id, since, since + INTERVAL 6 HOUR AS until, concept_id, max(revision_id) AS revision_id FROM e WHERE since + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL""")
def _(spark, d):
    """Digests of six hours for every customer, ten to a collection, of the periods that are over."""
    root = _scratch(spark)
    e = _stream(spark, d).select(F.col("user_id").alias("concept_id"), (F.col("user_id") % 10).alias("collection_id"), F.col("event_id").alias("revision_id"), F.col("ts").cast("timestamp").alias("revision_date"))
    subs = ad.read(spark, d, "customer").select(F.col("c_custkey").alias("concept_id"), F.floor(F.col("c_custkey") / 10).alias("collection_id"))
    out = st.digest_stream(e, subs, "6 hours", "1 hour")
    out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("since", "until")})


@query("sm6_derive_granules", sql("SELECT 'v' || (concept_id + 1000) AS collection_id, 'virt-' || transaction_id AS granule_ur, revision_id, deleted FROM revisions WHERE concept_id % 2 = 0", "revisions"))
def _(spark, d):
    r = ad.revisions(spark, d).select(F.col("concept_id").alias("collection_id"), F.concat(F.lit("src-"), F.col("transaction_id")).alias("granule_ur"), "revision_id", "deleted")
    config = ad.revisions(spark, d).where("concept_id % 2 = 0").select(F.col("concept_id").alias("collection_id"), F.concat(F.lit("v"), F.col("concept_id") + 1000).alias("virtual_collection_id"), F.lit("src-").alias("ur_from"), F.lit("virt-").alias("ur_to")).distinct()
    return st.derive_granules(r, config).select("collection_id", "granule_ur", "revision_id", "deleted")


@query("sm7_stream_bounds", sql("SELECT collection_id, min(start_date) AS start_date, CASE WHEN NOT bool_or(end_date IS NULL) THEN max(end_date) END AS end_date FROM granules GROUP BY 1", "granules"))
def _(spark, d):
    root = _scratch(spark)
    li = _stream(spark, d, "lineitem")
    e = F.when(~((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N")), F.col("l_shipdate") + F.make_dt_interval(F.col("l_quantity").cast("int")))
    g = li.select(F.col("l_partkey").alias("collection_id"), F.col("l_shipdate").alias("start_date"), e.alias("end_date"))
    target = tg.TargetTable(spark, f"{root}/bounds", g.schema, ["collection_id"], tg.widest(["collection_id"]), buckets=4)
    st.stream_bounds(g, target, f"{root}/checkpoint").awaitTermination()
    return target.read()


@query("sm8_dedupe_events", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def _(spark, d):
    root = _scratch(spark)
    e = _stream(spark, d).select("event_id", F.col("user_id").alias("concept_id"), F.col("event_id").alias("revision_id"), F.col("ts").cast("timestamp").alias("ts"))
    twice = e.withColumn("x", F.explode(F.array(F.lit(1), F.lit(2)))).drop("x")
    st.dedupe_events(twice, "30 days").writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query("sm9_cascade_deletes", """SELECT source_id, associated_id, 2 AS revision_id FROM (SELECT DISTINCT l_partkey AS source_id, l_suppkey AS associated_id FROM lineitem) WHERE associated_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) OR source_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)""")
def _(spark, d):
    links = ad.read(spark, d, "lineitem").select(F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("associated_id")).distinct().withColumns({"revision_id": F.lit(1), "deleted": F.lit(False), "revision_date": TS("2024-01-01")})
    gone = ad.read(spark, d, "supplier").select(F.col("s_suppkey").alias("concept_id"), (F.col("s_acctbal") < 0).alias("deleted"))
    return st.cascade_deletes(gone, links, "2024-02-01").select("source_id", "associated_id", "revision_id")


@query("mt7_visibility_lag", sql("SELECT concept_id, revision_id, value AS seconds FROM revisions", "revisions"))
def _(spark, d):
    r = ad.revisions(spark, d)
    docs = r.select("concept_id", "revision_id", (F.col("revision_date") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("value"))).alias("indexed_at"))
    return sg.visibility_lag(r.withColumn("ts", F.col("revision_date")), docs).withColumn("seconds", F.round("seconds", 2))
