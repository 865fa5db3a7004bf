"""Queries of operators that otherwise run inside others only: sweeps, merges, references, streams, ranges, patterns, orders."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import boxes as bx, dates, filters as fl
from ..operators import quality as dq, sorting as so, spatial as sp, timeline as tl
from ..sources import adapters as ad, sinks as sk
from ..sources.adapters import sql
from .more import _scratch, _stream
from .registry import query


@query("wn5_sweep", sql("""SELECT provider_id, t, change, CAST(sum(change) OVER (PARTITION BY provider_id ORDER BY t, change DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running FROM
    (SELECT provider_id, start_date AS t, 1 AS change FROM granules UNION ALL SELECT provider_id, end_date, -1 FROM granules WHERE end_date IS NOT NULL)""", "granules"))
def _(spark, d):
    """Granules of each provider that run at each start and end."""
    g = ad.granules(spark, d)
    starts = g.select("provider_id", F.col("start_date").alias("t"), F.lit(1).alias("change"))
    ends = g.where("end_date is not null").select("provider_id", F.col("end_date").alias("t"), F.lit(-1).alias("change"))
    return tl.sweep(starts.unionByName(ends), "provider_id", "t", "change")


@query("wn6_merge_adjacent", """WITH d AS (SELECT l_suppkey AS k, l_shipdate AS s, count(*) AS n FROM lineitem GROUP BY 1, 2), w AS (SELECT *, CASE WHEN lag(s) OVER (PARTITION BY k ORDER BY s) = s - INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM d),
    i AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY s) AS span FROM w) SELECT k AS collection_id, min(s) AS s, max(s) AS e, CAST(sum(n) AS BIGINT) AS n FROM i GROUP BY k, span""")
def _(spark, d):
    """Days with shipments of each supplier, days in a row as one span."""
    li = ad.read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("collection_id"), F.col("l_shipdate").alias("s")).agg(F.count("*").alias("n"))
    return tl.merge_adjacent(li.withColumns({"e": F.col("s"), "left": F.lit(0).cast("long")}), "day").select("collection_id", "s", "e", "n")


@query("snk4_refs", sql("SELECT concept_id, revision_id, event_type AS name FROM revisions", "revisions"))
def _(spark, d):
    return sk.to_refs(ad.revisions(spark, d), "event_type")


@query("src10_change_events", "SELECT event_id, user_id, event_type, value FROM events")
def _(spark, d):
    """The change stream, read to its end and written as it comes."""
    root = _scratch(spark)
    e = _stream(spark, d).select("event_id", "user_id", "event_type", "value")
    e.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(e.schema).parquet(f"{root}/out")


RANGES = {"1996-03-01T00:00:00Z/P1Y2M3D": ("1996-03-01", "1997-05-04"), "P2W/1998-01-15T00:00:00Z": ("1998-01-01", "1998-01-15"), "1995-06-01T12:00:00Z,": ("1995-06-01 12:00:00", None), ",1993-01-31": (None, "1993-01-31")}


@query("flt35_iso_range", sql(" UNION ALL ".join(f"SELECT '{text}' AS asked, order_id, line FROM granules WHERE " + " AND ".join([f"start_date >= TIMESTAMP '{a}'"] * bool(a) + [f"start_date <= TIMESTAMP '{b}'"] * bool(b)) for text, (a, b) in RANGES.items()), "granules"))
def _(spark, d):
    """Granules that start in ranges given as text: with a period, before a period's end, and open."""
    g, out = ad.granules(spark, d), None
    for text in RANGES:
        one = g.where(fl.date_range("start_date", *dates.parse_range(text))).select(F.lit(text).alias("asked"), "order_id", "line")
        out = one if out is None else out.unionByName(one)
    return out


PATTERNS = {"a*": "p_name LIKE 'a%'", "*e?": "p_name LIKE '%e_'", "?l*e*": "p_name LIKE '_l%e%'", "*": "true", "*.*": "p_name LIKE '%.%'", "b\\*": "p_name = 'b*'"}


@query("tx4_wildcard_regex", " UNION ALL ".join(f"SELECT '{p}' AS pattern, p_partkey FROM part WHERE {c}" for p, c in PATTERNS.items()))
def _(spark, d):
    p = ad.read(spark, d, "part")
    asked = F.explode(F.array(*[F.struct(F.lit(x).alias("pattern"), F.lit(fl.wildcard_regex(x)).alias("regex")) for x in PATTERNS]))
    return p.select("p_partkey", "p_name", asked.alias("a")).where(F.rlike("p_name", F.col("a.regex"))).select("a.pattern", "p_partkey")


_WINDOWS = "SELECT y, greatest(make_date(y, 1, 1) + 58 + leap, DATE '1992-02-10') AS a, least(make_date(y, 1, 1) + 99 + leap, DATE '1998-03-20') AS b FROM (SELECT CAST(y AS INTEGER) AS y, CASE WHEN y % 4 = 0 THEN 1 ELSE 0 END AS leap FROM range(1992, 1999) r(y))"


@query("dt5_period_windows", sql(f"SELECT y AS year, order_id, line FROM granules JOIN ({_WINDOWS}) w ON start_date >= a AND start_date <= b", "granules"))
def _(spark, d):
    """Granules in days 59 to 100 of each year, leap years moved by a day, clipped to the range."""
    windows = dates.periodic_windows(dt.datetime(1992, 2, 10), dt.datetime(1998, 3, 20), 59, 100, dt.datetime(2000, 1, 1))
    stamp = lambda x: F.lit(x).cast("timestamp_ntz")
    rows = F.explode(F.array(*[F.struct(F.lit(a.year).alias("year"), stamp(a).alias("a"), stamp(b).alias("b")) for a, b in windows]))
    g = ad.granules(spark, d).select("order_id", "line", "start_date", rows.alias("w"))
    return g.where(F.col("start_date").between(F.col("w.a"), F.col("w.b"))).select("w.year", "order_id", "line")


@query("so3_tiebreak_page", sql("SELECT concept_id, platform FROM collections ORDER BY platform, concept_id LIMIT 60 OFFSET 60", "collections"))
def _(spark, d):
    """The second page by a key of few values: which collections it holds follows from the tie-breakers."""
    return so.page(so.sort_by(ad.collections(spark, d), ["+platform"], "variable"), 60, 2).select("concept_id", "platform")


@query("so6_offset_page", sql("SELECT concept_id, version FROM collections ORDER BY version DESC, concept_id LIMIT 23 OFFSET 56", "collections"))
def _(spark, d):
    return so.page(so.sort_by(ad.collections(spark, d), ["-version"], "variable"), 23, offset=56).select("concept_id", "version")


# ---------------------------------------------------------------- every branch of a rule


@query("dq3_reference_branches", sql("""SELECT order_id, line, concat_ws(';', CASE WHEN len(a) > 0 THEN 'platforms: ' || array_to_string(a, ', ') END, CASE WHEN len(b) > 0 THEN 'sensors: ' || array_to_string(b, ', ') END) AS errors FROM
    (SELECT order_id, line, list_sort(list_filter([lower(flag), 'x' || line], lambda x: NOT list_contains(CASE WHEN version % 5 > 0 THEN [lower(substr(level, 1, 1)), 'x' || version % 7, 'n'] ELSE [] END, x))) AS a,
      CASE WHEN line % 3 > 0 THEN list_filter(['s' || line], lambda x: x <> 's' || version % 4) ELSE [] END AS b FROM granules g JOIN collections c ON g.collection_id = c.concept_id)""", "granules", "collections"))
def _(spark, d):
    """Names in two fields: several lost, one, none, and nulls on either side."""
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    g = ad.granules(spark, d).withColumns({"platforms": F.array(F.col("flag"), text("X", F.col("line"))), "sensors": F.when(F.col("line") % 3 > 0, F.array(text("s", F.col("line"))))})
    c = ad.collections(spark, d).withColumns({"platforms": F.when(F.col("version") % 5 > 0, F.array(F.col("level").substr(1, 1), text("x", F.col("version") % 7), F.lit("N"))), "sensors": F.array(text("S", F.col("version") % 4))})
    return dq.check_references(g, c.select("concept_id", "platforms", "sensors"), ["platforms", "sensors"]).select("order_id", "line", F.array_join("errors", ";").alias("errors"))


@query("dq5_grid_branches", sql("""SELECT order_id, line, CASE WHEN line = 7 THEN 'grid unknown to parent' ELSE concat_ws(',', CASE WHEN size < 5 OR size > 30 THEN 'start_1 out of bounds' END, CASE WHEN size + line > 30 THEN 'end_1 out of bounds' END,
    CASE WHEN lat < -60 OR lat > 45 THEN 'start_2 out of bounds' END, CASE WHEN line % 2 = 0 AND lat + line > 45 OR line % 2 = 0 AND lat + line < -60 THEN 'end_2 out of bounds' END) END AS errors FROM granules""", "granules"))
def _(spark, d):
    """Each end of both axes on either side of its bounds, ends left out, and a grid that the parent doesn't know."""
    x, y, k = F.col("size"), F.col("lat"), F.col("line")
    bounds = F.when(k != 7, F.struct(F.lit(5.0).alias("min_1"), F.lit(30.0).alias("max_1"), F.lit(-60.0).alias("min_2"), F.lit(45.0).alias("max_2")))
    g = ad.granules(spark, d).withColumns({"grid": F.struct(x.alias("start_1"), (x + k).alias("end_1"), y.alias("start_2"), F.when(k % 2 == 0, y + k).alias("end_2")), "bounds": bounds})
    g = g.withColumn("grid", F.when(k != 7, F.col("grid").withField("end_1", F.greatest(F.col("grid.end_1"), F.lit(5.0)))).otherwise(F.col("grid")))
    return dq.check_grid(g).select("order_id", "line", F.array_join("errors", ",").alias("errors"))


_KINDS = ["FLOAT", "INT", "BOOLEAN", "DATE", "DATETIME", "STRING", "TIME_STRING"]
_VALUES = ["12.5", "40", "true", "2001-02-03", "2001-02-03T04:05:06", "abc", "2001-02-30", "-7", None]


@query("dq6_attribute_branches", """WITH k(i, kind, lo, hi) AS (VALUES (0, 'FLOAT', '0', '30'), (1, 'INT', '-3', NULL), (2, 'BOOLEAN', NULL, NULL), (3, 'DATE', '2001-03-01', NULL), (4, 'DATETIME', NULL, '2001-01-01T00:00:00'), (5, 'STRING', 'a', NULL), (6, 'TIME_STRING', NULL, NULL)),
    v(j, value) AS (VALUES (0, '12.5'), (1, '40'), (2, 'true'), (3, '2001-02-03'), (4, '2001-02-03T04:05:06'), (5, 'abc'), (6, '2001-02-30'), (7, '-7'), (8, NULL)),
    e AS (SELECT kind, value, CASE kind || ':' || coalesce(value, '') WHEN 'FLOAT:12.5' THEN '' WHEN 'FLOAT:40' THEN 'value out of range' WHEN 'FLOAT:-7' THEN 'value out of range' WHEN 'FLOAT:' THEN '' WHEN 'INT:40' THEN '' WHEN 'INT:-7' THEN 'value out of range' WHEN 'INT:' THEN ''
      WHEN 'BOOLEAN:true' THEN '' WHEN 'BOOLEAN:' THEN '' WHEN 'DATE:2001-02-03' THEN 'value out of range' WHEN 'DATE:2001-02-03T04:05:06' THEN 'value out of range' WHEN 'DATE:' THEN '' WHEN 'DATETIME:2001-02-03' THEN 'value out of range' WHEN 'DATETIME:2001-02-03T04:05:06' THEN 'value out of range' WHEN 'DATETIME:' THEN ''
      ELSE CASE kind WHEN 'STRING' THEN 'range not allowed' WHEN 'TIME_STRING' THEN '' ELSE 'value does not parse' END END AS errors, i, j FROM k, v)
    SELECT event_id, kind, e.value, errors FROM events JOIN e ON i = event_id % 7 AND j = event_id % 9""")
def _(spark, d):
    """Each type with values that fit, don't parse, lie outside, and ranges where none belongs."""
    pick = lambda some, n: F.element_at(F.array(*[F.lit(x).cast("string") for x in some]), (F.col("event_id") % n + 1).cast("int"))
    e = ad.read(spark, d, "events").select("event_id", pick(_KINDS, 7).alias("kind"), pick(_VALUES, 9).alias("value"), pick(["0", "-3", None, "2001-03-01", None, "a", None], 7).alias("lo"), pick(["30", None, None, None, "2001-01-01T00:00:00", None, None], 7).alias("hi"))
    return e.select("event_id", "kind", "value", F.array_join(dq.attribute_errors(F.col("kind"), F.col("value"), F.col("lo"), F.col("hi")), ",").alias("errors"))


@query("dq7_repeated_names", """WITH n AS (SELECT o_custkey, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2)
    SELECT o_custkey, coalesce('priority must be unique: ' || string_agg(p, ', ' ORDER BY p) FILTER (n > 1), '') AS errors FROM n GROUP BY 1""")
def _(spark, d):
    """Which names a record has twice, each once and in order."""
    o = ad.read(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("names"))
    return dq.check_unique(o, F.col("names"), "priority").select("o_custkey", F.array_join("errors", ";").alias("errors"))


_AT = "degrees(atan(tan(radians(y)) * cos(radians({} - x - 30)) / cos(radians(30))))"


@query("sp9_arcs_meet_box", f"""SELECT p_partkey, lo <= hi AND least(a, b, CASE WHEN x + 30 BETWEEN lo AND hi THEN m ELSE 90 END) <= 40 AND greatest(a, b, CASE WHEN x + 30 BETWEEN lo AND hi THEN m ELSE -90 END) >= -35 AS met FROM
    (SELECT *, {_AT.format("lo")} AS a, {_AT.format("hi")} AS b, {_AT.format("(x + 30)")} AS m FROM (SELECT *, greatest(x, -50) AS lo, least(x + 60, 70) AS hi FROM
      (SELECT p_partkey, p_partkey * 7 % 290 - 170 + 0.2 AS x, p_partkey * 3 % 160 - 80 + 0.3 AS y FROM part)))""")
def _(spark, d):
    """Geodetic lines against a box: arcs that rise over its parallels and come down within it."""
    k = F.col("p_partkey")
    p = ad.read(spark, d, "part").select("p_partkey", (k * 7 % 290 - 170 + 0.2).alias("x"), (k * 3 % 160 - 80 + 0.3).alias("y"))
    point = lambda x: F.struct(x.alias("lon"), F.col("y").alias("lat"))
    line = F.struct(F.lit("line").alias("kind"), F.lit("geodetic").alias("coord_sys"), F.array(F.array(point(F.col("x")), point(F.col("x") + 60))).alias("rings"))
    box = sp.box_shape(bx.box(*[F.lit(float(v)) for v in (-50, 40, 70, -35)]))
    return sp.spread(p, "p_partkey").select("p_partkey", sp.shape_intersects(line, box).alias("met"))
