"""The driver's tables as catalog tables, in Spark and, for oracles, as SQL common table expressions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def revisions(spark: SparkSession, d: str) -> DataFrame:
    """``events`` as revisions of one concept for each user."""
    e = read(spark, d, "events")
    return e.select(
        F.col("user_id").alias("concept_id"),
        F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).alias("revision_id"),
        F.col("ts").alias("revision_date"),
        (F.col("event_type") == "error").alias("deleted"),
        F.col("event_id").alias("transaction_id"),
        "event_type",
        "value",
        "props",
    )


def collections(spark: SparkSession, d: str) -> DataFrame:
    """``part`` as collections."""
    return read(spark, d, "part").select(
        F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("short_name"), F.col("p_size").alias("version"),
        F.col("p_brand").alias("platform"), F.col("p_type").alias("level"), F.col("p_retailprice").alias("price"),
    )


def granules(spark: SparkSession, d: str) -> DataFrame:
    """``lineitem`` as granules; open-ended where the status is O and the flag N."""
    days = F.make_dt_interval(F.col("l_quantity").cast("int"))
    return read(spark, d, "lineitem").select(
        F.col("l_partkey").alias("collection_id"), F.col("l_suppkey").alias("provider_id"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"),
        F.col("l_shipdate").alias("start_date"),
        F.when(~((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N")), F.col("l_shipdate") + days).alias("end_date"),
        (F.col("l_discount") * 100).alias("cloud_cover"), F.col("l_tax").alias("access_value"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("size"),
        (F.pmod(F.col("l_partkey") * 37 + F.col("l_suppkey") * 11, F.lit(360)) - 180).cast("double").alias("lon"),
        (F.pmod(F.col("l_orderkey") * 13, F.lit(180)) - 90).cast("double").alias("lat"),
        (F.col("l_quantity") / 10).alias("half"),
    )


def providers(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as providers; their region is the consortium."""
    s, n, r = (read(spark, d, t) for t in ("supplier", "nation", "region"))
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey).select(
        F.col("s_suppkey").alias("provider_id"), F.col("s_name").alias("name"), F.col("n_name").alias("nation"), F.col("r_name").alias("consortium")
    )


def usage_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Orders for each part, as access counts by short name and version."""
    li, p = read(spark, d, "lineitem"), read(spark, d, "part")
    return li.join(p, li.l_partkey == p.p_partkey).groupBy(F.col("p_name").alias("short_name"), F.col("p_size").cast("string").alias("version")).agg(F.count("*").alias("access_count"))


CTES = {
    "revisions": """revisions AS (SELECT user_id AS concept_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS revision_id, ts AS revision_date,
      event_type = 'error' AS deleted, event_id AS transaction_id, event_type, value, props FROM events)""",
    "collections": """collections AS (SELECT p_partkey AS concept_id, p_name AS short_name, p_size AS version, p_brand AS platform, p_type AS level, p_retailprice AS price FROM part)""",
    "granules": """granules AS (SELECT l_partkey AS collection_id, l_suppkey AS provider_id, l_orderkey AS order_id, l_linenumber AS line, l_shipdate AS start_date,
      CASE WHEN NOT (l_linestatus = 'O' AND l_returnflag = 'N') THEN l_shipdate + to_days(CAST(l_quantity AS INTEGER)) END AS end_date,
      l_discount * 100 AS cloud_cover, l_tax AS access_value, l_returnflag AS flag, l_quantity AS size,
      CAST((l_partkey * 37 + l_suppkey * 11) % 360 - 180 AS DOUBLE) AS lon, CAST((l_orderkey * 13) % 180 - 90 AS DOUBLE) AS lat, l_quantity / 10 AS half FROM lineitem)""",
    "providers": """providers AS (SELECT s_suppkey AS provider_id, s_name AS name, n_name AS nation, r_name AS consortium FROM supplier
      JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "usage_metrics": """usage_metrics AS (SELECT p_name AS short_name, CAST(p_size AS VARCHAR) AS version, count(*) AS access_count FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)""",
}


def sql(body: str, *views: str) -> str:
    """``body`` over the named catalog views."""
    return "WITH " + ", ".join(CTES[v] for v in views) + " " + body


def inside_arcs(ring: list[tuple[float, float]]) -> str:
    """SQL for a point (lon, lat) on the left of each great circle along a convex ring."""
    def vector(lon: float, lat: float) -> tuple[float, float, float]:
        a, b = math.radians(lon), math.radians(lat)
        return math.cos(b) * math.cos(a), math.cos(b) * math.sin(a), math.sin(b)

    out = []
    for p, q in zip(ring, ring[1:]):
        (a, b, c), (e, f, g) = vector(*p), vector(*q)
        x, y, z = b * g - c * f, c * e - a * g, a * f - b * e
        out.append(f"cos(radians(lat)) * (cos(radians(lon)) * ({x!r}) + sin(radians(lon)) * ({y!r})) + sin(radians(lat)) * ({z!r}) >= -1e-9")
    return " AND ".join(out)
