"""Queries of single operators give DuckDB's rows; shapes are held against SQL half-planes and formulas."""

import inspect
import math
import re

import duckdb
import pytest

from catalograph.plans import QUERIES, SQL, rest, single

DATA = "/root/testdata/sf0.001"
OTHERS = ["sp8_polygon_search", "sp15_swath_sums", "jn14_spatial_join", "jn16_overlap_counts", "jn21_match_subscriptions", "jn21_subscription_atoms", "ag25_keyword_nodes", "sm1_stream_upsert", "sm2_stream_deletes", "sm5_digest_stream", "sm7_stream_bounds", "pm4_rules_for"]
NAMES = [n for n in re.findall(r'@query\("(\w+)"', inspect.getsource(rest) + inspect.getsource(single)) if n in SQL] + OTHERS


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("customer", "supplier", "part", "orders", "lineitem", "events", "documents", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _text(v) -> str:
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    return f"{v:.6f}" if isinstance(v, float) else str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else str(v)


def _sorted(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    cursor = db.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    got, want = _sorted(df.collect(), df.columns), _sorted(cursor.fetchall(), columns)
    assert got == want and got


def test_crossing_ranges_of_all_areas_and_orbits(spark):
    r = QUERIES["sp14_crossing_ranges"](spark, DATA)
    assert r.select("collection_id").distinct().count() == 200
    assert r.where("lat_min > lat_max").count() == 0


def test_concepts_are_written_where_they_are_read(spark):
    """No provider is one task's: the table of concepts is written without a shuffle by provider."""
    assert "repartition" not in inspect.getsource(rest._concepts)
