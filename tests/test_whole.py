"""Queries that work on whole tables, at sf0.001."""

import duckdb

import __spark_entry__ as entry

FAR = "TIMESTAMP '9999-01-01'"


def oracle(sf, sql):
    con = duckdb.connect()
    for t in ("lineitem", "part", "supplier", "orders", "customer", "events", "documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con.sql(sql).fetchall()


def same_as_sql(spark, sf, name):
    got = sorted((tuple(r) for r in entry.queries()[name](spark, sf).collect()), key=repr)
    assert got == sorted(oracle(sf, entry.oracle_sql()[name]), key=repr)
    return got


def test_temporal_join_takes_all_granules_and_orders(spark, sf):
    """Against all pairs of rows."""
    want = oracle(sf, f"""SELECT count(*), sum(o_orderkey * 31 + l_orderkey * 7 + l_linenumber), count(DISTINCT o_orderkey), count(DISTINCT (l_orderkey, l_linenumber)) FROM
        (SELECT *, CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN {FAR} ELSE l_shipdate + to_days(CAST(l_quantity AS INTEGER)) END AS e FROM lineitem) JOIN orders ON l_shipdate <= o_orderdate + to_days(3) AND o_orderdate <= e""")
    got = entry.queries()["jn16_temporal_join_whole"](spark, sf).selectExpr("count(*)", "sum(o_orderkey * 31 + order_id * 7 + line)", "count(distinct o_orderkey)", "count(distinct order_id, line)").first()
    assert [tuple(got)] == want


def test_associations_take_all_links(spark, sf):
    rows = same_as_sql(spark, sf, "jn8_with_associations_whole")
    links = oracle(sf, "SELECT count(DISTINCT (l_partkey, l_suppkey)) FROM lineitem")
    assert sum(r[2] for r in rows) == links[0][0]


def test_every_customer_is_a_subscriber(spark, sf):
    rows = same_as_sql(spark, sf, "sm3_notify_whole")
    keys = {k for (k,) in oracle(sf, "SELECT c_custkey FROM customer WHERE c_custkey // 10 IN (SELECT user_id FROM events)")}
    assert {r[2] for r in rows} == keys
    assert max(sum(1 for r in rows if r[:2] == x[:2]) for x in rows[:20]) == 10  # several to a collection


def test_orbits_of_all_collections_are_searched(spark, sf):
    """Granules of every collection, by the ranges of single points."""
    from catalograph.operators import orbit as ob

    rows = [tuple(r) for r in entry.queries()["jn15_orbit_join"](spark, sf).collect()]
    assert len({r[1] for r in rows}) > 100  # of 200 collections
    want = set()
    for k in range(5):
        lon = k * 30.0 - 60
        pts = [(lon + x, 10.0 + y) for x in (0, 2, 4, 6, 8) for y in (0, 2, 4, 6)]
        for v in (3, 40):
            own = {up: [r for p in pts if (r := ob.crossing_range(*p, 94.0, 96.7, 300.0 + v, up))] for up in (True, False)}
            for c, o, n, x, lat in oracle(sf, f"SELECT p_partkey, l_orderkey, l_linenumber, (l_partkey * 37 + l_suppkey * 11) % 360 - 180, (l_orderkey * 13) % 180 - 90 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size = {v}"):
                for up, rs in own.items():
                    lo, hi = (10, 16) if up else (164, 170)
                    end = lat / 2 + 60
                    if any(-50 <= hi + t and end >= lo + t for t in (-360, 0, 360)) and any(a <= x <= b if a <= b else x >= a or x <= b for a, b in rs):
                        want.add((k, c, o, n))
    sized = {c for (c,) in oracle(sf, "SELECT p_partkey FROM part WHERE p_size IN (3, 40)")}
    assert want and {r for r in rows if r[1] in sized} == want


def test_swaths_of_all_granules(spark, sf):
    assert entry.queries()["sp15_swath_polygons"](spark, sf).where("rings > 0 and points > 3").count() == 6000


def test_tree_of_all_parts(spark, sf):
    same_as_sql(spark, sf, "ag25_keyword_tree_whole")
