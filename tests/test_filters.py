"""Predicates: null semantics, wildcards, nested fields, ranges, guards."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from catalograph.functions import dates, filters as fl
from catalograph.plans.builder import build_filter


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([(1, "AST_L1A"), (2, "mod-09?"), (3, None), (4, "a*b"), (5, "")], "id int, name string")


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_negation_keeps_missing(names):
    assert ids(names.where(fl.negate(fl.string_eq("name", "ast_l1a")))) == [2, 3, 4, 5]
    assert ids(names.where(fl.exclude(fl.string_eq("name", "ast_l1a"), fl.string_like("name", "a*")))) == [2, 3, 4, 5]


@pytest.mark.parametrize("pattern, want", [("a*", [1, 4]), ("*09\\?", [2]), ("a\\*b", [4]), ("?????09?", []), ("*", [1, 2, 4, 5]), ("mod.09?", [])])
def test_wildcards(names, pattern, want):
    assert ids(names.where(fl.string_like("name", pattern))) == want


def test_case(names):
    assert ids(names.where(fl.string_eq("name", "AST_l1a", case_sensitive=True))) == []
    assert ids(names.where(fl.string_in("name", ["ast_l1a", "A*B"]))) == [1, 4]


def test_ranges(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 6.0, 9.0), (3, None, 2.0)], "id int, lo double, hi double")
    assert ids(df.where(fl.range_intersects("lo", "hi", 2, 3))) == [1, 3]
    assert ids(df.where(fl.num_range_param("lo", "6"))) == [2]
    with pytest.raises(ValueError):
        fl.num_range("lo", None, None)


def test_nested_needs_one_element(spark):
    df = spark.createDataFrame([(1, [("A", 1), ("B", 2)]), (2, [("A", 2)]), (3, None), (4, [])], "id int, xs array<struct<n:string,v:int>>")
    assert ids(df.where(fl.nested_match("xs", n="a", v=2))) == [2]
    assert ids(df.where(fl.missing("xs", array=True))) == [3, 4]


def test_phrase_rules(spark):
    df = spark.createDataFrame([(1, [" sea surface temperature "]), (2, [" surface "])], "id int, p array<string>")
    assert ids(df.where(fl.keyword_phrase("p", '"surface temp*"'))) == [1]
    for bad in ('"a" b', '"a" "b"', "a"):
        with pytest.raises(ValueError):
            fl.keyword_phrase("p", bad)


def test_attributes(spark):
    df = spark.createDataFrame([(1, [("X", 1.5, None)]), (2, [("x", 9.0, None)]), (3, [("y", None, "Q")])], "id int, attributes array<struct<name:string,float_value:double,string_value:string>>")
    assert ids(df.where(fl.attribute_match("float,x,1,2"))) == [1]
    assert ids(df.where(fl.attribute_match("float,x,2,"))) == [2]
    assert ids(df.where(fl.attribute_match("string,Y,q"))) == [3]
    assert ids(df.where(fl.attribute_match("x"))) == [1, 2]


def test_longitudes_wrap(spark):
    df = spark.createDataFrame([(1, [(1, 1, 1, 175.0)]), (2, [(2, 2, 3, -175.0)]), (3, [(4, 4, 4, 0.0)])], "id int, orbit_domains array<struct<orbit_number:int,start_orbit:int,stop_orbit:int,equator_lon:double>>")
    assert ids(df.where(fl.equator_longitude(170, -170))) == [1, 2]
    assert ids(df.where(fl.orbit_number(3, 4))) == [2, 3]


def test_boxes_over_the_antimeridian(spark):
    df = spark.createDataFrame([(1, 170.0, 10.0, -170.0, -10.0), (2, 100.0, 10.0, 160.0, -10.0), (3, -175.0, 50.0, -100.0, 20.0)], "id int, west double, north double, east double, south double")
    assert ids(df.where(fl.mbr_overlap("", 175, 5, -160, -5))) == [1]
    assert ids(df.where(fl.mbr_overlap("", 150, 60, -120, -5))) == [1, 2, 3]


@pytest.mark.parametrize(
    "text, want",
    [("0 to 1 km", (0, 1000)), ("1 meter & above", (1, None)), ("1+to+30+meters", (1, 30)), ("500 meters to 1 km", (500, 1000))],
)
def test_resolutions(text, want):
    assert fl.parse_resolution(text) == want


def test_periods_in_leap_years():
    """Day 59 is 28 February in ordinary years and 29 February in leap years."""
    w = dates.periodic_windows(dt.datetime(1999, 1, 1), dt.datetime(2000, 12, 31), 59, 90, dt.datetime(2020, 1, 1))
    assert [a.strftime("%m-%d") for a, _ in w] == ["02-28", "02-29"]
    assert [b.strftime("%m-%d") for _, b in w] == ["03-31", "03-31"]


def test_periods_that_wrap_and_clip():
    w = dates.periodic_windows(dt.datetime(1998, 1, 15), dt.datetime(2000, 1, 10), 335, 20, dt.datetime(2020, 1, 1))
    assert w[0] == (dt.datetime(1998, 12, 1), dt.datetime(1999, 1, 20)) and w[1][1] == dt.datetime(2000, 1, 10)


@pytest.mark.parametrize(
    "text, want",
    [("2000-01-01/P1M", ("2000-01-01", "2000-02-01")), ("P1Y/2001-03-01", ("2000-03-01", "2001-03-01")), (",2001", (None, "2001-01-01")), ("2000-02-03T04:05:06+01:00,", ("2000-02-03T03:05:06", None))],
)
def test_range_texts(text, want):
    assert dates.parse_range(text) == tuple(w and dt.datetime.fromisoformat(w) for w in want)


def test_builder_and_guards(names):
    fields = {"name": ("string", "name")}
    assert ids(names.where(build_filter({"or": [{"name": "AST*"}, {"not": {"name": "*"}}]}, "collection", {"name": {"pattern": True}}, fields))) == [1, 3]
    assert ids(names.where(build_filter({"exclude": {"name": ["a*b", "ast_l1a"]}}, "collection", {}, fields))) == [2, 3, 5]
    with pytest.raises(ValueError):
        build_filter({"nothing": 1}, "collection")
    with pytest.raises(ValueError):
        fl.check_query({"and": [{"name": ["x"] * 5000}]})
    with pytest.raises(ValueError):
        fl.check_query({"or": [{"name": "*x"}] * 6})


def test_data_type_default(spark):
    df = spark.createDataFrame([(1, None), (2, "SCIENCE_QUALITY"), (3, "OTHER")], "id int, data_type string")
    assert ids(df.where(fl.collection_data_type("science_quality"))) == [1, 2]
    assert ids(df.where(F.coalesce(fl.collection_data_type("other"), F.lit(False)))) == [3]


def test_keyword_wildcards_by_length(spark):
    """At each edge of the table: as many as allowed, one more, and one character more."""
    edges = {1: 30, 4: 30, 5: 30, 7: 30, 8: 30, 16: 30, 17: 22, 40: 22, 41: 16, 74: 16, 75: 13, 110: 13, 111: 10, 182: 10, 183: 5, 241: 5, 242: 0}
    texts = []
    for length, most in edges.items():
        assert fl.keyword_limit(length) == most
        texts += [(" ".join(["x" * (length - 1) + "*"] + ["?"] * (n - 1) + ["plain"] * 9), n <= most) for n in (most, most + 1) if n]
    df = spark.createDataFrame([*texts, (None, True), ("", True), ("no wildcard " * 200, True)], "t string, ok boolean")
    assert df.where(fl.keyword_problem(F.col("t")).isNull() != F.col("ok")).count() == 0
    for text, ok in texts:
        if ok:
            fl.check_query({"keyword": text})
        else:
            with pytest.raises(ValueError, match="keyword wildcards"):
                fl.check_query({"and": [{"not": {"keyword": text}}]}, max_leading=10**6)
    assert spark.createDataFrame([(" ".join(["a" * 20 + "*"] * 23),)], "t string").select(fl.keyword_problem(F.col("t"))).first()[0] == "23 keywords with wildcards, 22 allowed as the longest has 21 characters"
