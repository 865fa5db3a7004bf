"""Facets and counts. Distinct counts are exact; no facet is capped unless asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

FACET = "field string, value string"


def _values(df: DataFrame, field: str) -> Column:
    """A field's distinct values in a row as an array of strings."""
    c = F.col(field)
    if isinstance(df.schema[field].dataType, ArrayType):
        return F.array_distinct(F.transform(c, lambda x: x.cast("string")))
    return F.array(c.cast("string"))


def _pairs(df: DataFrame, field: str) -> Column:
    pairs = F.transform(_values(df, field), lambda v: F.struct(F.lit(field).alias("field"), v.alias("value")))
    return F.coalesce(pairs, F.array().cast("array<struct<field:string,value:string>>"))


def facet(df: DataFrame, fields: list[str], size: int | None = None) -> DataFrame:
    """(field, value, n): records for each value of each field, in one pass over ``df``.

    A row gives out its (field, value) pairs, which aggregate on the map side.
    """
    pairs = F.flatten(F.array(*[_pairs(df, f) for f in fields]))
    out = df.select(F.explode(pairs).alias("p")).where("p.value is not null").groupBy("p.field", "p.value").agg(F.count("*").alias("n"))
    if size is not None:
        from pyspark.sql.window import Window as W

        rank = F.row_number().over(W.partitionBy("field").orderBy(F.desc("n"), "value"))
        out = out.withColumn("_r", rank).where(F.col("_r") <= size).drop("_r")
    return out


def facet_tree(df: DataFrame, levels: list[str], record: str | None = None) -> DataFrame:
    """Counts of records at each level of a hierarchy: (level columns, depth, n).

    ``record``: a key to count distinct records by, where one record has several rows.
    """
    count = F.count_distinct(record) if record else F.count("*")
    out = df.rollup(*levels).agg(count.alias("n"), F.grouping_id().alias("_g"))
    depth = F.lit(len(levels)) - F.bit_count("_g")
    out = out.withColumn("depth", depth).where("depth > 0")
    for i, c in enumerate(levels):  # rows without a value at their own level say nothing
        out = out.where((F.col("depth") <= i) | F.col(c).isNotNull())
    return out.select(*levels, F.col("depth").cast("int").alias("depth"), "n")


def facet_prioritized(df: DataFrame, value: str, priority: str, size: int = 50) -> DataFrame:
    """Values by mean priority, then count, both descending."""
    return df.groupBy(value).agg(F.avg(priority).alias("priority"), F.count("*").alias("n")).orderBy(F.desc("priority"), F.desc("n"), value).limit(size)


def facet_ranges(df: DataFrame, field: str, ranges: list[tuple[str, float, float]]) -> DataFrame:
    """(label, n) of records with a value in [low, high) of each range; empty ranges are left out."""
    c = F.col(field)
    array = isinstance(df.schema[field].dataType, ArrayType)
    def hit(low, high):
        test = lambda x: (x >= low) & (x < high)
        return F.exists(c, test) if array else test(c)
    sums = df.agg(*[F.count_if(hit(low, high)).alias(f"r{i}") for i, (_, low, high) in enumerate(ranges)])
    pairs = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(i).alias("place"), F.col(f"r{i}").alias("n")) for i, (label, _, _) in enumerate(ranges)])
    return sums.select(F.explode(pairs).alias("x")).select("x.*").where("n > 0").orderBy("place").drop("place")


def facet_temporal(df: DataFrame, field: str, year: int | None = None, month: int | None = None) -> DataFrame:
    """Years; or a year's months; or a month's days."""
    c = F.col(field)
    if year is not None:
        df = df.where(F.year(c) == year)
    if month is not None:
        df = df.where(F.month(c) == month)
    part = F.year(c) if year is None else F.month(c) if month is None else F.day(c)
    return df.where(c.isNotNull()).groupBy(part.alias("part")).agg(F.count("*").alias("n"))


def facet_cycle(df: DataFrame, cycle: int | None = None, record: str = "concept_id") -> DataFrame:
    """Cycles with their records; within one cycle, passes with their distinct records."""
    if cycle is None:
        return df.where("cycle is not null").groupBy("cycle").agg(F.count("*").alias("n"))
    passes = df.where(F.col("cycle") == cycle).select(record, F.explode("passes").alias("p"))
    return passes.groupBy(F.col("p.pass").alias("pass")).agg(F.count_distinct(record).alias("n"))


def facets_multiselect(df: DataFrame, filters: dict[str, Column], fields: list[str]) -> DataFrame:
    """Facets in which each field's own filter is left off, in one pass.

    Each filter is evaluated once, as a bit of failed filters; a field counts rows that fail no
    filter but possibly its own.
    """
    names = list(filters)
    failed = sum([F.when(F.coalesce(filters[f], F.lit(False)), 0).otherwise(1 << i) for i, f in enumerate(names)], F.lit(0))
    d = df.withColumn("_failed", failed)
    parts = []
    for f in fields:
        own = 1 << names.index(f) if f in names else 0
        ok = F.col("_failed").bitwiseAND(F.lit(~own)) == 0
        parts.append(F.when(ok, _pairs(df, f)).otherwise(F.array().cast("array<struct<field:string,value:string>>")))
    pairs = F.flatten(F.array(*parts))
    return d.select(F.explode(pairs).alias("p")).where("p.value is not null").groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


def with_zero_terms(found: DataFrame, terms: list[tuple[str, str]]) -> DataFrame:
    """Applied (field, value) terms without hits, with count 0, added to the facet."""
    spark = found.sparkSession
    if not terms:
        return found
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(v).alias("value")) for f, v in terms])
    t = spark.range(1).select(F.explode(rows).alias("t")).select("t.field", "t.value").distinct()
    none = t.join(found, [t.field == found.field, F.lower(t.value) == F.lower(found.value)], "left_anti")
    return found.unionByName(none.withColumn("n", F.lit(0).cast("long")))


def facet_nodes(tree: DataFrame, levels: list[str], applied: list[str] = ()) -> DataFrame:
    """A tree of :func:`facet_tree` as nested nodes, one row for each root, children sorted by title.

    Nodes whose title is applied, or that lie above one, are flagged.
    """
    want = F.array(*[F.lit(a.lower()) for a in applied]) if applied else F.array().cast("array<string>")
    nodes = None
    for i in range(len(levels) - 1, -1, -1):
        here = tree.where(F.col("depth") == i + 1)
        keys = levels[: i + 1]
        own = F.array_contains(want, F.lower(F.col(levels[i])))
        if nodes is None:
            here = here.withColumn("children", F.lit(None)).withColumn("_below", F.lit(False)).drop("children")
            node = F.struct(F.col(levels[i]).alias("title"), F.col("n").alias("count"), own.alias("applied"))
        else:
            here = here.join(nodes, keys, "left")
            node = F.struct(F.col(levels[i]).alias("title"), F.col("n").alias("count"), (own | F.coalesce("_below", F.lit(False))).alias("applied"), F.col("children"))
        rows = here.select(*keys[:-1], node.alias("node"))
        if i == 0:
            return rows.select("node.*").orderBy("title")
        nodes = rows.groupBy(*keys[:-1]).agg(F.array_sort(F.collect_list("node")).alias("children"), F.bool_or("node.applied").alias("_below"))
    raise ValueError("a tree needs a level")


# ---------------------------------------------------------------- counts


def granule_counts(collections: DataFrame, granules: DataFrame, pred: Column | None = None) -> DataFrame:
    """Granules of each collection that meet ``pred``, 0 without any."""
    g = granules if pred is None else granules.where(pred)
    n = g.groupBy(F.col("collection_id").alias("concept_id")).agg(F.count("*").alias("granule_count"))
    return collections.join(n, "concept_id", "left").withColumn("granule_count", F.coalesce("granule_count", F.lit(0)))


def counts_by_provider(granules: DataFrame) -> DataFrame:
    return granules.groupBy("provider_id", "collection_id").agg(F.count("*").alias("n"))


def provider_holdings(collections: DataFrame, granules: DataFrame) -> DataFrame:
    """Collections with their numbers of granules, zero included."""
    return granule_counts(collections, granules)


def granule_bounds(granules: DataFrame) -> DataFrame:
    """First start and last end of each collection's granules; no end if any is open."""
    g = granules.groupBy("collection_id").agg(F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"), F.bool_or(F.col("end_date").isNull()).alias("open"))
    return g.select("collection_id", "start_date", F.when(~F.col("open"), F.col("end_date")).alias("end_date"))


def merge_bounds(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two bound sets merged so that ranges only widen, with ``changed``."""
    o = old.select("collection_id", F.col("start_date").alias("os"), F.col("end_date").alias("oe"), F.lit(True).alias("had"))
    n = new.select("collection_id", F.col("start_date").alias("ns"), F.col("end_date").alias("ne"), F.lit(True).alias("got"))
    both = o.join(n, "collection_id", "full")
    end = F.when(F.col("had").isNull(), F.col("ne")).when(F.col("got").isNull(), F.col("oe")).when(F.col("oe").isNotNull() & F.col("ne").isNotNull(), F.greatest("oe", "ne"))
    both = both.withColumns({"start_date": F.least("os", "ns"), "end_date": end})
    same = F.col("os").eqNullSafe(F.col("start_date")) & F.col("oe").eqNullSafe(F.col("end_date")) & F.col("had").isNotNull()
    return both.select("collection_id", "start_date", "end_date", (~same).alias("changed"))


def type_counts(df: DataFrame, parent: str = "collection_id") -> DataFrame:
    return df.groupBy(parent).agg(F.count("*").alias("n"))


def aggregate_usage(df: DataFrame) -> DataFrame:
    return df.groupBy("short_name", "version").agg(F.sum("access_count").alias("access_count"))


def partition_balance(granules: DataFrame, own_share: float = 0.01) -> DataFrame:
    """Rows of each collection, and whether it is large enough for a partition of its own."""
    n = granules.groupBy("collection_id").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("collection_id", "n", (F.col("n") >= F.col("total") * own_share).alias("own"))


def keyword_nodes(keywords: DataFrame, levels: list[str]) -> DataFrame:
    """(path, depth, value, children, leaves) of each node of a vocabulary: siblings merged, empty levels collapsed.

    A node is a row, so a wide level is many rows and no task holds the tree; ``children`` counts the
    nodes right below, ``leaves`` the different keywords at or below.
    """
    path = F.array_compact(F.array(*levels))
    flat = keywords.select(path.alias("p")).where(F.size("p") > 0).distinct()
    steps = flat.select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("depth"))
    here = F.slice("p", 1, F.col("depth"))
    nodes = steps.groupBy(here.alias("path"), "depth").agg(F.count("*").alias("leaves"))
    below = nodes.where("depth > 1").groupBy(F.slice("path", 1, F.col("depth") - 1).alias("_up")).agg(F.count("*").alias("children"))
    out = nodes.join(below, F.col("path") == F.col("_up"), "left")
    return out.select("path", "depth", F.element_at("path", -1).alias("value"), F.coalesce("children", F.lit(0)).alias("children"), "leaves")


def keyword_tree(keywords: DataFrame, levels: list[str]) -> DataFrame:
    """The tree of :func:`keyword_nodes` as one JSON text, sorted by value, for vocabularies that one answer can hold."""
    path = F.array_compact(F.array(*levels))
    flat = keywords.select(path.alias("p")).where(F.size("p") > 0).distinct()
    steps = flat.select(F.explode(F.sequence(F.lit(1), F.size("p"))).alias("depth"), "p").select(F.slice("p", 1, F.col("depth")).alias("p"), "depth").distinct()
    nodes = None
    for d in range(len(levels), 0, -1):
        here = steps.where(F.col("depth") == d).select(F.slice("p", 1, d - 1).alias("up"), "p", F.element_at("p", -1).alias("value"))
        if nodes is None:
            rows = here.select("up", F.struct(F.col("value"), F.to_json(F.array()).alias("below")).alias("node"))
        else:
            rows = here.join(nodes.withColumnRenamed("up", "_p"), F.col("p") == F.col("_p"), "left").select("up", F.struct(F.col("value"), F.coalesce("below", F.lit("[]")).alias("below")).alias("node"))
        nodes = rows.groupBy("up").agg(F.array_sort(F.collect_list("node")).alias("list")).select("up", F.concat(F.lit("["), F.array_join(F.transform("list", lambda n: F.concat(F.lit('{"value":'), F.to_json(F.array(n["value"])).substr(F.lit(2), F.length(F.to_json(F.array(n["value"]))) - 2), F.lit(',"below":'), n["below"], F.lit("}"))), ","), F.lit("]")).alias("below"))
    return nodes.where(F.size("up") == 0).select(F.col("below").alias("tree"))
