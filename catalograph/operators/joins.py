"""Joins between records, their parents, links, vocabularies and time ranges.

Side tables are joined by key and left to the optimizer, which broadcasts those that are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.numbers import FAR, range_cells
from .spatial import one_by_one, spread

#: The parent's key, and the child's column that holds it.
ID, PARENT = "concept_id", "collection_id"


def granules_of(granules: DataFrame, collections: DataFrame, pred: Column) -> DataFrame:
    """Granules whose collection meets ``pred``."""
    ids = collections.where(pred).select(F.col(ID).alias(PARENT))
    return granules.join(ids, PARENT, "left_semi")


def inherit_match(granules: DataFrame, collections: DataFrame, field: str, pred) -> DataFrame:
    """Granules whose own value, or where it is null their collection's, meets ``pred`` (of a column)."""
    up = collections.select(F.col(ID).alias(PARENT), F.col(field).alias("_up"))
    return granules.join(up, PARENT, "left").where(pred(F.coalesce(F.col(field), F.col("_up")))).drop("_up")


def by_concept_ids(granules: DataFrame, ids: list, collection_ids: list | None = None, key: str = "granule_id") -> DataFrame:
    """Granules by id, within collections given."""
    out = granules.where(F.col(key).isin(list(ids))) if ids else granules
    return out.where(F.col(PARENT).isin(list(collection_ids))) if collection_ids else out


def collections_with_granules(collections: DataFrame, granules: DataFrame, pred: Column) -> DataFrame:
    """Collections of which some granule meets ``pred``."""
    return collections.join(granules.where(pred).select(F.col(PARENT).alias(ID)), ID, "left_semi")


def has_granules(collections: DataFrame, granules: DataFrame, flag: bool = True) -> DataFrame:
    """Collections with any granule, or without."""
    ids = granules.select(F.col(PARENT).alias(ID))
    return collections.join(ids, ID, "left_semi" if flag else "left_anti")


def has_granules_or_consortium(collections: DataFrame, granules: DataFrame, names: list[str], flag: bool = True, field: str = "consortiums") -> DataFrame:
    """Collections with granules or in a named consortium; false asks for those without granules only."""
    if not flag:
        return has_granules(collections, granules, False)
    ids = granules.select(F.col(PARENT).alias(ID)).distinct().withColumn("_has", F.lit(True))
    member = F.coalesce(F.arrays_overlap(F.transform(field, F.lower), F.array(*[F.lit(n.lower()) for n in names])), F.lit(False)) if names else F.lit(False)
    return collections.join(ids, ID, "left").where(F.coalesce("_has", F.lit(False)) | member).drop("_has")


def related_items(outer: DataFrame, inner: DataFrame, outer_field: str, inner_field: str) -> DataFrame:
    """Outer rows whose field is among the inner query's."""
    return outer.join(inner.select(F.col(inner_field).alias(outer_field)), outer_field, "left_semi")


def intersect_ids(*frames: DataFrame, key: str = ID) -> DataFrame:
    """Ids in all frames."""
    out = frames[0].select(key).distinct()
    for f in frames[1:]:
        out = out.join(f.select(key), key, "left_semi")
    return out


def find_associations(links: DataFrame, concept_id: str) -> DataFrame:
    """Links that have the concept at either end."""
    ends = [c for c in ("source_id", "associated_id") if c in links.columns]
    cond = F.lit(False)
    for c in ends:
        cond = cond | (F.col(c) == concept_id)
    return links.where(cond)


def with_associations(df: DataFrame, links: DataFrame, targets: DataFrame, name: str, key: str = ID) -> DataFrame:
    """``df`` with an array of the latest live targets linked to each row."""
    live = links.where("not deleted").select(F.col("source_id").alias("_target"), F.col("associated_id").alias(key))
    fields = [c for c in targets.columns if c != key]
    t = targets.select(F.col(key).alias("_target"), *fields)
    grouped = live.join(t, "_target").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("_target").alias("id"), *fields))).alias(name))
    return df.join(grouped, key, "left")


def with_generic_associations(df: DataFrame, links: DataFrame, key: str = ID) -> DataFrame:
    """``df`` with a map from target type to linked ids, over links in both directions."""
    live = links.where("not deleted")
    both = live.select(F.col("source_id").alias(key), F.col("associated_id").alias("id"), F.col("associated_type").alias("kind")).unionByName(
        live.select(F.col("associated_id").alias(key), F.col("source_id").alias("id"), F.col("source_type").alias("kind"))
    )
    per = both.groupBy(key, "kind").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    grouped = per.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "ids")))).alias("associations"))
    return df.join(grouped, key, "left")


def lookup_keywords(df: DataFrame, keywords: DataFrame, on: dict[str, str]) -> DataFrame:
    """Vocabulary columns joined without case on ``on`` (column of df: column of the vocabulary)."""
    k = keywords
    for i, c in enumerate(on.values()):
        k = k.withColumn(f"_k{i}", F.lower(F.col(c)))
    k = k.dropDuplicates([f"_k{i}" for i in range(len(on))])
    cond = [F.lower(df[c]).eqNullSafe(k[f"_k{i}"]) for i, c in enumerate(on)]
    clash = [c for c in keywords.columns if c in df.columns]
    return df.join(k.drop(*clash), cond, "left").drop(*[f"_k{i}" for i in range(len(on))])


def lookup_location(df: DataFrame, keywords: DataFrame, levels: list[str], field: str = "location", overrides: dict[str, dict] | None = None) -> DataFrame:
    """The shallowest vocabulary row that has the location at any level; overrides come first."""
    entries = F.array(*[F.struct(F.lit(i).alias("depth"), F.lower(c).alias("name")) for i, c in enumerate(levels)])
    filled = sum([F.col(c).isNotNull().cast("int") for c in levels], F.lit(0))
    k = keywords.select("uuid", *levels, F.explode(entries).alias("e"), filled.alias("_n")).where("e.name is not null")
    for name, fixed in (overrides or {}).items():
        same = F.lit(True)
        for c, v in fixed.items():
            same = same & (F.lower(c) == v.lower())
        k = k.where((F.col("e.name") != name.lower()) | same)
    w = W.partitionBy("e.name").orderBy("e.depth", "_n", *levels, "uuid")
    k = k.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").select(F.col("e.name").alias("_name"), "uuid", *levels)
    return df.join(k, F.lower(field) == F.col("_name"), "left").drop("_name")


def usage_score(collections: DataFrame, metrics: DataFrame) -> DataFrame:
    """Sum of access counts with the same short name and the same version, ``N/A`` or none.

    Two equi-joins instead of one with OR: exact versions, and the unversioned rows.
    """
    m = metrics.withColumn("version", F.nullif("version", F.lit("N/A")))
    exact = m.where("version is not null").groupBy("short_name", "version").agg(F.sum("access_count").alias("_e"))
    loose = m.where("version is null").groupBy("short_name").agg(F.sum("access_count").alias("_l"))
    c = collections.withColumn("_v", F.col("version").cast("string"))
    out = c.join(exact.withColumnRenamed("version", "_v"), ["short_name", "_v"], "left").join(loose, "short_name", "left")
    return out.withColumn("usage", F.coalesce("_e", F.lit(0)) + F.coalesce("_l", F.lit(0))).select(*collections.columns, "usage")


def with_orbit(granules: DataFrame, collections: DataFrame) -> DataFrame:
    """Granules with their collection's orbit parameters."""
    return granules.join(collections.select(F.col(ID).alias(PARENT), F.col("orbit").alias("orbit_parameters")), PARENT, "left")


#: Days of the time line's dyadic tree, from the year 1: two bits a level, 4 million days.
DEPTH = 11
_FIRST_DAY = -719_162


def _day(c: str) -> Column:
    """Place on the tree's last level of a time: its day, held to the tree's ends."""
    day = F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")) - _FIRST_DAY
    return F.greatest(F.lit(0), F.least(day, F.lit(4**DEPTH - 1)))


def _above(day: Column, least: int | Column = 0) -> Column:
    """(level, node) of a day's nodes from a level down to the last, where a node is a day."""
    return F.transform(F.sequence(F.lit(least) if isinstance(least, int) else least, F.lit(DEPTH)), lambda k: _node(k, F.floor(day / F.pow(F.lit(4.0), DEPTH - k)).cast("long")))


def _node(level: Column, node: Column) -> Column:
    """A node as one number."""
    return (level.cast("long") * 4**DEPTH) + node


def _since(day: Column) -> Column:
    """The nodes that make up all days from a day on: at most three on each level, and the day itself."""
    def right(k: Column) -> Column:
        own = F.floor(day / F.pow(F.lit(4.0), DEPTH - k)).cast("long")
        last = F.pmod(own, F.lit(4))
        return F.transform(F.filter(F.array(*[F.lit(x) for x in (1, 2, 3)]), lambda x: x > last), lambda x: _node(k, own - last + x))

    return F.concat(F.array(_node(F.lit(DEPTH), day.cast("long"))), F.flatten(F.transform(F.sequence(F.lit(1), F.lit(DEPTH)), right)))


def _fitted(df: DataFrame, s: str, e: str, tag: str) -> DataFrame:
    """A row for each node of a closed range: the one or two of the deepest level that it fits in, and all above those."""
    a, b = F.col(f"_{tag}a"), F.col(f"_{tag}b")
    d = df.withColumns({f"_{tag}a": _day(s), f"_{tag}b": _day(e)})
    deep = F.lit(0)
    for k in range(1, DEPTH + 1):
        deep = F.when(b - a < 4 ** (DEPTH - k), k).otherwise(deep)
    d = d.withColumn(f"_{tag}deep", deep)
    d = d.withColumn(f"_{tag}level", F.explode(F.sequence(F.lit(0), F.col(f"_{tag}deep"))))
    width = F.pow(F.lit(4.0), DEPTH - F.col(f"_{tag}level"))
    d = d.withColumn(f"_{tag}node", F.explode(F.sequence(F.floor(a / width).cast("long"), F.floor(b / width).cast("long"))))
    return d.withColumn(f"_{tag}own", F.col(f"_{tag}level") == F.col(f"_{tag}deep")).withColumn("_key", _node(F.col(f"_{tag}level"), F.col(f"_{tag}node")))


#: Rows of a side that a task holds against the other side's, and rows that a packed row has.
SIDE, HEAP = 4096, 64


def by_values(df: DataFrame, n: Column, columns: list[str] | None = None) -> Column:
    """A number under ``n`` for each row of ``df``, the same for equal rows; maps have no hash and don't count."""
    return F.pmod(F.xxhash64(*[c for c, kind in df.dtypes if c in (columns or df.columns) and "map<" not in kind]), n)


def up_to(n: Column) -> Column:
    """A row for each number under ``n``."""
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def packed(df: DataFrame, by: list[str], name: str, most: int = HEAP) -> DataFrame:
    """Rows that are equal in ``by`` as one row, with their other columns as an array of structs ``name``.

    An array has about ``most`` rows; many rows give several arrays, to which they are dealt by their
    values, so only equal rows must stay together. Nulls in ``by`` are equal.
    """
    own = [c for c in df.columns if c not in by]
    many = df.groupBy(*by).agg(F.ceil(F.count("*") / most).alias("_heaps")).select("_heaps", *[F.col(c).alias(f"_of_{k}") for k, c in enumerate(by)])
    same = F.lit(True)
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{k}"))
    d = df.join(many.hint("merge"), same).withColumn("_heap", by_values(df, F.col("_heaps"), own) if own else F.lit(0))
    return d.groupBy(*by, "_heap").agg(F.collect_list(F.struct(*own, *([] if own else [F.lit(0).alias("_none")]))).alias(name)).drop("_heap")


def blocked(left: DataFrame, right: DataFrame, keys: list[str], left_rows: Column | None = None, right_rows: Column | None = None) -> DataFrame:
    """Inner join on ``keys``, cut into blocks of about ``SIDE`` rows of either side.

    A key's pairs grow with the product of its rows, so they are cut by both sides' rows: each left
    block meets each right block in a group of its own. A task holds one block of the right side at
    a time, no key is one task, and tasks aren't put together for having few bytes. Rows whose key the other side doesn't have are dropped first.
    ``left_rows``, ``right_rows``: how many rows one row stands for.
    """
    one = F.lit(1)
    n = left.groupBy(*keys).agg(F.ceil(F.sum(one if left_rows is None else left_rows) / SIDE).alias("_lcut"))
    n = n.join(right.groupBy(*keys).agg(F.ceil(F.sum(one if right_rows is None else right_rows) / SIDE).alias("_rcut")).hint("merge"), keys)
    cut = [*keys, "_lblock", "_rblock"]
    a = left.join(n.hint("merge"), keys).withColumns({"_lblock": by_values(left, F.col("_lcut")), "_rblock": up_to(F.col("_rcut"))}).drop("_lcut", "_rcut")
    b = right.join(n.hint("merge"), keys).withColumns({"_rblock": by_values(right, F.col("_rcut")), "_lblock": up_to(F.col("_lcut"))}).drop("_lcut", "_rcut")
    return spread(a, *cut).join(spread(b, *cut).hint("merge"), cut).drop("_lblock", "_rblock")


def temporal_join(left: DataFrame, right: DataFrame, left_cols=("start_date", "end_date"), right_cols=("from_date", "to_date"), inclusive: bool = True, by: tuple[str, str] | None = None, hint: str | None = "merge") -> DataFrame:
    """Pairs of rows whose times overlap; a null end is open. Equal rows pair each for itself.

    ``by``: a column of each side, of different names, that must be equal too. ``hint``: how to join;
    ``broadcast`` is for a right side that stays small whatever the input, None leaves it to the optimizer.
    By default nothing is broadcast, as the optimizer doesn't see that rows are dealt to a dozen nodes and more;
    equal ranges of a side meet the other's once, their rows :func:`packed`, and tasks are cut by the
    pairs of a node (:func:`blocked`).

    Closed ranges go to the nodes of a dyadic tree of days that they fit in (two at most) and to the
    nodes above: a dozen levels, whatever their lengths. Two ranges meet at the longer one's level,
    where one side's own nodes are the other side's own or above, and count in the node of the later
    start, so no pair comes twice. An open range is all days from its start on: at most three nodes on
    each level, and the other side's end lies below exactly one of them. Both are equi-joins, nothing
    depends on the latest time there is, and no side is looked at while the plan is built. Rows
    without a start, or that end before it, overlap with nothing. The names of the four times differ.
    """
    (ls, le), (rs, re) = left_cols, right_cols
    names = [*left.columns, *right.columns]
    whole = hint == "merge"
    if whole:
        left = packed(left, [ls, le, *([by[0]] if by else [])], "_lrows")
        right = packed(right, [rs, re, *([by[1]] if by else [])], "_rrows")
    sides = {"l": (left, ls, le), "r": (right, rs, re)}
    closed = {t: df.where(F.col(s).isNotNull() & (F.col(e) >= F.col(s))) for t, (df, s, e) in sides.items()}
    opened = {t: df.where(F.col(s).isNotNull() & F.col(e).isNull()) for t, (df, s, e) in sides.items()}
    met_names = [*left.columns, *right.columns]

    a, b = _fitted(closed["l"], ls, le, "l"), _fitted(closed["r"], rs, re, "r")
    # space 0: left's own nodes with right's own and those above; space 1: nodes above left's with right's own
    a = a.withColumn("_key", F.col("_key") * 2 + F.when(F.col("_lown"), 0).otherwise(1))
    b = b.withColumn("_key", F.explode(F.when(F.col("_rown"), F.array(F.col("_key") * 2, F.col("_key") * 2 + 1)).otherwise(F.array(F.col("_key") * 2))))
    home = F.floor(F.greatest("_la", "_ra") / F.pow(F.lit(4.0), DEPTH - F.col("_llevel"))) == F.col("_lnode")
    meet = (F.col(ls) <= F.col(re)) & (F.col(rs) <= F.col(le)) if inclusive else (F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le))
    same = F.lit(True) if by is None else F.col(by[0]) == F.col(by[1])

    def joined(x: DataFrame, y: DataFrame) -> DataFrame:
        """Left rows and right rows with equal ``_key``."""
        if whole:
            return blocked(x, y, ["_key"], F.size("_lrows"), F.size("_rrows")).where(same)
        y = y.withColumnRenamed("_key", "_rkey")
        return x.join(y.hint(hint) if hint else y, (F.col("_key") == F.col("_rkey")) & same)

    out = joined(a, b).where(meet & home).select(*met_names)

    def later(t: str, u: str, other: DataFrame) -> DataFrame:
        """Open rows of side t with rows of ``other``, of side u, that end at or after their start."""
        (_, s, _), (_, _, e) = sides[t], sides[u]
        own = opened[t].withColumn("_key", F.explode(_since(_day(s))))
        end = F.coalesce(_day(e), F.lit(4**DEPTH - 1))
        other = other.withColumn("_key", F.explode(_above(end, 1)))
        met = joined(own, other) if t == "l" else joined(other, own)
        after = F.col(e) >= F.col(s) if inclusive else F.col(e) > F.col(s)
        return met.where(F.col(e).isNull() | after).select(*met_names)

    right_all = closed["r"].unionByName(opened["r"])
    out = out.unionByName(later("l", "r", right_all)).unionByName(later("r", "l", closed["l"]))
    if whole:
        out = out.select("*", F.explode("_lrows").alias("_l")).drop("_lrows")
        out = out.select("*", F.explode("_rrows").alias("_r")).drop("_rrows").select("*", "_l.*", "_r.*")
    return out.select(*names)


def _until(times: DataFrame, asked: DataFrame, before: bool = False) -> DataFrame:
    """(t, n): how many of ``times`` lie at or before each time asked for, or only before it; both have a column t.

    Equal times are one row with their number, added up within each day and over the days before; only
    days, of which a calendar has few, are added up in one task.
    """
    marks = times.groupBy("t").agg(F.count("*").alias("n")).withColumn("_place", F.lit(0))
    places = marks.unionByName(asked.select("t").distinct().withColumns({"n": F.lit(0).cast("long"), "_place": F.lit(-1 if before else 1)}))
    places = places.where("t is not null").withColumn("_on", F.col("t").cast("date"))
    days = places.groupBy("_on").agg(F.sum("n").alias("_sum"))
    days = days.select("_on", (F.sum("_sum").over(W.orderBy("_on")) - F.col("_sum")).alias("_earlier"))
    same_day = F.sum("n").over(W.partitionBy("_on").orderBy("t", "_place").rowsBetween(W.unboundedPreceding, 0))
    return places.withColumn("_here", same_day).where("_place <> 0").join(days, "_on").select("t", (F.col("_here") + F.col("_earlier")).alias("n"))


def overlap_counts(left: DataFrame, right: DataFrame, left_cols=("start_date", "end_date"), right_cols=("from_date", "to_date"), name: str = "n") -> DataFrame:
    """``right`` with the number of left rows that :func:`temporal_join` pairs with each, 0 for none; both ends included.

    Pairs aren't formed: a range overlaps all that start by its end, but those that end before its start.
    """
    (ls, le), (rs, re) = left_cols, right_cols
    l = left.where(F.col(ls).isNotNull() & (F.col(le).isNull() | (F.col(le) >= F.col(ls))))
    started = _until(l.select(F.col(ls).alias("t")), right.select(F.col(re).alias("t"))).select(F.col("t").alias("_t1"), F.col("n").alias("_started"))
    ended = _until(l.where(F.col(le).isNotNull()).select(F.col(le).alias("t")), right.select(F.col(rs).alias("t")), before=True).select(F.col("t").alias("_t2"), F.col("n").alias("_ended"))
    every = l.agg(F.count("*").alias("_every"))
    out = right.join(started, F.col(re) == F.col("_t1"), "left").join(ended, F.col(rs) == F.col("_t2"), "left").crossJoin(F.broadcast(every))
    valid = F.col(rs).isNotNull() & (F.col(re).isNull() | (F.col(re) >= F.col(rs)))
    n = F.when(F.col(re).isNull(), F.col("_every")).otherwise(F.col("_started")) - F.col("_ended")
    return out.select(*right.columns, F.when(valid, n).otherwise(F.lit(0)).cast("long").alias(name))


def to_virtual(granules: DataFrame, config: DataFrame) -> DataFrame:
    """Derived records of source granules by a config of (provider_id, source_short_name, virtual_short_name, match_field, match_value, ur_from, ur_to)."""
    c = config.select("provider_id", F.col("source_short_name").alias("short_name"), "virtual_short_name", "match_field", "match_value", "ur_from", "ur_to")
    g = granules.join(c, ["provider_id", "short_name"])
    matched = F.col("match_field").isNull() | (F.col("attributes")[F.col("match_field")] == F.col("match_value"))
    return g.where(F.coalesce(matched, F.lit(False))).withColumn("virtual_ur", F.regexp_replace("granule_ur", F.col("ur_from"), F.col("ur_to")))


def to_source(virtual: DataFrame, config: DataFrame) -> DataFrame:
    """Source names of derived records, by the same config with the name change reversed."""
    c = config.select("provider_id", "source_short_name", F.col("virtual_short_name").alias("short_name"), "ur_from", "ur_to")
    v = virtual.join(c, ["provider_id", "short_name"], "left")
    return v.withColumn("source_ur", F.replace("granule_ur", F.col("ur_to"), F.col("ur_from"))).drop("ur_from", "ur_to")


ATOM = "struct<field:string,value:string,low:double,high:double>"
KEY = "struct<field:string,level:int,value:string,cell:bigint>"
#: Levels of keys: values, what meets every change, and the cell that wide ranges share.
VALUE, ALWAYS, WIDE = -100, -101, 99
#: Subscriptions of a collection for each part that its changes are split into, the most parts that these ask for, and the changes for each part.
CROWD, PARTS, BATCH = 500, 32, 16_384
#: Equal subscriptions that one row of the index has.
ALIKE = 128


def match_subscriptions(changes: DataFrame, subs: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Changes x subscriptions of their collection, revised after the last run, that meet all its atoms.

    A subscription's query is data: ``atoms``, an array of (field, value, low, high). With a value the
    change's field must equal it, or hold it if the field is an array, without case; without one the
    field's number must lie in the range, a null bound being open. No atoms match every change.
    ``fields``: columns that atoms may name, by default all strings, numbers and arrays of strings; a
    field that isn't there meets nothing.

    Each subscription is indexed under one atom: of its values the one that the fewest subscriptions
    of the collection ask for, else its narrowest range. Changes are dealt to the values and cells of the
    fields that their collection's subscriptions are indexed under, and to no others; they find them by one
    equi-join, and only what they find so is held against the other atoms. So subscriptions that a change
    can't meet cost nothing, and a pair comes once. Subscriptions of a collection that ask for the same
    since the same time are one row of the index, :func:`packed`, held against a change once; its atoms are
    one comparison for each field. The changes of a collection with many subscriptions or changes are split over parts,
    each with all of its index, so that no collection is one task. Nothing is broadcast.
    """
    kinds = dict(changes.dtypes)
    names = [c for c in (fields or changes.columns) if c != "collection_id"]
    texts = [c for c in names if kinds[c] in ("string", "array<string>")]
    numbers = [c for c in names if kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[c].startswith("decimal")]

    def lower(c: str) -> Column:
        own = F.array(c) if kinds[c] == "string" else F.coalesce(F.col(c), F.array().cast("array<string>"))
        return F.array_distinct(F.transform(F.array_compact(own), F.lower))

    def mapped(some: list[str], value, kind: str) -> Column:
        return F.create_map(*[x for c in some for x in (F.lit(c), value(c))]) if some else F.create_map().cast(f"map<string,{kind}>")

    c = changes.withColumns({"_texts": mapped(texts, lower, "array<string>"), "_numbers": mapped(numbers, lambda x: F.col(x).cast("double"), "double")})
    atoms = F.transform(F.coalesce(F.col("atoms"), F.array().cast(f"array<{ATOM}>")), lambda a: a.withField("value", F.lower(a["value"])))
    s = subs.select(F.col("concept_id").alias("subscription_id"), "subscriber_id", "collection_id", "last_notified_at", atoms.alias("_atoms"))
    known = lambda a: F.when(a["value"].isNotNull(), a["field"].isin(texts)).otherwise(a["field"].isin(numbers))
    s = s.where(F.forall("_atoms", lambda a: F.coalesce(known(a), F.lit(False))))  # others meet nothing
    own = ["collection_id", "last_notified_at", "_atoms", "_subs"]
    s = packed(s, own[:3], "_subs", ALIKE)

    value = F.struct(F.col("a.field").alias("field"), F.col("a.value").alias("value"))
    valued = s.select(*own, F.explode("_atoms").alias("a")).where("a.value is not null").withColumn("_value", value)
    asked = valued.groupBy(F.col("collection_id").alias("_c"), F.col("_value").alias("_v")).agg(F.sum(F.size("_subs")).alias("_n"))
    rare = valued.join(asked, (F.col("collection_id") == F.col("_c")) & (F.col("_value") == F.col("_v"))).groupBy(*own).agg(F.min_by("_value", F.struct("_n", "_value")).alias("_value"))
    rest = s.where(~F.exists("_atoms", lambda a: a["value"].isNotNull()))
    width = F.transform("_atoms", lambda a: F.struct(F.coalesce(a["high"] - a["low"], F.lit(float("inf"))).alias("width"), a["field"].alias("field"), a["low"].alias("low"), a["high"].alias("high")))
    ranged = rest.where(F.size("_atoms") > 0).withColumn("_range", F.array_min(width))
    free = rest.where(F.size("_atoms") == 0)

    def key(field: Column, level: Column, value: Column, cell: Column) -> Column:
        return F.struct(field.alias("field"), level.cast("int").alias("level"), value.alias("value"), cell.cast("long").alias("cell"))

    none, zero = F.lit(""), F.lit(0)
    index = rare.select(*own, key(F.col("_value.field"), F.lit(VALUE), F.col("_value.value"), zero).alias("_key"))
    cells = ranged.select(*own, "_range", F.explode(range_cells(F.col("_range.low"), F.col("_range.high"))).alias("_cell"))
    index = index.unionByName(cells.select(*own, key(F.col("_range.field"), F.col("_cell.level"), none, F.col("_cell.cell")).alias("_key")))
    index = index.unionByName(free.select(*own, key(none, F.lit(ALWAYS), none, zero).alias("_key")))

    # what a collection's subscriptions are indexed under: its changes are dealt to these keys only
    asks = index.groupBy("collection_id").agg(F.collect_set(F.struct("_key.field", "_key.level")).alias("_asked"), F.sum(F.size("_subs")).alias("_n"))
    asks = asks.join(changes.groupBy("collection_id").agg(F.count("*").alias("_changes")).hint("merge"), "collection_id")
    parts = F.greatest(F.least(F.lit(PARTS), 1 + F.floor(F.col("_n") / CROWD)), F.ceil(F.col("_changes") / BATCH)).cast("int")
    asks = asks.withColumn("_parts", parts).hint("merge")

    def keys(ask: Column) -> Column:
        x, f, level = F.col("_numbers")[ask["field"]], ask["field"], ask["level"]
        held = F.transform(F.col("_texts")[f], lambda v: key(f, level, v, zero))
        cell = F.when(level == WIDE, zero.cast("long")).when(F.abs(x) <= FAR, F.floor(x / F.pow(F.lit(4.0), level)).cast("long"))
        number = F.when(x.isNotNull() & cell.isNotNull(), F.array(key(f, level, none, cell)))
        return F.coalesce(F.when(level == ALWAYS, F.array(key(none, level, none, zero))).when(level == VALUE, held).otherwise(number), F.array().cast(f"array<{KEY}>"))

    plain = [x for x in changes.columns if kinds[x].split("(")[0] in ("string", "tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "date", "timestamp", "timestamp_ntz", "boolean")]
    dealt = c.join(asks.select("collection_id", "_asked", "_parts"), "collection_id").withColumn("_part", F.pmod(F.xxhash64(*plain), F.col("_parts")).cast("int"))
    dealt = dealt.withColumn("_key", F.explode(F.flatten(F.transform("_asked", keys)))).withColumns({f"_is_{f}": F.col("_texts")[f] if kinds[f] != "string" else F.lower(f) for f in texts})
    dealt = dealt.drop("_asked", "_parts", "_texts", "_numbers")
    copied = index.join(asks.select("collection_id", "_parts"), "collection_id").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")

    # an index row's atoms of each field as what the field must lie in, be, or hold
    tests, recent = {}, F.col("last_notified_at").isNull() | (F.col("revision_date") > F.col("last_notified_at"))
    for f in texts:
        need = F.transform(F.filter("_atoms", lambda a: a["value"].isNotNull() & (a["field"] == f)), lambda a: a["value"])  # noqa: B023
        x = F.col(f"_is_{f}")
        if kinds[f] == "string":
            tests |= {f"_least_{f}": F.array_min(need), f"_most_{f}": F.array_max(need)}
            recent = recent & (F.col(f"_least_{f}").isNull() | F.coalesce((x == F.col(f"_least_{f}")) & (x == F.col(f"_most_{f}")), F.lit(False)))
        else:
            tests |= {f"_need_{f}": need}
            recent = recent & F.forall(f"_need_{f}", lambda v: F.array_contains(x, v))  # noqa: B023
    for f in numbers:
        on = F.filter("_atoms", lambda a: a["value"].isNull() & (a["field"] == f))  # noqa: B023
        tests |= {f"_on_{f}": F.size(on) > 0, f"_low_{f}": F.array_max(F.transform(on, lambda a: a["low"])), f"_high_{f}": F.array_min(F.transform(on, lambda a: a["high"]))}
        x, low, high = F.col(f).cast("double"), F.col(f"_low_{f}"), F.col(f"_high_{f}")
        recent = recent & (~F.col(f"_on_{f}") | (x.isNotNull() & (low.isNull() | (x >= low)) & (high.isNull() | (x <= high))))

    by = ["collection_id", "_key", "_part"]
    found = spread(copied.withColumns(tests), *by).join(spread(dealt, *by).hint("merge"), by).where(recent)
    found = one_by_one(found.select(*changes.columns, "_subs", F.col("_atoms").alias("atoms"), "last_notified_at"))
    found = found.select(*changes.columns, F.explode("_subs").alias("_s"), "atoms", "last_notified_at")
    return found.select(*changes.columns, "_s.subscription_id", "_s.subscriber_id", "atoms", "last_notified_at")
