"""Spatial predicates on shape columns, the grid-bucketed spatial join, tiles, and area clean-up.

A shape is a struct {kind, coord_sys, rings: array<array<struct<lon, lat>>>}. Points and boxes are
plain columns (``functions.boxes``); lines and polygons go through Arrow UDFs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import boxes as bx
from ..functions import relations as rl
from ..functions import shapes as sh

POINT = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
SHAPE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("coord_sys", T.StringType()), T.StructField("rings", T.ArrayType(T.ArrayType(POINT)))])
BOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("west", "north", "east", "south")])


def _decoded(a: pa.StructArray) -> list[tuple[str, str, list[np.ndarray]] | None]:
    """(kind, coord_sys, rings) of a shape column, rings as arrays of degrees; None for null."""
    kind, system = a.field("kind").to_pylist(), a.field("coord_sys").to_pylist()
    outer = a.field("rings")
    ring, point = outer.offsets.to_numpy(), outer.values.offsets.to_numpy()
    flat = outer.values.values
    xy = np.column_stack([flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("lon", "lat")])
    ok = a.is_valid().to_numpy(zero_copy_only=False)
    return [(kind[i], system[i], [xy[point[k] : point[k + 1]] for k in range(ring[i], ring[i + 1])]) if ok[i] and kind[i] is not None else None for i in range(len(a))]


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over all cores before geometry, by columns if some are given: a small file of shapes is one task else."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def one_by_one(df: DataFrame) -> DataFrame:
    """A join's rows, taken as they come by what explodes them.

    Compiled into one step, a join holds all that its matches explode to before it gives out a row; a
    coalesce, here to more tasks than there are, parts the two and moves nothing.
    """
    return df.coalesce(1_000_000)


class _Kept(dict):
    """What a worker has found out, for shapes that come again. It forgets all when it is full."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def of(self, key, work):
        if key not in self:
            found = work()
            if len(self) >= self.most:
                self.clear()
            self[key] = found
        return self[key]


#: Figures of shapes, and results of functions of one shape or two; equal shapes have equal keys.
_FIGURES, _RESULTS = _Kept(4096), _Kept(50_000)


def _key(x: tuple[str, str, list[np.ndarray]] | None) -> bytes | None:
    """128 bits of a decoded shape, the same for equal ones; None for null."""
    if x is None:
        return None
    h = hashlib.blake2b(repr((x[0], x[1], [len(r) for r in x[2]])).encode(), digest_size=16)
    for r in x[2]:
        h.update(np.ascontiguousarray(r))
    return h.digest()


def _figure(key: bytes, x: tuple[str, str, list[np.ndarray]]) -> rl.Figure:
    # a copy of the rings, as a view would keep the whole batch
    return _FIGURES.of(key, lambda: rl.Figure(x[0], x[1], [r.copy() for r in x[2]]))


def _shapes(a: pa.StructArray) -> list[tuple[bytes | None, tuple | None]]:
    """(key, decoded shape) of a column; a column of one shape is worked out once."""
    if len(a) > 1 and a.null_count == 0 and _alike(a):
        return [(_key(x), x) for x in _decoded(a[:1])] * len(a)
    return [(_key(x), x) for x in _decoded(a)]


def _alike(a: pa.StructArray) -> bool:
    """Whether a batch has one shape only, as of a literal."""
    return a[:1].equals(a[-1:]) and a[:-1].equals(a[1:])


def _each(name: str, work, a: pa.StructArray) -> list:
    """``work`` of each decoded shape, once for equal ones; None for null."""
    return [None if x is None else _RESULTS.of((name, k), lambda: work(x)) for k, x in _shapes(a)]


def _related(test, a: pa.StructArray, b: pa.StructArray) -> pa.Array:
    """``test`` of each pair of shapes, once for equal pairs; None if either is null."""
    out = []
    for (k, x), (m, y) in zip(_shapes(a), _shapes(b)):
        out.append(None if x is None or y is None else _RESULTS.of((test.__name__, k, m), lambda: test(_figure(k, x), _figure(m, y))))
    return pa.array(out, pa.bool_())


@F.arrow_udf(T.BooleanType())
def shape_intersects(a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether two shape columns, of any kinds and systems, share a point; null if either is missing."""
    return _related(rl.intersects, a, b)


@F.arrow_udf(T.BooleanType())
def shape_covers(a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether the first shape column covers the second, of any kinds and systems."""
    return _related(rl.covers, a, b)


@F.arrow_udf(T.BooleanType())
def shape_covers_point(a: pa.Array, lon: pa.Array, lat: pa.Array) -> pa.Array:
    """Whether a shape column covers a point; all points of a batch that meet one shape are tested together."""
    x, y = (c.to_numpy(zero_copy_only=False).astype(float) for c in (lon, lat))
    points = np.column_stack([x, y])
    rows: dict[bytes, tuple[rl.Figure, list[int]]] = {}
    finite = np.isfinite(points).all(1)
    for i, (k, s) in enumerate(_shapes(a)):
        if s is not None and finite[i]:
            if k not in rows:
                rows[k] = _figure(k, s), []
            rows[k][1].append(i)
    out = np.full(len(points), None, object)
    for f, at in rows.values():
        out[at] = f.covers_points(points[at])
    return pa.array(out, pa.bool_())


@F.arrow_udf(BOX)
def shape_box(a: pa.Array) -> pa.Array:
    """The box around a shape column."""
    rows = [r or (None,) * 4 for r in _each("box", lambda x: sh.shape_box(x[2], x[1]), a)]
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.float64()) for k in range(4)], names=["west", "north", "east", "south"])


@F.arrow_udf(T.ArrayType(T.StringType()))
def shape_errors(a: pa.Array) -> pa.Array:
    return pa.array([r or [] for r in _each("errors", lambda x: sh.shape_errors(x[0], x[1], x[2]), a)], pa.list_(pa.string()))


def polygon(points: list[tuple[float, float]], coord_sys: str = "geodetic", holes=()) -> Column:
    """A literal polygon shape."""
    ring = lambda r: F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in r])
    return F.struct(F.lit("polygon").alias("kind"), F.lit(coord_sys).alias("coord_sys"), F.array(ring(points), *[ring(h) for h in holes]).alias("rings"))


def point_shape(lon: Column, lat: Column, coord_sys: str = "geodetic") -> Column:
    return F.struct(F.lit("point").alias("kind"), F.lit(coord_sys).alias("coord_sys"), F.array(F.array(F.struct(lon.alias("lon"), lat.alias("lat")))).alias("rings"))


def box_shape(b: Column) -> Column:
    """A box column as a shape; one that crosses the antimeridian goes beyond 180."""
    e = F.when(bx.crosses(b), b["east"] + 360).otherwise(b["east"])
    p = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    ring = F.array(p(b["west"], b["south"]), p(e, b["south"]), p(e, b["north"]), p(b["west"], b["north"]), p(b["west"], b["south"]))
    return F.struct(F.lit("box").alias("kind"), F.lit("cartesian").alias("coord_sys"), F.array(ring).alias("rings"))


def shapes_doc(df: DataFrame, boxes: str = "boxes") -> DataFrame:
    """A record's boxes merged into one, in their order."""
    first = F.get(boxes, F.lit(0))
    return df.withColumn("box", F.aggregate(F.slice(boxes, 2, F.greatest(F.size(boxes) - 1, F.lit(0))), first, bx.box_union))


#: Levels of the quadtree that boxes are dealt to: cells are 360 by 180 degrees over two to the power of the level.
LEVELS = (0, 2, 4, 6, 8, 10)  # eleven bits for a cell's number


def _dealt(df: DataFrame, box: str, tag: str) -> DataFrame:
    """A row for each cell of each part of a box, with its bounds as doubles (``_w0`` to ``_n`` after ``tag``).

    Cells (``_level``, ``_x``, ``_y``) are those of the deepest level that the part fits in, marked
    ``_own``, and their ancestors. A box across the antimeridian has two parts, and a pole that a box
    touches is one more with a cell of its own.
    """
    b, c = F.col(box), lambda name: F.col(f"_{tag}{name}")
    cross = bx.crosses(b)
    bounds = {
        "w0": b["west"] + 0.0, "e0": F.when(cross, F.lit(180.0)).otherwise(b["east"]),
        "w1": F.when(cross, F.lit(-180.0)), "e1": F.when(cross, b["east"] + 0.0), "s": b["south"] + 0.0, "n": b["north"] + 0.0,
    }
    d = df.where(b["west"].isNotNull() & b["east"].isNotNull() & b["south"].isNotNull() & b["north"].isNotNull()).withColumns({f"_{tag}{k}": v for k, v in bounds.items()})
    # parts 0 and 1 of a box, and those of the north and the south pole
    d = d.withColumn(f"_{tag}part", F.explode(F.array(*[F.lit(k) for k in range(4)])))
    d = d.where((c("part") == 0) | ((c("part") == 1) & c("w1").isNotNull()) | ((c("part") == 2) & (c("n") == 90)) | ((c("part") == 3) & (c("s") == -90)))
    west, east = F.when(c("part") == 1, c("w1")).otherwise(c("w0")), F.when(c("part") == 1, c("e1")).otherwise(c("e0"))
    size = F.greatest((east - west) / 360, (c("n") - c("s")) / 180)
    deepest = F.lit(0)
    for level in LEVELS[1:]:
        deepest = F.when(size <= 1 / (1 << level), level).otherwise(deepest)
    d = d.withColumn(f"_{tag}deep", F.when(c("part") > 1, 0).otherwise(deepest)).withColumn(f"_{tag}level", F.explode(F.sequence(F.lit(0), c("deep"), F.lit(LEVELS[1]))))
    d = d.withColumns({f"_{tag}own": c("level") == c("deep"), f"_{tag}scale": F.expr(f"shiftleft(1, _{tag}level)").cast("double")})
    polar = c("part") > 1
    span = lambda low, high, at, wide: F.sequence(F.when(polar, 0).otherwise(_cell(low, at, wide, c("scale"))), F.when(polar, 0).otherwise(_cell(high, at, wide, c("scale"))))
    return d.withColumn(f"_{tag}x", F.explode(span(west, east, -180, 360))).withColumn(f"_{tag}y", F.explode(span(c("s"), c("n"), -90, 180))).drop(f"_{tag}deep")


def _cell(c: Column, low: int, wide: int, scale: Column) -> Column:
    """Number of the cell that a degree lies in, of ``scale`` cells in all."""
    return F.least(F.floor((c - low) / wide * scale), scale - 1).cast("int")


#: Most different boxes of a right side that are broadcast; rows with one box that are given out side by side; deals of what meets them.
FEW, HEAP, DEALS = 10_000, 64, 64


def spatial_join(left: DataFrame, right: DataFrame, left_box: str = "box", right_box: str = "area_box", exact=None) -> DataFrame:
    """Pairs of rows whose boxes intersect and, if given, that meet ``exact``, a boolean column.

    Each different box of the right side is looked at once: left rows meet boxes first, and what meets
    is joined with the box's rows then.

    Boxes are dealt to the quadtree's cells of the level that they fit in (four cells at most for
    each part) and to the ancestors of those, six levels in all, so a box of any size takes a few
    dozen rows and small boxes share a cell with few others. They meet by an equi-join on the cell at
    the coarser one's level. A pair counts in the cell of the lower left corner of the first parts
    that overlap (or, if they only touch a pole together, in the pole's), so it comes once, without a
    distinct. Four comparisons of doubles come first. Boxes counted and found few are broadcast, so
    that left rows aren't shuffled for their cells; hot cells are split by the optimizer else.
    """
    own, bound = right.columns, [F.col(right_box)[c] + 0.0 for c in BOX.names]
    for c in bound:
        right = right.where(c.isNotNull())
    right = right.withColumn("_area", F.concat_ws(",", *bound))
    boxes = right.groupBy("_area", F.col(right_box).alias("_box")).agg(F.count("*").alias("_many"))
    a, b = _dealt(left, left_box, "l"), _dealt(boxes, "_box", "r")

    def key(tag: str, space) -> Column:
        c = lambda name: F.col(f"_{tag}{name}").cast("long")
        return (((F.lit(space).cast("long") * 32 + c("level")) * 4 + F.greatest(c("part") - 1, F.lit(0))) * 2048 + c("x")) * 2048 + c("y")

    # space 1: left's own cells with right's own and ancestors; space 2: left's ancestors with right's own
    a = a.withColumn("_cell", F.when(F.col("_lown"), key("l", 1)).otherwise(key("l", 2)))
    b = b.withColumn("_cell", F.explode(F.when(F.col("_rown") & (F.col("_rpart") < 2), F.array(key("r", 1), key("r", 2))).otherwise(F.array(key("r", 1)))))
    b = b.drop("_rlevel", "_rscale", "_rx", "_ry", "_rown")

    def overlap(i: int, j: int) -> Column:
        return F.coalesce((F.col(f"_lw{i}") <= F.col(f"_re{j}")) & (F.col(f"_rw{j}") <= F.col(f"_le{i}")), F.lit(False))

    lat = (F.col("_ls") <= F.col("_rn")) & (F.col("_rs") <= F.col("_ln"))
    row = _cell(F.greatest("_ls", "_rs"), -90, 180, F.col("_lscale")) == F.col("_ly")
    first, before = F.lit(False), F.lit(False)
    for i in (0, 1):
        for j in (0, 1):
            column = _cell(F.greatest(f"_lw{i}", f"_rw{j}"), -180, 360, F.col("_lscale")) == F.col("_lx")
            first = first | ((F.col("_lpart") == i) & (F.col("_rpart") == j) & overlap(i, j) & ~before & column)
            before = before | overlap(i, j)
    north = (F.col("_ln") == 90) & (F.col("_rn") == 90)
    polar = (F.col("_lpart") > 1) & (F.col("_rpart") > 1) & ~(lat & before) & ((F.col("_lpart") == 2) | ~north)
    b = F.broadcast(b) if boxes.limit(FEW + 1).count() <= FEW else b.hint("merge")
    met = a.join(b, "_cell").where(F.when((F.col("_lpart") > 1) | (F.col("_rpart") > 1), polar).otherwise(lat & first & row))
    out = _rows_of(met.select(*left.columns, "_area", "_many"), left.columns, right.join(boxes.drop("_box"), "_area"), own)
    return out.where(exact) if exact is not None else out


def _rows_of(met: DataFrame, left: list[str], right: DataFrame, own: list[str]) -> DataFrame:
    """``met`` with all rows of its ``_area``, of which there are ``_many`` on the right.

    Pairs are many times the rows, so tasks are cut by pairs: a box's rows are copied to every deal of the
    left rows that meet the box. Rows are dealt by their values. A box's rows go in heaps, arrays of about
    ``HEAP``: a heap meets all left rows of its deal, one after the other, and only then the next heap. So pairs that are
    written have long runs of a left row and short cycles of right ones, which take little room.
    """
    deals, heaps = F.least(F.col("_many"), F.lit(DEALS)), F.ceil(F.col("_many") / HEAP)
    by = lambda df, columns, n: F.pmod(F.xxhash64(*[c for c, kind in df.dtypes if c in columns and "map<" not in kind]), n)
    met = met.withColumn("_deal", by(met, left, deals)).drop("_many")
    right = right.groupBy("_area", "_many", by(right, own, heaps).alias("_heap")).agg(F.collect_list(F.struct(*own)).alias("_rows"))
    right = right.withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), deals - 1))).drop("_many", "_heap")
    keys = ["_area", "_deal"]
    out = spread(right, *keys).join(spread(met, *keys).hint("shuffle_hash"), keys)
    return one_by_one(out.select(*left, "_rows")).select(*left, F.explode("_rows").alias("_row")).select(*left, *[F.col("_row")[c].alias(c) for c in own])


# ---------------------------------------------------------------- tiles of the sinusoidal grid

COLUMNS, ROWS = 36, 18
#: Degrees between the points of an edge that is followed through the tiles.
WALK = 0.1


def tile_of(lon: Column, lat: Column) -> Column:
    """Tile (h, v) of a point."""
    x = lon * F.cos(F.radians(lat))
    h = F.least(F.floor((x + 180) / 10), F.lit(COLUMNS - 1)).cast("int")
    v = F.least(F.floor((90 - lat) / 10), F.lit(ROWS - 1)).cast("int")
    return F.struct(h.alias("h"), v.alias("v"))


def _tile(x: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Number of the tile of points in the grid's plane, 36 v + h."""
    h = np.clip(np.floor((x + 180) / 10), 0, COLUMNS - 1)
    v = np.clip(np.floor((90 - lat) / 10), 0, ROWS - 1)
    return (v * COLUMNS + h).astype(int)


def _middles() -> tuple[np.ndarray, np.ndarray]:
    """Tiles on the globe, and a point (degrees) inside each: on its side towards the equator, where it is widest."""
    v, h = np.divmod(np.arange(ROWS * COLUMNS), COLUMNS)
    lat = np.where(v < ROWS // 2, 80.0 - 10 * v + 1e-7, 90.0 - 10 * v - 1e-7)
    most = 180 * np.cos(np.radians(lat))
    low, high = np.maximum(10.0 * h - 180, -most), np.minimum(10.0 * h - 170, most)
    on = high > low
    return np.flatnonzero(on), np.column_stack([((low + high) / 2 / np.cos(np.radians(lat))), lat])[on]


TILES, MIDDLES = _middles()


def _walked(path: rl.Path) -> np.ndarray:
    """Tiles that edges pass through: points along them in the grid's plane, and the tile between two that part by a corner."""
    if not len(path):
        return _tile(path.corners[:, 0] * np.cos(np.radians(path.corners[:, 1])), path.corners[:, 1])
    long = np.degrees(sh._angle(path.a, path.b)) if path.arcs else np.abs(path.b - path.a).max(1)
    n = np.maximum(1, np.ceil(long / WALK)).astype(int)
    edge = np.repeat(np.arange(len(n)), n + 1)
    p = path.at(edge, (np.arange(len(edge)) - np.repeat(np.cumsum(n + 1) - n - 1, n + 1)) / n[edge])
    p[:, 0] = np.where(np.abs(p[:, 0]) > 180, np.mod(p[:, 0] + 180, 360) - 180, p[:, 0])
    x, y = p[:, 0] * np.cos(np.radians(p[:, 1])), p[:, 1]
    out = [_tile(x, y)]
    two = (edge[1:] == edge[:-1]) & (np.abs(np.diff(p[:, 0])) < 180)
    a, b = np.column_stack([x, y])[:-1][two], np.column_stack([x, y])[1:][two]
    part = (np.floor(a[:, 0] / 10) != np.floor(b[:, 0] / 10)) & (np.floor(a[:, 1] / 10) != np.floor(b[:, 1] / 10))
    a, b = a[part], b[part]
    side = 10 * np.floor(np.maximum(a[:, 0], b[:, 0]) / 10)  # the step crosses this upright and a level line: before or after?
    mid = a + ((side - a[:, 0]) / (b[:, 0] - a[:, 0]))[:, None] * (b - a)
    for shift in (-1e-9, 1e-9):
        out.append(_tile(mid[:, 0] + shift, mid[:, 1]))
    return np.concatenate(out)


def tiles_of(f: rl.Figure) -> np.ndarray:
    """Tiles that a shape meets, sorted by (h, v): those its edges pass through, and those without an edge that lie inside.

    Edges are followed in steps of ``WALK`` degrees, straight in the grid's plane, which is within a
    few ten thousandths of a degree of the edge.
    """
    met = _walked(f.path) if f.kind != "point" else _tile(f.some[:, 0] * np.cos(np.radians(f.some[:, 1])), f.some[:, 1])
    if f.area:
        rest = ~np.isin(TILES, met)
        met = np.concatenate([met, TILES[rest][f.covers_points(MIDDLES[rest])]])
    met = np.unique(met)
    return met[np.lexsort((met // COLUMNS, met % COLUMNS))]


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("h", T.IntegerType()), T.StructField("v", T.IntegerType())])))
def _tiles(a: pa.Array) -> pa.Array:
    def work(x):
        return tiles_of(rl.Figure(*x))

    some = _each("tiles", work, a)
    flat = np.concatenate([np.zeros(0, int), *[t for t in some if t is not None]])
    ends = np.append(0, np.cumsum([0 if t is None else len(t) for t in some])).astype(np.int32)
    tiles = pa.StructArray.from_arrays([pa.array(flat % COLUMNS, pa.int32()), pa.array(flat // COLUMNS, pa.int32())], names=["h", "v"])
    return pa.ListArray.from_arrays(pa.array(ends), tiles, mask=pa.array([t is None for t in some], pa.bool_()))


def assign_tiles(df: DataFrame, shape: str = "shape") -> DataFrame:
    """``df`` with ``tiles``, the sorted (h, v) of tiles that each shape meets; null for null. Rows are dealt over all cores first."""
    return spread(df).withColumn("tiles", _tiles(F.col(shape)))


def area_tiles(df: DataFrame, shape: str = "shape") -> DataFrame:
    """(h, v) of each tile that any of the shapes meets."""
    return assign_tiles(df, shape).select(F.explode("tiles").alias("t")).select("t.*").distinct()


# ---------------------------------------------------------------- search areas


#: Geometry types: the kind of shape, and how deep a shape's coordinates lie.
GEOMETRIES = {"Polygon": ("polygon", 3), "MultiPolygon": ("polygon", 4), "LineString": ("line", 2), "MultiLineString": ("line", 3), "Point": ("point", 1), "MultiPoint": ("point", 2)}


def _turned(ring: Column, hole: Column) -> Column:
    """A ring of (lon, lat) counter-clockwise, a hole clockwise."""
    x, y = (lambda p: p["lon"]), (lambda p: p["lat"])
    sides = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda p, q: (x(q) - x(p)) * (y(q) + y(p)))
    clockwise = F.aggregate(sides, F.lit(0.0), lambda a, v: a + v) > 0
    return F.when((F.size(ring) > 1) & (clockwise != hole), F.reverse(ring)).otherwise(ring)


def areas(features: DataFrame) -> DataFrame:
    """(area_id, shape) of GeoJSON features, one text each in ``feature``: a row for each polygon, line or point.

    ``area_id`` is the feature's id, else the text in ``place``. Features without geometry give no row.
    """
    f = features.select(F.coalesce(F.get_json_object("feature", "$.id"), F.col("place").cast("string")).alias("area_id"), F.get_json_object("feature", "$.geometry.type").alias("type"), F.get_json_object("feature", "$.geometry.coordinates").alias("c"))
    deep = lambda n: "array<" * n + "double" + ">" * n
    pair = lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))
    out = None
    for depth in (1, 2, 3, 4):
        own = [t for t, (_, n) in GEOMETRIES.items() if n == depth]
        if depth == 1:
            parts = F.array(F.array(F.array(F.col("v"))))
        elif depth == 2:  # a line, or points
            parts = F.when(F.col("type") == "LineString", F.array(F.array(F.col("v")))).otherwise(F.transform("v", lambda p: F.array(F.array(p))))
        elif depth == 3:  # a polygon, or lines
            parts = F.when(F.col("type") == "Polygon", F.array(F.col("v"))).otherwise(F.transform("v", lambda r: F.array(r)))
        else:
            parts = F.col("v")
        one = f.where(F.col("type").isin(own)).withColumn("v", F.from_json("c", deep(depth))).where(F.col("v").isNotNull())
        one = one.select("area_id", "type", F.explode(parts).alias("rings"))
        out = one if out is None else out.unionByName(one)
    rings = F.transform("rings", lambda r: F.transform(r, pair))
    kind = F.lit(None).cast("string")
    for t, (name, _) in GEOMETRIES.items():
        kind = F.when(F.col("type") == t, name).otherwise(kind)
    turned = F.when(kind == "polygon", F.transform(rings, lambda r, k: _turned(r, k > 0))).otherwise(rings)
    return out.select("area_id", F.struct(kind.alias("kind"), F.lit("geodetic").alias("coord_sys"), turned.alias("rings")).alias("shape"))


def read_areas(spark, path: str, lines: bool = False) -> DataFrame:
    """(area_id, shape) of GeoJSON files: collections of features or single ones, or with ``lines`` a feature a line.

    Features without geometry are dropped, rings are turned counter-clockwise (holes clockwise). A
    collection is cut into its features' texts first, which are parsed as rows of their own; files of
    lines are split by Spark, however large.
    """
    raw = spark.read.text(path, wholetext=not lines)
    whole = F.from_json("value", "struct<type:string,features:array<string>>")
    each = F.when(whole["type"] == "Feature", F.array(F.col("value"))).otherwise(whole["features"])
    return areas(raw.select(F.posexplode(each).alias("place", "feature")))


def simplify_areas(df: DataFrame, most: int, shape: str = "shape", tolerance: float = 1e-4, tries: int = 5) -> DataFrame:
    """Outlines simplified until they have at most ``most`` points: tolerance times ten at each try.

    A try whose outline crosses itself or collapses is passed over; adds ``simplified``. Rows are dealt over all cores first.
    """
    point = pa.struct([("lon", pa.float64()), ("lat", pa.float64())])
    a_type = pa.struct([("shape", pa.struct([("kind", pa.string()), ("coord_sys", pa.string()), ("rings", pa.list_(pa.list_(point)))])), ("simplified", pa.bool_())])

    def simplified(x) -> dict:
        best, t = x, tolerance
        ok = sum(map(len, x[2])) <= most
        for _ in range(tries):
            if ok:
                break
            rings = [sh.simplify(r, t) for r in x[2]]
            t *= 10
            if all(len(r) >= (4 if x[0] == "polygon" else 2) for r in rings) and not sh.shape_errors(x[0], "cartesian", rings):
                best = (x[0], x[1], rings)
                ok = sum(map(len, rings)) <= most
        shape = {"kind": best[0], "coord_sys": best[1], "rings": [[{"lon": float(p[0]), "lat": float(p[1])} for p in r] for r in best[2]]}
        return {"shape": shape, "simplified": best is not x}

    @F.arrow_udf(T.StructType([T.StructField("shape", SHAPE), T.StructField("simplified", T.BooleanType())]))
    def run(a: pa.Array) -> pa.Array:
        return pa.array([{"shape": None, "simplified": False} if r is None else r for r in _each(f"simplified {most} {tolerance} {tries}", simplified, a)], a_type)

    return spread(df).withColumn("_s", run(F.col(shape))).withColumn(shape, F.col("_s.shape")).withColumn("simplified", F.col("_s.simplified")).drop("_s")
