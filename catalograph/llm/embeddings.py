"""Operator 6, near-duplicate embeddings by iterative quantisation.

A rotation of the principal axes is learned on a bounded sample so that signs of the rotated
vector make a balanced binary code (iterative quantisation: fix the codes, solve the orthogonal
Procrustes problem, repeat). Several such rotations, from different starts, give codes that are cut
into substrings; each substring is the key of one Hamming table. Vectors that agree on a substring
in any table meet in a task, where original vectors decide by cosine in double precision.

Substrings have at least 8 bits, and about log2 of the number of vectors less nine beyond 130,000,
so buckets keep their size as data grow: a few hundred vectors, which one matrix product compares,
while fewer bits need fewer tables and so fewer copies of a vector. The number of tables follows from the target recall: a pair at cosine c differs in a bit
with probability arccos(c) / pi, and tables are independent draws of substrings. Pairs of a bucket
are counted and joined inside tasks, never given out: a task adds to each vector's number of links
the pairs for which this is the first table that they share, and returns edges from its components'
members to their smallest. A pair of blocks whose members all met in a table before is passed over,
so a group of near copies costs one comparison, not one for each table. Buckets of any size are split into pairs of blocks; none is capped. Only keys
of such buckets are joined to the vectors, which are shuffled once, in single precision where the
column has it.

Copies (equal components) first collapse to one vector with a weight. Vectors that are null, zero,
or hold null or non-finite components link with nothing, and neither do vectors of different
length. ``vec_id`` is an integer; a vector is one value in a task, however long. Rows with one ``vec_id`` are vectors of their own that share an id. An empty table gives
an empty result; labels and other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, blocked, components, runs, small, table, tidy

COSINE = 0.9
#: Target share of pairs at the threshold itself that some table brings together.
RECALL = 0.97
#: Vectors in the sample that the rotations are learned on, at most.
SAMPLE = 20_000
ITERATIONS = 20
#: Members of a bucket that one task compares with as many others.
BLOCK = 1024
BITS_LEAST, BITS_MOST = 8, 24
#: A bucket has about two to the power of this vectors.
BUCKET_BITS = 9


def plan_tables(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a substring and number of tables for ``n`` vectors."""
    bits = min(BITS_MOST, max(BITS_LEAST, math.ceil(math.log2(max(n, 2))) - BUCKET_BITS))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def learn(x: np.ndarray, seed: int) -> np.ndarray:
    """An iterative-quantisation projection of unit vectors: (dimensions, bits).

    Vectors aren't centred: a bit is then the side of a plane through the origin, so vectors at a
    small angle rarely differ in it, even where nearly all vectors are alike.
    """
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    _, axes = np.linalg.eigh(x.T @ x / max(len(x), 1) + 1e-9 * np.eye(dim))
    v = x @ axes
    turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    for _ in range(ITERATIONS):
        codes = np.where(v @ turn >= 0, 1.0, -1.0)
        a, _, b = np.linalg.svd(codes.T @ v)
        turn = (a @ b).T
    return axes @ turn


class Codes:
    """Learned projections and the cut of their codes into table keys."""

    def __init__(self, sample: np.ndarray, n: int):
        dim = sample.shape[1]
        self.bits, self.tables = plan_tables(n)
        each = max(1, dim // self.bits)  # substrings that one code has
        rotations = math.ceil(self.tables / each)
        self.projection = [learn(sample, seed) for seed in range(rotations)]
        self.cuts = [(t // each, [(t % each * self.bits + i) % dim for i in range(self.bits)]) for t in range(self.tables)]

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Each row's key in every table: (rows, tables)."""
        signs = [(x @ p) >= 0 for p in self.projection]
        power = 1 << np.arange(self.bits, dtype=np.int64)
        return np.stack([signs[r][:, at] @ power for r, at in self.cuts], 1)


def _vectors(kind: str):
    """Clean vectors as bytes of ``kind``, the column's own precision; null for those that can't link."""

    @tidy
    def each(batches):
        for b in batches:
            out = []
            for v in b.column("embedding"):
                own = v.values if v.is_valid else None
                x = own.to_numpy(zero_copy_only=False).astype(kind) + 0.0 if own is not None and not own.null_count else None
                ok = x is not None and len(x) and np.isfinite(x).all() and x.any()
                out.append(x.tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(out, pa.binary())], names=["vec_id", "vec"])

    return each


def unit(raw: list[bytes], kind: str = "f8") -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that no norm overflows or vanishes."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _keyed(codes: dict[int, Codes], kind: str):
    width = np.dtype(kind).itemsize

    def each(batches):
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                raw = part.column("vec").to_pylist()
                size = np.array([len(v) // width for v in raw])
                for dim in np.unique(size):
                    at = np.flatnonzero(size == dim)
                    own = codes[int(dim)]
                    keys = own.keys(unit([raw[k] for k in at], kind))
                    tables = np.tile(np.arange(own.tables), len(at))
                    rows = part.take(pa.array(np.repeat(at, own.tables)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(tables.astype(np.int32)), pa.array((dim << 40) | keys.ravel()), rows.column("node"), rows.column("vec"), rows.column("copies")],
                        names=["tab", "key", "node", "vec", "copies"],
                    )

    return each


def joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member that links i-j lead to, for each of ``n``: minima passed along until nothing changes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _linked(codes: dict[int, Codes], kind: str):
    """Of each pair of blocks: links that each vector gains, and edges that lead to each component's smallest member."""

    def each(batches):
        for g in runs(batches, ["tab", "key", "bi", "bj"]):
            if g.num_rows < 2:
                continue
            node, copies, mine = (g.column(c).to_numpy() for c in ("node", "copies", "mine"))
            tab, bi, bj = (g.column(c)[0].as_py() for c in ("tab", "bi", "bj"))
            x = unit(g.column("vec").to_pylist(), kind)
            keys = codes[x.shape[1]].keys(x)[:, :tab]
            left = np.flatnonzero(mine == bi)
            right = left if bi == bj else np.flatnonzero(mine == bj)
            if not len(left) or not len(right) or (keys == keys[:1]).all(0).any():
                continue  # in some table before, all of these met already
            gained, label = np.zeros(len(node), np.int64), np.arange(len(node))
            for k in range(0, len(left), 256):
                rows = left[k : k + 256]
                link = x[rows] @ x[right].T >= COSINE
                if bi == bj:
                    link &= rows[:, None] < right[None]
                some = int(link.sum())
                if not some:
                    continue
                if 8 * some > link.size:  # many: all pairs of the slice at once
                    for t in range(tab):
                        link &= keys[rows, t][:, None] != keys[right, t][None]
                i, j = np.nonzero(link)
                if tab and 8 * some <= link.size:
                    new = ~(keys[rows[i]] == keys[right[j]]).any(1)
                    link[i[~new], j[~new]] = False
                    i, j = i[new], j[new]
                if not len(i):
                    continue
                gained[rows] += link @ copies[right]
                gained[right] += copies[rows] @ link
                i, j = rows[i], right[j]
                apart = label[i] != label[j]
                if apart.any():
                    label = joined(len(node), np.concatenate([np.arange(len(node)), i[apart]]), np.concatenate([label, j[apart]]))
            some = np.flatnonzero(gained)
            led = np.flatnonzero(label != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.nulls(len(some), pa.int64()), pa.array(gained[some])], names=["a", "b", "links"])
            if len(led):
                yield pa.RecordBatch.from_arrays([pa.array(node[led]), pa.array(node[label[led]]), pa.array(np.zeros(len(led), np.int64))], names=["a", "b", "links"])

    return each


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding)."""
    scratch = Scratch(vectors.sparkSession, "vectors")
    held = vectors.schema["embedding"].dataType.simpleString()
    kind, width = ("f4", 4) if held == "array<float>" else ("f8", 8)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if width == 4 else "array<double>").alias("embedding"))
    rows = scratch.store(rows.mapInArrow(_vectors(kind), "vec_id long, vec binary").withColumn("h", F.xxhash64("vec")), "rows")
    groups = rows.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    nodes = scratch.store(groups.withColumn("node", F.monotonically_increasing_id()), "nodes")
    sizes = {r["dim"]: r["n"] for r in nodes.groupBy((F.length("vec") / width).cast("int").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n")).collect()}
    codes = {}
    for dim, n in sizes.items():
        share = min(1.0, 1.2 * SAMPLE / n)  # by hash, so no sort of the whole; the limit is the bound
        some = nodes.where(F.length("vec") == width * dim)
        some = some if share == 1 else some.where(F.pmod(F.xxhash64("vec", F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20)))
        codes[dim] = Codes(unit([r["vec"] for r in some.select("vec").limit(SAMPLE).collect()], kind), n)
    label = nodes.select("node", "vec", "vec_id", "copies")
    if codes:
        keyed = nodes.select("node", "vec", "copies").mapInArrow(_keyed(codes, kind), "tab int, key long, node long, vec binary, copies long")
        large = scratch.store(keyed.groupBy("tab", "key").agg(F.count("*").alias("members")).where(f"members > {BLOCK}"), "buckets")
        keyed = keyed.join(small(large, large.count()), ["tab", "key"], "left")
        meet = blocked(keyed, F.coalesce("members", F.lit(1)), F.col("node"), BLOCK)
        meet = meet.select("tab", "key", "bi", "bj", "mine", "node", "vec", "copies").repartition("tab", "key", "bi", "bj").sortWithinPartitions("tab", "key", "bi", "bj")
        found = scratch.store(meet.mapInArrow(_linked(codes, kind), "a long, b long, links long"), "links")
        comp = scratch.store(components(found.where("b is not null").select("a", "b"), scratch), "components")
        links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
        label = label.join(comp, "node", "left").join(links, "node", "left")
    else:
        label = label.withColumn("comp", F.lit(None).cast("long")).withColumn("links", F.lit(None).cast("long"))
    label = label.withColumn("comp", F.coalesce("comp", "node"))
    ids = label.groupBy("comp").agg(F.min("vec_id").alias("component_id"))
    label = label.join(ids, "comp").select("vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "vec").join(label, "vec", "left")
    lone = F.col("vec").isNull()
    return out.select(
        "vec_id",
        F.when(lone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        F.when(lone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_itq_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all ``embeddings``, whatever their labels."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT rid, vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v),
ok AS (SELECT * FROM u WHERE n > 0 AND isfinite(n) AND len(list_filter(e, lambda x: x IS NULL)) = 0),
l AS (SELECT a.rid AS a, b.rid AS b, b.vec_id AS bid FROM ok a JOIN ok b ON a.rid <> b.rid AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
r AS (SELECT rid, rid AS reach FROM u UNION SELECT r.rid, l.b FROM r JOIN l ON r.reach = l.a),
c AS (SELECT r.rid, min(u.vec_id) AS component_id FROM r JOIN u ON r.reach = u.rid GROUP BY r.rid),
k AS (SELECT a AS rid, count(*) AS n_links FROM l GROUP BY a)
SELECT u.vec_id, coalesce(n_links, 0) AS n_links, component_id, u.vec_id = component_id AS kept FROM u JOIN c USING (rid) LEFT JOIN k USING (rid)
"""
