"""Operator 11, compression of vectors to codes by ball k-means on each part.

Components are integers (floor of 256 times the component), vectors are cut into ``PARTS`` equal
parts, and each part position has a codebook of ``ENTRIES`` entries, at first those of the vectors
with the smallest ids. A round assigns every part to its nearest entry (ties to the lower index)
and moves each entry to its parts' mean, floored.

The first round compares all entries. From then on an entry with its parts is a ball: its radius is
bounded by the farthest part of the round before and the way that the entry has moved since, and
only entries whose centre lies within two radii are its neighbours. A part closer to its own entry
than half the way to the nearest neighbour is in the ball's stable core and keeps its entry; any
other lies in the ring of some neighbours, nearest first, and is compared with exactly those. A ball
none of whose neighbours has moved, nor itself, keeps all its parts. All of it is in integers (bounds
are rounded outwards), so results are those of comparing everything.

Each round is one pass over a table in the shared folder, which holds vectors with their codes and,
as rows of their own, each task's sums for each entry; sums of tasks are added up by Spark. The
driver gets the codebooks alone: ``PARTS`` times ``ENTRIES`` rows, whatever the number of vectors.

Vectors that are null, empty or hold null or non-finite components are left out, and so are those
whose length differs from that of the vector with the smallest id; a length that isn't a multiple
of ``PARTS`` is filled up with zeros. Components too large for exact 64-bit distances (about 500,000
for 64 components) count as the largest that isn't. Of equal ids the smaller vector comes first, null
ids come last; rows with one id are vectors of their own. With fewer vectors than entries there are as
many entries as vectors. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, tidy

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Integers in a component's unit.
SCALE = 256
#: Vectors that a task reads at once, and distances.
VECTORS, DISTANCES = 4096, 1 << 18


@tidy
def _integers(batches):
    """Vectors as the bytes of their integers, filled up to a multiple of the parts; null for those left out."""
    for b in batches:
        out = []
        for v in b.column("embedding"):
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) if v.is_valid and not v.values.null_count else np.zeros(0)
            if not len(x) or not np.isfinite(x).all():
                out.append(None)
                continue
            most = math.isqrt((1 << 62) // len(x)) // 2
            q = np.zeros(-(-len(x) // PARTS) * PARTS, np.int64)
            q[: len(x)] = np.clip(np.floor(np.clip(x, -1e30, 1e30) * SCALE), -most, most)
            out.append(q.astype("<i4").tobytes())
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(out, pa.binary())], names=["vec_id", "label", "q"])


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x and y, exactly."""
    return ((x[:, None] - y[None]) ** 2).sum(2)


def nearest(x: np.ndarray, entries: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest entry (of equally near ones that with the lowest name) and squared distance."""
    own, far = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    step = max(1, DISTANCES // max(1, entries.size))
    for i in range(0, len(x), step):
        d = squares(x[i : i + step], entries)
        far[i : i + step] = d.min(1)
        own[i : i + step] = np.where(d == far[i : i + step, None], names, len(names) + names.max()).min(1)
    return own, far


class Balls:
    """A part position's entries, and what the round before says of their balls."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None, far: np.ndarray | None = None):
        self.entries = entries
        self.first = before is None
        if self.first:
            return
        n = len(entries)
        gap = squares(entries, entries)
        moved = ((entries - before) ** 2).sum(1)
        self.far = far
        radius = np.sqrt(np.maximum(far, 0).astype(float)) + np.sqrt(moved.astype(float))
        reach = np.where(far < 0, -1.0, 4 * radius**2 * (1 + 1e-9) + 1)  # no parts, no neighbours
        near = gap <= reach[:, None]
        near[np.arange(n), np.arange(n)] = False
        self.neighbours, self.rings = [], []
        for i in range(n):
            own = np.flatnonzero(near[i])
            own = own[np.argsort(gap[i, own], kind="stable")]
            self.neighbours.append(own)
            self.rings.append(gap[i, own])
        self.still = (moved == 0) & ~(near & (moved > 0)[None]).any(1)

    def assign(self, x: np.ndarray, code: np.ndarray | None, distances: bool) -> tuple[np.ndarray, np.ndarray]:
        """Entry of each row of ``x``, and squared distances (of still balls only if asked for)."""
        if self.first:
            return nearest(x, self.entries, np.arange(len(self.entries)))
        out, far = code.copy(), np.zeros(len(x), np.int64)
        order = np.argsort(code, kind="stable")
        cut = np.searchsorted(code[order], np.arange(len(self.entries) + 1))
        for i in np.flatnonzero(np.diff(cut)):
            at = order[cut[i] : cut[i + 1]]
            if self.still[i] and not distances:
                continue
            far[at] = ((x[at] - self.entries[i]) ** 2).sum(1)
            if self.still[i] or not len(self.rings[i]):
                continue
            # a neighbour can be as near only if its centre lies within twice the part's own distance
            ring = np.searchsorted(self.rings[i], 4 * far[at], "right")
            by = np.argsort(ring, kind="stable")
            at, ring = at[by], ring[by]
            low = int(np.searchsorted(ring, 1))  # below: stable cores
            while low < len(at):
                most = 2 * int(ring[low])
                high = int(np.searchsorted(ring, most, "right"))
                names = np.concatenate([[i], self.neighbours[i][: int(ring[high - 1])]])
                rows = at[low:high]
                out[rows], far[rows] = nearest(x[rows], self.entries[names], names)
                low = high
        return out, far


def _parts(part: pa.RecordBatch) -> np.ndarray:
    """(vectors, parts, width)."""
    raw = b"".join(part.column("q").to_pylist())
    return np.frombuffer(raw, "<i4").reshape(part.num_rows, PARTS, -1).astype(np.int64)


def _codes(part: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(part.num_rows, PARTS).astype(np.int64)


def _assigned(shared):
    """Mapper: vectors with new codes, then the task's count, sum and farthest part of each entry it met."""

    @tidy
    def each(batches):
        balls = shared.value
        entries, width = balls[0].entries.shape
        count = np.zeros((PARTS, entries), np.int64)
        total = np.zeros((PARTS, entries, width), np.int64)
        far = np.zeros((PARTS, entries), np.int64)
        label = pa.null()
        for b in batches:
            label = b.schema.field("label").type
            for i in range(0, b.num_rows, VECTORS):
                part = b.slice(i, VECTORS)
                x = _parts(part)
                old = None if balls[0].first else _codes(part)
                new = np.empty((len(x), PARTS), np.uint8)
                for p, ball in enumerate(balls):
                    own, d = ball.assign(x[:, p], None if old is None else old[:, p], False)
                    new[:, p] = own
                    count[p] += np.bincount(own, minlength=entries)
                    np.add.at(total[p], own, x[:, p])
                    np.maximum.at(far[p], own, d)
                none = [pa.nulls(part.num_rows, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), part.column("q"), pa.array([c.tobytes() for c in new], pa.binary()), *none], names=NAMES)
        p, e = np.nonzero(count)
        none = [pa.nulls(len(p), t) for t in (pa.int64(), label, pa.binary(), pa.binary())]
        sums = [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64())), pa.array(far[p, e])]
        if len(p):
            yield pa.RecordBatch.from_arrays([*none, *sums], names=NAMES)

    return each


NAMES = ["vec_id", "label", "q", "code", "part", "entry", "n", "total", "far"]


def _coded(shared):
    """Mapper: each vector's code as text, and its error."""

    @tidy
    def each(batches):
        balls = shared.value
        for b in batches:
            for i in range(0, b.num_rows, VECTORS):
                part = b.slice(i, VECTORS)
                x, old = _parts(part), _codes(part)
                new, error = np.empty((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
                for p, ball in enumerate(balls):
                    new[:, p], d = ball.assign(x[:, p], old[:, p], True)
                    error += d
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array([c.tobytes().hex() for c in new]), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return each


def _moved(balls: list[Balls], coded: DataFrame) -> list[Balls]:
    """Balls of the next round: entries at their parts' floored means, radii by the farthest parts."""
    width = balls[0].entries.shape[1]
    sums = coded.where("part is not null").groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total"), F.max("far").alias("far"))
    entries = [b.entries.copy() for b in balls]
    far = [np.full(len(e), -1, np.int64) for e in entries]
    for r in sums.collect():  # at most a row for each entry of each part
        entries[r["part"]][r["entry"]] = [t // r["n"] for t in r["total"]]
        far[r["part"]][r["entry"]] = r["far"]
    # a still ball's parts weren't measured: their bound stays
    far = [f if b.first else np.where(b.still & (f >= 0), np.maximum(f, b.far), f) for b, f in zip(balls, far)]
    return [Balls(e, b.entries, f) for e, b, f in zip(entries, balls, far)]


def compress(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each kept row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "codes")
    label = vectors.schema["label"].dataType.simpleString()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    held = scratch.store(rows.mapInArrow(_integers, f"vec_id long, label {label}, q binary").where("q is not null"), "integers")
    order = F.asc_nulls_last("vec_id"), F.length("q"), F.col("q")
    least = held.select("vec_id", "q").orderBy(*order).first()
    if least is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    same = held.where(F.length("q") == len(least["q"]))
    first = same.select("vec_id", "q").orderBy(*order).limit(ENTRIES).collect()
    start = np.array([np.frombuffer(r["q"], "<i4") for r in first], np.int64).reshape(len(first), PARTS, -1)
    balls = [Balls(start[:, p]) for p in range(PARTS)]
    kind = f"vec_id long, label {label}, q binary, code binary, part int, entry int, n long, total array<long>, far long"
    coded = None
    for k in range(ROUNDS):
        own = same if coded is None else coded.where("part is null").select("vec_id", "label", "q", "code")
        new = scratch.store(own.mapInArrow(_assigned(spark.sparkContext.broadcast(balls)), kind), f"round{k}")
        scratch.drop(held if coded is None else coded)
        coded = new
        balls = _moved(balls, coded)
    digest = hashlib.sha256(",".join(str(c) for b in balls for e in b.entries.tolist() for c in e).encode()).hexdigest()
    out = coded.where("part is null").select("vec_id", "label", "q", "code").mapInArrow(_coded(spark.sparkContext.broadcast(balls)), f"vec_id long, label {label}, code string, error long")
    out = scratch.store(out, "coded")
    scratch.drop(coded)
    sums = out.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same")
    out = out.join(sums, F.col("label").eqNullSafe(F.col("same")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op11_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all ``embeddings``."""
    return compress(table(spark, sf_dir, "embeddings"))


def _near(parts: str, book: str) -> str:
    """SQL: each part's nearest entry of a codebook, as distance times 64 plus entry."""
    return f"SELECT rid, part, x, min(((x[1]-c[1])*(x[1]-c[1]) + (x[2]-c[2])*(x[2]-c[2]) + (x[3]-c[3])*(x[3]-c[3]) + (x[4]-c[4])*(x[4]-c[4])) * 64 + entry) AS best FROM {parts} JOIN {book} USING (part) GROUP BY rid, part, x"


def _mean(near: str, book: str) -> str:
    """SQL: a codebook moved to the floored means of its parts."""
    floor = ", ".join(f"CAST(floor(sum(x[{i}]) / count(*)) AS BIGINT)" for i in range(1, 5))
    return f"SELECT part, entry, coalesce(m, c) AS c FROM {book} LEFT JOIN (SELECT part, best % 64 AS entry, [{floor}] AS m FROM {near} GROUP BY ALL) USING (part, entry)"


#: For vectors of 64 components, which the given tables hold.
SQL = f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT rid, CAST(i AS INTEGER) AS part, q[4*i+1:4*i+4] AS x FROM v, range(16) r(i)),
c0 AS (SELECT part, rid - 1 AS entry, x AS c FROM p WHERE rid <= 64),
n0 AS ({_near("p", "c0")}), c1 AS ({_mean("n0", "c0")}),
n1 AS ({_near("p", "c1")}), c2 AS ({_mean("n1", "c1")}),
n2 AS ({_near("p", "c2")}),
e AS (SELECT rid, string_agg(printf('%02x', best % 64), '' ORDER BY part) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM n2 GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM c2) AS codebooks_sha256
FROM v JOIN e USING (rid)
"""
