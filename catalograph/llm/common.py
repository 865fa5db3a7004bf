"""Shared helpers of the training-data operators: shared storage, words, hashes, groups, components."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
#: A broadcast side has at most so many rows of a few fixed-width columns (tens of MB); beyond it joins shuffle.
BROADCAST_ROWS = 500_000
#: Entries a worker keeps of a per-word memo before it stops adding.
MEMO_WORDS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The input table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master may do without the setting; it then gets a temporary folder.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    held = getattr(shared_dir, "held", None)
    if held is None:
        held = shared_dir.held = tempfile.mkdtemp(prefix="spark-")
    return f"file://{held}"


class Scratch:
    """Tables written below the shared folder, so that a lost executor never costs their lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def store(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` as Parquet and read it again."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table of :meth:`store` that nothing reads any more."""
        self.remove(df._scratch_path)

    def remove(self, path: str) -> None:
        """Delete files below the shared folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if ``rows``, its counted size, is within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def hash128(c: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of different seeds; the second doesn't follow from the first."""
    return F.xxhash64(c), F.xxhash64(F.lit(1), c)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else unchanged; by the faster function where nothing else could change."""
    slow = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(slow)


# ---------------------------------------------------------------- inside tasks


def tidy(each):
    """A mapper of batches that gives its memory back when its partition ends: Python workers, and
    what their allocators keep, outlive tasks."""

    @functools.wraps(each)
    def run(batches):
        yield from each(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return run


# words and hashes


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two xor-shift multiplications), vectorised."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Memo of word (bytes) to 64-bit hash; bounded."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO_WORDS:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def grams(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` word hashes, by doubling; len(w) - k + 1 of them."""
    n = len(w) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, power, step, left = None, 0, w, 1, k
    while left:
        if left & 1:
            part = power[have : have + n]
            out = part if out is None else mix(out * np.uint64(0x9E3779B97F4A7C15) + part)
            have += step
        left >>= 1
        if left:
            power = mix(power[:-step] * np.uint64(0xC2B2AE3D27D4EB4F) + power[step:])
            step *= 2
    return out[:n]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def lists(parts: list[np.ndarray], dtype=np.int64) -> pa.Array:
    """An Arrow list column of one array for each row."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(dtype) if flat.dtype != dtype else flat))


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of a partition sorted by ``keys``: one table for each run of equal (non-null) keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(b.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        new[0] = last is not None and any(c[0] != x for c, x in zip(cols, last))
        last = [c[-1] for c in cols]
        at = 0
        for cut in np.flatnonzero(new):
            if cut > at:
                held.append(b.slice(at, cut - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], cut
        held.append(b.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def blocked(df: DataFrame, count: Column, member: Column, limit: int) -> DataFrame:
    """Split groups of more than ``limit`` rows into blocks, and give each pair of blocks a task.

    Adds ``bi`` <= ``bj``, the pair, and ``mine``, the row's block. A group of up to ``limit`` rows
    is one pair (0, 0). Rows of larger groups go to each pair that has their block, so all pairs of
    members still meet, exactly once when a pair of blocks compares only across its two blocks.
    """
    n = F.ceil(count / F.lit(limit)).cast("int")
    mine = F.pmod(F.xxhash64(member), n).cast("int")
    return (
        df.withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
        .withColumn("bi", F.least("mine", "other"))
        .withColumn("bj", F.greatest("mine", "other"))
        .drop("other")
    )


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of ``edges`` (a, b long): a row (node, comp) for each node that is not
    the smallest of its component; ``comp`` is the smallest node.

    Alternates the large-star and small-star steps until nothing changes; each round is a few
    grouped minima and equi-joins, and its result is a table in the shared folder.
    """
    e = scratch.store(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges"
    )
    seen = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        seen = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.store(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = (
            large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        new = scratch.store(small_star, "small")
        scratch.drop(e)
        scratch.drop(large)
        e = new
