"""Operator 5, near-duplicate documents by HyperMinHash.

A document's shingle set goes into ``REGISTERS`` buckets; of each bucket only the smallest hash is
kept, compressed to 16 bits: its leading-zero count and ten mantissa bits. Empty buckets borrow
from filled ones by a fixed random probing, so short texts fill all registers too. Bands of
registers find candidates, a collision-corrected Jaccard estimate over all registers thins them,
and full shingle sets confirm each remaining link.

Copies first collapse: documents with one shingle set are one node. Candidates never become all
pairs of a bucket:

* Round 1 links each node of a bucket with the bucket's smallest node (a row for each member).
  Confirmed links give components.
* Round 2 looks only at buckets that still hold several components. A task compares the registers
  of their members, only across components, each pair once (in the first band that it shares).
  Pairs that pass the estimate are held against the members' lowest ``LOWEST`` shingle hashes, which
  are whole sets for most texts, and given out if they pass that too. Buckets of any size are
  split into pairs of blocks.

All pairs of a bucket are so either compared or in one component already; nothing is capped.
A pair at similarity s is missed if no band agrees: (1 - s^7)^36, under 1e-6 at 0.85, 2e-4 at 0.8. The estimate
drops a pair only if it lies 4.5 standard deviations below the threshold.

Null or empty texts have no set: ``n_shingles`` 0, component of their own, kept. Repeated rows are
copies: each row comes back. Rows with a null ``doc_id`` take part; a component's id is its
smallest non-null id (null if it has none; such rows are kept). An empty table gives an empty result.
``doc_id`` is an integer, or text that reads as one. Hashes are 64-bit: two sets are taken for equal if their digests are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, blocked, components, grams, lists, mix, runs, small, table, tidy

WORDS = 5
#: Percent of similarity from which documents are linked, unless given.
THRESHOLD = 85
BAND, BANDS = 7, 36
REGISTERS = BAND * BANDS
MANTISSA = 10
PROBES = 48
#: Standard deviations that an estimate may lie below the threshold.
SLACK = 4.5
#: Shingle hashes of a member that a task of round 2 holds, the lowest ones.
LOWEST = 1024
#: Members of a bucket that one task compares with as many others.
BLOCK = 1024

_rng = np.random.default_rng(5)
_PROBE = _rng.integers(0, REGISTERS, (PROBES, REGISTERS))
_BAND_SALT = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(raw: bytes | None, memo: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a shorter text is one shingle; empty: none."""
    w = (raw or b"").lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not w:
        return np.zeros(0, np.uint64)
    h = memo.of(w)
    if len(w) < words:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), len(w))], np.uint64)
    return np.unique(grams(h, words))


def registers(s: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (leading zeros, then mantissa bits) of a sorted set of hashes."""
    bucket = ((s >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    low = np.minimum.reduceat(mix(s), begin)
    zeros = 64 - np.frexp(low.astype(np.float64))[1]
    zeros = np.clip(zeros, 0, 62).astype(np.uint64)
    mantissa = (low << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out = np.zeros(REGISTERS, np.uint16)
    filled = np.zeros(REGISTERS, bool)
    at = bucket[begin]
    out[at] = (zeros << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    filled[at] = True
    empty = np.flatnonzero(~filled)
    for probe in _PROBE:
        if not len(empty):
            return out
        found = filled[probe[empty]]
        hit = empty[found]
        out[hit] = out[probe[hit]]
        empty = empty[~found]
    if len(empty):  # few buckets are filled: the next filled one, cyclically
        out[empty] = out[at[np.searchsorted(at, empty) % len(at)]]
    return out


def bands(regs: np.ndarray) -> np.ndarray:
    """Keys of each row's bands: (rows, BANDS)."""
    r = regs.reshape(len(regs), BANDS, BAND).astype(np.uint64)
    h = np.broadcast_to(_BAND_SALT, r.shape[:2])
    for i in range(0, BAND, 4):
        word = np.zeros(r.shape[:2], np.uint64)
        for j in range(i, min(i + 4, BAND)):
            word = word << np.uint64(16) | r[..., j]
        h = mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + word)
    return h


def passes(equal: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """Whether pairs with so many equal registers may reach the threshold, by set sizes.

    Registers of different minima collide by chance; for buckets with a and b hashes that happens
    at a rate of about 0.72 / 2^r x a b / (a + b)^2, which the estimate takes off. Sets whose sizes
    alone rule the threshold out fail.
    """
    na, nb = na.astype(float), nb.astype(float)
    chance = 0.7213 / 2**MANTISSA * na * nb / (na + nb) ** 2
    est = (equal / REGISTERS - chance) / (1 - chance)
    t = threshold / 100
    least = np.minimum(na, nb)
    room = SLACK * np.sqrt(t * (1 - t) / (REGISTERS * -np.expm1(-least / REGISTERS)))
    return (est >= t - room) & (100 * least >= threshold * np.maximum(na, nb))


def reach(a: np.ndarray, others: list[np.ndarray], threshold: int = THRESHOLD) -> np.ndarray:
    """Whether sets may reach the threshold with set ``a``, from the lowest hashes of each.

    Below the smaller of two cut-offs both samples are complete, so the share of common hashes there
    estimates the similarity; sets that aren't cut off are compared as a whole.
    """
    out = np.zeros(len(others), bool)
    t = threshold / 100
    for i, b in enumerate(others):
        x, y, room = a, b, 0.0
        if len(x) >= LOWEST or len(y) >= LOWEST:
            top = min([v[-1] for v in (x, y) if len(v) >= LOWEST])
            x, y = x[: np.searchsorted(x, top, "right")], y[: np.searchsorted(y, top, "right")]
            room = SLACK * np.sqrt(t * (1 - t) / max(len(x), len(y), 1))
        both = np.concatenate([x, y])
        both.sort(kind="stable")
        common = int((both[1:] == both[:-1]).sum())
        out[i] = common >= (t - room) * (len(both) - common) - 1e-9
    return out


# ---------------------------------------------------------------- tasks


@tidy
def _features(batches):
    memo = WordHashes()
    for b in batches:
        for i in range(0, b.num_rows, 1024):
            part = b.slice(i, 1024)
            n, node, regs = [], [], []
            for raw in part.column("raw").to_pylist():
                s = shingles(raw, memo)
                n.append(len(s))
                node.append(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64)) if len(s) else None)
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("t"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(regs, pa.binary())], names=["doc_id", "t", "n", "node", "regs"])


@tidy
def _band_rows(batches):
    for b in batches:
        for i in range(0, b.num_rows, 1024):
            part = b.slice(i, 1024)
            regs = np.frombuffer(b"".join(part.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            yield pa.RecordBatch.from_arrays([part.column("node"), lists(list(bands(regs)))], names=["node", "keys"])


@tidy
def _sets(batches):
    memo = WordHashes()
    for b in batches:
        for i in range(0, b.num_rows, 512):
            part = b.slice(i, 512)
            s = [shingles(raw, memo) for raw in part.column("raw").to_pylist()]
            node = [np.uint64(xxhash.xxh3_64_intdigest(x.tobytes())).astype(np.int64) for x in s]
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array([x.tobytes() for x in s], pa.binary())], names=["node", "set"])


def _estimated(threshold: int):
    def each(batches):
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                ra, rb = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
                ok = passes((ra == rb).sum(1), part.column("na").to_numpy(), part.column("nb").to_numpy(), threshold)
                yield part.select(["a", "b"]).filter(pa.array(ok))

    return tidy(each)


def _confirmed(threshold: int):
    def each(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part, ok = b.slice(i, 256), []
                for x, y in zip(part.column("sa").to_pylist(), part.column("sb").to_pylist()):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = np.concatenate([x, y])
                    both.sort(kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    ok.append(100 * common >= threshold * (len(both) - common))
                yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return tidy(each)


def _across(threshold: int):
    """Pairs of a bucket's blocks in different components that pass the estimate, in their first band."""

    def each(batches):
        for g in runs(batches, ["key", "bi", "bj"]):
            if g.num_rows < 2:
                continue
            node, comp, n, mine = (g.column(c).to_numpy() for c in ("node", "comp", "n", "mine"))
            regs = np.frombuffer(b"".join(g.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            low = [np.frombuffer(x, np.uint64) for x in g.column("low").to_pylist()]
            keys = bands(regs)
            key = g.column("key")[0].as_py()
            band = int((keys[0].view(np.int64) == key).argmax())
            bi, bj = g.column("bi")[0].as_py(), g.column("bj")[0].as_py()
            left = np.flatnonzero(mine == bi)
            right = left if bi == bj else np.flatnonzero(mine == bj)
            found_a, found_b = [], []
            for x in left:
                other = right[(comp[right] != comp[x]) & ((node[right] > node[x]) if bi == bj else True)]
                if not len(other):
                    continue
                ok = passes((regs[other] == regs[x]).sum(1), n[other], np.broadcast_to(n[x], len(other)), threshold)
                other = other[ok]
                if len(other) and band:
                    other = other[~(keys[other][:, :band] == keys[x][:band]).any(1)]
                if len(other):
                    other = other[reach(low[x], [low[o] for o in other], threshold)]
                found_a.append(np.full(len(other), node[x]))
                found_b.append(node[other])
            if found_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))], names=["a", "b"])

    return tidy(each)


# ---------------------------------------------------------------- plan


class _Job:
    def __init__(self, docs: DataFrame, threshold: int = THRESHOLD):
        self.docs, self.spark, self.threshold = docs, docs.sparkSession, threshold
        self.scratch = Scratch(self.spark, "near")
        self.raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), F.col("text").cast("binary").alias("raw"))
        self.rows = self.scratch.store(self.raw.mapInArrow(_features, "doc_id long, t long, n long, node long, regs binary"), "rows")
        self.nodes = self.scratch.store(
            self.rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("regs").alias("regs")), "nodes"
        )

    def banded(self) -> DataFrame:
        keyed = self.nodes.select("node", "regs").mapInArrow(_band_rows, "node long, keys array<long>")
        return keyed.select("node", F.explode("keys").alias("key"))

    def estimate(self, pairs: DataFrame) -> DataFrame:
        side = self.nodes.select("node", "n", "regs")
        both = pairs.join(side.toDF("a", "na", "ra"), "a").join(side.toDF("b", "nb", "rb"), "b")
        return both.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_estimated(self.threshold), "a long, b long")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(node, set): whole shingle sets of some nodes; only their texts are read again."""
        ids = self.scratch.store(self.nodes.select("node", "doc_id").join(wanted, "node", "left_semi"), "wanted")
        ids = small(ids, ids.count())
        texts = self.raw.join(ids.select(F.col("doc_id").alias("_id")).distinct(), F.expr("doc_id <=> _id"), "left_semi")
        found = texts.select("raw").mapInArrow(_sets, "node long, set binary")
        # repeated rows and clashing ids bring texts that aren't asked for, or more than once
        return self.scratch.store(found.join(ids.select("node"), "node", "left_semi").groupBy("node").agg(F.first("set").alias("set")), "sets")

    def confirm(self, pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        """Links among ``pairs`` (a stored table), by full sets."""
        if sets is None:
            sets = self.sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
        links = self.scratch.store(both.select("a", "b", "sa", "sb").mapInArrow(_confirmed(self.threshold), "a long, b long"), "links")
        self.scratch.drop(sets)
        return links

    def components(self) -> DataFrame:
        """(node, comp) of nodes that links join to a smaller node."""
        banded = self.banded()
        shared = self.scratch.store(
            banded.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("members")).where("members > 1"), "buckets"
        )
        members = self.scratch.store(banded.join(small(shared, shared.count()), "key"), "members")
        star = members.where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
        links = self.confirm(self.scratch.store(self.estimate(star), "candidates"))
        comp = components(links, self.scratch)

        labelled = members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        open_ = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key")
        open_ = self.scratch.store(open_, "open")
        n = open_.count()
        if not n:
            return comp
        rest = self.scratch.store(labelled.join(small(open_, n), "key", "left_semi"), "rest")
        sets = self.sets(rest.select("node").distinct())
        low = sets.select("node", F.expr(f"substring(set, 1, {8 * LOWEST})").alias("low"))
        rest = rest.join(self.nodes.select("node", "n", "regs").join(low, "node"), "node")
        rest = blocked(rest, F.col("members"), F.col("node"), BLOCK)
        rest = rest.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
        across = rest.select("key", "bi", "bj", "mine", "node", "comp", "n", "regs", "low").mapInArrow(_across(self.threshold), "a long, b long")
        more = self.confirm(self.scratch.store(across, "across"), sets)
        return components(links.unionByName(more), self.scratch)

    def result(self) -> DataFrame:
        comp = self.scratch.store(self.components(), "components")
        least = self.nodes.select("node", "doc_id").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        ids = least.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
        # only nodes with several documents have another smallest id than their own
        label = least.join(ids, "comp").select("node", "component_id")
        out = self.rows.select("doc_id", "t", "n", "node").join(label, "node", "left")
        return out.select(
            "doc_id",
            "t",
            F.col("n").alias("n_shingles"),
            F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text)."""
    return _Job(docs, threshold).result().drop("t")


def keep_one(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` less all but one document of each near-duplicate component: the one it is named after.

    Of repeated rows with one ``doc_id`` and text, one stays. Texts without words stay.
    """
    job = _Job(docs, threshold)
    kept = job.result().where("kept").groupBy(F.col("doc_id").alias("id"), "t").agg(F.count("*").alias("n"))
    kept = job.scratch.store(kept, "kept")
    row = docs.select(F.struct(*docs.columns).alias("row"))  # one column, so that no name of the input can clash
    row = row.join(small(kept, kept.count()), F.expr("row.doc_id <=> id and xxhash64(row.text) = t"))
    again = row.where("n > 1").withColumn("text", F.col("row.text")).dropDuplicates(["id", "text"]).drop("text")
    return row.where("n = 1").unionByName(again).select("row.*")


def op5_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all ``documents``."""
    return near_duplicates(table(spark, sf_dir, "documents"))
