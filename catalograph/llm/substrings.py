"""Operator 8, substring dedup by seed and extend.

Seeds: of each window of 35 words the smallest of its 12-word hashes is an anchor (winnowing), so
two equal windows share their anchor at the same place. Anchors that occur once seed nothing; the
others are matched by an equi-join.

Extension: a shared anchor is extended to both sides over the windows that hold it as theirs, which
gives a segment: up to 24 windows in a row, 35 to 58 words. Documents are joined on whole segments
first: those with equal words are one class, and all of a class that occurs twice is repeated. What
differs somewhere on either side is joined window by window, against the other segments and one
representative of each class. Repeated windows that touch or overlap merge into maximal repeats
(:func:`repeats`), and their words are removed.

No pairs of documents are formed: segments are met by their class, a star, so a passage that a third
of all documents hold costs a row for each occurrence of a segment and no more. Copies first
collapse: rows with one word sequence are one node; of several rows with one sequence of 35 words
or more every word occurs elsewhere.

Null or empty texts have no words. Repeated rows are copies of each other. A null ``doc_id`` is a
value like another; ``doc_id`` is an integer, or text that reads as one. An empty table gives an empty result. Columns other than ``doc_id`` and ``text``
are ignored, whatever their names. A text is one value in a task, with some ten times its size in
hashes while it is read. Texts, windows and segments are equal if their 128-bit hashes are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, WordHashes, grams, lists, mix, signed, small, table, tidy

WINDOW = 35
GRAM = 12
SPAN = WINDOW - GRAM + 1
#: Segment classes whose windows a task remembers to have given out; beyond it they come again, to no harm.
SEEN = 200_000


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` neighbours, by doubling."""
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if have < w else x


def window_anchors(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of 12-word hashes: each window's anchor hash, and which places are an anchor of some window."""
    m = sliding_min(g, SPAN)
    padded = np.concatenate([np.zeros(SPAN - 1, np.uint64), m, np.zeros(SPAN - 1, np.uint64)])
    most = ~sliding_min(~padded, SPAN)  # the largest minimum of the windows that hold a place
    return m, most == g


def segments(m: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each segment: windows in a row with one shared anchor
    hash, ``SPAN`` at most (in periodic text an anchor hash may rule longer)."""
    at = np.flatnonzero(np.isin(m, shared))
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (m[at[1:]] != m[at[:-1]])
    first = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    cut = np.flatnonzero(place % SPAN == 0)
    return at[cut], np.diff(np.append(cut, len(at)))


def node_of(w: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(w))


@tidy
def _features(batches):
    """Of each row: number of words, hashes of the word sequence, and its anchors.

    An anchor hash comes once for a row, or twice if the row has it at several places.
    """
    memo = WordHashes()
    for b in batches:
        for i in range(0, b.num_rows, 1024):
            part = b.slice(i, 1024)
            n, node, sha, anchors = [], [], [], []
            for raw in part.column("raw").to_pylist():
                w = (raw or b"").split()
                n.append(len(w))
                joined = b" ".join(w)
                sha.append(hashlib.sha256(joined).hexdigest())
                node.append(xxhash.xxh3_128_digest(joined) if w else None)
                if len(w) >= WINDOW:
                    g = grams(memo.of(w), GRAM)
                    own, times = np.unique(g[window_anchors(g)[1]], return_counts=True)
                    anchors.append(np.concatenate([own, own[times > 1]]))
                else:
                    anchors.append(np.zeros(0, np.uint64))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(sha), lists(anchors)], names=["doc_id", "n_words", "node", "sha", "anchors"]
            )


@tidy
def _segments(batches):
    """Each segment of a text: its place, its class and, once for each class in a task, its windows."""
    memo, seen = WordHashes(), set()
    names = ["node", "start", "span", "c1", "c2", "w1", "w2"]
    for b in batches:
        for i in range(0, b.num_rows, 256):
            part = b.slice(i, 256)
            nodes, columns, fresh, w1, w2 = [], [], [], [], []
            for node, raw, shared in zip(part.column("node").to_pylist(), part.column("raw").to_pylist(), part.column("shared")):
                w = raw.split()
                if node_of(w) != node:
                    continue  # another row with this doc_id
                h = memo.of(w)
                start, span = segments(window_anchors(grams(h, GRAM))[0], shared.values.to_numpy().view(np.uint64))
                if not len(start):
                    continue
                one, two = grams(h, WINDOW), grams(mix(h ^ np.uint64(0x9E3779B97F4A7C15)), WINDOW)
                # the first and the last window hold all words of a segment
                ends = [mix(x[start] * np.uint64(0xC2B2AE3D27D4EB4F) + mix(x[start + span - 1] + span.astype(np.uint64))) for x in (one, two)]
                nodes += [node] * len(start)
                columns.append((start, span, *ends))
                for s, k, *key in zip(start.tolist(), span.tolist(), ends[0].tolist(), ends[1].tolist()):
                    key = tuple(key)
                    new = key not in seen
                    if new and len(seen) < SEEN:
                        seen.add(key)
                    fresh.append(k if new else 0)
                    if new:
                        w1.append(one[s : s + k])
                        w2.append(two[s : s + k])
            if not nodes:
                continue
            start, span, c1, c2 = (np.concatenate(c) for c in zip(*columns))
            offsets = pa.array(np.concatenate([[0], np.cumsum(fresh)]).astype(np.int32))
            windows = [pa.ListArray.from_arrays(offsets, signed(np.concatenate(x) if x else np.zeros(0, np.uint64))) for x in (w1, w2)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(start.astype(np.int32)), pa.array(span.astype(np.int32)), signed(c1), signed(c2), *windows], names=names)


@tidy
def _removed(batches):
    """Of each text: how many words its maximal repeats cover, where they are, and what is left."""
    for b in batches:
        for i in range(0, b.num_rows, 512):
            part = b.slice(i, 512)
            out = [[], [], [], []]
            for node, raw, found in zip(part.column("node").to_pylist(), part.column("raw").to_pylist(), part.column("found")):
                w = raw.split()
                if node_of(w) != node:
                    continue
                start, span = (found.values.field(k).to_numpy() for k in ("start", "span"))
                edge = np.zeros(len(w) + 1, np.int32)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + span + (WINDOW - 1), -1)
                gone = np.cumsum(edge[:-1]) > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                kept = b" ".join([w[j] for j in np.flatnonzero(~gone)])
                for c, v in zip(out, (node, int(gone.sum()), turn.astype(np.int32), kept.decode())):
                    c.append(v)
            node, n, turns, kept = out
            yield pa.RecordBatch.from_arrays(
                [pa.array(node, pa.binary()), pa.array(n, pa.int64()), lists(turns, np.int32), pa.array(kept, pa.string())], names=["node", "n_removed", "turns", "kept"]
            )


class RepeatedWindows:
    """The passages of ``docs`` (doc_id, text) that occur more than once."""

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        self.scratch = Scratch(self.spark, "repeats")
        self.raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
        self.rows = self.scratch.store(self.raw.mapInArrow(_features, "doc_id long, n_words long, node binary, sha string, anchors array<long>"), "rows")
        self.nodes = self.scratch.store(
            self.rows.where("node is not null")
            .groupBy("node")
            .agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n_words").alias("n_words"), F.first("anchors").alias("anchors")),
            "nodes",
        )

    def texts(self) -> DataFrame:
        """(node, raw, shared): text and shared anchors of each node that has some."""
        at = self.nodes.select("node", "doc_id", F.explode("anchors").alias("h"))
        shared = self.scratch.store(at.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "anchors")
        sets = self.scratch.store(at.join(shared.hint("merge"), "h", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.collect_set("h").alias("shared")), "shared")
        ids = self.scratch.store(sets.select(F.col("doc_id").alias("_id")).distinct(), "ids")
        raw, n = self.raw.where("raw is not null"), ids.count()
        if n <= BROADCAST_ROWS:  # beyond it, the join alone
            raw = raw.join(small(ids, n), F.expr("doc_id <=> _id"), "left_semi")
        held = raw.join(sets.withColumnRenamed("doc_id", "_id"), F.expr("doc_id <=> _id")).select("node", "raw", "shared")
        texts = self.scratch.store(held, "texts")
        for done in (shared, sets, ids):
            self.scratch.drop(done)
        return texts

    def kept(self) -> DataFrame:
        """(node, n_removed, turns, kept) of nodes that lose words to a repeat; ``turns`` has the
        first word of each maximal repeat and the first one after it, in turn.

        Tables that a hot key is joined with are stored, not aggregates, so that Spark can split it;
        these joins are merge joins at any size.
        """
        texts = self.texts()
        found = texts.mapInArrow(_segments, "node binary, start int, span int, c1 long, c2 long, w1 array<long>, w2 array<long>")
        found = self.scratch.store(found, "segments")
        classes = found.groupBy("c1", "c2").agg(F.count("*").alias("n")).where("n > 1").select("c1", "c2")
        classes = self.scratch.store(classes, "classes")
        whole = found.select("node", "start", "span", "c1", "c2").join(classes.hint("merge"), ["c1", "c2"], "left_semi").select("node", "start", "span")
        given = found.where("size(w1) > 0").join(classes.withColumn("copied", F.lit(True)).hint("merge"), ["c1", "c2"], "left")
        given = given.select("node", "start", F.coalesce("copied", F.lit(False)).alias("copied"), F.posexplode(F.arrays_zip("w1", "w2")).alias("i", "x"))
        at = given.select("node", (F.col("start") + F.col("i")).alias("start"), "copied", F.col("x.w1").alias("w1"), F.col("x.w2").alias("w2"))
        at = self.scratch.store(at, "windows")
        twice = at.groupBy("w1", "w2").agg(F.sum(F.when(F.col("copied"), 2).otherwise(1)).alias("n"), F.min("copied").alias("all"))
        twice = self.scratch.store(twice.where("n > 1 and not all").select("w1", "w2"), "twice")
        parts = at.where("not copied").join(twice.hint("merge"), ["w1", "w2"], "left_semi").select("node", "start", F.lit(1).alias("span"))
        held = whole.unionByName(parts).groupBy("node").agg(F.collect_list(F.struct("start", "span")).alias("found"))
        return texts.select("node", "raw").join(held, "node").mapInArrow(_removed, "node binary, n_removed long, turns array<int>, kept string")


def repeats(docs: DataFrame) -> DataFrame:
    """The maximal repeats of ``docs`` (doc_id, text): doc_id, start, end, in words, end exclusive.

    All rows of a text are given; of one that several rows share, the whole text is a repeat.
    """
    job = RepeatedWindows(docs)
    turns = job.kept().groupBy("node").agg(F.first("turns").alias("turns"))
    rows = job.rows.select("doc_id", "n_words", "node").join(job.nodes.select("node", "copies"), "node").join(turns, "node", "left")
    copied = (F.col("copies") > 1) & (F.col("n_words") >= WINDOW)
    ends = F.when(copied, F.array(F.lit(0), F.col("n_words").cast("int"))).otherwise(F.col("turns"))
    pair = F.transform(F.sequence(F.lit(0), F.size("ends") - 2, F.lit(2)), lambda k: F.struct(F.get("ends", k).alias("start"), F.get("ends", k + 1).alias("end")))
    held = rows.withColumn("ends", ends).where("size(ends) > 0")
    return held.select("doc_id", F.explode(pair).alias("x")).select("doc_id", "x.start", "x.end")


def dedup(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, n_repeats, kept_sha256."""
    job = RepeatedWindows(docs)
    gone = job.kept().groupBy("node").agg(F.first("n_removed").alias("n_removed"), F.first((F.size("turns") / 2).cast("long")).alias("n_repeats"), F.first(F.sha2("kept", 256)).alias("kept_sha"))
    gone = job.scratch.store(gone, "gone")
    copies = job.nodes.select("node", "copies", "n_words").where(f"copies > 1 and n_words >= {WINDOW}").select("node", F.lit(True).alias("copied"))
    info = gone.join(copies, "node", "full")
    none = hashlib.sha256(b"").hexdigest()
    return (
        job.rows.drop("anchors")
        .join(info, "node", "left")
        .select(
            "doc_id",
            "n_words",
            F.when(F.col("copied"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(F.col("copied"), F.lit(1)).otherwise(F.coalesce("n_repeats", F.lit(0))).cast("long").alias("n_repeats"),
            F.when(F.col("copied"), F.lit(none)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
        )
    )


def op8_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` less every word of a 35-word passage that occurs elsewhere too."""
    return dedup(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT rid, unnest(range(1, len(w) + 1)) AS i, w FROM d),
x AS (SELECT rid, i, w[i] AS word, CASE WHEN i + 34 <= len(w) THEN array_to_string(w[i:i+34], ' ') END AS win FROM p),
r AS (SELECT win FROM x WHERE win IS NOT NULL GROUP BY win HAVING count(*) > 1),
f AS (SELECT rid, i, word, max(CASE WHEN r.win IS NOT NULL THEN 1 END) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
      FROM x LEFT JOIN r ON x.win = r.win),
s AS (SELECT rid, i, word, gone, lag(gone) OVER (PARTITION BY rid ORDER BY i) AS was FROM f),
k AS (SELECT rid, count(*) FILTER (gone IS NOT NULL) AS n_removed, count(*) FILTER (gone IS NOT NULL AND was IS NULL) AS n_repeats,
             coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone IS NULL), '') AS kept FROM s GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(n_repeats, 0) AS n_repeats, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""
