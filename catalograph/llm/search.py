"""Operator 12, ranked lexical search by scanning documents with an Aho-Corasick automaton.

The distinct terms of a block of items make one automaton, each with a guard (a separator) at both
ends, so that it matches whole terms only. Tasks run it over each whole text and count every term
of every item at once; texts are bytes by then, with A-Z lower-cased and each separator made the
guard, so no document is ever tokenised into rows and no index of documents is built. What the scan
gives for a document (its number of terms, and the counts of the items' terms) is a table in the
shared folder; document frequencies and totals come from it. A second pass over that table maps the
automaton's outputs to items, adds up integer scores, and keeps each item's best documents of its
partition, which a window ranks at last.

Items are read in blocks by a hash of their id, as many as keep a block near ``PAIRS`` terms and
``ITEMS`` items, so that broadcasts stay bounded whatever the number of items; each block scans all
documents. A single item with more terms than that is a block's excess: it is one text.

Null or empty texts have no terms: such documents count nowhere and such items have no rows. Rows
with one ``item_id`` are one item with all their terms; rows with one ``doc_id`` are documents of
their own. Equal scores rank by ascending ``doc_id`` (null first), an integer. Empty tables give
an empty result. Other columns are ignored, whatever their names. A text is one value in a task,
however long.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, lists, table, tidy

#: Documents that an item keeps.
TOP = 10
#: Distinct terms of items, and items, that a block has about.
PAIRS, ITEMS = 1_000_000, 65_536
#: Sums of scores that a task holds at once, and candidates that it gathers before it ranks them.
SLOTS, GATHERED = 2_000_000, 200_000
#: A document without an id.
NO_ID = -(1 << 63)

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes as the automaton reads them: A-Z lower-cased, separators blank.
FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms(text: Column) -> Column:
    """The terms of a text, with repeats."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda t: t != "")


class Machine:
    """The automaton of a block's terms; its outputs are their numbers."""

    def __init__(self, words: list[str]):
        self.found = ahocorasick.Automaton()
        for i, w in enumerate(words):
            self.found.add_word(f" {w.encode().decode('latin-1')} ", i)
        self.found.make_automaton()
        self.empty = not words

    def count(self, text: str) -> tuple[int, Counter]:
        """Number of a text's terms, and occurrences of each known one."""
        raw = text.encode().translate(FOLD)
        n = len(raw.split())
        if not n or self.empty:
            return n, Counter()
        return n, Counter(map(itemgetter(1), self.found.iter(f" {raw.decode('latin-1')} ")))


_HELD: dict[str, Machine] = {}


def _machine(key: str, shared) -> Machine:
    """This worker's automaton of a block."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Machine(shared.value)
    return _HELD[key]


def scan(docs: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, n, terms, tf) of each document: its number of terms, and those of ``words`` it holds."""
    shared, key = docs.sparkSession.sparkContext.broadcast(words), uuid.uuid4().hex

    @tidy
    def each(batches):
        machine = _machine(key, shared)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                got = [machine.count(t or "") for t in part.column("text").to_pylist()]
                own = [np.fromiter(c.keys(), np.int32, len(c)) for _, c in got]
                tf = [np.fromiter(c.values(), np.int32, len(c)) for _, c in got]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n for n, _ in got], pa.int64()), lists(own, np.int32), lists(tf, np.int32)], names=["doc_id", "n", "terms", "tf"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, n long, terms array<int>, tf array<int>")


class Best:
    """The best documents of each item so far."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.ones(items, np.int64)
        self.item = self.score = self.doc = np.zeros(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        good = score >= self.least[item]
        self.new.append((item[good], score[good], doc[good]))
        self.size += int(good.sum())
        if self.size > GATHERED:
            self.rank()

    def rank(self) -> None:
        item, score, doc = (np.concatenate([held, *new]) for held, new in zip((self.item, self.score, self.doc), zip(*self.new) if self.new else ((), (), ())))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if len(item) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(item)))
        rank = np.arange(len(item)) - np.repeat(first, size)
        last = rank == self.top - 1
        self.least[item[last]] = score[last]
        kept = rank < self.top
        self.item, self.score, self.doc, self.new, self.size = item[kept], score[kept], doc[kept], [], 0


def _scored(shared, top: int):
    """Mapper of :func:`scan`'s rows: each item's best documents of the partition."""

    @tidy
    def each(batches):
        ids, weight, start, item, times, n_docs, total = shared.value
        best = Best(len(ids), top)
        step = max(1, SLOTS // max(1, len(ids)))
        for b in batches:
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                doc = part.column("doc_id").fill_null(NO_ID).to_numpy()
                m = 25 + 75 * part.column("n").to_numpy() * n_docs // total
                own = part.column("terms")
                t, tf = own.flatten().to_numpy(), part.column("tf").flatten().to_numpy().astype(np.int64)
                row = np.repeat(np.arange(len(doc)), own.value_lengths().to_numpy())
                worth = weight[t] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
                n = start[t + 1] - start[t]
                place = np.repeat(start[t] - np.cumsum(n) + n, n) + np.arange(n.sum())
                score = np.zeros(len(doc) * len(ids), np.int64)
                np.add.at(score, np.repeat(row * len(ids), n) + item[place], np.repeat(worth, n) * times[place])
                at = np.flatnonzero(score)
                best.add(at % len(ids), score[at], doc[at // len(ids)])
        best.rank()
        doc = pa.array(best.doc, mask=best.doc == NO_ID)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(best.item)), doc, pa.array(best.score)], names=["item_id", "doc_id", "score"])

    return each


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of ``docs`` (doc_id, text) for each of ``items`` (item_id, text)."""
    scratch = Scratch(docs.sparkSession, "search")
    kind = items.schema["item_id"].dataType.simpleString()
    held = items.select("item_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times"))
    held = scratch.store(held.withColumn("h", F.xxhash64("item_id")), "items")
    pairs, n_items = held.agg(F.count("*"), F.count_distinct("h")).first()
    blocks = max(1, math.ceil(pairs / PAIRS), math.ceil(n_items / ITEMS))
    out = [_block(scratch, docs, held.where(F.pmod("h", F.lit(blocks)) == k).drop("h"), top) for k in range(blocks) if pairs]
    best = docs.sparkSession.createDataFrame([], f"item_id {kind}, doc_id long, score long")
    for one in out:
        best = best.unionByName(one)
    place = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def _block(scratch: Scratch, docs: DataFrame, held: DataFrame, top: int) -> DataFrame:
    """Each item's best documents in each partition."""
    spark = docs.sparkSession
    own = held.orderBy("term", "item_id").toArrow()  # bounded: see PAIRS
    words, codes = (lambda d: (d.dictionary.to_pylist(), d.indices.to_numpy()))(own.column("term").combine_chunks().dictionary_encode())
    ids = own.column("item_id").combine_chunks().dictionary_encode("encode")
    start = np.searchsorted(codes, np.arange(len(words) + 1))
    found = scratch.store(scan(docs, words), "counts")
    stats = found.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    df = np.zeros(len(words), np.int64)
    for t, n in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term of the block
        df[t] = n
    weight = np.array([math.floor(1000 * math.log((2 * stats[0] + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    shared = spark.sparkContext.broadcast((ids.dictionary, weight, start, ids.indices.to_numpy().astype(np.int64), own.column("times").to_numpy(), stats[0], max(1, stats[1] or 0)))
    return found.where(F.size("terms") > 0).mapInArrow(_scored(shared, top), f"item_id {held.schema['item_id'].dataType.simpleString()}, doc_id long, score long")


def op12_aho_corasick_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all ``documents`` for each item of ``benchmark``."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
t AS (SELECT rid, doc_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
tf AS (SELECT rid, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
size AS (SELECT rid, count(*) AS n FROM t GROUP BY rid),
all_docs AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS total FROM size),
q AS (SELECT item_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, all_docs GROUP BY term, n_docs),
s AS (SELECT q.item_id, tf.rid, tf.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // total)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN size USING (rid), all_docs GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""
