"""Operator 4, line dedup over levelled sorted runs of line hashes.

The store counts, for each line key, the documents that hold it, in runs: tables of (key hash,
documents), bucketed and sorted by hash. A batch of documents is counted and merge-anti-joined with
the runs of frequent keys, whose count cannot change a decision any more; what is left is
merge-joined with each levelled run, so that its total so far is known, and becomes a run: keys that
reach ``min_docs`` are known as frequent from there on, the others are a new run of level 0. A level of ``FANOUT``
runs is compacted: merge-joined into one run of the next level, counts summed. Runs share their
buckets, so only the batch is shuffled, never a run.

Documents are read once for their lines' hashes, which are stored; batches and the search for
frequent lines work on those. The last pass cuts the dropped places out of the texts that have some.

Only DataFrame functions. Keys are 128-bit hashes (two 64-bit hashes of different seeds), so a run
never stores text. Counting first takes a document's distinct keys and aggregates on the map side,
so a line that a third of all documents hold costs a row for each task. The frequent keys are
broadcast only if their counted number is within a bound; else the join shuffles and Spark splits
hot keys.

A null or empty text is one empty line. Repeated rows with one ``doc_id`` count as documents of
their own. Very long texts are one row in a task. Empty tables give empty results; extra columns
pass through unless named like an added one, which then replaces them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, hash128, small, table

FANOUT = 2
MIN_DOCS = 10
MIN_CODE_POINTS = 1
#: Batches in which the query feeds the store.
BATCHES = 3
_SPACE = " \t\n\x0b\x0c\r"


def line_keys(text: Column) -> Column:
    """Each line of a text without ASCII white space at its ends, A-Z lower-cased."""
    return F.transform(F.split(ascii_lower(text), "\n", -1), lambda x: F.trim(x, F.lit(_SPACE)))


def key_hashes(docs: DataFrame, least: int = MIN_CODE_POINTS) -> DataFrame:
    """(t1, t2, keys) of ``docs`` (text): its hash, and those of its lines, null for short keys."""
    text = F.coalesce(F.col("text"), F.lit(""))
    t1, t2 = hash128(text)
    k = lambda x: F.struct(*[h.alias(n) for h, n in zip(hash128(x), ("h1", "h2"))])
    return docs.select(t1.alias("t1"), t2.alias("t2"), F.transform(line_keys(text), lambda x: F.when(F.length(x) >= least, k(x))).alias("keys"))


class LineRuns:
    """Levelled runs of (h1, h2, docs) in shared storage, and runs of the frequent keys (h1, h2)."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, min_code_points: int = MIN_CODE_POINTS):
        self.spark, self.min_docs, self.least = spark, min_docs, min_code_points
        self.scratch = Scratch(spark, "line-runs")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []
        self.known: list[DataFrame] = []
        self.tables: list[str] = []

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def _run(self, df: DataFrame) -> DataFrame:
        """``df`` as a run: one file for each bucket, sorted by hash."""
        name = f"line_run_{uuid.uuid4().hex}"
        (
            df.repartition(self.buckets, "h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
            .option("path", f"{self.scratch.root}/{name}").saveAsTable(name)
        )
        self.tables.append(name)
        return self.spark.table(name)

    def close(self) -> None:
        """Drop all runs and their files; what :meth:`dropped` stored stays."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.scratch.remove(f"{self.scratch.root}/{name}")
        self.levels, self.known, self.tables = [], [], []

    def frequent(self) -> DataFrame | None:
        """(h1, h2) of keys in at least ``min_docs`` documents so far."""
        out = None
        for k in self.known:
            out = k if out is None else out.unionByName(k)
        return out

    def add(self, keyed: DataFrame) -> None:
        """Count a batch of :func:`key_hashes` and add its run, without keys that are frequent."""
        own = F.explode(F.array_distinct(F.filter("keys", lambda k: k.isNotNull())))
        batch = keyed.select(own.alias("k")).groupBy(F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2")).agg(F.count("*").alias("docs"))
        for k in self.known:
            batch = batch.join(k.hint("merge"), ["h1", "h2"], "left_anti")
        batch = batch.withColumn("total", F.col("docs"))
        for r in self.runs():
            batch = batch.join(r.withColumnRenamed("docs", "before").hint("merge"), ["h1", "h2"], "left")
            batch = batch.select("h1", "h2", "docs", (F.col("total") + F.coalesce("before", F.lit(0))).alias("total"))
        run = self._run(batch)
        self.known.append(run.where(F.col("total") >= self.min_docs).select("h1", "h2"))
        if len(self.known) > FANOUT:
            self.known = [self._run(self.frequent())]
        self._put(0, run.where(F.col("total") < self.min_docs).select("h1", "h2", "docs"))

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == FANOUT:
            old, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._run(self._merged(old)))

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for r in runs[1:]:
            both = out.hint("merge").join(r.withColumnRenamed("docs", "more"), ["h1", "h2"], "full")
            out = both.select("h1", "h2", (F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("docs"))
        return out

    def dropped(self, keyed: DataFrame) -> DataFrame | None:
        """(t1, t2, drop) of the texts of ``keyed`` with frequent lines: their places, ascending."""
        known = self.frequent()
        n = 0 if known is None else known.count()
        if not n:
            return None
        at = keyed.select("t1", "t2", F.posexplode("keys").alias("pos", "k")).select("t1", "t2", "pos", F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2"))
        # by text hash, so equal texts are looked up once
        at = at.join(small(known, n), ["h1", "h2"], "left_semi").groupBy("t1", "t2").agg(F.array_sort(F.collect_set("pos")).alias("drop"))
        return self.scratch.store(at, "dropped")

    def dedup(self, docs: DataFrame, keyed: DataFrame) -> DataFrame:
        """``docs`` with ``text`` less its frequent lines, ``n_lines`` before and ``n_dropped``."""
        names = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "text")]
        # the other columns are one, so that no name of the input can clash
        d = docs.select(F.struct(F.lit(0).alias("_"), *names).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
        gone = self.dropped(keyed)
        if gone is None:
            d = d.withColumn("drop", F.lit(None).cast("array<int>"))
        else:
            t1, t2 = hash128(F.col("text"))
            # by a merge join at any size, so that memory and shuffle grow alike
            d = d.withColumns({"t1": t1, "t2": t2}).join(gone.hint("merge"), ["t1", "t2"], "left")
        d = d.withColumn("lines", F.when(F.col("drop").isNotNull(), F.split("text", "\n", -1)))
        begin = F.concat(F.array(F.lit(0)), F.transform("drop", lambda x: x + 1))
        end = F.concat(F.col("drop"), F.array(F.size("lines")))
        left = F.flatten(F.zip_with(begin, end, lambda a, b: F.slice("lines", a + 1, b - a)))
        text = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
        n_lines = (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
        out = d.select("row", text.alias("text"), n_lines.alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"))
        return out.select(*[F.col(f"row.{c}").alias(c) if c != "text" else F.col("text") for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")


def dedup(docs: DataFrame, batches: int = BATCHES, **settings) -> DataFrame:
    """Feed ``docs`` to a new store in ``batches`` by text hash, then drop frequent lines."""
    store = LineRuns(docs.sparkSession, **settings)
    try:
        keyed = store.scratch.store(key_hashes(docs, store.least), "keys")
        for i in range(batches):
            store.add(keyed.where(F.pmod("t1", F.lit(batches)) == i) if batches > 1 else keyed)
        return store.dedup(docs, keyed)  # reads what is stored by now, no run
    finally:
        store.close()


def op4_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` less the lines that at least ten of them hold."""
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, i, ls[i] AS line, translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM (SELECT rid, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
f AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10),
k AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (f.key IS NOT NULL) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL), '') AS kept
      FROM l LEFT JOIN f USING (key) GROUP BY rid)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN k USING (rid)
"""
