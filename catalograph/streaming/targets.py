"""Tables that streams keep up to date at the cost of what changes.

A table is cut into buckets by a hash of its key. A batch writes its own rows only, one folder with a
file for each bucket that it touches; a reader merges a bucket's base with its later folders. A
manifest, one small file for each batch, names each bucket's folders; it appears at once, by a rename,
and a reader sees the table as one manifest says. A bucket with many folders is compacted into a new
base by itself, when its deltas are worth the rewrite, and others aren't touched.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Folders of a bucket after its base from which on it may be compacted, and from which on it is in any case.
MANY, MOST = 4, 32
#: A compaction is due when the deltas have at least this share of the base's bytes.
SHARE = 0.5


def newest(keys: list[str], version: str) -> Callable[[DataFrame], DataFrame]:
    """Merge rule: the highest version of a key; of equal ones the latest batch's, then the greatest by all columns."""
    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in keys]
        order = F.struct(F.col(version), F.col("_seq"), F.to_json(F.struct(*rest)))
        top = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r"))
        return top.select(*[F.col(c) if c in keys else F.col("r")[c].alias(c) for c in rows.columns])

    return merge


def widest(keys: list[str], start: str = "start_date", end: str = "end_date") -> Callable[[DataFrame], DataFrame]:
    """Merge rule: the range around all of a key's ranges; a null end is open and stays so."""
    def merge(rows: DataFrame) -> DataFrame:
        closed = F.count(F.when(F.col(end).isNull(), 1)) == 0
        out = rows.groupBy(*keys).agg(F.min(start).alias(start), F.when(closed, F.max(end)).alias(end), F.max("_seq").alias("_seq"))
        return out.select(*rows.columns)

    return merge


class TargetTable:
    """A table at ``path`` with a key, kept by batches of rows and a merge rule.

    ``merge`` takes rows with a column ``_seq``, the batch they came with, and gives one row for each
    key; it must give the same whatever part of a key's rows was merged before. A batch that is run
    again changes nothing. The number of buckets is fixed when the table is made: one for each GB or so.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], merge: Callable[[DataFrame], DataFrame], buckets: int = 16):
        self.spark, self.path, self.keys, self.merge, self.buckets = spark, path.rstrip("/"), keys, merge, buckets
        self.schema = schema
        self.held = StructType([*schema.fields, StructField("_seq", LongType())])

    # files

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        p, fs = self._fs(path)
        return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []

    def _bytes(self, paths: list[str]) -> int:
        total = 0
        for path in paths:
            p, fs = self._fs(path)
            total += fs.getContentSummary(p).getLength()
        return total

    def manifest(self) -> dict:
        """Of the last batch: its number, and each bucket's folders, base first; -1 and none at first."""
        done = [int(n) for n in self._names(f"{self.path}/manifest") if n.isdigit()]
        if not done:
            return {"batch": -1, "buckets": {}}
        p, fs = self._fs(f"{self.path}/manifest/{max(done)}")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _switch(self, manifest: dict) -> None:
        """Make a manifest the current one; it is there as a whole or not at all."""
        number = manifest["batch"]
        part, fs = self._fs(f"{self.path}/manifest/_{number}")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        whole, _ = self._fs(f"{self.path}/manifest/{number}")
        fs.rename(part, whole)

    # reading

    def version(self) -> int:
        """The last batch, -1 without one."""
        return self.manifest()["batch"]

    def read(self) -> DataFrame:
        """The table after the last batch; what is read stays as it was while later batches run, but for the one before last."""
        return self._rows(self.manifest()["buckets"]).select(*self.schema.names)

    def _rows(self, folders: dict[str, list[str]]) -> DataFrame:
        """Rows of buckets with their batch, merged where a bucket has several folders."""
        def load(some: list[tuple[str, list[str]]]) -> DataFrame:
            paths = [f"{self.path}/{f}/_bucket={k}" for k, own in some for f in own]
            return self.spark.read.schema(self.held).parquet(*paths) if paths else self.spark.createDataFrame([], self.held)

        lone, several = [x for x in folders.items() if len(x[1]) == 1], [x for x in folders.items() if len(x[1]) > 1]
        if not several:
            return load(lone)
        merged = self.merge(load(several))
        return load(lone).unionByName(merged) if lone else merged

    # writing

    def _write(self, rows: DataFrame, folder: str) -> list[str]:
        """One file for each bucket of ``rows``, which have one row for each key; the buckets written."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        out = rows.select(*self.held.names).withColumn("_bucket", bucket).repartition("_bucket")
        out.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        return [n.split("=")[1] for n in self._names(f"{self.path}/{folder}") if n.startswith("_bucket=")]

    def apply(self, rows: DataFrame, batch: int) -> None:
        """Add a batch's rows, then compact what is due. Nothing for a batch that was applied before."""
        now = self.manifest()
        if batch <= now["batch"]:
            return
        own = self.merge(rows.select(*self.schema.names).withColumn("_seq", F.lit(batch).cast("long")))
        buckets = {k: list(v) for k, v in now["buckets"].items()}
        for k in self._write(own, f"delta-{batch}"):
            buckets.setdefault(k, []).append(f"delta-{batch}")
        due = {k: v for k, v in buckets.items() if len(v) > MANY and self._due(k, v)}
        if due:
            self._write(self._rows(due), f"base-{batch}")  # every row of these buckets falls into its bucket again
            buckets |= {k: [f"base-{batch}"] for k in due}
        self._switch({"batch": batch, "buckets": buckets})
        self._clean(now, buckets)

    def _due(self, bucket: str, folders: list[str]) -> bool:
        at = [f"{self.path}/{f}/_bucket={bucket}" for f in folders]
        return len(folders) > MOST or self._bytes(at[1:]) >= SHARE * self._bytes(at[:1])

    def _clean(self, before: dict, buckets: dict) -> None:
        """Drop folders that neither this manifest nor the one before names, and older manifests."""
        used = {f for own in (*before["buckets"].values(), *buckets.values()) for f in own}
        for name in self._names(self.path):
            if name.startswith(("delta-", "base-")) and name not in used:
                p, fs = self._fs(f"{self.path}/{name}")
                fs.delete(p, True)
        for name in self._names(f"{self.path}/manifest"):
            if name.isdigit() and int(name) < before["batch"]:
                p, fs = self._fs(f"{self.path}/manifest/{name}")
                fs.delete(p, False)
