"""Operator 2, secret scans by an incremental blob ledger.

Every historical version of a path is content-addressed (SHA-256 of its text). A ledger table in
shared storage holds one row for each (blob, rule set version) already scanned, with the spans
found. A scan hashes the versions, anti-joins their distinct blobs with the ledger, runs the rules
over the unseen ones only, appends their rows, and joins findings back to every path that holds
the blob. A new rule version makes every blob unseen for that version alone.

Null texts are empty. Repeated rows each get their own row of the result; an empty table gives an
empty result. Extra columns pass through, less those named like one of the ledger's. A text is one
value in a task, however long.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir, table

# Kind, pattern, group measured, least length. The first three are the base kinds of
# the contract in its order; the others are published credential formats.
RULES = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
]
BASE = ("assign", "access", "hex")
#: Kinds whose letters match in either case.
EITHER_CASE = {"assign"}
RULES_VERSION = "2"

LEDGER = T.StructType(
    [T.StructField("blob", T.StringType()), T.StructField("rules", T.StringType())]
    + [T.StructField(f"n_{k}", T.LongType()) for k in BASE]
    + [T.StructField("base", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_spans", T.LongType())]
)


#: A run of the characters that web tokens are made of, and dots inside it; it always takes the whole run.
_DOTTED = re.compile(r"[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++)*+")


def web_tokens(text: str):
    """(start, end) of the matches of the jwt rule, in one pass over the text.

    The rule itself would look for a dot from each ``eyJ`` of a long run anew.
    """
    if ".eyJ" not in text:
        return
    for m in _DOTTED.finditer(text):
        if ".eyJ" not in m[0]:
            continue
        parts, at, k = m[0].split("."), m.start(), 0
        while k + 2 < len(parts):
            head = parts[k].find("eyJ", 0, len(parts[k]) - 1)
            if head >= 0 and parts[k + 1].startswith("eyJ") and len(parts[k + 1]) > 3:
                end = at + sum(map(len, parts[k : k + 3])) + 2
                yield at + head, end
                at, k = end + 1, k + 3
            else:
                at, k = at + len(parts[k]) + 1, k + 1


def find(text: str, compiled: list) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of each span, in code points."""
    out = []
    for rank, (pattern, group, least) in enumerate(compiled):
        if pattern is web_tokens:
            out += [(a, rank, b) for a, b in web_tokens(text) if b - a >= least]
            continue
        for m in pattern.finditer(text):
            a, b = m.span(group)
            if b - a >= least:
                out.append((m.start(), rank, m.end()))
    out.sort()
    return out


def _compiled(rules):
    # a run of too few characters need not be reported, but it still consumes its text: plain
    # greedy runs can be asked for their least length at once, since a run is maximal either way
    out = []
    for kind, pattern, group, least in rules:
        if kind == "jwt":
            out.append((web_tokens, group, least))
            continue
        if group == 0 and pattern == r"[0-9a-f]+":
            pattern = rf"[0-9a-f]{{{least},}}"
        out.append((re.compile(pattern, re.A | (re.I if kind in EITHER_CASE else 0)), group, least))
    return out


def _scanner(rules: list, version: str):
    kinds = [r[0] for r in rules]

    def scan(batches):
        compiled = _compiled(rules)
        for b in batches:
            rows = {f.name: [] for f in LEDGER}
            for blob, text in zip(b.column("blob").to_pylist(), b.column("text").to_pylist()):
                spans = find(text, compiled)
                said = [(kinds[r], f"{kinds[r]}:{s}:{e}") for s, r, e in spans]
                rows["blob"].append(blob)
                rows["rules"].append(version)
                for k in BASE:
                    rows[f"n_{k}"].append(sum(1 for x, _ in said if x == k))
                rows["base"].append(",".join(x for k, x in said if k in BASE))
                rows["spans"].append(",".join(x for _, x in said))
                rows["n_spans"].append(len(said))
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([(f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for f in LEDGER]))

    return scan


class BlobLedger:
    """The table of scanned blobs at ``path``; None: a new one in the session's shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}"

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(LEDGER).parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], LEDGER)

    def scan(self, versions: DataFrame, rules: list | None = None, version: str = RULES_VERSION) -> int:
        """Scan the unseen blobs of ``versions`` (text) under ``version``; how many rows it added.

        Copies shuffle as a key and one text at most for each task, since Spark keeps the first
        text of a blob on the map side. The rows appear all at once, when the write commits; scans
        of the same blobs at the same time may both add them, and readers take one of equal rows.
        """
        before = self.rows().where(F.col("rules") == version).select("blob")
        text = F.coalesce(F.col("text"), F.lit(""))
        blobs = versions.select(F.sha2(text, 256).alias("blob"), text.alias("text"))
        if before.limit(1).count():
            blobs = blobs.join(before, "blob", "left_anti")
        unseen = blobs.groupBy("blob").agg(F.first("text").alias("text"))
        found = unseen.mapInArrow(_scanner(rules or RULES, version), LEDGER)
        seen = Observation()
        found.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(self.path)
        return seen.get["n"]

    def findings(self, versions: DataFrame, version: str = RULES_VERSION) -> DataFrame:
        """``versions`` without its text, with its blob address and the ledger's columns for it:
        findings of every path. A column of ``versions`` named like one of them is left out."""
        known = self.rows().where(F.col("rules") == version).drop("rules").dropDuplicates(["blob"])
        kept = [c for c in versions.columns if c != "text" and c not in known.columns]
        keyed = versions.select(*kept, F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("blob"))
        return keyed.join(known, "blob", "left").select(*kept, *known.columns)


def op2_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text of ``documents``, found through a new ledger."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = BlobLedger(spark)
    ledger.scan(docs)
    found = ledger.findings(docs)
    return found.select(
        "doc_id", *[f"n_{k}" for k in BASE], F.sha2("base", 256).alias("base_sha256"), "spans", "n_spans", F.col("blob").alias("blob_sha256")
    )


def _sql_matches(kind: str, pattern: str, group: int, least: int, rank: int) -> str:
    """Rows (doc row, start, rank, end) of one kind, from the texts between and of its matches."""
    p = ("(?i)" if kind in EITHER_CASE else "") + pattern.replace("'", "''")
    return f"""
    SELECT rid, doc_id, {rank} AS rank, '{kind}' AS kind,
           s + list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS a,
           length(hits[i]) AS len, length(vals[i]) AS vlen, {least} AS least
    FROM (SELECT rid, doc_id, 0 AS s, hits, vals, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (
        SELECT rid, doc_id, regexp_extract_all(text, '{p}') AS hits, regexp_extract_all(text, '{p}', {group}) AS vals,
               string_split_regex(text, '{p}') AS gaps FROM d WHERE regexp_matches(text, '{p}')))"""


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(_sql_matches(k, p if k != "hex" else "[0-9a-f]{32,}", g, n, i) for i, (k, p, g, n) in enumerate(RULES))}),
k AS (SELECT rid, rank, kind, a, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + len AS BIGINT) AS said FROM m WHERE vlen >= least),
g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(said, ',' ORDER BY a, rank) FILTER (rank < 3) AS base, string_agg(said, ',' ORDER BY a, rank) AS spans, count(*) AS n_spans FROM k GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_spans, 0) AS n_spans, sha256(text) AS blob_sha256
FROM d LEFT JOIN g USING (rid)
"""
