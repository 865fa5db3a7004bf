"""Operator 1, mixing sources to target weights by temperature.

Source token shares p are raised to an exponent a between 0 (uniform) and 1 (natural) and
normalised to weights. The exponent is bisected on a fixed grid: either the largest that reaches a
target entropy (entropy falls as a grows), or the smallest that keeps every source's repetitions,
weight x budget / tokens, within a limit. The weights become integer token budgets, which are
realised as block permutations: documents fall into blocks by a seeded hash, each epoch deals
blocks and the documents in them in a new order, and a source is read in that order, epoch after
epoch, until its budget is spent. The stream is cut into mix blocks that each hold every source's
share, so weights hold along the stream and not only in total.

Places in a permutation are prefix sums in three levels (document in block, block in group of
blocks, group in source), so no task holds a whole source, however hot.

Null sources form one source of their own. Null or empty texts count no tokens: such documents
keep their place in the order and cost nothing. Repeated rows are dealt as rows of their own; an
empty table gives an empty result. Extra columns pass through unless named like an added one,
which then replaces them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch, table

#: The exponent's grid: a = step / 2^20.
GRID = 20
#: Documents that a block holds on average, and blocks in a group.
BLOCK, GROUP = 512, 1024
#: Weights are integer parts of this.
PARTS = 10**9
SEED = 17

#: Production setting: no source is read more than this often; the budget reads every source once.
REPEATS = 2.0
MIX_BLOCKS = 64


def n_words(text: Column) -> Column:
    """Tokens of a text for the shares: runs of other characters than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _sums(shares: DataFrame, a: float) -> tuple[float, float, float, float]:
    """Of all sources: sum of n^a, of n^a ln n, and the least and largest of n^(a-1)."""
    n = F.col("tokens").cast("double")
    p = F.pow(n, F.lit(a))
    row = shares.where("tokens > 0").agg(F.sum(p), F.sum(p * F.log(n)), F.min(p / n), F.max(p / n)).first()
    return tuple(float(x or 0) for x in row)


def entropy(shares: DataFrame, a: float) -> float:
    """Entropy (nats) of the weights at exponent ``a``."""
    s, sl, _, _ = _sums(shares, a)
    return math.log(s) - a * sl / s if s else 0.0


def repetition(shares: DataFrame, a: float) -> float:
    """Epochs of the most repeated source when the budget reads the least repeated one once."""
    _, _, lo, hi = _sums(shares, a)
    return hi / lo if lo else 1.0


def bisect_exponent(shares: DataFrame, target_entropy: float | None = None, repeats: float | None = None) -> int:
    """The exponent's grid step: largest with at least ``target_entropy``, or smallest within ``repeats``.

    ``shares`` (source, tokens) is a small stored table; each halving is one aggregate over it.
    """
    if (target_entropy is None) == (repeats is None):
        raise ValueError("give a target entropy or a repetition limit")
    lo, hi = 0, 1 << GRID
    if target_entropy is not None:
        while lo < hi:  # largest step whose entropy is still enough
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if entropy(shares, mid / 2**GRID) >= target_entropy else (lo, mid - 1)
        return lo
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if repetition(shares, mid / 2**GRID) <= repeats else (mid + 1, hi)
    return lo


def budgets(shares: DataFrame, step: int, tokens: int | None = None) -> DataFrame:
    """(source, n_tokens, weight_ppb, budget): integer weights, and tokens to deal of each source.

    ``tokens``: the total budget; None: as many as read the least repeated source exactly once.
    """
    a = step / 2**GRID
    total, _, least, _ = _sums(shares, a)
    n = F.col("tokens").cast("double")
    p = F.pow(n, F.lit(a))
    weight = F.when(F.col("tokens") > 0, F.floor(p / F.lit(total or 1.0) * PARTS + 0.5)).otherwise(0).cast("long")
    if tokens is None:  # n^(a-1) over its least is how often a source is read; in millionths
        reads = F.floor(p / n / F.lit(least or 1.0) * 10**6 + 0.5).cast("decimal(38,0)")
        budget = F.floor(reads * F.col("tokens") / F.lit(10**6))
    else:
        budget = F.floor(weight.cast("decimal(38,0)") * F.lit(tokens) / F.lit(PARTS))
    return shares.select("source", F.col("tokens").alias("source_tokens"), weight.alias("weight_ppb"), F.when(F.col("tokens") > 0, budget).otherwise(0).cast("long").alias("budget"))


def _hash(*cols) -> Column:
    """A 60-bit order key from text: the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 15), 16, 10).cast("long")


def deal(docs: DataFrame, tokens: Column | None = None, target_entropy: float | None = None, repeats: float | None = None, total: int | None = None, mix_blocks: int = MIX_BLOCKS, seed: int = SEED) -> DataFrame:
    """Deal ``docs`` (doc_id, text, source, ...) to the temperature-mixed weights.

    Returns a row for each time that a document is dealt: its own columns, ``n_tokens``, ``epoch``
    from 0, ``place`` (tokens of its source dealt before it), ``mix_block`` and ``mix_key``: ordering
    by the last two gives the training order. See the module for the method and edge cases.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    added = ("n_tokens", "epoch", "place", "mix_block", "mix_key", "weight_ppb")
    kept = [c for c in docs.columns if c not in added]
    d = docs.select(  # the row is one column, so that no name of the input can clash
        F.struct(*kept).alias("_row"), "doc_id",
        (n_words(F.col("text")) if tokens is None else tokens).alias("n_tokens"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_source"),
    )
    shares = scratch.store(d.groupBy("_source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).withColumnRenamed("_source", "source"), "shares")
    step = bisect_exponent(shares, target_entropy, repeats)
    plan = budgets(shares, step, total).join(shares.select("source", "docs"), "source")
    plan = scratch.store(
        plan.select(
            F.col("source").alias("_source"), "source_tokens", "budget", "weight_ppb",
            F.ceil(F.col("docs") / BLOCK).cast("long").alias("blocks"),
            F.ceil(F.when(F.col("source_tokens") > 0, F.col("budget") / F.col("source_tokens")).otherwise(1)).cast("int").alias("epochs"),
        ).where("epochs > 0"),
        "plan",
    )
    # one row for each (document, epoch): its block and its order there change with the epoch's seed
    name = F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = (
        d.join(F.broadcast(plan) if shares.count() <= 10_000 else plan, "_source")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
        .withColumn("_key", _hash(name))
        .withColumn("_block", F.pmod(F.col("_key"), F.col("blocks")))
        .withColumn("_group", F.floor(F.col("_block") / GROUP))
    )
    ids = ["_source", "epoch", "_group", "_block"]
    sizes = scratch.store(rows.groupBy(*ids).agg(F.sum("n_tokens").alias("_size")), "blocks")
    groups = sizes.groupBy("_source", "epoch", "_group").agg(F.sum("_size").alias("_gsize"))
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    groups = groups.select("_source", "epoch", "_group", F.coalesce(F.sum("_gsize").over(before(W.partitionBy("_source", "epoch").orderBy("_group"))), F.lit(0)).alias("_g0"))
    starts = sizes.join(groups, ["_source", "epoch", "_group"]).select(
        *ids, (F.col("_g0") + F.coalesce(F.sum("_size").over(before(W.partitionBy("_source", "epoch", "_group").orderBy("_block"))), F.lit(0))).alias("_b0")
    )
    order = before(W.partitionBy(*ids).orderBy("_key", F.col("doc_id").asc_nulls_first(), "n_tokens"))
    placed = rows.withColumn("_in", F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).join(starts, ids)
    place = F.col("epoch") * F.col("source_tokens") + F.col("_b0") + F.col("_in")
    dealt = placed.withColumn("place", place.cast("long")).where("place < budget or (n_tokens = 0 and place <= budget)")
    block = F.floor(F.col("place").cast("decimal(38,0)") * mix_blocks / F.greatest(F.col("budget"), F.lit(1)))
    return dealt.select(
        "_row.*", "n_tokens", "epoch", "place",
        F.least(block, F.lit(mix_blocks - 1)).cast("int").alias("mix_block"), F.col("_key").alias("mix_key"), "weight_ppb",
    )


def op1_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` dealt to weights that repeat no source more than twice and read each once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("words"))
    docs = Scratch(spark, "words").store(docs, "words")  # texts are read once, and never dealt
    return deal(docs, tokens=F.col("words"), repeats=REPEATS).drop("words")


_KEY = "CAST('0x' || substr(md5('{seed}|' || epoch || '|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)"

SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce('=' || source, '') AS s,
           len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents),
sh AS (SELECT s, CAST(sum(n_tokens) AS DOUBLE) AS n, CAST(sum(n_tokens) AS BIGINT) AS source_tokens, count(*) AS docs FROM d GROUP BY s),
ns AS (SELECT list(n) AS v FROM sh WHERE n > 0),
st AS (SELECT list_reduce(list_concat([{{'lo': 0, 'hi': {1 << GRID}}}], list_transform(range({GRID + 1}), lambda i: {{'lo': 0, 'hi': 0}})), lambda x, y:
    CASE WHEN x.lo >= x.hi THEN x
         WHEN list_max(list_transform(v, lambda n: pow(n, ((x.lo + x.hi) // 2) / {1 << GRID}.0) / n)) / list_min(list_transform(v, lambda n: pow(n, ((x.lo + x.hi) // 2) / {1 << GRID}.0) / n)) <= {REPEATS}
         THEN {{'lo': x.lo, 'hi': (x.lo + x.hi) // 2}} ELSE {{'lo': (x.lo + x.hi) // 2 + 1, 'hi': x.hi}} END).lo / {1 << GRID}.0 AS a FROM ns),
w AS (SELECT s, source_tokens, docs, pow(n, a) AS p, pow(n, a) / n AS r FROM sh, st WHERE n > 0),
pl AS (SELECT s, source_tokens, (docs + {BLOCK - 1}) // {BLOCK} AS blocks, CAST(floor(p / (SELECT sum(p) FROM w) * {PARTS} + 0.5) AS BIGINT) AS weight_ppb,
       CAST(CAST(floor(r / (SELECT min(r) FROM w) * 1000000 + 0.5) AS HUGEINT) * source_tokens // 1000000 AS BIGINT) AS budget FROM w
       UNION ALL SELECT s, 0, (docs + {BLOCK - 1}) // {BLOCK}, 0, 0 FROM sh WHERE n = 0),
e AS (SELECT *, unnest(range(greatest(1, (budget + greatest(source_tokens, 1) - 1) // greatest(source_tokens, 1)))) AS epoch FROM pl),
k AS (SELECT doc_id, source, e.s, n_tokens, epoch, budget, source_tokens, weight_ppb, blocks, {_KEY.format(seed=SEED)} AS mix_key FROM d JOIN e ON d.s = e.s),
o AS (SELECT *, CAST(epoch * source_tokens + coalesce(sum(n_tokens) OVER (PARTITION BY s, epoch ORDER BY mix_key % blocks, mix_key, doc_id NULLS FIRST, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place FROM k)
SELECT doc_id, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(epoch AS INTEGER) AS epoch, place,
       CAST(least({MIX_BLOCKS - 1}, CAST(place AS HUGEINT) * {MIX_BLOCKS} // greatest(budget, 1)) AS INTEGER) AS mix_block, mix_key, weight_ppb
FROM o WHERE place < budget OR (n_tokens = 0 AND place <= budget)
"""
