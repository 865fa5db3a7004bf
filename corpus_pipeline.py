"""A training corpus from ``documents``: toxicity, line dedup, near dedup, source mixing, tokens.

Each stage works on all rows that the one before it kept, and all but the last return the columns
of ``documents`` (``n_chars`` follows the text). Between stages the rows are a Parquet table.

Repeated rows pass the first two stages as they are; the near-duplicate stage keeps one of them.
Null texts count as empty and stay to the end with no tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalograph.llm import bpe, lines, mixing, neardup, toxicity
from catalograph.llm.common import Scratch, table

#: How often the mix may read a source; every source is read at least once.
REPEATS = 1.25
#: Percent of five-word shingles that near duplicates share at least.
SIMILARITY = 80


OWN = ("doc_id", "text", "source")


def _whole(docs: DataFrame) -> DataFrame:
    """The columns that stages work on, and the others as one, so that their names can't clash."""
    return docs.select(F.struct(F.lit(0).alias("_"), *[c for c in docs.columns if c not in OWN]).alias("whole"), *OWN)


def _columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of a stage's input again, from :func:`_whole`."""
    return df.select(*[F.col(c) if c in OWN else F.col(f"whole.{c}").alias(c) for c in columns])


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel SVM scores under its threshold."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _columns(toxicity.score(_whole(docs), model).where(F.col("score") < toxicity.THRESHOLD), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that at least ten of them hold."""
    out = lines.dedup(_whole(docs))
    return _columns(out.withColumn("whole", F.col("whole").withField("n_chars", F.length("text").cast("long"))), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return neardup.keep_one(docs, SIMILARITY)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents dealt by temperature weights: each once, and those of small sources up to ``REPEATS`` times."""
    return _columns(mixing.deal(_whole(docs), repeats=REPEATS), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of each dealt document."""
    return bpe.digest(docs)


STAGES = [("toxicity", toxic), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("tokens", tokens)]

#: SQL can't express the trained classifier of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
