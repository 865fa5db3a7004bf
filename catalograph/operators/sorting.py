"""Orders, tie-breakers, pages and relevance order."""

from __future__ import annotations

import datetime as dt
import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default orders, and the columns that end every order, by record type.
DEFAULT_SORT = {
    "collection": ["+entry_title", "+provider_id"], "granule": ["+provider_id", "+start_date"], "variable": ["+name", "+provider_id"],
    "service": ["+name", "+provider_id"], "tool": ["+name", "+provider_id"], "tag": ["+tag_key"], "subscription": ["+name", "+provider_id"],
}
TIEBREAK = {"collection": ["+concept_id", "-revision_id"], "granule": ["+concept_id"]}
ALIASES = {"score": "-score", "usage_score": "-usage_score", "ongoing": "-ongoing", "end_date": "+end_date"}
MAX_PAGE_SIZE, MAX_DEPTH = 2000, 1_000_000


def parse_key(key: str) -> tuple[str, bool]:
    """A key's column, and whether it descends; scores descend unless told otherwise."""
    if key[:1] in "+-":
        return key[1:], key[0] == "-"
    full = ALIASES.get(key, "+" + key)
    return full[1:], full[0] == "-"


def order_of(keys: list[str]) -> list[Column]:
    """Missing values come last either way, as in the index."""
    out = []
    for k in keys:
        c, down = parse_key(k)
        out.append(F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last())
    return out


def default_sort(kind: str) -> list[str]:
    return DEFAULT_SORT[kind]


def with_tiebreak(keys: list[str], kind: str) -> list[str]:
    have = {parse_key(k)[0] for k in keys}
    return [*keys, *[k for k in TIEBREAK.get(kind, ["+concept_id"]) if parse_key(k)[0] not in have]]


def sort_by(df: DataFrame, keys: list[str], kind: str | None = None) -> DataFrame:
    return df.orderBy(*order_of(with_tiebreak(keys, kind) if kind else keys))


def has_granules_order(down: bool = False) -> Column:
    """The has-granules flag sorts the other way round: collections with granules first when ascending."""
    c = F.col("has_granules")
    return c.asc_nulls_last() if down else c.desc_nulls_last()


def version_key(c: Column) -> Column:
    """A version that is a number by its shortest form, else itself."""
    return F.coalesce(c.try_cast("bigint").cast("string"), c)


def page(df: DataFrame, size: int = 10, num: int | None = None, offset: int | None = None) -> DataFrame:
    """A page by number from 1 or by offset, of an ordered frame."""
    if num is not None and offset is not None:
        raise ValueError("give a page number or an offset")
    skip = offset if offset is not None else size * ((num or 1) - 1)
    if not 0 <= size <= MAX_PAGE_SIZE:
        raise ValueError(f"page size must be between 0 and {MAX_PAGE_SIZE}")
    if skip < 0 or skip + size > MAX_DEPTH:
        raise ValueError(f"paging depth is at most {MAX_DEPTH}")
    return df.offset(skip).limit(size)


def page_after(df: DataFrame, keys: list[str], last: list, size: int) -> DataFrame:
    """The rows after the last sort values of a page: a filter that pushes down, then a top-k."""
    parsed = [parse_key(k) for k in keys]
    terms = []
    for i, ((c, down), v) in enumerate(zip(parsed, last)):
        same = [F.col(p).eqNullSafe(F.lit(x)) for (p, _), x in zip(parsed[:i], last[:i])]
        if v is None:
            beyond = F.lit(False)  # missing values are last
        else:
            beyond = F.col(c).isNull() | (F.col(c) < F.lit(v) if down else F.col(c) > F.lit(v))
        terms.append(functools.reduce(operator.and_, [*same, beyond]))
    return df.where(functools.reduce(operator.or_, terms)).orderBy(*order_of(keys)).limit(size)


def natural_key(c: Column) -> Column:
    """Numbers in text compare as numbers, case ignored: an array of (number, text) parts."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.coalesce(p.try_cast("decimal(38,0)"), F.lit(-1).cast("decimal(38,0)")).alias("n"), F.when(p.rlike(r"^\d"), F.lit("")).otherwise(p).alias("t")))


def half_up(x: Column) -> Column:
    """Round half towards positive infinity, to 2 decimals."""
    return F.floor(x * 100 + 0.5) / 100


def bin_score(score: Column, size: float = 0.2) -> Column:
    """Half the score, to the nearest bin."""
    return half_up(F.floor(score / 2 / size + 0.5) * size)


def bin_usage(usage: Column, size: float = 400.0) -> Column:
    return half_up(F.floor(F.coalesce(usage, F.lit(0)) / size + 0.5) * size)


def relevance_sort(df: DataFrame, now: dt.datetime, score: str | None = "score", overlap: str | None = None, usage_first: bool = False) -> DataFrame:
    """Usage bin if asked first, score bin, temporal overlap, usage bin, end date (open counts as now), level."""
    keys = []
    if usage_first:
        keys.append(bin_usage(F.col("usage")).desc())
    if score:
        keys.append(bin_score(F.col(score)).desc())
    if overlap:
        keys.append(F.col(overlap).desc_nulls_last())
    keys += [bin_usage(F.col("usage")).desc(), F.coalesce("end_date", F.lit(now).cast("timestamp_ntz")).desc(), F.col("processing_level").desc_nulls_last(), F.col("concept_id").asc()]
    return df.orderBy(*keys)


def autocomplete(df: DataFrame, term: str, types: list[str] | None = None, k: int = 10, offset: int = 0) -> DataFrame:
    """Suggestions (type, value) whose words start like the term's, best first.

    Score: 2 for the whole value, 1 for a prefix of it, plus the share of the term's words found.
    """
    words = term.lower().split()
    v = F.lower("value")
    tokens = F.split(v, r"[\s/:>-]+")
    found = lambda w: F.exists(tokens, lambda t: t.startswith(w)).cast("int")
    hits = sum([found(w) for w in words], F.lit(0))
    score = F.when(v == term.lower(), 2.0).when(v.startswith(term.lower()), 1.0).otherwise(0.0) + hits / max(1, len(words))
    d = df.where(F.col("type").isin(types)) if types else df
    return d.withColumn("score", score).where(hits > 0).orderBy(F.desc("score"), "type", "value").offset(offset).limit(k)
