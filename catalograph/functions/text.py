"""Keyword words and phrases, relevance scores, humanised values, formats, highlights, fingerprints."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import all_of, any_of, wildcard_regex

# Characters that separate words, and phrases (the same but for the space).
SEPARATORS = "!@#$%^&()-=_+{}[]|;'.,\\\"/:<>?`~* "
_WORDS = "[" + re.escape(SEPARATORS).replace("/", "/") + "]"
_PHRASES = "[" + re.escape(SEPARATORS.replace(" ", "")) + "]"
_BRACKETED = "[\\{\\(\\[\"“:_](.*?)[_:”\"\\}\\)\\)]"
PIECE = 64


def _strings(c: Column | list[Column]) -> Column:
    """Text columns, or an array of text, as one array without nulls."""
    return F.array_compact(F.array(*c)) if isinstance(c, list) else F.filter(c, lambda x: x.isNotNull())


def keyword_words(values: Column | list[Column]) -> Column:
    """Distinct sorted words of text fields: each token whole, unwrapped from brackets, and split."""
    tokens = F.flatten(F.transform(_strings(values), lambda v: F.split(F.lower(v), " ")))

    def parts(t: Column) -> Column:
        wrapped = t.rlike(r"(?s)^[({\[].*[)}\]]$")
        return F.concat(F.array(t), F.when(wrapped, F.array(t.substr(F.lit(2), F.length(t) - 2))).otherwise(F.array().cast("array<string>")), F.split(t, _WORDS))

    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(tokens, parts)), lambda w: w != "")))


def keyword_phrases(values: Column | list[Column]) -> Column:
    """Space-padded whole values, parts between special characters and in brackets, then the words.

    Long values are cut into pieces of 64 terms.
    """
    v = F.array_distinct(F.filter(_strings(values), lambda x: F.trim(x) != ""))
    split = F.flatten(F.transform(v, lambda x: F.split(x, _PHRASES)))
    inner = F.flatten(F.transform(v, lambda x: F.concat(F.regexp_extract_all(x, F.lit(_BRACKETED), F.lit(0)), F.regexp_extract_all(x, F.lit(_BRACKETED), F.lit(1)))))
    padded = F.transform(F.filter(F.concat(split, inner, v), lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit(" "), F.lower(F.trim(x)), F.lit(" ")))

    def pieces(x: Column) -> Column:
        terms = F.split(x, r"\s")
        starts = F.sequence(F.lit(0), F.floor((F.size(terms) - 1) / PIECE).cast("int"))
        cut = F.transform(starts, lambda i: F.array_join(F.slice(terms, i * PIECE + 1, F.lit(PIECE)), " "))
        return F.when(F.size(terms) > PIECE, cut).otherwise(F.array(x))

    return F.array_distinct(F.filter(F.flatten(F.transform(F.concat(padded, keyword_words(values)), pieces)), lambda x: F.trim(x) != ""))


def query_keywords(query: str) -> dict[str, list[str]]:
    """Keywords of a query text: words, or the phrase of a quoted query."""
    q = query.strip().lower()
    if len(q) > 1 and q[0] == q[-1] == '"':
        return {"phrase": [q[1:-1].strip()], "words": []}
    return {"phrase": [], "words": q.split()}


# Weights of fields that match a keyword.
DEFAULT_BOOSTS = {
    "short_name": 1.4, "entry_id": 1.4, "project": 1.0, "platform": 1.3, "instrument": 1.2, "science_keywords": 1.2, "spatial_keyword": 1.1, "temporal_keyword": 1.1,
    "version_id": 1.0, "entry_title": 2.2, "provider": 1.0, "two_d_coord_name": 1.0, "processing_level_id": 1.0, "data_center": 1.0, "granule_data_format": 1.1,
}
# Fixed values: (column, kind of match, boost); "name" has a long and a short column.
SCORE_RULES = [
    ("long_name", "loose", "short_name"), ("short_name", "exact", "short_name"), ("entry_id", "exact", "entry_id"), ("project", "name", "project"), ("platform", "name", "platform"),
    ("instrument", "name", "instrument"), ("science_keywords", "keywords", "science_keywords"), ("spatial_keyword", "exact", "spatial_keyword"), ("temporal_keyword", "exact", "temporal_keyword"),
    ("version_id", "exact", "version_id"), ("entry_title", "loose", "entry_title"), ("doi", "exact", "doi"), ("provider_id", "exact", "provider"), ("two_d_coord_name", "exact", "two_d_coord_name"),
    ("processing_level_id", "exact", "processing_level_id"), ("data_center", "exact", "data_center"), ("granule_data_format", "exact", "granule_data_format"),
]


def boost_of(field: str, boosts: dict | None) -> float:
    """A given boost, the defaults if asked to include them, else 1."""
    if boosts is None:
        table = DEFAULT_BOOSTS
    elif str(boosts.get("include_defaults", "")).lower() == "true":
        table = DEFAULT_BOOSTS | boosts
    else:
        table = boosts
    return float(table.get(field, 1.0))


def keyword_score(df: DataFrame, words: list[str], boosts: dict | None = None) -> Column:
    """Product of the boosts of fields that match; rules whose columns are missing count as no match.

    ``loose``: every word occurs in one value. ``exact``: a value is the whole query. ``name``: every word
    occurs in the long name, or a word is the short name. ``keywords``: a keyword field is the query.
    """
    words = [w.lower() for w in words]
    inside = [wildcard_regex(f"*{w}*") for w in words]
    whole, each = wildcard_regex(" ".join(words)), [wildcard_regex(w) for w in words]
    types = dict(df.dtypes)

    def some(c: str, test) -> Column:
        if c not in types:
            return F.lit(False)
        col = F.col(c)
        hit = F.exists(col, lambda x: test(F.lower(x))) if types[c].startswith("array") else test(F.lower(col))
        return F.coalesce(hit, F.lit(False))

    score = F.lit(1.0)
    for field, kind, boost in SCORE_RULES:
        if kind == "loose":
            hit = all_of(*[some(field, lambda x, r=r: x.rlike(r)) for r in inside]) if field in types else F.lit(False)
        elif kind == "exact":
            hit = some(field, lambda x: x.rlike(whole))
        elif kind == "name":
            loose = all_of(*[_some_name(some, field + "_ln", r) for r in inside]) if field + "_ln" in types else F.lit(False)
            hit = loose | any_of(*[_some_name(some, field + "_sn", r) for r in each])
        else:
            fields = re.findall(r"(\w+):string", types.get(field, "")) if field in types else []
            hit = any_of(*[_keyword_level(field, f, whole) for f in fields])
        score = score * F.when(hit, F.lit(boost_of(boost, boosts))).otherwise(F.lit(1.0))
    return score


def _some_name(some, field: str, regex: str) -> Column:
    return some(field, lambda x: x.rlike(regex))


def _keyword_level(field: str, level: str, regex: str) -> Column:
    return F.coalesce(F.exists(F.col(field), lambda e: F.lower(e[level]).rlike(regex)), F.lit(False))


# ---------------------------------------------------------------- humanised values


_KINDS = ("alias", "capitalize", "ignore", "priority", "trim_whitespace")


def humanize(value: Column, rules: list[dict], field: str) -> Column:
    """A value after the rules of its field, in their order, each on the last one's result.

    Gives a struct of value, priority and reportable; an ignored value is null. One fold over an
    array of the rules, so the plan has the same size for any number of them.
    """
    own = sorted((r for r in rules if r["field"] == field), key=lambda r: r["order"])
    for r in own:
        if r["type"] not in _KINDS:
            raise ValueError(f"unknown humanizer: {r['type']}")
    table = [{k: r.get(k) for k in ("type", "source_value", "replacement_value", "priority")} | {"reportable": bool(r.get("reportable"))} for r in own]
    rule = "array<struct<type:string,source_value:string,replacement_value:string,priority:int,reportable:boolean>>"
    start = F.struct(value.cast("string").alias("value"), F.lit(0).alias("priority"), F.lit(False).alias("reportable"))
    done = F.aggregate(F.from_json(F.lit(json.dumps(table)), rule), start, _apply)
    return F.when(done["value"].isNotNull(), done)


def _apply(state: Column, rule: Column) -> Column:
    v, kind = state["value"], rule["type"]
    # every word starts upper-case; others become lower-case
    words = F.transform(F.regexp_extract_all(v, F.lit(r"(\w+|\W+)"), F.lit(1)), lambda w: F.concat(F.upper(w.substr(1, 1)), F.lower(w.substr(F.lit(2), F.length(w)))))
    new = (
        F.when(kind == "alias", rule["replacement_value"])
        .when(kind == "capitalize", F.array_join(words, ""))
        .when(kind == "trim_whitespace", F.trim(F.regexp_replace(v, r"\s+", " ")))
        .when(kind == "priority", v)
    )
    changed = F.struct(new.alias("value"), F.when(kind == "priority", rule["priority"]).otherwise(state["priority"]).alias("priority"), (state["reportable"] | rule["reportable"]).alias("reportable"))
    hit = v.isNotNull() & (rule["source_value"].isNull() | (v == rule["source_value"]))
    return F.when(hit, changed).otherwise(state)


def humanizer_report(df: DataFrame, rules: list[dict], fields: dict[str, str], keys: list[str]) -> DataFrame:
    """(keys, field, original, humanized) of values that a reportable rule changed; ``fields`` maps columns to rule fields."""
    parts = []
    for c, rule_field in fields.items():
        values = F.col(c) if dict(df.dtypes)[c].startswith("array") else F.array(c)
        parts.append(_reported(values, c, rules, rule_field))
    d = df.select(*keys, F.explode(F.concat(*parts)).alias("x"))
    return d.where("x.h.reportable and x.original != x.h.value").select(*keys, "x.field", "x.original", F.col("x.h.value").alias("humanized")).distinct()


def _reported(values: Column, name: str, rules: list[dict], rule_field: str) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(name).alias("field"), v.alias("original"), humanize(v, rules, rule_field).alias("h")))


def expand_aliases(names: Column, rules: list[dict], field: str) -> Column:
    """Names and, for each that is an alias rule's replacement, the values that it replaces."""
    back: dict[str, list[str]] = {}
    for r in rules:
        if r["type"] == "alias" and r["field"] == field and r.get("source_value") is not None:
            back.setdefault(r["replacement_value"], []).append(r["source_value"])
    if not back:
        return names
    table = F.create_map(*[x for k, vs in back.items() for x in (F.lit(k), F.array(*[F.lit(v) for v in vs]))])
    return F.array_distinct(F.flatten(F.transform(names, lambda n: F.concat(F.array(n), F.coalesce(table[n], F.array().cast("array<string>"))))))


# ---------------------------------------------------------------- formats, highlights, other


# Separators of distribution formats in their order, and what each must not be part of.
_FORMAT_SPLITS = [
    (r"(?i) *\/ *(?!CF)(?!95)(?!info)(?!arc)(?!98)(?!2000)", None), (r" +and +", r"\.r.?.? and \.q"), (r" +or +", None), (r"_or_", None), (r", *", None), (r" +- +(?!EOS)", None), (r" *; *(?!amp)(?!gt)", None),
]


def split_formats(c: Column) -> Column:
    """Formats named in one text: split at slashes, and, or, commas, dashes and semicolons."""
    text = F.regexp_replace(F.regexp_replace(c, ", (and|or) ", ", "), "Various: ", "")
    out = F.array(text)
    for pattern, unless in _FORMAT_SPLITS:
        out = F.flatten(F.transform(out, _splitter(pattern, unless)))
    return F.filter(F.transform(out, lambda x: F.trim(x)), lambda x: x != "")


def _splitter(pattern: str, unless: str | None):
    if unless is None:
        return lambda x: F.split(x, pattern)
    return lambda x: F.when(x.rlike(unless), F.array(x)).otherwise(F.split(x, pattern))


def highlight(c: Column, words: list[str], begin: str = "<em>", end: str = "</em>", length: int = 100, count: int = 5) -> Column:
    """Snippets of about ``length`` characters around the words found, tagged, ``count`` at most."""
    some = "|".join(re.escape(w) for w in words)
    pattern = rf"(?is).{{0,{max(0, (length - 10) // 2)}}}\b(?:{some})\b.{{0,{max(0, (length - 10) // 2)}}}"
    found = F.slice(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), 1, count)
    return F.transform(found, lambda s: F.regexp_replace(s, rf"(?i)\b({some})\b", begin + "$1" + end))


def variable_fingerprint(name: Column, units: Column, dimensions: Column) -> Column:
    """MD5 of the normalised name, units and dimensions (structs of Name, Size, Type)."""
    norm = lambda x: F.coalesce(F.lower(F.trim(x)), F.lit("null"))
    dim = F.transform(F.coalesce(dimensions, F.array()), lambda d: F.concat(F.lit('"{:Name '), norm(d["Name"]), F.lit(", :Size "), F.coalesce(d["Size"].cast("string"), F.lit("null")), F.lit(", :Type "), F.coalesce(d["Type"], F.lit("null")), F.lit('}"')))
    return F.md5(F.concat(norm(name), F.lit("|"), norm(units), F.lit("|["), F.array_join(dim, " "), F.lit("]")))


def drop_anti_values(df: DataFrame, c: str) -> DataFrame:
    """Rows whose value says something."""
    return df.where(F.trim(c) != "").where(~F.lower(F.trim(c)).rlike(r"^(none|not provided|not applicable)$"))


def classify_links(urls: Column, cloud_hosts: str) -> Column:
    """Struct of the cloud and the on-premises subset-service link, at most one each; more is an error text.

    ``cloud_hosts``: a pattern that the host of a cloud link matches as a whole.
    """
    host = rf"(?i)^https?://(?:{cloud_hosts})(?:[:/]|$)"
    cloud, local = F.filter(urls, lambda u: u.rlike(host)), F.filter(urls, lambda u: ~u.rlike(host))
    error = F.when((F.size(cloud) > 1) | (F.size(local) > 1), F.lit("at most one cloud and one on-premises link")).when(F.exists(urls, lambda u: u.rlike("(?i)^s3://")), F.lit("an S3 link is not a service link"))
    return F.struct(F.get(cloud, F.lit(0)).alias("cloud"), F.get(local, F.lit(0)).alias("on_premises"), error.alias("error"))


def limit_text(c: Column, n: int) -> Column:
    return c.substr(1, n)
