"""Operator 7, licence scans by an exact set-similarity join.

Templates are licence notices as sets of words. A text block matches a template if it holds at
least ``CONTAINMENT`` of the template's words. Related notices differ by a few words at one place:
after "attribution" stand "noncommercial", "sharealike", ... or none of them. A template of such a
family matches a block only if it says so at some place: its word before the place, then exactly its
own words of the family, then another word. So a block that holds two notices of a family gets both
labels, and neither hides the other. Blocks are ``2 * span`` consecutive words, one each ``span``
words, with a span that the template's wording fits in, however long it is, so any passage as long
as the wording, line breaks or not, lies whole in one. Identifiers are too short for sets: their
words must stand consecutively, like the base phrases.

The join: words are ordered by how many documents hold them, rarest first. A block that holds k of
a template's n words must hold one of the first n - k + 1 in that order (its prefix), so templates
are indexed by their prefixes and blocks meet them by an equi-join on those words. The length
filter asks for k different words in the block, the positional filter for k words at or after the
first prefix word that they share, on both sides. Blocks that are left are verified exactly.

Only DataFrame functions. Texts are read into words once: that pass gives the base columns and the
template words that a text holds, and keeps the words themselves where a text as a whole holds
enough of some template; blocks are cut from those. The template index is broadcast: its size is
that of ``TEMPLATES``. The ordering needs the counts of template words only; they reach the driver,
a few hundred at most. Matches join their rows by the rows' places in the stored table.

Null or empty texts have no words, no labels and score 0. Repeated rows each come back, as do ties.
Very long texts are one row in a task, and their blocks together twice their words. An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, table

CONTAINMENT = 0.8
#: The least stride of blocks; a template takes the first of its doubles that its words fit in.
SPAN = 12

# Phrases of the contract and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# Kinds and versions of Creative Commons licences, whose identifiers are a kind and a version,
# and names of licences in SPDX tags and in running text, as words, with their labels.
CC_KINDS = ["cc by", "cc by nc", "cc by nc nd", "cc by nc sa", "cc by nd", "cc by sa"]
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
SPDX = [
    ("mit", "mit"), ("isc", "isc"), ("apache 2 0", "apache-2.0"), ("bsd 2 clause", "bsd"), ("bsd 3 clause", "bsd"), ("mpl 2 0", "mpl-2.0"), ("unlicense", "unlicense"),
    ("gpl 2 0", "gpl"), ("gpl 3 0", "gpl"), ("lgpl 2 1", "lgpl"), ("lgpl 3 0", "lgpl"), ("agpl 3 0", "agpl"), ("cc0 1 0", "cc0-1.0"),
]
NAMED = [("licensed under the mit license", "mit"), ("licensed under mit license", "mit"), ("bsd 2 clause license", "bsd"), ("bsd 3 clause license", "bsd")]

IDENTIFIERS = (
    [(f"{kind} {version}", f"{kind} {version}".replace(" ", "-", kind.count(" ") + 1).replace(" ", ".")) for kind in CC_KINDS for version in CC_VERSIONS]
    + [("cc0 1 0", "cc0-1.0")] + [(f"spdx license identifier {name}", label) for name, label in SPDX] + NAMED
)

# Label and wording of published licence notices.
TEMPLATES = [
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]

# Of each family of licences its labels, the word before the place where they differ, and the
# words that may stand there. Single licences: a word that a block must hold.
FAMILIES = [
    (("agpl", "gpl", "lgpl"), "gnu", ("affero", "lesser")),
    (("cc-by", "cc-by-nc", "cc-by-nc-nd", "cc-by-nc-sa", "cc-by-nd", "cc-by-sa"), "attribution", ("noncommercial", "noderivatives", "sharealike")),
]
MUST = {"apache-2.0": "apache", "mpl-2.0": "mozilla", "unlicense": "unencumbered"}

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; of null none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def _array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


class Template:
    """A notice: its label, words, how many of them a block needs, and words it must or mustn't hold."""

    def __init__(self, label: str, text: str, containment: float = CONTAINMENT):
        said = _words(text)
        self.label, self.words = label, sorted(set(said))
        self.need = math.ceil(containment * len(self.words) - 1e-9)
        self.span = SPAN
        while self.span < len(said):
            self.span *= 2
        self.must = [w for w in [MUST.get(label)] if w in said]
        # the place: its words in the template, and those that would make it a relative's
        self.phrase, self.others = "", []
        for labels, anchor, apart in FAMILIES:
            if label in labels:
                at = said.index(anchor) + 1
                while said[at] in apart:
                    at += 1
                own = said[said.index(anchor) : at]
                self.phrase, self.others = mark(own), [mark([*own, w]) for w in apart]

    def holds(self, own: Column) -> Column:
        """Whether distinct words ``own`` hold enough of the template's."""
        out = F.size(F.array_intersect(own, _array(self.words))) >= self.need
        for w in self.must:
            out = out & F.array_contains(own, w)
        return out


def mark(words: list[str]) -> str:
    """Consecutive words as they stand in a joined block: each between blanks of its own."""
    return " " + "  ".join(words) + " "


def base_columns(df: DataFrame) -> DataFrame:
    """``df`` (with ``w``, its words) with n_words, n_base, first_word, last_word, the base labels and identifiers' ones.

    Words stand in one string as " word ", so a phrase's places never share a space, and the words
    before a place are half the spaces before it.
    """
    half = lambda piece: ((F.length(piece) - F.length(F.replace(piece, F.lit(" "), F.lit("")))) / 2).cast("long")
    d = df.withColumn("n_words", F.size("w").cast("long")).withColumn("_s", F.concat(F.lit(" "), F.array_join("w", "  "), F.lit(" ")))
    mark = lambda phrase: " " + phrase.replace(" ", "  ") + " "
    rare = {first: F.contains(F.col("_s"), F.lit(f" {first} ")) for first in {phrase.split()[0] for phrase, _ in IDENTIFIERS}}
    count, first, last, labels = [], [], [], []
    for phrase, label in PHRASES:
        pieces = F.split("_s", re.escape(mark(phrase)).replace("\\ ", " "), -1)
        has = F.contains(F.col("_s"), F.lit(mark(phrase)))
        count.append(F.when(has, F.size(pieces) - 1).otherwise(0))
        first.append(F.when(has, half(F.element_at(pieces, 1))))
        last.append(F.when(has, F.col("n_words") - half(F.element_at(pieces, -1)) - len(phrase.split())))
        labels.append(F.when(has, F.lit(label)))
    own = [F.when(rare[phrase.split()[0]] & F.contains(F.col("_s"), F.lit(mark(phrase))), F.lit(label)) for phrase, label in IDENTIFIERS]
    total = count[0] + count[1] + count[2]
    return (
        d.withColumn("n_base", total.cast("long"))
        .withColumn("first_word", F.least(*first))
        .withColumn("last_word", F.greatest(*last))
        .withColumn("_base", F.array_sort(F.array_compact(F.array(*labels))))
        .withColumn("_named", F.array_distinct(F.array_compact(F.array(*own))))
        .drop("_s")
    )


class TemplateJoin:
    """Prefix-filtered containment join of text blocks with ``templates`` (label, text)."""

    def __init__(self, spark: SparkSession, templates=None, containment: float = CONTAINMENT):
        self.spark = spark
        self.templates = [Template(label, t, containment) for label, t in templates or TEMPLATES]
        self.vocabulary = sorted({w for t in self.templates for w in t.words})

    def read(self, docs: DataFrame) -> DataFrame:
        """Per row of ``docs`` (doc_id, text): base columns, ``own``, the template words that it holds,
        and ``w``, all its words, if it may hold a template at all."""
        d = base_columns(docs.select("doc_id", words(F.col("text")).alias("w"))).withColumn("own", F.array_intersect("w", _array(self.vocabulary)))
        least = min(t.need for t in self.templates)
        some = F.lit(False)
        for t in self.templates:
            some = some | t.holds(F.col("own"))
        return d.withColumn("w", F.when((F.size("own") >= least) & some, F.col("w"))).withColumn("row", F.monotonically_increasing_id())

    def order(self, read: DataFrame) -> list[str]:
        """Template words, those in the fewest documents first."""
        held = read.select(F.explode("own").alias("word"))
        seen = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}  # at most the vocabulary
        return sorted(self.vocabulary, key=lambda w: (seen.get(w, 0), w))

    def index(self, order: list[str]) -> DataFrame:
        """Rows of the templates' prefixes: span, word and its rank, template, and what to verify."""
        rank = {w: i for i, w in enumerate(order)}
        rows = []
        for t in self.templates:
            ranked = sorted(t.words, key=rank.get)
            for place, w in enumerate(ranked[: len(ranked) - t.need + 1]):
                rows.append((t.span, w, rank[w], t.label, ranked, place, t.need, t.must, t.phrase, t.others))
        kinds = "span int, word string, rank int, label string, tokens array<string>, place int, need int, must array<string>, phrase string, others array<string>"
        return self.spark.createDataFrame(rows, kinds)

    @staticmethod
    def _cut(span: int, prefix: Column) -> Column:
        """Blocks of one stride that hold a prefix word, as structs of stride, words and distinct words."""
        start = F.sequence(F.lit(0), F.greatest(F.size("w") - span - 1, F.lit(0)), F.lit(span))
        block = F.filter(F.transform(start, lambda at: F.slice("w", at + 1, 2 * span)), lambda b: F.arrays_overlap(b, prefix))
        return F.transform(block, lambda b: F.struct(F.lit(span).alias("span"), b.alias("s"), F.array_distinct(b).alias("b")))

    def matches(self, read: DataFrame) -> DataFrame:
        """(row, label, containment) of blocks of a stored :meth:`read` that meet a template."""
        order = self.order(read)
        index = self.index(order)
        prefix = _array(sorted({w for t in self.templates for w in sorted(t.words, key=order.index)[: len(t.words) - t.need + 1]}))
        cut = F.flatten(F.array(*[self._cut(span, prefix) for span in sorted({t.span for t in self.templates})]))
        blocks = (
            read.where("w is not null").select("row", F.explode(cut).alias("x")).select("row", "x.span", "x.s", "x.b")
            .withColumn("ranks", F.transform(F.array_intersect("b", _array(order)), lambda x: F.array_position(_array(order), x) - 1))
        )
        met = (
            blocks.select("*", F.explode(F.array_intersect("b", prefix)).alias("word"))
            .join(F.broadcast(index), ["span", "word"])
            .where(F.size("b") >= F.col("need"))
            .where(F.size("tokens") - F.col("place") >= F.col("need"))
            .where(F.size(F.filter("ranks", lambda r: r >= F.col("rank"))) >= F.col("need"))
        )
        shared = F.size(F.array_intersect("b", "tokens"))
        # places where the phrase stands, less those where a relative's word follows and one at the block's end
        text = F.concat(F.lit(" "), F.array_join("s", "  "), F.lit(" "))
        times = lambda phrase: (F.length(text) - F.length(F.replace(text, phrase, F.lit("")))) / F.length(phrase)
        others = F.aggregate("others", F.lit(0.0), lambda n, phrase: n + times(phrase))
        said = times(F.col("phrase")) - others - F.when(F.endswith(text, F.col("phrase")), 1).otherwise(0)
        apart = (F.size(F.array_intersect("b", "must")) == F.size("must")) & ((F.col("phrase") == "") | (said > 0.5))
        return met.where(shared >= F.col("need")).where(apart).select("row", "label", (shared / F.size("tokens")).alias("containment"))


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the columns of :func:`op7_template_join`."""
    scratch = Scratch(docs.sparkSession, "licences")
    join = TemplateJoin(docs.sparkSession)
    read = scratch.store(join.read(docs), "read")
    found = join.matches(read).groupBy("row").agg(F.collect_set("label").alias("found"), F.max("containment").alias("most"))
    out = read.drop("w", "own").join(found, "row", "left")
    none = F.array().cast("array<string>")
    named = F.array_sort(F.array_distinct(F.concat("_base", "_named", F.coalesce("found", none))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(named, ",").alias("labels"),
        F.when(F.size("_named") > 0, F.lit(1.0)).otherwise(F.greatest(F.coalesce("most", F.lit(0.0)), F.when(F.size("_base") > 0, F.lit(0.5)).otherwise(0.0))).alias("score"),
    )


def op7_template_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and template matches of every whole text of ``documents``."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]::VARCHAR[]"


_T = ", ".join(f"('{t.label}', {_sql_list(t.words)}, {t.span}, {_sql_list(t.must)}, '{t.phrase}', {_sql_list(t.others)})" for t in (Template(*x) for x in TEMPLATES))
_P = ", ".join(f"('{label}', {_sql_list(p.split())}, {base})" for some, base in ((PHRASES, "true"), (IDENTIFIERS, "false")) for p, label in some)
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t(label, toks, span, must, phrase, others) AS (VALUES {_T}),
p(label, ph, base) AS (VALUES {_P}),
b AS (SELECT rid, span, list_distinct(w[pos + 1:pos + 2 * span]) AS b, ' ' || array_to_string(w[pos + 1:pos + 2 * span], '  ') || ' ' AS s FROM (SELECT rid, w, span, unnest(range(0, greatest(len(w) - span - 1, 0) + 1, span)) AS pos FROM d, (SELECT DISTINCT span FROM t))),
m AS (SELECT rid, label, len(list_intersect(b, toks)) / len(toks) AS c FROM b JOIN t USING (span) WHERE len(list_intersect(b, toks)) >= ceil({CONTAINMENT} * len(toks) - 1e-9) AND list_has_all(b, must)
  AND (phrase = '' OR (length(s) - length(replace(s, phrase, ''))) // greatest(length(phrase), 1) - list_sum(list_transform(others, lambda o: (length(s) - length(replace(s, o, ''))) // length(o))) - CAST(suffix(s, phrase) AS INTEGER) > 0)),
h AS (SELECT rid, label, base, i - 1 AS pos FROM (SELECT rid, w, label, ph, base, unnest(range(1, len(w) + 1)) AS i FROM d, p WHERE list_has_all(w, ph)) WHERE w[i:i + len(ph) - 1] = ph),
hb AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM h WHERE base GROUP BY rid),
l AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM m UNION SELECT rid, label FROM h) GROUP BY rid),
s AS (SELECT rid, max(c) AS c FROM (SELECT rid, c FROM m UNION ALL SELECT rid, 1.0 FROM h WHERE NOT base UNION ALL SELECT rid, 0.5 FROM h WHERE base) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(c, 0.0) AS score
FROM d LEFT JOIN hb USING (rid) LEFT JOIN l USING (rid) LEFT JOIN s USING (rid)
"""
