"""Ranked search against scores from the definition."""

import math
import re

from catalograph.llm import search

from .helpers import clashing, docs, empty, odd, passage

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def _brute(documents, items):
    own = [(i, _terms(t)) for i, t in documents]
    own = [(i, t) for i, t in own if t]
    total, n_docs = sum(len(t) for _, t in own), len(own)
    df = {}
    for _, t in own:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, []).extend(_terms(t))
    out = []
    for item, words in asked.items():
        scores = []
        for i, t in own:
            m = 100 - 75 + (75 * len(t) * n_docs) // total
            score = 0
            for w in words:
                tf = t.count(w)
                if tf:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, i is not None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores)[:10])]
    return sorted(out, key=repr)


def _items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def _got(df):
    return sorted(map(tuple, df.collect()), key=repr)


ITEMS = [(1, "Alpha3 beta5, ALPHA3; gamma9 épsilon"), (2, None), (3, ""), (4, "nothing of that"), (5, "TAIL " + "é" * 50), (5, "x same_text"), (None, "one two one"), (6, "\U0001f600 tail here")]


def _documents(spark):
    rows = [(k, passage(k, 5 + 7 * k % 40)) for k in range(60)] + [(100 + k, passage(3, 20)) for k in range(12)]
    rows += [(200, "alpha3beta5 xalpha3 alpha3x"), (201, "alpha3"), (202, "ÉPSILON épsilon Épsilon"), (203, " \t.;!"), (204, "alpha3 " * 500)]
    return docs(spark, rows).unionByName(odd(spark))


def test_against_brute_force(spark):
    df = _documents(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert _got(search.search(df, _items(spark, ITEMS))) == _brute(rows, ITEMS)


def test_blocks_and_small_steps(spark, monkeypatch):
    df = _documents(spark)
    items = ITEMS + [(10 + k, passage(k, 8)) for k in range(20)]
    want = _got(search.search(df, _items(spark, items)))
    monkeypatch.setattr(search, "PAIRS", 30)
    assert _got(search.search(df, _items(spark, items))) == want == _brute([(r.doc_id, r.text) for r in df.collect()], items)


def test_best_of_many():
    import numpy as np

    rng = np.random.default_rng(0)
    item, score, doc = rng.integers(0, 7, 5000), rng.integers(1, 40, 5000), rng.permutation(5000)
    best = search.Best(7, 10)
    for i in range(0, 5000, 300):
        best.add(item[i : i + 300], score[i : i + 300], doc[i : i + 300])
        best.rank()
    want = [r for k in range(7) for r in sorted(((k, -s, d) for j, s, d in zip(item, score, doc) if j == k))[:10]]
    assert list(zip(best.item, -best.score, best.doc)) == want


def test_clashes_and_empty(spark):
    df, items = _documents(spark), _items(spark, ITEMS)
    assert _got(search.search(clashing(df), clashing(items))) == _got(search.search(df, items))
    assert search.search(empty(spark), items).count() == 0
    assert search.search(df, _items(spark, [])).count() == 0
    assert search.search(docs(spark, [(1, "..."), (2, None)]), items).count() == 0
