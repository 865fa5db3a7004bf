"""Near-duplicate embeddings against brute force."""

import numpy as np

from catalograph.llm import embeddings as em


def _brute(rows):
    unit = {}
    for k, (i, v) in enumerate(rows):
        if v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            x = np.array(v, float)
            unit[k] = x / np.linalg.norm(x)
    links = {k: set() for k in range(len(rows))}
    for a in unit:
        for b in unit:
            if a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9:
                links[a].add(b)
    comp = {k: k for k in links}
    while True:
        new = {k: min([comp[k], *[comp[j] for j in links[k]]]) for k in links}
        if new == comp:
            break
        comp = new
    ids = {}
    for k in links:
        ids[comp[k]] = min(ids.get(comp[k], 10**9), rows[k][0])
    return sorted((rows[k][0], len(links[k]), ids[comp[k]], ids[comp[k]] == rows[k][0]) for k in links)


def _frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = []
    for g in range(40):
        base = rng.normal(size=16)
        for k in range(1 + g % 6):
            rows.append((len(rows), [float(np.float32(x)) for x in base + 0.05 * k * rng.normal(size=16)]))
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1002, None), (1003, []), (1004, [0.0] * 16), (1005, [float("nan")] * 16), (1006, [None] + [1.0] * 15), (1007, [1.0, 0.0]), (1008, [2.0, 0.1])]
    got = sorted(tuple(r) for r in em.near_duplicates(_frame(spark, rows)).collect())
    want = _brute(rows)
    found, all_ = sum(r[1] for r in got), sum(r[1] for r in want)
    assert [r[0] for r in got] == [r[0] for r in want] and all(g[1] <= w[1] for g, w in zip(got, want))
    assert found >= 0.9 * all_
    assert got[-9:-7] == want[-9:-7] and got[-7:-2] == [(i, 0, i, True) for i in range(1002, 1007)]


def test_hot_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(em, "BLOCK", 16)
    rng = np.random.default_rng(1)
    base = rng.normal(size=16)
    rows = [(i, [float(x) for x in base + 0.01 * rng.normal(size=16)]) for i in range(100)]
    got = em.near_duplicates(_frame(spark, rows)).toPandas()
    assert (got.n_links == 99).mean() > 0.9 and (got.component_id == 0).all()


def test_empty_and_extra_columns(spark):
    from pyspark.sql import functions as F

    assert em.near_duplicates(_frame(spark, [])).count() == 0
    df = _frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]).withColumns({"node": F.lit("x"), "key": F.lit(1), "vec": F.lit(2), "label": F.lit(None)})
    assert sorted(tuple(r) for r in em.near_duplicates(df).collect()) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    n = rng.normal(size=a.shape)
    n -= (n * a).sum(1)[:, None] * a
    n /= np.linalg.norm(n, axis=1)[:, None]
    b = 0.9 * a + np.sqrt(1 - 0.81) * n
    for size in (1000, 50_000, 2_000_000):
        codes = em.Codes(np.vstack([a, b])[:3000], size)
        assert (codes.keys(a) == codes.keys(b)).any(1).mean() >= 0.9


def test_labels_of_links():
    rng = np.random.default_rng(4)
    for n, m in ((1, 0), (50, 0), (200, 120), (200, 400), (300, 299)):
        i, j = (np.arange(m), np.arange(1, m + 1)) if m == n - 1 else (rng.integers(0, n, m), rng.integers(0, n, m))
        want = np.arange(n)
        for _ in range(n):
            for a, b in zip(i, j):
                want[a] = want[b] = min(want[a], want[b])
        assert (em.joined(n, i, j) == want).all()


def test_many_near_copies_in_time(spark):
    """6000 near copies and others: every link counted once, whatever the number of tables they share."""
    import time

    rng = np.random.default_rng(6)
    base = rng.normal(size=64)
    x = np.vstack([base + 0.02 * rng.normal(size=(6000, 64)), rng.normal(size=(500, 64))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    began = time.time()
    got = em.near_duplicates(df).toPandas().sort_values("vec_id")
    assert (got.n_links[:6000] == 5999).all() and (got.n_links[6000:] == 0).all() and (got.component_id[:6000] == 0).all()
    assert time.time() - began < 60
