"""Ball k-means codes against comparing everything."""

import hashlib

import numpy as np
from catalograph.llm import codes


def _brute(rows):
    """From the definition: (vec_id, code, error, label_error, digest), sorted."""
    kept = [(i, lab, [int(np.floor(256 * float(c))) for c in v]) for i, v, lab in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[2], "<i4").tobytes()))
    kept = [(i, lab, np.array(q + [0] * (-len(q) % 16)).reshape(16, -1)) for i, lab, q in kept if len(q) == len(kept[0][2])]
    books = [[q[p] for _, _, q in kept[:64]] for p in range(16)]

    def near(q, p):
        return min((int(((q[p] - c) ** 2).sum()), e) for e, c in enumerate(books[p]))

    for _ in range(2):
        own = [[near(q, p)[1] for p in range(16)] for _, _, q in kept]
        books = [[np.array([int(sum(int(x[j]) for x in mine)) // len(mine) for j in range(len(c))]) if (mine := [kept[k][2][p] for k in range(len(kept)) if own[k][p] == e]) else c for e, c in enumerate(books[p])] for p in range(16)]
    digest = hashlib.sha256(",".join(str(int(x)) for b in books for c in b for x in c).encode()).hexdigest()
    done = [[near(q, p) for p in range(16)] for _, _, q in kept]
    error = [sum(d for d, _ in x) for x in done]
    by = {}
    for (_, lab, _), e in zip(kept, error):
        by[lab] = by.get(lab, 0) + e
    return sorted(((i, bytes(e for _, e in x).hex(), err, by[lab], digest) for (i, lab, _), x, err in zip(kept, done, error)), key=repr)


def _got(spark, rows, extra=()):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    from pyspark.sql import functions as F

    return sorted(map(tuple, codes.compress(df.withColumns({c: F.lit("x") for c in extra})).collect()), key=repr)


def _clusters(seed, n, dim):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dim))
    return [(i, [float(np.float32(x)) for x in centres[i % 9] * (i % 3) + 0.2 * rng.normal(size=dim)], i % 4 or None) for i in range(n)]


def test_against_brute_force(spark):
    rows = _clusters(0, 300, 32)
    assert _got(spark, rows) == _brute(rows)


def test_odd_rows(spark):
    good = _clusters(1, 90, 20)  # 20 components: filled up to 32
    odd = [(1, None, 1), (2, [], 1), (3, [None] * 20, 1), (4, [float("nan")] * 20, None), (5, [float("inf")] + [0.0] * 19, 2), (6, [1.0, 2.0], 1), (None, [0.25] * 20, None)]
    ties = [(7, good[7][1], None), (7, good[7][1], 3), (7, good[8][1], 3), (200, [0.0] * 20, 5), (201, [1e-9] * 20, 5), (202, [-1e-9] * 20, 5)]
    rows = good + odd + ties
    assert _got(spark, rows, ["q", "code", "part", "n", "far", "node", "error"]) == _brute(rows)


def test_few_and_none(spark):
    rows = _clusters(2, 5, 16)
    assert _got(spark, rows) == _brute(rows)
    assert _got(spark, []) == [] and _got(spark, [(1, None, 1)]) == []


def test_largest_components(spark):
    rows = [(i, [3e38 if i % 2 else -3e38] * 16, None) for i in range(3)]
    got = _got(spark, rows)
    assert [r[2] for r in got] == [0, 0, 0] and got[0][1] == "00" * 16 and got[1][1] == "01" * 16


def test_rings_compare_enough():
    """Rounds by balls give what full comparisons give, on entries that move a lot, little and not at all."""
    rng = np.random.default_rng(3)
    for spread in (0, 1, 30, 400):
        x = np.concatenate([rng.integers(-500, 500, (400, 3)), np.repeat(rng.integers(-500, 500, (4, 3)), 30, 0)])
        before = rng.integers(-500, 500, (20, 3))
        after = before + rng.integers(-spread, spread + 1, before.shape) * (rng.random((20, 1)) < 0.5)
        old, d = codes.nearest(x, before, np.arange(20))
        far = np.full(20, -1)
        np.maximum.at(far, old, d)
        ball = codes.Balls(after, before, far)
        own, d = ball.assign(x, old, True)
        want, want_d = codes.nearest(x, after, np.arange(20))
        assert (own == want).all() and (d == want_d).all()
        if not spread:
            assert ball.still.all()
