"""The pipeline's stages against brute force on a small corpus, and on the smallest driver table."""

import hashlib

import corpus_pipeline as cp
from catalograph.llm import toxicity

from .helpers import clashing, docs, empty, odd, passage


def _tables(spark, tmp_path):
    data, labels = [], []
    for i in range(240):
        t = passage(i, 40)
        toxic = i % 5 == 0
        if toxic:
            t = t + " blockhead again blockhead " + passage(i + 999, 5)
        data.append((i, f"Footer line\n{t}.", "big" if i % 3 else "small"))
        labels.append((i, 1, int(toxic)))
    data += [(500 + i, f"{passage(i, 40)}.", "small") for i in (1, 2, 3)]
    d = str(tmp_path)
    docs(spark, data).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, data


def test_stages_keep_and_drop_what_they_should(spark, tmp_path):
    d, data = _tables(spark, tmp_path)
    df = spark.read.parquet(f"{d}/documents.parquet")
    columns = df.columns
    out = {}
    for name, stage in cp.STAGES:
        df = stage(spark, df, d)
        df.write.parquet(f"{d}/out-{name}")
        df = spark.read.parquet(f"{d}/out-{name}")
        if name != cp.STAGES[-1][0]:
            assert df.columns == columns
        out[name] = df.toPandas()
    clean = {i for i, t, _ in data if "blockhead" not in t}
    assert set(out["toxicity"].doc_id) == clean
    assert len(out["line_dedup"]) == len(clean) and not out["line_dedup"].text.str.contains("Footer").any()
    assert set(out["near_dedup"].doc_id) == {i for i in clean if i < 500}
    assert set(out["mix"].doc_id) == set(out["near_dedup"].doc_id) and out["mix"].groupby("doc_id").size().max() <= 2
    assert len(out["tokens"]) == len(out["mix"])
    text = dict(zip(out["mix"].doc_id, out["mix"].text))
    for r in out["tokens"].itertuples():
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_run(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    got = cp.run(spark, sf)
    assert 0.5 * n < got.count() <= 2 * n


def test_stages_take_odd_and_empty_tables(spark, sf):
    for name, stage in cp.STAGES:
        for df in (odd(spark), empty(spark), clashing(odd(spark))):
            out = stage(spark, df, sf)
            n = out.count()
            assert (n > 0) == (df.limit(1).count() > 0), name
            if name != "tokens":
                assert out.columns == df.columns, name


def test_threshold_is_the_queries(spark):
    assert toxicity.THRESHOLD == 0.7
