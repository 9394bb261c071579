"""The fitted encoder against numpy's decomposition of the same matrix, and copies among each other's nearest."""

import os

import numpy as np
import pytest

from lipika.operators import lsa, vector

SF = "/root/testdata/sf0.01"


def dense(spark, docs, c):
    """The tf-idf matrix, only of buckets that are there."""
    rows = [r["_ids"] for r in lsa.hashed(docs.select("text"), "text", c).collect()]
    df = np.zeros(c.buckets)
    for r in rows:
        df[r] += 1
    idf = np.where(df > 0, np.log((1 + len(rows)) / (1 + df)) + 1, 0)
    a = np.zeros((len(rows), c.buckets))
    for i, r in enumerate(rows):
        a[i, r] = idf[r]
    n = np.linalg.norm(a, axis=1, keepdims=True)
    return np.divide(a, n, out=a.copy(), where=n > 0), idf


@pytest.fixture(scope="module")
def small(spark):
    r = np.random.default_rng(1)
    words = ["".join(r.choice(list("aeimnorst"), r.integers(2, 8))) for _ in range(300)]
    topics = [r.choice(words, 40) for _ in range(8)]
    rows = [(i, " ".join(r.choice(topics[i % 8], 30))) for i in range(240)] + [(900, None), (901, ""), (902, "zzzz")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_values_and_space_as_numpy_has_them(spark, small):
    c = lsa.LsaConfig(buckets=2048, dims=8, oversample=8, power=6)
    m = lsa.fit_lsa(small, config=c)
    a, idf = dense(spark, small, c)
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(m.idf, idf) and np.allclose(m.values, s[:8], rtol=1e-3)
    # the same space: each leading direction lies within the other's
    assert np.linalg.norm(vt[:7] @ m.vectors, axis=1).min() > 0.99
    assert np.allclose(m.vectors.T @ m.vectors, np.eye(8), atol=1e-8)


def test_embeddings_and_the_stored_model(spark, small, tmp_path):
    c = lsa.LsaConfig(buckets=2048, dims=8, oversample=8)
    m = lsa.fit_lsa(small, config=c)
    lsa.save_lsa(spark, m, f"file://{tmp_path}/m")
    shown = lambda x: {r.doc_id: tuple(r.embedding) for r in lsa.embed_lsa(small, x).collect()}
    got = shown(m)
    assert got == shown(lsa.load_lsa(spark, f"file://{tmp_path}/m")) == shown(lsa.fit_lsa(small, config=c))
    n = {i: np.linalg.norm(v) for i, v in got.items()}
    assert n[900] == n[901] == 0 and all(abs(x - 1) < 1e-5 for i, x in n.items() if i < 900)
    # texts of one topic are nearer to each other than to those of others
    v = np.array([got[i] for i in range(240)])
    s = v @ v.T
    same = np.arange(240)[:, None] % 8 == np.arange(240)[None, :] % 8
    assert s[same].mean() > 0.8 > 0.5 > s[~same].mean()


def test_nothing_to_fit_on(spark, small):
    m = lsa.fit_lsa(small.limit(0), config=lsa.LsaConfig(buckets=64, dims=4, oversample=2))
    assert not m.values.any() and not m.vectors.any()
    assert lsa.embed_lsa(small.limit(0), m).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_given_documents(spark):
    """Singular values within 1 % of numpy's, and copies among each other's first five."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    c = lsa.LsaConfig(buckets=1 << 13, dims=32)
    m = lsa.fit_lsa(docs, config=c)
    a, _ = dense(spark, docs, c)
    s = np.sqrt(np.maximum(np.linalg.eigvalsh(a @ a.T)[::-1][:32], 0))
    assert np.allclose(m.values, s, rtol=0.01)
    rows = {r.doc_id: r.text for r in docs.collect()}
    by = {}
    for i, t in rows.items():
        by.setdefault(t, []).append(i)
    shingles = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows.items())}
    pairs = {(i, j) for x in by.values() if 1 < len(x) <= 4 for i in x for j in x if i != j}
    ids = sorted(rows)
    index = {}
    for i in ids:
        for g in sorted(shingles[i])[:3]:
            index.setdefault(g, []).append(i)
    for x in index.values():
        for i in x:
            for j in x:
                if i != j and len(x) <= 4 and len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]):
                    pairs.add((i, j))
    e = lsa.embed_lsa(docs, m).select("doc_id", "embedding").withColumnRenamed("doc_id", "vec_id")
    near = {(r.query_id, r.vec_id) for r in vector.l2_topk(e, e.withColumnRenamed("vec_id", "query_id"), 6).collect()}
    assert len(pairs) > 50 and len(pairs & near) >= 0.9 * len(pairs)


def test_rows_coded_once_give_the_same_model_and_embeddings(spark):
    """Blocks of rows are multiplied as dense matrices, in slices by rows and by tokens."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    ids = [sorted(rng.choice(50, size=int(n), replace=False).tolist()) for n in rng.integers(0, 20, size=300)]
    idf = rng.random(50) + 1
    m = rng.normal(size=(50, 4))
    full = np.zeros((300, 50))
    for i, own in enumerate(ids):
        full[i, own] = idf[own]
    full /= np.maximum(np.sqrt((full**2).sum(1, keepdims=True)), 1e-300)
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32()))], names=["_ids"])
    for most, rows in ((1 << 17, 256), (64, 256), (1 << 17, 7)):
        parts = [part @ m[own] for own, part in (x.dense() for x in lsa._slices([batch], idf, most, rows))]
        assert np.allclose(np.concatenate(parts), full @ m)
    c = lsa.LsaConfig(buckets=64, dims=3, oversample=4, power=3)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a king lives", "a queen lives", None, "", "rivers of the north", "a king of rivers"])], "doc_id long, text string")
    coded = lsa.hashed(docs, "text", c)
    model = lsa.fit_hashed(coded, c)
    shown = lambda d: [(r.doc_id, r.embedding) for r in d.orderBy("doc_id").select("doc_id", "embedding").collect()]
    assert np.allclose(model.values, lsa.fit_lsa(docs, config=c).values)
    assert shown(lsa.embed_hashed(coded, model)) == shown(lsa.embed_lsa(docs, model))
