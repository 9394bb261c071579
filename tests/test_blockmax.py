"""The index of blocks against full scoring, and its postings against plain lists."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lipika.operators import blockmax as B
from lipika.operators import lexical as L


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_postings_hold_what_they_were_given(data):
    size = data.draw(st.integers(1, 3000))
    ids = np.array(sorted(data.draw(st.sets(st.integers(0, size - 1), min_size=1, max_size=min(size, 400)))), np.int64)
    p = B.Postings(len(ids), *B.encode_postings(ids, size), size)
    alive = np.array(sorted(data.draw(st.sets(st.integers(0, size - 1), max_size=50))), np.int64)
    hit, n = p.among(alive)
    assert hit.tolist() == sorted(set(alive.tolist()) & set(ids.tolist()))
    assert n <= len(ids)
    if p.bits is None:
        assert p.read(np.arange(len(p.firsts))).tolist() == ids.tolist()


def corpus(spark, n=900, seed=3):
    """Skewed words, so that some tokens are in most documents; equal documents, empty ones and a very long one."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeghiklmnoprstuv") for _ in range(r.randint(2, 8))) for _ in range(400)]
    word = lambda: vocab[min(int(r.expovariate(0.02)), 399)]
    docs = [(i, "the and of " + " ".join(word() for _ in range(r.randint(1, 60)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " "), (n + 3, docs[5][1]), (n + 4, docs[5][1]), (n + 5, " ".join(vocab * 3)), (n + 6, "a")]
    queries = [(i, " ".join(word() for _ in range(r.randint(1, 12)))) for i in range(25)] + [(90, docs[5][1]), (91, ""), (92, None), (93, "qqqq zzzz"), (94, "the and of"), (95, "a")]
    return spark.createDataFrame(docs, "ix long, text string").repartition(5), spark.createDataFrame(queries, "query_id long, text string")


def shown(df):
    return sorted((r.query_id, r["rank"], r.ix, round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize("k, shard_docs", [(1, 8192), (7, 100), (50, 300), (2000, 300)])
def test_same_as_full_scoring(spark, k, shard_docs):
    docs, queries = corpus(spark)
    c = L.Bm25Config(k=k)
    report = {}
    got = B.bm25_blockmax(queries, docs, "query_id", "ix", c=c, digits=6, shard_docs=shard_docs, report=report)
    assert shown(got) == shown(L.bm25(queries, docs, "query_id", "ix", c=c, digits=6))
    assert report["bits"] > 0 and (k > 10 or report["scored"] < 0.7 * report["asked"])


def test_other_parameters_and_no_rounding(spark):
    docs, queries = corpus(spark, 300)
    c = L.Bm25Config(k=5, k1=0.6, b=0.1, n=2, hybrid=False)
    assert shown(B.bm25_blockmax(queries, docs, "query_id", "ix", c=c)) == shown(L.bm25(queries, docs, "query_id", "ix", c=c))


def test_stored_index_reads_its_buckets(spark, tmp_path):
    docs, queries = corpus(spark, 300)
    index = B.block_index(docs, "ix", shard_docs=100)
    B.save_blocks(index, f"file://{tmp_path}/ix", buckets=8)
    asked = queries.select("query_id", F.explode(L.tokens(F.col("text"))).alias("token"))
    loaded = B.load_blocks(spark, f"file://{tmp_path}/ix")
    c = L.Bm25Config(k=9)
    assert shown(B.search_blocks(loaded, asked, "query_id", c, 6, slice_queries=4)) == shown(B.search_blocks(index, asked, "query_id", c, 6))
    assert shown(B.search_blocks(loaded, asked, "query_id", c, 6, most_broadcast=0)) == shown(B.search_blocks(index, asked, "query_id", c, 6))
    assert loaded.blocks.select("bucket").distinct().count() > 1


def test_nothing_asked_or_indexed(spark):
    docs, queries = corpus(spark, 20)
    assert B.bm25_blockmax(queries.limit(0), docs, "query_id", "ix").count() == 0
    assert B.bm25_blockmax(queries, docs.limit(0), "query_id", "ix").count() == 0


def test_string_keys(spark):
    docs = spark.createDataFrame([("b", "red apple"), ("a", "red apple"), ("c", "green pear"), ("d", "blue plum"), ("e", "grey stone")], "ix string, text string")
    queries = spark.createDataFrame([("q", "apple")], "query_id string, text string")
    got = B.bm25_blockmax(queries, docs, "query_id", "ix").orderBy("rank").collect()
    assert [(r.query_id, r.ix) for r in got][:2] == [("q", "a"), ("q", "b")]


def test_tokens_are_neither_stored_nor_shuffled(spark, monkeypatch):
    """What the index's build writes is one row a list or a shard, no document's tokens; no shuffle deals tokens of documents."""
    docs, _ = corpus(spark)
    written, stash = [], B.files.stash
    monkeypatch.setattr(B.files, "stash", lambda df: written.append((df.columns, df._jdf.queryExecution().executedPlan().toString())) or stash(df))
    index = B.block_index(docs, "ix", shard_docs=300)
    assert [x for x, _ in written] == [["shard", "token", "n", "firsts", "gaps", "keys", "lengths"], ["token", "df"], ["shard", "keys", "lengths", "bits"]]
    assert all("Window" not in p and "collect_list" not in p and "explode" not in p for _, p in written)
    assert index.terms.where("bit is not null").count() > 0
    assert index.terms.agg(F.sum("df")).first()[0] == index.docs.select(F.explode("lengths").alias("x")).agg(F.sum("x")).first()[0]


def test_shards_end_at_their_documents_and_tokens(spark, monkeypatch):
    docs, queries = corpus(spark)
    want = shown(L.bm25(queries, docs, "query_id", "ix", c=L.Bm25Config(k=7), digits=6))
    for tokens, shard_docs in ((500, 8192), (B.SHARD_TOKENS, 40)):
        monkeypatch.setattr(B, "SHARD_TOKENS", tokens)
        sizes = [r.n for r in B.block_index(docs.coalesce(1), "ix", shard_docs=shard_docs).docs.select(F.size("keys").alias("n")).collect()]
        assert sum(sizes) == 907 and len(sizes) > 3 and max(sizes) <= shard_docs
        assert shown(B.bm25_blockmax(queries, docs, "query_id", "ix", c=L.Bm25Config(k=7), digits=6, shard_docs=shard_docs)) == want
