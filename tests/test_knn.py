"""Exact nearest neighbours by pivots against the blocks' exhaustive search."""

import numpy as np
import pytest

from lipika.operators import knn, vector

SCHEMA = "vec_id long, embedding array<float>"


def frame(spark, m, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(m)], SCHEMA).repartition(3)


def shown(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.dist) for r in df.collect())


def asked(base, m=7):
    return base.where(f"vec_id % {m} = 0").withColumnRenamed("vec_id", "query_id")


@pytest.mark.parametrize("k, config", [(5, knn.KnnConfig()), (1, knn.KnnConfig(cell_rows=10, block_rows=50)), (40, knn.KnnConfig(cell_rows=300, block_rows=64)), (2000, knn.KnnConfig())])
def test_same_as_all_pairs(spark, k, config):
    r = np.random.default_rng(2)
    m = np.vstack([r.normal(size=(300, 6)), np.repeat(r.normal(size=(1, 6)), 200, axis=0), r.normal(size=(150, 6)) * 10]).astype(np.float32)  # a third are one vector
    base = frame(spark, m)
    assert shown(knn.pivot_topk(base, asked(base), k, config=config)) == shown(vector.l2_topk(base, asked(base), k))


def test_clusters_are_ruled_out(spark):
    r = np.random.default_rng(3)
    m = np.repeat(r.normal(size=(50, 16)) * 5, 40, axis=0) + r.normal(size=(2000, 16)) * 0.2
    base, report = frame(spark, m.astype(np.float32)), {}
    got = knn.pivot_topk(base, asked(base), 10, report=report, config=knn.KnnConfig(cell_rows=40))
    assert shown(got) == shown(vector.l2_topk(base, asked(base), 10))
    assert report["share"] < 0.2


def test_edges(spark):
    base = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], SCHEMA)
    q = spark.createDataFrame([(9, [1.0, 0.1]), (8, None)], "query_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id, r["rank"]) for r in knn.pivot_topk(base, q, 5).orderBy("rank").collect()] == [(9, 1, 1), (9, 3, 2)]
    assert knn.pivot_topk(base.limit(0), q, 5).count() == 0
    assert knn.pivot_topk(base, q.limit(0), 5).count() == 0


def test_a_cell_is_searched_in_blocks_and_every_pair_is_met(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in (np.ones(3) if i < 40 else rng.normal(size=3))]) for i in range(120)]  # one large group of equal vectors
    base = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = base.where("vec_id % 6 = 0").withColumnRenamed("vec_id", "query_id")
    cells, centres = vector.ivf_cells(base, 4)
    found = vector._probed(cells, centres, queries, 7, 4, "vec_id", "query_id", "embedding", block_rows=8)
    want = vector.l2_topk(base, queries, 7)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    # centres travel with a function, not as literals of the plan
    assert str(found._jdf.queryExecution().analyzed()).count("array(") < 4
