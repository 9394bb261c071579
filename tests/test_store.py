"""Clustered tables: look-ups that read little, and upserts that rewrite only the buckets they touch."""

from pyspark.sql import functions as F

from lipika.operators import store


def rows(spark, n=200_000):
    return spark.range(n).select((F.col("id") * 3).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit(0).alias("seq"))


def scanned(df):
    """Rows that the scans of df gave, by its plan's metrics."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves, n = plan.collectLeaves(), 0
    for i in range(leaves.size()):
        n += leaves.apply(i).metrics().apply("numOutputRows").value()
    return n


def files_of(spark, path):
    by = {}
    for r in spark.read.parquet(path).select("bucket", "_metadata.file_path").distinct().collect():
        by.setdefault(r.bucket, set()).add(r.file_path)
    return by


def test_a_batch_of_look_ups_reads_little(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    store.save_clustered(rows(spark), at, "k", buckets=16, row_group=16 << 10)
    ids = [3 * i for i in range(0, 100, 1)] + [1, 2, -5]  # neighbours, and keys that are not there
    got = store.lookup_many(spark, at, "k", ids, buckets=16)
    assert {r.k for r in got.collect()} == {3 * i for i in range(100)}
    assert scanned(got) < 0.05 * 200_000
    assert store.lookup_many(spark, at, "k", [7], buckets=16).count() == 0
    assert scanned(store.lookup_many(spark, at, "k", [300_001], buckets=16)) == 0  # within a row group's range, but not in its Bloom filter
    assert store.lookup_many(spark, at, "k", [], buckets=16).count() == 0


def test_upsert_touches_only_its_buckets(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    base = rows(spark, 3000)
    store.save_clustered(base, at, "k", buckets=32)
    before = files_of(spark, at)
    new = spark.createDataFrame([(3, "changed", 1), (3, "changed again", 2), (10_000_001, "added", 1)], "k long, v string, seq int")
    n = store.upsert_buckets(spark, at, new, "k", [F.col("seq")], buckets=32)
    after = files_of(spark, at)
    changed = {b for b in after if after[b] != before.get(b)}
    assert 1 <= n <= 2 and len(changed) == n
    want = {r.k: r.v for r in base.collect()} | {3: "changed again", 10_000_001: "added"}
    assert {r.k: r.v for r in spark.read.parquet(at).collect()} == want
    # the same rows again change nothing but the files
    assert store.upsert_buckets(spark, at, new, "k", [F.col("seq")], buckets=32) == n
    assert {r.k: r.v for r in spark.read.parquet(at).collect()} == want
    assert store.upsert_buckets(spark, at, new.limit(0), "k", [F.col("seq")], buckets=32) == 0
