"""The chunk store: upserts, lookups and counts over tables of parents and children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lipika.sources import files


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of both, the last by order for each key: new rows replace old ones, and later new ones earlier ones."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_batch"), *[c.desc() for c in order])
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_batch")


def numbered(rows: DataFrame, order: list[str], name: str = "vector_index", ranges: int | None = None) -> DataFrame:
    """Rows numbered from 0 in order, without one task that sorts all: rows are ranged by order, written with their place in their range, and shifted by the counts before it. ranges: as many as the input has partitions, or Spark's shuffles where these are more."""
    n = ranges or max(rows.rdd.getNumPartitions(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = files.stash(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_i", F.monotonically_increasing_id()))
    # the upper bits of such an id are the partition, the lower 33 the place in it
    counts = placed.groupBy(F.shiftright("_i", 33).alias("_p")).agg(F.count("*").alias("_c"))
    before = counts.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    both = placed.withColumn("_p", F.shiftright("_i", 33)).join(F.broadcast(before), "_p")
    return both.withColumn(name, (F.col("_i").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")).cast("bigint")).drop("_p", "_i", "_before")


def child_counts(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Every parent with its number of children, 0 without any."""
    n = children.groupBy(key).agg(F.count("*").alias("child_count"))
    return parents.join(n, key, "left").withColumn("child_count", F.coalesce("child_count", F.lit(0)))


def statistics(parents: DataFrame, children: DataFrame, story: str) -> DataFrame:
    """One row: parents, children, distinct stories, children a parent (0 without parents)."""
    p = parents.agg(F.count("*").alias("total_parents"), F.countDistinct(story).alias("total_stories"))
    c = children.agg(F.count("*").alias("total_children"))
    return p.crossJoin(c).withColumn("avg_children_per_parent", F.when(F.col("total_parents") > 0, F.round(F.col("total_children") / F.col("total_parents"), 6)).otherwise(0.0))


def with_parent(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is there."""
    return children.join(parents.select(key), key, "left_semi")


def children_of(children: DataFrame, parent: str, order: str, values: list | None = None, name: str = "position") -> DataFrame:
    """Children with their position (from 1) among their parent's, by order; values: of these parents only."""
    some = children.where(F.col(parent).isin(values)) if values is not None else children
    return some.withColumn(name, F.row_number().over(Window.partitionBy(parent).orderBy(order)).cast("bigint"))


def clear(spark: SparkSession, path: str, tables: tuple[str, ...] = ("stories", "parents", "children", "bm25", "vectors")) -> list[str]:
    """Deletes the tables of an index folder; the names of those that were there. Other files in the folder stay."""
    return [t for t in tables if files.delete(spark, f"{path}/{t}")]


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def save_clustered(rows: DataFrame, path: str, key: str, buckets: int = 64, row_group: int = 1 << 20, mode: str = "overwrite") -> None:
    """Writes rows for look-ups by key: in folders by a hash of the key, sorted by it within files, in small row groups of which each has the key's range and a Bloom filter. A bucket of many rows fills several files, each with a range of its own."""
    ordered = rows.withColumn("bucket", _bucket(key, buckets)).repartitionByRange("bucket", key).sortWithinPartitions("bucket", key)
    ordered.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("parquet.block.size", row_group).option(f"parquet.bloom.filter.enabled#{key}", "true").partitionBy("bucket").parquet(path)


def lookup_many(spark: SparkSession, path: str, key: str, values: list, buckets: int = 64) -> DataFrame:
    """The rows of save_clustered() with one of a batch of keys. Only folders of their hashes are listed, and within these only row groups read whose range and Bloom filter allow one of them."""
    rows = spark.read.parquet(path)
    kind = rows.schema[key].dataType
    held = spark.createDataFrame([(v,) for v in values], "v " + kind.simpleString()).select(_bucket("v", buckets).alias("b")).distinct().collect()
    # a long list would go to the files as its least and greatest value only, so it goes in short ones
    short = max(1, int(spark.conf.get("spark.sql.parquet.pushdown.inFilterThreshold")))
    some = F.lit(False)
    for i in range(0, len(values), short):
        some = some | F.col(key).isin(values[i : i + short])
    return rows.where(F.col("bucket").isin([r["b"] for r in held]) & some).drop("bucket")


def upsert_buckets(spark: SparkSession, path: str, new: DataFrame, key: str, order: list[Column], buckets: int = 64) -> int:
    """Replaces and adds the rows of new in a table of save_clustered(), of several with one key the last by order; how many buckets were rewritten. Other buckets keep their files.

    Old rows without a new one are found by comparing keys alone, so of both sides only rows of touched buckets are read, and no row is compared by more than its key. The buckets are written anew from a copy in the shared folder, as no file may be read while it is replaced; should a run end before all are, another run with the same rows gives the same table, as long as no bucket had lost its old files.
    """
    w = Window.partitionBy(key).orderBy(*[c.desc() for c in order])
    last = files.stash(new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n"))
    touched = [r["b"] for r in last.select(_bucket(key, buckets).alias("b")).distinct().collect()]
    if not touched:
        return 0
    rows = spark.read.parquet(path).where(F.col("bucket").isin(touched)).drop("bucket")
    kept = rows.join(last.select(key), key, "left_anti")
    save_clustered(files.stash(kept.unionByName(last.select(rows.columns))), path, key, buckets)
    return len(touched)


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.where(F.col(key) == F.lit(value))


def token_statistics(chunks: DataFrame, kind: str) -> DataFrame:
    return chunks.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.min("token_count").alias("min_tokens"), F.max("token_count").alias("max_tokens"), F.round(F.avg("token_count"), 6).alias("avg_tokens"))
