"""Vector search: exact nearest neighbours in blocks, and cells found by k-means, in memory or stored."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lipika.sources import files


def normalized(v: Column) -> Column:
    """v at length 1; a zero vector stays."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def _k_nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of q, id and rounded squared distance of the k nearest of each row of q, ties to the smaller id.

    One matrix product gives all distances nearly; those that can be among the k nearest are then computed as they are defined.
    """
    near = (x * x).sum(1)[None, :] - 2 * (q @ x.T) + (q * q).sum(1)[:, None]
    slack = 10.0**-digits + 1e-9 * max(1.0, float(np.abs(near).max(initial=0.0)))
    bound = np.partition(near, k - 1, axis=1)[:, k - 1] + 2 * slack if k < len(x) else np.full(len(q), np.inf)
    row, at = np.nonzero(near <= bound[:, None])
    dist = np.round(((x[at] - q[row]) ** 2).sum(1), digits)
    order = np.lexsort((ids[at], dist, row))
    row, at, dist = row[order], at[order], dist[order]
    first = np.searchsorted(row, np.arange(len(q)))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], ids[at[keep]], dist[keep]


def _best_of_blocks(vector: str, k: int, digits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What a task does with a block of rows (id, vector) and one of queries (q, vector): q, id, dist of the k nearest of each query in the block."""

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = [right.schema.field("q").type, left.schema.field("id").type, pa.float64()]
        none = pa.table([pa.array([], x) for x in kinds], names=["q", "id", "dist"])
        if not left.num_rows or not right.num_rows:
            return none
        matrix = lambda t: t.column(vector).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)
        x, ids, names, found = matrix(left), left.column("id").to_numpy(), right.column("q").to_numpy(), []
        y = matrix(right)
        for a in range(0, len(y), 256):  # bounds the matrix of distances
            row, near, dist = _k_nearest(x, ids, y[a : a + 256], k, digits)
            found.append(pa.table([pa.array(names[a + row], kinds[0]), pa.array(near, kinds[1]), pa.array(dist)], names=["q", "id", "dist"]))
        return pa.concat_tables(found)

    return best


def l2_topk(base: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", query_key: str = "query_id", vector: str = "embedding", digits: int = 6, block_rows: int = 8192) -> DataFrame:
    """query_key, key, dist (squared, rounded to digits), rank: the k nearest of each query, ties to the smaller key.

    Both sides are dealt in blocks by hash; each pair of blocks meets in one task, which keeps k rows a query, so nothing is broadcast and a task holds two blocks. Null vectors take no part.
    """
    base, queries = base.where(F.col(vector).isNotNull()), queries.where(F.col(vector).isNotNull())
    n_base, n_queries = (max(1, -(-x.count() // block_rows)) for x in (base, queries))
    b = base.select(F.col(key).alias("id"), vector, F.pmod(F.xxhash64(key), F.lit(n_base)).alias("bb"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_queries - 1).cast("bigint"))).alias("qb"))
    q = queries.select(F.col(query_key).alias("q"), vector, F.pmod(F.xxhash64(query_key), F.lit(n_queries)).alias("qb"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_base - 1).cast("bigint"))).alias("bb"))

    met = b.groupBy("qb", "bb").cogroup(q.groupBy("qb", "bb")).applyInArrow(_best_of_blocks(vector, k, digits), "q long, id long, dist double")
    w = Window.partitionBy("q").orderBy("dist", "id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q").alias(query_key), F.col("id").alias(key), "dist", "rank")


def ivf_cells(base: DataFrame, n_cells: int | None = None, key: str = "vec_id", vector: str = "embedding", seed: int = 7) -> tuple[DataFrame, list[np.ndarray]]:
    """base with cell, and the centres: min(100, floor(sqrt(rows))) cells unless given."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = n_cells or max(1, min(100, isqrt(base.count())))
    data = base.withColumn("_v", array_to_vector(vector))
    model = KMeans(k=n, seed=seed, featuresCol="_v", predictionCol="cell", maxIter=15).fit(data)
    return model.transform(data).drop("_v"), model.clusterCenters()


def _nearest_cells(queries: DataFrame, centres: list[np.ndarray], n: int, query_key: str, vector: str) -> DataFrame:
    """query_key, vector, _cells of queries with a vector: numbers of the n nearest cells, nearest centre first, ties to the smaller number."""
    c = np.array(centres, np.float64).reshape(len(centres), -1)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, found = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1), []
            for a in range(0, len(y), 256):
                d = ((y[a : a + 256, None, :] - c[None]) ** 2).sum(2)
                found.append(np.argsort(d, axis=1, kind="stable")[:, :n].astype(np.int32))
            cells = np.concatenate(found) if found else np.zeros((0, n), np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1) * cells.shape[1], pa.int32()), pa.array(cells.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=[query_key, vector, "_cells"])

    some = queries.where(F.col(vector).isNotNull()).select(query_key, vector)
    return some.mapInArrow(near, T.StructType([*some.schema.fields, T.StructField("_cells", T.ArrayType(T.IntegerType()))]))


def calibrated_probes(cells: DataFrame, centres: list[np.ndarray], queries: DataFrame, k: int, recall: float = 0.95, sample: int = 256, key: str = "vec_id", query_key: str = "query_id", vector: str = "embedding") -> int:
    """The fewest cells to probe that hold that share of the true k nearest (brute force over all rows) of a sample of the queries, chosen by hash. One row a cell comes to the driver."""
    some = files.stash(queries.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(query_key), query_key).limit(sample))
    truth = l2_topk(cells.select(key, vector), some, k, key, query_key, vector).select(query_key, key)
    order = _nearest_cells(some, centres, len(centres), query_key, vector).select(query_key, "_cells")
    place = truth.join(cells.select(key, "cell"), key).join(order, query_key).select(F.array_position("_cells", F.col("cell")).alias("n"))
    by = {r["n"]: r["count"] for r in place.groupBy("n").count().collect()}
    held, total = 0, sum(by.values())
    for n in range(1, len(centres) + 1):
        held += by.get(n, 0)
        if held >= recall * total:
            return n
    return len(centres)


def ivf_topk(base: DataFrame, queries: DataFrame, k: int, nprobe: int | None = 1, n_cells: int | None = None, key: str = "vec_id", query_key: str = "query_id", vector: str = "embedding") -> DataFrame:
    """As l2_topk, but only rows of a query's nprobe nearest cells are compared (None: calibrated_probes()). At most 100 centres travel with the plan."""
    # a column file of few row groups is dealt over all cores once, and cells are assigned once
    cells, centres = ivf_cells(files.stash(files.spread(base.select(key, vector))), n_cells, key, vector)
    cells = files.stash(cells)
    if nprobe is None:
        nprobe = calibrated_probes(cells, centres, queries, k, key=key, query_key=query_key, vector=vector)
    return _probed(cells, centres, queries, k, nprobe, key, query_key, vector)


def _probed(cells: DataFrame, centres: list[np.ndarray], queries: DataFrame, k: int, nprobe: int, key: str, query_key: str, vector: str, block_rows: int = 8192) -> DataFrame:
    """The k nearest of each query among the rows of its nprobe nearest cells. Cells are dealt in blocks of about block_rows by the key's hash, as are queries; a block of a cell meets a block of the queries that probe it in one task, by a matrix product. A row a cell comes to the driver."""
    kinds = cells.schema[key].dataType, queries.schema[query_key].dataType
    cells = cells.where(F.col(vector).isNotNull())
    probes = _nearest_cells(queries, centres, nprobe, query_key, vector).select(F.col(query_key).alias("q"), vector, F.explode("_cells").alias("cell"))
    sizes = {r["cell"]: -(-r["count"] // block_rows) for r in cells.groupBy("cell").count().collect()}
    n_queries = max(1, -(-queries.count() // block_rows))
    blocks = F.coalesce(F.create_map(*[F.lit(x) for cell, n in sizes.items() for x in (cell, n)])[F.col("cell")], F.lit(1)) if sizes else F.lit(1)
    places = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    left = cells.select("cell", F.col(key).alias("id"), vector, F.pmod(F.xxhash64(key), blocks).cast("int").alias("bb"), places(F.lit(n_queries)).alias("qb"))
    right = probes.select("cell", "q", vector, F.pmod(F.xxhash64("q"), F.lit(n_queries)).cast("int").alias("qb"), places(blocks).alias("bb"))
    found = f"q {kinds[1].simpleString()}, id {kinds[0].simpleString()}, dist double"
    met = left.groupBy("cell", "qb", "bb").cogroup(right.groupBy("cell", "qb", "bb")).applyInArrow(_best_of_blocks(vector, k, 6), found)
    w = Window.partitionBy("q").orderBy("dist", "id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q").alias(query_key), F.col("id").alias(key), "dist", "rank")


@dataclass(frozen=True)
class IvfIndex:
    """A stored index: vectors in folders by cell, the centres, the number of cells to probe, and the columns' names."""

    cells: DataFrame
    centres: list[np.ndarray]
    nprobe: int
    key: str
    vector: str


def save_ivf(base: DataFrame, path: str, k: int = 50, n_cells: int | None = None, nprobe: int | None = None, key: str = "vec_id", vector: str = "embedding") -> None:
    """Fits the cells and writes the index under path. nprobe: as many as a sample of the vectors themselves needs for a recall of 0.95 of their k nearest, unless given. Null vectors are left out."""
    cells, centres = ivf_cells(base.where(F.col(vector).isNotNull()).select(key, vector), n_cells, key, vector)
    spark = base.sparkSession
    cells.repartition("cell", F.pmod(F.xxhash64(key), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    written = spark.read.parquet(f"{path}/cells")
    if nprobe is None:
        nprobe = calibrated_probes(written, centres, written.select(F.col(key).alias("_q"), vector), k, key=key, query_key="_q", vector=vector)
    rows = [(i, [float(x) for x in c], nprobe, key, vector) for i, c in enumerate(centres)]
    spark.createDataFrame(rows, "cell int, centre array<double>, nprobe int, key string, vector string").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def load_ivf(spark: SparkSession, path: str) -> IvfIndex:
    """The index as written, without a new fit; the driver reads the centres, 100 rows at most unless more were asked for."""
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    return IvfIndex(spark.read.parquet(f"{path}/cells"), [np.array(r["centre"]) for r in rows], rows[0]["nprobe"], rows[0]["key"], rows[0]["vector"])


def search_ivf(index: IvfIndex, queries: DataFrame, k: int = 50, query_key: str = "query_id", nprobe: int | None = None) -> DataFrame:
    """As ivf_topk over a stored index; queries hold a vector column of the index's name. Only folders of probed cells are read."""
    return _probed(index.cells, index.centres, queries, k, nprobe or index.nprobe, index.key, query_key, index.vector)
