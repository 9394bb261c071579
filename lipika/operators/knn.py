"""Exact nearest neighbours by pivots: every vector belongs to the cell of its nearest pivot, and a query meets only the cells that the triangle inequality cannot rule out."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lipika.operators.vector import _k_nearest
from lipika.sources import files


@dataclass(frozen=True)
class KnnConfig:
    """sample: vectors that the pivots are fitted on; cell_rows: rows a cell has on average, most_cells bounds the cells (which travel with the plan); block_rows: most vectors, and most queries, that meet in one task."""

    sample: int = 20_000
    cell_rows: int = 64
    most_cells: int = 2048
    iterations: int = 5
    block_rows: int = 8192
    seed: int = 7


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of all rows to all pivots, from differences: rounding is far below the slack of the bounds."""
    return np.sqrt(np.stack([((x - p) ** 2).sum(1) for p in pivots], axis=1)) if len(x) else np.zeros((0, len(pivots)))


def fit_pivots(sample: np.ndarray, n: int, c: KnnConfig) -> np.ndarray:
    """n pivots at most: means of clusters of the sample, from distinct random rows on."""
    r = np.random.default_rng(c.seed)
    distinct = np.unique(sample, axis=0)
    pivots = distinct[r.choice(len(distinct), min(n, len(distinct)), replace=False)]
    for _ in range(c.iterations):
        near = np.argmin((pivots * pivots).sum(1)[None, :] - 2 * sample @ pivots.T, axis=1)
        held = np.bincount(near, minlength=len(pivots))
        sums = np.zeros_like(pivots)
        np.add.at(sums, near, sample)
        pivots = sums[held > 0] / held[held > 0, None]
    return pivots


def pivot_topk(base: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", query_key: str = "query_id", vector: str = "embedding", digits: int = 6, config: KnnConfig = KnnConfig(), report: dict | None = None) -> DataFrame:
    """query_key, key, dist, rank as vector.l2_topk() gives them, exactly, without meeting all pairs of blocks.

    First each query meets its nearest cells, as many as hold k rows; their k-th distance bounds its k-th of all. Then it meets every other cell whose pivot is not farther than its radius and that bound together, and within a cell only rows whose own distance to the pivot allows it. Large cells are split, and queries come in slices, so no task holds more than a block of either.
    Null vectors take no part. report, if given, gets the cells and the share of (query, cell) pairs that met.
    """
    c, spark = config, base.sparkSession
    kind = base.schema[vector].dataType.simpleString()
    base = files.stash(base.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v")))
    asked = files.stash(queries.where(F.col(vector).isNotNull()).select(F.col(query_key).alias("q"), F.col(vector).alias("v")))
    total = base.count()
    if not total:
        return spark.createDataFrame([], f"{query_key} long, {key} long, dist double, rank int")
    drawn = base.select("v").orderBy(F.xxhash64("v", F.lit(c.seed))).limit(min(c.sample, total))
    pivots = fit_pivots(np.array([r.v for r in drawn.toLocalIterator()], np.float64), max(1, min(c.most_cells, total // c.cell_rows)), c)
    sent = spark.sparkContext.broadcast(pivots)

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = _to_pivots(_matrix(b.column(1)), sent.value) if b.num_rows else np.zeros((0, 1))
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near), pa.array(d[np.arange(len(d)), near])], names=["id", "v", "cell", "off"])

    rows = files.stash(base.mapInArrow(celled, f"id long, v {kind}, cell long, off double"))
    facts = {r["cell"]: (r["n"], r["radius"]) for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("off").alias("radius")).collect()}
    n = np.array([facts.get(i, (0, 0.0))[0] for i in range(len(pivots))])
    radius = np.array([facts.get(i, (0, 0.0))[1] for i in range(len(pivots))])
    parts = np.maximum(1, -(-n // c.block_rows))
    slices = max(1, -(-asked.count() // c.block_rows))
    slack = 10.0**-digits
    parts_of = F.get(F.array(*[F.lit(int(x)) for x in parts]), F.col("cell").cast("int")) if (parts > 1).any() else F.lit(1)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("id"), parts_of).cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    def visits(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: list[tuple] = []
                d = _to_pivots(_matrix(b.column(1)), sent.value) if b.num_rows else ()
                bounds = b.column(2).to_numpy(zero_copy_only=False) if b.num_rows else ()
                for i, own in enumerate(d):
                    order = np.argsort(own, kind="stable")
                    nearest = order[: int(np.searchsorted(np.cumsum(n[order]), min(k, total))) + 1]
                    if first:
                        cells = nearest
                    else:
                        cells = np.setdiff1d(np.nonzero((own - radius <= bounds[i] + slack) & (n > 0))[0], nearest)
                    out += [(i, int(x), p, float(own[x])) for x in cells for p in range(int(parts[x]))]
                at = pa.array([x[0] for x in out], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int32()), pa.array([x[3] for x in out], pa.float64())], names=["q", "v", "bound", "cell", "part", "away"])

        return run

    def met(some: DataFrame, first: bool) -> tuple[DataFrame, DataFrame]:
        def best(left: pa.Table, right: pa.Table) -> pa.Table:
            found = []
            if left.num_rows and right.num_rows:
                x, ids, off = _matrix(left.column("v").combine_chunks()), left.column("id").to_numpy(), left.column("off").to_numpy()
                order = np.argsort(off, kind="stable")
                x, ids, off = x[order], ids[order], off[order]
                y, names, bound, away = _matrix(right.column("v").combine_chunks()), right.column("q").to_numpy(), right.column("bound").to_numpy(), right.column("away").to_numpy()
                for a in range(0, len(y), 256):  # bounds the matrix of distances
                    b = slice(a, a + 256)
                    # rows farther from or nearer to the pivot than any of these queries' bounds allow are left out
                    low = np.searchsorted(off, (away[b] - bound[b] - slack).min())
                    high = np.searchsorted(off, (away[b] + bound[b] + slack).max(), "right")
                    if high > low:
                        row, near, dist = _k_nearest(x[low:high], ids[low:high], y[b], k, digits)
                        found.append(pa.table({"q": pa.array(names[a + row]), "id": pa.array(near), "dist": pa.array(dist)}))
            return pa.concat_tables(found) if found else pa.table({"q": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})

        seen = files.stash(some.mapInArrow(visits(first), f"q long, v {kind}, bound double, cell long, part int, away double").withColumn("slice", F.pmod(F.xxhash64("q"), F.lit(slices)).cast("int")))
        return seen, files.stash(dealt.groupBy("cell", "part", "slice").cogroup(seen.groupBy("cell", "part", "slice")).applyInArrow(best, "q long, id long, dist double"))

    by = Window.partitionBy("q").orderBy("dist", "id")
    seen, near = met(asked.withColumn("bound", F.lit(float("inf"))), True)
    # squared and rounded distances, so the bound itself is widened by what rounding can hide
    last = near.withColumn("n", F.row_number().over(by)).where(F.col("n") == k).select("q", F.sqrt(F.col("dist") + slack).alias("bound"))
    bounded = asked.join(last, "q", "left").select("q", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    more, far = met(bounded, False)
    if report is not None:
        pairs = seen.unionByName(more).where("part = 0").count()
        report |= {"cells": int((n > 0).sum()), "met": pairs, "share": pairs / max(1, asked.count() * int((n > 0).sum()))}
    return near.unionByName(far).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select(F.col("q").alias(query_key), F.col("id").alias(key), "dist", "rank")
