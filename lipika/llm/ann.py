"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, walked best bin first.

The tree is fitted on a bounded sample; every vector is indexed. A query walks the tree through a priority queue and visits the leaves it reaches first, as many as a calibration against brute force found necessary.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table


@dataclass(frozen=True)
class AnnConfig:
    """sample: most vectors the tree is fitted on. leaf_rows: most vectors a leaf holds on average, of the whole table: tables of fewer than leaves times so many have smaller leaves, of least_rows at least; branch: children of a node; max_leaves bounds the tree that is sent to the executors.

    target: recall that the calibration must reach, on probes (vectors of the table that the tree was not fitted on) against brute force over the whole table. reach: shares of a node's radius that the calibration tries in its priority. shard: most vectors, and most queries, that meet in one task.
    """

    k: int = 20
    sample: int = 20_000
    leaf_rows: int = 256
    least_rows: int = 8
    leaves: int = 1024
    branch: int = 8
    max_leaves: int = 16_384
    iterations: int = 8
    target: float = 0.95
    reach: tuple[float, ...] = (0.0, 0.2, 0.4, 0.7, 1.0)
    probes: int = 128
    shard: int = 4096
    seed: int = 7


@dataclass
class Tree:
    """centers[n]: centre of node n; radius[n]: the distance from it of the farthest sample vector of the node; children[n]: its nodes (none: a leaf); leaf[n]: number of a leaf, else -1."""

    centers: list[np.ndarray] = field(default_factory=list)
    radius: list[float] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: down the tree, at each node to the nearest centre."""
        out = np.zeros(len(x), np.int64)
        stack = [(0, np.arange(len(x)))]
        while stack:
            n, rows = stack.pop()
            kids = self.children[n]
            if not kids:
                out[rows] = self.leaf[n]
                continue
            c = np.array([self.centers[k] for k in kids])
            near = np.argmin((c * c).sum(1) - 2 * (x[rows] @ c.T), axis=1)
            stack += [(kid, rows[near == i]) for i, kid in enumerate(kids) if (near == i).any()]
        return out

    def priorities(self, q: np.ndarray, reach: float) -> np.ndarray:
        """Of each row of q and each node, what the node promises: the inner product with its centre and, at a reach of 1, all that a vector within its radius can add to it."""
        return q @ np.array(self.centers).T + reach * np.sqrt((q * q).sum(1))[:, None] * np.array(self.radius)[None, :]

    def walk(self, promise: list[float], leaves: int) -> list[int]:
        """The first leaves that the best-bin-first traversal reaches: always the open node that promises most."""
        queue, order = [(-np.inf, 0)], []
        while queue and len(order) < leaves:
            _, n = heapq.heappop(queue)
            if not self.children[n]:
                order.append(self.leaf[n])
            for kid in self.children[n]:
                heapq.heappush(queue, (-promise[kid], kid))
        return order


def _kmeans(x: np.ndarray, k: int, iterations: int, rng: np.random.Generator) -> np.ndarray:
    """Label of each row, by Lloyd's iterations from distinct random rows; empty clusters vanish."""
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(iterations):
        near = np.argmin((c * c).sum(1) - 2 * (x @ c.T), axis=1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = sums[n > 0] / n[n > 0, None]
    return np.argmin((c * c).sum(1) - 2 * (x @ c.T), axis=1)


def fit_tree(sample: np.ndarray, leaves: int, config: AnnConfig) -> Tree:
    """Splits the largest node in branch clusters until there are about so many leaves; nodes of equal vectors stay whole."""
    rng, t = np.random.default_rng(config.seed), Tree()

    def node(rows: np.ndarray) -> int:
        own = sample[rows]
        t.centers.append(own.mean(0) if len(rows) else np.zeros(sample.shape[1]))
        t.radius.append(float(np.sqrt(((own - t.centers[-1]) ** 2).sum(1).max())) if len(rows) else 0.0)
        t.children.append([])
        t.leaf.append(-1)
        return len(t.centers) - 1

    root = node(np.arange(len(sample)))
    queue, count = [(-len(sample), root, np.arange(len(sample)))], 1
    while queue and count < leaves:
        n, at, rows = heapq.heappop(queue)
        k = min(config.branch, leaves - count + 1, len(rows))
        if k < 2:
            continue
        label = _kmeans(sample[rows], k, config.iterations, rng)
        parts = [rows[label == i] for i in np.unique(label)]
        if len(parts) < 2:
            continue
        for p in parts:
            kid = node(p)
            t.children[at].append(kid)
            heapq.heappush(queue, (-len(p), kid, p))
        count += len(parts) - 1
    for n, kids in enumerate(t.children):
        if not kids:
            t.leaf[n] = t.leaves
            t.leaves += 1
    return t


def usable(v: str) -> Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(v).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def _matrix(col: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, in double precision."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, each summed component by component: equal vectors get equal scores wherever they stand."""
    s = np.zeros(len(x))
    for d in range(x.shape[1]):
        s += x[:, d] * q[d]
    return s


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """embedding, ids: each distinct vector with its k + 1 smallest ids, in order. No other copy can be among a query's k nearest, as ties go to smaller ids and a query leaves out one id, its own.

    The limit of the window is pushed below the shuffle, so a vector that holds a third of all rows sends k + 1 rows from each partition. Vectors are told apart by value, never by a hash alone.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("h", "embedding").orderBy("vec_id")
    first = vectors.withColumn("h", F.xxhash64("embedding")).withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1)
    return first.groupBy("h", "embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("embedding", "ids")


def one_vector_each(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of usable vectors with an id; of several vectors of one id, the least by its components. Only where ids repeat are any vectors moved."""
    good = vectors.select(F.col("vec_id").cast("long"), "embedding").where(F.col("vec_id").isNotNull() & usable("embedding"))
    again = stash(good.groupBy("vec_id").count().where("count > 1").select("vec_id"), "again")
    if again.isEmpty():
        return good
    return good.join(again, "vec_id", "left_anti").unionByName(good.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding")))


def nearest(vectors: DataFrame, queries: DataFrame, config: AnnConfig = AnnConfig(), report: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the config.k nearest found of each query row, its own vec_id left out, all candidates if fewer.

    vectors and queries: vec_id, embedding; other columns are left out. Vectors null, zero or with null or non-finite components and null ids take no part, nor do those whose length is not the most frequent one among vectors (of several, the smallest); repeated rows count once, and of several vectors of one id only the least by its components. Each distinct vector is indexed once with its smallest ids, and each distinct query searched once.
    The driver holds the tree and config.probes probe results, both of bounded size. Shards of neighbouring leaves meet the queries that visit them, in slices of both; large leaves are split, and each query's best of each shard are merged.
    report, if given, gets the tree's size, the leaves visited, the reach and the calibration's recall.
    """
    c = config
    spark = vectors.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    base = stash(distinct_vectors(one_vector_each(vectors), c.k), "vectors")
    lengths = base.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return none
    base, total = base.where(F.size("embedding") == lengths["n"]), lengths["count"]
    # by hash, so fixed and evenly drawn: the first fit the tree, the others are probes
    share = base.select("embedding", F.xxhash64("embedding", F.lit(c.seed)).alias("h")).orderBy("h").limit(min(c.sample + c.probes, total))
    drawn = np.array([r.embedding for r in share.select("embedding").toLocalIterator()], np.float64)
    n_probes = min(c.probes, total // 4)
    sample, probes = drawn[: len(drawn) - n_probes], drawn[len(drawn) - n_probes :]
    leaf_rows = min(c.leaf_rows, max(c.least_rows, total // c.leaves))
    tree = fit_tree(sample, max(1, min(c.max_leaves, total // leaf_rows)), c)
    sent = spark.sparkContext.broadcast((tree.centers, tree.radius, tree.children, tree.leaf, tree.leaves))

    def leaf_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tree(*sent.value)
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(t.assign(_matrix(b.column(0)))), *b.columns], names=["leaf", *b.schema.names])

    kind = base.schema["embedding"].dataType.simpleString()
    index = stash(base.mapInArrow(leaf_of, f"leaf long, embedding {kind}, ids array<long>"), "leaves")
    leaves, reach = _calibrate(index, tree, probes, c, report)

    # shards: runs of leaves of about c.shard vectors; a leaf with more has shards of its own, dealt by hash
    sizes = {r["leaf"]: r["count"] for r in index.groupBy("leaf").count().collect()}
    first, parts, shard, held = [], [], 0, 0
    for i in range(tree.leaves):
        n = sizes.get(i, 0)
        if held and held + n > c.shard:
            shard, held = shard + 1, 0
        k = max(1, -(-n // c.shard))
        first.append(shard)
        parts.append(k)
        shard, held = (shard + k, 0) if k > 1 else (shard, held + n)
    where = spark.createDataFrame([(i, first[i], parts[i]) for i in range(tree.leaves)], "leaf long, shard long, parts long")
    q = one_vector_each(queries).where(F.size("embedding") == lengths["n"]).withColumnRenamed("vec_id", "query_id")
    by_vector = q.withColumn("h", F.xxhash64("embedding"))
    asked = stash(by_vector.groupBy("h", "embedding").agg(F.min("query_id").alias("first")), "queries")
    slices = max(1, -(-asked.count() // c.shard))
    shard = F.col("shard") + F.pmod(F.xxhash64("embedding", F.lit(1)), "parts")
    dealt = index.join(F.broadcast(where), "leaf").select(shard.alias("shard"), "leaf", "embedding", "ids", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tree(*sent.value)
        for b in batches:
            rows: list[tuple[int, int, list[int]]] = []
            promise = t.priorities(_matrix(b.column(1)), reach) if b.num_rows else ()
            for i, own in enumerate(promise):
                by: dict[int, list[int]] = {}
                for leaf in t.walk(own.tolist(), leaves):
                    for s in range(first[leaf], first[leaf] + parts[leaf]):
                        by.setdefault(s, []).append(leaf)
                rows += [(s, i, found) for s, found in by.items()]
            at = pa.array([r[1] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), b.column(0).take(at), b.column(1).take(at), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["shard", "first", "embedding", "visit"])

    visited = asked.select("first", "embedding").mapInArrow(visits, f"shard long, first long, embedding {kind}, visit array<long>").withColumn("slice", F.pmod(F.xxhash64("first"), F.lit(slices)).cast("int"))

    def search(t: pa.Table, s: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if t.num_rows and s.num_rows:
            t = t.sort_by("leaf")
            leaf, x, ids = t.column("leaf").to_numpy(), _matrix(t.column("embedding").combine_chunks()), t.column("ids").to_pylist()
            lead = np.array([i[0] for i in ids])
            names, vectors_, visit = s.column("first").to_pylist(), _matrix(s.column("embedding").combine_chunks()), s.column("visit").to_pylist()
            for name, vec, own in zip(names, vectors_, visit, strict=True):
                runs = [(np.searchsorted(leaf, n), np.searchsorted(leaf, n, "right")) for n in sorted(own)]
                place = np.concatenate([np.arange(a, b) for a, b in runs])
                products = np.concatenate([x[a:b] @ vec for a, b in runs])
                # one more than k vectors, as the query's own may be among them
                at, score = _top(x, lead, products, vec, c.k + 1, place)
                out[0] += [name] * len(at)
                out[1] += [ids[i] for i in at]
                out[2] += score.tolist()
        return pa.table({"first": pa.array(out[0], pa.int64()), "ids": pa.array(out[1], pa.list_(pa.int64())), "score": pa.array(out[2], pa.float64())})

    from pyspark.sql import Window

    found = dealt.groupBy("shard", "slice").cogroup(visited.groupBy("shard", "slice")).applyInArrow(search, "first long, ids array<long>, score double")
    each = found.select("first", F.explode("ids").alias("vec_id"), "score")
    top = each.withColumn("rank", F.row_number().over(Window.partitionBy("first").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= c.k + 1)
    near = stash(top.groupBy("first").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("near")), "near")
    # back to every query row: its own id goes, and the first k of the rest stay
    back = by_vector.join(asked, (by_vector["h"] == asked["h"]) & (by_vector["embedding"] == asked["embedding"])).select("query_id", "first")
    rest = back.join(near, "first").select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, c.k).alias("near"))
    return rest.select("query_id", F.posexplode("near").alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def _top(x: np.ndarray, lead: np.ndarray, products: np.ndarray, q: np.ndarray, k: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the k best vectors, ties to the one with the smallest id."""
    near = place
    if len(place) > 2 * k:
        least = np.partition(products, len(products) - k)[len(products) - k]
        near = place[products >= least - 1e-9 * max(1.0, abs(least))]
    s = exact_scores(x[near], q)
    order = np.lexsort((lead[near], -s))[:k]
    return near[order], s[order]


def _calibrate(index: DataFrame, tree: Tree, probes: np.ndarray, c: AnnConfig, report: dict | None) -> tuple[int, float]:
    """(leaves, reach): the fewest leaves, over the shares of the radius in c.reach, after which the probes' k nearest, by brute force over the whole index, are found with a recall of c.target.

    Each partition gives its k best per probe with their leaves, which the driver merges pairwise by Spark's window; probes are stand-ins for queries, so their own vector doesn't count. The widening goes leaf by leaf along each probe's own traversal.
    """
    if not len(probes):
        return tree.leaves, 0.0
    spark = index.sparkSession
    sent = spark.sparkContext.broadcast(probes)
    k = c.k

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        held: list = [None] * len(p)
        for b in batches:
            leaf, x = b.column(0).to_numpy(), _matrix(b.column(1))
            scores = p @ x.T
            for i in range(len(p)):
                s, f = scores[i], leaf
                own = np.nonzero(np.abs(s - p[i] @ p[i]) < 1e-9)[0]
                own = own[(x[own] == p[i]).all(1)]
                s, f = np.delete(s, own), np.delete(f, own)
                if held[i] is not None:
                    s, f = np.concatenate([held[i][0], s]), np.concatenate([held[i][1], f])
                order = np.argsort(-s, kind="stable")[:k]
                held[i] = (s[order], f[order])
        rows = [(i, float(a), int(f)) for i, h in enumerate(held) if h is not None for a, f in zip(*h, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.int64())], names=["probe", "score", "leaf"])

    from pyspark.sql import Window

    found = index.select("leaf", "embedding").mapInArrow(brute, "probe long, score double, leaf long")
    top = found.withColumn("n", F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "leaf"))).where(F.col("n") <= k).select("probe", "leaf").collect()
    best = None
    for reach in c.reach:
        walks = [{leaf: n for n, leaf in enumerate(tree.walk(own.tolist(), tree.leaves))} for own in tree.priorities(probes, reach)]
        at = sorted(walks[r["probe"]][r["leaf"]] + 1 for r in top)
        leaves = at[min(len(at) - 1, int(np.ceil(c.target * len(at))))] if at else tree.leaves
        if best is None or leaves < best[0]:
            best = (leaves, reach, sum(x <= leaves for x in at) / max(1, len(at)))
    leaves = max(best[0], min(tree.leaves, 2))
    if report is not None:
        report |= {"leaves": tree.leaves, "visited": leaves, "reach": best[1], "probes": len(probes), "recall": best[2]}
    return leaves, best[1]


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose vec_id is divisible by 20, among all others."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
