"""A fitted encoder: the leading right singular vectors of a corpus's tf-idf matrix, found by subspace iteration in Spark passes.

Tokens are hashed into a fixed number of columns, so the model's size follows from its configuration and never from the corpus. A pass multiplies the matrix, block of documents by block, with a thin matrix of one row a column; what leaves the tasks are partial products of that size, as many as there are cores, not as there are documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lipika.operators.lexical import Bm25Config, tokens
from lipika.sources import files

ROWS = 1024  # columns of the matrix in a block of a partial product


@dataclass(frozen=True)
class LsaConfig:
    """buckets: columns that tokens are hashed into; dims: of an embedding; oversample, power: directions and passes beyond those that accuracy asks for; tokens: how texts are cut."""

    buckets: int = 1 << 14
    dims: int = 64
    oversample: int = 32
    power: int = 8
    seed: int = 7
    tokens: Bm25Config = field(default_factory=Bm25Config)


@dataclass
class LsaModel:
    """idf of each bucket; vectors: a row a bucket; values: the singular values, falling."""

    idf: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    config: LsaConfig


def hashed(rows: DataFrame, text: str, c: LsaConfig) -> DataFrame:
    """rows without text, with _ids: the distinct buckets of its tokens, in order; null and empty texts have none."""
    place = lambda t: F.pmod(F.xxhash64(t), F.lit(c.buckets)).cast("int")
    own = F.coalesce(tokens(F.col(text), c.tokens), F.array().cast("array<string>"))
    return rows.withColumn("_ids", F.sort_array(F.array_distinct(F.transform(own, place)))).drop(text)


class Weighted:
    """Rows of the tf-idf matrix, each of length 1."""

    def __init__(self, col: pa.Array, idf: np.ndarray) -> None:
        sizes = col.value_lengths().to_numpy(zero_copy_only=False)
        self.n, self.ids = len(col), col.flatten().to_numpy(zero_copy_only=False)
        self.row = np.repeat(np.arange(len(col)), sizes)
        w = idf[self.ids]
        length = np.sqrt(np.bincount(self.row, w * w, minlength=self.n))
        self.w = w / np.maximum(length, 1e-300)[self.row]

    def dense(self) -> tuple[np.ndarray, np.ndarray]:
        """(the rows' own buckets, rising; the rows over these). A matrix product of a few hundred rows costs less than gathering their tokens' rows one by one."""
        own = np.flatnonzero(np.bincount(self.ids))
        place = np.empty(own[-1] + 1 if len(own) else 0, np.int64)
        place[own] = np.arange(len(own))
        out = np.zeros((self.n, len(own)))
        out[self.row, place[self.ids]] = self.w
        return own, out


def _slices(batches: Iterator[pa.RecordBatch], idf: np.ndarray, most: int = 1 << 17, rows: int = 256) -> Iterator[Weighted]:
    """The rows of all batches, so many tokens and rows at a time."""
    for b in batches:
        col = b.column(b.schema.names.index("_ids"))
        ends = np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False))
        a = 0
        while a < len(col):
            z = min(a + rows, max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right"))))
            yield Weighted(col.slice(a, z - a), idf)
            a = z


def _product(rows: DataFrame, idf: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A' A m, (A m)' (A m)) for the matrix A of all rows.

    As many tasks as cores read all rows, and each gives one partial product, in blocks of ROWS buckets; blocks are summed in two stages, in the order of the tasks. What comes to the driver has the size of m.
    """
    spark = rows.sparkSession
    tasks = max(1, 2 * spark.sparkContext.defaultParallelism)
    lanes, width = isqrt(tasks) + 1, m.shape[1]
    sent = spark.sparkContext.broadcast((idf, m))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        idf_, m_ = sent.value
        total, gram = np.zeros(m_.shape), np.zeros((width, width))
        for x in _slices(batches, idf_):
            own, part = x.dense()
            y = part @ m_[own]
            total[own] += part.T @ y
            gram += y.T @ y
        at = TaskContext.get().partitionId()
        cells = [(-1, gram), *((i, total[i * ROWS : (i + 1) * ROWS]) for i in range(-(-len(total) // ROWS)))]
        for block, cell in cells:
            if cell.any():
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([at % lanes]), pa.array([at]), pa.array([cell.tobytes()], pa.binary())], names=["block", "lane", "at", "cell"])

    def summed(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        total = sum(np.frombuffer(x.as_buffer()) for x in t.column("cell"))
        return pa.table({"block": t.column("block")[:1], "at": t.column("lane")[:1], "cell": pa.array([total.tobytes()], pa.binary())})

    each = rows.select("_ids").coalesce(tasks).mapInArrow(partial, "block long, lane long, at long, cell binary")
    some = each.groupBy("block", "lane").applyInArrow(summed, "block long, at long, cell binary").withColumn("lane", F.lit(0).cast("long"))
    out, gram = np.zeros(m.shape), np.zeros((width, width))
    for r in some.groupBy("block").applyInArrow(summed, "block long, at long, cell binary").toLocalIterator():
        cell = np.frombuffer(r["cell"])
        if r["block"] < 0:
            gram = cell.reshape(width, width)
        else:
            out[r["block"] * ROWS : (r["block"] + 1) * ROWS] = cell.reshape(-1, width)
    sent.unpersist()
    return out, gram


def fit_lsa(docs: DataFrame, text: str = "text", config: LsaConfig = LsaConfig()) -> LsaModel:
    """fit_hashed() of documents' texts."""
    return fit_hashed(files.stash(hashed(docs.select(text), text, config)), config)


def fit_hashed(rows: DataFrame, config: LsaConfig = LsaConfig()) -> LsaModel:
    """The model of all rows of hashed(), which are read once a pass: idf of their buckets, and the config.dims leading right singular vectors of the matrix whose rows are their tf-idf weights at length 1 (a token counts once a document).

    Subspace iteration from random directions: each pass multiplies with the matrix and its transpose, and the result is made orthonormal. The last pass gives singular values and vectors by the small matrix of products. With fewer directions than dims, the rest are zero. Signs are such that each vector's largest component is positive.
    """
    c = config
    n = rows.count()
    idf = np.zeros(c.buckets)
    for r in rows.select(F.explode("_ids").alias("id")).groupBy("id").agg(F.count("*").alias("df")).toLocalIterator():
        idf[r["id"]] = np.log((1 + n) / (1 + r["df"])) + 1
    m = np.random.default_rng(c.seed).normal(size=(c.buckets, c.dims + c.oversample))
    m[idf == 0] = 0  # columns that no document has
    for _ in range(c.power):
        m, _ = np.linalg.qr(_product(rows, idf, m)[0])
    values, small = np.linalg.eigh(_product(rows, idf, m)[1])
    order = np.argsort(-values)[: c.dims]
    values = np.sqrt(np.maximum(values[order], 0))
    vectors = m @ small[:, order]
    vectors[:, values < 1e-9] = 0
    vectors *= np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(0)[None, :], 0) < 0, -1, 1)
    return LsaModel(idf, vectors, values, c)


def embed_lsa(rows: DataFrame, model: LsaModel, text: str = "text", out: str = "embedding") -> DataFrame:
    """rows with out (array<float> of length 1; zeros where no token is known), a column of that name replaced. The model travels to the tasks; its size is that of its configuration."""
    return embed_hashed(hashed(rows.drop(out).withColumn("_text", F.col(text)), "_text", model.config), model, out)


def embed_hashed(coded: DataFrame, model: LsaModel, out: str = "embedding") -> DataFrame:
    """As embed_lsa() of rows that hashed() has coded already."""
    kept = coded.drop("_ids")
    sent, names = coded.sparkSession.sparkContext.broadcast((model.idf, model.vectors)), kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, vectors = sent.value
        for b in batches:
            found = [part @ vectors[own] for own, part in (x.dense() for x in _slices([b], idf))]
            v = np.concatenate(found) if found else np.zeros((0, vectors.shape[1]))
            n = np.sqrt((v * v).sum(1, keepdims=True))
            v = np.divide(v, n, out=v.copy(), where=n > 1e-12)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.astype(np.float32).reshape(-1)))
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.names.index(x)) for x in names], lists], names=[*names, out])

    return coded.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))]))


def save_lsa(spark: SparkSession, model: LsaModel, path: str) -> None:
    """Writes the model under path; only buckets that documents had are kept."""
    rows = [(int(i), float(model.idf[i]), [float(x) for x in model.vectors[i]]) for i in np.nonzero(model.idf)[0]]
    spark.createDataFrame(rows, "bucket int, idf double, vector array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/buckets")
    c = model.config
    about = [(c.buckets, c.dims, c.tokens.n, c.tokens.hybrid, [float(x) for x in model.values])]
    spark.createDataFrame(about, "buckets int, dims int, n int, hybrid boolean, values array<double>").coalesce(1).write.mode("overwrite").json(f"{path}/about")


def load_lsa(spark: SparkSession, path: str) -> LsaModel:
    """The model as written; the driver reads as many rows as it has buckets at most."""
    a = spark.read.json(f"{path}/about").first()
    c = LsaConfig(buckets=a["buckets"], dims=a["dims"], tokens=Bm25Config(n=a["n"], hybrid=a["hybrid"]))
    idf, vectors = np.zeros(c.buckets), np.zeros((c.buckets, c.dims))
    for r in spark.read.parquet(f"{path}/buckets").toLocalIterator():
        idf[r["bucket"]], vectors[r["bucket"]] = r["idf"], r["vector"]
    return LsaModel(idf, vectors, np.array(a["values"]), c)
