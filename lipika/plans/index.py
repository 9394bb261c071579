"""From documents to an index in a folder, and hybrid search for a table of queries over it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipika.functions.normalize import preprocess
from lipika.operators import blockmax, chunk, encode, fusion, lexical, prompt, segment, store, vector
from lipika.plans.config import SearchConfig
from lipika.sources.files import load, save, stash

__all__ = ["SearchConfig", "answer", "build", "build_bm25", "build_vectors", "check", "search"]


def build(docs: DataFrame, path: str, config: SearchConfig = SearchConfig(), key: str = "doc_id", make: Callable[[], encode.Encoder] | None = None) -> None:
    """Writes stories, parents, children (numbered, with their search form), the BM25 index and, with an encoder, the vector index under path."""
    c = config
    found = segment.stories(docs, c.titles, key)
    found = found.withColumn("story_id", F.concat(F.col(key).cast("string"), F.lit("_s"), F.col("story").cast("string")))
    save(found, f"{path}/stories")
    spark = docs.sparkSession
    parents = chunk.parents(load(spark, f"{path}/stories"), keep=["title"], c=c.chunks)
    save(parents.withColumn("preprocessed_text", preprocess(F.col("text"))), f"{path}/parents")
    children = chunk.children(load(spark, f"{path}/parents"), keep=["story_id", "title"], c=c.chunks)
    children = children.withColumn("preprocessed_text", preprocess(F.col("text")))
    save(store.numbered(children, ["story_id", "parent_id", "child_index"], "ix"), f"{path}/children")
    build_bm25(spark, path, c)
    if make is not None:
        build_vectors(spark, path, make, c)


def build_bm25(spark: SparkSession, path: str, config: SearchConfig = SearchConfig()) -> None:
    """(Re)writes the BM25 index of the children under path."""
    children = load(spark, f"{path}/children")
    blockmax.save_blocks(blockmax.block_index(children, "ix", "preprocessed_text", config.bm25), f"{path}/bm25")


def build_vectors(spark: SparkSession, path: str, make: Callable[[], encode.Encoder], config: SearchConfig = SearchConfig()) -> None:
    """(Re)writes the vector index of the children under path; each text is encoded once."""
    c = config
    vectors = encode.embed(load(spark, f"{path}/children").select("ix", "preprocessed_text"), make, "preprocessed_text", config=c.encoder).select("ix", "embedding")
    vector.save_ivf(stash(vectors), f"{path}/vectors", c.vector_k, c.n_cells, c.nprobe, key="ix")


def search(spark: SparkSession, path: str, queries: DataFrame, config: SearchConfig = SearchConfig(), vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, make: Callable[[], encode.Encoder] | None = None) -> DataFrame:
    """query_id, rank, score, chunk_id, parent_id, title, child_text, parent_text for queries (query_id, text).

    The lexical leg reads the stored BM25 index. The vector leg is exact over vectors (ix, embedding) and query_vectors (query_id, embedding), or, with an encoder, asks the stored vector index; with neither, the lexical leg alone counts.
    """
    c = config
    children, parents = load(spark, f"{path}/children"), load(spark, f"{path}/parents")
    asked = queries.select("query_id", preprocess(F.col("text")).alias("text"))
    tokens = asked.select("query_id", F.explode_outer(lexical.tokens(F.col("text"), c.bm25)).alias("token")).where("token is not null")
    lex = blockmax.search_blocks(blockmax.load_blocks(spark, f"{path}/bm25"), tokens, "query_id", c.bm25).select("query_id", "ix", "score")
    if vectors is not None and query_vectors is not None:
        near = vector.l2_topk(vectors, query_vectors, c.vector_k, key="ix").select("query_id", "ix", "dist")
    elif make is not None:
        near = vector.search_ivf(vector.load_ivf(spark, f"{path}/vectors"), encode.embed_queries(asked, make, config=c.encoder), c.vector_k).select("query_id", "ix", "dist")
    else:
        near = spark.createDataFrame([], "query_id long, ix long, dist double")
    fused = fusion.weighted_fusion(lex, near, w_lexical=c.w_lexical, w_vector=c.w_vector)
    best = fusion.best_of_parents(fused, children, c.top_k, c.min_score)
    return (
        best.join(children.select("ix", "chunk_id", "title", "child_index", "total_children", F.col("text").alias("child_text")), "ix")
        .join(parents.select("parent_id", F.col("text").alias("parent_text")), "parent_id")
        .select("query_id", "rank", "score", "chunk_id", "parent_id", "title", "child_index", "total_children", "child_text", "parent_text")
    )


def answer(queries: DataFrame, hits: DataFrame, make: Callable[[], Callable[[str], str]], config: SearchConfig = SearchConfig()) -> DataFrame:
    """query_id, prompt, answer, error of queries (query_id, text) by a generator, from the passages of search()'s hits."""
    passages = hits.select("query_id", "rank", "title", "parent_text", F.col("child_text").alias("text"))
    context = prompt.contexts(passages)
    asked = queries.join(context, "query_id", "left").select("query_id", prompt.prompt(F.col("text"), F.col("context"), config.system, config.instruction, config.prefix).alias("prompt"))
    return prompt.generate(asked, make)


def check(spark: SparkSession, path: str) -> DataFrame:
    """name, ok, found, expected: whether the tables under path agree: each child has a parent, numbers are 0 .. n - 1, the BM25 index has a document each child, the vector index (if there) a vector each child, and search forms without Devanagari."""
    children, parents = load(spark, f"{path}/children"), load(spark, f"{path}/parents")
    n = children.agg(F.count("*").alias("expected"))
    one = lambda name, found, expected: found.crossJoin(F.broadcast(expected)).select(F.lit(name).alias("name"), (F.col("found") == F.col("expected")).alias("ok"), F.col("found").cast("bigint").alias("found"), F.col("expected").cast("bigint").alias("expected"))
    count = lambda df: df.agg(F.count("*").alias("found"))
    numbers = children.agg(F.countDistinct("ix").alias("n"), F.min("ix").alias("a"), F.max("ix").alias("z")).select(F.when((F.col("n") == 0) | (F.col("a") == 0) & (F.col("z") == F.col("n") - 1), F.col("n")).otherwise(-1).alias("found"))
    out = one("children with a parent", count(store.with_parent(children, parents, "parent_id")), n)
    out = out.unionByName(one("numbers", numbers, n))
    out = out.unionByName(one("bm25 documents", load(spark, f"{path}/bm25/facts").select(F.col("n_docs").alias("found")), n))
    out = out.unionByName(one("search forms", count(children.where(~F.coalesce(F.col("preprocessed_text").rlike(r"[\x{0900}-\x{097F}]"), F.lit(False)))), n))
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/vectors/cells")
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        out = out.unionByName(one("vectors", count(load(spark, f"{path}/vectors/cells").select("ix").distinct()), n))
    return out
