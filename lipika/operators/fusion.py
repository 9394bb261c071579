"""Fusion of lexical and vector results, and one hit a parent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def weighted_fusion(lexical: DataFrame, vector: DataFrame, query_key: str = "query_id", key: str = "ix", w_lexical: float = 0.7, w_vector: float = 0.3, floor: float = 0.001, digits: int | None = None) -> DataFrame:
    """query_key, key, score. lexical has score (higher is better), vector has dist (lower is better); each is scaled by its greatest per query, and a missing one counts 0."""
    w = Window.partitionBy(query_key)
    top = lambda c: F.greatest(F.max(c).over(w), F.lit(floor))
    left = lexical.select(query_key, key, (F.col("score") / top("score")).alias("a"))
    right = vector.select(query_key, key, (1 - F.col("dist") / top("dist")).alias("b"))
    score = w_lexical * F.coalesce("a", F.lit(0.0)) + w_vector * F.coalesce("b", F.lit(0.0))
    return left.join(right, [query_key, key], "full").select(query_key, key, (F.round(score, digits) if digits else score).alias("score"))


def best_of_parents(hits: DataFrame, children: DataFrame, k: int = 2, min_score: float = 0.1, query_key: str = "query_id", key: str = "ix", parent: str = "parent_id") -> DataFrame:
    """The k best parents of each query by their best child, hits under min_score left out; ties to the smaller child key. Children must have a row in children."""
    ok = hits.where(F.col("score") >= min_score).join(children.select(key, parent), key)
    one = Window.partitionBy(query_key, parent).orderBy(F.desc("score"), key)
    best = ok.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    rank = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return best.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def reciprocal_rank_fusion(ranked: list[DataFrame], query_key: str = "query_id", key: str = "ix", k: int = 60) -> DataFrame:
    """An extension: sum of 1 / (k + rank) over any number of ranked lists."""
    parts = [r.select(query_key, key, (1 / (F.lit(k) + F.col("rank"))).alias("part")) for r in ranked]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(query_key, key).agg(F.sum("part").alias("score"))
