"""Evaluation of retrieval: recall at k, summaries, breakdowns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lipika.operators.cuts import SMALL, Found, Runs, blocks
from lipika.sources import files


def recall_at_k(retrieved: Column, truth: Column, k: int = 5) -> Column:
    """Share of the distinct true items among the first k retrieved; 1 without truth."""
    return F.when(F.coalesce(F.size(truth), F.lit(0)) <= 0, 1.0).otherwise(F.size(F.array_intersect(F.slice(retrieved, 1, k), truth)) / F.size(F.array_distinct(truth)))


def found(retrieved: Column, truth: Column, k: int = 5) -> Column:
    return F.coalesce(F.arrays_overlap(F.slice(retrieved, 1, k), truth), F.lit(False))


def summary(values: DataFrame, component: str, value: str, digits: int = 6) -> DataFrame:
    """component, mean, min, max, n: nulls left out."""
    return values.groupBy(component).agg(F.round(F.avg(value), digits).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"))


def breakdown(results: DataFrame, category: str, values: list[str], digits: int = 6) -> DataFrame:
    """Mean of each value per category, null if all are null."""
    return results.groupBy(category).agg(F.count("*").alias("n"), *[F.round(F.avg(v), digits).alias(f"avg_{v}") for v in values])


def failures(results: DataFrame, recall: str = "recall") -> DataFrame:
    return results.where(F.col(recall).isNotNull() & (F.col(recall) < 1))


def cross_script_consistency(tops: DataFrame, group: str, top: str) -> DataFrame:
    """group, consistent: all spellings of a question have the same first hit."""
    return tops.groupBy(group).agg((F.countDistinct(top) == 1).alias("consistent"))


def run_evaluation(queries: DataFrame, hits: DataFrame, k: int = 5, query_key: str = "query_id", item: str = "title", rank: str = "rank") -> DataFrame:
    """A row a query of queries (query_key, category, truth: array or null; more columns stay): retrieved (distinct items by rank), recall and found at k. Without truth both are null; a query without hits has retrieved nothing. All queries are judged in one batch."""
    first = hits.groupBy(query_key, item).agg(F.min(rank).alias("_rank"))
    listed = first.groupBy(query_key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_rank", item))), lambda x: x[item]).alias("retrieved"))
    both = queries.join(listed, query_key, "left").withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<string>")))
    judged = F.coalesce(F.size("truth"), F.lit(0)) > 0
    return both.withColumn("recall", F.when(judged, recall_at_k(F.col("retrieved"), F.col("truth"), k))).withColumn("found", F.when(judged, found(F.col("retrieved"), F.col("truth"), k)))


def evaluation_report(results: DataFrame, category: str = "category", digits: int = 6) -> DataFrame:
    """kind (overall or category), name, n, judged, mean, min and max recall, found, of run_evaluation()'s rows."""
    facts = [F.count("*").alias("n"), F.count("recall").alias("judged"), F.round(F.avg("recall"), digits).alias("mean_recall"), F.min("recall").alias("min_recall"), F.max("recall").alias("max_recall"), F.coalesce(F.sum(F.col("found").cast("bigint")), F.lit(0)).alias("found")]
    whole = results.agg(*facts).select(F.lit("overall").alias("kind"), F.lit(None).cast("string").alias("name"), "*")
    each = results.groupBy(F.col(category).alias("name")).agg(*facts).select(F.lit("category").alias("kind"), "*")
    return whole.unionByName(each)


def timed(search: Callable[[DataFrame], DataFrame], queries: DataFrame) -> tuple[DataFrame, float]:
    """search(queries), written once so that it is not run again, and the milliseconds a query that this took."""
    import time

    began = time.perf_counter()
    hits = files.stash(search(queries))
    return hits, 1000 * (time.perf_counter() - began) / max(1, queries.count())


def _runs(texts: DataFrame, key: str, text: str, width: int, inner: bool = False) -> DataFrame:
    """key, _h, _size: hashes of width consecutive words, and their bytes, not all distinct. inner: without the first and the last word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Runs(width)
        for b in batches:
            for first, block in blocks(b.column(1), SMALL):
                at, h, size = cut.hashes(block, inner)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(first + at)), pa.array(h), pa.array(size)], names=[key, "_h", "_size"])

    return texts.select(key, F.col(text).cast("string")).mapInArrow(run, T.StructType([T.StructField(key, texts.schema[key].dataType), T.StructField("_h", T.LongType()), T.StructField("_size", T.LongType())]))


def quotable(text: Column, width: int = 3) -> Column:
    """Whether quotes() can look for a text: it has width words besides its first and its last."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))) >= width + 2, F.lit(False))


def quotes(items: DataFrame, docs: DataFrame, item_key: str = "item_id", key: str = "doc_id", text: str = "text", width: int = 3, most_broadcast: int = 500_000) -> DataFrame:
    """item_key, key: which documents contain which item's whole text, of quotable() items.

    A document that contains a text contains its inner words as words, so a run of width of these leads to the item's candidates, and they are compared in full. If the items' runs are most_broadcast at most, the run of each item that the fewest items have (of these, the longest) travels with its text, and documents are read once. Else both sides are shuffled by run, and the run that the fewest documents have leads to candidates.
    """
    asked = items.where(quotable(F.col(text), width)).select(F.col(item_key).alias("_item"), F.col(text).alias("_part"))
    own = files.stash(_runs(asked, "_item", "_part", width, True).groupBy("_item", "_h").agg(F.max("_size").alias("_size")))
    if own.count() <= most_broadcast:
        few = own.withColumn("_n", F.count("*").over(Window.partitionBy("_h")))
        led = few.withColumn("_o", F.row_number().over(Window.partitionBy("_item").orderBy("_n", F.desc("_size"), "_h"))).where("_o = 1")
        return _quoting(led.join(asked, "_item").select("_item", "_h", "_part"), docs.select(F.col(key).alias("_doc"), text), width).distinct().select(F.col("_item").alias(item_key), F.col("_doc").alias(key))
    met = files.stash(_runs(docs, key, text, width).select("_h", F.col(key).alias("_doc")).join(own.select("_h").distinct().hint("merge"), "_h").distinct())
    n = met.groupBy("_h").agg(F.count("*").alias("_n"))
    # a run that no document has: the item is in none
    rarest = own.join(n, "_h", "left").withColumn("_o", F.row_number().over(Window.partitionBy("_item").orderBy(F.coalesce("_n", F.lit(0)), "_h"))).where("_o = 1")
    candidates = files.stash(rarest.join(met, "_h").select("_item", "_doc"))
    both = candidates.join(asked, "_item").join(docs.select(F.col(key).alias("_doc"), F.col(text).alias("_whole")), "_doc")
    return both.where(F.contains("_whole", "_part")).select(F.col("_item").alias(item_key), F.col("_doc").alias(key)).distinct()


def _quoting(led: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """_item, _doc of led (_item, _h, _part), which travels, and docs (_doc, text): texts with a run _h that contain _part."""
    sent = led.toArrow().sort_by("_h")
    cast = docs.sparkSession.sparkContext.broadcast((sent.column("_h").to_numpy(), sent.column("_part").cast(pa.binary()).to_pylist(), sent.column("_item").combine_chunks()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        led_by, parts, names = cast.value
        cut, few = Runs(width), Found(led_by)
        first_of, end_of = np.searchsorted(led_by, few.few), np.searchsorted(led_by, few.few, "right")
        for b in batches:
            rows, found = [], []
            for first, block in blocks(b.column(1), SMALL):
                at, h, _ = cut.hashes(block)
                here, which = few.at(h)
                whole = block.cast(pa.binary())
                # the same run may be in a text many times
                for i, j in set(zip(at[here].tolist(), which.tolist(), strict=True)):
                    text = whole[i].as_py()
                    own = [x for x in range(first_of[j], end_of[j]) if parts[x] in text]
                    rows += [first + i] * len(own)
                    found += own
            yield pa.RecordBatch.from_arrays([names.take(pa.array(found, pa.int64())), b.column(0).take(pa.array(rows, pa.int64()))], names=["_item", "_doc"])

    return docs.mapInArrow(run, T.StructType([T.StructField("_item", led.schema["_item"].dataType), T.StructField("_doc", docs.schema["_doc"].dataType)]))


def ranked_metrics(queries: DataFrame, hits: DataFrame, truth: DataFrame, k: int = 5, query_key: str = "query_id", key: str = "doc_id", rank: str = "rank", score: str = "score") -> DataFrame:
    """A row a query of queries (query_key; other columns stay): n_truth, n_hits, found (a true one among the first k), recall_at_k, recall (of all hits), reciprocal_rank (0 if no hit is true), top_score, and the keys of the first k hits joined by commas. What needs a true one is null without any."""
    true = truth.select(query_key, key).distinct().withColumn("_true", F.lit(True))
    each = hits.join(true, [query_key, key], "left").groupBy(query_key).agg(
        F.count("*").alias("n_hits"),
        F.count(F.when(F.col("_true") & (F.col(rank) <= k), 1)).alias("_first"),
        F.count("_true").alias("_all"),
        F.min(F.when(F.col("_true"), F.col(rank))).alias("_rank"),
        F.max(score).alias("top_score"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col(rank) <= k, F.struct(rank, key)))), lambda x: x[key].cast("string")), ",").alias("top"),
    )
    n = true.groupBy(query_key).agg(F.count("*").alias("n_truth"))
    both = queries.join(each, query_key, "left").join(n, query_key, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_truth", "n_hits", "_first", "_all")}).withColumn("top", F.coalesce("top", F.lit("")))
    judged = F.col("n_truth") > 0
    out = {"found": F.col("_first") > 0, "recall_at_k": F.col("_first") / F.col("n_truth"), "recall": F.col("_all") / F.col("n_truth"), "reciprocal_rank": F.coalesce(1 / F.col("_rank"), F.lit(0.0))}
    return both.withColumns({c: F.when(judged, x) for c, x in out.items()}).drop("_first", "_all", "_rank")


class Components:
    """What each part of an evaluation cost: rows it gave and milliseconds it took, for a report beside the results."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, float]] = []

    def measured(self, name: str, frame: DataFrame) -> DataFrame:
        """frame, run once and written to the shared folder; its rows are counted by an observation within that same job."""
        import time

        from pyspark.sql import Observation

        seen, began = Observation(), time.perf_counter()
        out = files.stash(frame.observe(seen, F.count("*").alias("rows")))
        self.rows.append((name, int(seen.get["rows"]), 1000 * (time.perf_counter() - began)))
        return out

    def report(self, spark) -> DataFrame:
        """component, rows, milliseconds; a part that was measured again has another row."""
        return spark.createDataFrame(self.rows, "component string, rows long, milliseconds double")
