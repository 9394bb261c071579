"""Retrieval evaluated against the corpus itself: every benchmark passage is a question, and the documents that quote it whole are the right answers.

Reads items (item_id, text) and documents (doc_id, text), searches by BM25, and writes a row an item, in folders by category (how many words the item has). A run replaces the whole output, so it can be repeated at any time and gives the same rows; what each part cost is logged.

    python -m jobs.evaluate_retrieval --items PATH --documents PATH --out PATH --config jobs/evaluate_retrieval.json
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.command import log, main, rows_at
from lipika.operators import evaluate, lexical
from lipika.sources import files

RESULT = "item_id long, n_words long, n_truth long, n_hits long, found boolean, recall_at_k double, recall double, reciprocal_rank double, top_score double, top string"


@dataclass(frozen=True)
class Config:
    """k: hits an item; first: of these that found and recall_at_k look at; bounds: words from which the next category begins; digits: of scores, on which hits are ranked; width: words of the runs that lead to quoting documents."""

    k: int = 50
    first: int = 5
    bounds: tuple[int, ...] = (25, 45)
    digits: int = 6
    width: int = 3
    k1: float = 1.5
    b: float = 0.75


def category(n_words, bounds: tuple[int, ...]):
    """words_a_b for a <= n_words < b; the last one has no b."""
    out = None
    for low, high in zip((0, *bounds), (*bounds, None), strict=True):
        name = F.lit(f"words_{low}_{high}" if high is not None else f"words_{low}")
        test = (n_words >= low) & (n_words < high) if high is not None else n_words >= low
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def run(spark: SparkSession, items: str, documents: str, out: str, config: Config = Config()) -> dict:
    """Searches the documents for every item and writes how well the documents that quote it were found.

    Items without item_id are left out; an item_id that repeats is one item, its greatest text. An item with too few words to look for (width + 2) or quoted nowhere has no right answers: its measures are null.
    """
    c = config
    parts = evaluate.Components()
    asked = spark.read.parquet(items).where("item_id is not null").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.max("text").alias("text"))
    asked = parts.measured("items", asked)
    docs = files.spread(spark.read.parquet(documents).where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    truth = parts.measured("quotes", evaluate.quotes(asked, docs, width=c.width))
    hits = parts.measured("hits", lexical.bm25(asked, docs, "item_id", "doc_id", c=lexical.Bm25Config(k=c.k, k1=c.k1, b=c.b), digits=c.digits))
    words = asked.select("item_id", F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("long").alias("n_words"))
    rows = evaluate.ranked_metrics(words, hits, truth, c.first, query_key="item_id").withColumn("category", category(F.col("n_words"), c.bounds))
    put = Observation()
    rows = rows.select(*[x.split()[0] for x in RESULT.split(", ")], "category").observe(put, F.count("*").alias("rows"), F.count("found").alias("judged"), F.count(F.when(F.col("found"), 1)).alias("found"))
    rows.hint("rebalance", "category").sortWithinPartitions("category", "item_id").write.mode("overwrite").partitionBy("category").parquet(out)
    for name, n, ms in parts.rows:
        log.info("%s: %d rows in %.0f ms", name, n, ms)
    done = {x: put.get[x] for x in ("rows", "judged", "found")}
    log.info("wrote %d items, %d of them judged, %d found among the first %d, under %s", done["rows"], done["judged"], done["found"], c.first, out)
    return done


def results(spark: SparkSession, out: str) -> DataFrame:
    """RESULT and category, as written."""
    return rows_at(spark, out, f"{RESULT}, category string")


if __name__ == "__main__":
    main("evaluate_retrieval", ["items", "documents"], Config, run)
