"""Command line: python -m lipika.plans.cli --mode index --data FOLDER --index FOLDER, --mode query --query TEXT, --mode check, or --mode reset."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipika.operators import store
from lipika.operators.prompt import snippet
from lipika.plans import index
from lipika.plans.config import SearchConfig, load_config
from lipika.sources.files import directory_documents


def plugin(name: str | None):
    """What module:attribute names."""
    if not name:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser()
    p.add_argument("--mode", choices=["index", "query", "check", "reset"], required=True)
    p.add_argument("--query", action="append", default=[])
    p.add_argument("--data")
    p.add_argument("--index", required=True)
    p.add_argument("--config", help="a JSON or YAML file")
    p.add_argument("--top-k", type=int)
    p.add_argument("--encoder", help="module:function that gives an encoder")
    p.add_argument("--extractor", help="module:function that gives a PDF extractor")
    p.add_argument("--generator", help="module:function that gives a generator; with it, queries are answered")
    p.add_argument("--interactive", action="store_true")
    a = p.parse_args(argv)
    config = load_config(a.config) if a.config else SearchConfig()
    if a.top_k:
        from dataclasses import replace

        config = replace(config, top_k=a.top_k)
    spark = SparkSession.builder.appName("lipika").getOrCreate()
    if a.mode == "reset":
        print("deleted:", ", ".join(store.clear(spark, a.index)) or "nothing")
    elif a.mode == "index":
        docs = directory_documents(spark, a.data, plugin(a.extractor))
        docs.where("status <> 'ok'").select("filename", "status", "error").show(truncate=False)
        index.build(docs.where("status <> 'failed'").withColumn("doc_id", F.col("filename")), a.index, config, make=plugin(a.encoder))
    elif a.mode == "check":
        index.check(spark, a.index).show(truncate=False)
    else:
        if a.query:
            ask(spark, a.index, a.query, config, plugin(a.encoder), plugin(a.generator))
        while a.interactive and (line := input("? ").strip()) not in ("", "exit", "quit"):
            ask(spark, a.index, [line], config, plugin(a.encoder), plugin(a.generator))


def ask(spark: SparkSession, path: str, texts: list[str], config: SearchConfig, encoder=None, generator=None) -> DataFrame:
    """Shows the hits of all texts, and their answers if there is a generator."""
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    hits = index.search(spark, path, queries, config, make=encoder)
    hits.select("query_id", "rank", F.round("score", 4).alias("score"), "title", snippet(F.col("child_text")).alias("text")).orderBy("query_id", "rank").show(truncate=False)
    if generator is not None:
        index.answer(queries, hits, generator, config).select("query_id", "answer", "error").orderBy("query_id").show(truncate=False)
    return hits


if __name__ == "__main__":
    main()
