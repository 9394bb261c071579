"""Prompts: numbered passages as context, chat markup, cited titles, and a generator to plug in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What stands for a missing context, and before the passages.
NO_CONTEXT = "No context."
LEAD = "Here is the Sanskrit passage:"


def passage(number: Column, title: Column, parent_text: Column, text: Column, most: int = 1200) -> Column:
    body = F.coalesce(F.when(parent_text != "", parent_text), text, F.lit(""))
    cut = F.when(F.length(body) > most, F.concat(F.substring(body, 1, most), F.lit("..."))).otherwise(body)
    return F.concat(F.lit("[Passage "), number.cast("string"), F.lit(" - "), F.coalesce(title, F.lit("")), F.lit("]\n"), cut)


def contexts(hits: DataFrame, query_key: str = "query_id", rank: str = "rank", title: str = "title", parent_text: str = "parent_text", text: str = "text", most: int = 1200) -> DataFrame:
    """query_key, context: the query's passages by rank, a blank line between them; hits of a query are a few."""
    p = hits.select(query_key, F.struct(F.col(rank), passage(F.col(rank), F.col(title), F.col(parent_text), F.col(text), most).alias("p")).alias("x"))
    return p.groupBy(query_key).agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["p"]), "\n\n").alias("context"))


def prompt(query: Column, context: Column, system: str, instruction: str, prefix: str, lead: str = LEAD) -> Column:
    """Chat markup with the context (NO_CONTEXT if null) and the question."""
    return F.concat(
        F.lit(f"<|im_start|>system\n{system.strip()}\n<|im_end|>\n\n<|im_start|>user\n{lead}\n\n"),
        F.coalesce(context, F.lit(NO_CONTEXT)),
        F.lit("\n\nQuestion: "),
        query,
        F.lit(f"\n\n{instruction}\n<|im_end|>\n\n<|im_start|>assistant\n{prefix}"),
    )


def citations(hits: DataFrame, query_key: str = "query_id", rank: str = "rank", title: str = "title") -> DataFrame:
    """query_key, position (from 1), title: distinct titles in the order in which they first appear."""
    from pyspark.sql import Window

    first = hits.groupBy(query_key, title).agg(F.min(rank).alias("_first"))
    return first.withColumn("position", F.row_number().over(Window.partitionBy(query_key).orderBy("_first", title))).drop("_first")


def snippet(text: Column, most: int = 150) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def generate(prompts: DataFrame, make: Callable[[], Callable[[str], str]], prompt_column: str = "prompt", answer: str = "answer") -> DataFrame:
    """prompts with an answer. make() runs once a task and returns the model's call; an error gives a null answer and its text in error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()
        for b in batches:
            answers, errors = [], []
            for p in b[prompt_column]:
                try:
                    answers.append(call(p))
                    errors.append(None)
                except Exception as e:  # the row says what failed
                    answers.append(None)
                    errors.append(str(e))
            yield b.assign(**{answer: answers, "error": errors})

    from pyspark.sql import types as T

    return prompts.mapInPandas(run, T.StructType([*prompts.schema.fields, T.StructField(answer, T.StringType()), T.StructField("error", T.StringType())]))


def quick_answer(hits: DataFrame, queries: DataFrame, make: Callable[[], Callable[[str], str]], system: str = "", instruction: str = "", prefix: str = "", most: int = 2) -> DataFrame:
    """query_id, prompt, answer, error of queries (query_id, text) from their first hits alone; a query without hits is asked without context."""
    context = contexts(hits.where(F.col("rank") <= most))
    asked = queries.join(context, "query_id", "left").select("query_id", prompt(F.col("text"), F.col("context"), system, instruction, prefix).alias("prompt"))
    return generate(asked, make)


def first_passage() -> Callable[[str], str]:
    """A generator that needs no model: it answers with the first passage of the prompt, empty without one."""

    def call(text: str) -> str:
        _, _, rest = text.partition("[Passage 1 - ")
        return rest.partition("]\n")[2].partition("\n\n")[0]

    return call
