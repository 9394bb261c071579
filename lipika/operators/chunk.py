"""Hierarchical chunks: sentences packed greedily into parents, and each parent's sentences into children."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lipika.functions.script import fold, let, strip


@dataclass(frozen=True)
class ChunkConfig:
    delimiters: str = "।॥"
    ending: str = " ।"
    parent_max: int = 800
    child_max: int = 200
    chars_per_token: int = 4


def tokens_of(text: Column, c: ChunkConfig = ChunkConfig()) -> Column:
    return F.floor(F.length(text) / c.chars_per_token).cast("bigint")


def sentences(text: Column, c: ChunkConfig = ChunkConfig()) -> Column:
    """Stripped non-empty parts between delimiters, each with the ending."""
    parts = F.transform(F.split(text, f"[{re.escape(c.delimiters)}]", -1), strip)
    return F.transform(F.filter(parts, lambda s: s != ""), lambda s: F.concat(s, F.lit(c.ending)))


def pack(parts: Column, most: int, c: ChunkConfig = ChunkConfig()) -> Column:
    """Consecutive sentences in groups of at most `most` tokens; a sentence with more is a group of its own. Groups are runs of places, cut out at the end, so the work is linear in the sentences."""
    state = lambda at, start, tokens: F.struct(at.alias("at"), start.alias("start"), tokens.alias("tokens"))
    run = lambda start, n: F.struct(start.alias("start"), n.alias("n"))

    def step(a: Column, s: Column) -> tuple[Column, Column]:
        more = tokens_of(s, c)
        full = (a["tokens"] + more > most) & (a["at"] > a["start"])
        next_ = F.when(full, state(a["at"] + 1, a["at"], more)).otherwise(state(a["at"] + 1, a["start"], a["tokens"] + more))
        return next_, F.when(full, run(a["start"], a["at"] - a["start"]))

    def groups(all_: Column) -> Column:
        found = fold(all_, state(F.lit(0), F.lit(0), F.lit(0).cast("bigint")), step, "struct<start:int,n:int>")
        last = lambda f: F.when(f["state"]["at"] > f["state"]["start"], F.array(run(f["state"]["start"], f["state"]["at"] - f["state"]["start"]))).otherwise(F.array().cast("array<struct<start:int,n:int>>"))
        return F.transform(let(found, lambda f: F.concat(f["out"], last(f))), lambda r: F.slice(all_, r["start"] + 1, r["n"]))

    return let(parts, groups)


def placed(groups: Column, start: Column, c: ChunkConfig) -> Column:
    """Array of text, token_count, start_char, end_char of each group; offsets begin at start and leave out the spaces between groups. A fold over the row's own groups, so no window is needed."""

    def step(a: Column, text: Column) -> tuple[Column, Column]:
        end = a["at"] + F.length(text)
        own = F.struct(text.alias("text"), tokens_of(text, c).alias("token_count"), a["at"].alias("start_char"), end.alias("end_char"))
        return F.struct(end.alias("at")), own

    kind = "struct<text:string,token_count:bigint,start_char:bigint,end_char:bigint>"
    return fold(F.transform(groups, lambda g: F.array_join(g, " ")), F.struct(start.cast("bigint").alias("at")), step, kind)["out"]


def _rows(df: DataFrame, chunks: Column, index: str, keep: list[str]) -> DataFrame:
    """A row a chunk, numbered from 1."""
    rows = df.select(*keep, F.posexplode_outer(chunks).alias("_p", "_c")).where("_c is not null")
    return rows.select(*keep, (F.col("_p").cast("bigint") + 1).alias(index), "_c.text", "_c.start_char", "_c.end_char", "_c.token_count")


def parents(stories: DataFrame, key: str = "story_id", text: str = "story_text", keep: list[str] | None = None, c: ChunkConfig = ChunkConfig()) -> DataFrame:
    """key, kept columns, parent_index, parent_id, text, token_count, start_char, end_char; stories without sentences have none."""
    rows = _rows(stories, placed(pack(sentences(F.col(text), c), c.parent_max, c), F.lit(0), c), "parent_index", [key, *(keep or [])])
    return rows.withColumn("parent_id", F.concat(F.col(key).cast("string"), F.lit("_p"), F.col("parent_index").cast("string")))


def children(parent_rows: DataFrame, keep: list[str] | None = None, c: ChunkConfig = ChunkConfig()) -> DataFrame:
    """parent_id, kept columns, child_index, total_children, chunk_id, text, token_count, start_char, end_char."""
    of_parent = placed(pack(sentences(F.col("text"), c), c.child_max, c), F.col("start_char"), c)
    numbered = let(of_parent, lambda x: F.transform(x, lambda y: F.struct(F.size(x).cast("bigint").alias("total_children"), y["text"].alias("text"), y["start_char"].alias("start_char"), y["end_char"].alias("end_char"), y["token_count"].alias("token_count"))))
    own = ["parent_id", *(keep or [])]
    rows = parent_rows.select(*own, F.posexplode_outer(numbered).alias("_p", "_c")).where("_c is not null")
    rows = rows.select("parent_id", "_c.total_children", *(keep or []), (F.col("_p").cast("bigint") + 1).alias("child_index"), "_c.text", "_c.start_char", "_c.end_char", "_c.token_count")
    return rows.withColumn("chunk_id", F.concat("parent_id", F.lit("_c"), F.col("child_index").cast("string")))
