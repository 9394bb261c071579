"""Sources and sinks: text files, extracted pages and whole folders as documents; stories, chunks and reports as JSON or Parquet."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipika.functions.script import strip
from lipika.sources import pdf

#: Columns of documents read from files.
DOCUMENT = ("text", "source", "filename", "source_path", "file_size", "char_count", "valid")


def spread(df: DataFrame, per_core: int = 4) -> DataFrame:
    """df over all cores, several tasks each, where its scan has fewer partitions than these (small files, or of few row groups); larger inputs stay as they are read."""
    n = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Only a local master may leave it unset, and gets a new temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lipika-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, so that later steps see the same rows even after an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lipika-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _named(raw: DataFrame) -> list:
    name = F.substring_index("path", "/", -1)
    return [name.alias("source"), name.alias("filename"), F.col("path").alias("source_path"), F.col("length").cast("bigint").alias("file_size")]


def text_documents(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """text, source, filename, source_path, file_size, char_count, valid: a row a file; line breaks are \\n, and bytes that are no UTF-8 are replaced."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return _texts(raw)


def _texts(raw: DataFrame) -> DataFrame:
    content = F.col("content").cast("string")
    text = F.regexp_replace(F.make_valid_utf8(content), r"\r\n?", "\n")
    return raw.select(text.alias("text"), *_named(raw), F.length(text).cast("bigint").alias("char_count"), F.is_valid_utf8(content).alias("valid"))


def page_rows(spark: SparkSession, path: str, extract: Callable[[], Callable[[bytes], list[str]]], pattern: str = "*.pdf") -> DataFrame:
    """source, filename, source_path, file_size, page_no, text, error: the pages of each file as an extractor gives them.

    extract() runs once a task and returns a call from a file's bytes to its pages' texts. A file that fails gives one row with a null text and the error.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = extract()
        for b in batches:
            rows = []
            for source, size, content in zip(b["path"], b["length"], b["content"], strict=True):
                name = source.rpartition("/")[2]
                try:
                    rows += [(name, name, source, size, i, t, None) for i, t in enumerate(call(bytes(content)), 1)]
                except Exception as e:  # the row says what failed; the other files go on
                    rows.append((name, name, source, size, 0, None, str(e)))
            yield pd.DataFrame(rows, columns=["source", "filename", "source_path", "file_size", "page_no", "text", "error"])

    return raw.select("path", "length", "content").mapInPandas(run, "source string, filename string, source_path string, file_size long, page_no int, text string, error string")


def directory_documents(spark: SparkSession, path: str, extract: Callable[[], Callable[[bytes], list[str]]] | None = pdf.extractor) -> DataFrame:
    """DOCUMENT columns, status (ok, invalid or failed) and error of every file of a folder (not its subfolders), by its extension: .txt as text, .pdf by the extractor (None: failed); other files are no documents. A file that fails doesn't stop the others."""
    texts = text_documents(spark, path).withColumn("status", F.when(F.col("valid"), "ok").otherwise("invalid")).withColumn("error", F.lit(None).cast("string"))
    if extract is None:
        raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
        none = [F.lit(None).cast("string").alias("text"), *_named(raw), F.lit(None).cast("bigint").alias("char_count"), F.lit(False).alias("valid"), F.lit("failed").alias("status"), F.lit("no extractor").alias("error")]
        return texts.unionByName(raw.select(*none))
    pages = page_rows(spark, path, extract)
    keys = ["source", "filename", "source_path", "file_size"]
    whole = documents_of_pages(pages.where("error is null"), "source_path", "page_no").select("source_path", "text")
    files = pages.groupBy(*keys).agg(F.max("error").alias("error"))
    pdfs = files.join(whole, "source_path", "left").select(F.when(F.col("error").isNull(), F.coalesce("text", F.lit(""))).alias("text"), *keys, "error")
    pdfs = pdfs.withColumns({"char_count": F.length("text").cast("bigint"), "valid": F.col("error").isNull(), "status": F.when(F.col("error").isNull(), "ok").otherwise("failed")})
    return texts.unionByName(pdfs)


def documents_of_pages(pages: DataFrame, key: str = "source", number: str = "page_no", text: str = "text") -> DataFrame:
    """key, text, page_count of page tables (a PDF extractor's output, say): lines without trailing white space, runs of blank lines as one, blank pages left out, a blank line between pages."""
    lines = F.transform(F.split(F.col(text), "\n", -1), lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))
    clean = strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))
    kept = pages.select(key, number, clean.alias("_t"))
    pages_of = F.sort_array(F.collect_list(F.when(F.col("_t") != "", F.struct(number, "_t"))))
    return kept.groupBy(key).agg(F.array_join(F.transform(pages_of, lambda x: x["_t"]), "\n\n").alias("text"), F.count("*").alias("page_count"))


def totals(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).cast("bigint").alias("total_chars"), F.count("*").alias("total_files"))


def story_report(stories: DataFrame, key: str = "doc_id", text: str = "story_text", title: str = "title") -> DataFrame:
    """A row a story (its title, characters, words, lines) and one row with a null key and title for all of them, with the number of stories."""
    each = stories.select(F.col(key), F.col(title), F.length(text).cast("bigint").alias("chars"), F.regexp_count(text, F.lit(r"\S+")).cast("bigint").alias("words"), (F.regexp_count(text, F.lit("\n")) + 1).cast("bigint").alias("lines"), F.lit(1).cast("bigint").alias("stories"))
    each = stash(each)  # a few numbers a story, for the sum over all without cutting the texts again
    whole = each.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("chars", "words", "lines", "stories")])
    kind = stories.schema[key].dataType
    return each.unionByName(whole.select(F.lit(None).cast(kind).alias(key), F.lit(None).cast("string").alias(title), "chars", "words", "lines", "stories"))


def save(df: DataFrame, path: str, form: str = "parquet") -> None:
    df.write.mode("overwrite").format(form).save(path)


def load(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """JSON may be lines or whole arrays."""
    return spark.read.json(path, multiLine=True) if form == "json_array" else spark.read.format(form).load(path)


def delete(spark: SparkSession, path: str) -> bool:
    """Deletes a folder in whatever store it is; false if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
