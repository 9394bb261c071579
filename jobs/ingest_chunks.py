"""Incremental ingest: files of documents that are new since the last run become stories and chunks, and a current chunk table is kept in buckets.

Under the output folder: checkpoint (the stream's: which files were taken), chunks/batch=n/bucket=k (every batch's chunks, never changed), manifest/batch=n (which version of which document a batch holds), current/bucket=k (the chunks of each document's latest version) and published (the last batch that current holds).

A batch that fails is taken again under its number and overwrites its own folders only; a run that ends before current is complete leaves the mark behind, so the next run publishes what is missing. A run without new files changes nothing.

    python -m jobs.ingest_chunks --documents PATH --out PATH --config jobs/ingest_chunks.json
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from jobs.command import log, main, rows_at
from lipika.functions.normalize import preprocess
from lipika.functions.script import detect_script
from lipika.operators import chunk, segment

CHUNKS = "doc_id long, version string, lang string, story_id string, title string, parent_id string, chunk_id string, child_index long, total_children long, start_char long, end_char long, token_count long, script string, text string, search_text string"
NAMES = [x.split()[0] for x in CHUNKS.split(", ")]
MANIFEST = "doc_id long, version string, bucket int, batch long"


@dataclass(frozen=True)
class Config:
    """delimiters, ending, parent_max, child_max: of chunks; title_*: of title lines; buckets: folders of the current table; files: most files in a batch."""

    delimiters: str = "।॥"
    ending: str = " ।"
    parent_max: int = 800
    child_max: int = 200
    title_script: str | None = None
    title_min: int = 2
    title_max: int = 120
    title_chars: int = 5
    title_starters: tuple[str, ...] = segment.PROSE_STARTERS
    title_after_blank: bool = True
    buckets: int = 32
    files: int = 1000

    def chunks(self) -> chunk.ChunkConfig:
        return chunk.ChunkConfig(delimiters=self.delimiters, ending=self.ending, parent_max=self.parent_max, child_max=self.child_max)

    def titles(self) -> segment.TitleRule:
        return segment.TitleRule(self.title_min, self.title_max, self.title_chars, self.title_script, tuple(self.title_starters))


def chunked(docs: DataFrame, c: Config) -> DataFrame:
    """CHUNKS of docs (doc_id, version, lang, text): stories, their parents, these's children with script and search form. Each row follows from its document alone."""
    keyed = docs.select(F.struct("doc_id", "version", "lang").alias("_k"), "text")
    stories = segment.stories(keyed, c.titles(), key="_k", blank_before=c.title_after_blank)
    stories = stories.withColumn("story_id", F.concat(F.col("_k.doc_id").cast("string"), F.lit("_s"), F.col("story").cast("string")))
    parents = chunk.parents(stories, keep=["_k", "title"], c=c.chunks())
    children = chunk.children(parents, keep=["_k", "story_id", "title"], c=c.chunks())
    own = {"script": detect_script(F.col("text")), "search_text": preprocess(F.col("text"))}
    return children.select("_k.*", *[x for x in children.columns if x != "_k"]).withColumns(own).select(*NAMES)


def _take(batch: DataFrame, number: int, out: str, c: Config) -> None:
    """One batch: of each document's rows in it the one with the greatest version, if that is not what the manifest has already.

    Versions are compared without texts; only texts that are new are then shuffled, once.
    """
    spark = batch.sparkSession
    read, new, put = Observation(), Observation(), Observation()
    version = F.sha2(F.concat_ws("\x1f", F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit(""))), 256)
    named = batch.select(F.col("doc_id").cast("long"), version.alias("version"), "lang", F.coalesce("text", F.lit("")).alias("text"))
    seen = named.select("doc_id", "version").observe(read, F.count("*").alias("rows"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nameless"))
    one = seen.where("doc_id is not null").groupBy("doc_id").agg(F.max("version").alias("version"))
    before = rows_at(spark, f"{out}/manifest", MANIFEST).where(F.col("batch") < number)
    held = before.groupBy("doc_id").agg(F.max_by("version", "batch").alias("version"))
    # Spark's own hash, which a shuffle by doc_id deals by
    bucket = F.pmod(F.hash("doc_id"), F.lit(c.buckets))
    fresh = one.join(held, ["doc_id", "version"], "left_anti").withColumn("bucket", bucket)
    fresh.observe(new, F.count("*").alias("rows")).write.mode("overwrite").parquet(f"{out}/manifest/batch={number}")
    fresh = rows_at(spark, f"{out}/manifest/batch={number}", "doc_id long, version string, bucket int")
    # cutting costs more than its bytes tell, so the number of tasks follows from the rows; as a multiple of the buckets, each task holds one
    cores = spark.sparkContext.defaultParallelism
    tasks = min(max(4 * cores, new.get["rows"] // 8192), new.get["rows"] // 64)
    texts = named.join(fresh.select("doc_id", "version"), ["doc_id", "version"], "left_semi").repartition(c.buckets * max(1, -(-tasks // c.buckets)), "doc_id")
    # equal versions are equal rows: any of them will do
    texts = texts.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("version"))).where("_n = 1").drop("_n")
    rows = chunked(texts, c).withColumn("bucket", bucket).observe(put, F.count("*").alias("rows"))
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/chunks/batch={number}")
    log.info("batch %d: read %d rows (%d without doc_id), %d new or changed documents, wrote %d chunks", number, read.get["rows"], read.get["nameless"], new.get["rows"], put.get["rows"])


def _publish(spark: SparkSession, out: str) -> dict:
    """Rewrites the buckets of current that batches after the mark touch, then moves the mark."""
    mark = rows_at(spark, f"{out}/published", "batch long", "json").agg(F.max("batch")).first()[0]
    manifest = rows_at(spark, f"{out}/manifest", MANIFEST)
    later = manifest if mark is None else manifest.where(F.col("batch") > mark)
    found = later.groupBy("bucket").agg(F.max("batch").alias("batch"), F.count("*").alias("n")).collect()  # a row a bucket
    if not found:
        return {"documents": 0, "buckets": 0, "chunks": 0}
    touched = F.col("bucket").isin([r["bucket"] for r in found])
    latest = manifest.where(touched).groupBy("doc_id", "bucket").agg(F.max_by(F.struct("version", "batch"), "batch").alias("_v")).select("doc_id", "bucket", "_v.*")
    chunks = rows_at(spark, f"{out}/chunks", f"{CHUNKS}, batch long, bucket int").where(touched)
    put = Observation()
    # a document without chunks stays as one row without a chunk, so it replaces what it had, and no bucket is ever empty
    rows = latest.join(chunks, ["doc_id", "bucket", "version", "batch"], "left").select(*NAMES, "batch", "bucket").observe(put, F.count("chunk_id").alias("chunks"))
    # a document's chunks stand together; a large bucket is cut in several files
    ordered = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "doc_id", "chunk_id")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{out}/current")
    spark.range(1).select(F.lit(max(r["batch"] for r in found)).cast("long").alias("batch")).coalesce(1).write.mode("overwrite").json(f"{out}/published")
    return {"documents": sum(r["n"] for r in found), "buckets": len(found), "chunks": put.get["chunks"]}


def run(spark: SparkSession, documents: str, out: str, config: Config = Config()) -> dict:
    """Takes the new files of documents (Parquet: doc_id, text, lang; other columns are left out) into the chunk table under out.

    documents may be a file, a folder or a pattern. A document is new if its doc_id is, and changed if its text or lang is; the latest batch that changed it counts. Rows without doc_id are left out and counted in the log. Returns how many documents, buckets and chunks were published.
    """
    documents = documents.rstrip("/")
    # a stream takes a folder or a pattern; as a pattern, a path may also name a single file
    pattern = documents if set(documents) & set("*?[{") else f"{documents[:-1]}[{documents[-1]}]"
    stream = spark.readStream.schema(spark.read.parquet(documents).schema).option("maxFilesPerTrigger", config.files).parquet(pattern)
    taking = stream.writeStream.foreachBatch(lambda batch, number: _take(batch, number, out, config)).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    taking.awaitTermination()
    done = _publish(spark, out)
    log.info("published %d documents: %d buckets rewritten, %d chunks in them, under %s", done["documents"], done["buckets"], done["chunks"], out)
    return done


def current(spark: SparkSession, out: str) -> DataFrame:
    """The current chunk table: CHUNKS, batch and bucket; a document without chunks has one row without them."""
    return rows_at(spark, f"{out}/current", f"{CHUNKS}, batch long, bucket int")


if __name__ == "__main__":
    main("ingest_chunks", ["documents"], Config, run)
