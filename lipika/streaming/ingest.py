"""Incremental ingest: a stream of documents upserted into a chunk table, a batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lipika.operators import chunk


def stream_chunks(docs: DataFrame, out: str, checkpoint: str, config: chunk.ChunkConfig = chunk.ChunkConfig()) -> StreamingQuery:
    """Parents of each document of the stream (doc_id, text), written under out in a folder of their batch; a batch that runs again overwrites its own folder only. The latest batch of a document counts (latest())."""

    def put(batch: DataFrame, number: int) -> None:
        rows = chunk.parents(batch.select(F.col("doc_id").alias("story_id"), F.col("text").alias("story_text")), c=config)
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(rows: DataFrame) -> DataFrame:
    """Of all batches' chunks, those of each document's last batch."""
    last = rows.groupBy("story_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["story_id", "batch"], "left_semi")
