"""The jobs as queries over the given tables, each run twice into one new folder, and the same in DuckDB SQL."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import evaluate_retrieval, ingest_chunks
from jobs.command import read_config
from lipika import queries as own
from lipika.sources.files import shared_dir

HERE = os.path.dirname(os.path.abspath(__file__))


def job1_ingest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current chunk table after two runs of the ingest over all documents."""
    out = f"{shared_dir(spark)}/job1-{uuid.uuid4().hex}"
    config = read_config(ingest_chunks.Config, f"{HERE}/ingest_chunks.json")
    for _ in range(2):
        ingest_chunks.run(spark, f"{sf_dir}/documents.parquet", out, config)
    # Spark's hash of the folder has no counterpart in SQL, and the version is a digest of the text that is there
    return ingest_chunks.current(spark, out).drop("bucket", "version")


def job2_evaluate_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well BM25 finds the documents that quote each benchmark passage, after two runs over all of both tables."""
    out = f"{shared_dir(spark)}/job2-{uuid.uuid4().hex}"
    config = read_config(evaluate_retrieval.Config, f"{HERE}/evaluate_retrieval.json")
    for _ in range(2):
        evaluate_retrieval.run(spark, f"{sf_dir}/benchmark.parquet", f"{sf_dir}/documents.parquet", out, config)
    return evaluate_retrieval.results(spark, out)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_ingest_chunks": job1_ingest_chunks, "job2_evaluate_retrieval": job2_evaluate_retrieval}

ORACLES = {
    "job1_ingest_chunks": f"""WITH RECURSIVE {own.SQL_STORIES},
st AS (SELECT doc_id, doc_id || '_s' || story AS story_id, title, story_text FROM stories),
{own.sql_packed("st", "story_id", "story_text", 800, "par")}, parents AS (SELECT key AS story_id, g, key || '_p' || g AS parent_id, text, before FROM par),
{own.sql_packed("parents", "parent_id", "text", 200, "chi")},
c AS (SELECT p.story_id, c.key AS parent_id, c.key || '_c' || c.g AS chunk_id, c.g AS child_index, count(*) OVER (PARTITION BY c.key) AS total_children, p.before + c.before AS start_char, p.before + c.before + length(c.text) AS end_char, length(c.text) // 4 AS token_count, c.text FROM chi c JOIN parents p ON p.parent_id = c.key)
SELECT d.doc_id, CASE WHEN chunk_id IS NOT NULL THEN d.lang END AS lang, c.story_id, title, parent_id, chunk_id, child_index::BIGINT AS child_index, total_children::BIGINT AS total_children, start_char::BIGINT AS start_char, end_char::BIGINT AS end_char, token_count::BIGINT AS token_count, CASE WHEN chunk_id IS NOT NULL THEN {own.sql_script("c.text")} END AS script, c.text, CASE WHEN chunk_id IS NOT NULL THEN {own.sql_preprocess("c.text")} END AS search_text, 0::BIGINT AS batch
FROM documents d LEFT JOIN (SELECT c.*, st.doc_id, st.title FROM c JOIN st USING (story_id)) c ON c.doc_id = d.doc_id""",
    "job2_evaluate_retrieval": f"""WITH {own.SQL_BM25},
w AS (SELECT item_id, text, len(regexp_extract_all(text, '[^\\s]+'))::BIGINT AS n_words FROM benchmark),
truth AS (SELECT item_id, doc_id FROM w JOIN documents d ON contains(d.text, w.text) WHERE n_words >= 5),
h AS (SELECT query_id AS item_id, ix, score, rank, t.doc_id IS NOT NULL AS right_one FROM lex LEFT JOIN truth t ON t.item_id = lex.query_id AND t.doc_id = lex.ix),
m AS (SELECT item_id, count(*) AS n_hits, count(*) FILTER (right_one AND rank <= 5) AS first5, count(*) FILTER (right_one) AS every, min(rank) FILTER (right_one) AS best, max(score) AS top_score, string_agg(ix, ',' ORDER BY rank) FILTER (rank <= 5) AS top FROM h GROUP BY item_id),
n AS (SELECT item_id, count(*) AS n_truth FROM truth GROUP BY item_id)
SELECT w.item_id, n_words, coalesce(n_truth, 0)::BIGINT AS n_truth, coalesce(n_hits, 0)::BIGINT AS n_hits, CASE WHEN n_truth > 0 THEN coalesce(first5, 0) > 0 END AS found, CASE WHEN n_truth > 0 THEN coalesce(first5, 0) / n_truth END AS recall_at_k, CASE WHEN n_truth > 0 THEN coalesce(every, 0) / n_truth END AS recall, CASE WHEN n_truth > 0 THEN coalesce(1 / best, 0) END AS reciprocal_rank, top_score, coalesce(top, '') AS top,
CASE WHEN n_words < 25 THEN 'words_0_25' WHEN n_words < 45 THEN 'words_25_45' ELSE 'words_45' END AS category
FROM w LEFT JOIN m USING (item_id) LEFT JOIN n USING (item_id)""",
}
