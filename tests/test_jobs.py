"""The jobs: growing input in two runs, failures between steps, command line, and the registered queries against DuckDB."""

import json
import math
import os
import subprocess
import sys

import pytest
from jobs import command, evaluate_retrieval, ingest_chunks, registry
from lipika.operators import evaluate
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
CONFIG = ingest_chunks.Config(delimiters=".", ending=" .", title_script="[A-Z]", title_chars=1, title_max=60, title_starters=("It ",), title_after_blank=False, parent_max=20, child_max=6, buckets=8)
DOCS = "doc_id long, text string, lang string, extra int"


def text(i, n=6):
    return f"Title{i}\n" + " ".join(f"words of sentence {j} in {i}." for j in range(n))


def put(spark, rows, at):
    spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(at)


def chunks(spark, out):
    return {tuple(r) for r in ingest_chunks.current(spark, out).drop("batch", "version").collect()}


def files_of(spark, out):
    """Files of each bucket of the current table."""
    rows = spark.read.parquet(f"{out}/current").select("bucket", "_metadata.file_path").distinct().collect()
    by = {}
    for r in rows:
        by.setdefault(r.bucket, set()).add(r.file_path)
    return by


def test_ingest_takes_only_what_is_new(spark, tmp_path):
    docs, out = f"file://{tmp_path}/docs", f"file://{tmp_path}/out"
    first = [(i, text(i), "en", 1) for i in range(40)] + [(None, text(99), "en", 1), (3, text(3), "en", 2), (41, None, "de", 1), (42, " . \n", None, 1)]
    put(spark, first, docs)
    done = ingest_chunks.run(spark, docs, out, CONFIG)
    assert done["documents"] == 42 and done["buckets"] == 8
    before, held = files_of(spark, out), chunks(spark, out)
    # nothing new: nothing is written
    assert ingest_chunks.run(spark, docs, out, CONFIG)["documents"] == 0 and files_of(spark, out) == before
    # one changed, one emptied, one new, one as it was
    put(spark, [(5, text(5, 9), "en", 1), (7, "", "en", 1), (50, text(50), "fr", 1), (9, text(9), "en", 7)], docs)
    done = ingest_chunks.run(spark, docs, out, CONFIG)
    after, now = files_of(spark, out), chunks(spark, out)
    touched = {r.bucket for r in ingest_chunks.current(spark, out).where("doc_id in (5, 7, 50)").collect()}
    assert done["documents"] == 3 and done["buckets"] == len(touched)
    assert {b: f for b, f in after.items() if b not in touched} == {b: f for b, f in before.items() if b not in touched}
    assert all(not after[b] & before.get(b, set()) for b in touched)
    assert {x for x in now if x[0] not in (5, 7, 50)} == {x for x in held if x[0] not in (5, 7)}
    assert [x[1:7] for x in now if x[0] == 7] == [(None,) * 6]
    # as if all had come at once
    whole, other = f"file://{tmp_path}/whole", f"file://{tmp_path}/other"
    last = {r[0]: r for r in first if r[0] is not None} | {5: (5, text(5, 9), "en", 1), 7: (7, "", "en", 1), 50: (50, text(50), "fr", 1)}
    put(spark, list(last.values()), whole)
    ingest_chunks.run(spark, whole, other, CONFIG)
    assert chunks(spark, other) == now


def test_ingest_goes_on_after_failures(spark, tmp_path, monkeypatch):
    docs, out = f"file://{tmp_path}/docs", f"file://{tmp_path}/out"
    put(spark, [(i, text(i), "en", 1) for i in range(10)], docs)

    def fails(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:  # after the stream, before the current table
        m.setattr(ingest_chunks, "_publish", fails)
        with pytest.raises(RuntimeError):
            ingest_chunks.run(spark, docs, out, CONFIG)
    assert ingest_chunks.run(spark, docs, out, CONFIG)["documents"] == 10
    put(spark, [(3, text(3, 2), "en", 1), (11, text(11), "en", 1)], docs)
    with monkeypatch.context() as m:  # within a batch, after its manifest
        m.setattr(ingest_chunks, "chunked", fails)
        with pytest.raises(Exception, match="lost"):
            ingest_chunks.run(spark, docs, out, CONFIG)
    assert ingest_chunks.run(spark, docs, out, CONFIG)["documents"] == 2
    whole, other = f"file://{tmp_path}/whole", f"file://{tmp_path}/other"
    put(spark, [(i, text(i, 2 if i == 3 else 6), "en", 1) for i in [*range(10), 11]], whole)
    ingest_chunks.run(spark, whole, other, CONFIG)
    assert chunks(spark, other) == chunks(spark, out)


def test_ingest_returns_to_an_earlier_version(spark, tmp_path):
    docs, out = f"file://{tmp_path}/docs", f"file://{tmp_path}/out"
    seen = []
    for n in (3, 5, 3):
        put(spark, [(1, text(1, n), "en", 1)], docs)
        assert ingest_chunks.run(spark, docs, out, CONFIG)["documents"] == 1
        seen.append(chunks(spark, out))
    assert seen[0] == seen[2] != seen[1]
    assert ingest_chunks.run(spark, docs, f"file://{tmp_path}/out", CONFIG)["documents"] == 0


def test_cutting_is_dealt_over_all_cores(spark, tmp_path):
    """A batch of few bytes but many texts is not cut by one task, and each task holds one bucket."""
    docs, out = f"file://{tmp_path}/docs", f"file://{tmp_path}/out"
    put(spark, [(i, text(i, 2), "en", 1) for i in range(1100)], docs)
    assert ingest_chunks.run(spark, docs, out, CONFIG)["documents"] == 1100
    written = spark.read.parquet(f"{out}/chunks").select("bucket", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).alias("task")).distinct()
    assert written.count() == written.select("task").distinct().count() == 16


def test_quotes_against_brute_force(spark):
    items = [(1, "a b c d e"), (2, "x y z"), (3, "b b b b b b"), (4, "one two\nthree four five"), (5, None), (6, "half of this text here"), (7, "b c d e f g")]
    docs = [(10, "zz a b c d e f g"), (11, "a b c d ee"), (12, "b " * 50), (13, "one two three four five"), (14, "so: one two\nthree four five!"), (15, None), (16, ""), (17, "xa b c d efg")] * 2
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int").drop("doc_id")
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = {(a, b) for a, t in items for b, u in docs if t and u and len(t.split()) >= 5 and t in u}
    for most in (500_000, 0):
        assert {tuple(r) for r in evaluate.quotes(i, d, most_broadcast=most).collect()} == want
    assert evaluate.quotes(i.limit(0), d).count() == 0 and evaluate.quotes(i, d.limit(0)).count() == 0


def test_evaluation_is_repeatable(spark, tmp_path):
    items = [(1, "alpha beta gamma delta epsilon"), (2, "not to be found anywhere at all"), (3, "too short"), (4, None), (None, "no id of its own here"), (1, "alpha")]
    docs = [(i, f"filler {i} " * 5) for i in range(20)] + [(100, "so alpha beta gamma delta epsilon it is"), (101, "alpha beta gamma delta epsilon"), (102, None), (None, "alpha beta gamma delta epsilon")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/items")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"file://{tmp_path}/docs")
    seen = []
    for _ in range(2):
        done = evaluate_retrieval.run(spark, f"file://{tmp_path}/items", f"file://{tmp_path}/docs", f"file://{tmp_path}/out", evaluate_retrieval.Config(bounds=(3,), first=1))
        assert done == {"rows": 4, "judged": 1, "found": 1}
        seen.append(sorted(evaluate_retrieval.results(spark, f"file://{tmp_path}/out").collect()))
    assert seen[0] == seen[1]
    by = {r.item_id: r for r in seen[0]}
    assert (by[1].n_truth, by[1].found, by[1].recall_at_k, by[1].recall, by[1].reciprocal_rank, by[1].top) == (2, True, 0.5, 1.0, 1.0, "101")
    assert by[2].n_truth == 0 and by[2].recall is None and by[3].n_truth == 0
    assert {r.category for r in seen[0]} == {"words_0_3", "words_3"}


def test_components_count_rows_and_time(spark):
    c = evaluate.Components()
    assert c.measured("a", spark.range(7)).count() == 7 and c.measured("b", spark.range(0)).count() == 0
    got = c.report(spark).collect()
    assert [(r.component, r.rows) for r in got] == [("a", 7), ("b", 0)] and all(r.milliseconds > 0 for r in got)


def test_config_files(tmp_path):
    for kind, name in ((ingest_chunks.Config, "ingest_chunks"), (evaluate_retrieval.Config, "evaluate_retrieval")):
        assert command.read_config(kind, f"{ROOT}/jobs/{name}.json") != command.read_config(kind, None) or name == "evaluate_retrieval"
    (tmp_path / "c.json").write_text(json.dumps({"nonsense": 1}))
    with pytest.raises(ValueError, match="nonsense"):
        command.read_config(ingest_chunks.Config, str(tmp_path / "c.json"))


@given
def test_command_line(spark, tmp_path):
    ran = subprocess.run([sys.executable, "-m", "jobs.ingest_chunks", "--documents", f"{SF}/documents.parquet", "--out", f"file://{tmp_path}/out", "--config", f"{ROOT}/jobs/ingest_chunks.json", "--master", "local[2]"], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-2000:]
    assert "published 200 documents" in ran.stderr
    assert ingest_chunks.current(spark, f"file://{tmp_path}/out").select("doc_id").distinct().count() == 200


def shown(v):
    return ("nan" if math.isnan(v) else f"{v:.8g}") if isinstance(v, float) else str(v)


@given
@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_queries_against_duckdb(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    settings = lambda: {r.key: r.value for r in spark.sql("SET").collect() if r.key != "spark.checkpoint.dir"}
    before = settings()
    df = registry.QUERIES[name](spark, SF)
    assert settings() == before
    r = c.execute(registry.ORACLES[name])
    cols = [d[0] for d in r.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(tuple(map(shown, x)) for x in df.select(cols).collect()) == sorted(tuple(map(shown, x)) for x in r.fetchall())
