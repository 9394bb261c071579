import collections
import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lipika.llm import align, pu

from cases import frame, odd_documents

SF = "/root/testdata/sf0.01"

# --- 11: positive-unlabelled quality ---


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def marked_documents(n=600, bad=0.3, seed=4):
    """(doc_id, text, good): plain prose, and pages of symbols or shouting."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("aeimnorst") for _ in range(r.randint(2, 9))) for _ in range(300)]
    rows = []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.randint(30, 120))]
        good = r.random() >= bad
        if not good:
            words = [w.upper() + "!!" if i % 2 else w + "$$$" for w in words]
        rows.append((i, " ".join(words) + ".", good))
    return rows


def judged(spark, rows, labels, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return pu.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int"), **more)


def test_held_out_accuracy_and_prior(spark):
    rows = marked_documents()
    report = {}
    labels = [(i, int(good)) for i, _, good in rows if i % 2 == 0]
    got = {r.doc_id: r for r in judged(spark, [x[:2] for x in rows], labels, report=report).collect()}
    assert all(got[i].held_out == held(i) for i, _, _ in rows)
    own = [(got[i].predicted, int(good)) for i, _, good in rows if held(i)]
    assert sum(a == b for a, b in own) >= 0.95 * len(own)
    assert abs(report["prior"] - 0.7) < 0.1
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())


def test_only_trusted_positives_of_the_training_fold_are_read(spark):
    rows = marked_documents(200)
    labels = [(i, int(good)) for i, _, good in rows if i % 2 == 0]
    plain = [x[:2] for x in rows]
    first = {r.doc_id: r.score for r in judged(spark, plain, labels).collect()}
    other = [(i, 1 - q if held(i) else q) for i, q in labels if q == 1 or held(i)] + [(None, 1), (10**9, 1), (labels[0][0], None)]
    assert first == {r.doc_id: r.score for r in judged(spark, plain, other).collect()}


def test_scores_depend_on_texts_alone(spark):
    rows = odd_documents()
    rows += [(None, rows[0][1]), (None, None), rows[1], rows[1]]
    d = frame(spark, rows).withColumn("x", F.lit("x")).withColumn("score", F.lit(9)).withColumn("held_out", F.lit(1)).withColumn("label", F.lit(0))
    labels = spark.createDataFrame([(i, 1) for i in range(0, 50, 2)], "doc_id long, quality int")
    got = pu.classify(d, labels).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
    text = dict(rows)
    by = collections.defaultdict(set)
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id is not None:
            by[text[r.doc_id] or ""].add(r.score)
    assert all(len(x) == 1 for x in by.values()) and len(by) > 50


def test_without_positives_or_rows(spark):
    got = judged(spark, [(1, "a b c"), (2, None)], [(1, 0), (2, None)]).collect()
    assert {(r.doc_id, r.score, r.predicted) for r in got} == {(1, 0.5, 0), (2, 0.5, 0)}
    assert judged(spark, [], [(1, 1)]).count() == 0
    assert judged(spark, [(1, "same"), (3, "same")], [(1, 1), (3, 1)]).count() == 2


def test_risk_is_least_at_the_fit(spark, monkeypatch):
    """Against the risk as it is defined, at random weights nearby and far off."""
    monkeypatch.setattr(pu, "_summed", lambda x, part, size: part(x))
    r = np.random.default_rng(1)
    u = np.vstack([r.normal(1, 1, (700, 2)), r.normal(-1, 1, (300, 2))])
    p = r.normal(1, 1, (200, 2))
    c = pu.PuConfig(rounds=40, tolerance=0, ridge=0.01, ridge_rows=0)
    m = pu.fit(p, u, 0.7, np.zeros(2), np.ones(2), c)

    def risk(w):
        g = lambda x: x @ w[:2] + w[2]
        l = lambda z: np.log1p(np.exp(-z))  # noqa: E731, E741
        soft = c.softness / len(p) ** 0.5
        rest = l(-g(u)).mean() - 0.7 * l(-g(p)).mean()
        return 0.7 * l(g(p)).mean() + soft * np.log1p(np.exp(rest / soft)) + c.ridge / 2 * (w[:2] ** 2).sum()

    assert all(risk(m.weights) <= risk(m.weights + r.normal(0, s, 3)) + 1e-9 for s in (1e-3, 1e-2, 0.1, 1) for _ in range(100))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_given_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    got = pu.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)


# --- 12: two tokenizers ---


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in printable)}
    found, counts = [], collections.Counter()
    for i, x in rows:
        a = t.encode(" " + x, add_special_tokens=False) if x else None
        ids = sp.encode(x, num_threads=1) if x else []
        of_a = [bytes(byte_of[c] for c in q) for q in a.tokens] if x else []
        of_b = [bytes([int(q[3:5], 16)]) if len(q) == 6 and q.startswith("<0x") else q.replace("▁", " ").encode() for q in map(sp.id_to_piece, ids)]
        whole = (" " + (x or "")).encode()
        if not x or b"".join(of_a) != whole or b"".join(of_b) != whole:
            found.append((i, [], [], [], []))
            continue
        at_a, at_b = ([sum(map(len, q[: k + 1])) for k in range(len(q))] for q in (of_a, of_b))
        links = [(p, q) for p, u in zip(a.ids, at_a, strict=True) for q, v in zip(ids, at_b, strict=True) if u == v] if len(ids) < 300 else [(p, dict(zip(at_b, ids, strict=True))[u]) for p, u in zip(a.ids, at_a, strict=True) if u in set(at_b)]
        cuts, groups = sorted(set(at_a) & set(at_b)), []
        for low, high in zip([0, *cuts], cuts, strict=False):
            groups.append(([p for p, u in zip(a.ids, at_a, strict=True) if low < u <= high], [q for q, v in zip(ids, at_b, strict=True) if low < v <= high]))
        counts.update(links)
        found.append((i, a.ids, ids, groups, links))
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(i, len(a), len(b), len(g), len(l), sum(counts[x] == best[x[1]] for x in l), sum(counts[x] for x in l), hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g).encode()).hexdigest() if a else "") for i, a, b, g, l in found]


ODD = ["<|endoftext|> and <s></s><unk>", "▁ already", "tab\tand\nlines\r\n", "  two  spaces ", "धर्मः naïve 😀🏳️‍🌈 № ﬁ Å", "\u0000\u0001", "a" * 500, "Ünïcödé " * 20, "é", "e\u0301", "<0x41>", "١٢٣", "　", "x" * 3 + " " * 40 + "y"]


def test_alignment_against_brute_force(spark):
    rows = [(i, t if t is None else t[:900]) for i, t in odd_documents()] + [(100 + i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (5, "again"), (100, ODD[0])]
    d = frame(spark, rows).withColumn("links", F.lit("x")).withColumn("pairs", F.lit(1)).withColumn("salt", F.lit(2))
    got = [tuple(r) for r in align.alignment(d, align.AlignConfig(slice_bytes=3000)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(brute_alignment(rows), key=key)


def test_alignment_of_nothing_and_of_long_texts(spark):
    d = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {tuple(r) for r in align.alignment(d).collect()} == {(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)}
    assert align.alignment(d.limit(0)).count() == 0
    long = "some words, again and again. " * 20000
    got = align.alignment(spark.createDataFrame([(1, long), (2, long)], "doc_id long, text string")).collect()
    assert got[0].n_groups > 100_000 and {r.doc_id for r in got} == {1, 2} and got[0][1:] == got[1][1:]


def test_group_text_and_bound(spark):
    d = spark.createDataFrame([(1, "unbelievable tokenizers")], "doc_id long, text string")
    r = align.aligned(d, groups=True).first()
    assert hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256
    assert r.groups.count(";") + 1 == r.n_groups and len(r.groups.replace("|", ",").replace(";", ",").split(",")) == r.n_a + r.n_b
    assert 32_000 < align.most_pairs() < 2_000_000


def test_cross_of_tokens_without_bytes():
    sizes = np.array([1, 0, 2])
    cuts, ga, gb, la, lb = align.align(np.array([0, 1, 2]), np.array([0, 1, 1, 0, 0]), sizes, sizes)
    assert cuts.tolist() == [1, 3] and ga.tolist() == [0, 0, 1] and gb.tolist() == [0, 0, 0, 1, 1]
    assert list(zip(la.tolist(), lb.tolist(), strict=True)) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 4)]
