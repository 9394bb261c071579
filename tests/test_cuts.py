"""Texts cut in blocks against plain Python, and what the searches over documents make of them."""

import math
import random
import re

import pyarrow as pa
import pytest
from lipika.functions.normalize import LONG, SHORT
from lipika.operators import cuts, evaluate, lexical

EDGES = lexical.EDGES.replace("\\", "")
ODD = ["😀ab", "a😀 b", " ", "  ", "", "AI", "A", "<EMPTY>", "ab\x00", "\x1cabc\x1d", "\x85x\u2028yI", "--- -- -", "...a...b-!?", "-" * 9, "(x) [yI]U", "a\u1680b\u3000c", "\n", "xx\n\nyy", "é।कि"]


def plain(text, n=3, hybrid=True):
    """lexical.tokens() of a text, by code points."""
    if not text:
        return {lexical.EMPTY}
    solid, fold = text.replace(" ", ""), str.maketrans(LONG, SHORT)
    words = [x for x in (x.strip(EDGES) for x in re.split(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]", text)) if x] if hybrid else []
    grams = [solid[i : i + n] for i in range(len(solid) - n + 1)] or [solid]
    return {y for x in words + grams for y in (x, x.translate(fold))}


def odd_texts(rng, wide):
    letters = [*"abAIU  \n.-,'é।😀\x00\x1c\x85\u2028", *(chr(rng.randrange(0x100, 0xD000)) for _ in range(50 * wide))]
    return [*ODD, *("".join(rng.choice(letters) for _ in range(rng.choice((1, 2, 3, 5, 40, 300)))) for _ in range(9))]


@pytest.mark.parametrize(("n", "hybrid"), [(3, True), (3, False), (1, True), (2, True), (5, True), (12, False)])
def test_blocks_of_texts_have_the_tokens_of_each(n, hybrid):
    cut, rng = lexical.cutter(lexical.Bm25Config(n=n, hybrid=hybrid), lexical.EMPTY), random.Random(n)
    for i in range(30):
        texts = odd_texts(rng, i % 3)
        got = cut.cut(pa.array(["before", *texts]).slice(1))
        names = got.vocabulary.to_pylist()
        assert len(set(names)) == len(names)
        pairs = [(texts[a], names[b]) for a, b in zip(got.text.tolist(), got.token.tolist(), strict=True)]
        assert got.lengths().tolist() == [len(plain(x, n, hybrid)) for x in texts]
        assert set(pairs) == {(x, y) for x in texts for y in plain(x, n, hybrid)}


def test_blocks_hold_all_texts_and_bytes_that_are_no_characters():
    texts = pa.array(["abc", None, "d" * 40, "", "ef"] * 3)
    held = list(cuts.blocks(texts, 10))
    assert [a for a, _ in held] == [sum(len(x) for _, x in held[:i]) for i in range(len(held))] and len(held) > 5
    assert [x for _, b in held for x in b.to_pylist()] == [x or "" for x in texts.to_pylist()]
    broken = pa.StringArray.from_buffers(2, pa.py_buffer(b"\0\0\0\0\3\0\0\0\5\0\0\0"), pa.py_buffer(b"ab\xffcd"))
    got = lexical.cutter(lexical.Bm25Config()).cut(broken)
    assert set(got.vocabulary.to_pylist()) == {"ab�", "cd"}


def test_equal_runs_of_words_have_equal_hashes_anywhere():
    rng, seen, cut = random.Random(5), {}, cuts.Runs(3)
    for i in range(200):
        texts = ["".join(rng.choice("ab \n\té") for _ in range(rng.choice((0, 1, 2, 5, 40)))) for _ in range(rng.randrange(9))]
        inner = bool(i % 2)
        at, h, size = (x.tolist() for x in cut.hashes(pa.array(["before", *texts]).slice(1), inner))
        words = [re.findall(r"[^ \t\n\x0b\f\r]+", x) for x in texts]
        want = [(a, tuple(w[j : j + 3])) for a, w in enumerate(words) for j in range(inner, len(w) - 2 - inner)]
        assert at == [a for a, _ in want] and size == [sum(len(x.encode()) for x in w) for _, w in want]
        for (_, w), x in zip(want, h, strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen) > 100


def test_scores_of_odd_texts_follow_from_their_code_points(spark):
    """A character beyond 16 bits is one character: its halves are no tokens of their own, which made documents longer."""
    rng = random.Random(2)
    texts = [*odd_texts(rng, 0), *odd_texts(rng, 1), None]
    asked = {i: x for i, x in enumerate(["😀ab", " ", None, "x yI b", "a😀"])}
    own = [plain(x) for x in texts]
    df = {t: sum(t in d for d in own) for d in own for t in d}
    n, avgdl = len(own), sum(map(len, own)) / len(own)
    idf = {t: math.log(n - v + 0.5) - math.log(v + 0.5) for t, v in df.items()}
    mean = sum(idf.values()) / len(idf)
    want = {}
    for i, text in asked.items():
        score = [round(sum(0.25 * mean if idf[t] < 0 else idf[t] for t in d & plain(text)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(d) / avgdl)), 6) if text else 0 for d in own]
        want |= {(i, r + 1): (-x, ix) for r, (x, ix) in enumerate(sorted((-x, ix) for ix, x in enumerate(score) if x > 0)[:7])}
    docs = spark.createDataFrame(list(enumerate(texts)), "ix long, text string").repartition(3)
    queries = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    for most in (500_000, 0):
        got = {(r.query_id, r["rank"]): (r.score, r.ix) for r in lexical.bm25(queries, docs, "query_id", "ix", c=lexical.Bm25Config(k=7), digits=6, most_broadcast=most).collect()}
        assert got.keys() == want.keys() and all(got[x][1] == want[x][1] and abs(got[x][0] - want[x][0]) < 2e-6 for x in want)


def test_one_pass_gives_documents_and_terms_however_often_counts_are_passed_on(spark):
    docs = spark.createDataFrame([(i, f"king {i % 7} of the north {i}" if i % 5 else None) for i in range(60)], "ix long, text string").repartition(2)
    c, seen = lexical.Bm25Config(), []
    for most, vocabulary in ((1 << 20, ["king", "nor", "zzz"]), (4, ["king", "nor", *(f"+{i}" for i in range(70_000))])):
        own, terms = lexical.cut_documents(docs, "ix", "text", pa.array(vocabulary), c, most)
        seen.append((sorted((r.ix, r.dl, len(r.at) // lexical.place_type(len(vocabulary))().itemsize) for r in own.collect()), sorted(map(tuple, terms.collect()))))
    assert seen[0] == seen[1] and len(seen[0][0]) == 60
    assert [x[2] for x in seen[0][0]] == [2 if i % 5 else 0 for i in range(60)] and dict(seen[0][1])[lexical.EMPTY] == 12


def test_often_is_a_matter_of_speed_alone(spark):
    docs = spark.createDataFrame([(i, f"king {i % 7} of the north {i} rivers"[: 8 + i % 25]) for i in range(90)], "ix long, text string")
    asked = spark.createDataFrame([(1, "king"), (1, "nor"), (2, "of"), (3, "rive"), (3, "ing")], "query_id long, token string")
    vocabulary = asked.select("token").distinct().toArrow().column("token").combine_chunks()
    own, terms = lexical.cut_documents(docs, "ix", "text", vocabulary, lexical.Bm25Config())
    known = asked.join(lexical.weights(terms, own.selectExpr("count(*) n_docs", "avg(dl) avgdl"), asked), "token")
    shown = [sorted((r.query_id, r["rank"], r.ix, r.score) for r in lexical.score_blocks(own, known, vocabulary, "query_id", "ix", lexical.Bm25Config(k=9), 6, rows=16, slice_queries=2, often=x).collect()) for x in (0.0, 0.2, 2.0)]
    assert shown[0] == shown[1] == shown[2] and {x[0] for x in shown[0]} == {1, 2, 3}


def test_quotes_read_documents_once(spark):
    """Items travel: documents are neither joined, nor are their runs exploded."""
    items = spark.createDataFrame([(1, "one two three four five"), (2, "two three four"), (3, "so two three four so"), (4, "two two three four  four")], "item_id long, text string")
    docs = spark.createDataFrame([(10, "one two three four five"), (11, "x one two three four\nfive"), (12, "so two three four so two three four so"), (12, "so two three four so"), (13, "two two three four  four."), (14, None)], "doc_id long, text string")
    got = evaluate.quotes(items, docs)
    assert not re.search("Join|Generate", got._jdf.queryExecution().analyzed().toString())
    assert sorted(map(tuple, got.collect())) == [(1, 10), (3, 12), (4, 13)]
