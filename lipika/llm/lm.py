"""Language-model scoring by a weighted backoff automaton over n-grams counted in the whole corpus.

Documents become blocks of token numbers. All counts are exact sums over all training documents, found by a packed exchange for each length: every block sends its distinct n-grams with its own counts and gets the corpus counts back, so each block ends up with the part of the automaton that its documents can reach, and no task holds more.

N-grams are told apart by 64-bit hashes of their words' hashes. Of n distinct ones, about n * n / 2^64 share theirs and are counted as one: none to be expected below 1e9, and at 1e12 some 5e4, a share of 5e-8.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PACKED, exchange, hashes, ints, mix, pack_keys, parts_of, read_replies, replies, rows_of, runs, squeeze, stash, table, unsqueeze

END = b"\n"  # no word holds a line break


@dataclass(frozen=True)
class LmConfig:
    """order: longest n-gram. prior: how many observations the shorter context's distribution counts for in that of a longer one. discount: taken off each word's count and given to the one unknown word.

    folds, held: a document is held out if crc32(doc_id as text) mod folds is held. stretch: tokens that the traversal reads in a row; a longer text is read in several stretches, each of which first reads the order - 1 tokens before it.
    """

    order: int = 3
    prior: float = 16.0
    discount: float = 0.75
    folds: int = 7
    held: int = 2
    block_bytes: int = 4 << 20
    stretch: int = 256


CORPUS = "block long, ids binary, null_ids binary, sizes binary, held binary, seq binary, keys binary, train_tokens long"


def corpus_blocks(docs: DataFrame, c: LmConfig) -> DataFrame:
    """Blocks of documents as numbers of their lower-cased (A-Z) words, each document with an end; numbers are places among the block's sorted word hashes. Null text is empty: an end alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, k = TaskContext.get().partitionId() << 32, 0
        ids: list = []
        sizes: list[int] = []
        words: list[bytes] = []
        read = 0

        def flush() -> pa.RecordBatch:
            keys, seq = np.unique(hashes(words), return_inverse=True)
            held = np.array([zlib.crc32(("" if i is None else str(i)).encode()) % c.folds == c.held for i in ids], np.uint8)
            n = np.array(sizes, np.int64)
            cells = [np.array([i or 0 for i in ids], np.int64).tobytes(), np.array([i is None for i in ids], np.uint8).tobytes(), n.tobytes(), held.tobytes(), squeeze(seq.astype(np.uint32)), squeeze(np.diff(keys, prepend=np.uint64(0)))]
            return pa.RecordBatch.from_arrays([pa.array([base + k], pa.int64()), *[pa.array([x], pa.binary()) for x in cells], pa.array([int(n[held == 0].sum())], pa.int64())], names=[x.split()[0] for x in CORPUS.split(", ")])

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                text = text.as_py() or b""
                own = text.lower().split()
                words += own
                words.append(END)
                ids.append(i)
                sizes.append(len(own) + 1)
                read += len(text)
                if read >= c.block_bytes or len(ids) >= c.block_bytes >> 5:
                    yield flush()
                    ids, sizes, words, read, k = [], [], [], 0, k + 1
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, CORPUS)


class Grams:
    """The n-grams of one length in a block. at: positions where they end; key: their distinct keys, sorted; first: a place in at of each; of: place of each position's n-gram among the keys; count: corpus counts."""

    def __init__(self, at: np.ndarray, gram: np.ndarray):
        order = np.argsort(gram)
        ordered = gram[order]
        start = runs(ordered)
        self.at, self.key, self.first = at, ordered[start], order[start]
        self.of = np.empty(len(gram), np.int32)
        self.of[order] = np.repeat(np.arange(len(start), dtype=np.int32), np.diff(np.append(start, len(gram))))


class Block:
    """A block of documents and its n-grams."""

    def __init__(self, row: dict, c: LmConfig):
        self.c = c
        self.ids, self.sizes = ints(row["ids"]), ints(row["sizes"])
        self.null = np.frombuffer(row["null_ids"], np.uint8).astype(bool)
        self.held = np.frombuffer(row["held"], np.uint8).astype(bool)
        self.seq = unsqueeze(row["seq"], np.uint32).astype(np.int32)
        self.words = np.cumsum(unsqueeze(row["keys"], np.uint64), dtype=np.uint64)
        ends = np.cumsum(self.sizes)
        self.starts, self.n_words = ends - self.sizes, len(self.words)
        self.levels: list[Grams] = []

    def grams(self, longest: int) -> Iterator[np.ndarray]:
        """Positions at which an n-gram ends, and its hash, for each n from 1."""
        inside = np.arange(len(self.seq)) - np.repeat(self.starts, self.sizes)
        gram = self.words[self.seq]
        yield np.arange(len(self.seq)), gram
        for n in range(2, longest + 1):
            at = np.nonzero(inside >= n - 1)[0]
            longer = np.zeros(len(self.seq), np.uint64)
            longer[at] = mix(mix(gram[at - 1] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) + self.words[self.seq[at]])
            gram = longer
            yield at, gram[at]

    def level(self, n: int) -> tuple[Grams, np.ndarray]:
        """The n-grams of one length, and how often the block's training documents have each."""
        *_, (at, gram) = self.grams(n)
        x, train = Grams(at, gram), np.repeat(~self.held, self.sizes)
        return x, np.bincount(x.of[train[at]], minlength=len(x.key)).astype(np.uint32)

    def answered(self, row: dict) -> None:
        """All levels with their corpus counts."""
        for n, (at, gram) in enumerate(self.grams(self.c.order), 1):
            x = Grams(at, gram)
            x.count = read_replies(row[f"count{n}"], np.int64) >> 1
            self.levels.append(x)


def _counted(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Twice the corpus count of each key, 1 more for the first of a key's askers."""
    order = np.argsort(keys, kind="stable")
    first = runs(keys[order])
    found = np.repeat(2 * np.add.reduceat(counts[order].astype(np.int64), first), np.diff(np.append(first, len(keys))))
    found[first] += 1
    out = np.empty(len(keys), np.int64)
    out[order] = found
    return out


class Automaton:
    """The model within a block: states, arcs by state and token, and failure arcs.

    A state is an n-gram that training documents continue; state 0 is the empty one. An arc for each token that follows it in training has the log-probability as weight and leads to the longest n-gram read that is a state; state 0 has an arc for every token. A state without an arc for a token fails to the state of its n-gram less the first word, at the weight of its backoff.
    Probabilities: a context h seen c(h) times gives a token v (c(hv) + prior * p(v | h less its first word)) / (c(h) + prior), so they sum to one; the first term is an arc's, what a token without an arc gets is the failure's weight. As every document ends with a token of its own, c(h) is also the sum of its continuations' counts.
    """

    def __init__(self, b: Block, n_train: int, n_types: int):
        c, size = b.c, len(b.seq)
        # absolute discounting of words; what is taken off goes to the one unknown word
        total, count = max(1, n_train), b.levels[0].count
        known = np.where(count > 0, (count - c.discount) / total, max(n_types * c.discount, 1.0 if not n_train else 0.0) / total)
        p = known[b.seq]
        ends = np.zeros(size, bool)
        ends[np.cumsum(b.sizes) - 1] = True
        self.tokens = np.int64(b.n_words)
        after = np.zeros(size, np.int64)  # by position: the state of the longest n-gram so far that ends there
        reached = np.zeros(size, np.int64)  # the same of just the level below, 0: none
        context_count = np.full(size, n_train)
        fail, weight = [np.zeros(1, np.int64)], [np.zeros(1)]
        arcs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        states = 1
        for n, x in enumerate(b.levels, 1):
            seen = x.count[x.of]
            if n > 1:
                before = context_count[x.at - 1]
                p_at = p[x.at]
                p[x.at] = np.where(before > 0, (seen + c.prior * p_at) / (before + c.prior), p_at)
            source = reached[x.at - 1] if n > 1 else np.zeros(len(x.at), np.int64)
            if n < len(b.levels):
                state = x.at[(seen > 0) & ~ends[x.at]]
                ids = np.full(len(x.key), -1, np.int64)
                own = np.zeros(size, bool)
                own[state] = True
                distinct = np.nonzero(own[x.at[x.first]])[0]
                ids[distinct] = states + np.arange(len(distinct))
                fail.append(after[x.at[x.first[distinct]]])
                weight.append(np.log10(c.prior / (x.count[distinct] + c.prior)))
                states += len(distinct)
                reached = np.zeros(size, np.int64)
                of = np.full(size, -1, np.int32)
                of[x.at] = x.of
                reached[state] = ids[of[state]]
                after[state] = reached[state]
                context_count = np.zeros(size, np.int64)
                context_count[x.at] = seen
            # an arc for each distinct n-gram that training has; every token from state 0
            first = x.first if n == 1 else x.first[x.count > 0]
            at = x.at[first]
            arcs.append((source[first] * self.tokens + b.seq[at], np.log10(p[at]), after[at]))
        keys = np.concatenate([a[0] for a in arcs])
        order = np.argsort(keys)
        self.keys, self.weights, self.to = keys[order], np.concatenate([a[1] for a in arcs])[order], np.concatenate([a[2] for a in arcs])[order]
        self.fail, self.backoff = np.concatenate(fail), np.concatenate(weight)

    def traverse(self, seq: np.ndarray, starts: np.ndarray, sizes: np.ndarray, lead: int, stretch: int) -> np.ndarray:
        """Log-probability of each document, read from left to right: every token takes the current state's arc, or fails until a state has one, and the arc's end is the next state.

        All documents of the block advance together, a token a step. A document longer than stretch is read in several stretches: from lead tokens before its stretch on, which lead to the same state as the whole text before, as no state has more words.
        """
        pieces = np.maximum(1, -(-sizes // stretch))
        doc = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        early = np.minimum(lead, nth * stretch)  # nth is 0 or a whole stretch lies before
        begin = starts[doc] + nth * stretch - early
        length = np.minimum(stretch, sizes[doc] - nth * stretch) + early
        order = np.argsort(-length, kind="stable")
        doc, begin, length, early = doc[order], begin[order], length[order], early[order]
        state, total = np.zeros(len(doc), np.int64), np.zeros(len(doc))
        for t in range(int(length.max(initial=0))):
            m = int(np.searchsorted(-length, -t, "left"))  # stretches with a token t
            token, got = seq[begin[:m] + t], np.zeros(m)
            now = state[:m].copy()
            open_ = np.arange(m)
            while len(open_):
                key = now[open_] * self.tokens + token[open_]
                place = np.searchsorted(self.keys, key)
                place[place == len(self.keys)] = 0
                hit = self.keys[place] == key
                taken, missed = open_[hit], open_[~hit]
                got[taken] += self.weights[place[hit]]
                state[taken] = self.to[place[hit]]
                got[missed] += self.backoff[now[missed]]
                now[missed] = self.fail[now[missed]]
                open_ = missed
            total[:m] += np.where(t >= early[:m], got, 0.0)
        return np.bincount(doc, total, len(sizes))


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, config: LmConfig = LmConfig()) -> DataFrame:
    """SCORES of every row of docs (doc_id, text; other columns are left out); the model learns from the rows that are not held out, and from all their n-grams up to config.order words.

    base_score: add-one unigrams. score: see Automaton; over the known words and one unknown word, probabilities of a context's next token sum to one. Repeated doc_ids are documents of their own; a null doc_id has the text '' for its fold, null text is empty. A very long text is read in stretches, with the same result.
    """
    c = config
    corpus = stash(corpus_blocks(docs, c), "corpus")
    facts = corpus.agg(F.count("*"), F.sum("train_tokens")).first()
    n_train = int(facts[1] or 0)

    def rows(n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in rows_of(batch):
                    x, own = Block(row, c).level(n)
                    yield pack_keys(row["block"], x.key, [own])

        return run

    # one length after the other, as the shuffle of all at once takes twice the disk
    counts = [stash(replies(exchange(corpus.mapInArrow(rows(n), PACKED), _counted, [np.uint32], np.int64, parts_of(facts[0])), f"count{n}"), f"count{n}") for n in range(1, c.order + 1)]
    n_types = _types(counts[0])

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                b = Block(row, c)
                b.answered(row)
                known = b.levels[0].count
                base = np.log10((known + 1) / (n_train + n_types + 1))[b.seq]
                got = Automaton(b, n_train, n_types).traverse(b.seq, b.starts, b.sizes, c.order - 1, c.stretch)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b.ids, pa.int64(), mask=b.null), pa.array(b.held), pa.array(b.sizes), pa.array(np.add.reduceat((known > 0)[b.seq].astype(np.int64), b.starts)), pa.array([n_train] * len(b.ids), pa.int64()), pa.array(np.add.reduceat(base, b.starts)), pa.array(got, pa.float64())],
                    names=[x.split()[0] for x in SCORES.split(", ")],
                )

    for x in counts:
        corpus = corpus.join(x, "block", "left")
    return corpus.mapInArrow(scores, SCORES)


def _types(counts: DataFrame) -> int:
    """Distinct training tokens: words with a count, each counted at its first asker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cells in batch.column(0).to_pylist():
                x = read_replies(cells, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([int(((x & 1 > 0) & (x > 1)).sum())], pa.int64())], names=["n"])

    return int(counts.select("count1").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0)


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the six sevenths that are not held out."""
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
