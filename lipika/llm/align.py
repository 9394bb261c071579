"""Alignment of two tokenizers over a corpus: groups between common cuts, links of tokens that end together, corpus-wide counts of linked ids.

Tokens, cuts, groups and links come from array operations over a few megabytes of text at a time. Only counts of distinct id pairs are shuffled, in two stages of which the first is salted; texts and tokens never are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch_slices, raw, runs, squeeze, stash, table, unsqueeze

_held: dict = {}


@dataclass(frozen=True)
class AlignConfig:
    """salt: shares of an id pair's counts in the first stage. slice_bytes: text whose tokens are in memory at once (a longer text is alone)."""

    a: str = "byte_bpe_50k.json"
    b: str = "piece_bpe_32k.model"
    salt: int = 16
    slice_bytes: int = 1 << 19


def load_a(path: str):
    """(encode, token bytes by id) of a byte-level BPE file: encode(text) gives the ids of the tokenizers library with encode_special_tokens, so special tokens' strings are plain text.

    The file's vocabulary and merges are read into the faster tiktoken encoder, where ids are merge ranks, if they are of that kind and a probe agrees; else the tokenizers library itself encodes. Kept per process.
    """
    if path in _held:
        return _held[path]
    import json
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import tiktoken
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True

    def slow(text: str) -> list[int]:
        return plain.encode(text, add_special_tokens=False).ids

    encode = slow
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # byte-level alphabets write printable bytes as themselves and the others, in order, from U+0100 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [x for x in range(256) if x not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {x["content"] for x in spec.get("added_tokens", [])}
    vocab = spec["model"]["vocab"]
    pieces = [b""] * (max(vocab.values(), default=-1) + 1)
    for k, v in vocab.items():
        pieces[v] = bytes(byte_of[c] for c in k) if all(c in byte_of for c in k) else k.encode()
    ranks = {pieces[v]: v for k, v in vocab.items() if k not in special}
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    in_order = [vocab["".join(m)] for m in merges]
    if in_order == sorted(in_order) and len(ranks) == len(vocab.keys() - special) and not spec["model"].get("ignore_merges") and spec.get("normalizer") is None:
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        probe = " It's  a test: naïve façade, 12345 №№ धर्म \n\n\t x=y;####  end <|endoftext|> "
        if fast(probe) == slow(probe):
            encode = fast
    _held[path] = encode, pieces
    return _held[path]


def load_b(path: str):
    """(encode of a list of texts, token bytes by id) of a sentencepiece model: U+2581 of a piece is a space, <0xHH> the byte HH; control pieces have their own names. Kept per process."""
    if path in _held:
        return _held[path]
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(m.get_piece_size())]
    _held[path] = (lambda texts: m.encode(texts, num_threads=1)), pieces
    return _held[path]


def _ends(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes[ids], dtype=np.int64)


def cross(first_a: np.ndarray, n_a: np.ndarray, first_b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of all pairs of each group's n_a members of a with its n_b of b, which stand in a row from first_a and first_b on."""
    n = n_a * n_b
    group = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return first_a[group] + at // n_b[group], first_b[group] + at % n_b[group]


def align(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two tokenizations of the same bytes: (cuts: offsets where tokens of both end; the group of each token of a; of b; and of each link its place in a and in b). Links are the pairs of tokens that end at the same offset.

    A token without bytes belongs to the group that ends at its offset.
    """
    ends_a, ends_b = _ends(a, sizes_a), _ends(b, sizes_b)
    # ends rise, so one of each run is all that is distinct
    cuts = np.intersect1d(ends_a[runs(ends_a)], ends_b[runs(ends_b)], assume_unique=True)
    first_a, first_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
    n_a, n_b = np.searchsorted(ends_a, cuts, "right") - first_a, np.searchsorted(ends_b, cuts, "right") - first_b
    return cuts, np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b), *cross(first_a, n_a, first_b, n_b)


def _shown(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, names: np.ndarray, last: np.ndarray) -> list[bytes]:
    """The tokens in the order of groups, a's before b's, each with the mark that follows it: , within a side, | between the sides, ; between groups and nothing at the ends of documents (groups last)."""
    n = len(a) + len(b)
    if not n:
        return []
    ids, group, side = np.concatenate([a, b]), np.concatenate([group_a, group_b]), np.repeat([0, 1], [len(a), len(b)])
    at = np.empty(n, np.int64)
    # tokens of earlier groups and, for b, of the own group's a come before
    at[: len(a)] = np.arange(len(a)) + np.searchsorted(group_b, group_a)
    at[len(a) :] = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
    order = np.empty(n, np.int64)
    order[at] = np.arange(n)
    ids, group, side = ids[order], group[order], side[order]
    mark = np.zeros(n, np.int64)
    mark[:-1][side[:-1] != side[1:]] = 1
    ends = np.append(group[:-1] != group[1:], True)
    mark[ends] = 2
    mark[ends & np.isin(group, last)] = 3
    return names[mark, ids].tolist()


DOCS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, pairs array<long>, counts array<long>"


def aligned(docs: DataFrame, config: AlignConfig = AlignConfig(), groups: bool = False) -> DataFrame:
    """DOCS of every row of docs (doc_id, text): links, its links' id pairs (a << 32 | b) in order, compressed; and, once for each slice of text, its distinct pairs with their counts. No shuffle. groups: also a column groups, the text that groups_sha256 is of.

    Texts that are null or empty, or whose tokens' joined bytes are not a space and the text, have no tokens. Rows keep their doc_id, null or repeated; other columns are left out.
    """
    c = config

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_a, pieces_a = load_a(public_tokenizers.path(c.a))
        encode_b, pieces_b = load_b(public_tokenizers.path(c.b))
        sizes_a, sizes_b = (np.fromiter(map(len, p), np.int64, len(p)) for p in (pieces_a, pieces_b))
        # the decimal ids of both, with each mark
        most = max(len(pieces_a), len(pieces_b))
        names = np.array([[b"%d%s" % (i, m) for i in range(most)] for m in (b",", b"|", b";", b"")], object)
        for part in (x for b in batches for x in batch_slices(b, 1, c.slice_bytes)):
            texts = raw(part.column(1))
            a: list[int] = []
            b: list[int] = []
            n_a, n_b, good = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), []
            strings = [t.decode() for t in texts]
            for i, (t, s, own_b) in enumerate(zip(texts, strings, encode_b(strings), strict=True)):
                if not t:
                    continue
                own_a, whole = encode_a(" " + s), b" " + t
                if b"".join([pieces_b[x] for x in own_b]) == whole and b"".join([pieces_a[x] for x in own_a]) == whole:
                    a += own_a
                    b += own_b
                    n_a[i], n_b[i] = len(own_a), len(own_b)
                    good.append(i)
            ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
            cuts, group_a, group_b, link_a, link_b = align(ids_a, ids_b, sizes_a, sizes_b)
            # a document ends where both do, so its groups and links stand in a row
            ends = np.cumsum([len(texts[i]) + 1 for i in good])
            last = np.searchsorted(cuts, ends)
            n_groups, n_links = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            n_groups[good] = np.diff(last + 1, prepend=0)
            link_group = group_a[link_a]
            link_ends = np.searchsorted(link_group, last, "right")
            n_links[good] = np.diff(link_ends, prepend=0)
            codes = ids_a[link_a] << 32 | ids_b[link_b]
            pairs, counts = np.unique(codes, return_counts=True)
            shown = _shown(ids_a, ids_b, group_a, group_b, names, last)
            sha, links, texts_of, at, at_link = [""] * len(texts), [b""] * len(texts), [""] * len(texts), 0, 0
            for i in good:
                own = b"".join(shown[at : at + n_a[i] + n_b[i]])
                at += int(n_a[i] + n_b[i])
                sha[i] = hashlib.sha256(own).hexdigest()
                texts_of[i] = own.decode() if groups else ""
                cell = codes[at_link : at_link + n_links[i]]
                links[i] = squeeze(cell)
                at_link += int(n_links[i])
            first = [0] if part.num_rows else []
            lists = lambda x, first=first, n=part.num_rows: pa.array([x if i in first else None for i in range(n)], pa.list_(pa.int64()))
            out = [part.column(0), *[pa.array(x) for x in (n_a, n_b, n_groups, n_links)], pa.array(sha), pa.array(links, pa.binary()), lists(pairs), lists(counts)]
            yield pa.RecordBatch.from_arrays(out + [pa.array(texts_of)] * groups, names=[x.split()[0] for x in DOCS.split(", ")] + ["groups"] * groups)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, DOCS + ", groups string" * groups)


def pair_counts(aligned_docs: DataFrame, config: AlignConfig = AlignConfig()) -> DataFrame:
    """pair, n, best: links of each id pair over all documents, and whether no other pair of its b id has more.

    Each task sends a pair once; in the first stage the counts of a pair meet in config.salt shares of the tasks, in the second these.
    """
    each = aligned_docs.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "counts")).alias("x"), F.pmod(F.spark_partition_id(), F.lit(config.salt)).alias("salt"))
    salted = each.groupBy(F.col("x.pairs").alias("pair"), "salt").agg(F.sum("x.counts").alias("n"))
    total = salted.groupBy("pair").agg(F.sum("n").alias("n"))
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    return total.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(b)))


def most_pairs(config: AlignConfig = AlignConfig()) -> int:
    """How many id pairs can end together, whatever the corpus: of two tokens that end at the same offset, one's bytes are an end of the other's. So each token has at most as many partners that are no longer as it has ends, times the tokens that share those bytes."""
    pieces = [load_a(public_tokenizers.path(config.a))[1], load_b(public_tokenizers.path(config.b))[1]]
    n = 0
    for own, other in (pieces, pieces[::-1]):
        same: dict[bytes, int] = {}
        for x in other:
            same[x] = same.get(x, 0) + 1
        n += sum(same.get(x[i:], 0) for x in own for i in range(len(x) + 1))
    return n


def alignment(docs: DataFrame, config: AlignConfig = AlignConfig()) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs (doc_id, text).

    n_best: links whose pair has the highest count of its b id in all of docs, ties included; count_sum: the counts of all links' pairs. Nulls, empties and repeated rows as aligned() says; a row that is there twice counts twice. An empty table gives an empty one.
    Texts are tokenized once. The table of pair counts travels to the tasks: its size is bounded by the two vocabularies (most_pairs(), about a million for those of config), never by the corpus, and is checked against that bound.
    """
    held = stash(aligned(docs, config), "aligned")
    rows = stash(pair_counts(held, config), "pairs")
    most = most_pairs(config)
    found = rows.orderBy("pair").limit(most + 1).toArrow()
    if found.num_rows > most:
        raise ValueError("more id pairs than two vocabularies can have")
    sent = docs.sparkSession.sparkContext.broadcast(tuple(found.column(x).to_numpy() for x in ("pair", "n", "best")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = sent.value
        for b in batches:
            sums, bests = [], []
            for cell in b.column(b.schema.names.index("links")).to_pylist():
                at = np.searchsorted(pair, unsqueeze(cell, np.int64)) if cell else np.zeros(0, np.int64)
                sums.append(int(n[at].sum()))
                bests.append(int(best[at].sum()))
            kept = [b.column(b.schema.names.index(x)) for x in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), b.column(b.schema.names.index("groups_sha256"))], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return held.drop("pairs", "counts").mapInArrow(count, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment digests of every document under the two given tokenizers."""
    return alignment(table(spark, sf_dir, "documents").select("doc_id", "text"))
