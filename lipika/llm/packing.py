"""Packing of tokenised documents into fixed-length sequences by harmonic classes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import raw, table

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padding long"


@dataclass(frozen=True)
class PackConfig:
    """A remainder is cut once more, at its class's lower end, while the space its class leaves in a sequence exceeds slack, at most cuts times."""

    tokenizer: str = "byte_bpe_50k.json"
    capacity: int = 1024
    end_id: int = 0
    slack: float = 1 / 64
    cuts: int = 3


_encoders: dict = {}


def load_encoder(path: str):
    """encode(text) -> ids, as the tokenizers library gives them for a byte-level BPE file with add_special_tokens=False: special tokens that a text spells out are single ids.

    The file's vocabulary and merges are read into the faster tiktoken encoder, where ids are merge ranks; texts that spell out a special token, and all texts if a file is not of that kind or a probe differs, are encoded by the tokenizers library itself. Kept per process.
    """
    if path in _encoders:
        return _encoders[path]
    import json
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import tiktoken
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    out = slow = lambda text: plain.encode(text, add_special_tokens=False).ids
    spec = json.load(open(path, encoding="utf-8"))
    # byte-level alphabets write printable bytes as themselves and the others, in order, from U+0100 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(printable))}
    special = {x["content"] for x in spec.get("added_tokens", [])}
    vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in special}
    try:
        ranks = {bytes(byte_of[c] for c in k): v for k, v in vocab.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        in_order = [vocab["".join(m)] for m in merges]
        if in_order == sorted(in_order) and not spec["model"].get("ignore_merges") and (spec.get("normalizer") is None):
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            probe = "It's  a test: naïve façade, 12345 №№ धर्म \n\n\t x=y;####  end "
            if fast(probe) == slow(probe):
                out = lambda text: slow(text) if any(x in text for x in special) else fast(text)
    except KeyError:
        pass
    _encoders[path] = out
    return out


def cut(n: int, c: PackConfig) -> list[tuple[int, int]]:
    """(length, class) of the pieces of n tokens: full sequences (class 1), then the rest; a piece of class k is at most capacity / k long, more than capacity / (k + 1)."""
    pieces = [(c.capacity, 1)] * (n // c.capacity)
    rest = n % c.capacity
    for _ in range(c.cuts):
        if not rest:
            break
        k = c.capacity // rest
        if 1 - k * rest / c.capacity <= c.slack or c.capacity // (k + 1) == 0:
            break
        pieces.append((c.capacity // (k + 1), k + 1))
        rest -= c.capacity // (k + 1)
    if rest:
        pieces.append((rest, c.capacity // rest))
    return pieces


def pack(docs: DataFrame, path: str, config: PackConfig = PackConfig()) -> DataFrame:
    """A row a piece: its document's tokens start .. start+length, put at offset of sequence_id; padding: of that sequence.

    Each partition fills its own sequences, k pieces of class k to a sequence, and numbers them by the partition, so nothing is shuffled and a task that is run again gives the same rows. What is left of the classes at a partition's end, fewer than k pieces each, shares sequences first-fit by falling length. Memory is one open sequence a class.
    Null text is empty and gets the end id alone. Documents keep their rows: repeated doc_ids are packed each for itself, a null doc_id stays null; other columns are left out. A very long text is many full sequences and one remainder.
    A sequence is padded to capacity, except one whose content is a power of two, which stays as long as it is.
    """
    c = config

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = load_encoder(path)
        base, used = TaskContext.get().partitionId() << 40, 0
        open_: dict[int, list[tuple]] = {}
        out: list[tuple] = []

        def padding(length: int) -> int:
            return 0 if length & (length - 1) == 0 else c.capacity - length

        def close(pieces: list[tuple]) -> None:
            nonlocal used
            pad, at = padding(sum(p[2] for p in pieces)), 0
            for p in pieces:
                out.append((*p, base + used, at, pad))
                at += p[2]
            used += 1

        def batch() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])
            out.clear()
            return got

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), raw(b.column(1)), strict=True):
                ids = np.array([*encode(text.decode()), c.end_id], "<u4")
                start = 0
                for length, k in cut(len(ids), c):
                    group = open_.setdefault(k, [])
                    group.append((i, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids)))
                    start += length
                    if len(group) == k:
                        close(open_.pop(k))
            if out:
                yield batch()
        left = sorted((p for g in open_.values() for p in g), key=lambda p: -p[2])
        bins: list[tuple[int, list[tuple]]] = []
        for p in left:
            at = next((i for i, (free, _) in enumerate(bins) if free >= p[2]), None)
            if at is None:
                bins.append((c.capacity - p[2], [p]))
            else:
                bins[at] = (bins[at][0] - p[2], [*bins[at][1], p])
        for _, pieces in bins:
            close(pieces)
        if out:
            yield batch()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenised and packed into sequences of at most 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
