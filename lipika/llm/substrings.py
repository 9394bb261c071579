"""Substring dedup by recompression: equal substrings get equal interior symbols, and shared symbols lead to repeated windows.

Each document is parsed in rounds. In a round every symbol falls in a left or right class by a hash of its name, and each left symbol that a right one follows is named together with it; maximal runs of a token are named too. A name is a hash of what it stands for, so equal content has equal names in all documents without a shuffle, and each symbol knows its context: the words that decide that it forms. Two equal windows thus hold the same symbols among those whose context lies within them.

A window is represented by one of these, the highest level first, then the largest name. One exchange finds the names that two documents or more share; only windows represented by such names are compared, by a 96-bit hash of all their words, in a second exchange.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import NULL_ID, PACKED, blocks, exchange, hashes, ints, mix, pack_keys, parts_of, read_replies, replies, rows_of, runs, squeeze, stash, stash_buckets, table, unsqueeze

TOKEN = re.compile(rb"[^ \t\n\v\f\r]+[ \t\n\v\f\r]*")


class Block:
    """Words of a block of documents: hash, document, first word of the document and the one after its last."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, text: bytes):
        self.ids, self.sizes = ids, sizes
        self.words = text.split()
        self.hash = hashes(self.words)
        ends = np.cumsum(self.sizes, dtype=np.int32)
        self.doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.sizes)
        self.first, self.end = np.repeat(ends - self.sizes.astype(np.int32), self.sizes), np.repeat(ends, self.sizes)

    def starts(self, window: int) -> np.ndarray:
        return np.nonzero(np.arange(window, len(self.hash) + window, dtype=np.int32) <= self.end)[0]


def representatives(b: Block, window: int, rounds: int) -> np.ndarray:
    """The name that represents each window of b.starts(); names hold their level in the top bits."""
    n = len(b.hash)
    starts = b.starts(window)
    best = np.zeros(n, np.uint64)

    def represent(level: int, name: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Offers symbols with contexts low .. high to the windows that hold these."""
        fits = (high - low <= window) & (low >= 0)
        key, low, high = (np.uint64(level) << np.uint64(61)) | (name[fits] >> np.uint64(3)), low[fits], high[fits]
        # the windows from the first that holds the context's end to the one that starts with the context
        first = np.maximum(high - window, b.first[np.minimum(low, n - 1)])
        many = low - first + 1
        for s in range(int(many.max(initial=0))):
            ok = many > s
            np.maximum.at(best, first[ok] + s, key[ok])

    # maximal runs of a token; their context holds the tokens on both sides
    same = np.zeros(n + 1, bool)
    if n:
        same[1:-1] = (b.hash[1:] == b.hash[:-1]) & (b.doc[1:] == b.doc[:-1])
    a = np.nonzero(~same[:-1] & same[1:])[0]
    z = np.nonzero(same[:-1] & ~same[1:])[0] + 1
    inner = (a > b.first[a]) & (z < b.end[np.maximum(z - 1, 0)]) if len(a) else np.zeros(0, bool)
    represent(1, mix(b.hash[a] * np.uint64(0x9E3779B97F4A7C15) + (z - a).astype(np.uint64))[inner], a[inner] - 1, z[inner] + 1)

    start = np.arange(n, dtype=np.int32)
    name, low, high = b.hash, start, start + np.int32(1)
    never_low, never_high = np.int32(-n - window), np.int32(2 * n + window)
    for level in range(1, rounds + 1):
        if len(name) < 2:
            break
        left = (mix(name ^ np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & np.uint64(1)).astype(bool)
        joint = b.doc[start[1:]] == b.doc[start[:-1]]
        pair = np.nonzero(joint & left[:-1] & ~left[1:])[0]
        # a symbol stays single because of the neighbour that might have been its partner; at a document's edge that is nothing a window can hold
        new_low, new_high = low.copy(), high.copy()
        new_high[left], new_low[~left] = never_high, never_low
        lefts = np.nonzero(left[:-1] & joint)[0]
        new_low[lefts], new_high[lefts] = np.minimum(low[lefts], low[lefts + 1]), np.maximum(high[lefts], high[lefts + 1])
        rights = np.nonzero(~left[1:] & joint)[0] + 1
        new_low[rights], new_high[rights] = np.minimum(low[rights], low[rights - 1]), np.maximum(high[rights], high[rights - 1])
        new_name = name.copy()
        new_name[pair] = mix(name[pair] * np.uint64(0xD6E8FEB86659FD93) + mix(name[pair + 1] + np.uint64(level)))
        new_low[pair], new_high[pair] = np.minimum(low[pair], low[pair + 1]), np.maximum(high[pair], high[pair + 1])
        represent(level, new_name[pair], new_low[pair], new_high[pair])
        keep = np.ones(len(name), bool)
        keep[pair + 1] = False
        name, start, low, high = new_name[keep], start[keep], new_low[keep], new_high[keep]
    # windows without a symbol: the largest token
    bare = starts[best[starts] == 0]
    for s in range(window):
        best[bare] = np.maximum(best[bare], b.hash[bare + s] >> np.uint64(3))
    return best[starts]


def window_hash(h: np.ndarray, starts: np.ndarray, window: int, factor: int) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    for s in range(window):
        out = out * np.uint64(factor) + mix(h[starts + s] + np.uint64(factor))
    return mix(out)


INDEX = ("names", "twice", "places", "lengths")


def _indexed(window: int, rounds: int):
    """For a block: its sorted names (mixed, to spread evenly), which of them two of its documents hold, and the windows' names as runs: place among the names, and length."""

    def more(ids: np.ndarray, sizes: np.ndarray, text: bytes) -> list[bytes]:
        b = Block(ids, sizes, text)
        doc = b.doc[b.starts(window)]
        best = representatives(b, window, rounds)
        first = runs(best, doc)
        names, place = np.unique(mix(best[first]), return_inverse=True)
        low, high = np.full(len(names), len(ids), np.int32), np.full(len(names), -1, np.int32)
        np.minimum.at(low, place, doc[first])
        np.maximum.at(high, place, doc[first])
        return [squeeze(np.diff(names, prepend=np.uint64(0))), squeeze((low != high).astype(np.uint8)), squeeze(place.astype(np.uint32)), squeeze(np.diff(np.append(first, len(best))).astype(np.uint32))]

    return more


def _open(r: dict, window: int) -> tuple[Block, np.ndarray]:
    """A block and the starts of its windows with a shared name."""
    b = Block(ints(r["ids"]), ints(r["sizes"]), r["text"])
    yes = read_replies(r["shared"], np.uint8)
    starts = b.starts(window)
    return b, starts[np.repeat(yes[unsqueeze(r["places"], np.uint32)] > 0, unsqueeze(r["lengths"], np.uint32))] if len(starts) else starts


def _compared(b: Block, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes (64 and 32 bits) of the windows, the least document id of each, and each window's place among them."""
    key = window_hash(b.hash, starts, window, 0x9E3779B97F4A7C15)
    check = (window_hash(b.hash, starts, window, 0xC2B2AE3D27D4EB4F) >> np.uint64(32)).astype(np.uint32)
    doc = b.ids[b.doc[starts]]
    order = np.lexsort((doc, check, key))
    first = runs(key[order], check[order])
    place = np.empty(len(order), np.int64)
    place[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    lead = order[first]
    return key[lead], check[lead], doc[lead], place


def _shared(keys: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """1 for each name that comes from two blocks, or from two documents of one."""
    order = np.argsort(keys, kind="stable")
    first = runs(keys[order])
    n = np.diff(np.append(first, len(keys)))
    yes = (n > 1) | (np.maximum.reduceat(twice[order], first) > 0)
    out = np.empty(len(keys), np.uint8)
    out[order] = np.repeat(yes, n)
    return out


def _earlier(keys: np.ndarray, check: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """1 for each window that another block has in a document with a smaller id."""
    order = np.lexsort((doc, check, keys))
    first = runs(keys[order], check[order])
    least = np.repeat(doc[order][first], np.diff(np.append(first, len(keys))))
    out = np.empty(len(keys), np.uint8)
    out[order] = least < doc[order]
    return out


def dedup_substrings(docs: DataFrame, window: int = 13, rounds: int = 4, emit: str = "digest", names: tuple[str, str] = ("n_words", "n_removed"), block_bytes: int = 4 << 20) -> DataFrame:
    """Removes each word covered by a window of so many words that also starts in a document with a smaller doc_id.

    emit "digest": doc_id, n_words, n_removed, kept_sha256 (kept words joined by a space). emit "text": all columns of docs (but those that names replaces) and, by names, words and removed words, with text without the removed words; the text of a document that loses none stays byte for byte.
    Null text has no words. Rows with the same doc_id never count as smaller than each other; null doc_ids count as larger than all others.
    Texts are read thrice from blocks in the shared folder; what is shuffled are names and window hashes, once per block, and a flag for each back.
    """
    docs = docs.drop(*names)
    rest = [f.name for f in docs.schema.fields if f.name not in ("doc_id", "text")] if emit == "text" else []
    held = stash_buckets(blocks(docs.select("doc_id", "text", *rest), block_bytes, _indexed(window, rounds), INDEX), "block", "blocks")
    parts, columns = parts_of(held.count()), docs.columns

    def name_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in rows_of(batch):
                yield pack_keys(r["block"], np.cumsum(unsqueeze(r["names"], np.uint64), dtype=np.uint64), [unsqueeze(r["twice"], np.uint8)])

    shared = stash(replies(exchange(held.select("block", "names", "twice").mapInArrow(name_rows, PACKED), _shared, [np.uint8], np.uint8, parts), "shared"), "shared")

    def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in rows_of(batch):
                b, starts = _open(r, window)
                key, check, doc, _ = _compared(b, starts, window)
                yield pack_keys(r["block"], key, [check, doc])

    opened = held.select("block", "ids", "sizes", "text", "places", "lengths", *(["lens", "rest"] if emit == "text" else [])).join(shared, "block", "left")
    earlier = stash(replies(exchange(opened.drop("lens", "rest").mapInArrow(window_rows, PACKED), _earlier, [np.uint32, np.int64], np.uint8, parts), "earlier"), "earlier")

    def removed(r: dict) -> tuple[Block, np.ndarray]:
        b, starts = _open(r, window)
        gone = np.zeros(len(b.words) + 1, np.int64)
        if len(starts):
            _, _, doc, place = _compared(b, starts, window)
            covered = starts[(read_replies(r["earlier"], np.uint8)[place] > 0) | (doc[place] < b.ids[b.doc[starts]])]
            np.add.at(gone, covered, 1)
            np.add.at(gone, covered + window, -1)
        return b, np.cumsum(gone)[:-1] > 0

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in rows_of(batch):
                b, gone = removed(r)
                ends, shas, lost = np.cumsum(b.sizes).tolist(), [], []
                for e, n in zip(ends, b.sizes.tolist(), strict=True):
                    own = gone[e - n : e]
                    words = b.words[e - n : e]
                    lost.append(int(own.sum()))
                    shas.append(hashlib.sha256(b" ".join([w for w, g in zip(words, own.tolist(), strict=True) if not g] if lost[-1] else words)).hexdigest())
                ids = pa.array(b.ids, pa.int64(), mask=b.ids == NULL_ID)
                yield pa.RecordBatch.from_arrays([ids, pa.array(b.sizes), pa.array(lost, pa.int64()), pa.array(shas)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = batch.column(batch.schema.names.index("rest"))
            for k, r in enumerate(rows_of(batch.drop_columns("rest"))):
                b, gone = removed(r)
                at, text_at, out, lost = 0, 0, [], []
                other = others[k].values
                for n, size, null in zip(b.sizes.tolist(), ints(r["lens"]).tolist(), other.field("_lipika_null").to_pylist(), strict=True):
                    own, text = gone[at : at + n], r["text"][text_at : text_at + size]
                    at, text_at = at + n, text_at + size + 1
                    lost.append(int(own.sum()))
                    if lost[-1]:
                        text = b"".join([w for w, g in zip(TOKEN.findall(text), own.tolist(), strict=True) if not g])
                    out.append(None if null else text.decode())
                ids = pa.array(b.ids, pa.int64(), mask=b.ids == NULL_ID)
                by_name = {"doc_id": ids, "text": pa.array(out, pa.string()), **{c: other.field(c) for c in rest}}
                yield pa.RecordBatch.from_arrays([*[by_name[c] for c in columns], pa.array(b.sizes), pa.array(lost, pa.int64())], names=[*columns, *names])

    last = opened.join(earlier, "block", "left")
    if emit == "digest":
        return last.mapInArrow(digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    fields = [T.StructField("doc_id", T.LongType()) if f.name == "doc_id" else f for f in docs.schema.fields]
    return last.mapInArrow(texts, T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in names]]))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeat, 13 or more in a row, from documents with smaller ids."""
    return dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
