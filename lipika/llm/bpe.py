"""Byte-level BPE: higher-order functions fold ranked merges over the byte arrays of distinct words; decoding concatenates pieces.

Documents travel in chunks, one row each: the chunk's distinct words and each document as places among them. The distinct words of all chunks meet once, in Spark's own aggregation, and are folded once each, by native expressions; the ids go back to the chunks that asked, and the documents are put together from these. No dictionary has to fit anywhere but a chunk's own.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stash, stash_buckets, table

#: The fold's word is an array of longs, one a token: the rank of its pair with the next one (NONE: no pair), where it starts, its id. So all differ, and the least is the pair to merge next, the leftmost of equals. EDGE is the id of an entry that stands at either end.
RANK, START, NONE, EDGE = 34, 18, 1 << 20, (1 << 18) - 1
#: Words of more bytes are merged by a heap: each fold step copies the word's array, so a fold's cost is quadratic.
FOLD_BYTES = 512
#: Shares of the distinct words whose ids go back one after the other.
SHARES = 6
#: Places that are put together at once.
PLACES = 1 << 19


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with x evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _numbers(x: list[int] | np.ndarray, kind: str) -> Column:
    """A literal array: the optimizer folds the split and the cast."""
    return F.split(F.lit(",".join(map(str, x))), ",").cast(f"array<{kind}>")


def _nested(x: list[list[int]], kind: str) -> Column:
    """A literal array of arrays."""
    return F.from_json(F.lit(json.dumps(x, separators=(",", ":"))), f"array<array<{kind}>>")


def rank_table(ranks: dict[bytes, int]) -> Column:
    """The literal rank map. Keys are pairs of token ids whose bytes together are a token; the value is its rank, which is its id.

    Spark looks a key up in a map by reading it from the start, so the map is cut in buckets by the key's remainder, a few keys each. Pairs of bytes, with which every word starts, have a table of their own.
    """
    size = max(ranks.values()) + 1
    if size >= EDGE:  # and with that less than NONE
        raise ValueError("too many tokens")
    pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    n = max(1, len(pairs))
    keys: list[list[int]] = [[] for _ in range(n)]
    values: list[list[int]] = [[] for _ in range(n)]
    for x, y, r in pairs:
        key = (x << START) + y
        keys[key % n].append(key)
        values[key % n].append(r)
    single = [ranks[bytes([x])] for x in range(256)]
    double = [ranks.get(bytes([x, y]), NONE) for x in range(256) for y in range(256)]
    return F.struct(
        F.lit(n).cast("bigint").alias("buckets"),
        _nested(keys, "bigint").alias("keys"),
        _nested(values, "int").alias("values"),
        _numbers(single, "int").alias("single"),
        _numbers(double, "int").alias("double"),
    )


def _rank(t: Column, a: Column, b: Column) -> Column:
    """Rank of the token that a and b (longs) make; NONE if they make none."""
    key = F.shiftleft(a, START).bitwiseOR(b)
    bucket = (key % t["buckets"]).cast("int")
    return F.coalesce(F.get(F.get(t["values"], bucket), F.array_position(F.get(t["keys"], bucket), key).cast("int") - 1), F.lit(NONE))


def encode_word(bytes_: Column, t: Column) -> Column:
    """Token ids of one word (array of byte values): the fold merges the leftmost pair of least rank, once a step."""
    long = lambda x: F.lit(x).cast("bigint")
    id_of = lambda x: x.bitwiseAND(long((1 << START) - 1))
    entry = lambda rank, rest: F.shiftleft(rank.cast("bigint"), RANK).bitwiseOR(rest)

    def merge(acc: Column, x: Column) -> Column:
        m = F.shiftright(x, RANK)

        def put(p: Column) -> Column:
            before, second, after = F.get(acc, p - 2), F.get(acc, p), F.get(acc, p + 1)
            both = entry(_rank(t, m, id_of(after)), x.bitwiseAND(long(((1 << RANK) - 1) ^ ((1 << START) - 1))).bitwiseOR(m))
            left = entry(_rank(t, id_of(before), m), before.bitwiseAND(long((1 << RANK) - 1)))
            rest = F.array_remove(F.array_remove(F.array_remove(acc, x), second), before)
            return F.array_insert(F.array_insert(rest, p - 1, both), p - 1, left)

        return _let(F.array_position(acc, x).cast("int"), put)

    step = lambda acc, _: _let(F.array_min(acc), lambda x: F.when(x >= long(NONE << RANK), acc).otherwise(merge(acc, x)))
    rank = lambda b, i: F.coalesce(F.get(t["double"], b * 256 + F.get(bytes_, i + 1)), F.lit(NONE))
    begin = F.transform(bytes_, lambda b, i: entry(rank(b, i), F.shiftleft((i + 1).cast("bigint"), START).bitwiseOR(F.get(t["single"], b))))
    edge = lambda at: F.array(long((NONE << RANK) | (at << START) | EDGE))
    folded = F.aggregate(F.slice(bytes_, 2, F.size(bytes_)), F.concat(edge(0), begin, edge((1 << RANK - START) - 1)), step)
    return F.filter(F.transform(folded, lambda x: id_of(x).cast("int")), lambda x: x != EDGE)


def merge_by_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a long word, in time n log n."""
    import heapq

    n = len(word)
    part: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(ranks[p], i, 2) for i in range(n - 1) if (p := word[i : i + 2]) in ranks]
    heapq.heapify(heap)
    while heap:
        rank, i, size = heapq.heappop(heap)
        j = after[i]
        if part[i] is None or j < 0 or len(part[i]) + len(part[j]) != size:
            continue
        both = part[i] + part[j]
        if ranks.get(both, -1) != rank:
            continue
        part[i], part[j] = both, None
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
            p = both + part[after[i]]
            if p in ranks:
                heapq.heappush(heap, (ranks[p], i, len(p)))
        if before[i] >= 0:
            p = part[before[i]] + both
            if p in ranks:
                heapq.heappush(heap, (ranks[p], before[i], len(p)))
    return [ranks[p] for p in part if p is not None]


#: Letters that are \p{L} in all versions of Unicode, and marks that follow them: such strings are cut without the pattern, which says the same.
PLAIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+$"
MARKED = PLAIN[:-1] + "[.,;:!?]$"
#: White space beside a space, or at an end of the text.
ODD = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\pZ] | [\\s\\x0b\\x1c-\\x1f\\x{85}\\pZ]|^ | $"

CHUNK = "chunk long, ids array<long>, sizes binary, places binary, parts binary, pieces binary, words array<string>"


def cut_strings(strings: pa.Array, find: Callable[[str], list[str]], plain: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of distinct strings: how many words each has, their numbers, and the distinct words. A space that starts a string belongs to its first word."""
    import pyarrow.compute as pc

    n = len(strings)
    parts = np.zeros(n, np.int32)
    letters, marked = (pc.match_substring_regex(strings, x).to_numpy(zero_copy_only=False) if plain else np.zeros(n, bool) for x in (PLAIN.replace("^", "^ ?"), MARKED.replace("^", "^ ?")))
    rest = np.nonzero(~letters & ~marked)[0]
    found = [find(x) for x in strings.take(pa.array(rest)).to_pylist()]
    parts[letters], parts[marked], parts[rest] = 1, 2, [len(x) for x in found]
    start = np.cumsum(parts) - parts
    both = strings.filter(pa.array(marked))
    at = [start[letters], start[marked], start[marked] + 1, np.repeat(start[rest], parts[rest]) + _inner(parts[rest])]
    words = pa.chunked_array([strings.filter(pa.array(letters)), pc.utf8_slice_codeunits(both, 0, -1), pc.utf8_slice_codeunits(both, -1), pa.array([w for x in found for w in x], pa.string())]).combine_chunks().dictionary_encode()
    pieces = np.zeros(int(parts.sum()), np.int32)
    pieces[np.concatenate(at)] = words.indices.to_numpy()
    return parts, pieces, words.dictionary


def _inner(counts: np.ndarray) -> np.ndarray:
    """0 .. count - 1 for each count."""
    out = np.arange(int(counts.sum()), dtype=np.int32)
    out -= np.repeat((np.cumsum(counts) - counts).astype(np.int32), counts)
    return out


def _planes(x: np.ndarray) -> bytes:
    """int32 values, all first bytes, then all second bytes and so on: the upper ones are mostly zero, so they compress better."""
    return np.ascontiguousarray(x.astype("<i4", copy=False).view(np.uint8).reshape(-1, 4).T).tobytes()


def _of_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def chunks(docs: DataFrame, pattern: str, chunk_bytes: int) -> DataFrame:
    """Rows of documents of about chunk_bytes together: ids, strings of each document, and places of all strings among the distinct ones, whose words are pieces (parts of them each).

    A single space between two characters that are no white space starts a word with the pattern of these tokenizers and ends the one before, so a text is cut there first, and the pattern is applied to each distinct string once. A text with any other white space beside a space is cut by the pattern alone.
    """
    by_space = pattern == public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        import regex
        from pyspark import TaskContext

        find = regex.compile(pattern).findall
        base, k = TaskContext.get().partitionId() << 32, 0
        ids: list = []
        held: list[pa.Array] = []
        read = 0

        def flush() -> pa.RecordBatch:
            texts = pa.chunked_array(held, pa.string()).combine_chunks()
            odd = np.ones(len(texts), bool)
            if by_space:
                odd = pc.or_(pc.match_substring_regex(texts, ODD), pc.equal(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False)
            # strings of the plain texts but the first of each have a space before
            split = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
            n = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.zeros(int(n.sum()), bool)
            first[np.cumsum(n) - n] = True
            flat = split.flatten()
            later, begin = (flat.filter(pa.array(x)).dictionary_encode() for x in (~first, first))
            whole = [find(x) for x in texts.filter(pa.array(odd)).to_pylist()]
            alone = pa.array([w for x in whole for w in x], pa.string()).dictionary_encode()
            spaced = pc.binary_join_element_wise(pa.scalar(" "), later.dictionary, "")
            lists = [cut_strings(spaced, find, by_space), cut_strings(begin.dictionary, find, by_space)]
            words = pa.chunked_array([*[x[2] for x in lists], alone.dictionary]).combine_chunks().dictionary_encode()
            order = pc.sort_indices(words.dictionary)
            number = np.empty(len(order), np.int32)
            number[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
            number = number[words.indices.to_numpy()]
            after = np.cumsum([0, len(lists[0][2]), len(lists[1][2])])
            parts = np.concatenate([*[x[0] for x in lists], np.ones(len(alone.dictionary), np.int32)]).astype(np.int32)
            pieces = np.concatenate([number[after[0] + lists[0][1]], number[after[1] + lists[1][1]], number[after[2] :]]).astype(np.int32)
            # places in the order of the documents
            plain = np.zeros(int(n.sum()), np.int32)
            plain[~first] = later.indices.to_numpy()
            plain[first] = begin.indices.to_numpy() + len(spaced)
            other = alone.indices.to_numpy() + len(spaced) + len(begin.dictionary)
            sizes = np.zeros(len(texts), np.int32)
            sizes[~odd], sizes[odd] = n, [len(x) for x in whole]
            of_odd = np.repeat(odd, sizes)
            places = np.zeros(len(of_odd), np.int32)
            places[~of_odd], places[of_odd] = plain, other
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            return pa.RecordBatch.from_arrays([pa.array([base + k], pa.int64()), one(pa.array(ids, pa.int64())), *[pa.array([_planes(x)], pa.binary()) for x in (sizes, places, parts, pieces)], one(words.dictionary.take(order))], names=[x.split()[0] for x in CHUNK.split(", ")])

        for b in batches:
            ids += b.column(0).to_pylist()
            held.append(pc.fill_null(b.column(1), ""))
            read += held[-1].nbytes
            if read >= chunk_bytes or len(ids) >= chunk_bytes >> 4:
                yield flush()
                ids, held, read, k = [], [], 0, k + 1
                pa.default_memory_pool().release_unused()
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, CHUNK)


def _byte_arrays(words: DataFrame, pieces: list[bytes], fold_bytes: int) -> DataFrame:
    """word, bytes (its byte values; empty for a word of over fold_bytes), long_ids (the ids of such a word, else null)."""
    sent = words.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks: dict[bytes, int] = {}
        for b in batches:
            cells = b.column(0).cast(pa.binary())
            sizes = np.diff(np.frombuffer(cells.buffers()[1], np.int32, len(cells) + 1, 4 * cells.offset))
            big = np.nonzero(sizes > fold_bytes)[0]
            ranks = ranks or ({w: i for i, w in enumerate(sent.value) if w} if len(big) else {})
            ids: list = [None] * len(cells)
            for i in big:
                ids[i] = merge_by_heap(cells[i].as_py(), ranks)
            values = np.frombuffer(b"".join(x if len(x) <= fold_bytes else b"" for x in cells.to_pylist()), np.uint8).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(np.where(sizes > fold_bytes, 0, sizes))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)), pa.array(ids, pa.list_(pa.int32()))], names=["word", "bytes", "long_ids"])

    return words.mapInArrow(run, "word string, bytes array<int>, long_ids array<int>")


def encode_words(words: DataFrame, path: str, fold_bytes: int = FOLD_BYTES) -> DataFrame:
    """word, ids of each distinct word (string), folded once each."""
    ranks = load_ranks(path)
    t = rank_table(ranks)
    pieces = pieces_of(ranks)
    ids = F.coalesce("long_ids", _let(t, lambda t: encode_word(F.col("bytes"), t)))
    return _byte_arrays(words.select("word").distinct(), pieces, fold_bytes).select("word", ids.alias("ids"))


def _joined(strings: pa.Array, ends: np.ndarray) -> pa.Array:
    """Binary strings, those between two ends concatenated: the same bytes with fewer offsets."""
    at = np.frombuffer(strings.buffers()[1], np.int32)[: len(strings) + 1] if len(strings) else np.zeros(1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(at[ends].astype(np.int32)), strings.buffers()[2]])


def pieces_of(ranks: dict[bytes, int]) -> list[bytes]:
    """Bytes of each id; empty where there is no such id."""
    out = [b""] * (max(ranks.values()) + 1)
    for w, i in ranks.items():
        out[i] = w
    return out


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, chunk_bytes: int = 12 << 20, emit: str = "digest", fold_bytes: int = FOLD_BYTES) -> DataFrame:
    """Encodes each document's whole text, then decodes the ids by concatenating their pieces.

    emit "ids": doc_id, ids array<int>, decoded binary. emit "digest": doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256.
    Null text is empty and has no tokens; a null doc_id stays null, repeated doc_ids keep a row each, other columns are left out. A very long text is a chunk of its own. A word's tokens depend on it alone, so chunks don't change results.
    """
    held = stash_buckets(chunks(docs, pattern, chunk_bytes), "chunk", "chunks")
    asked = held.select("chunk", F.posexplode("words").alias("n", "word"))
    folded = stash(encode_words(asked, path, fold_bytes), "words")
    # the ids of a chunk's distinct words, a share of the words after the other: the shuffles of all at once would take more disk than the texts
    share = F.pmod(F.xxhash64("word", F.lit(1)), F.lit(SHARES))
    # in the chunks' own buckets, so that putting documents together moves nothing
    def answered(i: int) -> DataFrame:
        """chunk, and of a share of its words: numbers, how many ids each has, and the ids, flat (a third of the bytes of pairs)."""
        met = asked.where(share == i).join(folded.where(share == i), "word").groupBy("chunk").agg(F.collect_list(F.struct("n", "ids")).alias("a"))
        return met.select("chunk", F.col("a.n").alias(f"n{i}"), F.transform("a.ids", F.size).alias(f"counts{i}"), F.flatten("a.ids").alias(f"ids{i}"))

    answers = [stash_buckets(answered(i), "chunk", "answers") for i in range(SHARES)]
    discard(folded)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if emit == "digest" else "doc_id long, ids array<int>, decoded binary"
    names = [x.split()[0] for x in schema.split(", ")]
    sent = docs.sparkSession.sparkContext.broadcast(pieces_of(load_ranks(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(sent.value, pa.binary())
        decimals = pa.array([f"{i},".encode() for i in range(len(pieces))], pa.binary())
        for b in batches:
            for r in range(b.num_rows):
                cell = lambda c, b=b, r=r: b.column(b.schema.names.index(c))[r]
                sizes, places, parts, own = (_of_planes(cell(c).as_py()) for c in ("sizes", "places", "parts", "pieces"))
                # the ids of all words in the order of their numbers, as one array with ends
                number, counts, flat = (np.concatenate([np.zeros(0, np.int32), *[x.to_numpy() for x in (cell(f"{c}{i}").values for i in range(SHARES)) if x is not None]]) for c in ("n", "counts", "ids"))
                order = np.argsort(number)
                word_ends = np.concatenate([[0], np.cumsum(counts[order])])
                ids = pa.array(flat[np.repeat((np.cumsum(counts) - counts)[order], counts[order]) + _inner(counts[order])])
                by_word = pa.ListArray.from_arrays(pa.array(word_ends, pa.int32()), ids)
                per_word = [_joined(of_id.take(ids), word_ends) for of_id in (pieces, decimals)[: 2 if emit == "digest" else 1]]
                begin, doc_ids, after = np.cumsum(parts) - parts, cell("ids").values, np.concatenate([[0], np.cumsum(sizes)])
                # some documents after the other: every string's words, then every document's
                first = 0
                while first < len(doc_ids):
                    last = max(first + 1, int(np.searchsorted(after, after[first] + PLACES, "right")) - 1)
                    part = places[after[first] : after[last]]
                    words = own[np.repeat(begin[part], parts[part]) + _inner(parts[part])]
                    ends = np.concatenate([[0], np.cumsum(parts[part])])[after[first : last + 1] - after[first]]
                    lens = np.concatenate([[0], np.cumsum(np.diff(word_ends)[words])])[ends]
                    cells = []
                    for x in per_word:
                        whole = _joined(x.take(pa.array(words)), ends)
                        cells.append((memoryview(whole.buffers()[2] or b""), np.frombuffer(whole.buffers()[1], np.int32).tolist()))
                    data, at = cells[0]
                    if emit == "digest":
                        shown, to = cells[1]
                        digests = [hashlib.sha256(shown[x : max(x, y - 1)]).hexdigest() for x, y in zip(to, to[1:], strict=False)]
                        columns = [pa.array(np.diff(lens), pa.int64()), pa.array(digests), pa.array([hashlib.sha256(data[x:y]).hexdigest() for x, y in zip(at, at[1:], strict=False)])]
                    else:
                        columns = [pa.ListArray.from_arrays(pa.array(lens, pa.int32()), by_word.take(pa.array(words)).flatten()), pa.array([bytes(data[x:y]) for x, y in zip(at, at[1:], strict=False)], pa.binary())]
                    yield pa.RecordBatch.from_arrays([doc_ids.slice(first, last - first), *columns], names=names)
                    first = last

    # the chunks' texts join last: each join copies its rows
    rows = held.select("chunk")
    for x in answers:
        rows = rows.join(x, "chunk", "left")
    return rows.join(held.drop("words"), "chunk").mapInArrow(run, schema)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document and the round trip back."""
    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
