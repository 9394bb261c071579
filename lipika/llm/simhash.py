"""SimHash near-duplicates: byte-position inverted index with count filtering, and connected components of the links."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PACKED, batch_slices, discard, gathered, mix, pack_keys, parts_of, raw, runs, scratch, shuffles_end, stash, table, unpack_keys, unsqueeze

BYTES = 8


def shingles(text: bytes, words_per_shingle: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the lower-cased shingles in order, in arrays of bounded size; a shorter text is one shingle, no words are none."""
    import xxhash

    words = text.lower().split()
    line = b" ".join(words)
    n = len(words) - words_per_shingle + 1
    if n <= 1:
        if words:
            yield np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
        return
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.concatenate([[0], np.cumsum(sizes)])
    digest = xxhash.xxh64_intdigest
    for a in range(0, n, 65536):
        b = min(n, a + 65536)
        ends = (starts[a + words_per_shingle : b + words_per_shingle] - 1).tolist()
        yield np.array([digest(line[x:y], 42) for x, y in zip(starts[a:b].tolist(), ends, strict=True)], np.uint64)


def fingerprint(hashed: Iterable[np.ndarray]) -> int:
    """Bit i is set if it is set in over half the shingles' hashes (arrays of them), repeats included; no words: 0."""
    ones, done = np.zeros(64, np.int64), 0
    for h in hashed:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        done += len(h)
    return int.from_bytes(np.packbits(2 * ones > done, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words_per_shingle: int = 3, name: str = "fp") -> DataFrame:
    """docs with a 64-bit fingerprint as a signed long; all columns stay. One pass over whole texts; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in batch_slices(batch, batch.schema.names.index("text"))):
            fps = np.array([fingerprint(shingles(t, words_per_shingle)) for t in raw(b.column(b.schema.names.index("text")))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps, pa.int64())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


#: A posting list with more fingerprints is cut in lists of two more positions.
LONG_LIST = 256


def _masks(sets: list[tuple[int, ...]]) -> list[int]:
    """Signed masks of sets of byte positions."""
    masks = [sum(0xFF << (8 * p) for p in s) for s in sets]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


#: Of the four pairs of positions, those two that a list is for: each with its positions, and the ways to take two of its free positions more.
_LISTS = [tuple(p for h in pair for p in (2 * h, 2 * h + 1)) for pair in combinations(range(BYTES // 2), 2)]
_FINER = [list(combinations([p for p in range(BYTES) if p not in own], 2)) for own in _LISTS]


def _postings(fps: DataFrame) -> DataFrame:
    """The index: at, key, fp: each fingerprint under the bytes at every two of the four pairs of positions; long lists are cut further.

    Fingerprints within 2 differing bits share 6 byte positions at least (the guaranteed minimum), and the others touch two pairs at most, so two pairs are shared whole: a pair of fingerprints that reaches the minimum meets in one of these 6 lists. Lists of single bytes hold 1/256 of all rows each. Of the four free bytes of a list, two are shared as well: a list of over LONG_LIST fingerprints is replaced by the 6 lists of two free positions more, each of which 65,536 fingerprints fit in at most, whatever the input.
    """
    at = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in _masks(_LISTS)])).alias("at", "key")
    listed = stash(fps.select("fp", at), "postings")
    long = stash(listed.groupBy("at", "key").count().where(F.col("count") > LONG_LIST).select("at", "key", F.lit(True).alias("long")), "long")
    finer = F.array(*[F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in _masks([own + two for two in _FINER[i]])]) for i, own in enumerate(_LISTS)])
    some = listed.join(long, ["at", "key"], "left")
    short = some.where("long is null").select(F.col("at").cast("long").alias("at"), "key", "fp")
    cut = some.where("long").select("at", "fp", F.posexplode(F.get(finer, F.col("at"))).alias("i", "key"))
    return short.unionByName(cut.select((F.lit(len(_LISTS)) + F.col("at") * 6 + F.col("i")).cast("long").alias("at"), "key", "fp"))


def near_edges(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (a, b), a < b, that connect all distinct fingerprints at max_bits (1 or 2) or fewer differing bits as the full set of pairs would.

    Within a posting list, the shared positional bytes of each pair are tallied, pairs with BYTES - max_bits of them or more stay, and their differing bits decide. A list of the second kind has two free bytes: there a pair that is near differs in a mask of those 16 bits, so members are looked up by mask instead of pair by pair. A list gives a link for each member that is not its component's first, so links grow with members, never with pairs.
    """
    if not 1 <= max_bits <= 2:
        raise ValueError("posting lists are complete for 1 or 2 differing bits")
    lists = _postings(fps).groupBy("at", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)

    def tallied(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        octets = fp.view(np.uint8).reshape(-1, BYTES)
        shared = np.zeros((len(fp), len(fp)), np.uint8)
        for p in range(BYTES):
            shared += octets[:, None, p] == octets[None, :, p]
        i, j = np.nonzero(np.triu(shared >= BYTES - max_bits, 1))
        near = np.bitwise_count(fp[i] ^ fp[j]) <= max_bits
        return i[near], j[near]

    def looked_up(fp: np.ndarray, free: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        one = [np.uint64(1) << np.uint64(8 * p + b) for p in free for b in range(8)]
        found = []
        for m in [*one, *(x | y for x, y in combinations(one, 2) if max_bits > 1)]:
            other = fp ^ m
            place = np.searchsorted(fp, other)
            place[place == len(fp)] = 0
            hit = (fp[place] == other) & (other > fp)
            found.append((np.nonzero(hit)[0], place[hit]))
        return tuple(np.concatenate([f[k] for f in found]) for k in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for at, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                fp = np.sort(x.values.to_numpy().view(np.uint64))
                if len(fp) <= LONG_LIST or at < len(_LISTS):
                    i, j = tallied(fp)
                else:
                    own, i = divmod(at - len(_LISTS), 6)
                    i, j = looked_up(fp, tuple(p for p in range(BYTES) if p not in _LISTS[own] + _FINER[own][i]))
                if len(i):
                    root = _components(len(fp), i, j)
                    member = root != np.arange(len(fp))
                    out.append((fp[root[member]], fp[member]))
            a, b = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.uint64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return lists.select("at", "fps").mapInArrow(run, "a long, b long")


def _components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over links i-j, by hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        low = np.minimum(a, b)
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == root).all():
            return root
        root = new


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): smallest node reachable, for every node with a link, by alternating large and small stars.

    Each partition first contracts its own links to a spanning forest (exact, never more rows than it read). Each round keeps at most as many links as the one before and is written to the shared folder; the number of links that don't lead to a local minimum falls geometrically. Grouped state is a minimum only, so a hub costs no more than its links, split by Spark's partial aggregation.
    """

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(0).to_numpy(), b.column(1).to_numpy()
            nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
            root = _components(len(nodes), at[: len(x)], at[len(x) :])
            member = root != np.arange(len(nodes))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[root[member]]), pa.array(nodes[member])], names=["a", "b"])

    held = stash(edges.mapInArrow(contract, "a long, b long").distinct(), "links")
    while True:
        # large star: every neighbour above a node is linked to the node's smallest neighbour
        both = held.select("a", "b").union(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stash(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "links")  # written, so that Spark can split a hub's side of the join
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()
        mid = stash(large, "links")
        # small star: a node and its smaller neighbours are linked to the smallest of them
        down = mid.select(F.col("b").alias("n"), F.col("a").alias("s"))
        least = stash(down.groupBy("n").agg(F.min("s").alias("m")), "links")
        small = down.join(least, "n").select(F.col("m").alias("a"), F.explode(F.array("n", "s")).alias("b")).where("a <> b").distinct()
        after = stash(small, "links")
        # done when the links are stars: no node is both an end and a centre, and each end has one centre
        centres, ends = after.select(F.col("a").alias("x")).distinct(), after.select(F.col("b").alias("x"))
        done = centres.join(ends, "x", "left_semi").isEmpty() and ends.groupBy("x").count().where("count > 1").isEmpty()
        discard(held, low, mid, least)
        held = after
        if done:
            return held.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, words_per_shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, fp, component_id for every row of docs (other columns are left out).

    Equal fingerprints are one node from the start, so copies, hot groups and the empty texts (fingerprint 0) never become pairs. component_id: smallest doc_id reachable. Rows with a null doc_id keep their fingerprint; a group of only such rows has a null component_id.
    """
    marked = stash(fingerprints(docs.select(F.col("doc_id").cast("long"), "text"), words_per_shingle).drop("text"), "fingerprints")
    return group(marked, max_bits)


def group(marked: DataFrame, max_bits: int) -> DataFrame:
    """marked (doc_id, fp; more columns stay) with component_id."""
    nodes = stash(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    links = connected(near_edges(nodes.select("fp"), max_bits))
    reached = nodes.join(links.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # fingerprints of a component may meet in one row each: summed by partial aggregation
    lowest = reached.groupBy("root").agg(F.min("first").alias("component_id"))
    of = stash(reached.join(lowest, "root").select("fp", "component_id"), "components")
    return marked.join(of, "fp", "left")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Classes of a set's shingles that have a key, at each of up to two numbers of classes.
CLASSES = 40


def _classes(n: float, rate: int = 6) -> int:
    """Classes that n shingles are dealt in: the power of two from n / rate on, 16 at least, 32 beyond 64 shingles."""
    return max(16 if n <= 64 else 32, 1 << int(np.ceil(np.log2(max(1.0, n / rate)))))


def class_keys(h: np.ndarray, similarity: float) -> np.ndarray:
    """Keys of a set of shingles, one for each of its first CLASSES classes that is not empty: the shingles are dealt in classes by their hash, and a class's key stands for just its members.

    Sets of n shingles with that similarity or more differ in 2 * n * (1 - s) / (1 + s) at most (0.22 * n for 0.8), so a class is free of differences, and its keys equal, with a chance of a quarter or more, and one of the classes is but for a chance of 2 in 10,000 at 0.8 (much less above). Sets of sizes on both sides of a bound of _classes() meet as the smaller one is dealt at the next one's number too.
    """
    out = []
    for g in sorted({_classes(len(h)), _classes(len(h) / similarity)} if len(h) else ()):
        which = (mix(h) >> np.uint64(40)) % np.uint64(g)
        some = which < CLASSES
        own, which = mix(h[some] + np.uint64(g)), which[some]
        order = np.argsort(which, kind="stable")
        start = runs(which[order])
        if len(start):
            out.append(mix(np.add.reduceat(own[order], start) + which[order][start] * np.uint64(0x9E3779B97F4A7C15)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch(h: np.ndarray) -> np.ndarray:
    """Bits (in 64s), half as many as shingles, 256 at least, each the parity of the shingles that it stands for: two sets differ in as many shingles as their sketches in bits, at least. A sketch is folded to half its bits by xor of its halves."""
    bits = max(256, 1 << int(np.ceil(np.log2(max(1, len(h) / 2)))))
    return np.packbits(np.bincount((mix(h) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").view(np.uint64)


def folded(x: np.ndarray, width: int) -> np.ndarray:
    return np.bitwise_xor.reduce(x.reshape(-1, width), axis=0)


def _may_be(differ: np.ndarray | int, sizes: np.ndarray | int, similarity: float) -> np.ndarray | bool:
    """Whether sets of so many shingles together that differ in so many at least can have the similarity."""
    return differ * (1 + similarity) <= sizes * (1 - similarity) + 1e-6


MARKS = "doc_id long, h1 long, h2 long, fp long, n long, keys binary, sketch binary"


def marks(docs: DataFrame, words_per_shingle: int, similarity: float) -> DataFrame:
    """MARKS of each document, in one pass over its whole text: a 128-bit hash of its set of shingles, fingerprint, size of the set, class keys and sketch. No words: all the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch_slices(batch, 1):
                rows: list[list] = [[] for _ in range(6)]
                for t in raw(b.column(1)):
                    all_ = [*shingles(t, words_per_shingle)]
                    h = np.unique(np.concatenate(all_)) if all_ else np.zeros(0, np.uint64)
                    cells = (int(mix(h).sum(dtype=np.uint64)), int(mix(h + np.uint64(1)).sum(dtype=np.uint64)), fingerprint(all_), len(h), class_keys(h, similarity).tobytes(), sketch(h).tobytes())
                    for x, y in zip(rows, cells, strict=True):
                        x.append(y)
                signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in rows[:3]]
                yield pa.RecordBatch.from_arrays([b.column(0), *signed, pa.array(rows[3], pa.int64()), *[pa.array(x, pa.binary()) for x in rows[4:]]], names=[x.split()[0] for x in MARKS.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, MARKS)


def stars(sets: DataFrame, entries: int = 1 << 18) -> DataFrame:
    """key, a, b: each set's document b with the first document a that has a class key, for every key that two sets or more have.

    A sender of so many keys pairs those that share a key with its own first one, which alone goes on, so a key that a third of all sets have comes once from each sender.
    """
    total = int(sets.agg(F.sum(F.octet_length("keys"))).first()[0] or 0) // 8

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            key, ids = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            order = np.lexsort((ids, key))
            key, ids = key[order], ids[order]
            first = runs(key)
            lead = np.repeat(ids[first], np.diff(np.append(first, len(key))))
            rest = lead != ids
            leads = pack_keys(0, key[first], [ids[first]])
            none = lambda n, kind: pa.nulls(n, kind)
            k = int(rest.sum())
            yield pa.RecordBatch.from_arrays([*leads.columns, *[none(leads.num_rows, pa.int64())] * 3], names=[*leads.schema.names, "key", "a", "b"])
            yield pa.RecordBatch.from_arrays([*[none(k, c.type) for c in leads.columns], pa.array(key[rest].view(np.int64)), pa.array(lead[rest]), pa.array(ids[rest])], names=[*leads.schema.names, "key", "a", "b"])

        for batch in batches:
            keys = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            held.append((np.concatenate(keys), np.repeat(batch.column(0).to_numpy(), [len(x) for x in keys])))
            if sum(len(x[0]) for x in held) >= entries:
                yield from flush()
                held.clear()
        if held:
            yield from flush()

    def lead(t: pa.Table) -> pa.Table:
        key = np.concatenate([unpack_keys(b) for b in t.column("keys").to_pylist()])
        ids = np.concatenate([unsqueeze(v[0], np.int64) for v in t.column("vals").to_pylist()])
        order = np.lexsort((ids, key))
        key, ids = key[order], ids[order]
        first = runs(key)
        low = np.repeat(ids[first], np.diff(np.append(first, len(key))))
        rest = low != ids
        return pa.table({"key": pa.array(key[rest].view(np.int64)), "a": pa.array(low[rest]), "b": pa.array(ids[rest])})

    made = stash(sets.select("doc_id", "keys").mapInArrow(own, PACKED + ", key long, a long, b long"), "classes")
    leads = made.where("part is not null").select("part", F.monotonically_increasing_id().alias("block"), "n", "keys", "vals")
    across = gathered(leads, [np.int64], parts_of(-(-total // entries))).groupBy("part").applyInArrow(lead, "key long, a long, b long")
    return made.where("part is null").select("key", "a", "b").unionByName(across)


def crossed(members: DataFrame, similarity: float, most: int = 4096) -> DataFrame:
    """Candidates (a, b) of members (key, doc_id, component_id, n, sketch): all pairs of documents under one key that are in different components, but those that their sizes or sketches prove to be below the similarity. Nothing is capped.

    A key with more than most members is compared in blocks of so many, each pair of blocks as a key of its own.
    """
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("k"))
    block = F.pmod(F.xxhash64("doc_id"), F.col("k")).cast("int")
    dealt = members.join(sizes, "key").withColumn("x", block).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = dealt.withColumn("key", F.when(F.col("k") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("x", "y"), F.greatest("x", "y")))).drop("k", "x", "y")
    rows = stash(rows, "members")
    parts = max(1, rows.count() >> 16)

    def pairs(t: pa.Table) -> pa.Table:
        key, ids, components, sizes = (t.column(c).to_numpy() for c in ("key", "doc_id", "component_id", "n"))
        marks_ = [np.frombuffer(x, np.uint64) for x in t.column("sketch").to_pylist()]
        wide = np.array([len(x) for x in marks_])
        order = np.lexsort((ids, components, key))
        first = runs(key[order])
        n = np.diff(np.append(first, len(key)))
        # only keys with members of more than one component have pairs left
        mixed = components[order][first] != components[order][first + n - 1]
        width = np.repeat(np.minimum.reduceat(wide[order], first), n)
        out = [np.zeros((2, 0), np.int64)]
        for w in np.unique(width[np.repeat(mixed, n)]).tolist():
            some = np.repeat(mixed, n) & (width == w)
            at, count = order[some], n[mixed & (width[first] == w)]
            flat = np.stack([folded(marks_[i], w) for i in at])
            end, i, apart = np.repeat(np.cumsum(count), count), np.arange(len(at)), 0
            held = 0
            while len(i):
                apart += 1
                i = i[i + apart < end[i]]
                for start in range(0, len(i), 1 << 16):
                    x = i[start : start + (1 << 16)]
                    x = x[components[at[x]] != components[at[x + apart]]]
                    y = x + apart
                    differ = np.maximum(np.bitwise_count(flat[x] ^ flat[y]).sum(1, dtype=np.int64), np.abs(sizes[at[x]] - sizes[at[y]]))
                    ok = _may_be(differ, sizes[at[x]] + sizes[at[y]], similarity)
                    x, y = ids[at[x[ok]]], ids[at[y[ok]]]
                    out.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
                    held += len(x)
                if held > 1 << 20:
                    out, held = [np.unique(np.concatenate(out, axis=1), axis=1)], 0
        both = np.unique(np.concatenate(out, axis=1), axis=1)
        return pa.table({"a": pa.array(both[0]), "b": pa.array(both[1])})

    return rows.groupBy(F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part")).applyInArrow(pairs, "a long, b long").distinct()


def likely(docs: DataFrame, ids: DataFrame, bits: int = 1 << 23) -> DataFrame:
    """docs with _lipika_maybe: true for every doc_id that is in ids, and by chance for some others; false for null.

    A bitmap of so many bits, a bit an id, travels to all executors (2 MB, whatever the input). It only spares rows that can't be in ids the shuffle of an exact join that must follow.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    at = ids.select(place.alias("p")).groupBy(F.expr("p div 64").alias("_lipika_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("_lipika_bits"))
    marked = docs.withColumn("_lipika_place", place).withColumn("_lipika_word", F.expr("_lipika_place div 64"))
    hit = F.coalesce(F.expr("shiftright(_lipika_bits, cast(_lipika_place % 64 as int)) & 1"), F.lit(0)) == 1
    joined = marked.join(F.broadcast(stash(at, "bits")), "_lipika_word", "left").withColumn("_lipika_maybe", hit & F.col("doc_id").isNotNull())
    return joined.select(*docs.columns, "_lipika_maybe")


def similar_documents(docs: DataFrame, words_per_shingle: int = 5, similarity: float = 0.8, max_bits: int = 2) -> DataFrame:
    """doc_id, component_id of every doc_id that is not null: groups by links of documents whose sets of shingles have a Jaccard similarity of at least so much.

    Equal sets are one from the start. Candidates come from fingerprints within max_bits and from classes of shingles (see class_keys), and each is verified on its whole sets: first each set with the first that shares a class, then every pair of a class that still is in different components. Texts are read once for their marks, and those of candidates once for each of the two verifications.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    of = stash(marks(docs, words_per_shingle, similarity), "marks")
    own = F.struct("fp", "n", "keys", "sketch")
    sets = of.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.min_by(own, "doc_id").alias("x"))
    sets = stash(sets.select("h1", "h2", "doc_id", "x.*"), "sets")  # a row a distinct set
    starred = stash(stars(sets), "stars")
    # near fingerprints: each links the first sets of its two, and further sets with one fingerprint their first
    firsts = sets.groupBy("fp").agg(F.min("doc_id").alias("first"))
    edges = near_edges(firsts.select("fp"), max_bits)
    ends = lambda c, name: firsts.select(F.col("fp").alias(c), F.col("first").alias(name))
    near = edges.join(ends("a", "x"), "a").join(ends("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    same = sets.join(firsts, "fp").where("first <> doc_id").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    found = stash(starred.select("a", "b").unionByName(near).unionByName(same).distinct(), "pairs")
    groups = stash(_linked(sets, _verified(docs, _sifted(found, sets, similarity), words_per_shingle, similarity)), "groups")
    # keys of which two members are in different components: each has its first document with a member of another one
    open_ = stash(starred.join(_apart(found, groups).select("a", "b"), ["a", "b"], "left_semi").select("key").distinct(), "open")
    members = _members(sets, open_).join(groups, "doc_id").join(sets.select("doc_id", "n", "sketch"), "doc_id")
    rest = stash(crossed(members, similarity), "pairs")
    links = _verified(docs, _apart(rest, groups).select("a", "b"), words_per_shingle, similarity)
    of_pair = _apart(links, groups).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    roots = connected(of_pair.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).select(F.col("node").alias("component_id"), "root")
    last = groups.join(roots, "component_id", "left").select(F.col("doc_id").alias("first"), F.coalesce("root", "component_id").alias("component_id"))
    by_set = stash(sets.select("h1", "h2", F.col("doc_id").alias("first")).join(last, "first").select("h1", "h2", "component_id"), "by_set")
    # a doc_id of several texts is in several sets, which then are one group
    return of.select("doc_id", "h1", "h2").join(by_set, ["h1", "h2"]).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))


def _linked(sets: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, component_id of every set's document, by links (a, b)."""
    roots = connected(links).select(F.col("node").alias("doc_id"), "root")
    return sets.select("doc_id").distinct().join(roots, "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("component_id"))


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """pairs (a, b) of different components, with these (ca, cb)."""
    of = lambda c: groups.select(F.col("doc_id").alias(c), F.col("component_id").alias(f"c{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").where("ca <> cb").select("a", "b", "ca", "cb")


def _members(sets: DataFrame, keys: DataFrame, bits: int = 1 << 24) -> DataFrame:
    """key, doc_id of every set that has one of keys. A bitmap of the keys (2 MB, whatever the input) goes to all executors and spares most others the exact join that follows."""
    place = F.expr(f"shiftrightunsigned(key, {64 - bits.bit_length() + 1})")
    words = keys.select(place.alias("p")).groupBy(F.expr("p div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
    map_ = np.zeros(bits // 64, np.int64)
    for r in words.toLocalIterator():
        map_[r["word"]] = r["bits"]
    sent, shift = keys.sparkSession.sparkContext.broadcast(map_), np.uint64(64 - bits.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        map_ = sent.value.view(np.uint64)
        for b in batches:
            own = [np.frombuffer(x, np.uint64) for x in b.column(1).to_pylist()]
            key, ids = np.concatenate(own), np.repeat(b.column(0).to_numpy(), [len(x) for x in own])
            at = key >> shift
            hit = (map_[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
            yield pa.RecordBatch.from_arrays([pa.array(key[hit].view(np.int64)), pa.array(ids[hit])], names=["key", "doc_id"])

    return sets.select("doc_id", "keys").mapInArrow(run, "key long, doc_id long").join(keys, "key", "left_semi").distinct()


def _sifted(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """pairs (a, b) without those that sizes or sketches prove to be below the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for i, (n, m, x, y) in enumerate(zip(*(c.to_pylist() for c in b.columns[2:]), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                w = min(len(x), len(y))
                if _may_be(max(abs(n - m), int(np.bitwise_count(folded(x, w) ^ folded(y, w)).sum())), n + m, similarity):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], names=["a", "b"])

    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _verified(docs: DataFrame, pairs: DataFrame, words_per_shingle: int, similarity: float, partners: int = 256) -> DataFrame:
    """The pairs (a, b) whose whole sets of shingles are that similar."""
    some = stash(pairs, "pairs")
    asked = stash(some.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "asked")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch_slices(batch, 1):
                cells = []
                for t in raw(b.column(1)):
                    all_ = [*shingles(t, words_per_shingle)]
                    cells.append(np.unique(np.concatenate(all_)).tobytes() if all_ else b"")
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cells, pa.binary())], names=["doc_id", "set"])

    texts = likely(docs, asked).where("_lipika_maybe").select("doc_id", "text").join(asked, "doc_id", "left_semi")
    have = stash(texts.mapInArrow(sets, "doc_id long, set binary"), "shingles")
    side = lambda c: have.select(F.col("doc_id").alias(c), F.col("set").alias(f"s{c}"))
    # a may be the first of a class that very many have: its pairs are dealt over lanes, and its set goes once to each, never to each pair
    lanes = some.groupBy("a").agg(F.ceil(F.count("*") / F.lit(partners)).cast("int").alias("k"))
    of_a = side("a").join(lanes, "a").withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).drop("k")
    of_b = some.join(lanes, "a").withColumn("lane", F.pmod(F.xxhash64("b"), F.col("k")).cast("int")).drop("k").join(side("b"), "b")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= similarity * (len(x) + len(y) - both):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    return stash(of_b.join(of_a, ["a", "lane"]).select("a", "b", "sa", "sb").mapInArrow(compared, "a long, b long").distinct(), "links")


def keep_one(docs: DataFrame, words_per_shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without all but the document with the smallest doc_id of each group of similar_documents(); of rows with one doc_id, that with the least text hash and text. Rows with a null doc_id stay, as they can't be told apart; null text is empty, and texts without words are alike."""
    with scratch() as keep:
        grouped = keep(stash(similar_documents(docs, words_per_shingle, similarity), "similar"))
    gone = grouped.where("doc_id <> component_id").select("doc_id")
    # texts that can't be among those that go stay where they are; the others meet the exact list
    out = _without(docs, gone)
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    with shuffles_end(docs.sparkSession):
        if again.isEmpty():
            return out
    from pyspark.sql import Window

    marked = likely(out, again)
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    some = marked.where("_lipika_maybe").drop("_lipika_maybe").withColumn("_lipika_n", F.row_number().over(order)).where("_lipika_n = 1").drop("_lipika_n")
    return marked.where("not _lipika_maybe").drop("_lipika_maybe").unionByName(some)


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id is not in ids; only rows that a bitmap can't rule out are shuffled."""
    marked = likely(docs, ids)
    rest = marked.where("_lipika_maybe").join(ids, "doc_id", "left_anti")
    return marked.where("not _lipika_maybe").unionByName(rest).select(docs.columns)
