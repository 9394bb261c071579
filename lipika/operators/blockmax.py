"""BM25 over an index of shards: postings in delta-coded blocks or bitmaps, and a top-k that raises a threshold and looks only at what can still reach it.

A token counts once a document, so a document's score is g(length) times the sum of the weights of the query's tokens it has, and g falls with the length. Within a shard documents are numbered by rising length, so the first document of a block bounds all of it.
Tokens of over half of all documents, whose idf is negative and whose weight is therefore one and the same, are no postings at all: they are bits of a document, and a query counts those it shares. All other weights are positive, so sums only rise.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lipika.operators.lexical import Bm25Config, own_tokens, tokens
from lipika.sources import files

BLOCK = 64
#: Documents of a shard: 16 bits are enough for their numbers.
SHARD_DOCS = 8192
#: A shard of long texts ends earlier, as a task holds its tokens.
SHARD_TOKENS = 8 << 20
#: Lists in a batch of a task's output.
ROWS = 8192
BLOCKS = "shard long, token string, n long, firsts binary, gaps binary"


@dataclass(frozen=True)
class BlockIndex:
    """blocks (BLOCKS: a row a shard and light token), docs (shard, keys, lengths, bits: in the order of the shard's numbers), terms (token, df, bit: null if light) and facts (n_docs, avgdl; one row)."""

    blocks: DataFrame
    docs: DataFrame
    terms: DataFrame
    facts: DataFrame
    key: str


def encode_postings(ids: np.ndarray, size: int) -> tuple[bytes | None, bytes]:
    """Rising numbers below size, as (first number of each block of BLOCK, gaps within the blocks), 16 bits each, the last block filled up with gaps of 0; or, where that is shorter, as (None, a bit a number)."""
    if len(ids) * 16 > size:
        bits = np.zeros(size, np.uint8)
        bits[ids] = 1
        return None, np.packbits(bits).tobytes()
    n = -(-len(ids) // BLOCK)
    full = np.concatenate([ids, np.repeat(ids[-1:], n * BLOCK - len(ids))]).astype(np.int64).reshape(n, BLOCK)
    return full[:, 0].astype("<u2").tobytes(), np.diff(full, axis=1, prepend=full[:, :1]).astype("<u2").tobytes()


class Postings:
    """The documents of one token in one shard."""

    def __init__(self, n: int, firsts: bytes | None, gaps: bytes, size: int) -> None:
        self.n = n
        self.bits = np.unpackbits(np.frombuffer(gaps, np.uint8), count=size) if firsts is None else None
        if firsts is not None:
            self.firsts = np.frombuffer(firsts, "<u2").astype(np.int64)
            self.gaps = np.frombuffer(gaps, "<u2").reshape(-1, BLOCK)

    def read(self, which: np.ndarray) -> np.ndarray:
        """The documents of the blocks which (rising places), in order."""
        ids = (self.firsts[which, None] + np.cumsum(self.gaps[which], axis=1, dtype=np.int64)).ravel()
        spare = len(self.firsts) * BLOCK - self.n
        return ids[: len(ids) - spare] if spare and len(which) and which[-1] == len(self.firsts) - 1 else ids

    def all(self) -> np.ndarray:
        return np.flatnonzero(self.bits) if self.bits is not None else self.read(np.arange(len(self.firsts)))

    def among(self, alive: np.ndarray) -> tuple[np.ndarray, int]:
        """(those of alive, rising, that have the token; how many postings or bits were looked at). Blocks without any of alive are skipped."""
        if self.bits is not None:
            return alive[self.bits[alive] > 0], min(len(alive), self.n)
        at = np.searchsorted(self.firsts, alive, "right") - 1
        which = np.unique(at[at >= 0])
        ids = self.read(which)
        if not len(ids):
            return alive[:0], 0
        place = np.minimum(np.searchsorted(ids, alive), len(ids) - 1)
        return alive[ids[place] == alive], len(ids)


def block_index(docs: DataFrame, key: str, text: str = "text", c: Bm25Config = Bm25Config(), shard_docs: int = SHARD_DOCS) -> BlockIndex:
    """The index of documents (their keys are distinct), written to the shared folder.

    A task cuts its texts and numbers, sorts and codes their postings in shards of at most shard_docs documents, and the coded lists are written once: texts are shuffled once, by the key, and tokens neither stored nor shuffled. Document frequencies are sums over the lists. Only the lists of heavy tokens go on to their shards' documents, as bits. A document without tokens has one that nothing matches. The heavy tokens come to the driver: each is in over half of the documents, so they are fewer than twice the tokens of an average document.
    """
    total = docs.count()
    most = min(shard_docs, 1 << 15)
    # several tasks a core even if the documents are few, but none for a handful of them
    n = max(1, -(-total // most), min(4 * docs.sparkSession.sparkContext.defaultParallelism, total // 512))
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).repartition(n, "key")
    kind = docs.schema[key].dataType.simpleString()

    def shard(number: int, keys: pa.Array, tokens_: pa.ListArray):
        """A row a token with its list, and one with a null token for the documents."""
        size, lengths = len(keys), tokens_.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        order = pc.sort_indices(pa.table({"dl": lengths, "key": keys}), [("dl", "ascending"), ("key", "ascending")]).to_numpy()
        ids = np.empty(size, np.int64)
        ids[order] = np.arange(size)
        coded = tokens_.flatten().dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        counts = np.bincount(code, minlength=len(coded.dictionary))
        # by token, then by document
        flat = np.sort(code * size + np.repeat(ids, lengths)) % size
        ends = np.cumsum(counts)
        for at in range(0, len(counts), ROWS):
            own = range(at, min(at + ROWS, len(counts)))
            lists = [encode_postings(flat[ends[i] - counts[i] : ends[i]], size) for i in own]
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(own), pa.int64()), coded.dictionary.slice(at, ROWS), pa.array(counts[at : at + ROWS], pa.int64()), pa.array([x for x, _ in lists], pa.binary()), pa.array([x for _, x in lists], pa.binary()), pa.nulls(len(own), pa.list_(keys.type)), pa.nulls(len(own), pa.list_(pa.int64()))], names=names)
        none = [pa.nulls(1, pa.string()), pa.array([size], pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())]
        whole = [pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), x) for x in (keys.take(pa.array(order)), pa.array(lengths[order]))]
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *none, *whole], names=names)

    names = [x.split()[0] for x in BLOCKS.split(", ")] + ["keys", "lengths"]

    def cut(batches):
        held, n_docs, n_tokens, number = [], 0, 0, TaskContext.get().partitionId() << 24

        def whole():
            return shard(number, *(pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1)))

        for b in batches:
            for a in range(0, b.num_rows, min(256, most)):
                part = b.slice(a, min(256, most))
                if held and (n_docs + part.num_rows > most or n_tokens >= SHARD_TOKENS):
                    yield from whole()
                    held, n_docs, n_tokens, number = [], 0, 0, number + 1
                held.append(part)
                n_docs, n_tokens = n_docs + part.num_rows, n_tokens + len(part.column(1).flatten())
        if held:
            yield from whole()

    made = files.stash(texts.select("key", own_tokens(F.col("text"), c).alias("tokens")).mapInArrow(cut, f"{BLOCKS}, keys array<{kind}>, lengths array<long>"))
    df = files.stash(made.where("token is not null").groupBy("token").agg(F.sum("n").alias("df")))
    heavy = [r["token"] for r in df.where(2 * F.col("df") > total).select("token").orderBy("token").collect()]
    place = {t: i for i, t in enumerate(heavy)}
    bit = F.create_map(*[F.lit(x) for t, i in place.items() for x in (t, i)])[F.col("token")] if heavy else F.lit(None).cast("int")
    is_heavy = F.col("token").isin(heavy)

    def mark(t: pa.Table) -> pa.Table:
        docs_ = t.filter(pc.is_null(t.column("token")))
        size = docs_.column("n")[0].as_py()
        m = np.zeros((size, max(1, -(-len(heavy) // 64)) * 64), np.uint8)
        lists = t.filter(pc.is_valid(t.column("token")))
        for token, k, firsts, gaps in zip(*(lists.column(x).to_pylist() for x in ("token", "n", "firsts", "gaps")), strict=True):
            m[Postings(k, firsts, gaps, size).all(), place[token]] = 1
        return docs_.select(["shard", "keys", "lengths"]).append_column("bits", pa.array([np.packbits(m, axis=1, bitorder="little").tobytes()], pa.binary()))

    of = files.stash(made.where(F.col("token").isNull() | is_heavy).groupBy("shard").applyInArrow(mark, f"shard long, keys array<{kind}>, lengths array<long>, bits binary"))
    facts = of.select(F.explode("lengths").alias("dl")).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    return BlockIndex(made.where(F.col("token").isNotNull() & ~is_heavy).drop("keys", "lengths"), of, df.withColumn("bit", bit), facts, key)


def save_blocks(index: BlockIndex, path: str, buckets: int | None = None) -> None:
    """Writes the index under path, the blocks in folders by a hash of the token, so that a search reads only those of its own tokens. buckets: of these; one for every 4 million postings unless given."""
    spark = index.blocks.sparkSession
    n = buckets or max(1, int(index.terms.agg(F.sum("df")).first()[0] or 0) >> 22)
    index.blocks.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(n)).cast("int")).hint("rebalance", "bucket").sortWithinPartitions("bucket", "token", "shard").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
    for name in ("docs", "terms", "facts"):
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(n, index.key)], "buckets int, key string").coalesce(1).write.mode("overwrite").json(f"{path}/about")


def load_blocks(spark: SparkSession, path: str) -> BlockIndex:
    about = spark.read.json(f"{path}/about").first()
    blocks = spark.read.parquet(f"{path}/blocks").withColumn("_buckets", F.lit(about["buckets"]))
    return BlockIndex(blocks, *(spark.read.parquet(f"{path}/{x}") for x in ("docs", "terms", "facts")), about["key"])


@dataclass
class Shard:
    """lists: postings by token; g: each document's factor, falling; bits: its heavy tokens, in 64-bit words."""

    lists: dict[str, Postings]
    g: np.ndarray
    bits: np.ndarray

    def top(self, light: list[tuple[str, float]], heavy: list[int], heavy_weight: float, k: int, floor: float, slack: float, seed: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(numbers, scores, postings looked at) of the documents that can be among the k best of a query of light tokens with their weights and heavy bits.

        floor: a score that k documents are known to have at least. Documents within slack of the k-th score stay. Weights are added from the largest on, to those documents only that can still reach the threshold: g * (sum so far + weights left). The threshold rises with the k-th of the sums so far.
        seed: stop after so many postings; scores are then lower bounds.
        """
        g = self.g
        terms = sorted(((w, t) for t, w in light if t in self.lists), key=lambda x: (-x[0], x[1]))
        rest = np.cumsum([w for w, _ in terms][::-1])[::-1].tolist() + [0.0] if terms else [0.0]
        total = np.zeros(len(g))
        if heavy:
            mask = np.zeros(self.bits.shape[1], np.uint64)
            for x in heavy:
                mask[x >> 6] |= np.uint64(1 << (x & 63))
            total += heavy_weight * np.bitwise_count(self.bits & mask).sum(1)
        alive, scored, threshold, judged = np.arange(len(g)), 0, floor, np.inf
        for i, (w, t) in enumerate(terms):
            if rest[i] <= 0.9 * judged:
                # enough was added since the last look at who can still matter
                judged = rest[i]
                low = total[alive] * g[alive]
                if len(alive) > k:
                    threshold = max(threshold, float(np.partition(low, len(low) - k)[len(low) - k]))
                alive = alive[low + rest[i] * g[alive] >= threshold - slack]
                if not len(alive):
                    break
            hit, n = self.lists[t].among(alive)
            scored += n
            total[hit] += w
            if seed is not None and scored >= seed:
                break
        own = alive[total[alive] > 0]
        scores = total[own] * g[own]
        if len(own) > k:
            keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k] - slack
            own, scores = own[keep], scores[keep]
        return own, scores, scored


def search_blocks(index: BlockIndex, asked: DataFrame, query_key: str, c: Bm25Config = Bm25Config(), digits: int | None = None, most_broadcast: int = 500_000, slice_queries: int = 256, report: dict | None = None) -> DataFrame:
    """query_key, key, score, rank as lexical.search_bm25() gives them for asked (query_key, token), by skipping.

    Each shard meets each slice of slice_queries queries in one task, which holds the shard's postings of asked tokens; only postings of tokens that are asked are read. A first round scores the rarest tokens of each query alone, and the k-th best of that over all shards is the floor from which every shard prunes.
    report, if given, gets the postings looked at (both rounds), those of all asked tokens, and of these those that are bits.
    """
    spark, key = index.blocks.sparkSession, index.key
    terms = index.terms.crossJoin(F.broadcast(index.facts)).withColumn("idf", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = terms.agg(F.avg("idf").alias("mean_idf"))
    weight = F.when(F.col("idf") < 0, c.epsilon * F.col("mean_idf")).otherwise(F.col("idf"))
    known = asked.select("token").distinct().join(terms, "token").crossJoin(F.broadcast(mean)).select("token", "bit", (weight * (c.k1 + 1)).alias("weight"), "df")
    known = files.stash(known)
    per = files.stash(asked.join(known, "token").groupBy(query_key).agg(F.sort_array(F.collect_list(F.struct("token", "weight", "bit"))).alias("terms")))
    n_slices = max(1, -(-per.count() // slice_queries))
    light = known.where("bit is null").select("token")
    small = F.broadcast(light) if light.count() <= most_broadcast else light.hint("merge")
    blocks = index.blocks
    if "bucket" in blocks.columns:  # stored: only the folders of asked tokens are read
        buckets = blocks.select("_buckets").first()
        blocks = blocks.drop("_buckets")
        small = small.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets[0] if buckets else 1)).cast("int"))
    blocks = blocks.join(small, [x for x in ("bucket", "token") if x in small.columns]).select("shard", "token", "n", "firsts", "gaps")
    # one row a shard with its documents, and one a token; every slice of queries meets all of them
    slices = F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1)))
    avgdl = index.facts.select("avgdl")
    factor = lambda x: 1 / (1 + c.k1 * (1 - c.b + c.b * x / F.col("avgdl")))
    docs = index.docs.crossJoin(F.broadcast(avgdl)).select("shard", F.transform("lengths", factor).alias("g"), "bits")
    side = docs.select("shard", F.lit(None).cast("string").alias("token"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("firsts"), F.col("bits").alias("gaps"), "g")
    side = side.unionByName(blocks.withColumn("g", F.lit(None).cast("array<double>"))).withColumn("slice", slices)
    slack = 2 * 10.0**-digits if digits is not None else 1e-9
    kind = per.schema[query_key].dataType
    found = T.StructType([T.StructField("shard", T.LongType()), T.StructField("query", kind), T.StructField("id", T.IntegerType()), T.StructField("raw", T.DoubleType()), T.StructField("scored", T.LongType())])

    def round_of(queries: DataFrame, seed: int | None) -> DataFrame:
        def search(left: pa.Table, right: pa.Table) -> pa.Table:
            out: list[list] = [[], [], [], [], []]
            if left.num_rows and right.num_rows:
                at, rows, shard = left.column("shard")[0].as_py(), [], None
                for t, n, f, gaps, own in zip(*(left.column(x).to_pylist() for x in ("token", "n", "firsts", "gaps")), left.column("g"), strict=True):
                    if t is None:
                        g = np.array(own.as_py(), np.float64)
                        shard = Shard({}, g, np.frombuffer(gaps, "<u8").reshape(len(g), -1))
                    else:
                        rows.append((t, n, f, gaps))
                shard.lists |= {t: Postings(n, f, gaps, len(shard.g)) for t, n, f, gaps in rows}
                for q, own, floor in zip(right.column("query").to_pylist(), right.column("terms").to_pylist(), right.column("floor").to_pylist(), strict=True):
                    heavy = [x for x in own if x["bit"] is not None]
                    ids, scores, scored = shard.top([(x["token"], x["weight"]) for x in own if x["bit"] is None], [x["bit"] for x in heavy], heavy[0]["weight"] if heavy else 0.0, c.k, floor, slack, seed)
                    m = max(1, len(ids))  # a query that finds nothing here still says what it read
                    out[0] += [at] * m
                    out[1] += [q] * m
                    out[2] += ids.tolist() or [None]
                    out[3] += scores.tolist() or [None]
                    out[4] += [scored, *[0] * (m - 1)]
            return pa.table([pa.array(x, y) for x, y in zip(out, (pa.int64(), right.schema.field("query").type, pa.int32(), pa.float64(), pa.int64()), strict=True)], names=["shard", "query", "id", "raw", "scored"])

        spread = queries.withColumn("slice", F.pmod(F.xxhash64("query"), F.lit(n_slices)).cast("int")).join(F.broadcast(index.docs.select(F.col("shard").alias("at"))))
        return files.stash(side.groupBy("shard", "slice").cogroup(spread.groupBy("at", "slice")).applyInArrow(search, found))

    own = per.select(F.col(query_key).alias("query"), "terms")
    first = round_of(own.withColumn("floor", F.lit(0.0)), 4 * c.k)
    by = Window.partitionBy("query").orderBy(F.desc("raw"))
    floors = first.where("id is not null").withColumn("_n", F.row_number().over(by)).where(F.col("_n") == c.k).select("query", F.col("raw").alias("floor"))
    hits = round_of(own.join(floors, "query", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0))), None)
    if report is not None:
        asked_n = asked.join(known, "token").agg(F.sum("df").alias("n"), F.sum(F.when(F.col("bit").isNotNull(), F.col("df"))).alias("bits")).first()
        report |= {"scored": first.unionByName(hits).agg(F.sum("scored")).first()[0] or 0, "asked": asked_n["n"] or 0, "bits": asked_n["bits"] or 0}
    named = index.docs.select("shard", F.posexplode("keys").alias("id", key))
    score = F.round("raw", digits) if digits is not None else F.col("raw")
    # the k best by raw score of each shard and what is as near are all that can be ranked
    best = hits.where("id is not null").withColumn("score", score).where("score > 0").withColumn("_m", F.rank().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("_m") <= c.k)
    keyed = named.join(best, ["shard", "id"]).select(F.col("query").alias(query_key), key, "score")
    w = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return keyed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= c.k)


def bm25_blockmax(queries: DataFrame, docs: DataFrame, query_key: str, key: str, query_text: str = "text", text: str = "text", c: Bm25Config = Bm25Config(), digits: int | None = None, shard_docs: int = SHARD_DOCS, report: dict | None = None) -> DataFrame:
    """search_blocks() of a table of queries over documents that have no stored index."""
    asked = queries.select(query_key, F.explode_outer(tokens(F.col(query_text), c)).alias("token")).where("token is not null")
    return search_blocks(block_index(docs, key, text, c, shard_docs), asked, query_key, c, digits, report=report)
