"""Helpers that the training-data operators share: storage, exact binomial bounds, packed exchanges."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of all contracts: space and \t \n \v \f \r. bytes.split() splits at just these.
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Lowers the session's limits of an Arrow batch, in rows and in bytes: rows here are whole texts, and both sides of the exchange hold a batch. Lower limits that the caller has set stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, "64MB", "67108864b"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master, where all is one machine, may leave it unset (as tests do); it then is a new temporary one."""
    small_batches(spark)
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lipika-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


@contextlib.contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of each query within as soon as it ends; else they stay on the executors' disks until the driver's JVM happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Lists of what stash() writes within open scratch() blocks, the innermost last.
_scratch: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes, when the block ends well, all that was stashed within it, but what was passed to the function that the block gets (that passes to the block around it, if any). Only for blocks of which no other frame leaves unread."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    _scratch.append(made)
    try:
        yield keep
    finally:
        _scratch.remove(made)
    left = {df._lipika_path for df in kept}
    discard(*[df for df in made if df._lipika_path not in left])
    if _scratch:
        _scratch[-1].extend(df for df in made if df._lipika_path in left)


def stash(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df written to the shared folder as Parquet and read again; cuts its lineage, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lipika-{name}-{uuid.uuid4().hex}"
    with shuffles_end(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lipika_path = path  # for discard()
    if _scratch:
        _scratch[-1].append(out)
    return out


def stash_buckets(df: DataFrame, key: str, name: str, codec: str = "zstd") -> DataFrame:
    """As stash(), in buckets by key, as many as spark.sql.shuffle.partitions: later joins on key shuffle the other side only."""
    spark = df.sparkSession
    unique = uuid.uuid4().hex
    buckets, entry = int(spark.conf.get("spark.sql.shuffle.partitions")), f"lipika_{unique}"
    with shuffles_end(spark):
        df.write.format("parquet").option("compression", codec).option("path", f"{shared_dir(spark)}/lipika-{name}-{unique}").bucketBy(buckets, key).saveAsTable(entry)
    out = spark.table(entry)
    out._lipika_path = f"{shared_dir(spark)}/lipika-{name}-{unique}"
    if _scratch:
        _scratch[-1].append(out)
    spark.sql(f"drop table {entry}")  # the catalog's entry of an external table; the files stay
    return out


def discard(*stashed: DataFrame) -> None:
    """Deletes what stash() wrote; only for what no returned frame reads."""
    for df in stashed:
        spark = df.sparkSession
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._lipika_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def raw(col: pa.Array) -> list[bytes]:
    """UTF-8 of each value; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


# --- exact binomial bounds -------------------------------------------------------------------------------------------


def _log_beta(a: float, b: float) -> float:
    from math import lgamma

    return lgamma(a) + lgamma(b) - lgamma(a + b)


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function I_x(a, b), by its continued fraction."""
    from math import exp, log, log1p

    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, 10_000):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + n * d
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1 + n / c
            c = c if abs(c) > 1e-300 else 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-13:
            break
    return exp(a * log(x) + b * log1p(-x) - _log_beta(a, b)) * h / a


def beta_above(x: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 - beta_cdf(x, a, b) of arrays, by the same continued fraction over all at once."""
    from math import lgamma

    a, b = (np.asarray(v, np.float64) for v in (a, b))
    turn = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    near = lambda v: np.where(np.abs(v) > 1e-300, v, 1e-300)
    c, d = np.ones_like(p), 1 / near(1 - (p + q) * y / (p + 1))
    h = d.copy()
    for m in range(1, 10_000):
        for n in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / near(1 + n * d)
            c = near(1 + n / c)
            h = h * c * d
        if (np.abs(c * d - 1) < 1e-13).all():
            break
    log_beta = np.array([lgamma(u) + lgamma(v) - lgamma(u + v) for u, v in zip(p, q, strict=True)])
    below = np.exp(p * np.log(y) + q * np.log1p(-y) - log_beta) * h / p
    return np.where(turn, below, 1 - below)


def binomial_upper(k: int, n: int, risk: float) -> float:
    """Clopper-Pearson upper limit at level 1 - risk of a rate, seen k times of n; 1 if n is 0."""
    if n <= 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(mid, k + 1, n - k) < 1 - risk else (low, mid)
    return high


# --- blocks of documents and packed exchanges ------------------------------------------------------------------------

NULL_ID = np.iinfo(np.int64).max  # stands for a null doc_id within blocks; larger than any


def batch_slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose values of a string column have about so many bytes, so that working memory follows the slice, not the batch."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + most, "right")))
        yield batch.slice(a, b - a)
        a = b


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """The batch's rows, one in memory at a time."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def blocks(docs: DataFrame, block_bytes: int, more: Callable[[np.ndarray, np.ndarray, bytes], list[bytes]] | None = None, names_of_more: tuple[str, ...] = ()) -> DataFrame:
    """Documents gathered in blocks of about block_bytes, one row a block, within the partitions as read (no shuffle).

    block: a number of its own; ids: int64 doc ids; sizes, lens: int64 words and bytes of each document; text: the texts, a space after each; rest: the other columns of docs, a struct each; then the binary columns that more(ids, sizes, text) gives.
    Null text is empty and null doc_id is NULL_ID. A document longer than block_bytes ends its block.
    """
    from pyspark.sql import types as T

    rest = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    row = T.StructType([T.StructField("_lipika_null", T.BooleanType()), *rest])
    schema = T.StructType([T.StructField("block", T.LongType()), *[T.StructField(c, T.BinaryType()) for c in ("ids", "sizes", "lens", "text")], T.StructField("rest", T.ArrayType(row)), *[T.StructField(c, T.BinaryType()) for c in names_of_more]])
    names = [f.name for f in rest]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, k = TaskContext.get().partitionId() << 32, 0
        ids: list[int] = []
        sizes: list[int] = []
        parts: list[bytes] = []
        kept: list[pa.RecordBatch] = []
        held = 0

        def flush() -> pa.RecordBatch:
            others = pa.Table.from_batches(kept).combine_chunks()
            text = b"".join(p + b" " for p in parts)
            found = more(np.array(ids, np.int64), np.array(sizes, np.int64), text) if more else []
            structs = pa.StructArray.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in others.columns], names=others.column_names)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([base + k], pa.int64()),
                    *[pa.array([np.array(x, np.int64).tobytes()], pa.binary()) for x in (ids, sizes, [len(p) for p in parts])],
                    pa.array([text], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), structs),
                    *[pa.array([x], pa.binary()) for x in found],
                ],
                names=["block", "ids", "sizes", "lens", "text", "rest", *names_of_more],
            )

        for batch in batches:
            at = batch.schema.names.index("doc_id")
            text_at = batch.schema.names.index("text")
            for part in batch_slices(batch, text_at, block_bytes):
                own = part.column(at).to_pylist()
                texts = raw(part.column(text_at))
                ids += [NULL_ID if i is None else i for i in own]
                sizes += [len(x.split()) for x in texts]
                parts += texts
                held += sum(map(len, texts))
                kept.append(pa.RecordBatch.from_arrays([part.column(text_at).is_null(), *[part.column(part.schema.names.index(c)) for c in names]], names=["_lipika_null", *names]))
                if held >= block_bytes or len(ids) >= block_bytes >> 5:
                    yield flush()
                    ids, sizes, parts, kept, held, k = [], [], [], [], 0, k + 1
        if ids:
            yield flush()

    return docs.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(gather, schema)


def ints(cell: bytes) -> np.ndarray:
    return np.frombuffer(cell, np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every bit depends on all."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of each word."""
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


PACKED = "part int, block long, n long, keys binary, vals array<binary>"
#: Rows that a sender makes of its keys, whatever the input.
FAN = 64


def parts_of(blocks: int, share: int = 4) -> int:
    """Parts of the key space, a multiple of FAN: so many that a part gets the keys of share blocks, or FAN where that is more."""
    return FAN * max(1, -(-blocks // (FAN * share)))


_codecs: dict = {}


def _codec(kind: str):
    """The process's own (de)compressor, as making one costs more than most uses of it."""
    import zstandard

    if kind not in _codecs:
        _codecs[kind] = zstandard.ZstdCompressor(1) if kind == "in" else zstandard.ZstdDecompressor()
    return _codecs[kind]


def squeeze(x: np.ndarray) -> bytes:
    """Bytes of an integer array, its byte planes apart and compressed: sorted keys and small numbers get short."""
    x = np.ascontiguousarray(x)
    return _codec("in").compress(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes())


def unsqueeze(b: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(_codec("out").decompress(b), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _edges(keys: np.ndarray, first: int, count: int, parts: int) -> list[int]:
    """Where the parts first .. first + count of the whole key space cut sorted keys that lie in these."""
    inner = np.array([(i << 64) // parts for i in range(first + 1, first + count)], np.uint64)
    return [0, *np.searchsorted(keys, inner).tolist(), len(keys)]


def pack_keys(block: int, keys: np.ndarray, vals: list[np.ndarray]) -> pa.RecordBatch:
    """Sorted 64-bit keys of a block, with values each, as one row for each of FAN parts of the key space that has any."""
    edges = _edges(keys, 0, FAN, FAN)
    rows = [(p, a, b) for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([p for p, _, _ in rows], pa.int32()),
            pa.array([block] * len(rows), pa.int64()),
            pa.array([b - a for _, a, b in rows], pa.int64()),
            pa.array([squeeze(np.diff(keys[a:b], prepend=np.uint64(0))) for _, a, b in rows], pa.binary()),
            pa.array([[squeeze(v[a:b]) for v in vals] for _, a, b in rows], pa.list_(pa.binary())),
        ],
        names=["part", "block", "n", "keys", "vals"],
    )


def unpack_keys(cell: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(cell, np.uint64), dtype=np.uint64)


BUNDLED = PACKED + ", who binary, ns binary"


def gathered(packed: DataFrame, kinds: list[type], parts: int) -> DataFrame:
    """Rows of pack_keys() in rows of BUNDLED for each of parts parts of the key space.

    A sender's rows are FAN whatever the input, so all rows grow in proportion to it. Beyond FAN parts there are two hops: rows of a part and of some FAN senders meet in one task, which cuts them in finer parts and bundles each of these; block is then the bundle's number, who the senders' and ns their numbers of keys. Up to FAN parts rows stay as they are.
    """
    if parts <= FAN:
        return packed
    fine, groups = parts // FAN, max(1, parts * 4 // FAN)

    def bundle(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        part, group, who = t.column("part")[0].as_py(), t.column("sender")[0].as_py(), t.column("block").to_numpy()
        keys = [unpack_keys(b) for b in t.column("keys").to_pylist()]
        vals = [[unsqueeze(v, kind) for v, kind in zip(row, kinds, strict=True)] for row in t.column("vals").to_pylist()]
        edges = [_edges(k, part * fine, fine, parts) for k in keys]
        out: list[list] = [[] for _ in range(7)]
        for j in range(fine):
            ns = np.array([e[j + 1] - e[j] for e in edges], np.int64)
            if ns.any():
                own = np.concatenate([k[e[j] : e[j + 1]] for k, e in zip(keys, edges, strict=True)])
                cells = [squeeze(np.concatenate([v[i][e[j] : e[j + 1]] for v, e in zip(vals, edges, strict=True)])) for i in range(len(kinds))]
                for x, y in zip(out, (part * fine + j, part * groups + group, len(own), squeeze(np.diff(own, prepend=np.uint64(0))), cells, who.tobytes(), ns.tobytes()), strict=True):
                    x.append(y)
        types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.binary()]
        return pa.table([pa.array(x, k) for x, k in zip(out, types, strict=True)], names=["part", "block", "n", "keys", "vals", "who", "ns"])

    return packed.withColumn("sender", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).groupBy("part", "sender").applyInArrow(bundle, BUNDLED)


def exchange(packed: DataFrame, answer: Callable[..., np.ndarray], kinds: list[type], reply: type, parts: int) -> DataFrame:
    """Each part's keys of all blocks meet in one task; every key of every block gets a reply, which goes back packed, by the same hops.

    packed: rows of pack_keys(). answer(keys, *vals): the replies, in the order of keys. parts: parts_of() the number of blocks, so a part's size does not grow with the input; a key is in a block once (or few times), whatever its frequency.
    Result: part (one of FAN), block, reply: the replies in the order of the block's keys of that part.
    """
    more = ["who", "ns"] if parts > FAN else []

    def reduce(t: pa.Table) -> pa.Table:
        n = t.column("n").to_numpy()
        keys = np.concatenate([unpack_keys(b) for b in t.column("keys").to_pylist()])
        vals = t.column("vals").to_pylist()
        got = answer(keys, *[np.concatenate([unsqueeze(v[i], kind) for v in vals]) for i, kind in enumerate(kinds)]).astype(reply)
        ends = np.cumsum(n)
        cells = pa.array([squeeze(got[e - k : e]) for e, k in zip(ends, n, strict=True)], pa.binary())
        return pa.table([t.column("part"), t.column("block"), cells, *[t.column(c) for c in more]], names=["part", "block", "reply", *more])

    def unbundle(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        who, got = ints(t.column("who")[0].as_py()), []
        for cell, ns in zip(t.column("reply").to_pylist(), t.column("ns").to_pylist(), strict=True):
            got.append(np.split(unsqueeze(cell, reply), np.cumsum(ints(ns))[:-1]))
        cells = [np.concatenate(x) for x in zip(*got, strict=True)]
        part = t.column("part")[0].as_py() * FAN // parts
        rows = [(w, squeeze(x)) for w, x in zip(who.tolist(), cells, strict=True) if len(x)]
        return pa.table([pa.array([part] * len(rows), pa.int32()), pa.array([w for w, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["part", "block", "reply"])

    answered = gathered(packed, kinds, parts).groupBy("part").applyInArrow(reduce, "part int, block long, reply binary" + "".join(f", {c} binary" for c in more))
    return answered.groupBy("block").applyInArrow(unbundle, "part int, block long, reply binary") if more else answered


def replies(answers: DataFrame, name: str) -> DataFrame:
    """All replies to a block in one row, by part."""
    return answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "reply"))).alias(name))


def read_replies(got: list | None, kind: type) -> np.ndarray:
    return np.concatenate([unsqueeze(x["reply"], kind) for x in got]) if got else np.zeros(0, kind)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys (all arrays together) in sorted arrays."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.nonzero(new)[0]
