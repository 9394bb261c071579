"""Embeddings of texts by an encoder to plug in, and by a hashing encoder that needs no model."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Encoder = Callable[[list[str]], "np.ndarray | Sequence[Sequence[float]]"]


@dataclass(frozen=True)
class EncoderConfig:
    """model: the name that decides about prefixes; batch: texts in a call; normalize: to length 1 (zero vectors stay)."""

    model: str = ""
    batch: int = 32
    normalize: bool = True

    def prefix(self, query: bool) -> str:
        """What models of the e5 family expect before a text."""
        if "e5" not in self.model.lower():
            return ""
        return "query: " if query else "passage: "


def embed(rows: DataFrame, make: Callable[[], Encoder], text: str = "text", query: bool = False, config: EncoderConfig = EncoderConfig(), out: str = "embedding") -> DataFrame:
    """rows with out (array<float>), a column of that name replaced. make() runs once a task, where the model is loaded, and returns the call; null text is empty."""
    c = config
    kept = rows.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call, prefix = make(), c.prefix(query)
        for b in batches:
            texts = [prefix + (t or "") for t in b.column(b.schema.names.index(text)).to_pylist()]
            found = [np.asarray(call(texts[i : i + c.batch]), np.float64) for i in range(0, len(texts), c.batch)]
            if not found:
                continue
            v = np.concatenate(found)
            if c.normalize:
                n = np.sqrt((v * v).sum(1, keepdims=True))
                v = np.divide(v, n, out=v.copy(), where=n > 0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.astype(np.float32).reshape(-1)))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, out])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))]))


def embed_queries(rows: DataFrame, make: Callable[[], Encoder], text: str = "text", config: EncoderConfig = EncoderConfig(), out: str = "embedding") -> DataFrame:
    return embed(rows, make, text, True, config, out)


def hashing_encoder(dims: int = 64, n: int = 3) -> Callable[[], Encoder]:
    """An encoder without a model: counts of character n-grams, dealt over dims by CRC-32."""

    def make() -> Encoder:
        def call(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dims))
            for row, t in zip(out, texts, strict=True):
                for i in range(max(1, len(t) - n + 1)):
                    row[zlib.crc32(t[i : i + n].encode()) % dims] += 1
            return out

        return call

    return make


def hashed() -> Encoder:
    """The hashing encoder as it is; names a plug-in of the command line."""
    return hashing_encoder()()
