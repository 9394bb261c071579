"""Stories, chunks, lexical and vector search, fusion, the chunk store, evaluation and prompts: DataFrame -> DataFrame."""

from . import chunk, encode, evaluate, fusion, lexical, prompt, segment, store, vector

__all__ = ["chunk", "encode", "evaluate", "fusion", "lexical", "prompt", "segment", "store", "vector"]
