"""Configuration of an index and its search, from a dataclass, a mapping, or a JSON or YAML file."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from typing import Any

from lipika.operators import chunk, encode, lexical, segment


@dataclass(frozen=True)
class SearchConfig:
    """lexical_index, vector_index: whether build() stores these. n_cells, nprobe: of the stored vector index (None: fitted). system, instruction, prefix: parts of the prompt."""

    chunks: chunk.ChunkConfig = field(default_factory=chunk.ChunkConfig)
    titles: segment.TitleRule = field(default_factory=segment.TitleRule)
    bm25: lexical.Bm25Config = field(default_factory=lexical.Bm25Config)
    encoder: encode.EncoderConfig = field(default_factory=encode.EncoderConfig)
    vector_k: int = 50
    n_cells: int | None = None
    nprobe: int | None = None
    w_lexical: float = 0.7
    w_vector: float = 0.3
    min_score: float = 0.1
    top_k: int = 2
    system: str = "You answer questions about the passages you are given."
    instruction: str = "Answer from the passages only."
    prefix: str = ""


def _made(kind: type, given: dict[str, Any], at: str) -> Any:
    fields = {f.name: f for f in dataclasses.fields(kind)}
    unknown = sorted(set(given) - set(fields))
    if unknown:
        raise ValueError(f"unknown setting {at}{unknown[0]}")
    base, out = kind(), {}
    for name, value in given.items():
        now = getattr(base, name)
        if dataclasses.is_dataclass(now):
            if not isinstance(value, dict):
                raise ValueError(f"{at}{name} must be a section")
            out[name] = _made(type(now), value, f"{at}{name}.")
        elif isinstance(now, tuple):
            out[name] = tuple(value)
        elif isinstance(now, bool) != isinstance(value, bool) or isinstance(now, (int, float)) and not isinstance(value, (int, float)) or isinstance(now, str) and not isinstance(value, str):
            raise ValueError(f"{at}{name} must be {type(now).__name__}, not {value!r}")
        else:
            out[name] = value
    return dataclasses.replace(base, **out)


def make_config(given: dict[str, Any], required: tuple[str, ...] = ()) -> SearchConfig:
    """A configuration from a mapping of sections and settings; what it leaves out keeps its default. Unknown or missing required names, values of another kind and impossible numbers raise."""
    for name in required:
        if name not in given:
            raise ValueError(f"missing section {name}")
    return validate(_made(SearchConfig, given, ""))


def validate(c: SearchConfig) -> SearchConfig:
    rules = [
        (c.chunks.child_max > 0 and c.chunks.parent_max >= c.chunks.child_max, "chunks.parent_max must be at least chunks.child_max, and both positive"),
        (c.bm25.n > 0 and c.bm25.k > 0 and c.vector_k > 0 and c.top_k > 0, "bm25.n, bm25.k, vector_k and top_k must be positive"),
        (0 <= c.bm25.b <= 1 and c.bm25.k1 >= 0, "bm25.b must be between 0 and 1, bm25.k1 not negative"),
        (c.w_lexical >= 0 and c.w_vector >= 0 and c.w_lexical + c.w_vector > 0, "weights must not be negative, nor both zero"),
        (c.encoder.batch > 0, "encoder.batch must be positive"),
    ]
    for ok, text in rules:
        if not ok:
            raise ValueError(text)
    return c


def load_config(path: str, required: tuple[str, ...] = ()) -> SearchConfig:
    """From a JSON file, or from a YAML file where PyYAML is installed."""
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            given = yaml.safe_load(f)
        else:
            given = json.load(f)
    if not isinstance(given, dict):
        raise ValueError(f"{path} holds no sections")
    return make_config(given, required)
