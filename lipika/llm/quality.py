"""Quality rules: base counts of a text, and risk-controlled cutoffs learnt from labelled documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_slices, binomial_upper, raw, stash, table

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"


@dataclass(frozen=True)
class Rule:
    """Rejects a document whose ratio is over (under, if low) a cutoff from grid; grid goes from lenient to strict."""

    name: str
    top: str
    bottom: str
    low: bool
    grid: tuple[float, ...]


def _steps(first: float, last: float, n: int = 40) -> tuple[float, ...]:
    return tuple(float(x) for x in np.round(np.geomspace(first, last, n), 6))


@dataclass(frozen=True)
class QualityConfig:
    """false_rejection: most good documents of a stratum that all its cutoffs together may reject, with a probability of 1 - risk over all strata together. A stratum with too few labels for that is held to the least share that its labels can certify if no holdout is rejected, loosest at most; with fewer labels still it has no cutoff."""

    false_rejection: float = 0.02
    loosest: float = 0.1
    risk: float = 0.05
    min_words: int = 50
    repeat_percent: int = 50
    rules: tuple[Rule, ...] = (
        Rule("symbols", "n_symbols", "word_chars", False, _steps(1.0, 0.005)),
        Rule("dup_lines", "n_dup_lines", "n_lines", False, _steps(1.0, 0.02)),
        Rule("repeats", "n_repeat_words", "n_words", False, _steps(0.5, 0.01)),
        Rule("long_words", "word_chars", "n_words", False, _steps(40.0, 6.0)),
        Rule("short_words", "word_chars", "n_words", True, _steps(1.0, 5.0)),
    )


def text_counts(texts: list[bytes]) -> list[np.ndarray]:
    """COUNTS of each text, an int64 array each."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    flat = np.frombuffer(b"".join(texts), np.uint8)

    def of(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[flat], dtype=np.int64)])
        return total[ends] - total[ends - sizes]

    chars = np.ones(256, np.uint8)
    chars[0x80:0xC0] = 0
    chars[list(SPACES)] = 0
    symbols = np.zeros(256, np.uint8)
    symbols[list(SYMBOLS)] = 1
    n = np.zeros((4, len(texts)), np.int64)
    for i, text in enumerate(texts):
        words = text.split()
        lines = [x for x in text.split(b"\n") if x and not x.isspace()]
        windows = list(zip(words, words[1:], words[2:], strict=False))
        repeated = 0
        if len(set(windows)) < len(windows):
            seen: dict = {}
            same = np.fromiter((seen.setdefault(x, k) for k, x in enumerate(windows)), np.int64, len(windows))
            often = np.bincount(same)[same] > 1
            covered = np.zeros(len(words), bool)
            for k in range(3):
                covered[k : k + len(windows)] |= often
            repeated = int(covered.sum())
        n[:, i] = len(words), len(lines) - len(set(lines)), repeated, len(lines)
    return [n[0], of(chars), of(symbols), n[1], n[2], n[3]]


def measure(docs: DataFrame, name: str = "counts") -> DataFrame:
    """docs with a struct of COUNTS; null and empty texts count zero. One pass, no shuffle; all other columns stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in batch_slices(batch, batch.schema.names.index("text"))):
            got = text_counts(raw(b.column(b.schema.names.index("text"))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.StructArray.from_arrays([pa.array(x) for x in got], names=list(COUNTS))], names=[*b.schema.names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))])
    return docs.mapInArrow(run, schema)


def base_failed(counts: str, c: QualityConfig) -> Column:
    n = F.col(f"{counts}.n_words")
    return (n < c.min_words) | (100 * F.col(f"{counts}.n_repeat_words") > c.repeat_percent * n)


def stratum(docs: DataFrame, c: QualityConfig) -> Column:
    """lang, whatever it is; null, and tables without the column: ''."""
    return F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")


def _ratio(counts: str, rule: Rule) -> Column:
    return F.col(f"{counts}.{rule.top}") / F.greatest(F.col(f"{counts}.{rule.bottom}"), F.lit(1))


def _beaten(rule: Rule, counts: str) -> Column:
    ratio = _ratio(counts, rule)
    return F.filter(F.array(*[F.lit(g) for g in rule.grid]), (lambda g: ratio < g) if rule.low else (lambda g: ratio > g))


def _path(bad: np.ndarray, plain: np.ndarray) -> list[tuple[int, int]]:
    """Moves (rule, level) from lenient to strict, a rule's level being the number of its cutoffs passed: each time the one that rejects most bad documents for each unlabelled one.

    bad, plain: documents by rule and by the level that rejects them first. No good label has a part in it.
    """
    at, out = [0] * len(bad), []
    while True:
        best = None
        for r in range(len(bad)):
            gain, cost = (np.cumsum(x[r, at[r] + 1 :]) for x in (bad, plain))
            for k in np.nonzero(np.diff(gain, prepend=0))[0]:
                # without unlabelled documents, for each step of the grid
                score = gain[k] / (cost[k] + 1 if plain.any() else k + 1)
                if best is None or score > best[0]:
                    best = (score, r, at[r] + 1 + int(k))
        if best is None:
            return out
        at[best[1]] = best[2]
        out.append(best[1:])


def least_labels(c: QualityConfig, strata: int = 1, share: float | None = None) -> int:
    """The fewest labelled good documents with which a cutoff that rejects none of them can be certified for that share, where strata share the risk."""
    return int(np.ceil(np.log(c.risk / strata) / np.log(1 - (share or c.false_rejection))))


def promised(holdouts: dict[str, int], c: QualityConfig) -> dict[str, tuple[float, float]]:
    """(share of good documents that may be rejected, risk) of each stratum that can have cutoffs, from the numbers of holdouts alone. Strata that could not be certified even if they had all the risk do not share it."""
    able = [s for s, n in holdouts.items() if n >= least_labels(c, 1, c.loosest)]
    out = {}
    for s in able:
        risk = c.risk / len(able)
        share = max(c.false_rejection, 1 - risk ** (1 / holdouts[s]))
        if share <= c.loosest:
            out[s] = (share, risk)
    return out


def fit_cutoffs(measured: DataFrame, labels: DataFrame, c: QualityConfig = QualityConfig(), counts: str = "counts") -> dict[tuple[str, str], float]:
    """The strictest certified cutoffs of each (stratum, rule); none where no cutoff can be certified.

    Labelled good documents (quality 1; of conflicting labels the best counts) that pass the base rules are the holdout of their stratum; all rules of a stratum are certified together, by its own holdouts alone. One sequence of moves, each of which makes one rule stricter, is chosen from the stratum's labelled bad and unlabelled documents (without bad ones: all rules in turn), and the sequence ends before the first at which the Clopper-Pearson bound of the rate of holdouts that any rule rejects exceeds what is promised(): in a fixed sequence, that needs no correction among cutoffs or rules. Strata share risk (Bonferroni).
    Only counts per stratum with enough holdouts, rule and grid cell, and per stratum and move, come to the driver.
    """
    best = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # hit: the number of cutoffs that reject this document, those of the strict end
    hits = F.array(*[F.size(_beaten(r, counts)) for r in c.rules])
    judged = measured.where(~base_failed(counts, c)).select("doc_id", stratum(measured, c).alias("stratum"), hits.alias("hits")).join(best, "doc_id", "left")
    good = judged.where("quality = 1").groupBy("stratum").agg(F.count("*").alias("n"))
    holdouts = {r["stratum"]: r["n"] for r in good.where(F.col("n") >= least_labels(c, 1, c.loosest)).collect()}
    levels = promised(holdouts, c)
    if not levels:
        return {}
    judged = judged.where(F.col("stratum").isin(list(levels)))
    rows = judged.select("stratum", "quality", F.posexplode("hits").alias("rule", "hit")).groupBy("stratum", "quality", "rule", "hit").count().collect()
    most = max(len(r.grid) for r in c.rules)
    paths = {}
    for s in levels:
        seen = {q: np.zeros((len(c.rules), most + 1), np.int64) for q in (0, None)}
        for x in rows:
            if x["stratum"] == s and x["quality"] in seen and x["hit"]:
                seen[x["quality"]][x["rule"], len(c.rules[x["rule"]].grid) - x["hit"] + 1] += x["count"]
        paths[s] = _path(seen[0], seen[None]) or [(r, i) for i in range(1, most + 1) for r in range(len(c.rules)) if i <= len(c.rules[r].grid)]
    # the first move that rejects a holdout, by stratum, rule and hit
    first = {}
    for s, path in paths.items():
        for r, rule in enumerate(c.rules):
            reached = lambda level, r=r, path=path: next((i for i, (x, n) in enumerate(path) if x == r and n >= level), len(path))
            first[s, r] = [len(path), *[reached(len(rule.grid) - h + 1) for h in range(1, len(rule.grid) + 1)]]
    moves = F.coalesce(*[F.when(F.col("stratum") == s, F.least(*[F.get(F.array(*[F.lit(x) for x in first[s, r]]), F.col("hits")[r]) for r in range(len(c.rules))])) for s in paths])
    falls = judged.where("quality = 1").select("stratum", moves.alias("move")).groupBy("stratum", "move").count().collect()
    cutoffs: dict[tuple[str, str], float] = {}
    for s, path in paths.items():
        share, risk = levels[s]
        by = {x["move"]: x["count"] for x in falls if x["stratum"] == s}
        total, rejected = sum(by.values()), 0
        for i, (r, level) in enumerate(path):
            rejected += by.get(i, 0)
            # a share of its own is met by no rejection exactly, up to rounding
            if binomial_upper(rejected, total, risk) > share + 1e-9:
                break
            cutoffs[s, c.rules[r].name] = c.rules[r].grid[level - 1]
    return cutoffs


def rejected_by(cutoffs: dict[tuple[str, str], float], of: Column, c: QualityConfig = QualityConfig(), counts: str = "counts") -> Column:
    """Names of the rules whose cutoff for the stratum rejects the document."""
    hits = []
    for r in c.rules:
        out = None
        for s in sorted({x for x, _ in cutoffs}):
            if (s, r.name) in cutoffs:
                x = F.lit(cutoffs[s, r.name])
                test = _ratio(counts, r) < x if r.low else _ratio(counts, r) > x
                out = F.when(of == s, test) if out is None else out.when(of == s, test)
        if out is not None:
            hits.append(F.when(out, F.lit(r.name)))
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def judge_quality(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig(), name: str = "_quality") -> DataFrame:
    """docs with a struct of counts, base_failed, rejected_by and kept. Texts are read twice (fit, verdict) and never shuffled.

    Null text counts as no words and fails the base rules; unlabelled documents are judged like any other; without good labels only the base rules reject. All columns of docs stay as they are, but one called name is replaced.
    """
    few = docs.select("doc_id", *[x for x in ("lang",) if x in docs.columns], "text")
    cutoffs = fit_cutoffs(measure(few).drop("text"), labels, config)
    out = measure(docs.drop(name), name)
    failed, rejected = base_failed(name, config), rejected_by(cutoffs, stratum(docs, config), config, name)
    return out.withColumn(name, F.struct(*[F.col(f"{name}.{c}").alias(c) for c in COUNTS], failed.alias("base_failed"), rejected.alias("rejected_by"), (~failed & (F.size(rejected) == 0)).alias("kept")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; the counts are written once, without texts, for both the fit and the verdict."""
    c = QualityConfig()
    measured = stash(measure(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).drop("text"), "counts")
    cutoffs = fit_cutoffs(measured, table(spark, sf_dir, "labels").select("doc_id", "quality"), c)
    failed, rejected = base_failed("counts", c), rejected_by(cutoffs, stratum(measured, c), c)
    return measured.select("doc_id", *[F.col(f"counts.{x}").alias(x) for x in COUNTS[:5]], failed.alias("base_failed"), (~failed & (F.size(rejected) == 0)).alias("kept"), F.array_join(rejected, ",").alias("rejected_by"))
