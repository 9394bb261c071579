"""Quality classifier from positives and unlabelled texts: non-negative unbiased risk, with an estimated class prior.

No labelled negative is ever read. The risk of a scorer g under the logistic loss l is prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]); its minimiser gives the posterior of the positive class by the logistic function. Texts are read once, for a small vector each; every step of the fit is one Spark pass over all these vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_slices, raw, stash, table
from .quality import COUNTS, text_counts

#: Character classes whose shares describe a text; what is in none of them is a class of its own.
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\v\f", b".", b",", b"!?", b"\"'`", b"()[]{}", b"#*$%&@^~", b"<>", b"|", b"=+_/\\", b"-:;")
FEATURES = (*(f"class_{i}" for i in range(len(CLASSES) + 3)), "log_words", "word_chars", "symbols", "dup_lines", "repeats", "words_a_line", "distinct_words", "same_neighbours", "one_char_words", "long_words", "ends_in_stop")


@dataclass(frozen=True)
class PuConfig:
    """threshold: least score of a predicted positive. first_prior: prior of the first fit, whose order of the texts estimates the prior. ridge: least weight of the squared coefficients, ridge_rows: the same of few positives, times their number. softness: how the risk's corner is rounded off, in parts of the root of the positives' number. prior_risk: of the bound by which a threshold's ratio is judged before the best is chosen."""

    threshold: float = 0.7
    first_prior: float = 0.5
    ridge: float = 0.03
    ridge_rows: float = 1.0
    softness: float = 0.5
    rounds: int = 12
    tolerance: float = 1e-5
    bins: int = 4096
    prior_risk: float = 0.1
    fold: int = 4
    held_out: int = 2


@dataclass
class PuModel:
    """score = logistic(weights . (x - mean) / scale + weights[-1]); prior: the estimated share of positives; report: risks of each round."""

    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    prior: float
    report: list[dict] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _logistic(_design((x - self.mean) / self.scale) @ self.weights)


def _logistic(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -500, 500)))


def _design(z: np.ndarray) -> np.ndarray:
    """Standardised features, none further than 8 deviations off, and a constant."""
    return np.hstack([np.clip(z, -8, 8), np.ones((len(z), 1))])


def text_features(texts: list[bytes]) -> np.ndarray:
    """FEATURES of each text, in single precision: roots of the shares of character classes, and measures of words and lines. An empty text has zeros."""
    n = len(texts)
    kinds = np.full(256, len(CLASSES), np.int64)
    kinds[0x80:0xC0], kinds[0xC0:] = len(CLASSES) + 1, len(CLASSES) + 2
    for i, c in enumerate(CLASSES):
        kinds[list(c)] = i
    sizes = np.fromiter(map(len, texts), np.int64, n)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    k = len(CLASSES) + 3
    seen = np.bincount(np.repeat(np.arange(n) * k, sizes) + kinds[flat], minlength=n * k).reshape(n, k).astype(np.float64)
    out = np.zeros((n, len(FEATURES)))
    out[:, :k] = np.sqrt(seen / np.maximum(sizes, 1)[:, None])
    counts = dict(zip(COUNTS, text_counts(texts), strict=True))
    words, lines = np.maximum(counts["n_words"], 1), np.maximum(counts["n_lines"], 1)
    out[:, k] = np.log1p(counts["n_words"])
    out[:, k + 1] = counts["word_chars"] / words
    out[:, k + 2] = np.sqrt(counts["n_symbols"] / np.maximum(counts["word_chars"], 1))
    out[:, k + 3] = counts["n_dup_lines"] / lines
    out[:, k + 4] = counts["n_repeat_words"] / words
    out[:, k + 5] = np.log1p(counts["n_words"] / lines)
    for i, text in enumerate(texts):
        own = text.split()
        if own:
            size = np.fromiter(map(len, own), np.int64, len(own))
            same = sum(a == b for a, b in zip(own, own[1:], strict=False))
            stops = sum(w[-1] in b".!?" for w in own)
            out[i, k + 6 :] = len(set(own)) / len(own), same / len(own), np.mean(size == 1), np.mean(size > 15), stops / len(own)
    return out.astype(np.float32)


def features(docs: DataFrame, name: str = "x") -> DataFrame:
    """docs without text, with text_features() as bytes of single-precision numbers; null text is empty. One pass, no shuffle."""
    kept = [f for f in docs.schema.fields if f.name not in ("text", name)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in batch_slices(batch, batch.schema.names.index("text"))):
            x = text_features(raw(b.column(b.schema.names.index("text"))))
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.names.index(f.name)) for f in kept], pa.array([v.tobytes() for v in x], pa.binary())], names=[*[f.name for f in kept], name])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(name, T.BinaryType())]))


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(len(col), -1).astype(np.float64)


def _summed(rows: DataFrame, part, size: int) -> np.ndarray:
    """The sum over all rows of part(x) -> array of size numbers, x being a batch's vectors: each partition's sum, then 64 sums of partitions, in fixed orders, so that the same input gives the same bits. 64 rows come to the driver."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += part(_matrix(b.column(0)))
        at = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([at % 64]), pa.array([at]), pa.array([total.tobytes()], pa.binary())], names=["lane", "at", "total"])

    def lane(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        total = np.zeros(size)
        for cell in t.column("total").to_pylist():
            total += np.frombuffer(cell)
        return pa.table({"lane": pa.array([t.column("lane")[0].as_py()]), "total": pa.array([total.tobytes()], pa.binary())})

    lanes = rows.select("x").mapInArrow(own, "lane long, at long, total binary").groupBy("lane").applyInArrow(lane, "lane long, total binary")
    out = np.zeros(size)
    for r in sorted(lanes.collect(), key=lambda r: r["lane"]):
        out += np.frombuffer(r["total"])
    return out


def _softplus(g: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, g)


def fit(positive: DataFrame, unlabelled: DataFrame, prior: float, mean: np.ndarray, scale: np.ndarray, c: PuConfig) -> PuModel:
    """The minimiser of the non-negative risk plus the ridge, by damped Newton steps.

    As l(g) - l(-g) = -g, the risk is the larger of two convex functions of the weights (the positives' part, and the unbiased risk), so its minimum is global; the corner between them is rounded off at about the sampling error.
    positive, unlabelled: a column x each. All rows of both count in every pass.
    """
    d = len(mean) + 1

    def slopes(w: np.ndarray, rows: DataFrame) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            z = _design((x - mean) / scale)
            g = z @ w
            s = _logistic(g)
            return np.concatenate([[len(z), _softplus(-g).sum(), _softplus(g).sum()], z.sum(0), s @ z, ((z * (s * (1 - s))[:, None]).T @ z).ravel()])

        got = _summed(rows, part, 3 + 2 * d + d * d)
        return np.concatenate([got[:1], got[1:] / max(got[0], 1)])

    def risks(ws: np.ndarray, rows: DataFrame) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            g = _design((x - mean) / scale) @ ws.T
            return np.concatenate([[len(x)], _softplus(-g).sum(0), _softplus(g).sum(0)])

        got = _summed(rows, part, 1 + 2 * len(ws))
        return (got[1:] / max(got[0], 1)).reshape(2, -1)

    w = np.zeros(d)
    p, u = slopes(w, positive), slopes(w, unlabelled)
    penalty = np.full(d, max(c.ridge, c.ridge_rows / max(p[0], 1)))
    penalty[-1] = 0
    # max(0, v), rounded off at about the sampling error of v; convex and increasing like it
    soft = c.softness / max(p[0], 1) ** 0.5
    objective = lambda p, u, w: prior * p[0] + soft * _softplus((u[1] - prior * p[1]) / soft) + ((w * w) @ penalty) / 2
    report: list[dict] = []
    for _ in range(c.rounds):
        (px, ps, ph), (_, us, uh) = ((x[3 : 3 + d], x[3 + d : 3 + 2 * d], x[3 + 2 * d :].reshape(d, d)) for x in (p, u))
        negative = u[2] - prior * p[2]
        share, rise = _logistic(np.array(negative / soft)), us - prior * ps
        grad = prior * (ps - px) + share * rise
        hess = prior * (1 - share) * ph + share * uh + share * (1 - share) / soft * np.outer(rise, rise)
        now = float(objective(p[1:3], u[1:3], w))
        report.append({"risk": now, "negative": float(negative), "prior": prior})
        step = np.linalg.solve(hess + np.diag(penalty + 1e-9), grad + penalty * w)
        tried = w - step[None, :] * 0.5 ** np.arange(8)[:, None]
        values = np.array([objective(a, b, x) for a, b, x in zip(risks(tried, positive).T, risks(tried, unlabelled).T, tried, strict=True)])
        best = int(values.argmin())
        if not values[best] < now:
            break
        w = tried[best]
        if now - values[best] < c.tolerance:
            break
        p, u = slopes(w, positive), slopes(w, unlabelled)
    return PuModel(w, mean, scale, prior, report)


def estimate_prior(positive: DataFrame, unlabelled: DataFrame, model: PuModel, c: PuConfig) -> float:
    """The share of positives among the unlabelled: over a threshold t lie U(t) of the unlabelled and P(t) of the positives, so the share is U(t) / P(t) at most, and just that where no negative lies over t. The threshold with the least upper bound of the ratio is taken.

    All rows of both are counted, in c.bins bins of the score.
    """

    def part(x: np.ndarray) -> np.ndarray:
        # bins by the order of the log-odds, so that none holds most of one class
        g = np.clip(_design((x - model.mean) / model.scale) @ model.weights, -16, 16)
        return np.bincount(((g + 16) / 32 * (c.bins - 1)).astype(np.int64), minlength=c.bins).astype(np.float64)

    over = [np.cumsum(_summed(rows, part, c.bins)[::-1]) for rows in (positive, unlabelled)]
    n_p, n_u = over[0][-1], over[1][-1]
    if not n_p or not n_u:
        return c.first_prior
    p, u = over[0] / n_p, over[1] / n_u
    # how far an empirical distribution can be off anywhere (Dvoretzky, Kiefer and Wolfowitz), for both together
    off = sum(np.sqrt(np.log(4 / c.prior_risk) / (2 * n)) for n in (n_p, n_u))
    good = p > 0
    ratio = np.where(good, u / np.maximum(p, 1e-12), np.inf)
    at = int(np.argmin(np.where(good, ratio + off / np.maximum(p, 1e-12), np.inf)))
    return float(np.clip(ratio[at], 0.01, 0.99))


def train(vectors: DataFrame, positives: DataFrame, c: PuConfig = PuConfig()) -> PuModel | None:
    """A model from vectors (doc_id, x; the unlabelled, all of them) and positives (doc_id), which are found among them; None without any. Ids that are null or not among the vectors count for nothing; a row of vectors whose doc_id repeats counts as often as it is there."""
    trusted = stash(vectors.join(positives.where("doc_id is not null").select("doc_id").distinct(), "doc_id", "left_semi").select("x"), "positives")
    if trusted.isEmpty():
        return None
    d = len(FEATURES)
    got = _summed(vectors, lambda x: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), 1 + 2 * d)
    mean = got[1 : 1 + d] / got[0]
    scale = np.sqrt(np.maximum(got[1 + d :] / got[0] - mean**2, 0))
    scale[scale < 1e-9] = 1
    # one half of the texts orders the other: a scorer rates the rows it was fitted on too well
    half = F.pmod(F.xxhash64("x"), F.lit(2))
    first = fit(trusted.where(half == 0), vectors.where(half == 0), c.first_prior, mean, scale, c)
    prior = estimate_prior(trusted.where(half == 1), vectors.where(half == 1), first, c)
    return fit(trusted, vectors, prior, mean, scale, c)


def held_out(doc_id: Column, c: PuConfig = PuConfig()) -> Column:
    """Whether a document's label must not be learnt from; a null doc_id is never held out (it can have no label)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % c.fold == c.held_out, F.lit(False))


def scored(vectors: DataFrame, model: PuModel | None, name: str = "score") -> DataFrame:
    """vectors with the model's score instead of x; without a model every score is 0.5."""
    if model is None:
        return vectors.withColumn(name, F.lit(0.5)).drop("x")
    kept = [f for f in vectors.schema.fields if f.name not in ("x", name)]
    m = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(b.schema.names.index("x"))) if b.num_rows else np.zeros((0, len(m.mean)))
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.names.index(f.name)) for f in kept], pa.array(m.scores(x))], names=[*[f.name for f in kept], name])

    return vectors.mapInArrow(run, T.StructType([*kept, T.StructField(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, config: PuConfig = PuConfig(), report: dict | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text); other columns are left out, and none but text has a part in a score.

    labels: doc_id, quality. Trusted positives are documents not held out with a label of quality 1 (any of them, if labels conflict); every other label, null or 0, is not looked at. The unlabelled are all rows not held out. Null text is empty, and empty texts get a score too; null and repeated doc_ids keep their rows; equal texts have equal scores. Without positives every score is 0.5. An empty table gives an empty one.
    report, if given, gets the prior and the rounds' risks.
    """
    c = config
    vectors = stash(features(docs.select(F.col("doc_id").cast("long"), "text")).withColumn("held_out", held_out(F.col("doc_id"), c)), "features")
    model = train(vectors.where(~F.col("held_out")), labels.where("quality = 1"), c)
    if report is not None and model is not None:
        report |= {"prior": model.prior, "rounds": model.report, "weights": dict(zip((*FEATURES, "constant"), model.weights.tolist(), strict=True))}
    return scored(vectors, model).select("doc_id", "held_out", "score", (F.col("score") >= c.threshold).cast("int").alias("predicted"))


def op11_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, from trusted positives and unlabelled texts."""
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
