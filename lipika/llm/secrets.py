"""Secret scans: format rules and sliding-window Shannon entropy over candidate strings, all in native expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPAN = "array<struct<kind:string,rank:int,start:int,end:int>>"
#: Keywords whose letters count in either case.
ASSIGN = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: A match is a maximal run from its start, so a least length in the pattern drops just those that fail it.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"


@dataclass(frozen=True)
class EntropyClass:
    """Candidates: maximal runs of chars, least characters long or more. Flagged: windows of so many characters with an entropy of bits or more."""

    name: str
    chars: str
    pattern: str
    must: str
    least: int
    window: int
    bits: float


@dataclass(frozen=True)
class SecretConfig:
    classes: tuple[EntropyClass, ...] = (
        EntropyClass("hexcase", "0123456789ABCDEFabcdef", r"[0-9A-Fa-f]", r"^(?=.*[0-9])(?=.*[A-Fa-f])", 20, 20, 3.0),
        EntropyClass("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", r"[A-Za-z0-9+/_=-]", r"^(?=.*[A-Z])(?=.*[a-z])(?=.*[0-9])", 20, 20, 3.8),
        EntropyClass("lower", "abcdefghijklmnopqrstuvwxyz0123456789", r"[a-z0-9]", r"^(?=.*[a-z])(?=.*[0-9])", 20, 20, 3.6),
        EntropyClass("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", r"[A-Z0-9]", r"^(?=.*[A-Z])(?=.*[0-9])", 20, 20, 3.6),
    )
    #: The shortest rest of an entropy span that a base span cuts off.
    rest: int = 8
    #: A candidate that fits one of these is no secret.
    allow: tuple[str, ...] = (r"(?i)example|sample|dummy|placeholder|changeme", r"(.)\1{7,}", r"(?i)0123456789|abcdefghij", r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")


def _between(text: Column, pattern: str, kind: str, rank: int, group: int = 0, least: int = 0) -> Column:
    """Spans of all leftmost non-overlapping matches: gaps (split) and matches alternate, so running lengths give the places."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(found.alias("m"), (F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found).alias("g"), F.slice(gaps, 1, F.size(found)).alias("gap"))
    named = F.transform(parts, lambda p: F.struct(F.length(p["gap"]).alias("gap"), F.length(p["m"]).alias("m"), F.length(p["g"]).alias("g")))
    none = F.array().cast(SPAN)
    walked = F.aggregate(
        named,
        F.struct(F.lit(0).alias("at"), none.alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + p["gap"] + p["m"]).alias("at"),
            F.when(p["g"] >= least, F.concat(s["spans"], F.array(F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), (s["at"] + p["gap"]).alias("start"), (s["at"] + p["gap"] + p["m"]).alias("end"))))).otherwise(s["spans"]).alias("spans"),
        ),
    )["spans"]
    return F.when(text.rlike(pattern), walked).otherwise(none)


def _flagged(s: Column, c: EntropyClass) -> Column:
    """First and last end of the windows of s whose entropy reaches c.bits (0, 0: none).

    One fold over the characters: counts of each character and the sum of n*log2(n) change by the one that comes and the one that goes.
    """
    w, size = c.window, len(c.chars)
    goal = w * (F.log2(F.lit(float(w))) - F.lit(c.bits)) + 1e-9  # the sum at which entropy = log2(w) - sum / w is just bits
    term = lambda n: F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(0.0)

    def step(a: Column, x: Column) -> Column:
        n_in, n_out = F.get(a["n"], x["come"]), F.get(a["n"], x["go"])
        same = x["come"] == x["go"]
        total = F.when(same, a["sum"]).otherwise(a["sum"] + term(n_in + 1) - term(n_in) + F.when(x["go"] >= 0, term(n_out - 1) - term(n_out)).otherwise(0.0))
        counts = F.when(same, a["n"]).otherwise(F.transform(a["n"], lambda v, j: v + F.when(j == x["come"], 1).otherwise(0) - F.when(j == x["go"], 1).otherwise(0)))
        hit = (x["i"] >= w) & (total <= goal)
        return F.struct(counts.alias("n"), total.alias("sum"), F.when(hit & (a["first"] == 0), x["i"]).otherwise(a["first"]).alias("first"), F.when(hit, x["i"]).otherwise(a["last"]).alias("last"))

    places = F.transform(F.split(s, "(?!^)"), lambda ch: F.position(ch, F.lit(c.chars)) - 1)
    pairs = F.arrays_zip(places.alias("a"), F.concat(F.array_repeat(F.lit(-1), w), places).alias("b"))
    rows = F.transform(F.slice(pairs, 1, F.length(s)), lambda p, i: F.struct(p["a"].alias("come"), p["b"].alias("go"), (i + 1).alias("i")))
    start = F.struct(F.array_repeat(F.lit(0), size).alias("n"), F.lit(0.0).alias("sum"), F.lit(0).alias("first"), F.lit(0).alias("last"))
    return F.aggregate(rows, start, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))


def _entropy(text: Column, c: EntropyClass, allow: tuple[str, ...], rank: int) -> Column:
    """Spans of class c: of each candidate that is not allow-listed, from the first flagged window to the end of the last."""
    pattern = f"{c.pattern}{{{c.least},}}"
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("gap"))
    none = F.array().cast(SPAN)

    def wanted(m: Column) -> Column:
        ok = m.rlike(c.must)
        for p in allow:
            ok = ok & ~m.rlike(p)
        return ok

    at = F.transform(parts, lambda p: F.struct(p["m"].alias("m"), F.length(p["gap"]).alias("gap"), F.length(p["m"]).alias("len")))
    walked = F.aggregate(
        at,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<m:string,start:int>>").alias("c")),
        lambda s, p: F.struct((s["at"] + p["gap"] + p["len"]).alias("at"), F.when(wanted(p["m"]), F.concat(s["c"], F.array(F.struct(p["m"].alias("m"), (s["at"] + p["gap"]).alias("start"))))).otherwise(s["c"]).alias("c")),
    )["c"]
    judged = F.transform(walked, lambda p: F.struct(p["start"].alias("start"), _flagged(p["m"], c).alias("f")))
    spans = F.transform(F.filter(judged, lambda p: p["f"]["last"] > 0), lambda p: F.struct(F.lit(c.name).alias("kind"), F.lit(rank).alias("rank"), (p["start"] + p["f"]["first"] - c.window).alias("start"), (p["start"] + p["f"]["last"]).alias("end")))
    return F.when(text.rlike(pattern), spans).otherwise(none)


def scan_secrets(docs: DataFrame, text: str = "text", config: SecretConfig = SecretConfig(), names: tuple[str, str] = ("base_spans", "spans")) -> DataFrame:
    """docs with two arrays, by the names given: base spans and all spans, of (kind, rank, start, end) in code points, end exclusive, by start, then rank.

    Base spans are matches of the three formats; all spans adds high-entropy windows, less what base spans cover of them; one that lies within a window of an earlier class is left out.
    Null or empty text has no spans, repeated rows and null doc_ids are rows like others; all other columns stay, but columns of the names given are replaced. No shuffle, no Python: one pass over each text.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    order = lambda x: F.transform(F.array_sort(F.transform(x, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: F.struct(s["kind"].alias("kind"), s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end")))
    base = F.concat(_between(t, ASSIGN, "assign", 0, 2, 6), _between(t, ACCESS, "access", 1), _between(t, HEX, "hex", 2))
    more = F.concat(*[_entropy(t, c, config.allow, 3 + i) for i, c in enumerate(config.classes)])
    found = docs.withColumn("_lipika_base", base).withColumn("_lipika_more", more)
    sorted_ = found.withColumn("_lipika_base", order(F.col("_lipika_base")))
    # what lies within a span of an earlier class is known already
    within = lambda s: F.exists("_lipika_more", lambda x: (x["rank"] < s["rank"]) & (x["start"] <= s["start"]) & (s["end"] <= x["end"]))
    rest = F.flatten(F.transform(F.filter("_lipika_more", lambda s: ~within(s)), lambda s: _less(s, F.col("_lipika_base"), config.rest)))
    return sorted_.withColumn(names[1], F.when(F.size("_lipika_more") == 0, F.col("_lipika_base")).otherwise(order(F.concat(F.col("_lipika_base"), rest)))).withColumn(names[0], F.col("_lipika_base")).drop("_lipika_base", "_lipika_more")


def _less(span: Column, base: Column, least: int) -> Column:
    """Parts of an entropy span that no base span (by start) covers: the span itself if none touches it, else those of least characters or more."""
    part = lambda a, z: F.array(F.struct(span["kind"].alias("kind"), span["rank"].alias("rank"), a.alias("start"), z.alias("end")))

    def step(x: Column, b: Column) -> Column:
        touches = (b["start"] < span["end"]) & (b["end"] > x["at"])
        before = touches & (b["start"] - x["at"] >= least)
        return F.struct(F.when(touches, F.greatest(x["at"], b["end"])).otherwise(x["at"]).alias("at"), F.when(before, F.concat(x["out"], part(x["at"], b["start"]))).otherwise(x["out"]).alias("out"))

    def end(x: Column) -> Column:
        whole = (x["at"] == span["start"]) | (span["end"] - x["at"] >= least)
        return F.when(whole, F.concat(x["out"], part(x["at"], span["end"]))).otherwise(x["out"])

    return F.aggregate(base, F.struct(span["start"].alias("at"), F.array().cast(SPAN).alias("out")), step, end)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """text with each run of overlapping spans replaced by mark."""
    state = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda s, p: F.struct(F.when(p["start"] >= s["at"], F.concat(s["out"], F.substring(text, s["at"] + 1, p["start"] - s["at"]), F.lit(mark))).otherwise(s["out"]).alias("out"), F.greatest(s["at"], p["end"]).alias("at")),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(state["out"], F.substring(text, state["at"] + 1, F.lit(2147483647))))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text of documents: counts of the base kinds, a digest of their spans, and all spans."""
    docs = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return docs.select("doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")], F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
