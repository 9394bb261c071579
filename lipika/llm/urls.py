"""URL filters: longest-match rules, and empirical-Bayes reputation of hosts for the rest."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beta_above, stash, table

#: (host, path, verdict) of the query's contract.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class ReputationConfig:
    """A page without a rule is blocked if its host's bad rate exceeds bad_rate with a posterior probability of certainty.

    base: prior (bad, good) pseudo-counts above the suffixes; strength: pseudo-counts that a level hands down where its own spread can't be told (fewer than two children with outcomes), and the least and most handed down.
    generic: labels under which a country's domain (two letters) has registered domains, as in co.uk: with one, the suffix is two labels.
    """

    bad_rate: float = 0.5
    certainty: float = 0.95
    base: tuple[float, float] = (1.0, 1.0)
    strength: float = 4.0
    least: float = 1.0
    most: float = 50.0
    generic: tuple[str, ...] = ("ac", "co", "com", "edu", "go", "gob", "gov", "gouv", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; null or no ://: empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], field: str) -> Column:
    """The longest rule (host plus path; then longest host, then first) that fits, as host/path or as its verdict; else null."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.lit(verdict if field == "verdict" else h + p)
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("string")


def _two_labels(host: Column, generic: Sequence[str]) -> Column:
    """Whether the suffix has two labels, as co.uk."""
    label = F.element_at(F.split(F.substring_index(host, ".", -2), "[.]"), 1)
    return F.substring_index(host, ".", -1).rlike("^[a-z]{2}$") & label.isin(list(generic)) & F.contains(host, F.lit("."))


def suffix_of(host: Column, generic: Sequence[str]) -> Column:
    return F.when(_two_labels(host, generic), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, generic: Sequence[str]) -> Column:
    """The suffix and one more label, or the host where it has no more."""
    return F.when(_two_labels(host, generic), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def bad_page(html: Column, least_words: int = 50, link_share: float = 0.5) -> Column:
    """A page's own outcome where nothing else is known: 1 if its visible text has fewer than least_words words, or more than link_share of them in links; else 0. Null html is bad."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    words = lambda x: F.regexp_count(F.regexp_replace(x, "<[^>]*>", " "), F.lit(r"[^\x20\x09-\x0D]+"))
    links = F.array_join(F.regexp_extract_all(text, F.lit(r"(?is)<a\b[^>]*>(.*?)</a\s*>"), F.lit(1)), " ")
    return F.coalesce(((words(text) < least_words) | (words(links) > link_share * words(text))).cast("int"), F.lit(1))


def _level(children: DataFrame, key: str, prior: DataFrame | None, up: str | None, c: ReputationConfig) -> DataFrame:
    """Posterior mean and strength that each key hands down: own sums shrunk to the parent's mean, strength by the method of moments over the children's rates."""
    rate = F.col("bad") / F.col("n")
    own = children.groupBy(key, *([up] if up else [])).agg(
        F.sum("bad").alias("bad"),
        F.sum("n").alias("n"),
        F.count("*").alias("k"),
        (F.sum(F.col("n") * rate * rate) / F.sum("n") - F.pow(F.sum("bad") / F.sum("n"), 2)).alias("spread"),
        (F.count("*") / F.sum("n")).alias("inv"),
    )
    if prior is None:
        own = own.withColumn("pa", F.lit(c.base[0])).withColumn("pb", F.lit(c.base[1]))
    else:
        own = own.join(prior.select(F.col(up), F.col("ha").alias("pa"), F.col("hb").alias("pb")), up, "left")
    mean = (F.col("bad") + F.col("pa")) / (F.col("n") + F.col("pa") + F.col("pb"))
    bound = F.col("mean") * (1 - F.col("mean"))
    # var of a child's rate = m(1-m)/(s+1) * (1 + s/n), solved for s with 1/n as the children's mean
    s = F.when(F.col("k") < 2, F.lit(c.strength)).when(F.col("spread") <= bound * F.col("inv"), F.lit(c.most)).otherwise((bound - F.col("spread")) / (F.col("spread") - bound * F.col("inv")))
    s = F.least(F.greatest(F.coalesce(s, F.lit(c.strength)), F.lit(c.least)), F.lit(c.most))
    return own.withColumn("mean", mean).withColumn("s", s).withColumn("ha", F.col("mean") * F.col("s")).withColumn("hb", (1 - F.col("mean")) * F.col("s"))


def host_reputation(outcomes: DataFrame, hosts: DataFrame, config: ReputationConfig = ReputationConfig()) -> DataFrame:
    """For every host of hosts: its counts, its posterior Beta(a, b) of the bad rate, and whether the posterior bound calls it bad.

    outcomes: host, bad (0 or 1), a row a labelled page. A host without outcomes has its domain's prior, a domain without its suffix's, a suffix without the base prior.
    Outcomes are summed per host before any other shuffle, so a host with a third of all pages is a few rows.
    """
    c = config
    by_host = outcomes.where("bad is not null").groupBy("host").agg(F.sum(F.col("bad").cast("double")).alias("bad"), F.count("*").cast("double").alias("n"))
    by_host = by_host.withColumn("domain", domain_of(F.col("host"), c.generic)).withColumn("suffix", suffix_of(F.col("host"), c.generic))
    domains = by_host.groupBy("suffix", "domain").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    suffix = stash(_level(domains, "suffix", None, None, c), "suffix")
    domain = stash(_level(by_host, "domain", suffix, "suffix", c), "domain")
    every = hosts.select("host").distinct().withColumn("domain", domain_of(F.col("host"), c.generic)).withColumn("suffix", suffix_of(F.col("host"), c.generic))
    joined = (
        every.join(by_host.select("host", "bad", "n"), "host", "left")
        .join(domain.select("domain", F.col("ha").alias("da"), F.col("hb").alias("db")), "domain", "left")
        .join(suffix.select("suffix", F.col("ha").alias("sa"), F.col("hb").alias("sb")), "suffix", "left")
    )
    a = F.coalesce("da", "sa", F.lit(c.base[0])) + F.coalesce("bad", F.lit(0.0))
    b = F.coalesce("db", "sb", F.lit(c.base[1])) + F.coalesce("n", F.lit(0.0)) - F.coalesce("bad", F.lit(0.0))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, at = np.unique(np.stack([batch.column(i).to_numpy() for i in (2, 3)]), axis=1, return_inverse=True)
            p = beta_above(c.bad_rate, *pairs)[at.reshape(-1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array(p >= c.certainty)], names=[*batch.schema.names, "p_bad", "bad_host"])

    out = joined.select("host", F.coalesce("n", F.lit(0.0)).cast("long").alias("n_labelled"), a.alias("a"), b.alias("b"))
    return out.mapInArrow(judged, "host string, n_labelled long, a double, b double, p_bad double, bad_host boolean")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, labels: DataFrame | None = None, config: ReputationConfig = ReputationConfig()) -> DataFrame:
    """page_id, host, path, rule, verdict, p_bad of every page (page_id, url; html, if there; other columns are left out).

    A page with a rule has its verdict. Any other page is judged by its host's reputation, learnt from labels (page_id, bad). Without labels, every page is an outcome: a ruled one by its rule (block: bad), any other by its own html (bad_page()), or not at all without html.
    Pages without a host (null url, no ://) are one host, '', with its own outcomes. Repeated and null page_ids are judged row by row; of several labels of a page the worst counts. A very long url or html is read whole.
    """
    own = bad_page(F.col("html")) if "html" in pages.columns else F.lit(None).cast("int")
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), *([] if labels is not None else [own.alias("own")]))
    ruled = parsed.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules, "rule")).withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules, "verdict"))
    if labels is None:
        outcomes = ruled.select("host", F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0).otherwise(F.col("own")).alias("bad"))
    else:
        outcomes = parsed.join(labels.groupBy("page_id").agg(F.max("bad").alias("bad")), "page_id").select("host", "bad")
    reputation = stash(host_reputation(outcomes, ruled.where("ruled is null"), config), "reputation")
    out = ruled.drop("own").join(reputation.select("host", "p_bad", "bad_host"), "host", "left")
    verdict = F.coalesce("ruled", F.when(F.col("bad_host"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("ruled").isNull(), F.col("p_bad")).alias("p_bad"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every url of pages: the contract's rules, else host reputation learnt from rules and page texts."""
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
