"""URL filters: explicit rules first, then the reputation of hosts.

Pages that a rule decides are labelled outcomes. A host without enough of its
own is judged by its registered domain, that by its suffix, and that by all
pages: each level's share of allowed pages is the prior mean of the level
below, with a beta-binomial strength estimated from the spread of the rates.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fpindex.llm.scratch import Scratch
from fpindex.operators.joins import hot_join

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Labels that make a suffix of two labels with a country's two letters, below which domains are registered.
REGISTRIES = ("ac", "co", "com", "edu", "gob", "gov", "mil", "ne", "net", "nom", "or", "org")
#: Correlation within a group: bounds of the estimate, and its value without data.
LOWEST, HIGHEST, UNKNOWN = 0.001, 0.5, 0.1
#: A page is blocked if its host's rate lies below the threshold even at the upper bound.
THRESHOLD, DEVIATIONS = 0.5, 1.645


class Rule(NamedTuple):
    """``allow`` or ``block`` for a host with all subdomains, and paths with this head."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rule(verdict: str, text: str) -> Rule:
    """A rule such as ``example.org/es/``: host up to the first slash, then path."""
    if verdict not in ("allow", "block"):
        raise ValueError(f"unknown verdict: {verdict}")
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``path``: empty if the url is null or has no ``://``."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _UPPER.lower())
    return pages.withColumns({"host": host, "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)})


def _first_rule(rules: Sequence[Rule], value: str) -> Column:
    """``text`` or ``verdict`` of the longest rule that fits; of equals the alphabetically first."""
    chain = None
    host, path = F.col("host"), F.col("path")
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text, r.verdict)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        result = F.lit(getattr(rule, value))
        chain = F.when(fits, result) if chain is None else chain.when(fits, result)
    return F.lit(None).cast("string") if chain is None else chain


def long_suffix(registries: Sequence[str] = REGISTRIES) -> str:
    """Regular expression of suffixes of two labels, such as ``co.uk``."""
    return rf"^(?:{'|'.join(registries)})\.[a-z]{{2}}$"


def _levels(host: Column) -> dict[str, Column]:
    last = F.substring_index(host, ".", -1)
    two = F.substring_index(host, ".", -2)
    long = two.rlike(long_suffix())
    suffix = F.when(long, two).otherwise(last)
    domain = F.when(long, F.substring_index(host, ".", -3)).otherwise(two)
    return {"domain": domain, "suffix": suffix}


def _strength(children: DataFrame, parents: DataFrame, key: str) -> float:
    """Weight, in pages, of the parent's rate as a prior of its children.

    The moment estimate of the correlation within children, pooled over all
    parents whose rate is neither 0 nor 1; only its three sums reach the driver.
    """
    m = F.col("g_all") / F.col("n_all")
    both = (
        children.filter("n > 0")
        .join(parents.select(key, F.col("n").alias("n_all"), F.col("good").alias("g_all")), key)
        .filter("g_all > 0 AND g_all < n_all")
    )
    share = F.col("n") / F.col("n_all")
    row = both.agg(
        F.sum(F.col("n") * (F.col("good") / F.col("n") - m) * (F.col("good") / F.col("n") - m) / (m * (1 - m))),
        F.sum(1 - share),
        F.sum(F.col("n") * (1 - share)),
    ).first()
    rho = UNKNOWN
    if row[0] is not None and row[2] > row[1]:
        rho = min(max((row[0] - row[1]) / (row[2] - row[1]), LOWEST), HIGHEST)
    return 1 / rho - 1


def host_reputation(outcomes: DataFrame, scratch: Scratch) -> DataFrame:
    """``host, rate, bound`` from ``outcomes(host, outcome)``, one row per page.

    ``outcome`` is 1 (good), 0 (bad) or null (not labelled). ``rate`` is the
    posterior mean of the share of good pages, ``bound`` its upper bound. With
    no labels at all every rate is one half.
    """
    hosts = scratch.store(
        outcomes.groupBy("host")
        .agg(F.count("outcome").alias("n"), F.coalesce(F.sum("outcome"), F.lit(0)).cast("long").alias("good"))
        .withColumns(_levels(F.col("host")))
    )
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    domains = scratch.store(hosts.groupBy("domain", "suffix").agg(*sums))
    suffixes = scratch.store(domains.groupBy("suffix").agg(*sums).withColumn("every", F.lit(1)))
    every = suffixes.groupBy("every").agg(*sums)
    total = every.first()
    top = F.lit(total["good"] / total["n"] if total and total["n"] else 0.5)

    def shrunk(prior: Column, strength: float) -> Column:
        return (F.col("good") + prior * strength) / (F.col("n") + strength)

    s_host = _strength(hosts, domains, "domain")
    s_domain = _strength(domains, suffixes, "suffix")
    s_suffix = _strength(suffixes, every, "every")
    by_suffix = suffixes.select("suffix", shrunk(top, s_suffix).alias("prior"))
    by_domain = domains.join(by_suffix, "suffix").select(
        "domain", shrunk(F.col("prior"), s_domain).alias("prior")
    )
    rated = hosts.join(by_domain, "domain").select(
        "host", shrunk(F.col("prior"), s_host).alias("rate"), (F.col("n") + s_host).alias("weight")
    )
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("weight") + 1))
    return rated.select("host", "rate", (F.col("rate") + DEVIATIONS * deviation).alias("bound"))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    id: str = "page_id",
    url: str = "url",
    outcome: str | None = None,
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page.

    The longest fitting rule decides and is named in ``rule``; other pages are
    blocked if the posterior bound of their host lies below the threshold.
    ``outcome`` names a column of labels (1 good, 0 bad, null unknown); without
    it the verdicts of the rules are the labels. A url that is null or has no
    ``://`` has empty host and path and is judged like any other. Repeated rows
    give repeated rows; other columns play no part. An empty table gives none.
    """
    scratch = Scratch(pages.sparkSession)
    label = F.col(outcome).cast("int") if outcome else F.lit(None).cast("int")
    parts = with_parts(pages.select(F.col(id).alias("page_id"), F.col(url).alias("url"), label.alias("label")))
    judged = parts.select(
        "page_id", "host", "path", "label",
        _first_rule(rules, "text").alias("rule"), _first_rule(rules, "verdict").alias("ruled"),
    )
    known = F.col("label") if outcome else F.when(F.col("ruled").isNotNull(), (F.col("ruled") == "allow").cast("int"))
    reputation = host_reputation(judged.select("host", known.alias("outcome")), scratch)
    verdict = F.coalesce("ruled", F.when(F.col("bound") < THRESHOLD, "block").otherwise("allow"))
    return hot_join(judged, scratch.store(reputation), "host", "page_id", "left").select(
        "page_id", "host", "path", "rule", verdict.alias("verdict")
    )
