"""URL filter by empirical-Bayes host reputation, under fixed rules.

Labelled page outcomes are shrunk down the host tree: a suffix towards the rate of
all pages, a registered domain towards its suffix, a host towards its domain. The
strength of each beta prior is estimated from the spread of the rates at its level
(method of moments). A page is blocked when even the lower posterior bound of its
host's rate of bad pages reaches the limit, so hosts with few labels pass.

Defined results: a null URL, or one without "://", has an empty host and path and is
judged like any host. Pages of a host without labels get the posterior of the domain, or of
the suffix. Repeated rows are judged alike. Other columns are not read.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import written

# Public suffixes of two labels, as fixed values; every other suffix is the last label.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "co.za", "com.br", "co.in")


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Reputation:
    """limit: of the rate of bad pages. z: the bound lies so many deviations below the mean.
    weakest, strongest: of a prior, in pages."""

    limit: float = 0.5
    z: float = 1.645
    weakest: float = 1.0
    strongest: float = 10_000.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path)"""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def host_levels(host: Column) -> tuple[Column, Column]:
    """(suffix, registered domain) of a host."""
    suffix = F.when(F.substring_index(host, ".", -2).isin(*LONG_SUFFIXES), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))
    domain = F.when(F.substring_index(host, ".", -2).isin(*LONG_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))
    return suffix, domain


def strength(groups: DataFrame, how: Reputation) -> float:
    """Strength of the beta prior that fits the spread of the rates of groups (n, k, prior), from one row of sums."""
    v = F.col("prior") * (1 - F.col("prior"))
    row = groups.agg(
        F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.count("*").alias("groups"),
        F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("prior"), F.lit(2))).alias("spread"),
        F.sum(F.col("n") * v).alias("noise"),
    ).first()
    if not row["rows"] or not row["noise"] or row["rows"] == row["squares"] / row["rows"]:
        return how.strongest
    mean_v = row["noise"] / row["rows"]
    between = (row["spread"] - (row["groups"] - 1) * mean_v) / (row["rows"] - row["squares"] / row["rows"]) / mean_v
    return min(max(1 / between - 1, how.weakest), how.strongest) if between > 0 else how.strongest


def _shrunk(n: Column, k: Column, prior: Column, strength_of: float) -> Column:
    return (k + strength_of * prior) / (n + strength_of)


def reputations(hosts: DataFrame, outcomes: DataFrame, how: Reputation = Reputation()) -> DataFrame:
    """(host, labelled, bad_rate, bad_bound) for every row of hosts (host), from outcomes (host, bad).

    Levels are tables of counts; only a level's sums, one row, come to the driver.
    """
    suffix, domain = host_levels(F.col("host"))
    counts = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("int")).alias("k"))
    counts = written(counts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k"), "hosts")
    total = counts.agg(F.sum("k").alias("k"), F.sum("n").alias("n")).first()
    overall = total["k"] / total["n"] if total["n"] else 0.0

    suffixes = counts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("prior", F.lit(overall))
    m = strength(suffixes, how)
    suffixes = suffixes.select("suffix", _shrunk(F.col("n"), F.col("k"), F.col("prior"), m).alias("suffix_rate"))
    domains = counts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains = domains.join(suffixes, "suffix").withColumnRenamed("suffix_rate", "prior")
    m = strength(domains, how)
    domains = domains.select("domain", _shrunk(F.col("n"), F.col("k"), F.col("prior"), m).alias("domain_rate"))
    m = strength(counts.join(domains, "domain").withColumnRenamed("domain_rate", "prior"), how)

    known = (
        hosts.select("host", domain.alias("domain"), suffix.alias("suffix"))
        .join(counts.select("host", "n", "k"), "host", "left").join(domains, "domain", "left").join(suffixes, "suffix", "left")
    )
    n, k = F.coalesce("n", F.lit(0)), F.coalesce("k", F.lit(0))
    rate = _shrunk(n, k, F.coalesce("domain_rate", "suffix_rate", F.lit(overall)), m)
    known = known.select("host", n.alias("labelled"), rate.alias("bad_rate"))
    deviation = F.sqrt(F.col("bad_rate") * (1 - F.col("bad_rate")) / (F.col("labelled") + m + 1))
    return known.withColumn("bad_bound", F.greatest(F.col("bad_rate") - how.z * deviation, F.lit(0.0)))


def judged(pages: DataFrame, outcomes: DataFrame, rules: tuple[UrlRule, ...] = (), how: Reputation = Reputation()) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_rate, bad_bound), one row per row of pages.

    outcomes: (page_id, bad) of labelled pages; a null outcome is no label.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    labelled = rows.join(outcomes.filter("bad is not null").select("page_id", "bad"), "page_id").select("host", "bad")
    known = reputations(rows.select("host").distinct(), labelled, how)
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bad_bound") >= how.limit, "block").otherwise("allow")
    return (
        rows.withColumn("_rule", rule).join(known, "host", "left")
        .select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), method).alias("verdict"),
                "bad_rate", "bad_bound")
    )
