"""URL filter: rules, then empirical-Bayes reputation of hosts.

Labelled page outcomes (good or not) are counted by host, registered domain and
public suffix.  Every level is shrunk to the one above through a beta prior:
the suffix to the overall rate, the domain to its suffix, the host to its
domain.  Each level's prior strength is estimated from all its groups by the
moments of the beta-binomial.  A host's posterior is a beta distribution; a host is blocked
when the upper bound of its good rate, mean plus ``Z`` standard deviations, is
below ``LEAST_GOOD``, so hosts without evidence are judged by their domain and
are not blocked on thin evidence.

Rules (``host/path``) come first: a rule fits its host and all subdomains if
the path starts with the rule's; the longest wins.  Rules are a list of the
caller's, tested in one expression; they do not grow with the data.

Null urls, and those without ``://``, have an empty host and path: no rule fits,
and they are judged by the overall rate.  Outcomes without a host count there
too.  With no outcomes at all the rate is 1/2 with strength 2: everything passes.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clarion.llm.common import stored

#: The rules of the registered query.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: Suffixes of two labels; others have one.
LONG_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "org.uk")
Z, LEAST_GOOD = 1.645, 0.5
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1_000.0


def host_of(url: Column) -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return F.translate(F.coalesce(rest, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)), F.lit(""))


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null if none does."""
    text = verdict = F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | F.endswith(host, F.lit("." + rule[:at]))) & F.startswith(path, F.lit(rule[at:]))
        text, verdict = F.when(fits, F.lit(rule)).otherwise(text), F.when(fits, F.lit(says)).otherwise(verdict)
    return text, verdict


def domain_of(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host (without its port)."""
    labels = F.split(F.regexp_replace(host, ":[0-9]*$", ""), r"\.")
    two = F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)))
    parts = F.when(two.isin(*LONG_SUFFIXES), F.lit(2)).otherwise(F.lit(1))
    last = lambda n: F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n))
    return last(parts + 1), last(parts)


def _strength(groups: DataFrame) -> float:
    """Prior strength from groups (good, n) by moments; one row reaches the driver."""
    n, good = F.col("n").cast("double"), F.col("good").cast("double")
    r = groups.where("n > 0").agg(F.count(F.lit(1)).alias("g"), F.sum(n).alias("n"), F.sum(n * n).alias("nn"), F.sum(good).alias("good"), F.sum(good * good / n).alias("gg")).first()
    if not r.g or r.g < 2:
        return MOST_STRENGTH
    p = r.good / r.n
    spread, free = r.gg - r.n * p * p, r.n - r.nn / r.n - (r.g - 1)
    noise = p * (1 - p)
    if noise <= 0 or free <= 0:
        return MOST_STRENGTH
    rho = (spread - noise * (r.g - 1)) / (noise * free)
    return MOST_STRENGTH if rho <= 0 else round(min(MOST_STRENGTH, max(LEAST_STRENGTH, 1 / rho - 1)), 6)


def reputation(hosts: DataFrame) -> DataFrame:
    """``mean`` and ``upper`` of the posterior for rows (host, good, n); one row per host."""
    domain, suffix = domain_of(F.col("host"))
    by_host = hosts.withColumn("domain", domain).withColumn("suffix", suffix)
    by_domain = by_host.groupBy("domain", "suffix").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    k_host, k_domain, k_suffix = (_strength(x) for x in (by_host, by_domain, by_suffix))
    total = by_suffix.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    rate = ((total.good or 0) + 1.0) / ((total.n or 0) + 2.0)
    shrunk = lambda prior, k: (F.col("good") + prior * F.lit(k)) / (F.col("n") + F.lit(k))
    suffixes = by_suffix.select("suffix", shrunk(F.lit(rate), k_suffix).alias("suffix_mean"))
    domains = by_domain.join(suffixes, "suffix").select("domain", shrunk(F.col("suffix_mean"), k_domain).alias("domain_mean"))
    size = F.col("n") + F.lit(k_host)
    mean = shrunk(F.col("domain_mean"), k_host)
    upper = F.col("mean") + F.lit(Z) * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("size") + 1))
    return by_host.join(domains, "domain").withColumn("mean", mean).withColumn("size", size).select("host", "n", "mean", upper.alias("upper"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and reputation for every row of ``pages`` (page_id, url).

    ``outcomes`` (host, good boolean) are the labelled pages.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    seen = outcomes.groupBy("host").agg(F.sum(F.col("good").cast("long")).alias("good"), F.count("good").alias("n"))
    # every host gets a row, labelled or not
    hosts = urls.groupBy("host").agg(F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("n")).unionByName(seen)
    hosts = hosts.groupBy("host").agg(F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.sum("n").alias("n"))
    known = reputation(stored(hosts, "hosts"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    out = urls.join(known, "host")
    return out.select("page_id", "host", "path", rule.alias("rule"),
                      F.coalesce(says, F.when(F.col("upper") < LEAST_GOOD, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
                      F.col("n").alias("labelled"), F.round("mean", 6).alias("good_rate"), F.round("upper", 6).alias("good_upper"))


def outcomes_of(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes of pages whose url ends in the number of a labelled document: good if of quality and not toxic."""
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:[^0-9].*)?$", 1)
    numbered = pages.select(host_of(F.col("url")).alias("host"), F.when(number != "", number.cast("long")).alias("doc"))
    good = F.when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(), (F.col("quality") == 1) & (F.col("toxic") == 0))
    return numbered.join(labels.select(F.col("doc_id").alias("doc"), good.alias("good")).where(F.col("good").isNotNull()), "doc").select("host", "good")
