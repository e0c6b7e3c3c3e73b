"""URL filters by rules and empirical-Bayes host reputation, in DataFrame functions alone.

Labelled page outcomes (bad or not) are counted by host.  Rates are shrunk along suffix, registered domain
and host: each level's posterior mean is the prior mean of the level below, and each level's prior
strength comes from the moments of its beta-binomial counts.  A host is blocked where the lower bound of its
posterior bad rate lies above the threshold.  A rule that fits a url overrides the reputation.

Suffixes are the last label, or the last two where a country's two letters follow one of SECOND_LEVEL; the registered domain has one
label more.  The bound is the posterior mean less z posterior standard deviations.

Scale: pages are parsed once for counts by host and once for the result, and reduced to counts before any level meets another; only sums by
level reach the driver.  Counts and reputations by host are stored, so that the join of pages with a very common host can be split.

Defined results: a null url or one without ``://`` has empty host and path and no rule, and is judged by the
empty host's outcomes; labels repeated for a page count once, as bad if one of them is; pages repeated under one
id each give a row; a null id has no outcome; a page without outcome counts in no rate; with no outcome at all nothing is blocked but by rule;
of rules of one length the first by text wins; an empty table gives no rows; a url of any length is parsed whole; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.scratch import stored

#: Labels below which countries register domains.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, else nulls."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, on, start in reversed(ordered):
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(start)
        text, verdict = F.when(fits, on + start).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def prior_strength(level: DataFrame, least: float = 1.0, most: float = 1000.0) -> float:
    """Prior observations from the moments of beta-binomial counts (n, bad) of a level's groups."""
    labelled = level.filter("n > 0")
    k, n, bad, squares, spread = labelled.agg(F.count("*"), F.sum("n"), F.sum("bad"), F.sum(F.col("n").cast("double") * F.col("n")), F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n"))).first()
    if not k or k < 2 or bad in (0, n):
        return most
    mean = bad / n
    room = mean * (1 - mean) * (n - squares / n - (k - 1))
    rho = (spread - mean * mean * n - mean * (1 - mean) * (k - 1)) / room if room > 0 else 0.0
    return most if rho <= 0 else min(most, max(least, (1 - rho) / rho))


def reputations(hosts: DataFrame, z: float = 1.645, threshold: float = 0.5) -> DataFrame:
    """(host, lower, blocked) from counts (host, n, bad); hosts without outcome get their domain's rate."""
    last, before = F.substring_index("host", ".", -1), F.substring_index(F.substring_index("host", ".", -2), ".", 1)
    two = F.col("host").contains(".") & last.rlike("^[a-z][a-z]$") & before.isin(*SECOND_LEVEL)
    labelled = hosts.withColumn("domain", F.when(two, F.substring_index("host", ".", -3)).otherwise(F.substring_index("host", ".", -2)))
    labelled = labelled.withColumn("suffix", F.when(two, F.substring_index("host", ".", -2)).otherwise(last))
    domains = labelled.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total, all_bad = (x or 0 for x in suffixes.agg(F.sum("n"), F.sum("bad")).first())
    k_suffix, k_domain, k_host = prior_strength(suffixes), prior_strength(domains), prior_strength(hosts)
    base = (all_bad + 1) / (total + 2)
    s = suffixes.select("suffix", ((F.lit(k_suffix * base) + F.col("bad")) / (F.lit(k_suffix) + F.col("n"))).alias("mean_s"))
    d = domains.join(s, "suffix").select("domain", ((F.lit(k_domain) * F.col("mean_s") + F.col("bad")) / (F.lit(k_domain) + F.col("n"))).alias("mean_d"))
    weight = F.lit(k_host) + F.col("n")
    h = labelled.join(d, "domain").select("host", "n", ((F.lit(k_host) * F.col("mean_d") + F.col("bad")) / weight).alias("mean"), weight.alias("weight"))
    lower = F.col("mean") - F.lit(z) * F.sqrt(F.col("mean") * (F.lit(1.0) - F.col("mean")) / (F.col("weight") + F.lit(1.0)))
    return h.select("host", lower.alias("lower"), (lower > threshold).alias("blocked"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, z: float = 1.645, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, lower of every page; ``outcomes`` has page_id and bad (boolean)."""
    host, path = url_parts(F.col("url").cast("string"))
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    once = outcomes.filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    counted = parsed.select("page_id", "host").join(once, "page_id", "left")
    hosts = stored(counted.groupBy("host").agg(F.count("bad").alias("n"), F.count_if("bad").alias("bad")), "hosts")
    known = stored(reputations(hosts, z, threshold), "reputations")
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = parsed.join(known, "host", "left")
    method = F.when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "lower")
