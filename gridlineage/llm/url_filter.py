"""URL filter: rules first, then empirical-Bayes host reputation; DataFrame functions only.

Labelled page outcomes are counted by host, registered domain and suffix.  Each level's
children get a beta prior whose mean is the parent's posterior mean and whose strength is
fitted by moments to how much siblings differ beyond binomial noise.  A page is blocked
where the lower bound of its host's posterior bad rate is above LIMIT.  Unseen hosts fall
back on their domain, then their suffix, then all outcomes: the first of these that has
outcomes decides.

The suffix is the last label, or the last two where they're one of SECOND under a country's
two letters (co.uk); the registered domain has one label more.  An address is its own domain,
and all addresses share a suffix.  User and port are left out of both.

Defined cases: a null url or one without :// has empty host and path, fits no rule and gets
the verdict of all outcomes, to which its own count too; without outcomes nothing is blocked;
outcomes of unknown pages and null outcomes are ignored; a page with several outcomes counts
each; repeated and tied rows are judged alike; other columns are ignored; a table may be empty.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlineage.llm.common import cut, small

#: (action, host and path) of each rule.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
LIMIT, DEVIATIONS, STRENGTH = 0.5, 2.0, (2.0, 1000.0)
#: Labels under which a country's registry gives out names, a fixed and bounded list.
SECOND = ("ac", "co", "com", "edu", "gov", "mil", "net", "org")
#: Rules that are tested one by one; more are joined by host, with the same result.
MOST_RULES = 100


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path); A-Z of the host in lower case."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits; null where none does."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: (len(r[1]), r[1], r[0])):  # the longest is tested first
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def with_rules(placed: DataFrame, rules=RULES) -> DataFrame:
    """placed (host, path, ...) with _rule and _action of the longest rule that fits."""
    if len(rules) <= MOST_RULES:
        rule, action = rule_of(F.col("host"), F.col("path"), rules)
        return placed.withColumns({"_rule": rule, "_action": action})
    # each distinct host meets the rules of the names that it ends with, then each page chooses by its path
    listed = placed.sparkSession.createDataFrame([(len(t), t, act, *t.partition("/")[::2]) for act, t in rules], "n int, rule string, action string, name string, start string")
    hosts = placed.select("host").distinct()
    names = hosts.select("host", F.explode(F.expr("transform(sequence(1, size(split(host, '[.]'))), k -> substring_index(host, '.', -k))")).alias("name"))
    fitting = names.join(small(listed), "name").groupBy("host").agg(F.collect_list(F.struct("n", "rule", "action", "start")).alias("_rules"))
    best = F.array_max(F.filter("_rules", lambda r: F.col("path").startswith(F.concat(F.lit("/"), r["start"]))))
    return placed.join(small(cut(fitting, "host-rules")), "host", "left").withColumn("_best", best).withColumns({"_rule": F.col("_best.rule"), "_action": F.col("_best.action")}).drop("_rules", "_best")


def levels(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    address = name.rlike(r"^[0-9]+([.][0-9]+){3}$") | name.startswith("[")
    second = F.substring_index(name, ".", -2).rlike(rf"^({'|'.join(SECOND)})[.][a-z]{{2}}$")
    domain = F.when(address, name).when(second, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    suffix = F.when(address, "[]").when(second, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))
    return domain, suffix


def _moments(children: DataFrame, group: list[str]) -> DataFrame:
    """(group, _mean, _strength): mean rate of the children, and the strength of the prior that their spread asks for."""
    sums = children.groupBy(*group).agg(F.sum("n").alias("_n"), F.sum("bad").alias("_bad"), F.count("*").alias("_k"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("_s"))
    mean = F.col("_bad") / F.col("_n")
    spread = F.greatest(F.col("_s") / F.col("_n") - mean * mean - mean * (1 - mean) * F.col("_k") / F.col("_n"), F.lit(1e-9))
    strength = F.least(F.greatest(mean * (1 - mean) / spread - 1, F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))
    return sums.select(*group, mean.alias("_mean"), strength.alias("_strength"))


def _posterior(prior: Column) -> list[Column]:
    return [(F.col("_strength") * prior + F.col("bad")).alias("a"), (F.col("_strength") * (1 - prior) + F.col("n") - F.col("bad")).alias("b")]


def reputation(judged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """judged (host, bad 0/1, n outcomes) -> posteriors (a, b) by host, by domain, by suffix; empty hosts are left out."""
    domain, suffix = levels(F.col("host"))
    hosts = judged.where("host <> ''").groupBy("host").agg(F.sum(F.col("n") * F.col("bad")).alias("bad"), F.sum("n").alias("n")).withColumn("domain", domain).withColumn("suffix", suffix)
    hosts = cut(hosts, "host-outcomes")
    domains = cut(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domain-outcomes")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    top = _moments(suffixes, []).first()  # one row
    by_suffix = suffixes.withColumns({"_mean": F.lit(top["_mean"]).cast("double"), "_strength": F.lit(top["_strength"]).cast("double")}).select("suffix", *_posterior(F.col("_mean")))
    by_suffix = cut(by_suffix, "suffix-posteriors")
    prior = F.col("_up_a") / (F.col("_up_a") + F.col("_up_b"))
    above = lambda df: df.withColumnsRenamed({"a": "_up_a", "b": "_up_b"})
    by_domain = cut(domains.join(_moments(domains, ["suffix"]), "suffix").join(above(by_suffix), "suffix").select("domain", *_posterior(prior)), "domain-posteriors")
    by_host = cut(hosts.join(_moments(hosts, ["domain"]), "domain").join(above(by_domain), "domain").select("host", *_posterior(prior)), "host-posteriors")
    return by_host, by_domain, by_suffix


def lower_bound(a: Column, b: Column) -> Column:
    """Mean less DEVIATIONS standard deviations of Beta(a, b)."""
    return a / (a + b) - DEVIATIONS * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES) -> DataFrame:
    """pages (page_id, url), outcomes (page_id, bad) -> page_id, host, path, rule, verdict, a row each page."""
    host, path = parts(F.col("url").cast("string"))
    placed = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = outcomes.select("page_id", F.col("bad").cast("long").alias("bad")).where("bad IS NOT NULL")
    judged = placed.select("page_id", "host").join(known, "page_id").groupBy("host", "bad").agg(F.count("*").alias("n"))
    judged = cut(judged, "outcomes")
    # all outcomes under a uniform prior: without any, the bound is below LIMIT
    n, bad = judged.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("bad")), F.lit(0))).first()
    overall = lower_bound(F.lit(bad + 1.0), F.lit(n - bad + 1.0)) > LIMIT
    found = reputation(judged)
    domain, suffix = levels(F.col("host"))
    joined = with_rules(placed, rules).withColumn("domain", domain).withColumn("suffix", suffix)
    # a verdict for each level's names that have outcomes; the first level that was seen decides
    for key, level in zip(("host", "domain", "suffix"), found):
        joined = joined.join(small(level.select(key, (lower_bound(F.col("a"), F.col("b")) > LIMIT).alias(f"_{key}"))), key, "left")
    blocked = F.when(F.col("host") != "", F.coalesce("_host", "_domain", "_suffix", overall)).otherwise(overall)
    return joined.select("page_id", "host", "path", F.col("_rule").alias("rule"), F.coalesce("_action", F.when(blocked, "block").otherwise("allow")).alias("verdict"))
