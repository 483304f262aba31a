"""URL filter: rules first, then the host's reputation from labelled pages (empirical Bayes).

Pages are judged by host. A host's good rate has a beta prior around the rate of its registered domain, that
one around the rate of its suffix, and that one around the overall rate. How strongly each level leans on the one
above is estimated from the labelled pages of all hosts, by the moments of a beta-binomial. A host is blocked when
the upper bound of its posterior good rate is below `least`; a host without labelled pages inherits its domain's.

DataFrame operations only. Per-host counts are combined before their shuffle; the host table is stored, so that
the planner broadcasts it only if it is small, and AQE splits a hot host's pages otherwise.

Defined cases: a null url, or one without "://", has an empty host and path. Labels that are null, or of pages that
don't exist, are left out; a page labelled twice counts twice; a page given twice comes out twice. Without labels all rates
are 0.5 and every verdict is allow or the rule's. A null page_id has no labels. A port is part of the host, but not of its
domain and suffix. A suffix has one label unless `suffixes` says otherwise. An empty table of pages gives no rows, one of
labels has no outcomes. Very long urls are cut like any other. Further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import lower_ascii, taken
from hearthline.runtime import durable

Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(_rest(url), "^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    there = F.instr(url, "://")
    return F.when(there > 0, F.substring(url, there + F.lit(3), F.length(url)))


def _site(host: Column) -> Column:
    """The host without its port."""
    return F.regexp_replace(host, ":[0-9]*$", "")


def _by_suffix(host: Column, suffixes: Sequence[str], more: int) -> Column:
    """As many last labels as the longest fitting suffix has, or one, and `more`; of a number address all if `more`."""
    site = _site(host)
    picked = F.when(site.rlike(r"^[0-9.]+$"), site if more else "")
    for s in sorted({x.strip(".").lower() for x in suffixes}, key=lambda x: (-x.count("."), x)):
        picked = picked.when((site == s) | site.endswith("." + s), F.substring_index(site, ".", -(s.count(".") + 1 + more)))
    return picked.otherwise(F.substring_index(site, ".", -1 - more))


def domain_of(host: Column, suffixes: Sequence[str] = ()) -> Column:
    """The suffix and the label before it, or all of a number address."""
    return _by_suffix(host, suffixes, 1)


def suffix_of(host: Column, suffixes: Sequence[str] = ()) -> Column:
    """The longest of the given suffixes (such as co.uk) that fits, or the last label; empty for a number address."""
    return _by_suffix(host, suffixes, 0)


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule's text and its verdict; of equally long ones the first by host and path."""
    text = verdict = None
    for says, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, h + p) if text is None else text.when(fits, h + p)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text, verdict)


def settled(c: Column) -> Column:
    """Six digits, with the border between two values away from round numbers."""
    return F.floor(c * 1e6 + 0.4137) / 1e6


def strength(counts: DataFrame, prior: Column) -> Column:
    """How many pages the level above is worth, as a one-row subquery: beta-binomial moments over all groups.

    `counts` has n and k. The correlation within groups is kept between 0.001 and 0.999 and rounded, so that the
    order of addition doesn't show.
    """
    apart = F.col("k") - F.col("n") * prior
    over = apart * apart - F.col("n") * prior * (1 - prior)
    pairs = F.col("n") * (F.col("n") - 1) * prior * (1 - prior)
    rho = F.sum(over) / F.nullif(F.sum(pairs), F.lit(0.0))
    rho = settled(F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.coalesce(rho, F.lit(0.5)))))
    return counts.agg(((1 - rho) / rho).alias("s")).scalar()


def posterior(prior: Column, weight: Column) -> Column:
    return (F.col("k") + weight * prior) / (F.col("n") + weight)


def host_reputation(counts: DataFrame, bound_z: float = 1.645, suffixes: Sequence[str] = ()) -> DataFrame:
    """Per host: n, k, mean, and the upper bound of the good rate. `counts`: host, n and k (labelled and good pages)."""
    domain, suffix = domain_of(F.col("host"), suffixes), suffix_of(F.col("host"), suffixes)
    hosts = durable(counts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k"))
    summed = [F.sum("n").cast("double").alias("n"), F.sum("k").cast("double").alias("k")]
    overall = hosts.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("n"), F.lit(0)) + 2.0)).alias("p")).scalar()
    suffixes = durable(hosts.groupBy("suffix").agg(*summed))
    suffixes = suffixes.select("suffix", posterior(overall, strength(suffixes, overall)).alias("m_suffix"))
    domains = durable(hosts.groupBy("domain", "suffix").agg(*summed).join(suffixes, "suffix"))
    domains = domains.select("domain", "suffix", posterior(F.col("m_suffix"), strength(domains, F.col("m_suffix"))).alias("m_domain"))
    full = durable(hosts.join(domains, ["domain", "suffix"]))
    s = strength(full, F.col("m_domain"))
    a = F.col("k") + s * F.col("m_domain")
    b = F.col("n") - F.col("k") + s * (1 - F.col("m_domain"))
    mean = F.col("a") / (F.col("a") + F.col("b"))
    spread = F.sqrt(F.col("a") * F.col("b") / ((F.col("a") + F.col("b")) * (F.col("a") + F.col("b")) * (F.col("a") + F.col("b") + 1)))
    return full.select("host", "n", "k", a.alias("a"), b.alias("b")).select(
        "host", "n", "k", mean.alias("mean"), settled(F.least(F.lit(1.0), mean + F.lit(bound_z) * spread)).alias("bound")
    )


def url_filter(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[Rule] = (),
    least: float = 0.5,
    bound_z: float = 1.645,
    page_id: str = "page_id",
    url: str = "url",
    outcome_id: str = "page_id",
    good: str = "good",
    suffixes: Sequence[str] = (),
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, labelled, good, bound.

    `outcomes` holds labelled pages: their id and 1 (good) or 0. `rules` are (verdict, host, path); a rule fits its host
    and all subdomains if the path starts with its path. Where no rule fits, a host whose bound is below `least` is blocked.
    `suffixes` are the public suffixes of several labels (co.uk, github.io) under which every label is a registered domain.
    """
    seen = taken(pages, page_id=page_id, url=url).select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    marked = taken(outcomes, marked_id=outcome_id, good=good).where("good IS NOT NULL")
    labelled = (
        seen.select("page_id", "host")
        .join(marked, F.col("page_id") == F.col("marked_id"))
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("good") > 0, 1).otherwise(0)).alias("k"))
    )
    zero = F.lit(0).cast("bigint")
    counts = (
        seen.select("host", zero.alias("n"), zero.alias("k"))
        .distinct()
        .unionByName(labelled.select("host", "n", "k"))
        .groupBy("host")
        .agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    )
    rated = durable(host_reputation(counts, bound_z, suffixes))
    text, says = rule_for(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("bound") < least, "block").otherwise("allow")
    return seen.join(rated, "host", "left").select(
        "page_id",
        "host",
        "path",
        text.alias("rule"),
        F.coalesce(says, by_host).alias("verdict"),
        F.col("n").alias("labelled"),
        F.col("k").alias("good"),
        "bound",
    )
