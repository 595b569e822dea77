"""URL filters in DataFrame operations: rules first, then empirical-Bayes host reputation.

A rule (host and path prefix, written ``host/path``) fits its host and all subdomains; the
longest rule that fits decides. Other pages are judged by their host: labelled page
outcomes (1 bad, 0 good) are counted by host, host rates shrink towards their registered
domain's, those towards their suffix's, and those towards the whole, each by a beta-binomial
prior whose strength comes from the spread of the rates at that level (moments). A page is
blocked if the lower bound of its host's posterior exceeds ``LIMIT``.

The registered domain is the label before the public suffix and the suffix: sites under
``co.uk`` are no neighbours. ``suffixes`` names the public suffixes of several labels;
``SUFFIXES`` has common ones. User parts, ports and a closing dot of a host don't count
there, and an address of four numbers is its own domain.

Results: a null url, or one without ``://``, has an empty host and path; the empty host has
a reputation as any other. Hosts without labelled pages have their domain's rate. Repeated
rows count each. Extra columns are never read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import LOWER, UPPER, materialize

LIMIT, Z = 0.5, 1.645
WEAK, STRONG = 1.0, 1000.0
#: Public suffixes of two labels (fixed values of the public list, the common ones).
SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "ltd.uk", "me.uk", "com.au", "net.au", "org.au", "edu.au", "gov.au", "co.nz", "org.nz", "ac.nz", "co.jp", "ne.jp", "or.jp", "ac.jp", "go.jp",
    "com.br", "net.br", "org.br", "gov.br", "com.cn", "net.cn", "org.cn", "gov.cn", "com.tr", "org.tr", "co.in", "net.in", "org.in", "ac.in", "gov.in", "co.kr", "or.kr", "ac.kr", "co.za", "org.za",
    "com.mx", "org.mx", "com.ar", "org.ar", "com.tw", "org.tw", "com.hk", "com.sg", "com.my", "co.il", "org.il", "ac.il", "com.pl", "com.ua", "com.ru", "co.id", "com.vn", "co.th", "com.co", "com.pe",
    "github.io", "gitlab.io", "blogspot.com", "herokuapp.com", "netlify.app", "vercel.app", "pages.dev",
)
ADDRESS = r"^[0-9]+([.][0-9]+){3}$"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of ``rules`` ((verdict, rule) pairs) that fits; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, p = split_rule(text)
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(name)).otherwise(verdict)
    return rule, verdict


def site_of(host: Column) -> Column:
    """The host without user part, port and closing dot."""
    return F.regexp_replace(host, r"^.*@|[.]?(:[0-9]*)?$", "")


def suffix_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The public suffix: one label, or two that ``suffixes`` names; ``ip`` for an address."""
    site = site_of(host)
    two = F.substring_index(site, ".", -2)
    return F.when(site.rlike(ADDRESS), F.lit("ip")).when(two.isin(*suffixes), two).otherwise(F.substring_index(site, ".", -1))


def domain_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """Registered domain: the public suffix and the label before it; an address is its own."""
    site = site_of(host)
    two = F.substring_index(site, ".", -2)
    return F.when(site.rlike(ADDRESS), site).when(two.isin(*suffixes), F.substring_index(site, ".", -3)).otherwise(two)


def strength(children: DataFrame) -> tuple[float, float]:
    """(mean, prior strength) of a level from its children's (n, bad) by moments; three sums reach the driver."""
    n, bad, units, spread = children.filter("n > 0").agg(F.sum("n"), F.sum("bad"), F.count("*"), F.sum(F.col("bad") * F.col("bad") / F.col("n"))).first()
    if not n:
        return 0.0, WEAK
    mean = bad / n
    between = spread / n - mean * mean - mean * (1 - mean) * (units - 1) / n
    return mean, STRONG if between <= 0 else max(WEAK, min(STRONG, mean * (1 - mean) / between - 1))


def reputation(outcomes: DataFrame, limit: float = LIMIT, z: float = Z, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(host, rate, bound, blocked) of every host in ``outcomes`` (host, bad: 1, 0 or null)."""
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = materialize(hosts.withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)}), "hosts")
    domains = materialize(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = materialize(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffixes")
    (whole, k0), (_, k1), (_, k2) = strength(suffixes), strength(domains), strength(hosts)

    def shrunk(k: float, prior: Column) -> Column:
        return (F.col("bad") + k * prior) / (F.col("n") + k)

    top = suffixes.select("suffix", shrunk(k0, F.lit(whole)).alias("suffix_rate"))
    middle = domains.join(top, "suffix").select("domain", shrunk(k1, F.col("suffix_rate")).alias("domain_rate"))
    rate = shrunk(k2, F.col("domain_rate"))
    both = hosts.join(materialize(middle, "domain-rates"), "domain").select("host", rate.alias("rate"), (F.col("n") + k2).alias("weight"))
    bound = F.col("rate") - z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("weight") + 1))
    return both.select("host", "rate", bound.alias("bound"), (bound > limit).alias("blocked"))


def judge(df: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", outcome: Column | None = None, limit: float = LIMIT, z: float = Z, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``df``.

    ``outcome`` labels pages (1 bad, 0 good, null unknown); by default a page that a rule
    decides is a labelled one.
    """
    pages = df.select(df[id_col].alias("page_id"), host_of(df[url_col]).alias("host"), path_of(df[url_col]).alias("path"), (outcome if outcome is not None else F.lit(None)).cast("int").alias("own"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    bad = F.col("own") if outcome is not None else F.when(F.col("by_rule") == "block", 1).when(F.col("by_rule") == "allow", 0)
    ruled = materialize(pages.withColumns({"rule": rule, "by_rule": verdict}).withColumn("bad", bad), "ruled")
    known = materialize(reputation(ruled.select("host", "bad"), limit, z, suffixes), "reputation")
    return ruled.join(known.select("host", "blocked"), "host").select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict")
    )


def bound_of(bad: int, n: int, k: float, prior: float, z: float = Z) -> float:
    """The bound of one host, for tests."""
    rate = (bad + k * prior) / (n + k)
    return rate - z * math.sqrt(rate * (1 - rate) / (n + k + 1))
