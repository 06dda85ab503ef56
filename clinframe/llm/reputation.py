"""Filter pages by rules, and by the reputation of their hosts where no rule fits.

Reputation is the share of a host's labelled pages that are good, shrunk by beta-binomial priors:
suffixes towards the share of all pages, registered domains towards their suffix, hosts towards
their registered domain. How strongly, is estimated per level from how much more the groups differ
than chance explains. A host is blocked when the upper bound of its posterior is below a threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinframe.llm.common import lower_ascii
from clinframe.session import stored

#: Rules as (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Suffixes of two labels under which domains are registered. Fixed values.
TWO_LABELS = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")
#: Share of good pages below which a host is blocked, and normal deviates of the bound.
THRESHOLD = 0.5
DEVIATES = 1.645
#: The strength of a prior, in pages, lies between these.
WEAKEST, STRONGEST = 0.01, 10000.0

_AFTER_SCHEME = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
    empty without ``://`` or for null."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, _AFTER_SCHEME, 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _AFTER_SCHEME, 2), F.lit(""))


def rule(rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule (struct of rule and verdict) that fits ``host`` and ``path``, or null.
    Among rules of one length the first counts."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1]))[::-1]:
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(start)
        own = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, own).otherwise(out)
    return out


def _levels(name: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host; both the host itself if it has one label."""
    two = F.substring_index(name, ".", -2)
    known = two.isin(*TWO_LABELS)
    suffix = F.when(known, two).otherwise(F.substring_index(name, ".", -1))
    return F.when(known, F.substring_index(name, ".", -3)).otherwise(two), suffix


def _shrunk(groups: DataFrame, prior: str, name: str) -> DataFrame:
    """Adds the posterior mean ``name`` of each group (n, good), its prior mean being ``prior``."""
    m = F.col(prior)
    chance = m * (1 - m)
    sums = groups.agg(
        F.sum(F.pow(F.col("good") - F.col("n") * m, 2) - F.col("n") * chance).alias("excess"),
        F.sum(F.col("n") * (F.col("n") - 1) * chance).alias("room"),
    ).first()
    rho = sums["excess"] / sums["room"] if sums["room"] else 0.0
    strength = min(max(1 / rho - 1, WEAKEST), STRONGEST) if rho > 0 else STRONGEST
    mean = (F.col("good") + strength * m) / (F.col("n") + strength)
    return groups.withColumn(name, mean).withColumn("strength", F.lit(strength))


def host_reputation(pages: DataFrame) -> DataFrame:
    """One row per host of ``pages`` (host, good 0/1 or null): n, good, mean and upper bound.

    Pages without label count for no host; without any label the prior is 1, and nothing blocked.
    """
    hosts = pages.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    domain, suffix = _levels(F.col("host"))
    hosts = stored(hosts.withColumn("domain", domain).withColumn("suffix", suffix))
    total = F.sum("n").alias("n"), F.sum("good").alias("good")
    domains = stored(hosts.groupBy("domain", "suffix").agg(*total))
    suffixes = stored(domains.groupBy("suffix").agg(*total))
    every = suffixes.agg(*total).first()
    suffixes = suffixes.withColumn("prior", F.lit(every["good"] / every["n"] if every["n"] else 1.0))
    suffixes = _shrunk(suffixes, "prior", "suffix_mean").select("suffix", "suffix_mean")
    domains = _shrunk(domains.join(suffixes, "suffix"), "suffix_mean", "domain_mean").select("domain", "domain_mean")
    found = _shrunk(hosts.join(domains, "domain"), "domain_mean", "mean")
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("strength") + 1))
    return found.select("host", "n", "good", "mean", (F.col("mean") + DEVIATES * spread).alias("upper"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and posterior bound of every row of ``pages``.

    ``outcomes`` (page_id, good) labels pages; several labels of a page count as good only if all
    are; null ids and labels are left out. Null urls have an empty host and path, which is judged
    like any other host. Repeated rows are judged each.
    """
    known = outcomes.where("page_id is not null and good is not null").groupBy("page_id").agg(F.min("good").alias("good"))
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rows = stored(rows.withColumn("found", rule(rules)))
    bounds = stored(host_reputation(rows.join(known, "page_id", "left").select("host", "good")))
    own = F.when(F.col("upper") < THRESHOLD, "block").otherwise("allow")
    return rows.join(bounds, "host").select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", own).alias("verdict"),
        F.round("upper", 6).alias("upper"),
    )
