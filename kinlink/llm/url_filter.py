"""URL filters by empirical-Bayes host reputation; DataFrame functions only.

Bad outcomes of labelled pages follow a beta-binomial law within each level: the suffix shrinks
towards the rate of all pages, the registered domain towards its suffix, the host towards its domain.
How strongly is estimated from the spread within each level. A host is blocked if the lower bound of
its posterior bad rate is above a limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels under which names are registered, unless a longer list is given (fixed values).
TWO_LABELS = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "co.in", "co.kr", "co.za", "com.br", "com.mx", "com.cn", "com.tr")
#: The rules of the contract: (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Standard deviations below the posterior mean, and the bad rate that this bound must exceed.
BELOW, LIMIT = 1.645, 0.5
#: Bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0
#: Hosts whose reputations are broadcast at most: some 100 bytes each.
MOST_HOSTS = 200_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty if there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits host or a parent domain and begins the path; else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def suffix_of(host: Column, suffixes: Sequence[str] = TWO_LABELS) -> Column:
    """The longest of ``suffixes`` (of two labels or more) that the host ends in, else its last label."""
    out = F.substring_index(host, ".", -1)
    for n in sorted({x.count(".") + 1 for x in suffixes}):
        tail = F.substring_index(host, ".", -n)
        out = F.when(tail.isin(*(x for x in suffixes if x.count(".") + 1 == n)), tail).otherwise(out)
    return out


def domain_of(host: Column, suffixes: Sequence[str] = TWO_LABELS) -> Column:
    """The suffix and the label before it: the registered name."""
    out = F.substring_index(host, ".", -2)
    for n in sorted({x.count(".") + 1 for x in suffixes}):
        tail = F.substring_index(host, ".", -n)
        out = F.when(tail.isin(*(x for x in suffixes if x.count(".") + 1 == n)), F.substring_index(host, ".", -n - 1)).otherwise(out)
    return out


def _strength(level: DataFrame, rate: Column) -> float:
    """Strength of the prior in pages: moments of the groups' rates around their parents' (one row to the driver)."""
    n, k = F.col("n"), F.col("k")
    row = level.filter(n > 0).agg(
        F.sum(n * F.pow(k / n - rate, 2)).alias("spread"),
        F.sum(rate * (1 - rate)).alias("noise"),
        F.sum(n * rate * (1 - rate)).alias("scale"),
        F.sum(n).alias("pages"),
    ).first()
    if not row["pages"]:
        return WEAKEST
    over = (row["spread"] - row["noise"]) / row["pages"]  # variance between groups
    inside = row["scale"] / row["pages"]
    return STRONGEST if over <= inside / (STRONGEST + 1) else min(max(inside / over - 1, WEAKEST), STRONGEST)


def reputations(urls: DataFrame, outcomes: DataFrame, suffixes: Sequence[str] = TWO_LABELS) -> DataFrame:
    """(host, mean, low): posterior bad rate of every host of ``urls`` and its lower bound.

    ``urls``: id, host. ``outcomes``: id, bad (0 or 1; null: no outcome). Pages are counted per host
    before anything is gathered by domain or suffix.
    """
    counted = outcomes.filter(F.col("bad").isNotNull()).groupBy("id").agg(F.max("bad").alias("bad"))
    hosts = urls.join(counted, "id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("k"))
    hosts = materialize(hosts.withColumn("suffix", suffix_of(F.col("host"), suffixes)).withColumn("domain", domain_of(F.col("host"), suffixes)), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    mean = (total["k"] + 0.5) / (total["n"] + 1) if total["n"] else 0.5
    n, k = F.col("n"), F.col("k")
    shrunk = lambda prior, m: (F.lit(m) * prior + k) / (F.lit(m) + n)
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = suffixes.select("suffix", shrunk(F.lit(mean), _strength(suffixes, F.lit(mean))).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix")
    domains = domains.select("domain", shrunk(F.col("suffix_rate"), _strength(domains, F.col("suffix_rate"))).alias("domain_rate"))
    hosts = materialize(hosts.join(domains, "domain"), "hosts")
    m = _strength(hosts, F.col("domain_rate"))
    a, b = F.lit(m) * F.col("domain_rate") + k, F.lit(m) * (1 - F.col("domain_rate")) + n - k
    post = a / (a + b)
    spread = F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1)))
    return hosts.select("host", post.alias("mean"), (post - BELOW * spread).alias("low"))


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    suffixes: Sequence[str] = TWO_LABELS,
    limit: float = LIMIT,
) -> DataFrame:
    """id, host, path, rule, verdict (allow or block), and the host's ``bad_low`` that decides without a rule.

    A null url, or one without ``://``, has an empty host and path; that empty host has a reputation
    like any other. Pages without an outcome count for nothing; without any outcome the rate is one
    half and nothing is blocked. Repeated ids count each; an empty table gives no rows. ``suffixes``:
    public suffixes of two labels and more. Up to MOST_HOSTS hosts are broadcast, so that pages are not
    moved; of more, Spark joins by host and divides hosts that many pages share.
    """
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    known = materialize(reputations(urls.select("id", "host"), outcomes, suffixes), "reputations")
    known = F.broadcast(known) if known.count() <= MOST_HOSTS else known
    rule = rule_for(F.col("host"), F.col("path"), rules)
    judged = urls.withColumn("r", rule).join(known, "host", "left")
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("low") > limit, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), F.round("low", 6).alias("bad_low"))
