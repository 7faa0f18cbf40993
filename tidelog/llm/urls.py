"""URL filters: explicit rules first, host reputation for the rest.

Reputation is empirical Bayes.  Labelled outcomes (bad or not) are added up by host, by registered domain and by
suffix.  A suffix's rate is shrunk towards the rate of all, a domain's towards its suffix's, a host's towards its
domain's; the strength of each prior is fitted by moments to the rates one level below it, and is at most what its own level rests on: labelled pages and the
strength of the prior above.  A page whose host has a
posterior low bound over a limit is blocked; the others, and those about which nothing is known, are allowed.

Limit and deviations are chosen so that a page is blocked on reputation only if bad pages are the greater part of its host with two
deviations to spare: a host of few labelled pages, or of as many good as bad ones, is spared.

Corner cases: a null url, or one without ``://``, has an empty host and path; such pages share one reputation like any
host's; repeated rows are judged one by one; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.shared import materialize, work_dir

#: (verdict, host, path prefix)
Rule = tuple[str, str, str]
#: The rules of the contract.
RULES: list[Rule] = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), CAPITALS, SMALL)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching(rules: list[Rule], what: str) -> Column:
    """The rule's text or verdict of the longest rule that fits, else null; the earlier of two as long."""
    found = None
    for verdict, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        value = F.lit(host + path if what == "rule" else verdict)
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("string")


def domain_of(host: Column) -> Column:
    """The last two labels; no list of public suffixes is at hand."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _strength(level: DataFrame) -> float:
    """Of a beta prior around each row's parent mean (columns n, k, parent), by moments."""
    m = level.where("n > 0").agg(F.sum(F.pow(F.col("k") - F.col("n") * F.col("parent"), 2)).alias("s"), F.sum(F.col("n") * F.col("parent") * (1 - F.col("parent"))).alias("binomial"), F.sum(F.col("n") * (F.col("n") - 1) * F.col("parent") * (1 - F.col("parent"))).alias("pairs")).first()
    if not m["s"] or not m["pairs"]:
        return 10.0
    within = (m["s"] - m["binomial"]) / m["pairs"]  # the correlation of two outcomes of one row: 1 / (strength + 1)
    return min(max(1 / within - 1, 1.0), 1000.0) if within > 0 else 1000.0


def reputation(spark: SparkSession, pages: DataFrame, sigmas: float = 2.0) -> DataFrame:
    """(host, bad_rate, low_bound) of every host from (host, bad); bad is 1, 0, or null where a page has no label."""
    folder = work_dir(spark, "reputation")
    hosts = pages.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    hosts = materialize(hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}), f"{folder}/hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    overall = ((total["k"] or 0) + 0.5) / ((total["n"] or 0) + 1.0)

    def shrunk(level: DataFrame, name: str) -> DataFrame:
        level = materialize(level, f"{folder}/{name}")
        s = _strength(level)
        w = F.least(F.lit(s), F.col("known"))  # a prior is no surer than what is known of the level above
        a, b = F.col("k") + w * F.col("parent"), F.col("n") - F.col("k") + w * (1 - F.col("parent"))
        return level.withColumns({"rate": a / (a + b), "weight": F.col("n") + w, "low": a / (a + b) - sigmas * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))})

    by_suffix = shrunk(suffixes.withColumns({"parent": F.lit(overall), "known": F.lit((total["n"] or 0) + 1.0)}), "suffixes").select("suffix", F.col("rate").alias("parent"), F.col("weight").alias("known"))
    by_domain = shrunk(domains.join(by_suffix, "suffix"), "domains").select("domain", F.col("rate").alias("parent"), F.col("weight").alias("known"))
    by_host = shrunk(hosts.select("host", "domain", "n", "k").join(by_domain, "domain"), "by_host")
    return by_host.select("host", F.col("rate").alias("bad_rate"), F.col("low").alias("low_bound"))


def judge_urls(spark: SparkSession, pages: DataFrame, rules: list[Rule], limit: float = 0.5, sigmas: float = 2.0, label: Column | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    ``label``: 1 for a bad page, 0 for a good one, null for one that isn't labelled; without it the outcomes of the
    rules are the labels, so the hosts' reputation carries the rules' judgement over to pages that no rule fits.
    """
    url = F.col("url")
    parsed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), *([] if label is None else [label.cast("int").alias("bad")]))
    parsed = parsed.withColumns({"rule": matching(rules, "rule"), "ruled": matching(rules, "verdict")})
    if label is None:
        parsed = parsed.withColumn("bad", (F.col("ruled") == "block").cast("int"))
    known = reputation(spark, parsed.select("host", "bad"), sigmas).select(F.col("host").alias("h"), (F.col("low_bound") > limit).alias("rejected"))
    out = parsed.join(known, parsed.host == known.h, "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"))
