"""URL filters: explicit rules, and empirical-Bayes host reputation for what no rule decides.

A host's page outcomes (each between bad, 0, and good, 1) are shrunk through beta-binomial priors: the suffix's rate towards
the overall rate, the registered domain's towards its suffix's, the host's towards its domain's. The strength
of each prior is estimated by the method of moments from how far the children's rates spread beyond what their
counts explain. A host is blocked if even the upper posterior bound of its good rate is below the floor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgrain.llm.common import Scratch

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


#: Public suffixes of two labels; all other suffixes are taken to have one.
SUFFIXES = (
    "ac.jp", "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.hk", "com.mx", "com.sg",
    "com.tr", "com.tw", "edu.au", "gov.au", "gov.uk", "ltd.uk", "net.au", "ne.jp", "or.jp", "org.au", "org.nz", "org.uk",
)


def _labels(host: Column, more: int) -> Column:
    """The last labels: those of the public suffix and so many more."""
    two = F.substring_index(host, ".", -2).isin(*SUFFIXES)
    return F.when(two, F.substring_index(host, ".", -2 - more)).otherwise(F.substring_index(host, ".", -1 - more))


def domain_of(host: Column) -> Column:
    """The registered domain: the public suffix and the label before it."""
    return _labels(host, 1)


def suffix_of(host: Column) -> Column:
    return _labels(host, 0)


def _strength(children: DataFrame) -> Column:
    """Of the prior that children(n, good in millionths, base) share: p(1-p)/spread - 1, between 1 and 1000."""
    p = F.sum(F.col("base") * F.col("n")) / F.sum("n")
    seen = F.sum(F.col("n") * F.pow(F.col("good") / 1e6 / F.col("n") - F.col("base"), 2)) / F.sum("n")
    noise = F.sum(F.col("base") * (1 - F.col("base"))) / F.sum("n")
    spread = F.greatest(F.lit(1e-6), seen - noise)
    return F.round(F.greatest(F.lit(1.0), F.least(F.lit(1000.0), p * (1 - p) / spread - 1)), 6)


def reputation(outcomes: DataFrame, scratch: Scratch, z: float = 1.645) -> DataFrame:
    """host, n, good, rate, upper: for each host of outcomes(host, good: true, false or a share between 0 and 1). The driver gets four numbers: the overall
    rate and a prior's strength a level.

    Rows without a host or an outcome are left out. Repeated rows count each. An empty table gives an empty result. Sums are of whole millionths, so
    that their order doesn't matter.
    """
    hosts = scratch.write(
        outcomes.filter("host is not null and good is not null")
        .groupBy("host")
        .agg(F.count("*").alias("n"), F.sum(F.round(F.col("good").cast("double") * 1e6).cast("long")).alias("good"))
        .withColumn("domain", domain_of(F.col("host")))
        .withColumn("suffix", suffix_of(F.col("host"))),
        "hosts",
    )
    one = hosts.agg(F.sum("good") / 1e6 / F.sum("n")).first()[0]
    level, key = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("base", F.lit(one).cast("double")), "suffix"
    for child in ("domain", "host", None):
        strength = F.lit(level.agg(_strength(level)).first()[0]).cast("double")
        done = level.withColumn("m", strength).withColumn("rate", F.round((F.col("good") / 1e6 + F.col("m") * F.col("base")) / (F.col("n") + F.col("m")), 9))
        if child is None:
            break
        below = hosts.groupBy(child, key).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
        level, key = below.join(done.select(key, F.col("rate").alias("base")), key).select(child, "n", "good", "base"), child
        level = scratch.write(level, child)
    sd = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("m") + 1))
    return done.select("host", "n", (F.col("good") / 1e6).alias("good"), "rate", F.round(F.least(F.lit(1.0), F.col("rate") + z * sd), 6).alias("upper"))


def judge(pages: DataFrame, outcomes: DataFrame, scratch: Scratch, rules=RULES, floor: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, upper: every page's verdict by rule, else by its host's reputation.

    pages: page_id, url; a null url or one without :// has an empty host and path. A host without
    labelled outcomes is allowed. Repeated pages are judged each.
    """
    known = scratch.write(reputation(outcomes, scratch).select(F.col("host").alias("h"), "upper"), "known")
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    p = p.withColumn("r", rule_for(F.col("host"), F.col("path"))).join(known, F.col("host") == F.col("h"), "left")
    verdict = F.coalesce("r.verdict", F.when(F.col("upper") < floor, F.lit("block")).otherwise(F.lit("allow")))
    return p.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "upper")


#: A page's title is its text's first line, which pages cut after so many characters.
TITLE = 60


def title_of(html: Column) -> Column:
    """The whole title, entities resolved; null where there is none."""
    t = F.regexp_extract(html, "<title>([^<]*)</title>", 1)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.nullif(t, F.lit(""))


def page_outcomes(pages: DataFrame, docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """host, good: a row for each page whose title heads labelled documents; good is the share of these that are good.

    Good is quality 1 and not toxic. Labels that repeat a doc_id count each, null qualities and labels of unknown documents not. Pages without
    a host or title and documents with an empty first line have no outcome. Empty tables give an empty result.
    """
    line = F.nullif(F.substring(F.substring_index("text", "\n", 1), 1, TITLE), F.lit(""))
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    marked = docs.select("doc_id", line.alias("title")).join(labels.filter("quality is not null").select("doc_id", good.alias("good")), "doc_id")
    share = (F.sum(F.col("good").cast("long")) / F.count("*")).alias("good")
    titles = scratch.write(marked.filter("title is not null").groupBy("title").agg(share), "titles")
    return pages.select(host_of(F.col("url")).alias("host"), title_of(F.col("html")).alias("title")).filter("host <> ''").join(titles, "title").select("host", "good")
