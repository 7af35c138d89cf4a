"""URL filter: rules first, then an Empirical-Bayes reputation of the host.

Labelled page outcomes (good or bad) are counted per host, without user names
and ports. A beta-binomial prior is passed down from all pages to the public
suffix (the last label, or the last two where a table of suffixes has them), the
registered domain (one label more) and the host. At each level the prior's mean
is the parent's posterior mean and its strength is fitted, by moments, to how
far the level's rates lie from their own parents'. A host is blocked if even the
lower bound of its posterior rate of bad pages (posterior mean less ``z``
posterior deviations) is over ``threshold``.

Scale: labelled pages are counted with map-side partial sums, so a hot host is
a few rows when it is shuffled. Verdicts are made per distinct host and joined
back to the pages; a hot host's pages are split by the adaptive skew join, as
the other side has one row for a host. The driver gets one row of moments.

Edge cases: a null url, or one without "://", has an empty host and path, fits
no rule and is judged as the host "". A page or label without an id carries no
outcome; a page id with several label rows is bad if any of them is. With no
labels at all the prior is Beta(1/2, 1/2) on every level. Repeated pages are
judged alike, each on its own row. Columns of the input are kept, clashing ones
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ascii_lower, written

LEVELS = ("suffix", "domain", "host")
#: Public suffixes of two labels; more can be given.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "nhs.uk", "org.uk", "plc.uk", "sch.uk", "com.au", "edu.au", "gov.au", "net.au", "org.au",
    "co.nz", "ac.nz", "govt.nz", "net.nz", "org.nz", "ac.jp", "co.jp", "go.jp", "ne.jp", "or.jp", "ac.kr", "co.kr", "go.kr", "or.kr", "com.cn", "edu.cn", "gov.cn",
    "net.cn", "org.cn", "com.hk", "com.tw", "edu.tw", "org.tw", "com.sg", "com.my", "co.th", "co.id", "com.ph", "com.vn", "ac.in", "co.in", "gov.in", "net.in", "org.in",
    "com.pk", "com.bd", "co.il", "ac.il", "org.il", "com.tr", "gov.tr", "org.tr", "com.ua", "com.pl", "com.ru", "com.br", "gov.br", "net.br", "org.br", "com.ar", "com.mx",
    "gob.mx", "org.mx", "com.co", "com.pe", "com.ve", "com.ec", "com.uy", "ac.za", "co.za", "gov.za", "org.za", "co.ke", "com.ng", "com.eg", "com.sa", "com.es", "com.pt",
)


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


DEFAULT_RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def site_of(host: Column) -> Column:
    """The host without a user name and a port."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def suffix_of(site: Column, suffixes) -> Column:
    two = F.substring_index(site, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(site, ".", -1)) if suffixes else F.substring_index(site, ".", -1)


def domain_of(site: Column, suffixes) -> Column:
    two = F.substring_index(site, ".", -2)
    return F.when(two.isin(*suffixes), F.substring_index(site, ".", -3)).otherwise(two) if suffixes else two


def first_fitting(rules, host: Column, path: Column, value) -> Column:
    """value of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        out = F.when(rule.fits(host, path), F.lit(value(rule))).otherwise(out)
    return out


def host_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """site, n and bad: labelled pages of a host and how many of them are bad."""
    bad = F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0))
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(bad.alias("_bad"))
    seen = pages.select("page_id", site_of(host_of(F.col("url"))).alias("site"))
    return seen.join(marks, seen.page_id == marks.doc_id).groupBy("site").agg(F.count("*").alias("n"), F.sum("_bad").alias("bad"))


def fitted_strength(groups: DataFrame, least: float, most: float) -> float:
    """Strength (alpha + beta) of beta-binomials whose groups (n, bad, mean: the parent's rate) spread about their means as these do, by moments."""
    rate, spread = F.col("bad") / F.col("n"), F.col("mean") * (1 - F.col("mean"))
    off = F.col("n") * (rate - F.col("mean")) * (rate - F.col("mean")) / spread
    row = groups.filter("n > 0 and mean > 0 and mean < 1").agg(F.count("*").alias("g"), F.sum(F.col("n") - 1).cast("double").alias("free"), F.sum(off).alias("off")).first()
    if not row.g or row.g < 2 or not row.free:
        return most
    rho = (row.off - row.g) / row.free
    return most if rho <= 0 else min(most, max(least, 1 / rho - 1))


def host_posteriors(sites: DataFrame, outcomes: DataFrame, least: float = 1.0, most: float = 1000.0, z: float = 1.645, suffixes=SUFFIXES) -> DataFrame:
    """For each row of sites (distinct): posterior rates of bad pages by level, and the lower bound of the site's.

    The three levels' tables hold a row for each suffix, domain and site; the driver gets one row of moments a level.
    """
    both = {"suffix": suffix_of(F.col("site"), suffixes), "domain": domain_of(F.col("site"), suffixes)}
    known = written(outcomes, "outcomes").withColumns(both)
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    out = sites.withColumns(both).withColumn("mean", F.lit((total.bad + 0.5) / (total.n + 1)))
    parents = known.withColumn("mean", F.lit((total.bad + 0.5) / (total.n + 1)))
    for level, key in zip(LEVELS, ("suffix", "domain", "site"), strict=True):
        counts = parents.groupBy(key).agg(F.sum("n").alias("_n"), F.sum("bad").alias("_bad"), F.first("mean").alias("_mean"))
        k = F.lit(fitted_strength(counts.select(F.col("_n").alias("n"), F.col("_bad").alias("bad"), F.col("_mean").alias("mean")), least, most))
        a, b = F.col("_bad") + k * F.col("mean"), F.col("_n") - F.col("_bad") + k * (1 - F.col("mean"))
        spread = a * b / ((a + b) * (a + b) * (a + b + 1))
        fill = lambda df: df.withColumns({"_n": F.coalesce("_n", F.lit(0)), "_bad": F.coalesce("_bad", F.lit(0))})
        out = fill(out.join(counts.drop("_mean"), key, "left")).withColumns({f"{level}_rate": a / (a + b), "_var": spread}).withColumn("mean", F.col(f"{level}_rate")).drop("_n", "_bad")
        parents = fill(parents.join(counts.drop("_mean"), key, "left")).withColumn("mean", a / (a + b)).drop("_n", "_bad")
    return out.select("site", *(f"{x}_rate" for x in LEVELS), (F.col("host_rate") - z * F.sqrt("_var")).alias("bad_bound"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules=DEFAULT_RULES, threshold: float = 0.3, **fit) -> DataFrame:
    """pages with host, path, rule (or null), bad_bound and verdict."""
    host, path = F.col("host"), F.col("path")
    judged = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    judged = judged.withColumns({"rule": first_fitting(rules, host, path, lambda r: r.text), "_action": first_fitting(rules, host, path, lambda r: r.action)})
    judged = judged.drop("bad_bound").withColumn("_site", site_of(host))
    sites = judged.groupBy(F.col("_site").alias("site")).agg(F.lit(1).alias("_one")).drop("_one")
    bounds = host_posteriors(sites, host_outcomes(pages, labels), **fit).select(F.col("site").alias("_site"), "bad_bound")
    own = F.when(F.col("bad_bound") > threshold, "block").otherwise("allow")
    return judged.join(bounds, "_site", "left").withColumn("verdict", F.coalesce("_action", own)).drop("_action", "_site")
