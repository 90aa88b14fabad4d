"""URL filters by empirical-Bayes host reputation.

Labelled outcomes of pages (good or not) are counted per host. Beta-binomial priors
shrink them downwards: all pages to a suffix, a suffix to its registered domains, a
domain to its hosts. How strongly a level binds its members is estimated from how much
their shares differ (method of moments). A host is blocked when the upper end of its
posterior interval lies under the wanted share of good pages, so little evidence never
blocks. Everything is grouping and joins over hosts; no page text is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Second-level labels that form a suffix with a two-letter country label.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)
WANTED = 0.5
Z = 1.64
SALTS = 16


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for null or where ``://`` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def suffix_of(host: Column) -> Column:
    """Public suffix by rule: the last label, or the last two when a general label stands before a two-letter one."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    last, second = F.element_at(labels, -1), F.when(n > 2, F.element_at(labels, -2))
    double = (F.length(last) == 2) & second.isin(*SECOND_LEVEL)
    return F.when(F.coalesce(double, F.lit(False)), F.concat_ws(".", second, last)).otherwise(last)


def domain_of(host: Column, suffix: Column) -> Column:
    """Registered domain: the suffix and one label more; a host that is only a suffix stands for itself."""
    two = F.size(F.split(suffix, r"\.")) == 2
    return F.when(two, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def match_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does; ties go to the rule listed first."""
    best = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        best = F.when(fits, hit) if best is None else best.when(fits, hit)
    if best is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return best["rule"], best["verdict"]


def _strength(members: DataFrame, parent: list[str], share: str) -> DataFrame:
    """How many pages the parent's share is worth to a member, per parent.

    Beta-binomial moments: with S the squared differences weighted by pages, expected
    within-member scatter is share * (1 - share) * (k - 1); what exceeds it is the spread
    between members, and strength = share * (1 - share) / spread - 1, held in [1, 1000].
    """
    p = F.col(share)
    k, n = F.count(F.lit(1)), F.sum("__n")
    scatter = F.sum(F.col("__n") * F.pow(F.col("__g") / F.col("__n") - p, F.lit(2.0)))
    room = n - F.sum(F.col("__n") * F.col("__n")) / n
    noise = F.max(p * (1 - p))
    spread = (scatter - noise * (k - 1)) / room
    s = F.when((k > 1) & (spread > 0), noise / spread - 1).otherwise(F.lit(1000.0))
    return members.where("__n > 0").groupBy(*parent).agg(F.greatest(F.lit(1.0), F.least(F.lit(1000.0), s)).alias("__s"))


def reputations(outcomes: DataFrame, z: float = Z) -> DataFrame:
    """Posterior of every host in ``outcomes`` (host, good boolean or null for unlabelled).

    Returns host, domain, suffix, labelled, good (counts), share (posterior mean), upper
    (end of the interval). A level whose members all agree, or that has one member,
    binds with 1,000 pages. Without any label the share is 0.5 of a uniform prior.
    """
    hosts = outcomes.groupBy("host").agg(
        F.count("good").cast("double").alias("__n"), F.coalesce(F.sum(F.col("good").cast("double")), F.lit(0.0)).alias("__g")
    )
    hosts = hosts.withColumn("suffix", suffix_of(F.col("host")))
    hosts = hosts.withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("__n").alias("__n"), F.sum("__g").alias("__g"))
    suffixes = domains.groupBy("suffix").agg(F.sum("__n").alias("__n"), F.sum("__g").alias("__g"))
    root = suffixes.agg(((F.coalesce(F.sum("__g"), F.lit(0.0)) + 1) / (F.coalesce(F.sum("__n"), F.lit(0.0)) + 2)).alias("__p0"))

    def shrink(level: DataFrame, parent: list[str], prior: str, out: str) -> DataFrame:
        bind = _strength(level, parent, prior)
        level = level.join(bind, parent, "left") if parent else level.join(bind)
        s = F.coalesce(F.col("__s"), F.lit(1000.0))
        a = F.col("__g") + s * F.col(prior)
        return level.withColumn(out, a / (F.col("__n") + s)).withColumn("__m", F.col("__n") + s).drop("__s")

    suffixes = shrink(suffixes.join(root), [], "__p0", "__p1")
    domains = shrink(domains.join(suffixes.select("suffix", "__p1"), "suffix"), ["suffix"], "__p1", "__p2")
    hosts = shrink(hosts.join(domains.select("suffix", "domain", "__p2"), ["suffix", "domain"]), ["suffix", "domain"], "__p2", "share")
    sd = F.sqrt(F.col("share") * (1 - F.col("share")) / (F.col("__m") + 1))
    return hosts.select(
        "host", "domain", "suffix", F.col("__n").cast("long").alias("labelled"), F.col("__g").cast("long").alias("good"), "share",
        F.least(F.lit(1.0), F.col("share") + F.lit(float(z)) * sd).alias("upper"),
    )


def judge(pages: DataFrame, rules=RULES, outcomes: DataFrame | None = None, wanted: float = WANTED, z: float = Z) -> DataFrame:
    """Verdict of every row of ``pages`` (page_id, url).

    A rule that fits decides. Otherwise the host is blocked when ``upper`` of its
    posterior is under ``wanted``. ``outcomes`` (url, good) are labelled pages; without
    it the pages that a rule decides serve as labels. Null or broken URLs have an empty
    host, which is a host like any other. Repeated rows give repeated rows.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("__ruled", verdict)
    if outcomes is None:
        labelled = rows.select("host", (F.col("__ruled") == "allow").alias("good"))
    else:
        h, _ = split_url(F.col("url"))
        labelled = outcomes.select(h.alias("host"), F.col("good").cast("boolean").alias("good")).unionByName(
            rows.select("host", F.lit(None).cast("boolean").alias("good")))
    known = reputations(labelled, z)
    # a busy host is spread over the salts, its one reputation row copied to each
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt")
    known = known.select(F.col("host").alias("__h"), "labelled", "share", "upper", salts)
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
    joined = rows.join(known.withColumnRenamed("__salt", "__s"), (F.col("host") == F.col("__h")) & (F.col("__salt") == F.col("__s")))
    by_host = F.when(F.col("upper") < F.lit(float(wanted)), "block").otherwise("allow")
    return joined.select(
        "page_id", "host", "path", "rule", F.coalesce("__ruled", by_host).alias("verdict"),
        "labelled", F.round("share", 6).alias("good_share"), F.round("upper", 6).alias("upper_bound"),
    )
