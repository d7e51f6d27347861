"""Operator 9: URL filters by rules and empirical-Bayes host reputation.

Rules judge the pages that they fit, the longest rule first. Other pages are
judged by their host: labelled page outcomes (good or bad) give each host a
beta-binomial posterior whose prior is shrunk from the suffix to the registered
domain to the host. The strength of each level's prior comes from the spread of
its groups over all labelled pages. A host is blocked when the lower bound of
its posterior rate of bad pages is above a limit.

A host's registered domain is its last two labels, or three under a suffix of
two labels (SUFFIXES); an address in numbers is a domain of its own. User names
and ports don't count. The labels of one page are one outcome, bad if any is.

A null url, or one without "://", has an empty host and path, fits no rule and
is judged as the empty host. Repeated rows give repeated rows. Without labelled
pages every unruled page is allowed. An empty table gives an empty one. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factweave.llm.common import materialize

# The contract's rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Posterior standard deviations below the mean, and the limit for that bound.
Z, LIMIT = 1.645, 0.5
#: Bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0

# Public suffixes of two labels under which names are registered.
SUFFIXES = tuple("""ac.uk co.uk gov.uk ltd.uk me.uk net.uk org.uk plc.uk sch.uk com.au net.au org.au edu.au gov.au id.au co.nz net.nz org.nz govt.nz ac.nz co.jp ne.jp or.jp ac.jp go.jp ad.jp
com.br net.br org.br gov.br edu.br com.cn net.cn org.cn gov.cn edu.cn ac.cn com.hk org.hk edu.hk gov.hk com.tw org.tw edu.tw gov.tw co.kr or.kr ac.kr go.kr co.in net.in org.in gov.in ac.in firm.in
com.mx org.mx gob.mx edu.mx com.ar gob.ar org.ar com.co gov.co com.tr gov.tr edu.tr org.tr co.za org.za gov.za ac.za com.sg edu.sg gov.sg com.my gov.my edu.my com.ph gov.ph co.id go.id ac.id or.id
co.th go.th ac.th or.th com.vn gov.vn edu.vn co.il org.il ac.il gov.il com.ua gov.ua org.ua com.pl net.pl org.pl gov.pl edu.pl com.eg gov.eg com.sa gov.sa com.pk gov.pk com.ng gov.ng co.ke go.ke com.pe gob.pe""".split())

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(url: str = "url") -> tuple[Column, Column]:
    """(host, path) of a url column."""
    rest = F.when(F.col(url).contains("://"), F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) by the longest rule that fits, else nulls; the rules are a short list, so they are part of the plan."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, own, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule, verdict = F.when(fits, own + start).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def _level(groups: DataFrame, key: str) -> DataFrame:
    return groups.groupBy(key).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))


def _strength(groups: DataFrame) -> DataFrame:
    """One row: the prior's strength, from the spread of the groups' rates by the method of moments."""
    sums = groups.agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("g"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk"))
    over = F.try_divide  # null where there is one group or none
    p = over(F.col("k"), F.col("n"))
    size = over(F.col("n") - over(F.col("n2"), F.col("n")), F.col("g") - 1)
    between = over(over(F.col("kk") - F.col("n") * p * p, F.col("g") - 1) - p * (1 - p), size)
    strength = F.when((F.col("g") > 1) & (size > 0) & (between > 0), F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), over(p * (1 - p), between) - 1))).otherwise(STRONGEST)
    return sums.select(strength.alias("strength"))


#: A port after a name, and an address in numbers.
PORT, NUMBERS = r"^.*@|:[0-9]*$", r"^[0-9]+([.][0-9]+){3}$|^\["


def registered(host: Column) -> tuple[Column, Column]:
    """(registered domain, its suffix) of a host; an address in numbers has suffix ''."""
    name = F.regexp_replace(host, PORT, "")
    two, three = F.substring_index(name, ".", -2), F.substring_index(name, ".", -3)
    long = two.isin(*SUFFIXES)
    number = name.rlike(NUMBERS)
    domain = F.when(number, name).when(long, three).otherwise(two)
    return domain, F.when(number, "").when(long, two).otherwise(F.substring_index(name, ".", -1))


def reputation(outcomes: DataFrame) -> DataFrame:
    """(host, n, k, mean, bound) from outcomes (host, bad 0/1): posterior of the rate of bad pages, with its lower bound."""
    domain, suffix = registered(F.col("host"))
    hosts = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("k")).withColumn("domain", domain).withColumn("suffix", suffix)
    hosts = materialize(hosts, "url-hosts")  # every level is summed up from it: pages are read once
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = _level(domains, "suffix")
    top = suffixes.agg(((F.sum("k") + 1) / (F.sum("n") + 2)).alias("top"))
    up = lambda mean, s: (F.col(s) * F.col(mean) + F.col("k")) / (F.col(s) + F.col("n"))
    suffixes = suffixes.withColumns({"s": _strength(suffixes).scalar(), "top": top.scalar()}).select("suffix", up("top", "s").alias("suffix_mean"))
    domains = domains.withColumn("s", _strength(domains).scalar()).join(suffixes, "suffix").select("domain", up("suffix_mean", "s").alias("domain_mean"))
    hosts = hosts.withColumn("s", _strength(hosts).scalar()).join(domains, "domain").select("host", "n", "k", "s", up("domain_mean", "s").alias("mean"))
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("s") + F.col("n") + 1))
    return hosts.select("host", "n", "k", "mean", (F.col("mean") - Z * sd).alias("bound"))


def judge(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) of pages (page_id, url); labelled has (page_id, bad 0/1) for some of them."""
    host, path = parsed()
    own = pages.select("page_id", host.alias("host"), path.alias("path"))
    once = labelled.where(F.col("bad").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("bad"))
    outcomes = own.select("page_id", "host").join(once, "page_id").select("host", "bad")
    blocked = reputation(outcomes).where(F.col("bound") > LIMIT).select("host", F.lit("block").alias("by_host"))
    rule, verdict = ruled(F.col("host"), F.col("path"))
    return own.join(blocked, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "by_host", F.lit("allow")).alias("verdict"))
