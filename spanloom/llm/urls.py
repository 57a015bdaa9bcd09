"""URL filters: rules first, else the reputation of the host, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.text import ascii_lower
from spanloom.session import stored

#: Fixed values: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: A country's code after one of these labels is a suffix of two labels, under which names are registered.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "mil", "ne", "net", "or", "org")
TWO_LABELS = rf"^(?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}$"
#: A page is blocked if its host's rate of bad pages exceeds LIMIT even at the lower bound of Z standard deviations.
LIMIT, Z = 0.5, 1.645
#: Bounds of a prior's weight, in pages.
WEIGHTS = (2.0, 1000.0)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): A-Z of the host lower-cased; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    path = F.when(F.substring(path, 1, 1) == "/", path).otherwise("")
    none = F.coalesce(at, F.lit(0)) == 0
    return F.when(none, "").otherwise(ascii_lower(host)), F.when(none, "").otherwise(path)


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path; nulls without one."""
    order = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    name = verdict = None
    for kind, rule_host, rule_path in order:
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path) if name is None else name.when(fits, rule_host + rule_path)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return name, verdict


def domain_of(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix); a host of one label or an address is its own domain and suffix."""
    two = F.substring_index(host, ".", -2)
    long_suffix = two.rlike(TWO_LABELS)
    whole = host.rlike(r"^[0-9.]+$|^[^.]*$|^\[")
    suffix = F.when(whole, host).when(long_suffix, two).otherwise(F.substring_index(host, ".", -1))
    domain = F.when(whole, host).when(long_suffix, F.substring_index(host, ".", -3)).otherwise(two)
    return domain, suffix


def _weight(level: DataFrame, keys: list[str]) -> DataFrame:
    """Prior weight for the children of each key, from how much their rates scatter (method of moments)."""
    n, bad = F.sum("n"), F.sum("bad")
    rate = bad / n
    scatter = F.sum(F.col("bad") * F.col("bad") / F.col("n")) / n - rate * rate
    expected = rate * (1 - rate)
    kids = F.count(F.lit(1))
    own = F.greatest(scatter - expected * kids / n, expected / WEIGHTS[1])
    weight = F.when((expected > 0) & (kids > 1), F.least(F.greatest(expected / own - 1, F.lit(WEIGHTS[0])), F.lit(WEIGHTS[1]))).otherwise(F.lit(WEIGHTS[1] / 10))
    return level.groupBy(*keys).agg(n.alias("n"), bad.alias("bad"), weight.alias("weight"))


def reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(host, n, bad, rate, lower): the posterior rate of bad pages for each host of ``pages`` (page_id, host).

    outcomes: (page_id, bad 0 or 1); further ones of a page are averaged. Counts go from
    pages to hosts, registered domains, suffixes and all pages; each level's beta prior
    is the posterior of the level above, weighted by how its children scatter.
    """
    marks = outcomes.filter("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.avg("bad").alias("bad"))
    seen = pages.filter("page_id IS NOT NULL").join(marks, "page_id").groupBy("host").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("bad").alias("bad"))
    hosts = pages.select("host").distinct().join(seen, "host", "left").na.fill(0.0, ["n", "bad"])
    domain, suffix = domain_of(F.col("host"))
    hosts = stored(hosts.withColumn("domain", domain).withColumn("suffix", suffix), "hosts")
    domains = _weight(hosts.filter("n > 0"), ["domain", "suffix"])
    suffixes = _weight(domains.select("domain", "suffix", "n", "bad"), ["suffix"])
    every = _weight(suffixes.select("suffix", "n", "bad"), [])

    def shrunk(bad: str, n: str, prior: str, weight: str) -> Column:
        return (F.coalesce(bad, F.lit(0.0)) + F.col(prior) * F.col(weight)) / (F.coalesce(n, F.lit(0.0)) + F.col(weight))

    top = every.select(F.coalesce((F.col("bad") + 1) / (F.col("n") + 2), F.lit(0.5)).alias("p0"), F.coalesce("weight", F.lit(WEIGHTS[0])).alias("w0")).first()
    s = suffixes.withColumn("p0", F.lit(top.p0)).withColumn("w0", F.lit(top.w0)).select("suffix", shrunk("bad", "n", "p0", "w0").alias("p1"), F.col("weight").alias("w1"))
    d = domains.select("domain", "suffix", "n", "bad", F.col("weight").alias("w2")).join(s, "suffix").select("domain", "suffix", shrunk("bad", "n", "p1", "w1").alias("p2"), "w2")
    known = hosts.join(d, ["domain", "suffix"], "left").join(s, "suffix", "left")
    prior = F.coalesce("p2", "p1", F.lit(top.p0))
    weight = F.coalesce("w2", "w1", F.lit(top.w0))
    a, b = F.col("bad") + prior * weight, F.col("n") - F.col("bad") + (1 - prior) * weight
    rate = a / (a + b)
    lower = rate - Z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return known.select("host", "n", "bad", rate.alias("rate"), lower.alias("lower"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: tuple = RULES, limit: float = LIMIT) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_rate) for each row of ``pages`` (page_id, url; others are ignored).

    verdict is that of the longest fitting rule, else ``block`` where the lower posterior
    bound of the host's rate of bad pages exceeds ``limit``, else ``allow``. A null url or
    one without ``://`` has an empty host and path, a host like others to the reputation.
    Repeated rows are judged one by one. Empty tables give no rows, or the prior alone.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    known = reputation(rows.select("page_id", "host"), outcomes)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = rows.join(known.select("host", "rate", "lower"), "host", "left")
    own = F.when(F.col("lower") > limit, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.col("rate").alias("bad_rate"))


def outcomes_of(labels: DataFrame) -> DataFrame:
    """Page outcomes from ``labels`` (doc_id, quality, toxic): a page is bad if it is toxic or of low quality."""
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    return labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
