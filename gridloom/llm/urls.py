"""URL filters: rules for hosts and paths, then an empirical-Bayes reputation of hosts.

Labelled pages are outcomes (bad or not). A host's rate of bad outcomes is shrunk to its registered domain's, that to its
suffix's, and that to the overall rate, each by a beta prior whose strength is fitted to how far the rates of that level
scatter around their parents (method of moments for the beta-binomial). A host is blocked if a lower bound of its
posterior, mean less ``z`` deviations, is over ``most_bad``. Rules come first.

The suffix is the last label of the host, or one of ``long_suffixes``; the registered domain is one label more. User
parts and ports don't count for either.

Defined results: a null url or one without ``://`` has empty host and path, fits no rule and is judged under the empty
host. A label counts once for each page row with its id; several labels of an id count as bad if any is. Without labels
nobody is blocked. Repeated rows are judged alike; an empty table gives an empty table. Columns other than those named
in the arguments are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.session import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[str]) -> Column:
    """The longest rule ``host/path`` that fits; null if none does."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def suffix_of(host: Column, long_suffixes: tuple[str, ...] = ()) -> Column:
    bare = F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":\d*$", "")
    found = F.substring_index(bare, ".", -1)
    for s in sorted(long_suffixes, key=len):
        found = F.when((bare == s) | bare.endswith("." + s), F.lit(s)).otherwise(found)
    return found


def domain_of(host: Column, suffix: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":\d*$", "")
    before = F.expr("''") if suffix is None else F.substring(bare, F.lit(1), F.greatest(F.length(bare) - F.length(suffix) - 1, F.lit(0)))
    return F.when(before == "", bare).otherwise(F.concat_ws(".", F.substring_index(before, ".", -1), suffix))


def _strength(level: DataFrame) -> float:
    """Pseudo-observations of the prior of rows (n, k, parent): 1/rho - 1, where rho is the excess scatter."""
    spread = F.col("parent") * (1 - F.col("parent"))
    r = (
        level.where("n > 0")
        .agg(
            F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("parent"), 2)).alias("s"),
            F.sum(spread).alias("v"),
            F.sum(spread * (F.col("n") - 1)).alias("w"),
        )
        .first()
    )
    rho = (r["s"] - r["v"]) / r["w"] if r["w"] else 0.5
    rho = min(max(rho, 0.001), 0.9)
    return 1 / rho - 1


def host_reputation(pages: DataFrame, outcomes: DataFrame, long_suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(host, n, k, mean, deviation) for every host of ``pages`` (page_id, host); ``outcomes``: (page_id, bad)."""
    marks = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    hosts = (
        pages.select("page_id", "host").join(marks, "page_id", "left")
        .groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
        .withColumn("suffix", suffix_of(F.col("host"), long_suffixes))
        .withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    )
    hosts = saved(hosts, "host-outcomes")
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    total = hosts.agg(*sums).first()
    overall = ((total["k"] or 0) + 1) / ((total["n"] or 0) + 2)
    suffixes = suffixes.withColumn("parent", F.lit(overall))

    def shrunk(level: DataFrame, name: str, key: str) -> DataFrame:
        m = _strength(level)
        return level.select(F.col(name).alias(key), ((m * F.col("parent") + F.col("k")) / (m + F.col("n"))).alias("parent"))

    domains = domains.join(shrunk(suffixes, "suffix", "suffix"), "suffix")
    hosts = hosts.join(shrunk(domains, "domain", "domain"), "domain")
    m = _strength(hosts)
    a, b = m * F.col("parent") + F.col("k"), m * (1 - F.col("parent")) + F.col("n") - F.col("k")
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.select("host", "n", "k", (a / (a + b)).alias("mean"), deviation.alias("deviation"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: dict[str, str], most_bad: float = 0.5, z: float = 1.645, id_col: str = "page_id", url_col: str = "url", long_suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, host, path, rule, bad_bound, verdict) of every page. ``rules``: rule -> allow or block."""
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    parts = urls.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = host_reputation(parts, outcomes, long_suffixes)
    bound = known.select("host", (F.col("mean") - z * F.col("deviation")).alias("bad_bound"))
    verdict = F.when(F.col("bad_bound") > most_bad, "block").otherwise("allow")
    for rule, said in rules.items():
        verdict = F.when(F.col("rule") == rule, said).otherwise(verdict)
    return (
        parts.join(bound, "host")
        .withColumn("rule", matching_rule(F.col("host"), F.col("path"), list(rules)))
        .select("page_id", "host", "path", "rule", "bad_bound", verdict.alias("verdict"))
    )
