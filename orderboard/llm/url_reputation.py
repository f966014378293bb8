"""URL filter: rules first, then an empirical-Bayes reputation of the host.

Pages that a rule decides are the labelled outcomes. Their counts are summed for
each host, its registered domain, its suffix and all pages. From the top down
each level's rate is a beta-binomial posterior whose prior mean is the level
above; the prior's strength is estimated from how much the rates of that level
scatter (method of moments). A page without a rule is blocked if the lower bound
of its host's posterior block rate exceeds ``max_rate``.

Counts are summed within tasks before they are shuffled, priors are scalar
subqueries, and pages meet one row for each host.

Defined cases: a NULL url, or one without ``://``, has an empty host and path;
the empty host has a reputation like any other. A rule whose path begins with
``/`` does not fit an empty path. Repeated pages count as often as they occur.
Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderboard.llm.tables import stored, whole_row


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    block: bool

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("org", "/", block=False),
    Rule("example.org", "/es/", block=True),
    Rule("example.org", "/en/1", block=True),
    Rule("com", "/fr/", block=False),
    Rule("com", "/de/", block=True),
)
MAX_RATE = 0.5
Z = 1.645
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Second-level labels under which a country registers domains.
SHARED_LABELS = "co|com|net|org|gov|ac|edu"
DOMAIN = rf"([^.]+\.(?:(?:{SHARED_LABELS})\.[a-z]{{2}}|[^.:]+))(?::\d*)?$"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, "://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def decide(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and whether it blocks; NULL where none does."""
    rule, block = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule = F.when(fits, F.lit(r.text)).otherwise(rule)
        block = F.when(fits, F.lit(r.block)).otherwise(block)
    return rule, block


def _strength(level: DataFrame) -> Column:
    """The prior strength of a level with columns n, bad and parent rate ``above``.

    With rates x of n outcomes scattering by p q (1 + (n - 1) rho) / n around p,
    rho is estimated by moments; the strength is (1 - rho) / rho.
    """
    seen = level.filter(F.col("n") > 0)
    pq = F.col("above") * (1 - F.col("above"))
    off = F.col("bad") / F.col("n") - F.col("above")
    rho = F.try_divide(
        F.sum(F.col("n") * off * off) - F.sum(pq), F.sum((F.col("n") - 1) * pq)
    )
    bounded = F.greatest(F.least(F.coalesce(rho, F.lit(0.5)), F.lit(0.99)), F.lit(0.01))
    return seen.select(((1 - bounded) / bounded).alias("strength")).scalar()


def _shrunk(level: DataFrame, keep: Sequence[str]) -> DataFrame:
    strength = _strength(level)
    rate = (strength * F.col("above") + F.col("bad")) / (strength + F.col("n"))
    return level.select(*keep, rate.alias("above"))


def host_reputation(outcomes: DataFrame, max_rate: float = MAX_RATE, z: float = Z) -> DataFrame:
    """(host, rate, lower, blocked) from rows (host, block), block NULL where unlabelled."""
    block = F.col("block").cast("long")
    counts = stored(
        outcomes.groupBy("host").agg(F.count(block).alias("n"), F.coalesce(F.sum(block), F.lit(0)).alias("bad"))
        .select(
            "host",
            F.when(F.col("host").rlike(r"^[0-9.]+(:\d*)?$"), F.col("host"))
            .otherwise(F.coalesce(F.nullif(F.regexp_extract("host", DOMAIN, 1), F.lit("")), F.col("host")))
            .alias("domain"),
            "n",
            "bad",
        )
        .withColumn("suffix", F.regexp_extract("domain", r"\.(.*)$", 1)),
        "url-hosts",
    )
    overall = counts.select(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("rate")).scalar()

    def summed(*by: str) -> DataFrame:
        return counts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    # Each level is read twice, for its strength and for its rates.
    by_suffix = stored(summed("suffix").withColumn("above", overall), "url-suffixes")
    suffixes = _shrunk(by_suffix, ["suffix"])
    by_domain = stored(summed("domain", "suffix").join(suffixes, "suffix"), "url-domains")
    domains = _shrunk(by_domain, ["domain"])
    hosts = stored(counts.join(domains, "domain"), "url-host-priors")
    strength = _strength(hosts)
    a = strength * F.col("above") + F.col("bad")
    b = strength * (1 - F.col("above")) + F.col("n") - F.col("bad")
    return hosts.select("host", a.alias("a"), b.alias("b")).select(
        "host",
        (F.col("a") / (F.col("a") + F.col("b"))).alias("rate"),
        (
            F.col("a") / (F.col("a") + F.col("b"))
            - z
            * F.sqrt(
                F.col("a") * F.col("b")
                / ((F.col("a") + F.col("b")) * (F.col("a") + F.col("b")) * (F.col("a") + F.col("b") + 1))
            )
        ).alias("lower"),
    ).withColumn("blocked", F.col("lower") > max_rate)


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule] = RULES, max_rate: float = MAX_RATE, z: float = Z
) -> DataFrame:
    """Every page: ``row`` (its columns), host, path, rule, verdict, rate, lower."""
    split = pages.select(
        whole_row(pages).alias("row"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    rule, block = decide(F.col("host"), F.col("path"), rules)
    ruled = split.select("*", rule.alias("rule"), block.alias("block"))
    reputation = stored(host_reputation(ruled.select("host", "block"), max_rate, z), "url-reputation")
    block_it = F.coalesce(F.col("block"), F.col("blocked"))
    return ruled.join(reputation, "host", "left").select(
        "row",
        "host",
        "path",
        "rule",
        F.when(block_it, "block").otherwise("allow").alias("verdict"),
        "rate",
        "lower",
    )


def allowed_pages(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The pages the filter lets pass, columns unchanged."""
    return judge_urls(pages, rules).filter(F.col("verdict") == "allow").select("row.*")
