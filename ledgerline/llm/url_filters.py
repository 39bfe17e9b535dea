"""URL filters: explicit host and path rules, then empirical-Bayes host reputation.

Labelled outcomes (1 good, 0 bad) are counted per host, registered domain and
suffix. Each level is a beta-binomial whose prior mean is the posterior mean of
the level above and whose prior strength is fitted by moments over that level;
the top level is shrunk to the overall rate. A URL without a fitting rule is
allowed if the lower bound of its host's posterior reaches ``least_good``.

Defined results: a NULL URL or one without ``://`` has an empty host and path,
fits no rule, and is judged like an unknown host. Unknown hosts take the
posterior of their domain, suffix or the overall rate, whichever is known first.
Without any labels the overall rate is that of the given base prior. Outcomes
that are NULL count nothing; repeated outcomes count as often as they occur.
Repeated pages give repeated rows. Extra columns of the pages are kept out of
the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.llm.common import LOWER, UPPER
from ledgerline.operators.rows import join_on
from ledgerline.session import materialize


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """Lower-cased host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end; else empty."""
    host = F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest fitting rule, or NULLs.

    The rules are a list of the caller; they become one expression. Among equally
    long ones the longer host wins, then block.
    """
    text = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.verdict != "block", r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text = F.when(fits, r.text) if text is None else text.when(fits, r.text)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text, verdict)


def is_address(host: Column) -> Column:
    """An IPv4 address, or an IPv6 address in brackets."""
    return host.rlike(r"^([0-9]+(\.[0-9]+){3}|\[.*\])$")


# Suffixes of two labels below which domains are registered. A longer list may be given instead.
LONG_SUFFIXES = (
    "ac.jp", "ac.nz", "ac.uk", "ac.za", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za",
    "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.eg", "com.hk", "com.mx", "com.my", "com.ng", "com.pe", "com.ph", "com.pk",
    "com.sa", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "go.jp", "gov.au", "gov.br", "gov.cn", "gov.in",
    "gov.uk", "ne.jp", "net.au", "net.br", "net.cn", "net.nz", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.nz", "org.uk", "org.za",
)


def registered_domain(host: Column, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> Column:
    """The suffix and one label before it; a host of one label is its own domain, as is an address. Ports don't count."""
    host = F.regexp_replace(host, ":[0-9]*$", "")
    labels = F.split(host, r"\.")
    two, three = (F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(n)), n), ".") for n in (2, 3))
    named = F.when(two.isin(*long_suffixes), three).otherwise(two) if long_suffixes else two
    return F.when(is_address(host), host).otherwise(named)


def suffix_of(domain: Column) -> Column:
    """What follows the first dot of a registered domain; without one, or of an address, the domain itself."""
    at = F.instr(domain, ".")
    return F.when((at > 0) & ~is_address(domain), F.substring(domain, at + F.lit(1), F.length(domain))).otherwise(domain)


@dataclass(frozen=True)
class Prior:
    """Limits of the fit: base successes and failures, least and greatest correlation within a unit."""

    good: float = 1.0
    bad: float = 1.0
    least_rho: float = 0.001
    most_rho: float = 0.5


def _shrunk(units: DataFrame, prior: Prior) -> DataFrame:
    """Posterior of every unit from its counts ``n``, ``k`` and its parent's mean ``m``.

    With rho the correlation of two outcomes of one unit, the squared deviations
    weighted by n have the mean m(1-m)(1 + (n-1) rho); rho is solved from their
    sums, one aggregated row, and the prior counts as 1/rho - 1 outcomes.
    """
    variance = F.col("m") * (1 - F.col("m"))
    counted = units.filter("n > 0")
    s = counted.agg(
        F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("m"), 2)).alias("seen"),
        F.sum(variance).alias("one"),
        F.sum(variance * (F.col("n") - 1)).alias("more"),
    ).first()
    rho = prior.most_rho if not s.more else (s.seen - s.one) / s.more
    weight = 1 / min(max(rho, prior.least_rho), prior.most_rho) - 1
    a, b = F.col("k") + weight * F.col("m"), F.col("n") - F.col("k") + weight * (1 - F.col("m"))
    return units.withColumn("a", a).withColumn("b", b).withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))


def host_reputation(
    hosts: DataFrame, outcomes: DataFrame, prior: Prior = Prior(), long_suffixes: Sequence[str] = LONG_SUFFIXES
) -> DataFrame:
    """Posterior ``a``, ``b`` and ``mean`` of every distinct ``host`` of ``hosts``.

    ``outcomes`` has ``host`` and ``good`` (0 or 1). Counts combine map-side, so a
    hot host costs one row per map task; the levels above work on the counts.
    """
    counts = (
        outcomes.filter(F.col("good").isNotNull())
        .select("host", F.col("good").cast("long").alias("k"), F.lit(1).cast("long").alias("n"))
        .unionByName(hosts.select("host", F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("n")))
        .groupBy("host")
        .agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        .withColumn("domain", registered_domain(F.col("host"), long_suffixes))
        .withColumn("suffix", suffix_of(F.col("domain")))
    )
    counts = materialize(counts, "hosts")
    domains = counts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    overall = (total.k + prior.good) / (total.n + prior.good + prior.bad)
    top = materialize(_shrunk(suffixes.withColumn("m", F.lit(overall)), prior), "suffixes")
    middle = join_on(domains, top.select("suffix", F.col("mean").alias("m")), ["suffix"])
    middle = materialize(_shrunk(middle, prior), "domains")
    low = join_on(counts, middle.select("domain", F.col("mean").alias("m")), ["domain"])
    return _shrunk(low, prior).select("host", "domain", "suffix", "n", "k", "a", "b", "mean")


def filter_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[Rule] = (),
    key: str = "page_id",
    url: str = "url",
    least_good: float = 0.5,
    z: float = 1.645,
    prior: Prior = Prior(),
    long_suffixes: Sequence[str] = LONG_SUFFIXES,
) -> DataFrame:
    """Every page with ``host``, ``path``, ``rule``, ``verdict`` and its host's posterior mean and bound.

    ``outcomes`` has ``url`` and ``good``. The bound is the posterior mean less z
    standard deviations. The table of hosts is stored, so Catalyst knows its size
    and broadcasts it only when small; otherwise adaptive execution splits hot hosts.
    """
    parsed = pages.select(
        F.col(key).alias("_key"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path")
    )
    labelled = outcomes.select(url_host(F.col("url")).alias("host"), "good")
    posterior = host_reputation(parsed.select("host").distinct(), labelled, prior, long_suffixes)
    a, b = F.col("a"), F.col("b")
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    judged = posterior.select("host", F.col("mean").alias("reputation"), (F.col("mean") - z * deviation).alias("bound"))
    judged = materialize(judged, "reputation")
    rule, rule_verdict = matching_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bound") >= least_good, "allow").otherwise("block")
    return join_on(parsed, judged, ["host"], "left").select(
        F.col("_key").alias(key),
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(rule_verdict, method).alias("verdict"),
        "reputation",
        "bound",
    )
