"""URL filtering by rules first and by host reputation where no rule fits.

Reputation is empirical Bayes in three steps: labelled page outcomes are counted by host, and each level's rates are shrunk by a beta prior towards
the rate of the level above: suffix towards all pages, registered domain towards its suffix, host towards its domain. The strength of a
level's prior is fitted to the spread of its rates around their parents by moments. A posterior's variance is that of its own beta distribution and, by the
prior's share in it, the parent's, so a host with few labels is never surer than its domain. A host is blocked if its posterior bad rate, less ``z`` standard
deviations, exceeds ``bad_rate``; a host without labelled pages takes the posterior of its domain, then of its suffix.

The registered domain is the last two labels of a host, or three where the last two are a public suffix of two labels (``SECOND_LEVEL`` before a
two-letter country); the suffix is what follows its first label. Only the levels' strengths (three numbers) and the overall counts reach
the driver; hosts are joined back by Spark, which broadcasts them only below its own size check and splits hot hosts otherwise.

Rows: a null url or one without ``://`` has an empty host and path and is judged by no rule; pages without a label count in no
rate; a label that repeats for a page counts once, a page listed twice is judged twice; null labels count as none; empty tables give an empty
result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

BAD_RATE = 0.5
Z = 2.0
# Labels that registries put before a country code.
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "net", "org"]


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def domain_of(host: Column) -> Column:
    """The registered domain."""
    second = "|".join(SECOND_LEVEL)
    long = F.regexp_extract(host, rf"([^.]+\.(?:{second})\.[a-z][a-z])$", 1)
    return F.when(long != "", long).otherwise(F.regexp_extract(host, r"([^.]+\.[^.]+|[^.]*)$", 1))


def suffix_of(domain: Column) -> Column:
    """The public suffix of a registered domain."""
    return F.regexp_replace(domain, r"^[^.]*\.?", "")


def rule_column(rules: list[tuple[str, str]], host: Column, path: Column) -> Column:
    """The longest rule that fits: (verdict, rule), or null. A rule ``host/path`` fits its host and its subdomains."""
    fits = []
    for verdict, rule in rules:
        name, slash, start = rule.partition("/")
        test = (host == name) | host.endswith(f".{name}")
        fits.append(F.when(test & path.startswith(slash + start), F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    none = F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    return F.array_max(F.array(none, *fits))


def level(counts: DataFrame, key: str, parents: DataFrame | None, parent: str, overall: tuple[float, float]) -> DataFrame:
    """Posterior of one level: key, mean, var. ``counts``: key, parent, n, bad; ``parents``: parent, m, v (mean and variance), or else ``overall``'s."""
    joined = counts.withColumn("m", F.lit(overall[0])).withColumn("v", F.lit(overall[1])) if parents is None else counts.join(parents, parent)
    sums = joined.agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("m"), 2)).alias("spread"),
        F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))).alias("noise"), F.sum(F.col("m") * (1 - F.col("m"))).alias("each"),
    ).first()
    strength = F.lit(prior_strength(sums["n"] or 0, sums["spread"] or 0.0, sums["noise"] or 0.0, sums["each"] or 0.0))
    total = F.col("n") + strength
    mean = (F.col("bad") + strength * F.col("m")) / total
    return joined.select(key, mean.alias("mean"), (mean * (1 - mean) / (total + 1) + F.pow(strength / total, 2) * F.col("v")).alias("var"))


def prior_strength(n: int, spread: float, noise: float, each: float) -> float:
    """Pseudo-count of a beta prior from the spread of rates around their means, less the binomial noise."""
    if not n or noise <= 0:
        return 1.0
    between = (spread - each) / n
    return min(max(noise / n / between - 1, 1.0), 1e6) if between > 0 else 1e6


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, bad of every page whose document has a label (doc_id, bad): the document's number follows the path's first folder (``/en/5462``).

    A path without such a number, or with one of more than 18 digits, has no document.
    """
    number = F.regexp_extract(path_of(F.col("url")), r"^/[^/]+/(\d{1,18})(?:/|$)", 1)
    numbered = pages.select("page_id", F.when(number != "", number).cast("long").alias("doc_id"))
    return numbered.join(labels.select("doc_id", "bad"), "doc_id").select("page_id", "bad")


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], bad_rate: float = BAD_RATE, z: float = Z
) -> DataFrame:
    """page_id, host, path, rule, verdict of every page. ``outcomes``: page_id, bad (boolean); ``rules``: (verdict, rule)."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    seen = stored(pages.select("page_id", host.alias("host"), path.alias("path")), "urls")
    labelled = outcomes.filter("bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = (
        seen.filter("host <> ''").join(labelled, "page_id").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
        .withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain")))
    )
    hosts = stored(hosts, "hosts")
    sums = hosts.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    mean = sums["bad"] / sums["n"] if sums["n"] else 0.0
    overall = (mean, mean * (1 - mean) / (sums["n"] + 1))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by_suffix = level(suffixes, "suffix", None, "", overall)
    by_domain = level(domains, "domain", by_suffix.select("suffix", F.col("mean").alias("m"), F.col("var").alias("v")), "suffix", overall)
    by_host = level(hosts, "host", by_domain.select("domain", F.col("mean").alias("m"), F.col("var").alias("v")), "domain", overall)

    def blocked(posterior: DataFrame, key: str) -> DataFrame:
        return posterior.select(key, (F.col("mean") - z * F.sqrt("var") > bad_rate).alias(f"{key}_blocked"))

    fitting = rule_column(rules, F.col("host"), F.col("path"))
    out = seen.withColumn("fit", F.when(F.col("host") != "", fitting)).withColumn("domain", domain_of(F.col("host")))
    out = out.withColumn("suffix", suffix_of(F.col("domain")))
    for posterior, key in ((by_host, "host"), (by_domain, "domain"), (by_suffix, "suffix")):
        out = out.join(blocked(posterior, key), key, "left")
    bad = F.coalesce(F.col("host_blocked"), F.col("domain_blocked"), F.col("suffix_blocked"), F.lit(False))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(bad, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))


def oracle_sql(rules: list[tuple[str, str]], bad_rate: float = BAD_RATE, z: float = Z) -> str:
    """The same verdicts as DuckDB SQL over pages and labels (an outcome is bad if its quality is 0 or it is toxic)."""
    second = "|".join(SECOND_LEVEL)
    values = ", ".join(f"('{verdict}', '{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}')" for verdict, rule in rules)

    def strength(source: str) -> str:
        return f"""SELECT CASE WHEN coalesce(sum(n), 0) = 0 OR sum(n * m * (1 - m)) <= 0 THEN 1.0
            WHEN sum(n * pow(bad / n - m, 2)) - sum(m * (1 - m)) > 0
            THEN least(greatest(sum(n * m * (1 - m)) / (sum(n * pow(bad / n - m, 2)) - sum(m * (1 - m))) - 1, 1.0), 1e6) ELSE 1e6 END AS s FROM {source}"""

    def lower(alias: str) -> str:
        return f"{alias}.mean - {z} * sqrt({alias}.var) > {bad_rate}"

    def posterior(key: str, source: str, strengths: str) -> str:
        return f"""SELECT {key}, mean, mean * (1 - mean) / (n + s + 1) + pow(s / (n + s), 2) * v AS var
            FROM (SELECT *, (bad + s * m) / (n + s) AS mean FROM {source}, {strengths})"""

    return rf"""
    WITH u AS (
        SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
    ), d AS (
        SELECT *, CASE WHEN regexp_matches(host, '[^.]+\.({second})\.[a-z][a-z]$') THEN regexp_extract(host, '([^.]+\.({second})\.[a-z][a-z])$', 1)
            ELSE regexp_extract(host, '([^.]+\.[^.]+|[^.]*)$', 1) END AS domain FROM u
    ), s AS (
        SELECT *, regexp_replace(domain, '^[^.]*\.?', '') AS suffix FROM d
    ), labelled AS (
        SELECT page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NULL AND toxic IS NULL THEN NULL ELSE 0 END) AS bad
        FROM (SELECT page_id, regexp_extract(path, '^/[^/]+/(\d{{1,18}})(?:/|$)', 1) AS number FROM u) JOIN labels
            ON number <> '' AND doc_id = try_cast(number AS BIGINT) GROUP BY page_id
    ), hosts AS (
        SELECT host, any_value(domain) AS domain, any_value(suffix) AS suffix, count(*) AS n, sum(bad) AS bad
        FROM s JOIN labelled USING (page_id) WHERE host <> '' AND bad IS NOT NULL GROUP BY host
    ), overall AS (SELECT m, m * (1 - m) / (n + 1) AS v FROM (SELECT coalesce(sum(bad) / sum(n), 0) AS m, coalesce(sum(n), 0) AS n FROM hosts)),
    c1 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT m FROM overall) AS m, (SELECT v FROM overall) AS v FROM hosts GROUP BY suffix),
    s1 AS ({strength("c1")}),
    p1 AS ({posterior("suffix", "c1", "s1")}),
    c2 AS (SELECT domain, sum(n) AS n, sum(bad) AS bad, any_value(p1.mean) AS m, any_value(p1.var) AS v FROM hosts JOIN p1 USING (suffix) GROUP BY domain),
    s2 AS ({strength("c2")}),
    p2 AS ({posterior("domain", "c2", "s2")}),
    c3 AS (SELECT host, n, bad, p2.mean AS m, p2.var AS v FROM hosts JOIN p2 USING (domain)),
    s3 AS ({strength("c3")}),
    p3 AS ({posterior("host", "c3", "s3")}),
    rules(v, rule, name, start) AS (VALUES {values}),
    fits AS (
        SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v
        FROM s JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY page_id
    )
    SELECT s.page_id, s.host, s.path, fits.rule,
        coalesce(fits.v, CASE WHEN coalesce({lower("p3")}, {lower("p2")}, {lower("p1")}, false) THEN 'block' ELSE 'allow' END) AS verdict
    FROM s LEFT JOIN fits ON s.page_id = fits.page_id LEFT JOIN p3 ON s.host = p3.host LEFT JOIN p2 ON s.domain = p2.domain LEFT JOIN p1 ON s.suffix = p1.suffix
    """
