r"""Quality rules of documents, and verdicts on whole hosts drawn from them. DataFrame functions only.

Words are runs of characters other than space and \x09-\x0D. A document's base rules: too few words, or too many of its words inside
three-word windows that the text holds twice or more. A host (``source``) is judged by its documents' failures: its failure
rate is shrunk towards the rate of all hosts by a beta prior fitted to the hosts' rates by moments, so that a host with few documents says
little; a host whose posterior rate lies above ``host_rate`` by ``z`` standard deviations fails with all its documents.

Windows are compared by 64-bit hashes, sorted together with their places inside the row: no row is ever exploded, a text of any length stays one
row, and the only shuffle is the sum of failures by host, added up in each task first.

Rows: a null text has no words and fails; a document with a null source has no host and keeps its own verdict; equal rows count each; an
empty table gives an empty result; further columns are kept by ``passing`` and not read by ``judged``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import only, stored

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
HOST_RATE = 0.8
HOST_Z = 2.0
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more."""

    def packed(w: Column, bits: Column) -> Column:
        # The hash's low bits above the window's place: one sort of longs brings equal windows side by side.
        return F.transform(
            F.slice(w, 1, F.size(w) - 2),
            lambda x, i: F.call_function("shiftleft", F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i.cast("long")),
        )

    def same(a: Column, b: Column, bits: Column) -> Column:
        return F.call_function("shiftrightunsigned", a, bits) == F.call_function("shiftrightunsigned", b, bits)

    def places(s: Column, w: Column, bits: Column) -> Column:
        twice = F.filter(s, lambda x, i: F.coalesce(same(x, F.get(s, i + 1), bits), F.lit(False)) | ((i > 0) & F.coalesce(same(x, F.get(s, F.greatest(i - 1, F.lit(0))), bits), F.lit(False))))
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        return F.array_sort(F.transform(twice, lambda x: x.bitwiseAND(mask)))

    def covered(p: Column) -> Column:
        # Three words for each window, less what it shares with the one before.
        shares = F.transform(p, lambda x, k: F.when(k > 0, F.greatest(F.lit(0).cast("long"), F.lit(3) - (x - F.get(p, F.greatest(k - 1, F.lit(0)))))).otherwise(F.lit(0).cast("long")))
        return F.lit(3) * F.size(p).cast("long") - F.aggregate(shares, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def count(w: Column) -> Column:
        bits = F.length(F.bin(F.size(w).cast("long")))
        return let(bits, lambda b: let(F.sort_array(packed(w, b)), lambda s: let(places(s, w, b), covered)))

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(count(w)))


def measures(text: Column) -> dict[str, Column]:
    """The measures of a text, each a long. ``words`` must be taken first and stands in the others as a column."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD))
    return {
        "n_symbols": F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
    }


def measured(docs: DataFrame, text: Column, prefix: str = "") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    name = lambda c: f"{prefix}{c}"
    words = name("words")
    out = docs.withColumn(words, F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), ""))
    found = {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_repeat_words": repeat_words(F.col(words)),
    } | measures(text)
    out = out.select(*[F.col(c) for c in docs.columns], *[v.alias(name(k)) for k, v in found.items()])
    failed = (F.col(name("n_words")) < MIN_WORDS) | (100 * F.col(name("n_repeat_words")) > MAX_REPEAT_PERCENT * F.col(name("n_words")))
    return out.withColumn(name("base_failed"), failed)


def host_verdicts(flags: DataFrame, host_rate: float = HOST_RATE, z: float = HOST_Z) -> DataFrame:
    """Hosts with their counts and verdict. ``flags``: host, failed. Two numbers of the prior reach the driver."""
    hosts = flags.filter("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("bad"))
    hosts = stored(hosts, "hosts")
    sums = hosts.agg(
        F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("square")
    ).first()
    mean, strength = beta_prior(sums["hosts"], sums["n"] or 0, sums["bad"] or 0, sums["square"] or 0.0)
    total = F.col("n") + F.lit(strength)
    rate = (F.col("bad") + F.lit(strength * mean)) / total
    spread = F.sqrt(rate * (1 - rate) / (total + 1))
    return hosts.select("host", "n", "bad", rate.alias("rate"), (rate - z * spread > host_rate).alias("rejected"))


def beta_prior(hosts: int, n: int, bad: int, square: float) -> tuple[float, float]:
    """Mean and strength (pseudo-documents) of the beta prior, from the hosts' rates by moments; ``square``: sum of bad^2 / n."""
    if not n:
        return 0.5, 1.0
    mean = bad / n
    noise = mean * (1 - mean)
    between = square / n - mean * mean - noise * hosts / n
    strength = noise / between - 1 if between > 0 and noise > 0 else 1e6 if noise > 0 else 1.0
    return mean, min(max(strength, 1.0), 1e6)


def judged(docs: DataFrame, host_rate: float = HOST_RATE, z: float = HOST_Z) -> DataFrame:
    """Measures and verdicts of every document: doc_id, the measures, base_failed, host_failed, kept."""
    flags = stored(measured(only(docs, "doc_id", "text", "source"), F.col("text")).drop("text"), "quality")
    hosts = host_verdicts(flags.select(F.col("source").alias("host"), F.col("base_failed").alias("failed")), host_rate, z)
    bad = hosts.filter("rejected").select(F.col("host").alias("source"), F.lit(True).alias("host_failed"))
    out = flags.join(bad, "source", "left").withColumn("host_failed", F.coalesce("host_failed", F.lit(False)))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_failed",
        (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"),
    )


def passing(docs: DataFrame, host_rate: float = HOST_RATE, z: float = HOST_Z) -> DataFrame:
    """The documents that pass, with all their columns."""
    tag = f"_{uuid.uuid4().hex}_"
    flags = measured(docs, F.col("text"), tag).select(*[F.col(c) for c in docs.columns], F.col(f"{tag}base_failed").alias(tag))
    flags = stored(flags, "quality")
    hosts = host_verdicts(flags.select(F.col("source").alias("host"), F.col(tag).alias("failed")), host_rate, z)
    bad = hosts.filter("rejected").select(F.col("host").alias(f"{tag}host"))
    return flags.filter(~F.col(tag)).join(bad, F.col("source") == F.col(f"{tag}host"), "left_anti").drop(tag)


def oracle_sql(documents: str = "documents", host_rate: float = HOST_RATE, z: float = HOST_Z) -> str:
    """The same verdicts as DuckDB SQL."""
    return rf"""
    WITH w AS (
        SELECT doc_id, source, coalesce(text, '') AS text,
            list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
        FROM {documents}
    ), windows AS (
        SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)
    ), twice AS (
        SELECT doc_id, g FROM windows GROUP BY doc_id, g HAVING count(*) > 1
    ), covered AS (
        SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
        FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM windows JOIN twice USING (doc_id, g)) GROUP BY doc_id
    ), lines AS (
        SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w
    ), m AS (
        SELECT w.doc_id, w.source, len(words)::BIGINT AS n_words,
            coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
            len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
            (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
            len(words) < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {MAX_REPEAT_PERCENT} * len(words) AS base_failed
        FROM w JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
    ), hosts AS (
        SELECT source, count(*) AS n, sum(base_failed::INT) AS bad FROM m WHERE source IS NOT NULL GROUP BY source
    ), moments AS (
        SELECT count(*) AS k, sum(n) AS n, sum(bad) / sum(n) AS mean, sum(bad * bad / n) AS square FROM hosts
    ), prior AS (
        SELECT mean, mean * (1 - mean) AS noise, square / n - mean * mean - mean * (1 - mean) * k / n AS between_hosts FROM moments
    ), strength AS (
        SELECT mean, least(greatest(CASE WHEN between_hosts > 0 AND noise > 0 THEN noise / between_hosts - 1
            WHEN noise > 0 THEN 1e6 ELSE 1.0 END, 1.0), 1e6) AS s FROM prior
    ), rates AS (
        SELECT source, (bad + s * mean) / (n + s) AS rate, n + s AS total FROM hosts, strength
    ), verdicts AS (
        SELECT source, rate - {z} * sqrt(rate * (1 - rate) / (total + 1)) > {host_rate} AS rejected FROM rates
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        coalesce(rejected, false) AS host_failed, NOT base_failed AND NOT coalesce(rejected, false) AS kept
    FROM m LEFT JOIN verdicts USING (source)
    """
