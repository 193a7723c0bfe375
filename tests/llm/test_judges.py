"""Quality rules, quality scores, URL reputation and language: brute force, held-out accuracy, odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from cases import PAGES, no_docs, odd_docs, prose
from pyspark.sql import functions as F

from tidemark.llm import language_id, quality_classifier, quality_rules, url_filter

MODEL = public_tokenizers.path("piece_bpe_32k.model")
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def rules_of(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
        len(words) < 50 or 100 * len(covered) > 50 * len(words),
    )


def test_rules_equal_brute_force(spark):
    docs = odd_docs(spark)
    draw = random.Random(1)
    more = [(100 + k, " ".join(draw.choice("ab c #x \n y\n".split(" ")) for _ in range(draw.randrange(0, 200))), "en", f"s{k % 3}") for k in range(40)]
    docs = docs.select("doc_id", "text", "lang", "source", "words").union(spark.createDataFrame([(*m, "w") for m in more], "doc_id long, text string, lang string, source string, words string"))
    got = sorted(str(tuple(r)[:7]) for r in quality_rules.judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    assert got == sorted(str((r["doc_id"], *rules_of(r["text"]))) for r in docs.collect())


def test_a_bad_host_fails_with_its_good_documents_and_small_hosts_do_not(spark):
    good, bad = prose(1, 80, 10**6), "no " * 80
    rows = [(k, bad if k % 20 else good, "en", "farm") for k in range(200)] + [(1000 + k, good, "en", f"h{k % 10}") for k in range(300)]
    rows += [(5000, bad, "en", "tiny"), (5001, good, "en", "tiny"), (5002, good, "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality_rules.judged(docs).collect()}
    assert got[0]["host_failed"] and not got[0]["base_failed"] and not got[0]["kept"]
    assert all(got[k]["kept"] for k in (1000, 1299, 5001, 5002)) and not got[5000]["host_failed"]
    assert sorted(r["doc_id"] for r in quality_rules.passing(docs).collect()) == sorted(k for k, r in got.items() if r["kept"])


def test_passing_keeps_columns_and_odd_rows(spark):
    docs = odd_docs(spark)
    kept = quality_rules.passing(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "2", "3", "9", "None"])
    assert quality_rules.judged(no_docs(spark)).collect() == [] and quality_rules.passing(no_docs(spark)).collect() == []


def test_rules_run_without_python(spark):
    plan = quality_rules.judged(odd_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_beta_prior():
    assert quality_rules.beta_prior(0, 0, 0, 0.0) == (0.5, 1.0)
    assert quality_rules.beta_prior(3, 30, 30, 30.0) == (1.0, 1.0)
    mean, strength = quality_rules.beta_prior(2, 2000, 1000, 900 * 900 / 1000 + 100 * 100 / 1000)
    assert mean == 0.5 and strength < 2


def test_scores_tell_junk_from_prose_on_held_out_rows(spark):
    rows, labels = [], []
    for k in range(600):
        text = prose(k, 100)
        bad = k % 4 == 0
        rows.append((k, " ".join(w + "###" for w in text.split()) if bad else text))
        labels.append((k, int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = quality_classifier.quality_scores(docs, spark.createDataFrame(labels, "doc_id long, label int"))
    truth = dict(labels)
    got = table.collect()
    assert len(got) == 600 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 100 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)
    flipped = [(d, 1 - y if spark_crc(d) % 3 == 1 else y) for d, y in labels]
    again = quality_classifier.quality_scores(docs, spark.createDataFrame(flipped, "doc_id long, label int")).collect()
    assert {r["doc_id"]: round(r["score"], 6) for r in again} == {r["doc_id"]: round(r["score"], 6) for r in got}


def spark_crc(number):
    import zlib

    return zlib.crc32(str(number).encode())


def test_scores_of_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (5, 0), (None, 1), (9, None), (77, 1)], "doc_id long, label int")
    got = quality_classifier.quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(r["score"] is not None and 0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality_classifier.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.quality_scores(no_docs(spark), labels).collect() == []


def test_monotone_is_the_pooled_mean():
    good, count = np.array([0.0, 3, 1, 0, 8]), np.array([4.0, 4, 4, 0, 8])
    curve = quality_classifier.monotone(good, count)
    assert (np.diff(curve) >= 0).all() and curve[0] < 0.1 and curve[4] > 0.9 and (curve[1] + curve[2]) / 2 == pytest.approx(0.5, abs=0.1)
    assert set(quality_classifier.monotone(np.zeros(3), np.zeros(3))) == {0.5}


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


URLS = [
    None, "", "no scheme", "http://a.net/", "http://A.Net", "https://x.example.net/en/1?q#f", "http://example.net/en", "x://y.example.com/de/a/b",
    "http://a.org/fr/1", "http://org/fr/", "http://b.a.org?x=/fr/", "http://notnet/", "http://É.Example.COM/de/\nx", "a://b://c/d", "http://h.co.uk/a", "://",
    "http://sub.example.com", "http://u@h.com:80/p",
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(k, u, "<p>", "h", "p", "b", 1) for k, u in enumerate(URLS)], PAGES)
    none = spark.createDataFrame([], "page_id long, bad boolean")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, none, RULES).collect()}
    assert len(got) == len(URLS)
    for k, url in enumerate(URLS):
        host, path = plain_url(url)
        fits = [(len(r), r, v) for v, r in RULES if host and (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        assert (got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) == (host, path, rule, verdict), url


def test_reputation_blocks_bad_hosts_and_spares_thin_evidence(spark):
    rows = [(k, f"http://bad.farm.com/{k}") for k in range(80)] + [(100 + k, f"http://good{k % 9}.site.com/{k}") for k in range(300)]
    rows += [(900, "http://new.site.com/"), (901, "http://one.site.com/"), (901, "http://one.site.com/")]
    outcomes = [(k, True) for k in range(70)] + [(100 + k, k % 25 == 0) for k in range(250)] + [(901, True), (901, True), (None, True), (5, None)]
    found = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad boolean"), [])
    got = [(r["page_id"], r["verdict"]) for r in found.collect()]
    assert len(got) == len(rows)
    assert {v for p, v in got if p < 80} == {"block"} and {v for p, v in got if p >= 100} == {"allow"}


def test_registered_domains(spark):
    hosts = ["a.b.example.com", "example.com", "x.co.uk", "a.x.co.uk", "com", "", "a.b.co"]
    rows = spark.createDataFrame([(h,) for h in hosts], "h string").select(url_filter.domain_of(F.col("h")).alias("d")).select("d", url_filter.suffix_of(F.col("d")).alias("s")).collect()
    assert [(r["d"], r["s"]) for r in rows] == [("example.com", "com"), ("example.com", "com"), ("x.co.uk", "co.uk"), ("x.co.uk", "co.uk"), ("com", ""), ("", ""), ("b.co", "co")]


def test_forward_sums_and_expected_counts_equal_all_segmentations():
    names = ["\x000", "a", "b", "ab", "▁a", "▁", "▁ab", "ba"]
    pieces = language_id.Pieces(names)
    chance = np.random.default_rng(0).dirichlet(np.ones(len(names)), 2).T.copy()

    def cuts(s):
        if not s:
            yield []
        for k in range(1, len(s) + 1):
            number = names.index(s[:k]) if s[:k] in names else 0 if k == 1 else None
            if number is not None:
                for rest in cuts(s[k:]):
                    yield [number, *rest]

    words = ["abab", "b", "aczb", ""]
    counts = np.array([[1, 2], [3, 0], [1, 1], [2, 2.0]])
    lattice = language_id.Lattice(words, pieces)
    logs = lattice.log_probability(chance)
    expected = np.zeros_like(chance)
    for k, word in enumerate(words):
        every = list(cuts("▁" + word))
        parts = np.array([np.prod(chance[c], axis=0) for c in every])
        assert np.allclose(np.log(parts.sum(axis=0)), logs[k])
        for cut, share in zip(every, parts / parts.sum(axis=0)):
            for number in cut:
                expected[number] += share * counts[k]
    assert np.allclose(expected, lattice.expected(chance, counts))


def test_long_runs_are_scored_whole():
    pieces = language_id.Pieces(["\x000", "a", "▁"])
    chance = np.array([[0.1], [0.6], [0.3]])
    assert language_id.Lattice(["a" * 500], pieces).log_probability(chance)[0, 0] == pytest.approx(math.log(0.3) + 500 * math.log(0.6))


def test_held_out_languages(spark):
    draw = random.Random(4)
    stems = {"en": ["the", "ing", "wh", "ly", "ould"], "de": ["sch", "ung", "ich", "keit", "ß"], "fr": ["eau", "tion", "é", "que", "oi"]}
    rows = []
    for k in range(300):
        lang = draw.choice(list(stems))
        rows.append((k, " ".join("".join(draw.choice(stems[lang]) for _ in range(3)) for _ in range(25)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(docs, MODEL).collect()}
    held = [(got[k], lang) for k, _, lang in rows if got[k]["held_out"]]
    assert len(held) > 30 and all(r["lang_pred"] == lang for r, lang in held)


def test_languages_of_odd_rows(spark):
    docs = odd_docs(spark)
    got = language_id.identify(docs, MODEL).collect()
    assert len(got) == docs.count()
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert {k for k, r in by_id.items() if r["lang_pred"] == "und"} == {4, 5, 6, 12}
    assert all(0 <= r["score"] <= 1 and (r["lang_pred"] in ("en", "fr")) == (r["score"] > 0) for r in got)
    kept = language_id.recognised(docs, MODEL)
    assert kept.columns == docs.columns and not {4, 5, 6, 12} & {r["doc_id"] for r in kept.collect()}
    assert language_id.identify(no_docs(spark), MODEL).collect() == []
    assert {r["lang_pred"] for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")), MODEL).collect()} == {"und"}


def test_statistics_take_slices():
    texts = pa.array(["skip me", "One two!\nOne two!", None, ""])
    assert np.array_equal(quality_classifier.statistics(texts.slice(1)), quality_classifier.statistics(pa.array(["One two!\nOne two!", None, ""])))


def test_labels_are_those_of_the_document_in_the_path(spark):
    urls = {1: "http://a.com/en/3?x=2", 2: "https://b.com/de/1#top", 3: "http://c.com/en/2/more", 4: "http://d.com/1", 5: "http://e.com/en/1x", 6: None, 7: f"http://f.com/en/{10**25}"}
    pages = spark.createDataFrame(list(urls.items()), "page_id long, url string")
    labels = spark.createDataFrame([(1, True), (2, None), (3, False), (None, True)], "doc_id long, bad boolean")
    assert sorted(map(tuple, url_filter.page_outcomes(pages, labels).collect())) == [(1, False), (2, True), (3, None)]


def test_the_query_takes_labels_by_path(spark, tmp_path):
    from tidemark.llm import queries

    # Documents 100 and up are bad and lie on one host; page_id numbers other documents.
    rows = [(k, f"http://{'bad' if k < 50 else 'good'}.com/en/{k + 100 if k < 50 else k - 50}", "") for k in range(100)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(k, int(k < 100), 0) for k in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["page_id"]: r["verdict"] for r in queries.op5_url_filter(spark, str(tmp_path)).collect()}
    assert got == {k: "block" if k < 50 else "allow" for k in range(100)}


def test_a_dozen_labels_of_one_domain_block_nothing(spark):
    # Twelve labelled pages, eight bad, on hosts of one domain: the suffix is uncertain, and no host below it is surer.
    rows = [(k, f"http://h{k % 6}.site.com/en/{k}") for k in range(12)] + [(100, "http://new.site.com/en/1"), (101, "http://other.com/")]
    outcomes = spark.createDataFrame([(k, k not in (0, 4, 7, 11)) for k in range(12)], "page_id long, bad boolean")
    found = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), outcomes, [])
    assert {r["verdict"] for r in found.collect()} == {"allow"}
