"""One query for each operator: the operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tidemark.llm import class_lm, decontamination, language_id, main_text, near_dedup, packing, prefix_trie, quality_classifier, quality_rules, repeated_spans, token_files, url_filter, vector_codes
from tidemark.llm.registry import query

PIECES = "piece_bpe_32k.model"
TOKENIZER = "byte_bpe_50k.json"
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op4_token_files")
def op4_token_files(spark, sf_dir):
    folder = token_files.token_folder(spark)
    manifest = token_files.write_token_files(
        table(spark, sf_dir, "documents"), folder, public_tokenizers.path(TOKENIZER), end_id=0
    )
    return token_files.token_digests(manifest, folder)


@query("op9_packing")
def op9_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=1)


@query("op1_near_dedup")
def op1_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicate_classes(table(spark, sf_dir, "documents"))


@query("op2_decontamination")
def op2_decontamination(spark, sf_dir):
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_quality_rules", quality_rules.oracle_sql())
def op6_quality_rules(spark, sf_dir):
    return quality_rules.judged(table(spark, sf_dir, "documents"))


@query("op5_url_filter", url_filter.oracle_sql(URL_RULES))
def op5_url_filter(spark, sf_dir):
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    bad = F.when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False)))
    return url_filter.judge_urls(pages, url_filter.page_outcomes(pages, labels.select("doc_id", bad.alias("bad"))), URL_RULES)


@query("op7_language_id")
def op7_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


@query("op3_quality_classifier")
def op3_quality_classifier(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality_classifier.quality_scores(table(spark, sf_dir, "documents"), labels)


@query("op10_class_lm")
def op10_class_lm(spark, sf_dir):
    return class_lm.score_texts(table(spark, sf_dir, "documents"))


@query("op8_main_text")
def op8_main_text(spark, sf_dir):
    return main_text.main_texts(table(spark, sf_dir, "pages"))


@query("op11_repeated_spans")
def op11_repeated_spans(spark, sf_dir):
    return repeated_spans.without_repeats(table(spark, sf_dir, "documents"))


@query("op12_prefix_trie", prefix_trie.oracle_sql())
def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query("op13_vector_codes", vector_codes.oracle_sql())
def op13_vector_codes(spark, sf_dir):
    return vector_codes.digests(table(spark, sf_dir, "embeddings"))
