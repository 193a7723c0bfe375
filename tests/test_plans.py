"""Physical plans: what is read, what is shuffled, and what must never appear."""

import re
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import queries  # noqa: E402
from queries.base import Tables  # noqa: E402
from tidemark.operators import fingerprint, integrity, metrics, reconcile, retrieval  # noqa: E402
from tidemark.operators.integrity import ForeignKey  # noqa: E402
from tidemark.streaming import changes  # noqa: E402

queries.load_all()
SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text: str) -> int:
    return len(re.findall(r"Exchange (hash|range|Single|RoundRobin)", text))


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF)


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if not n.startswith(("stream_", "bulk_"))))
def test_no_query_multiplies_rows(spark, name):
    text = plan(queries.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


def test_fingerprint_reads_only_its_columns_and_shuffles_one_row(t):
    text = plan(fingerprint.table_fingerprint(t.lineitem, ["l_orderkey", "l_tax"]))
    assert "ReadSchema: struct<l_orderkey:bigint,l_tax:double>" in text
    assert exchanges(text) == 1 and "partial_sum" in text


def test_counts_need_no_columns(t):
    assert "ReadSchema: struct<>" in plan(reconcile.row_counts({"orders": (t.orders, t.orders)}))


def test_incremental_filter_reaches_the_scan(t):
    assert "GreaterThanOrEqual(o_orderkey,100)" in plan(changes.newer_rows(t.orders, "o_orderkey", 100))


def test_orphans_are_counted_per_key_before_the_join(spark, t):
    fk = ForeignKey("f", "lineitem", ("l_orderkey",), "orders", ("o_orderkey",))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # parents too large to broadcast
    try:
        text = plan(integrity.orphan_count(t.lineitem, t.orders, fk))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "ReadSchema: struct<l_orderkey:bigint>" in text and "ReadSchema: struct<o_orderkey:bigint>" in text
    assert text.index("LeftAnti") < text.index("partial_count")


def test_sliding_windows_shuffle_sums_not_events(t):
    text = plan(metrics.counter_rate(t.calls, "1 hour", ["tool_name"], "5 minutes"))
    below_expand = text[text.index("Expand") :] if "Expand" in text else text
    assert "partial_count" in below_expand


def test_top_k_is_cut_in_each_task(t):
    vectors = t.kb.select("id", "embedding")
    text = plan(retrieval.retrieve_batch(vectors, vectors, 3))
    assert re.search(r"WindowGroupLimit .* Partial", text) and "MapInArrow" in text
    assert exchanges(text) == 1


def test_one_shuffle_for_keyed_differences(t):
    assert exchanges(plan(reconcile.row_diff(t.orders, t.tgt_orders, ["o_orderkey"]))) == 1


def test_last_value_needs_no_window(t):
    text = plan(metrics.gauge_last(t.gauges, ["deployment_name"], order=["ts", "event_id"]))
    assert "Window" not in text and "partial_max_by" in text


def test_histogram_is_one_pass(t):
    text = plan(metrics.histogram(t.calls.withColumn("v", F.col("seconds")), metrics.BUCKETS["tool"], ["tool_name"], "v"))
    assert text.count("FileScan") == 1 and exchanges(text) == 1
