"""Numbering, look-back and feeds with one busy job; streams in several batches equal the batch."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators.metrics import exact_quantiles
from tidemark.operators.ordering import RANGE, in_ranges, number_rows, text_parts
from tidemark.operators.progress import TERMINAL, latest_approvals, status_changes, trace_timeline
from tidemark.session import scratch_path
from tidemark.sources import stores
from tidemark.streaming import changes, progress as sp
from tidemark.streaming.metrics import keep_gauges, read_gauges, stream_increase
from tidemark.streaming.sources import parquet_stream, run_batches, run_to_files

START = dt.datetime(2024, 1, 1)
SCHEMA = "job_id string, ts timestamp, seq int, status string, note string"


def snapshots(n=3000, seed=2, terminal=0.0015):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        job = "hot" if rng.random() < 0.4 else f"j{rng.randrange(30)}"
        status = rng.choice(TERMINAL) if rng.random() < terminal else rng.choice(["RUNNING", "PAUSED"])
        rows.append((job, START + dt.timedelta(seconds=rng.randrange(5000)), i, status, rng.choice(["a", None])))
    return rows


def expected(rows):
    last, ended, out = {}, set(), []
    for job, ts, seq, status, note in sorted(rows, key=lambda r: (r[1], r[2])):
        if job in ended:
            continue
        if last.get(job, ()) != (status, note):
            out.append((job, seq))
        last[job] = (status, note)
        if status in TERMINAL:
            ended.add(job)
    return sorted(out)


def test_status_changes_equal_brute_force(spark):
    rows = snapshots()
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    for ranges in (None, 2, 9, 40):
        got = sorted((r["job_id"], r["seq"]) for r in status_changes(df, ["status", "note"], ranges).collect())
        assert got == expected(rows)


def test_feed_over_batches_and_replays(spark):
    rows = sorted(snapshots(1500, 4), key=lambda r: (r[1], r[2]))
    base = scratch_path(spark, "feed")
    handle = sp.feed_changes(f"{base}/out", f"{base}/state", ["status", "note"], buckets=4)
    parts = [rows[:400], rows[400:900], rows[900:]]
    for i, part in enumerate(parts):
        handle(spark.createDataFrame(part, SCHEMA), i)
        if i == 1:
            handle(spark.createDataFrame(part, SCHEMA), i)  # the same batch once more, as after a restart
    got = sorted((r["job_id"], r["seq"]) for r in spark.read.parquet(f"{base}/out").collect())
    assert got == expected(rows)


def test_timeline(spark):
    rows = [("hot" if i % 3 else f"j{i % 7}", random.Random(i).choice(["Plan", "Validate", "Odd"]), START + dt.timedelta(seconds=(i * 37) % 1000), i) for i in range(900)]
    df = spark.createDataFrame(rows, "job_id string, phase string, ts timestamp, step_id int").repartition(5)
    got = {r["step_id"]: (r["step_no"], r["phase_no"], r["display_group"]) for r in trace_timeline(df, 23).collect()}
    assert got == {r["step_id"]: (r["step_no"], r["phase_no"], r["display_group"]) for r in trace_timeline(df).collect()}
    seen, firsts = {}, {}
    for job, phase, ts, i in sorted(rows, key=lambda r: (r[2], r[3])):
        seen[job, phase] = seen.get((job, phase), 0) + 1
        firsts.setdefault(job, {}).setdefault(phase, ts)
        assert got[i][0] == seen[job, phase]
    for job, phase, ts, i in rows:
        order = sorted(firsts[job], key=lambda p: (firsts[job][p], p))
        assert got[i][1] == order.index(phase) + 1
        assert got[i][2] == {"Plan": "plan", "Validate": "validation", "Odd": None}[phase]


def test_rows_without_job_phase_or_time_are_kept(spark):
    rows = [(None if i % 2 else "j", None if i % 3 == 0 else "Plan", None if i % 5 == 0 else START + dt.timedelta(seconds=i), i) for i in range(200)]
    df = spark.createDataFrame(rows, "job_id string, phase string, ts timestamp, step_id int")
    whole, cut = trace_timeline(df).collect(), trace_timeline(df, 10).collect()
    assert len(whole) == 200 and sorted(map(str, whole)) == sorted(map(str, cut))
    snaps = df.selectExpr("job_id", "ts", "step_id as seq", "case when step_id % 2 = 0 then 'RUNNING' else 'PAUSED' end as status")
    snaps = snaps.withColumn("status", F.when(F.col("seq") % 7 == 0, "DRAFT").otherwise(F.col("status")))
    one, many = status_changes(snaps, ["status"]).collect(), status_changes(snaps, ["status"], 10).collect()
    assert one and sorted(map(str, one)) == sorted(map(str, many))


def test_number_rows_with_a_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 9)).alias("k"), F.hash("id").alias("v"))
    rows = number_rows(df.repartition(7), ["k"], ["v"], "n", 9).collect()
    assert sorted(rows) == sorted(number_rows(df, ["k"], ["v"], "n").collect())
    by_key = {}
    for r in rows:
        by_key.setdefault(r["k"], []).append((r["v"], r["n"]))
    assert len(rows) == 5000
    for values in by_key.values():
        assert [n for _, n in sorted(values)] == list(range(1, len(values) + 1))


def test_rows_without_a_key_are_numbered(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, None).when(F.col("id") < 700, 1).otherwise(F.col("id")).alias("k"), "id")
    rows = number_rows(df, ["k"], ["id"], "n", 7).filter("k is null").collect()
    assert [r["n"] for r in sorted(rows, key=lambda r: r["id"])] == list(range(1, 401))
    assert number_rows(df.limit(0), ["k"], ["id"], "n", 7).collect() == []


def test_equal_times_of_one_key_spread_over_all_ranges(spark):
    tied = spark.range(1_000_000).select(F.lit("hot").alias("k"), F.timestamp_seconds(F.lit(5)).alias("ts"), "id")
    sizes = [r["count"] for r in in_ranges(tied, ["k"], ["ts"], 8).groupBy(RANGE).count().collect()]
    assert len(sizes) == 8 and sum(sizes) == 1_000_000 and max(sizes) < 250_000
    numbered = number_rows(tied, ["k"], ["ts", "id"], "n", 8)
    assert numbered.filter(F.col("n") != F.col("id") + 1).isEmpty()


def test_repeated_rows_and_maps_are_numbered(spark):
    df = spark.range(300).select((F.col("id") % 2).alias("k"), F.lit(1).alias("v"), F.create_map(F.lit("a"), F.lit(1)).alias("m"))
    rows = number_rows(df, ["k"], ["v"], "n", 5).collect()
    assert sorted((r["k"], r["n"]) for r in rows) == [(k, n) for k in (0, 1) for n in range(1, 151)]


def test_exact_quantiles_count_equal_values_first(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.choice([7.0, 7.0, 7.0, rng.random() * 10, None])) for _ in range(3000)] + [("one", 2.5), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    qs = (0.0, 0.25, 0.5, 0.99, 1.0)
    for ranges in (None, 5):
        got = {r["k"]: list(r)[1:] for r in exact_quantiles(df, ["k"], qs, "v", ranges).collect()}
        assert set(got) == {"a", "b", None, "one"}
        for k, found in got.items():
            values = sorted(v for key, v in rows if key == k and v is not None)
            for q, x in zip(qs, found):
                at = (len(values) - 1) * q
                low, high = values[int(at)], values[min(int(at) + 1, len(values) - 1)]
                assert abs(x - (low + (high - low) * (at - int(at)))) < 1e-9
    hot = spark.range(100_000, numPartitions=8).select(F.when(F.col("id") % 10 > 0, 1.0).otherwise(F.col("id").cast("double")).alias("v"))
    assert list(exact_quantiles(hot, [], (0.5, 1.0), "v", 4).first()) == [1.0, 99990.0]


def test_text_parts(spark):
    df = spark.range(1, 11).select(F.lit("j").alias("j"), F.col("id").alias("p"), F.col("id").cast("string").alias("t"))
    rows = text_parts(df, ["j"], "p", "t", ",", 4).orderBy("part_no").collect()
    assert [r["text"] for r in rows] == ["1,2,3,4", "5,6,7,8", "9,10"]


def test_approvals(spark):
    rows = [("j", "HumanReviewPlan", 1, 0, "approve", "ann"), ("j", "HumanReviewPlan", 2, 0, None, None), ("j", "HumanReviewCutover", 1, 0, "approve", ""),
            ("k", "HumanReviewValidation", 1, 0, "modify", "bo")]
    df = spark.createDataFrame(rows, "job_id string, gate string, ts int, seq int, decision string, reviewer string")
    got = {(r["job_id"], r["gate"]): (r["decision"], r["reviewer"], r["next_phase"]) for r in latest_approvals(df).collect()}
    assert got == {("j", "HumanReviewPlan"): ("reject", "unknown", "END"), ("j", "HumanReviewCutover"): ("approve", "unknown", "Cutover"),
                   ("k", "HumanReviewValidation"): ("modify", "bo", "DataMigrate")}


def write_parts(spark, rows, schema, base, parts=4):
    for i in range(parts):
        spark.createDataFrame(rows[i::parts], schema).coalesce(1).write.mode("append").parquet(f"{base}/in")


def test_streamed_counter_over_many_files(spark):
    rng = random.Random(9)
    rows = [(START + dt.timedelta(seconds=rng.randrange(7200)), rng.choice("ab")) for _ in range(800)]
    base = scratch_path(spark, "s")
    write_parts(spark, rows, "ts timestamp, tool string", base)
    schema = spark.read.parquet(f"{base}/in").schema
    stream = parquet_stream(spark, f"{base}/in", schema, files_per_batch=1)
    found = run_to_files(stream_increase(stream, "10 minutes", ["tool"], "3 hours"), f"{base}/out", f"{base}/cp")
    # Nothing has closed yet: the watermark lies three hours back. A late marker event closes the rest.
    assert found.count() == 0
    spark.createDataFrame([(START + dt.timedelta(hours=9), "z")], "ts timestamp, tool string").coalesce(1).write.mode("append").parquet(f"{base}/in")
    found = run_to_files(stream_increase(parquet_stream(spark, f"{base}/in", schema), "10 minutes", ["tool"], "3 hours"), f"{base}/out", f"{base}/cp")
    got = {(r["window_start"], r["tool"]): r["increase"] for r in found.collect()}
    want = {}
    for ts, tool in rows:
        key = (ts - dt.timedelta(seconds=(ts - START).seconds % 600), tool)
        want[key] = want.get(key, 0) + 1
    assert got == want


def test_gauges_over_batches(spark):
    base = scratch_path(spark, "g")
    handle = keep_gauges(f"{base}/store", ["pod"], order=("ts",), buckets=3)
    batch = lambda rows: spark.createDataFrame(rows, "pod string, value int, ts int")
    handle(batch([("a", 1, 1), ("a", 2, 5), ("b", 7, 2)]), 0)
    handle(batch([("a", 9, 3), ("c", 4, 1)]), 1)
    handle(batch([("a", 9, 3), ("c", 4, 1)]), 1)
    assert sorted((r["pod"], r["value"]) for r in read_gauges(spark, f"{base}/store", ["pod"]).collect()) == [("a", 2), ("b", 7), ("c", 4)]


def test_change_stream_equals_batch(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(40), rng.choice("UUUID"), START + dt.timedelta(seconds=rng.randrange(500)), i, rng.randrange(99)) for i in range(600)]
    schema = "k int, op string, ts timestamp, seq int, v int"
    base = scratch_path(spark, "c")
    write_parts(spark, rows, schema, base)
    stream = parquet_stream(spark, f"{base}/in", spark.read.parquet(f"{base}/in").schema, files_per_batch=1)
    got = changes.apply_change_stream(stream, f"{base}/store", ["k"], f"{base}/cp", buckets=5)
    last = {}
    for k, op, ts, seq, v in sorted(rows, key=lambda r: (r[2], r[3])):
        last[k] = (op, v)
    assert sorted((r["k"], r["v"]) for r in got.collect()) == sorted((k, v) for k, (op, v) in last.items() if op != "D")
    empty = spark.createDataFrame([], "k int, v int")
    batch = changes.apply_changes(empty, spark.createDataFrame(rows, schema), ["k"])
    assert sorted((r["k"], r["v"]) for r in batch.collect()) == sorted((r["k"], r["v"]) for r in got.collect())


def test_jobs_over_batches(spark):
    base = scratch_path(spark, "j")
    handle = sp.keep_jobs(f"{base}/store", buckets=2)
    batch = lambda rows: spark.createDataFrame(rows, "job_id string, name string, source_dialect string, target_dialect string, status string, ts int, seq int")
    handle(batch([("j", "one", "a", "b", "RUNNING", 1, 0), ("k", "x", "a", "b", "RUNNING", 1, 0)]), 0)
    handle(batch([("j", "two", "c", "d", "DONE", 2, 0)]), 1)
    # Events that arrive late count by their time.
    handle(batch([("j", "three", "c", "d", "PAUSED", 1, 5), ("k", "zero", "a", "b", "INIT", 0, 0)]), 2)
    rows = {r["job_id"]: (r["name"], r["status"]) for r in stores.read_jobs(spark, f"{base}/store").collect()}
    assert rows == {"j": ("one", "DONE"), "k": ("zero", "RUNNING")}


def test_incremental_load_reads_each_file_once(spark):
    base = scratch_path(spark, "i")
    schema = "ts timestamp, v int"
    write_parts(spark, [(START, i) for i in range(20)], schema, base, 2)
    struct = spark.read.parquet(f"{base}/in").schema
    for _ in range(2):
        changes.incremental_load(parquet_stream(spark, f"{base}/in", struct), f"{base}/out", f"{base}/cp")
    write_parts(spark, [(START, 100)], schema, base, 1)
    found = changes.incremental_load(parquet_stream(spark, f"{base}/in", struct), f"{base}/out", f"{base}/cp")
    assert (found.count(), found.agg(F.max("v")).first()[0]) == (21, 100)


def test_run_batches_sees_every_file(spark):
    base = scratch_path(spark, "r")
    write_parts(spark, [(START, i) for i in range(9)], "ts timestamp, v int", base, 3)
    seen = []
    stream = parquet_stream(spark, f"{base}/in", spark.read.parquet(f"{base}/in").schema, files_per_batch=1)
    run_batches(stream, lambda df, i: seen.append((i, df.count())), f"{base}/cp")
    assert sum(n for _, n in seen) == 9 and len(seen) >= 2
