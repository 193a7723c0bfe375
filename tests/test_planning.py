"""Load order, risk and review lists on small schemas."""

import random

import pytest

from tidemark.plans import risk, waves as wave_module
from tidemark.plans.waves import apply_order, load_waves, waves

OBJECTS = "job_id string, ord int, dialect string, object_type string, object_name string, schema_name string"
COLS = "job_id string, dialect string, table_name string, native_type string, schema_name string"


def plan(spark, names, edges):
    tables = spark.createDataFrame([("j", n, i) for i, n in enumerate(names)], "job_id string, table_name string, ord int")
    links = spark.createDataFrame([("j", c, p) for c, p in edges] or [("x", "y", "z")], "job_id string, child string, parent string")
    return {r["table_name"]: r["wave"] for r in load_waves(tables, links).collect()}


def test_parents_before_children(spark):
    got = plan(spark, ["ASSIGN", "PROJ", "EMP", "DEPT"], [("ASSIGN", "EMP"), ("ASSIGN", "PROJ"), ("PROJ", "DEPT"), ("EMP", "DEPT")])
    assert got == {"DEPT": 0, "EMP": 1, "PROJ": 1, "ASSIGN": 2}


def test_cycle_and_all_below_it_have_no_wave(spark):
    got = plan(spark, ["DEPT", "EMP", "PROJ", "FREE"], [("DEPT", "EMP"), ("EMP", "DEPT"), ("PROJ", "DEPT")])
    assert got == {"DEPT": None, "EMP": None, "PROJ": None, "FREE": 0}


def test_self_reference_and_unknown_parent_are_ignored(spark):
    assert plan(spark, ["EMP"], [("EMP", "EMP"), ("EMP", "NOT_LISTED"), ("EMP", "EMP")]) == {"EMP": 0}


def test_no_edges(spark):
    assert plan(spark, ["A", "B"], []) == {"A": 0, "B": 0}


def test_random_graphs_keep_every_edge(spark):
    rng = random.Random(5)
    nodes, edges = [], []
    for job in range(12):
        names = [f"t{i}" for i in range(15)]
        nodes += [(job, n, i) for i, n in enumerate(names)]
        edges += [(job, names[a], names[b]) for a, b in (rng.sample(range(15), 2) for _ in range(18)) if a > b]
    df = spark.createDataFrame(nodes, "job_id int, table_name string, ord int")
    links = spark.createDataFrame(edges, "job_id int, child string, parent string")
    got = {(r["job_id"], r["table_name"]): r["wave"] for r in load_waves(df, links).collect()}
    assert len(got) == len(nodes)
    depth = {}

    def expect(job, name):
        if (job, name) not in depth:
            parents = [p for j, c, p in edges if j == job and c == name]
            depth[job, name] = 1 + max(expect(job, p) for p in parents) if parents else 0
        return depth[job, name]

    assert all(got[j, n] == expect(j, n) for j, n, _ in nodes)


def test_apply_order(spark):
    objects = spark.createDataFrame(
        [("j", 0, "foreign_key", "fk"), ("j", 1, "trigger", "trg"), ("j", 2, "view", "outer_v"), ("j", 3, "view", "inner_v"),
         ("j", 4, "function", "f"), ("j", 5, "procedure", "p"), ("j", 6, "synonym", "s")],
        "job_id string, ord int, object_type string, object_name string",
    )
    links = spark.createDataFrame([("j", "outer_v", "inner_v"), ("j", "outer_v", "f")], "job_id string, child string, parent string")
    rows = apply_order(objects, links).orderBy("priority", "depth", "ord").collect()
    assert [r["object_name"] for r in rows] == ["f", "p", "inner_v", "outer_v", "trg", "fk", "s"]


def test_waves_without_parents_in_scope(spark):
    nodes = spark.createDataFrame([("a", "n1"), ("b", "n2")], "s string, name string")
    links = spark.createDataFrame([("a", "n1", "n2")], "s string, child string, parent string")
    assert {r["wave"] for r in waves(nodes, links, ["s"], "name").collect()} == {0}


def _plain_waves(names, links):
    parents = {n: {p for c, p in links if c == n and p != n and p in names} for n in names}
    wave, settled = {}, set()
    for depth in range(len(names) + 1):
        fresh = {n for n in names if n not in settled and parents[n] <= settled}
        wave.update(dict.fromkeys(fresh, depth))
        settled |= fresh
    return {n: wave.get(n) for n in names}


@pytest.mark.parametrize("seed", range(3))
def test_waves_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    names = [f"t{i}" for i in range(40)]
    jobs = {j: [(rng.choice(names), rng.choice([*names, "gone"])) for _ in range(25 + 10 * j)] for j in range(3)}
    # Links mostly from later to earlier names, so that chains grow; a few go back and close cycles.
    jobs = {j: [(max(c, p, key=len), min(c, p, key=len)) if rng.random() < 0.2 else (c, p) for c, p in e] for j, e in jobs.items()}
    jobs[3] = [(f"t{i}", f"t{i - k}") for i in range(1, 40) for k in (1, 2, 7) if k <= i and rng.random() < 0.5]
    nodes = spark.createDataFrame([(j, n) for j in jobs for n in names], "j int, name string")
    links = spark.createDataFrame([(j, *e) for j, es in jobs.items() for e in [*es, *es[:3]]], "j int, child string, parent string")
    got = {(r["j"], r["name"]): r["wave"] for r in waves(nodes, links, ["j"], "name").collect()}
    assert got == {(j, n): w for j, es in jobs.items() for n, w in _plain_waves(names, es).items()}


def test_a_chain_and_a_hub(spark, monkeypatch):
    """A chain of 50 tables whose last one has 20,000 children: rounds before the last two write only what they met."""
    written = []
    keep = wave_module.cut_lineage
    monkeypatch.setattr(wave_module, "cut_lineage", lambda df: written.append(keep(df)) or written[-1])
    chain = spark.range(50).selectExpr("'j' as j", "concat('c', id) as name")
    leaves = spark.range(20_000).selectExpr("'j' as j", "concat('l', id) as name")
    links = chain.filter("name <> 'c0'").selectExpr("j", "name as child", "concat('c', cast(substr(name, 2) as int) - 1) as parent")
    found = waves(chain.union(leaves), links.union(leaves.selectExpr("j", "name as child", "'c49' as parent")), ["j"], "name")
    sizes = [df.count() for df in written]
    assert sizes[:2] == [20_049, 20_049] and sizes[-1] == 20_000 and max(sizes[2:-1]) == 1 and len(sizes) == 53
    assert {r["wave"]: r["count"] for r in found.groupBy("wave").count().collect()} == {**dict.fromkeys(range(50), 1), 50: 20_000}


def test_risk(spark):
    objects = spark.createDataFrame(
        [("j", k, "oracle", kind, name, "s") for k, (kind, name) in enumerate(
            [("table", "PLAIN"), ("table", "RICH"), ("procedure", "P"), ("view", "V"), ("synonym", "S"), ("foreign_key", "FK")])], OBJECTS)
    cols = spark.createDataFrame(
        [("j", *c, "s") for c in [("oracle", "PLAIN", "VARCHAR2(10)"), ("oracle", "RICH", "CLOB"), ("oracle", "RICH", "NUMBER(10,2)"),
         ("oracle", "RICH", " blob (7)"), ("oracle", "RICH", "clob"), ("mysql", "PLAIN", "CLOB")]], COLS)
    got = {r["object_name"]: (r["risk_level"], r["reason"]) for r in risk.score_risk(objects, cols).collect()}
    assert got["PLAIN"] == ("low", None)
    assert got["RICH"][0] == "high" and got["RICH"][1].endswith(": BLOB, CLOB")
    assert [got[n][0] for n in ("P", "V", "S", "FK")] == ["high", "medium", "medium", "medium"]


def test_overrides(spark):
    register = spark.createDataFrame(
        [("j", 0, "v", "view", "medium", "old"), ("j", 1, "p", "procedure", "high", "old"), ("j", 2, "v", "table", "low", None)],
        "job_id string, ord int, object_name string, object_type string, risk_level string, reason string")
    overrides = spark.createDataFrame(
        [("j", "v", "high", "uses ROWNUM", 0), ("j", "p", "critical", "no", 1), ("j", "p", "low", None, 0)],
        "job_id string, object_name string, risk_level string, reason string, seq int")
    got = {(r["object_name"], r["object_type"]): (r["risk_level"], r["reason"]) for r in risk.refine_risk(register, overrides).collect()}
    assert got[("v", "view")] == ("high", "uses ROWNUM") and got[("v", "table")] == ("high", "uses ROWNUM")
    assert got[("p", "procedure")] == ("low", "old")


def test_overrides_of_one_kind(spark):
    register = spark.createDataFrame(
        [("j", 0, "v", "view", "medium", "old"), ("j", 1, "v", "table", "low", None)],
        "job_id string, ord int, object_name string, object_type string, risk_level string, reason string")
    overrides = spark.createDataFrame(
        [("j", "v", "view", "high", "uses ROWNUM", 0)], "job_id string, object_name string, object_type string, risk_level string, reason string, seq int")
    got = {r["object_type"]: (r["risk_level"], r["reason"]) for r in risk.refine_risk(register, overrides).collect()}
    assert got == {"view": ("high", "uses ROWNUM"), "table": ("low", None)}


def test_all_candidates_stay_and_come_in_batches(spark):
    register = spark.range(5000).selectExpr(
        "case when id < 4000 then 'hot' else cast(id % 10 as string) end as job_id", "id as ord", "cast(id as string) as object_name",
        "'view' as object_type", "case when id % 2 = 0 then 'medium' else 'low' end as risk_level", "'' as reason")
    rows = risk.refinement_candidates(register).filter("job_id = 'hot'").collect()
    assert sorted((r["batch_no"], r["ord"]) for r in rows) == [(k // 30, 2 * k) for k in range(2000)]


def test_risk_keeps_schemas_apart(spark):
    objects = spark.createDataFrame([("j", 0, "oracle", "table", "T", "a"), ("j", 1, "oracle", "table", "T", "b")], OBJECTS)
    cols = spark.createDataFrame([("j", "oracle", "T", "CLOB", "a"), ("j", "oracle", "T", "NUMBER", "b")], COLS)
    assert {r["ord"]: r["risk_level"] for r in risk.score_risk(objects, cols).collect()} == {0: "high", 1: "low"}


def test_manual_review_keeps_first_place(spark):
    register = spark.createDataFrame(
        [("j", 5, "a", "high"), ("j", 1, "b", "high"), ("j", 2, "c", "low")], "job_id string, ord int, object_name string, risk_level string")
    low = spark.createDataFrame([("j", "b", 0), ("j", "c", 2), ("j", "c", 7)], "job_id string, object_name string, ord int")
    rows = risk.manual_review(register, low).orderBy("list_no", "ord").collect()
    assert [r["object_name"] for r in rows] == ["b", "a", "c"]
