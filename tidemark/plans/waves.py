"""Load waves and apply order from dependencies."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from tidemark.operators.joins import shuffled
from tidemark.plans.risk import with_type_priority
from tidemark.session import cut_lineage

# Kinds of objects in the order their statements are applied.
APPLY_ORDER = (("procedure", "function"), ("view",), ("trigger",), ("foreign_key",))


def waves(nodes: DataFrame, edges: DataFrame, scope: Sequence[str], name: str) -> DataFrame:
    """Wave of each node: 0 without parents, else one more than the latest parent; NULL in or below a cycle.

    Self references and edges to unknown nodes do not count. Each round settles one wave in all jobs together, so
    there are as many rounds as the longest chain in any job. An edge carries how many parents its child has; a
    round follows the edges out of the wave settled last and keeps only the children met so far, with the number of
    their settled parents. It is one action, which also counts what was settled. Edges leave when half of them
    are settled, so all rewriting together costs no more than twice the edges.
    """
    scope = list(scope)
    node = [*scope, name]
    known = nodes.select(*node)
    links = (
        edges.filter(F.col("child") != F.col("parent"))
        .select(*scope, "child", "parent")
        .distinct()
        .join(shuffled(known.withColumnRenamed(name, "child")), [*scope, "child"], "left_semi")
        .join(shuffled(known.withColumnRenamed(name, "parent")), [*scope, "parent"], "left_semi")
    )
    links = cut_lineage(links)
    parents = links.groupBy(*scope, "child").agg(F.count(F.lit(1)).alias("_open"))
    live, facts = _counted(links.join(shuffled(parents), [*scope, "child"]), F.count(F.lit(1)).alias("edges"))
    children = live.select(*scope, F.col("child").alias(name)).distinct()
    roots, _ = _counted(known.join(shuffled(children), node, "left_anti").withColumn("wave", F.lit(0)), F.count(F.lit(1)).alias("n"))
    settled, frontier, touched = [roots], roots, None
    left, gone, leaving, wave = facts["edges"], 0, [roots.select(*node)], 0
    while left > 0:
        wave += 1
        met = (
            live.join(shuffled(frontier.select(*scope, F.col(name).alias("parent"))), [*scope, "parent"])
            .groupBy(*scope, F.col("child").alias(name))
            .agg(F.count(F.lit(1)).alias("_done"), F.max("_open").alias("_open"), F.count(F.lit(1)).alias("_new"))
        )
        if touched is not None:
            met = met.unionByName(touched.withColumn("_new", F.lit(0).cast("bigint"))).groupBy(*node).agg(
                F.sum("_done").alias("_done"), F.max("_open").alias("_open"), F.sum("_new").alias("_new")
            )
        whole = F.col("_done") == F.col("_open")
        state, facts = _counted(met, F.count_if(whole).alias("settled"), F.sum("_new").alias("edges"))
        if not facts["settled"]:
            break
        frontier = state.filter(whole).select(*node, F.lit(wave).alias("wave"))
        touched = state.filter(~whole).select(*node, "_done", "_open")
        settled.append(frontier)
        leaving.append(frontier.select(*node))
        left, gone = left - facts["edges"], gone + facts["edges"]
        if 0 < left <= gone:
            # The parents of the wave settled last still have their edges to give out.
            past = reduce(DataFrame.unionByName, leaving[:-1]).withColumnRenamed(name, "parent")
            live = cut_lineage(live.join(shuffled(past), [*scope, "parent"], "left_anti"))
            leaving, gone = leaving[-1:], 0
    found = reduce(DataFrame.unionByName, settled)
    rest = children.join(shuffled(found), node, "left_anti").withColumn("wave", F.lit(None).cast("int"))
    return found.unionByName(rest)


def _counted(df: DataFrame, *facts: Column) -> tuple[DataFrame, dict[str, int]]:
    """The rows, checkpointed, and facts about them that the same action counts."""
    seen = Observation()
    return cut_lineage(df.observe(seen, *facts)), seen.get


def load_waves(tables: DataFrame, edges: DataFrame) -> DataFrame:
    """Waves of the tables of each job: parents load before children, one wave loads in parallel.

    Tables in or downstream of a cycle have no wave and go last, in catalogue order.
    """
    return tables.join(shuffled(waves(tables, edges, ["job_id"], "table_name")), ["job_id", "table_name"])


def apply_order(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """Priority by kind, and depth among objects of the same kind; apply by (priority, depth, ord)."""
    ranked = with_type_priority(objects, APPLY_ORDER)
    kinds = objects.select("job_id", "object_type", "object_name")
    same_kind = edges.join(
        shuffled(kinds.withColumnRenamed("object_name", "child")), ["job_id", "child"]
    ).select("job_id", "object_type", "child", "parent")
    depth = waves(kinds, same_kind, ["job_id", "object_type"], "object_name").withColumnRenamed("wave", "depth")
    return ranked.join(shuffled(depth), ["job_id", "object_type", "object_name"]).select(
        "job_id", "ord", "object_type", "object_name", "priority", "depth"
    )
