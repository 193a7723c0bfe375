"""Risk, counts, review lists and load waves over the estate."""

from pyspark.sql import functions as F

from queries import estate  # noqa: F401  (fixtures)
from queries.base import FIXTURES, query
from queries.catalog import fks_of
from tidemark.functions.native_types import RISKY_TYPES
from tidemark.operators.catalog import dependency_edges
from tidemark.plans import risk, waves

FIXTURES["overrides"] = """
SELECT job_id, object_name, CASE WHEN object_type = 'view' THEN 'high' WHEN object_type = 'function' THEN 'critical' ELSE 'low' END AS risk_level,
       CASE WHEN object_type = 'view' THEN 'reviewed: outer join syntax' END AS reason, ord AS seq
FROM {estate_objects} o WHERE object_type IN ('view', 'function', 'trigger') AND segment <> 'MACHINERY'"""
FIXTURES["low_confidence"] = """
SELECT job_id, object_name, ord FROM {estate_objects} o WHERE object_type IN ('view', 'procedure') AND acctbal < 1000"""

_RISKY = " OR ".join(f"(dialect = '{d}' AND ty IN ({', '.join(repr(x) for x in v)}))" for d, v in RISKY_TYPES.items())
SQL_RISK = f"""
WITH h AS (SELECT job_id, table_name, string_agg(DISTINCT ty, ', ' ORDER BY ty) AS hits
           FROM (SELECT *, upper(trim(split_part(native_type, '(', 1))) AS ty FROM {{sv_columns}} c) x WHERE {_RISKY} GROUP BY ALL)
SELECT o.job_id, o.ord, o.object_name, o.object_type,
       CASE WHEN o.object_type = 'table' THEN CASE WHEN h.hits IS NULL THEN 'low' ELSE 'high' END
            WHEN o.object_type IN ('procedure', 'function', 'trigger') THEN 'high' ELSE 'medium' END AS risk_level,
       CASE WHEN o.object_type = 'table' THEN '{risk.TYPE_REASON}' || h.hits ELSE o.object_type || '{risk.KIND_REASON}' END AS reason
FROM {{estate_objects}} o LEFT JOIN h ON o.object_type = 'table' AND h.job_id = o.job_id AND h.table_name = o.object_name"""


def register_of(t):
    return risk.score_risk(t.estate_objects, t.sv_columns)


@query("object_counts", """
SELECT job_id, """ + ", ".join(f"count(*) FILTER (object_type = '{k}') AS {k}s" for k in risk.PLAN_TYPES) + """
FROM {estate_objects} o GROUP BY job_id""")
def object_counts(t):
    return risk.object_counts(t.estate_objects)


@query("score_risk", SQL_RISK)
def score_risk(t):
    return register_of(t)


@query("refinement_candidates", f"""
SELECT job_id, ord, object_name, object_type, risk_level, reason, ((row_number() OVER (PARTITION BY job_id ORDER BY ord) - 1) // 5)::INT AS batch_no
FROM ({SQL_RISK}) r WHERE risk_level <> 'low'""")
def refinement_candidates(t):
    return risk.refinement_candidates(register_of(t), 5)


@query("refine_risk", f"""
SELECT r.job_id, r.ord, r.object_name, r.object_type, coalesce(v.risk_level, r.risk_level) AS risk_level,
       coalesce(v.reason, r.reason) AS reason
FROM ({SQL_RISK}) r LEFT JOIN (SELECT * FROM {{overrides}} o WHERE risk_level IN ('low', 'medium', 'high')) v
ON v.job_id = r.job_id AND v.object_name = r.object_name""")
def refine_risk(t):
    return risk.refine_risk(register_of(t), t.overrides)


@query("manual_review", f"""
SELECT job_id, object_name, min((list_no, ord)).list_no AS list_no, min((list_no, ord)).ord AS ord
FROM (SELECT job_id, object_name, struct_pack(list_no := 0, ord := ord) AS p FROM ({SQL_RISK}) r WHERE risk_level = 'high'
      UNION ALL SELECT job_id, object_name, struct_pack(list_no := 1, ord := ord) FROM {{low_confidence}} l) u
GROUP BY job_id, object_name""".replace("min((list_no, ord)).list_no", "min(p).list_no").replace("min((list_no, ord)).ord", "min(p).ord"))
def manual_review(t):
    return risk.manual_review(register_of(t), t.low_confidence)


@query("risk_breakdown", f"""
SELECT job_id, count(*) FILTER (risk_level = 'low') AS low, count(*) FILTER (risk_level = 'medium') AS medium,
       count(*) FILTER (risk_level = 'high') AS high FROM ({SQL_RISK}) r GROUP BY job_id""")
def risk_breakdown(t):
    return risk.risk_breakdown(register_of(t))


# All paths are followed; a node on or below a cycle is found by reaching itself.
SQL_WAVES = """
WITH RECURSIVE nodes AS (SELECT {scope}, name, ord FROM {nodes}),
links AS (SELECT DISTINCT {e_scope}, e.child, e.parent FROM {edges} JOIN nodes a ON {a_on} AND a.name = e.child
          JOIN nodes b ON {b_on} AND b.name = e.parent WHERE e.child <> e.parent),
reach AS (SELECT {scope}, child, parent FROM links UNION
          SELECT {r_scope}, r.child, l.parent FROM reach r JOIN links l ON {rl_on} AND l.child = r.parent),
loops AS (SELECT DISTINCT {scope}, child AS name FROM reach WHERE child = parent),
below AS (SELECT {scope}, name FROM loops UNION SELECT DISTINCT {r_scope}, r.child FROM reach r JOIN loops l ON {rl_on} AND l.name = r.parent),
depth AS (SELECT {scope}, name, 0 AS d FROM nodes UNION ALL
          SELECT {l_scope}, l.child, p.d + 1 FROM depth p JOIN links l ON {pl_on} AND l.parent = p.name
          WHERE NOT EXISTS (SELECT 1 FROM below z WHERE {zl_on} AND z.name = l.child))
"""


def sql_waves(scope: list[str], nodes: str, edges: str) -> str:
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in scope)
    cols = lambda a: ", ".join(f"{a}.{c}" for c in scope)
    return SQL_WAVES.format(
        scope=", ".join(scope), e_scope=cols("e"), r_scope=cols("r"), l_scope=cols("l"), a_on=on("a", "e"), b_on=on("b", "e"),
        rl_on=on("r", "l"), pl_on=on("p", "l"), zl_on=on("z", "l"), nodes=nodes, edges=edges,
    )


@query("load_waves", sql_waves(
    ["job_id"],
    "(SELECT job_id, object_name AS name, ord FROM {estate_objects} o WHERE object_type = 'table') q",
    "(SELECT job_id, table_name AS child, ref_table_name AS parent FROM {estate_foreign_keys} f) e",
) + """
SELECT n.job_id, n.name AS table_name, n.ord, CASE WHEN b.name IS NULL THEN max(d.d) END AS wave
FROM nodes n JOIN depth d ON d.job_id = n.job_id AND d.name = n.name LEFT JOIN below b ON b.job_id = n.job_id AND b.name = n.name
GROUP BY n.job_id, n.name, n.ord, b.name""")
def load_waves(t):
    tables = t.estate_objects.filter(F.col("object_type") == "table").select("job_id", F.col("object_name").alias("table_name"), "ord")
    return waves.load_waves(tables, dependency_edges(fks_of(t)))


FIXTURES["object_links"] = """
SELECT job_id, CASE WHEN dialect = 'oracle' THEN 'RICH_ACCOUNTS' ELSE 'rich_accounts' END AS parent,
       CASE WHEN dialect = 'oracle' THEN 'OPEN_ACCOUNTS' ELSE 'open_accounts' END AS child
FROM {estate_objects} o WHERE object_type = 'procedure' AND segment <> 'BUILDING'"""


@query("apply_order", sql_waves(
    ["job_id", "object_type"],
    "(SELECT job_id, object_type, object_name AS name, ord FROM {estate_objects} o WHERE object_type <> 'table') q",
    "(SELECT k.job_id, o.object_type, k.child, k.parent FROM {object_links} k JOIN {estate_objects} o ON o.job_id = k.job_id "
    "AND o.object_name = k.child) e",
) + """
SELECT n.job_id, n.ord, n.object_type, n.name AS object_name, CASE n.object_type WHEN 'procedure' THEN 0 WHEN 'function' THEN 0
       WHEN 'view' THEN 1 WHEN 'trigger' THEN 2 WHEN 'foreign_key' THEN 3 ELSE 99 END AS priority, max(d.d) AS depth
FROM nodes n JOIN depth d ON d.job_id = n.job_id AND d.object_type = n.object_type AND d.name = n.name
GROUP BY n.job_id, n.ord, n.object_type, n.name""")
def apply_order(t):
    objects = t.estate_objects.filter(F.col("object_type") != "table")
    return waves.apply_order(objects, t.object_links)
