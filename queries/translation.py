"""Cleaning and scoring of translated DDL over whole document texts and the estate."""

from pyspark.sql import functions as F

from queries import catalog as cat  # noqa: F401  (fixtures)
from queries import estate  # noqa: F401  (fixtures)
from queries.base import FIXTURES, query
from tidemark.functions import ddl_text
from tidemark.operators import catalog, translation

# Every document becomes the comment of a view's DDL; the whole text is cleaned.
FIXTURES["doc_ddl"] = """
SELECT doc_id, source, CASE WHEN lang = 'en' THEN 'mysql' WHEN lang = 'de' THEN 'oracle' ELSE 'postgresql' END AS target_dialect,
       concat('CREATE OR REPLACE Force  EDITIONABLE VIEW "', upper(source), '"."DOC" AS /* ', text, ' */ SELECT * FROM ',
              source, '.customer, `', source, '`.x') AS ddl
FROM {documents}"""
# As a model returns it: line ends, quotes and backslashes escaped.
FIXTURES["doc_escaped"] = """
SELECT doc_id, replace(replace(replace(concat(source, chr(92), chr(9), text, '"n'), chr(92), concat(chr(92), chr(92))), chr(10), concat(chr(92), 'n')),
       '"', concat(chr(92), '"')) AS ddl FROM {documents}"""

_STRIPPED = r"regexp_replace(regexp_replace(ddl, '(?i)\b(EDITIONABLE|NONEDITIONABLE|FORCE)\b\s*', '', 'g'), '[ \t]+', ' ', 'g')"


@query("strip_oracle_noise", f"SELECT doc_id, {_STRIPPED} AS ddl FROM {{doc_ddl}} d")
def strip_oracle_noise(t):
    return t.doc_ddl.select("doc_id", ddl_text.strip_oracle_noise(F.col("ddl")).alias("ddl"))


@query("remap_schema", r"""
SELECT doc_id, target_dialect, CASE target_dialect
  WHEN 'postgresql' THEN regexp_replace(ddl, '"' || source || '"([^\w])', '"app$1"\1', 'gi')
  WHEN 'mysql' THEN regexp_replace(regexp_replace(ddl, '`' || source || '`\.', '', 'gi'), '\b' || source || '\.', '', 'gi')
  ELSE ddl END AS ddl FROM {doc_ddl} d""")
def remap_schema(t):
    ddl = ddl_text.remap_schema(F.col("ddl"), F.col("source"), F.lit("App$1"), F.col("target_dialect"))
    return t.doc_ddl.select("doc_id", "target_dialect", ddl.alias("ddl"))


@query("unescape_ddl", r"""SELECT doc_id, source || chr(92) || chr(9) || text || '"n' AS ddl FROM documents""")
def unescape_ddl(t):
    return t.doc_escaped.select("doc_id", ddl_text.unescape_ddl(F.col("ddl")).alias("ddl"))


# View texts with bare, quoted and foreign names in mixed case.
FIXTURES["view_texts"] = """
SELECT job_id, object_id, target_dialect, schema_name AS source_schema, 'Trade' AS target_schema,
       concat('CREATE VIEW "', object_name, '" AS SELECT C_CustKey, "c_name", c.C_ACCTBAL, x_acctbal, s.ship Note FROM ', lower(object_name),
              ' JOIN Customer c ON c.c_nationkey = nation.N_NationKey') AS ddl
FROM {estate_objects} o WHERE object_type IN ('view', 'table')"""
_TOKENS = r"""regexp_extract_all(v.ddl, '"[^"]*"|(?i:ship note)|\w+|[^\w"]+')"""


@query("requote_identifiers", f"""
WITH n AS (SELECT job_id, map(list(lower_name), list(name)) AS m FROM (SELECT DISTINCT job_id, lower(name) AS lower_name, name FROM (
  SELECT job_id, object_name AS name FROM {{estate_objects}} o WHERE object_type = 'table' UNION ALL SELECT job_id, column_name FROM {{sv_columns}} c) u) d GROUP BY job_id)
SELECT v.job_id, v.object_id, array_to_string(list_transform({_TOKENS}, lambda x: coalesce('"' || n.m[lower(x)] || '"', x)), '') AS ddl
FROM {{view_texts}} v JOIN n ON n.job_id = v.job_id""")
def requote_identifiers(t):
    case_map = catalog.case_map_from_extracts(t.sv_tables, t.sv_columns)
    return translation.requote_identifiers(t.view_texts, case_map).select("job_id", "object_id", "ddl")


@query("clean_ddl", f"""
WITH n AS (SELECT job_id, map(list(lower_name), list(name)) AS m FROM (SELECT DISTINCT job_id, lower(name) AS lower_name, name FROM (
  SELECT job_id, object_name AS name FROM {{estate_objects}} o WHERE object_type = 'table' UNION ALL SELECT job_id, column_name FROM {{sv_columns}} c) u) d GROUP BY job_id)
SELECT v.job_id, v.object_id, CASE WHEN target_dialect = 'postgresql'
  THEN array_to_string(list_transform({_TOKENS}, lambda x: coalesce('"' || n.m[lower(x)] || '"', x)), '') ELSE v.ddl END AS ddl
FROM {{view_texts}} v JOIN n ON n.job_id = v.job_id""")
def clean_ddl(t):
    case_map = catalog.case_map_from_extracts(t.sv_tables, t.sv_columns)
    return translation.clean_ddl(t.view_texts, case_map).select("job_id", "object_id", "ddl")


# Answers of a model about each conversation, one per turn; some state no readable confidence.
FIXTURES["answers"] = """
SELECT conv_id AS job_id, concat('view_', conv_id) AS object_name, turn AS seq,
       concat(chr(123), '"Answer": "', text, '", "Reasoning": "', role, '", "Confidence": ',
       CASE WHEN role = 'user' THEN concat('0.', turn) WHEN role = 'assistant' THEN concat('"0.8', turn, '"') ELSE 'unsure' END, ' ', chr(125)) AS content
FROM {conversations}
UNION ALL SELECT page_id, concat('page_', page_id), 0, 'Warning: No piece find' FROM {pages} p"""
FIXTURES["translated"] = """
SELECT DISTINCT conv_id AS job_id, concat('view_', conv_id) AS object_name, CASE conv_id % 4 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'model_only'
       WHEN 2 THEN 'rule_only' ELSE 'failed' END AS method, conv_id % 7 AS lifts FROM {conversations}
UNION ALL SELECT page_id, concat('page_', page_id), CASE page_id % 2 WHEN 0 THEN 'hybrid' ELSE 'model_only' END, page_id % 3 FROM {pages} p
UNION ALL SELECT doc_id, concat('doc_', doc_id), 'hybrid', doc_id % 25 FROM {documents} d"""

_CONF = r"""try_cast(trim(regexp_extract(content, '(?s)"Answer":\s*(.*?)\s*,\s*"Reasoning":\s*(.*?),\s*"Confidence":\s*(.*?)\s', 3), '" ') AS double)"""


@query("extract_confidences", f"""SELECT * FROM (SELECT job_id, object_name, seq, content, {_CONF} AS confidence FROM {{answers}} a) x
WHERE confidence IS NOT NULL""")
def extract_confidences(t):
    return translation.extract_confidences(t.answers)


@query("score_translation", f"""
WITH a AS (SELECT job_id, object_name, avg({_CONF}) AS mean, count(*) FILTER (content <> 'Warning: No piece find') AS asked
           FROM {{answers}} a GROUP BY ALL)
SELECT o.job_id, o.object_name, o.method, o.lifts, CASE o.method
  WHEN 'hybrid' THEN round(greatest(0, coalesce(mean, CASE WHEN coalesce(asked, 0) > 0 THEN 0.75 ELSE 1.0 END) - cast(0.05 AS double) * o.lifts), 4)
  WHEN 'model_only' THEN round(greatest(cast(0.2 AS double), greatest(0, coalesce(mean, 0.75) - cast(0.1 AS double) * o.lifts) - cast(0.15 AS double)), 4)
  WHEN 'rule_only' THEN 0.5 ELSE 0.0 END AS confidence
FROM {{translated}} o LEFT JOIN a ON a.job_id = o.job_id AND a.object_name = o.object_name""")
def score_translation(t):
    return translation.score_translation(t.translated, t.answers)


FIXTURES["translations"] = """
SELECT object_id AS id, object_id AS source_object_id, job_id, object_type, object_name, definition AS source_ddl,
       CASE WHEN object_type = 'procedure' AND segment = 'BUILDING' THEN 'model timed out' END AS error,
       CASE WHEN segment = 'HOUSEHOLD' AND object_type = 'trigger' THEN NULL ELSE lower(definition) END AS target_ddl,
       CASE WHEN object_type = 'trigger' THEN 0.7 WHEN object_type = 'view' THEN 0.95 WHEN segment = 'MACHINERY' THEN NULL ELSE 0.75 END AS confidence
FROM {estate_objects} o"""
SQL_STATUS = """
SELECT id, job_id, object_type, object_name, status, CASE WHEN status IN ('SUCCESS', 'FAILED') THEN cast(confidence AS double) END AS confidence,
       status IN ('NO_SOURCE_DDL', 'ERROR') OR (status IN ('SUCCESS', 'FAILED') AND coalesce(confidence <= 0.7, false)) AS low_confidence
FROM (SELECT *, CASE WHEN object_type = 'table' THEN 'SKIPPED_TABLE' WHEN source_ddl IS NULL THEN 'NO_SOURCE_DDL' WHEN error IS NOT NULL THEN 'ERROR'
      WHEN target_ddl IS NULL THEN 'FAILED' ELSE 'SUCCESS' END AS status FROM {translations} t) s"""


def statuses_of(t):
    rows = t.translations.withColumn("confidence", F.col("confidence").cast("double"))
    return translation.translation_status(rows).select(
        "id", "job_id", "object_type", "object_name", "status", "confidence", "low_confidence"
    )


@query("translation_status", SQL_STATUS)
def translation_status(t):
    return statuses_of(t)


@query("average_confidence", f"SELECT job_id, avg(confidence) AS average_confidence FROM ({SQL_STATUS}) s GROUP BY job_id")
def average_confidence(t):
    return translation.average_confidence(statuses_of(t))


FIXTURES["translation_results"] = """
SELECT t.id, t.job_id, t.source_object_id, t.target_ddl, CASE WHEN t.error IS NULL AND t.target_ddl IS NOT NULL THEN 'SUCCESS' ELSE 'ERROR' END AS translation_status,
       a.applied_status, a.applied_error
FROM {translations} t JOIN {applied} a ON a.job_id = t.job_id AND a.object_type = t.object_type AND a.object_name = t.object_name"""


def _applicable(pending: str) -> str:
    return f"""SELECT r.id, r.job_id, r.source_object_id, r.target_ddl, o.object_type, o.object_name
FROM {{translation_results}} r JOIN {{estate_objects}} o ON o.object_id = r.source_object_id
WHERE r.translation_status = 'SUCCESS' AND r.target_ddl IS NOT NULL AND (r.applied_status IS NULL {pending})"""


@query("applicable_translations", _applicable(""))
def applicable_translations(t):
    return translation.applicable_translations(t.translation_results, t.estate_objects)


@query("applicable_translations_pending", _applicable("OR r.applied_status = 'PENDING_MANUAL_REVIEW'"))
def applicable_translations_pending(t):
    return translation.applicable_translations(t.translation_results, t.estate_objects, include_pending=True)


@query("applied_outcomes", """SELECT o.job_id, o.object_type, o.object_name, r.applied_status, r.applied_error
FROM {translation_results} r JOIN {estate_objects} o ON o.object_id = r.source_object_id""")
def applied_outcomes(t):
    return translation.applied_outcomes(t.translation_results, t.estate_objects)


FIXTURES["attempts"] = """
SELECT job_id, object_type, object_name, CASE WHEN object_type = 'foreign_key' THEN concat('constraint ', object_name, ' Already Exists')
       WHEN object_type = 'view' AND acctbal < 0 THEN 'relation already exists' WHEN object_type = 'trigger' THEN 'permission denied' END AS error
FROM {estate_objects} o WHERE object_type <> 'table'"""
FIXTURES["flagged"] = "SELECT job_id, object_name FROM {low_confidence} l UNION ALL SELECT job_id, object_name FROM {low_confidence} m"


@query("apply_outcomes", """
SELECT job_id, object_type, object_name, applied_status, CASE WHEN applied_status = 'APPLY_FAILED' THEN error END AS applied_error FROM (
SELECT a.*, CASE WHEN EXISTS (SELECT 1 FROM {flagged} f WHERE f.job_id = a.job_id AND f.object_name = a.object_name) THEN 'PENDING_MANUAL_REVIEW'
  WHEN error IS NULL OR (object_type = 'foreign_key' AND lower(error) LIKE '%already exists%') THEN 'APPLIED' ELSE 'APPLY_FAILED' END AS applied_status
FROM {attempts} a) x""")
def apply_outcomes(t):
    return translation.apply_outcomes(t.attempts, t.flagged)


@query("translation_summary", f"""
SELECT job_id, status, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' WHEN confidence IS NOT NULL THEN 'low' END AS band,
       count(*) AS objects FROM ({SQL_STATUS}) s GROUP BY ALL""")
def translation_summary(t):
    return translation.translation_summary(statuses_of(t))
