"""The queries of the general training-data problems 1, 3, 4 and 5, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.operators.drift import schema_changes, union_table
from tesseral.operators.nested import explode_objects, field_types, flat_table, own_fields
from tesseral.operators.orphans import find_orphans, references
from tesseral.operators.redelivery import find_repeats
from tesseral.session import table

# The referring tables with their row id and key.
REFERRING = [("result_segment", "result_row", "tool_use_id"), ("hook_record", "hook_row", "tool_use_id"), ("agent_return", "return_row", "tool_use_id")]


def _orphans(spark: SparkSession, root: str) -> DataFrame:
    first, *rest = (references(table(spark, root, t), t, r, k, "arrived_at") for t, r, k in REFERRING)
    for x in rest:
        first = first.unionByName(x)
    return find_orphans(first, table(spark, root, "tool_call"))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return _orphans(spark, root).select("source_table", "row_id", "reason")


def p1_report(spark: SparkSession, root: str) -> DataFrame:
    return _orphans(spark, root).groupBy("source_table", F.to_date("at").alias("day"), "reason").agg(F.count("*").alias("orphans"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return schema_changes(table(spark, root, "log_line"), table(spark, root, "log_file")).select("file_id", "change", "old_path", "new_path")


def p3_table(spark: SparkSession, root: str) -> DataFrame:
    return union_table(table(spark, root, "log_line"), table(spark, root, "log_file"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return find_repeats(table(spark, root, "usage_entry"), "request_id", "received_at", "row_id")


def p4_kept(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "usage_entry")
    return rows.join(find_repeats(rows, "request_id", "received_at", "row_id"), "row_id", "left_anti").select("row_id", "batch_id", "request_id", "usage")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    found = explode_objects(table(spark, root, "transcript_event"), "line_id", "message", nodes=False)
    return found.select(F.col("row").alias("line_id"), "item_path", "parent_path")


def _fields(spark: SparkSession, root: str) -> DataFrame:
    return own_fields(table(spark, root, "transcript_event"), "line_id", "message")


def p5_tables(spark: SparkSession, root: str) -> DataFrame:
    """All flat tables in one: a row a value, with the table and the row it belongs to and that row's parent."""
    return _fields(spark, root).withColumnRenamed("row", "line_id")


def p5_schema(spark: SparkSession, root: str) -> DataFrame:
    return field_types(_fields(spark, root)).withColumn("kinds", F.concat_ws(",", "kinds"))


def p5_records(spark: SparkSession, root: str) -> DataFrame:
    """The flat table of the records themselves, usage included, a typed column a field."""
    types = [(r["field"], r["kinds"]) for r in field_types(_fields(spark, root)).where("table_name = ''").collect()]
    return flat_table(table(spark, root, "transcript_event"), "line_id", "message", "", types).withColumnRenamed("row", "line_id").drop("parent_path", "item_path", "place")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_report, p3_found, p3_table, p4_found, p4_kept, p5_found, p5_tables, p5_schema, p5_records)}

_ORPHANS = """
WITH refs AS (
  SELECT 'result_segment' AS source_table, result_row AS row_id, tool_use_id AS k, arrived_at AS t FROM result_segment
  UNION ALL SELECT 'hook_record', hook_row, tool_use_id, arrived_at FROM hook_record
  UNION ALL SELECT 'agent_return', return_row, tool_use_id, arrived_at FROM agent_return
), judged AS (
  SELECT source_table, row_id, t, count(p.id) AS n,
         coalesce(bool_or(p.arrived_at <= t AND (p.deleted_at IS NULL OR p.deleted_at > t)), false) AS ok,
         coalesce(min(p.arrived_at) > t, false) AS late
  FROM refs LEFT JOIN tool_call p ON p.id = k
  WHERE k IS NOT NULL AND regexp_matches(k, '\\S')
  GROUP BY source_table, row_id, t
), cases AS (
  SELECT source_table, row_id, t, CASE WHEN n = 0 THEN 'missing' WHEN late THEN 'late' ELSE 'deleted' END AS reason
  FROM judged WHERE NOT ok
)
"""
_FIELDS = """
WITH RECURSIVE node(line_id, v, tbl, item, parent, own, field) AS (
  SELECT line_id, CAST(message AS JSON), '', '', '', '', '' FROM transcript_event WHERE json_valid(message) AND json_type(message) = 'OBJECT'
  UNION ALL
  SELECT line_id, c.v, c.tbl, c.item, CASE WHEN c.inside THEN own ELSE parent END, CASE WHEN c.inside AND json_type(c.v) = 'OBJECT' THEN c.item ELSE own END, c.field
  FROM (
    SELECT line_id, parent, own, unnest(
      CASE json_type(v)
        WHEN 'OBJECT' THEN list_transform(json_keys(v), lambda k: {'v': json_extract(v, '$."' || k || '"'), 'tbl': tbl, 'item': item, 'field': CASE field WHEN '' THEN k ELSE field || '.' || k END, 'inside': false})
        ELSE list_transform(range(CAST(json_array_length(v) AS BIGINT)), lambda i: {'v': json_extract(v, '$[' || i || ']'),
          'tbl': CASE WHEN field = '' THEN tbl WHEN tbl = '' THEN field ELSE tbl || '.' || field END || '[]', 'item': CASE WHEN field = '' THEN item WHEN item = '' THEN field ELSE item || '.' || field END || '[' || i || ']', 'field': '', 'inside': true})
      END) AS c
    FROM node WHERE json_type(v) IN ('OBJECT', 'ARRAY')
  )
), val AS (
  SELECT line_id, tbl AS table_name, item AS item_path, parent AS parent_path, field,
    CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS kind, CASE WHEN json_type(v) IN ('VARCHAR', 'BOOLEAN') THEN v->>'$' END AS text, CASE WHEN json_type(v) NOT IN ('VARCHAR', 'BOOLEAN') THEN CAST(v AS DOUBLE) END AS number
  FROM node WHERE json_type(v) NOT IN ('OBJECT', 'ARRAY', 'NULL')
)
"""
_USAGE_PATHS = ["cache_creation.ephemeral_1h_input_tokens", "cache_creation.ephemeral_5m_input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "input_tokens", "output_tokens", "output_tokens_details.thinking_tokens"]
_RANKED = """
WITH named AS (
  SELECT row_id, received_at, nullif(lower(regexp_replace(request_id, '^\\s+|\\s+$', '', 'g')), '') AS ident FROM usage_entry
), ranked AS (
  SELECT row_id, ident, row_number() OVER (PARTITION BY ident ORDER BY received_at, row_id) AS n FROM named
)
"""
ORACLES: dict[str, str] = {
    "p1_found": _ORPHANS + "SELECT source_table, row_id, reason FROM cases",
    "p1_report": _ORPHANS + "SELECT source_table, CAST(t AS DATE) AS day, reason, count(*) AS orphans FROM cases GROUP BY ALL",
    "p3_found": """
WITH v AS (
  SELECT file_id, CAST(line AS JSON) AS j FROM log_line WHERE json_valid(line) AND json_type(line) = 'OBJECT'
), k1 AS (
  SELECT file_id, k AS outr, json_extract(j, '$."' || k || '"') AS x FROM (SELECT file_id, j, unnest(json_keys(j)) AS k FROM v)
), k2 AS (
  SELECT file_id, outr, k AS inr, json_extract(x, '$."' || k || '"') AS x FROM (SELECT file_id, outr, x, unnest(json_keys(x)) AS k FROM k1 WHERE json_type(x) = 'OBJECT')
), kinds AS (
  SELECT file_id, outr, inr, string_agg(DISTINCT CASE json_type(x) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END, ',' ORDER BY CASE json_type(x) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END) AS t
  FROM (SELECT file_id, outr, '' AS inr, x, true AS top FROM k1 UNION ALL SELECT file_id, outr, inr, x, false FROM k2) WHERE json_type(x) <> 'NULL' GROUP BY file_id, outr, inr, top
), tops AS (
  SELECT file_id, outr AS nm, t FROM (SELECT file_id, outr, string_agg(DISTINCT kd, ',' ORDER BY kd) AS t FROM (SELECT file_id, outr, CASE json_type(x) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS kd FROM k1 WHERE json_type(x) <> 'NULL') GROUP BY 1, 2)
), ins AS (
  SELECT file_id, outr, inr AS nm, t FROM (SELECT file_id, outr, inr, string_agg(DISTINCT kd, ',' ORDER BY kd) AS t FROM (SELECT file_id, outr, inr, CASE json_type(x) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS kd FROM k2 WHERE json_type(x) <> 'NULL') GROUP BY 1, 2, 3)
), pairs AS (
  SELECT * FROM (SELECT file_id AS new_id, lag(file_id) OVER (PARTITION BY stream ORDER BY opened_at NULLS LAST, file_id) AS old_id FROM log_file WHERE file_id IN (SELECT file_id FROM v)) WHERE old_id IS NOT NULL
), tj AS (
  SELECT coalesce(o.new_id, n.new_id) AS new_id, o.nm AS o, n.nm AS n, o.t AS ot, n.t AS nt
  FROM (SELECT new_id, nm, t FROM pairs JOIN tops ON file_id = old_id) o FULL JOIN (SELECT new_id, nm, t FROM pairs JOIN tops ON file_id = new_id) n ON o.new_id = n.new_id AND o.nm = n.nm
), tg AS (
  SELECT new_id, max(o) FILTER (WHERE n IS NULL) AS o, max(n) FILTER (WHERE o IS NULL) AS n, max(ot) FILTER (WHERE n IS NULL) AS ot, max(nt) FILTER (WHERE o IS NULL) AS nt FROM tj GROUP BY 1
  HAVING count(*) FILTER (WHERE n IS NULL) = 1 AND count(*) FILTER (WHERE o IS NULL) = 1 AND max(ot) FILTER (WHERE n IS NULL) = max(nt) FILTER (WHERE o IS NULL)
), td AS (
  SELECT * FROM tj WHERE (o IS NOT NULL AND n IS NOT NULL) OR new_id NOT IN (SELECT new_id FROM tg) UNION ALL SELECT * FROM tg
), par AS (
  SELECT td.new_id, old_id, o, n FROM td JOIN pairs ON pairs.new_id = td.new_id WHERE contains(ot, 'object') AND contains(nt, 'object')
), ij AS (
  SELECT coalesce(a.new_id, b.new_id) AS new_id, coalesce(a.po, b.po) AS po, coalesce(a.pn, b.pn) AS pn, a.nm AS o, b.nm AS n, a.t AS ot, b.t AS nt
  FROM (SELECT new_id, par.o AS po, par.n AS pn, nm, t FROM par JOIN ins ON file_id = old_id AND outr = par.o) a FULL JOIN (SELECT new_id, par.o AS po, par.n AS pn, nm, t FROM par JOIN ins ON file_id = new_id AND outr = par.n) b ON a.new_id = b.new_id AND a.po = b.po AND a.pn = b.pn AND a.nm = b.nm
), ig AS (
  SELECT new_id, po, pn, max(o) FILTER (WHERE n IS NULL) AS o, max(n) FILTER (WHERE o IS NULL) AS n, max(ot) FILTER (WHERE n IS NULL) AS ot, max(nt) FILTER (WHERE o IS NULL) AS nt FROM ij GROUP BY 1, 2, 3
  HAVING count(*) FILTER (WHERE n IS NULL) = 1 AND count(*) FILTER (WHERE o IS NULL) = 1 AND max(ot) FILTER (WHERE n IS NULL) = max(nt) FILTER (WHERE o IS NULL)
), idiff AS (
  SELECT * FROM ij WHERE (o IS NOT NULL AND n IS NOT NULL) OR (new_id, po, pn) NOT IN (SELECT (new_id, po, pn) FROM ig) UNION ALL SELECT * FROM ig
), every AS (
  SELECT new_id AS file_id, o, n, ot, nt, coalesce(o, '') AS old_path, coalesce(n, '') AS new_path FROM td
  UNION ALL SELECT new_id, o, n, ot, nt, CASE WHEN o IS NULL THEN '' ELSE po || '.' || o END, CASE WHEN n IS NULL THEN '' ELSE pn || '.' || n END FROM idiff
)
SELECT file_id, CASE WHEN n IS NULL THEN 'removed' WHEN o IS NULL THEN 'added' WHEN o <> n THEN 'renamed' ELSE 'retyped' END AS change, old_path, new_path FROM every WHERE n IS NULL OR o IS NULL OR o <> n OR ot <> nt
""",
    "p4_found": _RANKED + "SELECT row_id FROM ranked WHERE ident IS NOT NULL AND n > 1",
    "p4_kept": _RANKED + "SELECT u.row_id, batch_id, request_id, usage FROM usage_entry u JOIN ranked r ON u.row_id = r.row_id WHERE ident IS NULL OR n = 1",
    "p5_tables": _FIELDS + "SELECT * FROM val",
    "p5_schema": _FIELDS + "SELECT table_name, field, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM val GROUP BY ALL",
    "p5_records": "SELECT line_id, " + ", ".join(f"CASE WHEN json_type(message, '$.{c}') = 'VARCHAR' THEN message->>'$.{c}' END AS {c}" for c in ("content", "id", "model", "role", "stop_reason"))
    + ", " + ", ".join(f"CASE WHEN json_type(message, '$.usage.{p}') NOT IN ('VARCHAR', 'OBJECT', 'ARRAY', 'NULL', 'BOOLEAN') THEN CAST(message->'$.usage.{p}' AS DOUBLE) END AS usage__{p.replace('.', '__')}" for p in _USAGE_PATHS)
    + " FROM (SELECT line_id, CAST(message AS JSON) AS message FROM transcript_event WHERE json_valid(message) AND json_type(message) = 'OBJECT')",
    "p5_found": """
WITH RECURSIVE node(line_id, v, path, around) AS (
  SELECT line_id, CAST(message AS JSON), '', '' FROM transcript_event WHERE json_valid(message) AND json_type(message) = 'OBJECT'
  UNION ALL
  SELECT line_id, child.v, child.path, CASE WHEN child.inside AND json_type(child.v) = 'OBJECT' THEN child.path ELSE around END
  FROM (
    SELECT line_id, around, unnest(
      CASE json_type(v)
        WHEN 'OBJECT' THEN list_transform(json_keys(v), lambda k: {'v': json_extract(v, '$."' || k || '"'), 'path': CASE path WHEN '' THEN k ELSE path || '.' || k END, 'inside': false})
        ELSE list_transform(range(CAST(json_array_length(v) AS BIGINT)), lambda i: {'v': json_extract(v, '$[' || i || ']'), 'path': path || '[' || i || ']', 'inside': true})
      END) AS child
    FROM node WHERE json_type(v) IN ('OBJECT', 'ARRAY')
  )
), named AS (
  SELECT line_id, path, around FROM node WHERE around = path AND path <> ''
)
SELECT n.line_id, n.path AS item_path, coalesce(max_by(p.path, length(p.path)), '') AS parent_path
FROM named n LEFT JOIN named p ON p.line_id = n.line_id AND starts_with(n.path, p.path || '.')
GROUP BY n.line_id, n.path
""",
}
