"""The queries of problems 2, 6, 7 and 8, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.llm.conversations import ordered, verdicts
from tesseral.llm.packing import pack
from tesseral.llm.quality import text_types
from tesseral.llm.tokenizer import encode
from tesseral.session import table


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return verdicts(table(spark, root, "transcript_event")).where("reason is not null").select("conversation_id", "reason")


def p2_conversations(spark: SparkSession, root: str) -> DataFrame:
    return ordered(table(spark, root, "transcript_event"))


def p2_trees(spark: SparkSession, root: str) -> DataFrame:
    """Every conversation with its prompts, replies and trees, and why it is dropped (null if it is not)."""
    return verdicts(table(spark, root, "transcript_event"))


def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    return encode(table(spark, root, "documents"), "doc_id", "text").select(F.col("row").alias("doc_id"), "ids")


def p7_packed(spark: SparkSession, root: str) -> DataFrame:
    return pack(table(spark, root, "documents"), table(spark, root, "context_window"), "doc_id", "text").withColumnRenamed("row", "doc_id")


def p7_fill(spark: SparkSession, root: str) -> DataFrame:
    """How full the windows of each capacity are."""
    used = p7_packed(spark, root).groupBy("window_id", "bin").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("pieces"))
    return (
        used.groupBy("window_id")
        .agg(F.count("*").alias("bins"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.sum("pieces").alias("pieces"))
        .join(F.broadcast(table(spark, root, "context_window")), "window_id")
        .withColumn("filled", F.col("tokens") / (F.col("bins") * F.col("capacity_tokens")))
    )


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return p8_statistics(spark, root).where("text_type <> 'prose'").select("doc_id")


def p8_statistics(spark: SparkSession, root: str) -> DataFrame:
    return text_types(table(spark, root, "documents"), "doc_id", "text", table(spark, root, "common_word")).withColumnRenamed("row", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_conversations, p2_trees, p6_ids, p7_packed, p7_fill, p8_found, p8_statistics)}
_VERDICTS = r"""
WITH ev AS (
  SELECT *, CASE WHEN json_valid(message) AND json_type(message) = 'OBJECT' THEN CAST(message AS JSON) END AS m,
    CASE WHEN regexp_full_match(ts, '\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)') THEN epoch_us(try_cast(ts AS TIMESTAMPTZ))
         WHEN regexp_full_match(ts, '\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?') THEN epoch_us(try_cast(ts AS TIMESTAMP)) END AS us
  FROM transcript_event
), one AS (
  SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY session_key, event_idx ORDER BY arrived_at, line_id) = 1
), files AS (
  SELECT session_key, coalesce(sid, session_key) AS conversation_id, row_number() OVER (PARTITION BY coalesce(sid, session_key) ORDER BY first NULLS LAST, session_key) AS file
  FROM (SELECT session_key, min(us) AS first FROM one GROUP BY 1) JOIN (SELECT session_key, max(nullif(session_id, '')) AS sid FROM transcript_event GROUP BY 1) USING (session_key)
), said AS (
  SELECT conversation_id, file, event_idx, m, coalesce(is_meta, false) AS meta, coalesce(type, m->>'$.role') AS role,
    CASE WHEN json_type(m, '$.content') = 'VARCHAR' THEN m->>'$.content' END AS line,
    CASE WHEN json_type(m, '$.content') = 'ARRAY' THEN CAST(m->'$.content' AS JSON[]) ELSE [] END AS items
  FROM one JOIN files USING (session_key)
), talk AS (
  SELECT *, coalesce(regexp_matches(line, '\S'), false) OR len(list_filter(items, lambda i: i->>'$.type' = 'text' AND json_type(i, '$.text') = 'VARCHAR' AND regexp_matches(i->>'$.text', '\S'))) > 0 AS talks,
    len(list_filter(items, lambda i: i->>'$.type' = 'tool_use')) AS uses, len(list_filter(items, lambda i: i->>'$.type' = 'tool_result')) AS results
  FROM said WHERE role IN ('user', 'assistant')
), kind AS (
  SELECT *, CASE WHEN role = 'user' AND NOT meta AND results = 0 AND talks THEN 'prompt' WHEN role = 'assistant' AND (talks OR uses > 0) THEN 'reply' END AS kind FROM talk
), item AS (
  SELECT conversation_id, file, event_idx, n, i->>'$.type' AS t, i->>'$.id' AS id, i->>'$.tool_use_id' AS rid
  FROM (SELECT conversation_id, file, event_idx, unnest(items) AS i, unnest(range(len(items))) AS n FROM talk)
), call AS (
  SELECT conversation_id, id, min((file, event_idx, n)) AS made FROM item WHERE t = 'tool_use' AND id IS NOT NULL GROUP BY 1, 2
), lost AS (
  SELECT DISTINCT r.conversation_id FROM item r LEFT JOIN call c ON c.conversation_id = r.conversation_id AND c.id = r.rid
  WHERE t = 'tool_result' AND (made IS NULL OR made > (file, event_idx, n))
), turns AS (
  SELECT conversation_id, kind, lead(kind) OVER (PARTITION BY conversation_id ORDER BY file, event_idx) AS next, lag(kind) OVER (PARTITION BY conversation_id ORDER BY file, event_idx) AS prev
  FROM kind WHERE kind IS NOT NULL
), agg AS (
  SELECT conversation_id, bool_or(prev IS NULL AND kind = 'reply') AS headless, bool_or(kind = 'prompt' AND coalesce(next, 'prompt') = 'prompt') AS open FROM turns GROUP BY 1
), bad AS (
  SELECT DISTINCT conversation_id FROM talk WHERE m IS NULL
), verdict AS (
  SELECT c.conversation_id, CASE WHEN a.conversation_id IS NULL THEN 'empty' WHEN headless OR b.conversation_id IS NOT NULL OR l.conversation_id IS NOT NULL THEN 'broken' WHEN open THEN 'no_reply' END AS reason
  FROM (SELECT DISTINCT conversation_id FROM files) c LEFT JOIN agg a USING (conversation_id) LEFT JOIN bad b USING (conversation_id) LEFT JOIN lost l USING (conversation_id)
)
"""
ORACLES: dict[str, str] = {
    "p2_found": _VERDICTS + "SELECT conversation_id, reason FROM verdict WHERE reason IS NOT NULL",
    "p2_trees": _VERDICTS + "SELECT conversation_id, coalesce(prompts, 0) AS prompts, coalesce(replies, 0) AS replies, coalesce(prompts, 0) AS trees, reason FROM verdict LEFT JOIN (SELECT conversation_id, count(*) FILTER (WHERE kind = 'prompt') AS prompts, count(*) FILTER (WHERE kind = 'reply') AS replies FROM kind GROUP BY 1) USING (conversation_id)",
}
