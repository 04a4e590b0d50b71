"""DuckDB text that several oracles share."""

from __future__ import annotations

# Fixed value: white space as in functions.text, in RE2's notation.
WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def micros(x: str) -> str:
    """An ISO text as microseconds; no zone means UTC; null if it can't be read."""
    day = r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?"
    return rf"CASE WHEN regexp_full_match({x}, '{day}(Z|[+-]\d\d:\d\d)') THEN epoch_us(try_cast({x} AS TIMESTAMPTZ)) WHEN regexp_full_match({x}, '{day}') THEN epoch_us(try_cast({x} AS TIMESTAMP)) END"


_TEXTS = f"list_transform(list_filter(items, lambda i: i->>'$.type' = 'text' AND json_type(i, '$.text') = 'VARCHAR' AND {strip("i->>'$.text'")} <> ''), lambda i: {strip("i->>'$.text'")})"
_FLAT = strip("user_text")
_NAME = r"regexp_extract(user_text, '(?s)<command-name>(.*?)</command-name>', 1)"
_ARGS = r"regexp_extract(user_text, '(?s)<command-args>(.*?)</command-args>', 1)"

#: Events, their items, user texts (ut) and prompts (pr) of transcript_event.
EVENTS = rf"""
WITH ev AS (
  SELECT session_key, event_idx, type, ts, coalesce(is_meta, false) AS is_meta, session_id, git_branch, cwd, version, request_id, attachment, message,
    CASE WHEN json_valid(message) AND json_type(message) = 'OBJECT' THEN CAST(message AS JSON) END AS m, {micros("ts")} AS us
  FROM transcript_event QUALIFY row_number() OVER (PARTITION BY session_key, event_idx ORDER BY arrived_at, line_id) = 1
), parts AS (
  SELECT *, CASE WHEN json_type(m, '$.content') = 'VARCHAR' THEN m->>'$.content' END AS line,
    CASE WHEN json_type(m, '$.content') = 'ARRAY' THEN CAST(m->'$.content' AS JSON[]) ELSE [] END AS items
  FROM ev
), item AS (
  SELECT session_key, event_idx, type, ts, n AS item_idx, i, i->>'$.type' AS kind
  FROM (SELECT session_key, event_idx, type, ts, unnest(items) AS i, unnest(range(len(items))) AS n FROM parts)
), ut AS (
  SELECT *, CASE WHEN type IS DISTINCT FROM 'user' THEN NULL WHEN line IS NOT NULL THEN line
    WHEN json_type(m, '$.content') = 'ARRAY' AND len(list_filter(items, lambda i: i->>'$.type' = 'tool_result')) = 0 THEN coalesce(array_to_string({_TEXTS}, chr(10)), '') END AS user_text
  FROM parts
), nx AS (
  SELECT *, lead(user_text) OVER (PARTITION BY session_key ORDER BY event_idx) AS next_text FROM ut
), pr AS (
  SELECT *, CASE WHEN type = 'user' AND NOT is_meta AND user_text IS NOT NULL AND NOT starts_with({_FLAT}, '<local-command-stdout>')
      AND NOT ({_NAME} <> '' AND coalesce(starts_with({strip("next_text")}, '<local-command-stdout>'), false))
      AND NOT starts_with({_FLAT}, '<local-command-caveat>') AND NOT starts_with({_FLAT}, '<task-notification>') AND {_FLAT} <> ''
      AND NOT regexp_matches({_FLAT}, '^\[Request interrupted by user[^\]]*\]$')
    THEN CASE WHEN {_NAME} <> '' THEN {strip(f"{strip(_NAME)} || ' ' || {strip(_ARGS)}")} ELSE user_text END END AS prompt
  FROM nx
)
"""

_COUNT = lambda p: f"CASE json_type(u, '$.{p}') WHEN 'BOOLEAN' THEN CASE WHEN u->>'$.{p}' = 'true' THEN 1 ELSE 0 END WHEN 'UBIGINT' THEN CAST(u->>'$.{p}' AS BIGINT) WHEN 'BIGINT' THEN CAST(u->>'$.{p}' AS BIGINT) WHEN 'DOUBLE' THEN CAST(trunc(CAST(u->>'$.{p}' AS DOUBLE)) AS BIGINT) ELSE 0 END"
NAMES = ("input", "output", "cache_read", "cache_creation", "cache_creation_1h", "cache_creation_5m", "thinking")
_PATHS = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "cache_creation.ephemeral_1h_input_tokens", "cache_creation.ephemeral_5m_input_tokens", "output_tokens_details.thinking_tokens")
#: The usage series of the events' messages.
USAGE = EVENTS + ", us_raw AS (SELECT session_key, event_idx, request_id, m->'$.usage' AS u FROM ev WHERE json_type(m, '$.usage') = 'OBJECT'), series AS (SELECT session_key, event_idx, request_id, " + ", ".join(f"{_COUNT(p)} AS {n}" for n, p in zip(NAMES, _PATHS)) + " FROM us_raw QUALIFY row_number() OVER (PARTITION BY session_key, coalesce('=' || request_id, '#' || event_idx) ORDER BY event_idx) = 1)"

#: Turns: pr with turn_idx and turn_prompt, compactions from the hook log.
TURNS = USAGE + f"""
, comp AS (
  SELECT DISTINCT session_id AS session_key, {micros("ts")} AS t FROM hook_record WHERE event IN ('PreCompact', 'PostCompact') AND coalesce(agent_id, '') = '' AND session_id IS NOT NULL
), hit AS (
  SELECT DISTINCT c.session_key, min(e.event_idx) AS event_idx FROM comp c JOIN ev e ON e.session_key = c.session_key AND e.us >= c.t GROUP BY c.session_key, c.t
), st AS (
  SELECT pr.*, row_number() OVER w = 1 AS first_row, count(prompt) OVER (PARTITION BY pr.session_key ORDER BY pr.event_idx) AS prompts,
    first_value(prompt IGNORE NULLS) OVER (PARTITION BY pr.session_key ORDER BY pr.event_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS any_prompt, hit.event_idx IS NOT NULL AS compacted
  FROM pr LEFT JOIN hit ON hit.session_key = pr.session_key AND hit.event_idx = pr.event_idx WINDOW w AS (PARTITION BY pr.session_key ORDER BY pr.event_idx)
), turned AS (
  SELECT *, CASE WHEN any_prompt IS NOT NULL THEN sum(CASE WHEN first_row OR (prompt IS NOT NULL AND prompts > 1) OR compacted THEN 1 ELSE 0 END) OVER (PARTITION BY session_key ORDER BY event_idx) - 1 END AS turn_idx,
    coalesce(last_value(prompt IGNORE NULLS) OVER (PARTITION BY session_key ORDER BY event_idx), any_prompt) AS turn_prompt
  FROM st
)
"""
