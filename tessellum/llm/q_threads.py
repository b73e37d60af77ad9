"""Queries on conversations (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.llm import threads
from tessellum.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conversation_id, defect) of each conversation to be dropped."""
    return threads.rebuild(table(spark, sf_dir, "messages"), table(spark, sf_dir, "conversations"))[1].where(F.col("defect").isNotNull())


def p3_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept conversations, a row per message in order."""
    return threads.rebuild(table(spark, sf_dir, "messages"), table(spark, sf_dir, "conversations"))[0]


_INVISIBLE = r"[\s\p{Z}\p{Cc}\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}]"
_CTES = rf"""
WITH m0 AS (
  SELECT id, conversation_id, role, content, tool_call_id, min(created_at) OVER (PARTITION BY id) AS created_at,
         row_number() OVER (PARTITION BY id ORDER BY created_at NULLS LAST) AS rn
  FROM messages WHERE conversation_id IS NOT NULL),
m1 AS (
  SELECT id, conversation_id, content, tool_call_id, created_at, upper(trim(role)) AS role,
         length(regexp_replace(replace(coalesce(content, ''), '[TRUNCATED DUE TO ERROR]', ''), '{_INVISIBLE}', '', 'g')) > 0 AS visible
  FROM m0 WHERE rn = 1),
m2 AS (
  SELECT *, coalesce(list_position(['SYSTEM', 'USER', 'TOOL', 'TOOL_RESPONSE', 'ASSISTANT'], role), 0) AS rnk FROM m1),
m AS (
  SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at NULLS FIRST, CASE WHEN rnk = 0 THEN 9 ELSE rnk END, id) AS pos FROM m2),
facts AS (
  SELECT conversation_id, bool_or(visible AND role IN ('USER', 'ASSISTANT')) AS speaks, bool_or(rnk = 0) AS odd, bool_or(created_at IS NULL) AS no_time,
         min(pos) FILTER (visible AND role = 'USER') AS first_user, min(pos) FILTER (visible AND role NOT IN ('USER', 'SYSTEM')) AS first_other
  FROM m GROUP BY 1),
made AS (
  SELECT conversation_id, call_id, min(pos) AS at FROM (
    SELECT conversation_id, pos, json_extract_string(unnest(CAST(json_extract(content, '$[*]') AS JSON[])), '$.id') AS call_id
    FROM m WHERE role = 'TOOL' AND json_valid(content)) GROUP BY 1, 2),
answered AS (SELECT conversation_id, tool_call_id AS call_id, min(pos) AS at FROM m WHERE role = 'TOOL_RESPONSE' GROUP BY 1, 2),
misfit AS (
  SELECT DISTINCT coalesce(a.conversation_id, b.conversation_id) AS conversation_id
  FROM made a FULL JOIN answered b ON a.conversation_id = b.conversation_id AND a.call_id = b.call_id
  WHERE a.at IS NULL OR b.at IS NULL OR b.at < a.at),
ev AS (
  SELECT conversation_id, pos, CASE WHEN role = 'USER' AND visible THEN 'U' WHEN role = 'ASSISTANT' AND visible THEN 'A' WHEN role IN ('ASSISTANT', 'TOOL', 'TOOL_RESPONSE') THEN 'x' END AS kind
  FROM m),
xs AS (SELECT *, sum(CASE WHEN kind = 'x' THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_id ORDER BY pos) AS x FROM ev WHERE kind IS NOT NULL),
nx AS (
  SELECT conversation_id, kind, lead(kind) OVER w AS next_kind, x, lead(x) OVER w AS next_x FROM xs WHERE kind <> 'x'
  WINDOW w AS (PARTITION BY conversation_id ORDER BY pos)),
silent AS (SELECT DISTINCT conversation_id FROM nx WHERE kind = 'U' AND (next_kind IS NULL OR (next_kind = 'U' AND next_x > x))),
known AS (SELECT DISTINCT id AS conversation_id FROM conversations WHERE id IS NOT NULL),
every AS (SELECT conversation_id FROM facts UNION SELECT conversation_id FROM known),
judged AS (
  SELECT e.conversation_id,
    CASE WHEN NOT coalesce(f.speaks, false) THEN 'empty'
         WHEN k.conversation_id IS NULL OR f.odd OR f.no_time OR mi.conversation_id IS NOT NULL
              OR (f.first_other IS NOT NULL AND (f.first_user IS NULL OR f.first_other < f.first_user)) THEN 'broken'
         WHEN s.conversation_id IS NOT NULL THEN 'missing_reply' END AS defect
  FROM every e LEFT JOIN facts f USING (conversation_id) LEFT JOIN known k USING (conversation_id)
       LEFT JOIN misfit mi USING (conversation_id) LEFT JOIN silent s USING (conversation_id))
"""

QUERIES = {"p3_found": p3_found, "p3_conversations": p3_conversations}
ORACLE = {
    "p3_found": _CTES + "SELECT conversation_id, defect FROM judged WHERE defect IS NOT NULL",
    "p3_conversations": _CTES
    + """SELECT m.conversation_id, m.pos - 1 AS position, m.id, m.role, m.content, m.tool_call_id, m.created_at
FROM m JOIN judged USING (conversation_id) WHERE judged.defect IS NULL""",
}
