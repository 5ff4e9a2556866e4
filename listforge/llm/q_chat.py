"""Queries over ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from listforge.llm import chat
from listforge.llm.common import table

_TRICKY = "\\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    extra = spark.createDataFrame([(-7, 0, "user", _TRICKY), (-7, 1, "assistant", _TRICKY)],
                                  "conv_id long, turn long, role string, text string")
    turns = chat.canonical_turns(rows).unionByName(chat.canonical_turns(extra))
    return chat.read_back(chat.formatted_turns(turns))


QUERIES = {"op1_chat_format": op1_chat_format}

ORACLE = {"op1_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '<turn', '\<turn'), '</turn', '\</turn') AS body,
    replace(replace(replace(replace(role, '\', '\\'), '<turn', '\<turn'), '</turn', '\</turn'), '>', '\>') AS who
  FROM c),
t AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(who) + length(body) + length('<turn ' || '>' || '</turn>') + 3) AS BIGINT) AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT * FROM t
"""}
