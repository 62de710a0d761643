"""Multi-party chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and all others as
named users; the mask marks the characters to learn: the speaker's own words and the end mark after them.

Marks inside a role or a text cannot begin or end a turn: every run of bars between ``<`` and ``im_`` is doubled (``<||im_start|>``), which ``restored`` takes
back, so that different texts stay different; line breaks in a role are blanks. There is a rendering for each participant, so the output has turns x participants turns in all.

A rendering is a list of chunks of up to ``chunk_turns`` turns in order (nearly always one), so that a conversation of
any length is rendered whole without meeting in one row or task. Cases: a null role is the participant ``unknown``; null
text is empty; turns of an equal number follow by role, then text; a null turn comes first; a null conv_id is one
conversation; an empty table renders nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ordering import numbered

CHUNK_TURNS = 64
START, END = "<|im_start|>", "<|im_end|>"


def _own(role: Column) -> Column:
    return F.lit(f"{START}assistant\n")


def _other(role: Column) -> Column:
    return F.concat(F.lit(f"{START}user name="), role, F.lit("\n"))


def _plain(c: Column) -> Column:
    """``c`` with every run of bars between ``<`` and ``im_`` doubled, so that no start or end mark is left."""
    return F.regexp_replace(c, r"<(\|+)im_", "<$1$1im_")


def restored(c: Column) -> Column:
    """The text that ``_plain`` made ``c`` of: such runs are of even length, and are halved."""
    return F.regexp_replace(c, r"<(\|+)\1im_", "<$1im_")


def perspectives(turns: DataFrame, chunk_turns: int = CHUNK_TURNS, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, perspective, chunk, n_turns, rendered, mask (spans of characters of ``rendered``)."""
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.translate(_plain(F.coalesce(F.col(role), F.lit("unknown"))), "\r\n", "  ").alias("role"), _plain(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    placed = numbered(rows, ["conv_id"], ["turn", "role", "text"], "place")
    chunk = F.floor(F.col("place") / chunk_turns).alias("chunk")
    chunks = placed.groupBy("conv_id", chunk).agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
    people = rows.select(F.col("conv_id").alias("of"), F.col("role").alias("perspective")).distinct()
    both = chunks.join(people, chunks["conv_id"].eqNullSafe(people["of"])).drop("of")
    mine = lambda t: t["role"] == F.col("perspective")
    head = lambda t: F.when(mine(t), _own(t["role"])).otherwise(_other(t["role"]))
    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), mine(t).alias("own")))

    def add(state: Column, p: Column) -> Column:
        start = state["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        span = F.when(p["own"], F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct((end + 1).alias("at"), F.concat(state["mask"], span).alias("mask"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))
    return both.select("conv_id", "perspective", "chunk", pieces.alias("pieces")).select(
        "conv_id",
        "perspective",
        "chunk",
        F.size("pieces").cast("long").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("rendered"),
        F.aggregate("pieces", none, add, lambda s: s["mask"]).alias("mask"),
    )


def digest(turns: DataFrame) -> DataFrame:
    """The renderings, with the mask as text: start-end, joined by commas."""
    out = perspectives(turns)
    spans = F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string")))
    return out.withColumn("mask", F.array_join(spans, ","))


DIGEST_SQL = """
WITH c AS (
  SELECT conv_id, turn, translate(regexp_replace(coalesce(role, 'unknown'), '<(\\|+)im_', '<\\1\\1im_', 'g'), chr(13) || chr(10), '  ') AS role,
         regexp_replace(coalesce(text, ''), '<(\\|+)im_', '<\\1\\1im_', 'g') AS text
  FROM conversations),
t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place FROM c),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t),
r AS (
  SELECT t.conv_id, p.perspective, t.place // 64 AS chunk, t.place, t.role = p.perspective AS own,
         CASE WHEN t.role = p.perspective THEN '<|im_start|>assistant' || chr(10)
              ELSE '<|im_start|>user name=' || t.role || chr(10) END AS head,
         t.text || '<|im_end|>' AS body
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
      PARTITION BY conv_id, perspective, chunk ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS a
  FROM r)
SELECT conv_id, perspective, CAST(chunk AS BIGINT) AS chunk, count(*) AS n_turns,
       string_agg(head || body || chr(10), '' ORDER BY place) AS rendered,
       coalesce(string_agg(CAST(a AS BIGINT) || '-' || CAST(a + length(body) AS BIGINT), ',' ORDER BY place) FILTER (WHERE own), '') AS mask
FROM o GROUP BY ALL
"""
