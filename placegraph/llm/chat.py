"""Multi-party chat formatting: every participant in turn is the assistant.

For each participant of a conversation the dialogue is rendered with that speaker's
turns as the assistant's and everybody else's as those of named users, and the part
to learn, the assistant's words and end marker, is given as a span. A rendering is
kept as its segments in order, one row per turn with offsets, so that a conversation
of any length is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placegraph.operators.common import running

END = "<|end|>\n"
#: Speaks to all and is nobody's part.
SYSTEM = "system"
NOBODY = "unknown"
#: Turn numbers numbered together in one task.
CHUNK = 256


def _plain(c: Column) -> Column:
    """Text in which nobody can write a marker of their own."""
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def perspectives(turns: DataFrame) -> DataFrame:
    """Segments of every participant's rendering of every conversation.

    Takes ``conv_id, turn, role, text``; turns follow ``turn`` (null first), equal ones
    speaker and text. A null or blank role is the participant ``unknown``; ``system``
    turns appear in all renderings and have none of their own. Null texts are empty;
    a null ``conv_id`` is one conversation. Repeated rows are turns of their own.
    Returns ``conv_id, participant, turn, speaker, segment, start, end, learn_start,
    learn_end``: character offsets into the rendering, the last two -1 where masked.
    """
    speaker = F.coalesce(F.nullif(F.trim(F.col("role").cast("string")), F.lit("")), F.lit(NOBODY))
    said = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), speaker.alias("speaker"),
                        _plain(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("body"))
    people = said.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("speaker").alias("participant")).distinct()
    seen = said.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    own = F.col("speaker") == F.col("participant")
    head = (F.when(F.col("speaker") == SYSTEM, F.lit("<|system|>\n")).when(own, F.lit("<|assistant|>\n"))
            .otherwise(F.concat(F.lit("<|user|>"), _plain(F.col("speaker")), F.lit("\n"))))
    shown = seen.select("*", head.alias("head"), own.alias("own"))
    shown = shown.withColumn("size", (F.length("head") + F.length("body") + F.lit(len(END))).cast("bigint"))
    placed = running(shown, ["conv_id", "participant"], "turn", sums={"end": F.col("size")}, tie=("speaker", "body"), chunk=CHUNK)
    start = F.col("end") - F.col("size")
    return placed.select("conv_id", "participant", "turn", "speaker", F.concat("head", "body", F.lit(END)).alias("segment"), start.alias("start"), "end",
                         F.when(F.col("own"), start + F.length("head")).otherwise(-1).cast("bigint").alias("learn_start"),
                         F.when(F.col("own"), F.col("end") - 1).otherwise(-1).cast("bigint").alias("learn_end"))


SQL = """
WITH said AS (
  SELECT conv_id, turn, coalesce(nullif(trim(role), ''), 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS participant FROM said WHERE speaker <> 'system'),
shown AS (
  SELECT s.*, participant, CASE WHEN speaker = 'system' THEN '<|system|>' || chr(10) WHEN speaker = participant THEN '<|assistant|>' || chr(10)
         ELSE '<|user|>' || replace(speaker, '<|', '< |') || chr(10) END AS head
  FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
sized AS (SELECT *, head || body || '<|end|>' || chr(10) AS segment FROM shown),
placed AS (
  SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, participant ORDER BY turn NULLS FIRST, speaker, body
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS "end" FROM sized)
SELECT conv_id, participant, turn, speaker, segment, "end" - length(segment) AS start, "end",
       CASE WHEN speaker = participant THEN "end" - length(segment) + length(head) ELSE -1 END AS learn_start,
       CASE WHEN speaker = participant THEN "end" - 1 ELSE -1 END AS learn_end
FROM placed
"""
