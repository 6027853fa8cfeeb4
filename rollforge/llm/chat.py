"""Dialogues from every participant's side.

For each participant of a conversation the whole dialogue is rendered with that speaker as the assistant and all others
as named users; system turns stay system turns and their speaker is no participant. The loss mask covers what the
assistant says, with its closing tag.

A rendering comes in parts of CHUNK turns (the last one may be shorter), so no conversation has to fit a task: part 0, 1,
... in order make up the text, and spans are character offsets in the whole text. Turns are numbered by range, and the
offsets of parts are summed over their lengths alone. Null text is empty. A null role is rendered as a user named "unknown", is no
participant and is never masked, even where a participant has that name. A null turn comes first. Repeated rows are rendered each; equal turns are ordered by role and the text's
digest. Texts and names are rendered as they are: tags of the format inside of them are not escaped, and spans tell what was
said. Conversations without participants and empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollforge.llm.shared import written
from rollforge.operators.ordinals import numbered

CHUNK = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _head(speaker: Column, told: Column, perspective: Column, system: str) -> Column:
    return F.concat(F.lit(OPEN), F.when(speaker == system, F.lit(system)).when(told & (speaker == perspective), F.lit("assistant")).otherwise(F.concat(F.lit("user name="), speaker)), F.lit("\n"))


def perspectives(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", system: str = "system") -> DataFrame:
    """conv_id, perspective, part, n_turns, text, spans ("from-to" of each masked stretch, joined by commas)."""
    said = F.coalesce(F.col(text_col), F.lit(""))
    turns = conversations.select(F.col(conv_col).alias("conv_id"), F.coalesce(F.col(turn_col).cast("long"), F.lit(-1)).alias("turn"), F.coalesce(F.col(speaker_col), F.lit("unknown")).alias("speaker"), F.col(speaker_col).isNotNull().alias("told"), said.alias("said"), F.md5(said).alias("mark"))
    turns = written(numbered(turns, ["conv_id"], ["turn", "speaker", "told", "mark"]).select("conv_id", "speaker", "told", "said", "place", F.floor(F.col("place") / CHUNK).alias("part")), "turns")
    speakers = conversations.select(F.col(conv_col).alias("own_id"), F.col(speaker_col).alias("perspective")).where(F.col("perspective").isNotNull() & (F.col("perspective") != system)).distinct()
    seen_by = lambda df: df.hint("merge").join(speakers.hint("merge"), F.col("conv_id").eqNullSafe(F.col("own_id")))
    head = _head(F.col("speaker"), F.col("told"), F.col("perspective"), system)
    # where each part begins: a running sum over lengths, one row for each part
    sizes = seen_by(turns.select("conv_id", "speaker", "told", "part", F.length("said").alias("chars"))).groupBy("conv_id", "perspective", "part").agg(F.sum(F.length(head) + F.col("chars") + len(CLOSE) + 1).alias("chars"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select(F.col("conv_id").alias("at_id"), F.col("perspective").alias("at_perspective"), F.col("part").alias("at_part"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("starts"))
    seen = seen_by(turns).select("conv_id", "perspective", "part", "place", head.alias("head"), F.concat("said", F.lit(CLOSE)).alias("body"), (F.col("told") & (F.col("speaker") == F.col("perspective")) & (F.col("speaker") != system)).alias("masked"))
    parts = seen.groupBy("conv_id", "perspective", "part").agg(F.array_sort(F.collect_list(F.struct("place", "head", "body", "masked"))).alias("turns"))
    parts = parts.withColumn("text", F.array_join(F.transform("turns", lambda t: F.concat(t.head, t.body, F.lit("\n"))), ""))
    parts = parts.hint("merge").join(begins.hint("merge"), F.col("conv_id").eqNullSafe(F.col("at_id")) & (F.col("perspective") == F.col("at_perspective")) & (F.col("part") == F.col("at_part")))
    begun = F.struct(F.col("starts").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        said = state.at + F.length(turn.head)
        ends = said + F.length(turn.body)
        return F.struct((ends + 1).alias("at"), F.when(turn.masked, F.concat(state.spans, F.array(F.concat(said.cast("string"), F.lit("-"), ends.cast("string"))))).otherwise(state.spans).alias("spans"))

    return parts.select("conv_id", "perspective", F.col("part").cast("long").alias("part"), F.size("turns").cast("long").alias("n_turns"), "text", F.array_join(F.aggregate("turns", begun, step).spans, ",").alias("spans"))


ORACLE = """
    WITH t AS (SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS speaker, role IS NOT NULL AS told, coalesce(text, '') AS said FROM conversations),
    n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, speaker, told, md5(said)) - 1 AS place FROM t),
    s AS (SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role IS NOT NULL AND role <> 'system'),
    j AS (SELECT n.conv_id, perspective, place // 256 AS part, place, '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN told AND speaker = perspective THEN 'assistant' ELSE 'user name=' || speaker END || chr(10) AS head,
                 said || '<|im_end|>' AS body, told AND speaker = perspective AS masked
          FROM n JOIN s ON n.conv_id IS NOT DISTINCT FROM s.conv_id),
    o AS (SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective ORDER BY place) - 1 AS ends FROM j)
    SELECT conv_id, perspective, part, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY place) AS text,
           coalesce(string_agg(CASE WHEN masked THEN (ends - length(body))::BIGINT::VARCHAR || '-' || ends::BIGINT::VARCHAR END, ',' ORDER BY place), '') AS spans
    FROM o GROUP BY ALL"""
