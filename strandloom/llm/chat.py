"""Chat formatting by perspective rotation: each participant in turn is the assistant, all others are named users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def _message(m: Column, speaker: Column) -> Column:
    head = F.when(m["role"] == "system", F.lit("system")).when(m["role"] == speaker, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), m["role"]))
    return F.concat(F.lit(START), head, F.lit("\n"), m["text"], F.lit(END))


def rotations(conversations: DataFrame, block_turns: int = 256) -> DataFrame:
    """For every dialogue and each of its participants, the dialogue with that speaker as assistant.

    conversations: conv_id, turn, role, text. Participants are the distinct roles but system, which stays
    system for all. Messages are ordered by turn, role, text; repeated rows are repeated messages; a null role
    counts as "unknown", a null text as empty, null turns come first, and all rows with a null conv_id are one
    dialogue. A dialogue with system messages only has no participant and gives no row; so does an empty table.
    Other columns are ignored.

    A dialogue is rendered in blocks of block_turns turn numbers (block 0, 1, ...; null turns: -1), so that no row has to
    hold a dialogue of any length; the blocks joined in order are the whole dialogue.

    Returns conv_id, participant, block, n_turns, n_trained (messages), text, mask (one character per message, 1: the
    participant's own, trained on), spans (start and stop of each trained text within text, in characters).
    """
    turn = F.col("turn").cast("long")
    said = conversations.select(
        "conv_id",
        F.coalesce(F.floor(turn / block_turns), F.lit(-1)).cast("long").alias("block"),
        F.struct(turn.alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("m"),
    )
    speakers = said.filter(F.col("m.role") != "system").select(F.col("conv_id").alias("_id"), F.col("m.role").alias("participant")).distinct()
    blocks = said.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    both = blocks.join(speakers, F.col("conv_id").eqNullSafe(F.col("_id")))
    who = F.col("participant")
    parts = F.transform("ms", lambda m: F.struct(_message(m, who).alias("out"), (m["role"] == who).alias("own"), F.length(m["text"]).alias("n")))
    both = both.select("conv_id", "participant", "block", parts.alias("parts"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))
    skip, end = len(START) + len("assistant\n"), len(END)

    def add(s: Column, p: Column) -> Column:
        span = F.struct((s["at"] + skip).alias("start"), (s["at"] + skip + p["n"]).alias("stop"))
        return F.struct((s["at"] + F.length(p["out"])).alias("at"), F.when(p["own"], F.array_append(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return both.select(
        "conv_id",
        "participant",
        "block",
        F.size("parts").cast("long").alias("n_turns"),
        F.size(F.filter("parts", lambda p: p["own"])).cast("long").alias("n_trained"),
        F.array_join(F.transform("parts", lambda p: p["out"]), "").alias("text"),
        F.array_join(F.transform("parts", lambda p: F.when(p["own"], F.lit("1")).otherwise(F.lit("0"))), "").alias("mask"),
        F.aggregate("parts", start, add, lambda s: s["spans"]).alias("spans"),
    )


#: DuckDB SQL of rotations(), without spans, in blocks of 256.
ROTATIONS_SQL = f"""
WITH said AS (
  SELECT conv_id, coalesce(CAST(floor(turn / 256) AS BIGINT), -1) AS block, CAST(turn AS BIGINT) AS turn,
         coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
speakers AS (SELECT DISTINCT conv_id AS id, role AS participant FROM said WHERE role <> 'system')
SELECT conv_id, participant, block, count(*) AS n_turns, count(*) FILTER (WHERE role = participant) AS n_trained,
       string_agg('{START}' || CASE WHEN role = 'system' THEN 'system' WHEN role = participant THEN 'assistant'
                  ELSE 'user name=' || role END || chr(10) || text || '{END.strip()}' || chr(10), ''
                  ORDER BY turn NULLS FIRST, role, text) AS text,
       string_agg(CASE WHEN role = participant THEN '1' ELSE '0' END, '' ORDER BY turn NULLS FIRST, role, text) AS mask
FROM said JOIN speakers ON conv_id IS NOT DISTINCT FROM id GROUP BY conv_id, participant, block
"""
