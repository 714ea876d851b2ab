"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once: that speaker's turns are the assistant's, all
other turns are a user's under the speaker's name, and the masks mark what the assistant says.

A conversation is rendered in blocks of `block_turns` turn numbers, so that no row grows without bound however long a
conversation is; block b holds the turns with floor(turn / block_turns) = b, in the order of turn, role and text. Every
participant of the conversation gets every block, so that its blocks together are the whole dialogue; where it does not
speak, all is context.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What stands around a turn; {name} is the speaker's."""

    assistant: tuple[str, str] = ("<|assistant|>\n", "<|end|>\n")
    user: tuple[str, str] = ("<|user name={name}|>\n", "<|end|>\n")
    unnamed: str = "unknown"
    block_turns: int = 256


def _around(parts: tuple[str, str], name: Column) -> tuple[Column, Column]:
    before, after = parts
    pieces = before.split("{name}")
    columns = [x for i, p in enumerate(pieces) for x in ([name] if i else []) + [F.lit(p)]]
    return F.concat(*columns), F.lit(after)


def perspectives(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, block, perspective, n_turns, text, mask_spans): mask_spans is array<struct<start int, end int>>, the
    character ranges of text to learn from: each of the speaker's texts with the closing mark, that is its turn's end.

    turns: conv_id, turn, role, text. A null role is the participant `unnamed`, a null text an empty one, a null turn comes
    first in block 0; a null conv_id is a conversation of its own. Repeated rows are turns said twice. Other columns
    are not read. Native DataFrame operations; turns are shuffled by conversation and block, blocks meet the conversation's
    participants."""
    name = F.coalesce(F.col("role").cast("string"), F.lit(template.unnamed))
    rows = turns.select(
        F.col("conv_id").alias("conv_id"),
        F.floor(F.coalesce(F.col("turn"), F.lit(0)) / template.block_turns).cast("long").alias("block"),
        F.struct(F.col("turn").alias("turn"), name.alias("name"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("said"),
    )
    blocks = rows.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("said")).alias("said"))
    who = rows.select(F.col("conv_id").alias("of"), F.col("said.name").alias("perspective")).distinct()
    each = blocks.join(who, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")

    def rendered(s: Column) -> Column:
        own = s["name"] == F.col("perspective")
        (a0, a1), (u0, u1) = _around(template.assistant, s["name"]), _around(template.user, s["name"])
        return F.struct(F.when(own, a0).otherwise(u0).alias("before"), F.concat(s["text"], F.when(own, a1).otherwise(u1)).alias("rest"), own.alias("own"))

    each = each.withColumn("parts", F.transform("said", rendered))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, part: Column) -> Column:
        begin = state["at"] + F.length(part["before"])
        end = begin + F.length(part["rest"])
        span = F.array(F.struct(begin.cast("int").alias("start"), end.cast("int").alias("end")))
        return F.struct(end.cast("int").alias("at"), F.when(part["own"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return each.select(
        "conv_id", "block", "perspective", F.size("parts").alias("n_turns"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["before"], p["rest"])), "").alias("text"),
        F.aggregate("parts", start, step, lambda s: s["spans"]).alias("mask_spans"),
    )


def perspective_digests(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """perspectives() with the spans as text `start-end,...`, so that rows compare plainly."""
    spans = F.array_join(F.transform("mask_spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return perspectives(turns, template).withColumn("mask_spans", spans)


#: The same rows from DuckDB, for the default template.
SQL = """
WITH said AS (
  SELECT conv_id, CAST(floor(coalesce(turn, 0) / 256) AS BIGINT) AS block, turn, coalesce(role, 'unknown') AS name, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id, CAST(floor(coalesce(turn, 0) / 256) AS BIGINT) ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS i
  FROM conversations
), who AS (
  SELECT DISTINCT conv_id, name AS perspective FROM said
), parts AS (
  SELECT s.conv_id, s.block, w.perspective, s.i, s.name = w.perspective AS own,
    CASE WHEN s.name = w.perspective THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || s.name || '|>' || chr(10) END AS before,
    s.text || '<|end|>' || chr(10) AS rest
  FROM said s JOIN who w ON s.conv_id IS NOT DISTINCT FROM w.conv_id
), placed AS (
  SELECT *, sum(length(before) + length(rest)) OVER (PARTITION BY conv_id, block, perspective ORDER BY i) AS till FROM parts
)
SELECT conv_id, block, perspective, CAST(count(*) AS INTEGER) AS n_turns, string_agg(before || rest, '' ORDER BY i) AS text,
  coalesce(string_agg(CAST(till - length(rest) AS BIGINT) || '-' || CAST(till AS BIGINT), ',' ORDER BY i) FILTER (WHERE own), '') AS mask_spans
FROM placed GROUP BY conv_id, block, perspective
"""
