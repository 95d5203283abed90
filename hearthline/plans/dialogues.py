"""Dialogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.operators import dialogue
from hearthline.plans.registry import register
from hearthline.sources.tables import table


@register("turn_prev_role", "SELECT conv_id, turn, role, lag(role) OVER w AS prev_role, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def turn_prev_role(spark, d):
    return dialogue.with_previous(table(spark, d, "conversations"), "role").select("conv_id", "turn", "role", "prev_role", "next_role")


@register("role_transcript", "SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def role_transcript(spark, d):
    return dialogue.transcripts(table(spark, d, "conversations"), "role", ">")


@register("text_transcript", "SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def text_transcript(spark, d):
    return dialogue.transcripts(table(spark, d, "conversations"), "text", "\n").select("conv_id", F.md5("transcript").alias("digest"))


@register(
    "turn_counts",
    "SELECT conv_id, count(*) FILTER (WHERE role = 'assistant') AS assistant, count(*) FILTER (WHERE role = 'system') AS system, count(*) FILTER (WHERE role = 'user') AS user FROM conversations GROUP BY conv_id",
)
def turn_counts(spark, d):
    return dialogue.turn_counts(table(spark, d, "conversations"))


@register(
    "longest_replies",
    "SELECT conv_id, turn, n_chars FROM (SELECT conv_id, turn, length(text) AS n_chars, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS k FROM conversations WHERE role = 'assistant') WHERE k = 1",
)
def longest_replies(spark, d):
    rows = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.length("text").cast("bigint").alias("n_chars"))
    best = F.max_by(F.struct("turn", "n_chars"), F.struct("n_chars", -F.col("turn"))).alias("b")
    return rows.groupBy("conv_id").agg(best).select("conv_id", "b.turn", "b.n_chars")


@register("unanswered", "SELECT conv_id, turn FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE role = 'user' AND n IS DISTINCT FROM 'assistant'")
def unanswered(spark, d):
    rows = dialogue.with_previous(table(spark, d, "conversations"), "role")
    return rows.where("role = 'user' AND NOT (next_role <=> 'assistant')").select("conv_id", "turn")
