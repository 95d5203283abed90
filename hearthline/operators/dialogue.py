"""Multi-turn dialogues: previous turns, transcripts, turn statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_previous(turns: DataFrame, column: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return turns.withColumn(f"prev_{column}", F.lag(column).over(w)).withColumn(f"next_{column}", F.lead(column).over(w))


def transcripts(turns: DataFrame, column: str, separator: str) -> DataFrame:
    """One string a dialogue, in turn order; the order is made inside the group, not hoped for."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", column)))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda t: t[column]), separator).alias("transcript"))


def turn_counts(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").pivot("role", ["assistant", "system", "user"]).agg(F.count(F.lit(1))).na.fill(0)
