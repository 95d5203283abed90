"""Time windows, sessions and as-of joins over event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthline.operators.graph import checkpoints


def windowed(events: DataFrame, length: str, slide: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Counts and error ratio by time window; the same plan serves a stream."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = events.groupBy(w.alias("w"), *(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.sum("value").alias("value")
    )
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(by or []), "n", "errors", "value")


def sessions(events: DataFrame, key: str, gap: str) -> DataFrame:
    out = events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), "n")


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """left with right's last `value` at or before its time, by key; null if there is none.

    A scan in two levels, linear in the input: both sides are dealt into slices of (key, time) by range, so that a key with all rows lies in all slices; a running window
    works inside a slice, and each slice's last state of a key is carried on to the key's later slices. The carried states are a row for each key and slice.
    """
    columns, kind = left.columns, right.schema[value].dataType
    both = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(kind)}).unionByName(
        right.select(key, ts, F.col(value).alias("_v")).withColumn("_side", F.lit(0)), allowMissingColumns=True
    )
    checkpoints(left.sparkSession)
    # equal (key, time) go to one slice; written, so that a slice's number holds when a task runs again
    sliced = both.repartitionByRange(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), key, ts).withColumn("_slice", F.spark_partition_id()).checkpoint()
    inside = Window.partitionBy("_slice", key).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = sliced.withColumn("_near", F.last("_v", ignorenulls=True).over(inside)).where("_side = 1")
    state = sliced.groupBy("_slice", key).agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(ts, "_side"))).alias("_state"))
    earlier = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = state.select(F.col("_slice").alias("_s"), F.col(key).alias("_k"), F.last("_state", ignorenulls=True).over(earlier).alias("_before")).where("_before IS NOT NULL")
    out = near.join(carried, (F.col("_slice") == F.col("_s")) & F.col(key).eqNullSafe(F.col("_k")), "left")
    return out.select(*columns, F.coalesce("_near", "_before").alias(f"last_{value}"))


def ranges_joined(points: DataFrame, spans: DataFrame, at: str, lo: str, hi: str, width: int) -> DataFrame:
    """Points in [lo, hi) of spans, by an equi-join on buckets of `width`; a span is repeated once a bucket."""
    p = points.withColumn("_b", F.floor(F.col(at) / width))
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))))
    return p.join(s, "_b").where((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("_b")


#: Levels of the dyadic tree over 64-bit numbers.
LEVELS = 62


def dyadic(spans: DataFrame, lo: str, hi: str) -> DataFrame:
    """spans, a row for each block of [lo, hi): _level and _block of the few aligned blocks of 2^level numbers that make it up.

    There are at most two a level, so a span costs the logarithm of its length, not its length. Spans without a number in them give no row.
    """
    # whole numbers only: division by powers of two through shifts keeps 64 bits exact
    pair = F.expr(
        f"""flatten(transform(sequence(0, {LEVELS}), k -> filter(array(
            IF(-shiftright(-{lo}, k) < shiftright({hi}, k) AND (-shiftright(-{lo}, k) & 1) = 1, named_struct('level', k, 'block', -shiftright(-{lo}, k)), NULL),
            IF(-shiftright(-{lo}, k) < shiftright({hi}, k) AND (shiftright({hi}, k) & 1) = 1, named_struct('level', k, 'block', shiftright({hi}, k) - 1), NULL)), b -> b IS NOT NULL)))"""
    )
    out = spans.withColumn("_b", F.explode(pair))
    return out.select(*spans.columns, F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block"))


def points_in(points: DataFrame, spans: DataFrame, at: str, lo: str, hi: str) -> DataFrame:
    """points joined with the spans [lo, hi) that hold them, once each: blocks of a span are disjoint, so a point meets it in one block at most.

    A point goes to the one block of each level that holds it, of the levels that spans use. No width is chosen, so spans from one number to all may be mixed.
    """
    cut = dyadic(spans, lo, hi)
    used = cut.select("_level").distinct()  # 63 rows at most
    placed = points.where(F.col(at).isNotNull()).crossJoin(F.broadcast(used)).withColumn("_block", F.expr(f"shiftright(`{at}`, _level)"))
    return placed.join(cut, ["_level", "_block"]).drop("_level", "_block")


def overlaps(a: DataFrame, b: DataFrame, a_lo: str, a_hi: str, b_lo: str, b_hi: str) -> DataFrame:
    """Pairs of spans of two tables that share a number, once each. Columns are whole numbers under names of their own.

    Two spans overlap if the later start lies in the other: starts of b in spans of a, and starts of a inside spans of b but not at their start.
    """
    a, b = (x.where(F.col(lo) < F.col(hi)) for x, lo, hi in ((a, a_lo, a_hi), (b, b_lo, b_hi)))
    columns = [*a.columns, *b.columns]
    inner = b.withColumn("_after", F.col(b_lo) + 1)
    one = points_in(b, a, b_lo, a_lo, a_hi).select(columns)
    return one.union(points_in(a, inner, a_lo, "_after", b_hi).select(columns))


def overlap_counts(a: DataFrame, b: DataFrame, a_lo: str, a_hi: str, b_lo: str, b_hi: str, value: str) -> DataFrame:
    """a's spans that share a number with spans of b, with n (how many) and first (their least `value`): what `overlaps` would give, summed up by a's row, without its pairs.

    b is summed up by block before it meets a, and equal spans of a are looked up once, so the work follows the spans, however many overlap.
    """
    a, b = (x.where(F.col(lo) < F.col(hi)) for x, lo, hi in ((a, a_lo, a_hi), (b, b_lo, b_hi)))
    block, tally = ["_level", "_block"], [F.sum("n").alias("n"), F.min("first").alias("first")]
    spans = a.select(F.col(a_lo).alias("_lo"), F.col(a_hi).alias("_hi")).distinct()
    others = b.groupBy(F.col(b_lo).alias("_from"), (F.col(b_lo) + 1).alias("_after"), F.col(b_hi).alias("_until")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("first"))

    def placed(points, at, cut):
        return points.crossJoin(F.broadcast(cut.select("_level").distinct())).withColumn("_block", F.expr(f"shiftright({at}, _level)"))  # 63 levels at most

    cut = dyadic(spans, "_lo", "_hi")
    starts = placed(others.groupBy("_from").agg(*tally), "_from", cut).groupBy(block).agg(*tally)
    one = cut.join(starts, block).select("_lo", "_hi", "n", "first")
    inner = dyadic(others, "_after", "_until").groupBy(block).agg(*tally)
    begun = placed(spans.select("_lo").distinct(), "_lo", inner).join(inner, block).groupBy("_lo").agg(*tally)
    found = one.unionByName(spans.join(begun, "_lo")).groupBy("_lo", "_hi").agg(*tally)
    return a.join(found, (F.col(a_lo) == F.col("_lo")) & (F.col(a_hi) == F.col("_hi"))).drop("_lo", "_hi")
