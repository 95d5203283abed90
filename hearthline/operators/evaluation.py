"""Evaluation results: truth against prediction, runs of a rubric, configurations against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthline.functions.scalars import ratio


def recall(truth: DataFrame, prediction: DataFrame, key: list[str], attribute: str, by: list[str]) -> DataFrame:
    """Share of truth rows that a prediction matches; the denominator is all of truth."""
    p = prediction.select(*key, F.col(attribute).alias("_p")).dropDuplicates(key)
    return truth.join(p, key, "left").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), ratio(F.col(attribute) == F.col("_p")).alias("matched"))


def run_summary(results: DataFrame, by: list[str], score: str, pass_mark: float) -> DataFrame:
    """Mean, spread and pass rate over independent runs."""
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("sd"),
        F.min(score).alias("low"), F.max(score).alias("high"), ratio(F.col(score) >= pass_mark).alias("pass_rate"),
    )


def agreement(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """Both sides' values by key, also where one side has none, and whether they agree."""
    x, y = a.select(*key, F.col(value).alias("a")), b.select(*key, F.col(value).alias("b"))
    return x.join(y, key, "full").withColumn("agrees", F.col("a").eqNullSafe(F.col("b")))


def metrics(truth: DataFrame, prediction: DataFrame, key: list[str], attribute: str, by: list[str]) -> DataFrame:
    """Four metrics by group: coverage (truth that has a prediction), recall (truth that is matched), precision (predictions that match) and
    agreement (1 if truth and prediction hold the same rows). Predictions without truth count against precision and agreement."""
    t = truth.select(*key, *by, F.col(attribute).alias("_t"), F.lit(True).alias("_in"))
    p = prediction.select(*key, *by, F.col(attribute).alias("_p"), F.lit(True).alias("_guessed")).dropDuplicates(key)
    both = t.join(p, [*key, *by], "full")
    n, m, hit = F.count_if("_in"), F.count_if("_guessed"), F.count_if(F.col("_in") & F.col("_guessed") & (F.col("_t") == F.col("_p")))
    covered = F.count_if(F.col("_in") & F.col("_guessed"))
    return both.groupBy(*by).agg(
        n.alias("n"), F.try_divide(covered, n).alias("coverage"), F.try_divide(hit, n).alias("recall"), F.try_divide(hit, m).alias("precision"),
        F.when((hit == n) & (hit == m), 1).otherwise(0).alias("agreement"),
    )


def quantiles(df: DataFrame, group: str, value: str, shares: dict[str, float], buckets: int = 512) -> DataFrame:
    """Exact interpolated quantiles by group, without the values of a group in one task.

    Values are counted, and cut into `buckets` of about as many different values at approximate ranks, so that far outliers fill no bucket with all others; the counts
    are summed up by bucket, and only the values of the buckets that hold a wanted rank are put in order.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ends = counted.groupBy("g").agg(F.percentile_approx("v", [k / buckets for k in range(1, buckets)], 4 * buckets).alias("cuts"), F.sum("c").alias("n"))
    part = F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("v"))), F.lit(0))
    placed = counted.join(ends.select(F.col("g").alias("h"), "cuts"), F.col("g").eqNullSafe(F.col("h"))).select("g", "v", "c", part.alias("b"))
    sums = placed.groupBy("g", "b").agg(F.sum("c").alias("c"))
    sums = sums.withColumn("upto", F.sum("c").over(Window.partitionBy("g").orderBy("b")))
    at = lambda p: (F.col("n") - 1) * F.lit(p)
    ranks = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(i).alias("end"), (F.floor(at(p)) if i == 0 else F.ceil(at(p))).alias("rank"), (at(p) - F.floor(at(p))).alias("share")) for k, p in shares.items() for i in (0, 1)])
    wanted = ends.select(F.col("g").alias("h"), F.inline(ranks))
    hits = sums.join(wanted, F.col("g").eqNullSafe(F.col("h")) & (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
    hits = hits.select("h", F.col("b").alias("hb"), "name", "end", "share", (F.col("rank") - F.col("upto") + F.col("c")).alias("k"))
    some = placed.join(hits, F.col("g").eqNullSafe(F.col("h")) & (F.col("b") == F.col("hb")))
    upto = F.sum("c").over(Window.partitionBy("g", "b", "name", "end").orderBy("v"))
    found = some.withColumn("upto", upto).where("k < upto AND k >= upto - c")
    low, high = (F.max(F.when(F.col("end") == i, F.col("v"))) for i in (0, 1))
    each = found.groupBy("g", "name").agg((low + (high - low) * F.first("share")).alias("q"))
    return each.groupBy(F.col("g").alias(group)).pivot("name", list(shares)).agg(F.first("q"))
