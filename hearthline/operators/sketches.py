"""Sketches stored by hour and merged over any span of hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds that hold for merged sketches of the default sizes: share of the distinct count (three standard errors), and of ranks.
DISTINCT_ERROR, RANK_ERROR = 0.05, 0.03


def by_hour(events: DataFrame, ts: str, key: str, value: str, by: list[str] | None = None) -> DataFrame:
    """One row an hour (and group): hour, n, keys (a distinct-count sketch) and ranks (a quantile sketch), both of bounded size whatever the rows.

    Null keys and values, and values that are not numbers, are left out of the sketches; n counts all rows. Rows without a time are an hour of their own, null.
    """
    number = F.when(~F.isnan(value), F.col(value).cast("double"))
    return events.groupBy(F.date_trunc("hour", ts).alias("hour"), *(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(key, F.lit(12)).alias("keys"), F.kll_sketch_agg_double(number).alias("ranks"),
    )


def merged(stored: DataFrame, span: Column, quantiles: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Sketches of hours merged by span (a column of hour): n, distinct, and each named quantile, from rows of sketches alone."""
    g = stored.groupBy(span.alias("span"), *(by or [])).agg(F.sum("n").alias("n"), F.hll_union_agg("keys").alias("keys"), F.kll_merge_agg_double("ranks").alias("ranks"))
    many = F.kll_sketch_get_n_double("ranks") > 0
    at = [F.when(many, F.kll_sketch_get_quantile_double("ranks", F.lit(q))).alias(name) for name, q in quantiles.items()]
    return g.select("span", *(by or []), "n", F.hll_sketch_estimate("keys").alias("distinct"), *at)


def within(exact: Column, estimate: Column) -> Column:
    """Whether a distinct count is within its bound of the exact one."""
    return F.abs(exact - estimate) <= DISTINCT_ERROR * exact


def rank_within(value: Column, estimate: Column, q: float) -> Column:
    """Aggregate: whether an estimated quantile's rank among the values is within its bound."""
    n = F.count(value)
    return (F.count_if(value < estimate) <= (q + RANK_ERROR) * n) & (F.count_if(value <= estimate) >= (q - RANK_ERROR) * n)
