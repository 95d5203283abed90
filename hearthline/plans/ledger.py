"""Ledger and queue state over the event log: latest rows, snapshots, status counts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hearthline.operators import state
from hearthline.operators.graph import checkpoints
from hearthline.plans.registry import register
from hearthline.sources import ledger
from hearthline.sources.tables import table


@register("latest_claims", "SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_claims(spark, d):
    """Last row of each key."""
    return state.latest(table(spark, d, "events"), ["user_id"], ["ts", "event_id"])


@register("open_tasks", "SELECT event_id, user_id, value FROM events WHERE event_type = 'signup' ORDER BY value DESC, event_id LIMIT 20")
def open_tasks(spark, d):
    """Filter, order, limit."""
    rows = state.feed(table(spark, d, "events"), F.col("event_type") == "signup", [F.col("value").desc(), F.col("event_id")], 20)
    return rows.select("event_id", "user_id", "value")


@register("status_counts", "SELECT event_type AS status, count(*) AS n FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) GROUP BY 1")
def status_counts(spark, d):
    """How many keys are in each state now."""
    return latest_claims(spark, d).groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "status_pivot",
    """SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error,
    count(*) FILTER (WHERE event_type = 'view') AS view FROM events WHERE event_type IN ('click', 'error', 'view') GROUP BY user_id""",
)
def status_pivot(spark, d):
    """One row a key, one column a status."""
    kinds = ["click", "error", "view"]
    return table(spark, d, "events").where(F.col("event_type").isin(kinds)).groupBy("user_id").pivot("event_type", kinds).agg(F.count(F.lit(1))).na.fill(0)


@register(
    "state_snapshot",
    """WITH c AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY user_id),
    l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
    SELECT l.user_id, l.event_id AS last_event, l.event_type AS status, l.ts AS since, c.n, c.errors, c.errors > 10 AS over_limit FROM l JOIN c ON l.user_id = c.user_id""",
)
def state_snapshot(spark, d):
    """State, counters and limits of every actor, in one aggregate."""
    last = F.max_by(F.struct("event_id", "event_type", "ts"), F.struct("ts", "event_id")).alias("last")
    g = table(spark, d, "events").groupBy("user_id").agg(last, F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return g.select("user_id", F.col("last.event_id").alias("last_event"), F.col("last.event_type").alias("status"), F.col("last.ts").alias("since"), "n", "errors", (F.col("errors") > 10).alias("over_limit"))


@register(
    "merged_ledgers",
    """SELECT user_id, event_id, value FROM (SELECT user_id, event_id, value FROM events WHERE event_type = 'click' UNION ALL
    SELECT user_id, event_id, value FROM events WHERE event_type = 'purchase') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""",
)
def merged_ledgers(spark, d):
    """Union of two ledgers by key, the newer row wins."""
    e = table(spark, d, "events").select("user_id", "event_id", "value", "event_type")
    return state.merged([e.where(f"event_type = '{k}'").drop("event_type") for k in ("click", "purchase")], ["user_id"], "event_id")


@register(
    "top_users",
    """SELECT event_type, user_id, n, rank FROM (SELECT event_type, user_id, n, CAST(rank() OVER (PARTITION BY event_type ORDER BY n DESC) AS BIGINT) AS rank
    FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL)) WHERE rank <= 3""",
)
def top_users(spark, d):
    n = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return state.ranked_within(n, ["event_type"], [F.col("n").desc()], 3)


@register(
    "dense_top_users",
    """SELECT event_type, n, rank FROM (SELECT event_type, n, dense_rank() OVER (PARTITION BY event_type ORDER BY n DESC) AS rank
    FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL)) WHERE rank <= 2""",
)
def dense_top_users(spark, d):
    n = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return state.ranked_within(n, ["event_type"], [F.col("n").desc()], 2, "dense_rank").select("event_type", "n", "rank")


@register("missing_claims", "SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def missing_claims(spark, d):
    """Wanted keys that have no row yet."""
    from hearthline.sources.tables import missing

    return missing(table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), table(spark, d, "events"), "user_id")


@register(
    "claims_as_of",
    """SELECT event_id, ts, user_id, event_type, value, props FROM events WHERE (day(ts) - 1) // 8 <= 2
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def claims_as_of(spark, d):
    """Events of a month upserted as four batches of eight days, two of them twice, compacted in between and read as of the third."""
    checkpoints(spark)
    path, key, order = f"{spark.sparkContext.getCheckpointDir()}/ledger-{uuid.uuid4().hex}", ["user_id"], ["ts", "event_id"]
    events = table(spark, d, "events")
    for batch in (0, 1, 1, 2, 3, 2):
        ledger.upsert(events.where((F.floor((F.dayofmonth("ts") - 1) / 8)) == batch), batch, path, key, order)
        if batch == 1:
            ledger.compact(spark, path, key, order)
    return ledger.as_of(spark, path, key, order, 2)
