"""Trace log: pages, feeds, health by time window, payloads, sessions, as-of context."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.functions.scalars import json_number
from hearthline.operators import evaluation, loops, sketches, state, time
from hearthline.plans.registry import register
from hearthline.sources.tables import table


@register("events_after", "SELECT * FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100")
def events_after(spark, d):
    """The page of 100 after a given id."""
    return state.after(table(spark, d, "events"), "event_id", 500, 100)


@register("trace_feed", "SELECT event_id, ts, user_id, value FROM events WHERE event_type = 'error' AND value > 10 ORDER BY ts DESC, event_id LIMIT 50")
def trace_feed(spark, d):
    """Newest matching events."""
    e = table(spark, d, "events")
    rows = state.feed(e, (F.col("event_type") == "error") & (F.col("value") > 10), [F.col("ts").desc(), F.col("event_id")], 50)
    return rows.select("event_id", "ts", "user_id", "value")


@register(
    "user_counters",
    """SELECT user_id, count(*) AS n, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors,
    count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id HAVING count(*) > 5""",
)
def user_counters(spark, d):
    """Counters of each actor over a limit."""
    g = table(spark, d, "events").groupBy("user_id")
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_distinct("event_type").alias("kinds")).where("n > 5")


@register("loop_alarms", "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) > 2")
def loop_alarms(spark, d):
    """Actors with more errors than allowed."""
    return state.over_limit(table(spark, d, "events"), "user_id", F.col("event_type") == "error", 2)


@register(
    "event_loops",
    """WITH s AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    m AS (SELECT s.user_id, s.event_id, s.n, p FROM s JOIN range(1, 9) r(p) ON true JOIN s b ON b.user_id IS NOT DISTINCT FROM s.user_id AND b.n = s.n - p
        WHERE b.event_type IS NOT DISTINCT FROM s.event_type),
    g AS (SELECT *, n - row_number() OVER (PARTITION BY user_id, p ORDER BY n) AS g FROM m),
    r AS (SELECT user_id, p, min(n) - p AS first, max(n) AS last, count(*) AS m, max(event_id) FILTER (WHERE n = least_n + 2 * p - 1) AS alarm
        FROM (SELECT *, min(n) OVER (PARTITION BY user_id, p, g) AS least_n FROM g) GROUP BY user_id, p, g)
    SELECT user_id, p AS period, (m + p) // p AS repeats, first, m + p AS length, alarm FROM r WHERE m >= 2 * p
    AND NOT EXISTS (SELECT 1 FROM r q WHERE q.user_id IS NOT DISTINCT FROM r.user_id AND q.p < r.p AND r.p % q.p = 0 AND q.first <= r.first AND q.last >= r.last)""",
)
def event_loops(spark, d):
    """Actors that do a block of up to eight kinds three times or more in a row, with the event that completes the third."""
    out = loops.loops(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", 8, 3)
    return out.withColumn("alarm", F.col("alarm.event_id"))


@register(
    "tumbling_health",
    """SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n,
    count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY ALL""",
)
def tumbling_health(spark, d):
    """Counts and errors by hour and kind."""
    return time.windowed(table(spark, d, "events"), "1 hour", by=["event_type"]).drop("value")


@register(
    "sliding_health",
    """SELECT start, start + INTERVAL 2 HOUR AS "end", count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors,
    round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS error_ratio
    FROM (SELECT date_trunc('hour', ts) - to_hours(k) AS start, event_type FROM events, (VALUES (0), (1)) v(k)) GROUP BY start""",
)
def sliding_health(spark, d):
    """Error ratio in two-hour windows every hour."""
    w = time.windowed(table(spark, d, "events"), "2 hours", "1 hour").drop("value")
    return w.withColumn("error_ratio", F.round(F.col("errors") / F.col("n"), 6))


@register(
    "user_sessions",
    """WITH f AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def user_sessions(spark, d):
    return time.sessions(table(spark, d, "events"), "user_id", "30 minutes")


@register("payload_counts", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def payload_counts(spark, d):
    """M5: counts by an integer key of the JSON payload."""
    return table(spark, d, "events").groupBy(json_number(F.col("props"), "k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@register("payload_variant", "SELECT event_type, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS top, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def payload_variant(spark, d):
    """M5: the payload read as a variant."""
    k = F.expr("variant_get(parse_json(props), '$.k', 'bigint')")
    return table(spark, d, "events").groupBy("event_type").agg(F.max(k).alias("top"), F.sum(k).alias("total"))


@register("payload_parsed", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, false AS corrupt FROM events")
def payload_parsed(spark, d):
    """Schema-checked parse; what does not fit is flagged, not lost."""
    parsed = F.from_json("props", "k BIGINT, _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = table(spark, d, "events").select("event_id", parsed.alias("p"))
    return rows.select("event_id", "p.k", F.col("p._corrupt").isNotNull().alias("corrupt"))


@register(
    "value_stats",
    "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS low, max(value) AS high FROM events GROUP BY event_type",
)
def value_stats(spark, d):
    g = table(spark, d, "events").groupBy("event_type")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"))


@register("value_median", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type")
def value_median(spark, d):
    """Exact quantiles; no task holds the values of a group."""
    out = evaluation.quantiles(table(spark, d, "events"), "event_type", "value", {"median": 0.5, "p90": 0.9})
    return out.select("event_type", F.round("median", 6).alias("median"), F.round("p90", 6).alias("p90"))


@register(
    "prev_error_asof",
    """SELECT p.event_id, p.user_id, p.ts, max(e.event_id) AS last_event_id FROM events p JOIN events e
    ON e.user_id = p.user_id AND e.event_type = 'error' AND p.event_type = 'purchase' AND e.ts <= p.ts
    WHERE e.ts = (SELECT max(x.ts) FROM events x WHERE x.user_id = p.user_id AND x.event_type = 'error' AND x.ts <= p.ts)
    GROUP BY p.event_id, p.user_id, p.ts""",
)
def prev_error_asof(spark, d):
    """The last error of the same user at or before each purchase; of errors at one time, the greatest id."""
    e = table(spark, d, "events")
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    errors = e.where("event_type = 'error'").groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id"))
    return time.as_of(bought, errors, "user_id", "ts", "event_id").where("last_event_id IS NOT NULL")


@register(
    "maintenance_hits",
    """SELECT s.n_nationkey AS span, count(*) AS n FROM events e JOIN nation s
    ON e.event_id >= s.n_nationkey * 40 AND e.event_id < s.n_nationkey * 40 + 25 GROUP BY 1""",
)
def maintenance_hits(spark, d):
    """Range join: events whose id falls in a span, by buckets instead of a nested loop."""
    spans = table(spark, d, "nation").select(F.col("n_nationkey").alias("span"), (F.col("n_nationkey") * 40).cast("bigint").alias("lo"), (F.col("n_nationkey") * 40 + 25).cast("bigint").alias("hi"))
    hits = time.ranges_joined(table(spark, d, "events").select("event_id"), spans, "event_id", "lo", "hi", 64)
    return hits.groupBy("span").agg(F.count(F.lit(1)).alias("n"))


@register(
    "span_overlaps",
    """WITH s AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS lo, CAST(floor(epoch(ts)) AS BIGINT) + CASE event_id % 50 WHEN 0 THEN 400000 WHEN 1 THEN 0 ELSE 1 + event_id % 90 END AS hi, event_type FROM events),
    e AS (SELECT * FROM s WHERE event_type = 'error'), p AS (SELECT * FROM s WHERE event_type = 'purchase')
    SELECT e.event_id AS error_id, count(*) AS n, min(p.event_id) AS first FROM e JOIN p ON e.lo < p.hi AND p.lo < e.hi AND e.lo < e.hi AND p.lo < p.hi GROUP BY 1""",
)
def span_overlaps(spark, d):
    """Interval join of two span tables: purchases that were going on during each error, spans from none to days."""
    lo = F.date_trunc("second", "ts").cast("timestamp").cast("bigint")
    width = F.expr("CASE event_id % 50 WHEN 0 THEN 400000 WHEN 1 THEN 0 ELSE 1 + event_id % 90 END").cast("bigint")
    e = table(spark, d, "events").select("event_id", lo.alias("lo"), (lo + width).alias("hi"), "event_type")
    side = lambda kind, p: e.where(F.col("event_type") == kind).select(*[F.col(c).alias(p + c) for c in ("event_id", "lo", "hi")])
    met = time.overlap_counts(side("error", "e_"), side("purchase", "p_"), "e_lo", "e_hi", "p_lo", "p_hi", "p_event_id")
    return met.groupBy(F.col("e_event_id").alias("error_id")).agg(F.sum("n").alias("n"), F.min("first").alias("first"))


@register(
    "running_value",
    """SELECT event_id, count(*) OVER w AS seen, max(value) OVER w AS top, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
)
def running_value(spark, d):
    """Row frames: the last five events of each user."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    w = order.rowsBetween(-4, 0)
    return table(spark, d, "events").select("event_id", F.count(F.lit(1)).over(w).alias("seen"), F.max("value").over(w).alias("top"), F.lag("event_type").over(order).alias("before"))


@register(
    "recent_by_range",
    "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS in_hour FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events)",
)
def recent_by_range(spark, d):
    """Range frame: events of the same user within the hour before, to the second."""
    from pyspark.sql import Window

    sec = F.date_trunc("second", "ts").cast("timestamp").cast("bigint")
    w = Window.partitionBy("user_id").orderBy("sec").rangeBetween(-3600, 0)
    return table(spark, d, "events").withColumn("sec", sec).select("event_id", F.count(F.lit(1)).over(w).alias("in_hour"))


@register(
    "merged_sketches",
    """SELECT date_trunc('day', ts) AS span, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_within, true AS median_within, true AS p95_within FROM events GROUP BY 1""",
)
def merged_sketches(spark, d):
    """Sketches of hours merged by day, held against the exact counts and ranks of the same days."""
    events = table(spark, d, "events")
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("span")
    merged = sketches.merged(sketches.by_hour(events, "ts", "user_id", "value"), F.date_trunc("day", "hour").cast("timestamp_ntz"), {"median": 0.5, "p95": 0.95})
    both = events.select(day, "user_id", "value").join(merged.withColumnRenamed("n", "rows"), "span")
    users, value = F.count_distinct("user_id"), F.col("value")
    return both.groupBy("span").agg(
        F.first("rows").alias("n"), users.alias("users"), sketches.within(users, F.first("distinct")).alias("users_within"),
        sketches.rank_within(value, F.col("median"), 0.5).alias("median_within"), sketches.rank_within(value, F.col("p95"), 0.95).alias("p95_within"),
    )
