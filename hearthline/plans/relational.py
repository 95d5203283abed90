"""Generic relational categories on the star schema: joins, grouping sets, set operations, frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.plans.registry import register
from hearthline.sources.tables import table


def same_sql(name: str, sql: str, *tables: str):
    """One text for both engines; {table} stands for a table."""

    def run(spark, d):
        return spark.sql(sql, **{t: table(spark, d, t) for t in tables})

    run.__name__ = name
    register(name, sql.format(**{t: t for t in tables}))(run)


same_sql(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_base,
    round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "lineitem",
)
same_sql(
    "segment_revenue",
    """SELECT n_name, c_mktsegment, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
    JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name, c_mktsegment""",
    "lineitem", "orders", "customer", "nation", "region",
)
same_sql("type_cube", "SELECT event_type, user_id % 3 AS shard, count(*) AS n FROM {events} GROUP BY CUBE(event_type, user_id % 3)", "events")
same_sql("status_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ROLLUP(o_orderstatus, o_orderpriority)", "orders")
same_sql("grouping_sets", "SELECT p_brand, p_size, count(*) AS n FROM {part} GROUP BY GROUPING SETS ((p_brand), (p_size), ())", "part")
same_sql("left_join_counts", "SELECT c_custkey, count(o_orderkey) AS n FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey", "customer", "orders")
same_sql("right_join_counts", "SELECT n_name, count(s_suppkey) AS n FROM {supplier} RIGHT JOIN {nation} ON s_nationkey = n_nationkey GROUP BY n_name", "supplier", "nation")
same_sql("theta_join", "SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM {nation} a JOIN {region} b ON a.n_regionkey > b.r_regionkey", "nation", "region")
same_sql("users_without_purchase", "SELECT user_id FROM {events} WHERE event_type = 'error' EXCEPT SELECT user_id FROM {events} WHERE event_type = 'purchase' AND value > 80", "events")
same_sql("users_of_both", "SELECT user_id FROM {events} WHERE event_type = 'error' INTERSECT SELECT user_id FROM {events} WHERE event_type = 'signup'", "events")
same_sql("except_all", "SELECT user_id FROM {events} WHERE event_type = 'view' EXCEPT ALL SELECT user_id FROM {events} WHERE event_type = 'click'", "events")
same_sql("union_distinct", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}", "customer", "supplier")
same_sql("union_all_counts", "SELECT side, count(*) AS n FROM (SELECT 'c' AS side FROM {customer} UNION ALL SELECT 's' FROM {supplier}) GROUP BY side", "customer", "supplier")
same_sql("scalar_subquery", "SELECT s_suppkey FROM {supplier} WHERE s_acctbal > (SELECT avg(s_acctbal) FROM {supplier})", "supplier")
same_sql("correlated_exists", "SELECT o_orderpriority, count(*) AS n FROM {orders} o WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45) GROUP BY o_orderpriority", "orders", "lineitem")
same_sql("ntile_parts", "SELECT p_partkey, CAST(ntile(4) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS INT) AS quarter FROM {part}", "part")
same_sql("first_last_orders", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS first, last_value(o_orderkey) OVER w AS last FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", "orders")
same_sql("case_buckets", "SELECT CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 150000 THEN 'mid' ELSE 'high' END AS bucket, count(*) AS n FROM {orders} GROUP BY 1", "orders")
same_sql("string_functions", "SELECT p_partkey, upper(p_brand) AS u, lower(p_type) AS l, substring(p_name, 1, 4) AS s, replace(p_name, ' ', '_') AS r, trim(p_type) AS t FROM {part}", "part")
same_sql("top_parts", "SELECT p_partkey, p_retailprice FROM {part} ORDER BY p_retailprice DESC, p_partkey LIMIT 25", "part")
same_sql("distinct_pairs", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM {lineitem}", "lineitem")


@register("monthly_orders", "SELECT date_trunc('month', o_orderdate) AS month, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL")
def monthly_orders(spark, d):
    o = table(spark, d, "orders")
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")
    return o.groupBy(month, F.year("o_orderdate").cast("bigint").alias("y")).agg(F.count(F.lit(1)).alias("n"))


@register("order_status_pivot", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_orderpriority")
def order_status_pivot(spark, d):
    out = table(spark, d, "orders").where("o_orderstatus IN ('F', 'O')").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O"]).agg(F.count(F.lit(1))).na.fill(0)
    return out.withColumnsRenamed({"F": "f", "O": "o"})


@register("approximate_counts")
def approximate_counts(spark, d):
    """Sketches: approximate distinct counts and quantiles; no oracle, as engines differ."""
    return table(spark, d, "lineitem").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.percentile_approx("l_extendedprice", 0.5, 1000).alias("median"))
