"""Program-graph queries on a graph derived from the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.operators import graph, matching
from hearthline.plans.registry import register
from hearthline.sources.tables import table

#: The graph's edges in SQL: region > nation > customer, and customer > market segment.
EDGES = """e AS (
  SELECT DISTINCT 'r' || r_regionkey AS src, 'n' || n_nationkey AS dst FROM region JOIN nation ON n_regionkey = r_regionkey
  UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION SELECT 'c' || c_custkey, 'm' || c_mktsegment FROM customer)"""


def edges(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("c"), F.concat(F.lit("n"), "c_nationkey").alias("n"), F.concat(F.lit("m"), "c_mktsegment").alias("m"))
    n = table(spark, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("r"), F.concat(F.lit("n"), "n_nationkey").alias("n"))
    out = graph.edges_of(n, "r", "n", "HOLDS")
    return out.union(graph.edges_of(c, "n", "c", "CALLS")).union(graph.edges_of(c, "c", "m", "READS"))


@register("graph_edges", f"WITH {EDGES} SELECT src, dst FROM e")
def graph_edges(spark, d):
    return edges(spark, d).select("src", "dst")


@register("graph_nodes", f"WITH {EDGES} SELECT id, left(id, 1) AS label FROM (SELECT src AS id FROM e UNION SELECT dst FROM e)")
def graph_nodes(spark, d):
    e = edges(spark, d)
    return e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().withColumn("label", F.left("id", F.lit(1)))


@register("node_degrees", f"WITH {EDGES} SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY id")
def node_degrees(spark, d):
    return graph.degrees(edges(spark, d))


@register("two_hop_paths", f"WITH {EDGES} SELECT a.src, b.dst, count(*) AS paths FROM e a JOIN e b ON a.dst = b.src GROUP BY ALL")
def two_hop_paths(spark, d):
    return graph.two_hops(edges(spark, d)).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("paths"))


@register(
    "reachable_by_depth",
    f"WITH RECURSIVE {EDGES}, w AS (SELECT 'r1' AS id, 0 AS depth UNION SELECT e.dst, depth + 1 FROM w JOIN e ON e.src = w.id WHERE depth < 3) SELECT depth, count(*) AS n FROM (SELECT id, min(depth) AS depth FROM w GROUP BY id) GROUP BY depth",
)
def reachable_by_depth(spark, d):
    roots = spark.createDataFrame([("r1",)], "id string")
    return graph.reachable(edges(spark, d), roots, 3).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


@register(
    "recursive_depths",
    f"WITH RECURSIVE {EDGES}, w AS (SELECT 'r2' AS id, 0 AS depth UNION SELECT e.dst, depth + 1 FROM w JOIN e ON e.src = w.id WHERE depth < 3) SELECT depth, count(*) AS n FROM (SELECT id, min(depth) AS depth FROM w GROUP BY id) GROUP BY depth",
)
def recursive_depths(spark, d):
    """What a recursive query is for, by frontiers: recursion with UNION ALL would walk every path."""
    roots = spark.createDataFrame([("r2",)], "id string")
    return graph.reachable(edges(spark, d), roots, 3).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


@register("topological_depths", f"WITH RECURSIVE {EDGES}, w AS (SELECT DISTINCT src AS id, 0 AS depth FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT e.dst, depth + 1 FROM w JOIN e ON e.src = w.id) SELECT id, max(depth) AS depth FROM w GROUP BY id")
def topological_depths(spark, d):
    """Longest path to each node."""
    return graph.topological_depth(edges(spark, d))


#: Kinds of event that follow each other for a user, once cheap ones have been seen: a small graph with cycles.
FOLLOWS = """SELECT DISTINCT event_type AS src, nxt AS dst FROM (SELECT event_type, value, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM {events})
    WHERE nxt IS NOT NULL AND (event_type < nxt OR event_type IN ('error', 'view')) AND (event_type, nxt) NOT IN (('view', 'click'), ('view', 'purchase'), ('view', 'error'))"""


@register(
    "strong_parts",
    f"""WITH RECURSIVE e AS ({FOLLOWS.format(events="events")}), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e),
    w AS (SELECT id AS a, id AS b FROM v UNION SELECT w.a, e.dst FROM w JOIN e ON e.src = w.b) SELECT x.a AS id, min(x.b) AS component FROM w x JOIN w y ON x.a = y.b AND x.b = y.a GROUP BY x.a""",
)
def strong_parts(spark, d):
    """Strongly connected components."""
    return graph.strong_components(spark.sql(FOLLOWS, events=table(spark, d, "events")))


@register(
    "connected_parts",
    """WITH RECURSIVE e AS (SELECT DISTINCT 'o' || o_orderkey AS a, 'c' || o_custkey AS b FROM orders),
    u AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
    w AS (SELECT x AS id, x AS r FROM u UNION SELECT u.y, w.r FROM w JOIN u ON u.x = w.id) SELECT component, count(*) AS n FROM (SELECT id, min(r) AS component FROM w GROUP BY id) GROUP BY component""",
)
def connected_parts(spark, d):
    """Components of all orders and customers."""
    return order_parts(table(spark, d, "orders"))


def order_parts(orders):
    o = orders.select(F.concat(F.lit("o"), "o_orderkey").alias("a"), F.concat(F.lit("c"), "o_custkey").alias("b"))
    return graph.components(graph.edges_of(o, "a", "b", "CALLS")).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


@register("pinned_functions", "SELECT p_partkey, p_name FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size = 50)")
def pinned_functions(spark, d):
    """Rows whose name is among the known ones, those of the largest parts."""
    p = table(spark, d, "part")
    return graph.pinned(p, p.where("p_size = 50"), "p_brand").select("p_partkey", "p_name")


@register(
    "struct_layouts",
    "SELECT l_orderkey AS base, string_agg(DISTINCT l_linenumber || ':' || CAST(l_quantity AS BIGINT), ',' ORDER BY l_linenumber || ':' || CAST(l_quantity AS BIGINT)) AS fields FROM lineitem GROUP BY 1",
)
def struct_layouts(spark, d):
    """Set of (offset, width) of each base pointer."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("base"), F.col("l_linenumber").alias("at"), F.col("l_quantity").cast("bigint").alias("width"))
    text = F.array_sort(F.transform("fields", lambda f: F.concat_ws(":", f["at"], f["width"])))
    return graph.layouts(rows).select("base", F.array_join(text, ",").alias("fields"))


@register(
    "renamed_functions",
    """WITH o AS (SELECT 'a' AS build, o_orderkey, o_custkey, o_orderpriority FROM orders UNION ALL SELECT 'b', o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderstatus <> 'P'),
    k AS (SELECT build, o_custkey, string_agg(o_orderpriority, ',' ORDER BY o_orderpriority) AS k FROM o GROUP BY build, o_custkey),
    n AS (SELECT build, 'c' || o_custkey AS id, 'c' || k AS colour FROM k UNION ALL SELECT build, 'o' || o_orderkey, 'o' || o_orderpriority || ';' || k FROM o JOIN k USING (build, o_custkey)),
    s AS (SELECT colour, count(*) FILTER (WHERE build = 'a') AS n_a, count(*) FILTER (WHERE build = 'b') AS n_b, min('x' || id) FILTER (WHERE build = 'b') AS other FROM n GROUP BY colour)
    SELECT id, n_a, n_b, CASE WHEN n_a = 1 AND n_b = 1 THEN other END AS match FROM n JOIN s USING (colour) WHERE build = 'a'""",
)
def renamed_functions(spark, d):
    """D32 where names are gone: customers that call orders, of which only the priority is known, and a second build under other names without some of them."""
    orders = table(spark, d, "orders")

    def build(name, rows, prefix):
        ends = [F.concat(F.lit(prefix + p), F.col(c).cast("string")) for p, c in (("c", "o_custkey"), ("o", "o_orderkey"))]
        b = F.lit(name).alias("build")
        nodes = rows.select(b, ends[0].alias("id"), F.lit(None).cast("string").alias("label")).distinct().union(rows.select(b, ends[1], "o_orderpriority"))
        return nodes, rows.select(b, ends[0].alias("src"), ends[1].alias("dst"))

    a, b = build("a", orders, ""), build("b", orders.where("o_orderstatus <> 'P'"), "x")
    return matching.matched(matching.refined(a[0].union(b[0]), a[1].union(b[1])), "a", "b")
