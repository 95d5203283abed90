"""Class hierarchies and the edges of dataflow that objects make: virtual calls and lifetimes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.operators.corpus import EDGE_KINDS
from hearthline.operators.graph import checkpoints


def closure(inherits: DataFrame) -> DataFrame:
    """(class, ancestor, depth) from (class, base): every ancestor at its least distance, and each class itself at 0.

    Paths double in length each round, so rounds follow the logarithm of the depth; each round ends in a checkpoint, and a cycle only ends the search.
    """
    checkpoints(inherits.sparkSession)
    inherits = inherits.select("class", "base").distinct().checkpoint()
    direct = inherits.where("base IS NOT NULL AND class <> base").select("class", F.col("base").alias("ancestor")).distinct()
    known = direct.withColumn("depth", F.lit(1)).checkpoint()
    size = known.count()
    while True:
        further = known.alias("a").join(known.alias("b").hint("merge"), F.col("a.ancestor") == F.col("b.class")).where("a.class <> b.ancestor")
        further = further.select("a.class", "b.ancestor", (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        grown = known.union(further).groupBy("class", "ancestor").agg(F.min("depth").alias("depth")).checkpoint()
        now = grown.count()
        if now == size:
            break
        known, size = grown, now
    own = inherits.select("class").union(inherits.where("base IS NOT NULL").select("base")).distinct()
    return known.union(own.select("class", F.col("class").alias("ancestor"), F.lit(0).alias("depth")))


def dispatched(receivers: DataFrame, inherits: DataFrame, methods: DataFrame) -> DataFrame:
    """receivers (class, method, *) with what a virtual call may reach: target (the class that defines it) and dst (its file).

    methods: (class, method, path). A call reaches the definitions in the receiver's class and in those derived from it; a class without a definition of its own
    has its nearest ancestor's.
    """
    lines = closure(inherits)
    concrete = lines.select("class", F.col("ancestor").alias("receiver"))  # classes that an object of the receiver's static class may have
    defined = methods.select(F.col("class").alias("target"), "method", F.col("path").alias("dst")).distinct()
    binds = lines.join(defined.select("target", "method").distinct().hint("merge"), F.col("ancestor") == F.col("target"))
    nearest = binds.groupBy("class", "method").agg(F.min("depth").alias("depth"))
    bound = binds.join(nearest.hint("merge"), ["class", "method", "depth"]).select("class", "method", "target").distinct()
    reach = concrete.join(bound.hint("merge"), "class").select("receiver", "method", "target").distinct()
    calls = receivers.withColumnRenamed("class", "receiver")
    return calls.join(reach.hint("merge"), ["receiver", "method"]).join(defined.hint("merge"), ["target", "method"]).withColumnRenamed("receiver", "class")


def case_of(path) -> F.Column:
    """Folder and name of a test case with its flow code: what its files share."""
    return F.regexp_extract(path, r"^(.*/CWE\d+_.+?__.+_\d\d)[a-e]?(?:_(?:bad|goodG2B|goodB2G|good1))?\.\w+$", 1)


def object_edges(recorded: DataFrame, facts: DataFrame) -> DataFrame:
    """(src, dst, type, via, src_missing) of flows whose data moves in objects.

    The part that calls (a) is not in the corpus: it stands as a missing node, the case's name with an `a`. Virtual flows go from it through the header's root
    class to all overriders; where the hierarchy is not there, to the methods that the case's own classes define. Lifetime flows go to the constructor, and from
    there to the destructor, which is in the same file.
    """
    kind = F.create_map(*[F.lit(x) for kv in EDGE_KINDS.items() for x in kv])
    flows = recorded.where(F.col("flow").isin("81", "82", "83", "84")).select("path", kind[F.col("flow")].alias("type"), case_of(F.col("path")).alias("case"))
    missing = F.concat("case", F.lit("a"))
    checkpoints(facts.sparkSession)
    # read once by all that follows; sizes are known of files only, not of what their texts hold, so no side is broadcast by them
    inside = facts.where("kind IN ('class', 'function')").select("path", "kind", "name", "scope", "base").join(flows.hint("merge"), "path").checkpoint()
    classes = inside.where("kind = 'class'").select("case", "type", F.col("name").alias("class"), "base").distinct()
    last = F.element_at(F.split("scope", "::"), -1)
    methods = inside.where("kind = 'function' AND scope IS NOT NULL").select("path", "case", "type", last.alias("class"), F.col("name").alias("method"))
    virtual = methods.where("type = 'virtual' AND NOT startswith(method, '~') AND method <> class")
    roots = classes.where("type = 'virtual' AND base IS NULL").select("case", "class").distinct()
    sites = roots.join(virtual.select("case", "method").distinct().hint("merge"), "case")
    by_class = dispatched(sites, classes.where("type = 'virtual'").select("class", "base"), virtual.select("class", "method", "path"))
    alone = virtual.join(classes.select("case").distinct().hint("merge"), "case", "left_anti")
    named = lambda c, m: F.concat_ws("::", c, m)
    edges = by_class.select(missing.alias("src"), "dst", F.lit("virtual").alias("type"), named("class", "method").alias("via"), F.lit(True).alias("src_missing"))
    edges = edges.union(alone.select(missing, "path", F.lit("virtual"), named("class", "method"), F.lit(True)))
    life = methods.where("type = 'lifetime'")
    made = life.where("method = class")
    edges = edges.union(made.select(missing, "path", F.lit("lifetime"), named("class", "method"), F.lit(True)))
    ended = life.where("startswith(method, '~')").select("case", "class", F.col("path").alias("dst"), F.col("method").alias("end"))
    edges = edges.union(made.join(ended.hint("merge"), ["case", "class"]).select(F.col("path"), "dst", F.lit("lifetime"), named("class", "end"), F.lit(False)))
    return edges.distinct()
