"""Evaluation over labels, documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.functions.scalars import ratio
from hearthline.operators import evaluation
from hearthline.plans.registry import register
from hearthline.sources.tables import table


@register(
    "label_profile",
    "SELECT quality, toxic, lang, count(*) AS n, round(avg(length(text)), 4) AS mean_chars FROM labels JOIN documents USING (doc_id) GROUP BY ALL",
)
def label_profile(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return rows.groupBy("quality", "toxic", "lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"))


@register("unlabelled_docs", "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unlabelled_docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left_anti")


@register("labelled_docs", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def labelled_docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi")


@register(
    "truth_recall",
    """SELECT d.lang, count(*) AS n, round(avg(CASE WHEN l.quality = p.quality THEN 1.0 ELSE 0.0 END), 6) AS matched
    FROM labels l JOIN documents d USING (doc_id) LEFT JOIN (SELECT doc_id, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS quality FROM documents WHERE n_chars >= 500) p ON p.doc_id = l.doc_id GROUP BY d.lang""",
)
def truth_recall(spark, d):
    """Truth against a prediction that leaves short texts out, over all of truth."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    truth = table(spark, d, "labels").join(docs, "doc_id").select("doc_id", "lang", "quality")
    guess = docs.where("n_chars >= 500").select("doc_id", (F.col("n_chars") > 1500).cast("int").alias("quality"))
    out = evaluation.recall(truth, guess, ["doc_id"], "quality", ["lang"])
    return out.withColumn("matched", F.round("matched", 6))


@register(
    "case_runs",
    """SELECT event_type AS "case", CASE WHEN user_id % 2 = 0 THEN 'live' ELSE 'offline' END AS mode, count(*) AS runs, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd,
    min(value) AS low, max(value) AS high, round(avg(CASE WHEN value >= 50 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate FROM events GROUP BY ALL""",
)
def case_runs(spark, d):
    """Scores of independent runs by case and mode."""
    rows = table(spark, d, "events").select(F.col("event_type").alias("case"), F.when(F.col("user_id") % 2 == 0, "live").otherwise("offline").alias("mode"), "value")
    out = evaluation.run_summary(rows, ["case", "mode"], "value", 50)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "sd", "pass_rate")})


@register(
    "level_agreement",
    """SELECT coalesce(x.k, y.k) AS k, x.v AS a, y.v AS b, x.v IS NOT DISTINCT FROM y.v AS agrees FROM
    (SELECT user_id AS k, count(*) % 3 AS v FROM events WHERE event_type = 'view' GROUP BY 1) x FULL JOIN
    (SELECT user_id AS k, count(*) % 3 AS v FROM events WHERE event_type = 'error' GROUP BY 1) y ON x.k = y.k""",
)
def level_agreement(spark, d):
    """The same key under two configurations."""
    e = table(spark, d, "events").withColumnRenamed("user_id", "k")
    side = lambda t: e.where(f"event_type = '{t}'").groupBy("k").agg((F.count(F.lit(1)) % 3).alias("v"))
    return evaluation.agreement(side("view"), side("error"), ["k"], "v")


@register("case_listing", "SELECT DISTINCT event_type AS \"case\" FROM events")
def case_listing(spark, d):
    """What can be run."""
    return table(spark, d, "events").select(F.col("event_type").alias("case")).distinct()


@register(
    "truth_metrics",
    """WITH t AS (SELECT doc_id, lang, quality FROM labels JOIN documents USING (doc_id)), p AS (SELECT doc_id, lang, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS quality FROM documents WHERE n_chars >= 500)
    SELECT lang, count(t.doc_id) AS n, round(count(*) FILTER (WHERE t.doc_id IS NOT NULL AND p.doc_id IS NOT NULL) / count(t.doc_id), 6) AS coverage, round(count(*) FILTER (WHERE t.quality = p.quality) / count(t.doc_id), 6) AS recall,
    round(count(*) FILTER (WHERE t.quality = p.quality) / count(p.doc_id), 6) AS precision, CASE WHEN count(*) FILTER (WHERE t.quality = p.quality) = count(*) THEN 1 ELSE 0 END AS agreement
    FROM t FULL JOIN p USING (doc_id, lang) GROUP BY lang""",
)
def truth_metrics(spark, d):
    """Coverage, recall, precision and exact agreement by language."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    truth = table(spark, d, "labels").join(docs, "doc_id").select("doc_id", "lang", "quality")
    guess = docs.where("n_chars >= 500").select("doc_id", "lang", (F.col("n_chars") > 1500).cast("int").alias("quality"))
    out = evaluation.metrics(truth, guess, ["doc_id"], "quality", ["lang"])
    return out.withColumns({c: F.round(c, 6) for c in ("coverage", "recall", "precision")})


@register("benchmark_coverage", "SELECT item_id, length(text) AS n_chars, EXISTS (SELECT 1 FROM documents d WHERE d.text = b.text) AS verbatim FROM benchmark b")
def benchmark_coverage(spark, d):
    """Texts meet by their digests, so no text is shuffled."""
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    b = table(spark, d, "benchmark").select("item_id", F.length("text").cast("bigint").alias("n_chars"), digest)
    docs = table(spark, d, "documents").select(digest).join(b.select("digest"), "digest", "left_semi").distinct().withColumn("verbatim", F.lit(True))
    return b.join(docs, "digest", "left").select("item_id", "n_chars", F.coalesce("verbatim", F.lit(False)).alias("verbatim"))


@register("toxic_rate", "SELECT source, count(*) AS n, round(avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY source")
def toxic_rate(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(ratio(F.col("toxic") == 1), 6).alias("rate"))
