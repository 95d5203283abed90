"""Text-corpus queries on documents: lines, regions, markers, duplicates, coverage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hearthline.functions import scalars
from hearthline.operators import corpus, vectors
from hearthline.plans.registry import register
from hearthline.sources.tables import table


@register("line_records", "SELECT doc_id, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id")
def line_records(spark, d):
    """C4."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).cast("bigint").alias("chars"))


@register(
    "line_regions",
    r"""WITH l AS (SELECT doc_id, i, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))),
    m AS (SELECT *, CASE WHEN regexp_matches(line, '^[A-E]') THEN 'BAD' WHEN regexp_matches(line, '^[N-S]') THEN 'GOOD' END AS mark FROM l),
    r AS (SELECT doc_id, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS region FROM m)
    SELECT region, count(*) AS lines FROM r GROUP BY region""",
)
def line_regions(spark, d):
    """Running state over the lines of a text."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    mark = F.when(F.regexp_like("line", F.lit("^[A-E]")), "BAD").when(F.regexp_like("line", F.lit("^[N-S]")), "GOOD")
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(F.last(mark, ignorenulls=True).over(w).alias("region")).groupBy("region").agg(F.count(F.lit(1)).alias("lines"))


@register("marker_counts", r"SELECT lower(mark) AS mark, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[Tt]h[aeo]\w')) AS mark FROM documents) GROUP BY 1")
def marker_counts(spark, d):
    """Occurrences of a pattern by what it matched."""
    rows = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[Tt]h[aeo][0-9A-Za-z_]"), F.lit(0))).alias("m"))
    return rows.groupBy(F.lower("m").alias("mark")).agg(F.count(F.lit(1)).alias("n"))


@register("duplicate_text", "SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def duplicate_text(spark, d):
    """Byte-equal groups, smallest id kept."""
    return table(spark, d, "documents").groupBy(F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@register("normalised_duplicates", r"SELECT md5(regexp_replace(lower(text), '[^a-z]', '', 'g')) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def normalised_duplicates(spark, d):
    """Groups equal after normalising."""
    return table(spark, d, "documents").groupBy(F.md5(F.regexp_replace(F.lower("text"), "[^a-z]", "")).alias("digest")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@register("case_sizes", "SELECT n_files, count(*) AS cases FROM (SELECT lang, source, doc_id % 7 AS flow, count(*) AS n_files FROM documents GROUP BY ALL) GROUP BY n_files")
def case_sizes(spark, d):
    """How many cases have how many files."""
    cases = table(spark, d, "documents").groupBy("lang", "source", (F.col("doc_id") % 7).alias("flow")).agg(F.count(F.lit(1)).alias("n_files"))
    return cases.groupBy("n_files").agg(F.count(F.lit(1)).alias("cases"))


@register("chain_completeness", "SELECT k, len(list_distinct(list(p))) = 4 AS complete FROM (SELECT user_id AS k, event_type AS p FROM events WHERE event_type <> 'purchase') GROUP BY k")
def chain_completeness(spark, d):
    """C14: whether a chain has all its parts."""
    rows = table(spark, d, "events").where("event_type <> 'purchase'").groupBy(F.col("user_id").alias("k")).agg(F.collect_set("event_type").alias("p"))
    return rows.select("k", (F.size(F.array_except(F.array(*map(F.lit, ("click", "error", "signup", "view"))), "p")) == 0).alias("complete"))


@register("corpus_profile", "SELECT source, lang, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars, max(n_chars) AS longest, count(DISTINCT md5(text)) AS different FROM documents GROUP BY ALL")
def corpus_profile(spark, d):
    """C19."""
    g = table(spark, d, "documents").groupBy("source", "lang")
    return g.agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"), F.count_distinct(F.md5("text")).alias("different"))


@register("text_parsed_url", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, length(html) AS n_html, CAST(len(regexp_extract_all(html, '<a ')) AS BIGINT) AS links FROM pages")
def text_parsed_url(spark, d):
    return table(spark, d, "pages").select(
        "page_id", F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host"), F.length("html").cast("bigint").alias("n_html"), F.regexp_count("html", F.lit("<a ")).cast("bigint").alias("links")
    )


@register("build_outputs", "SELECT p_partkey || '_o' || level AS output FROM part, (VALUES (0), (2)) v(level)")
def build_outputs(spark, d):
    """Every source at every level, without a cross join: the levels are an array."""
    files = table(spark, d, "part").select(F.concat("p_partkey", F.lit(".c")).alias("path")).withColumn("path", F.concat(F.lit("/"), "path"))
    return corpus.build_matrix(files).select("output")


@register("symbol_names", "SELECT CAST(l_orderkey AS VARCHAR) AS binary, string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS names FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_orderkey")
def symbol_names(spark, d):
    """Names of one type, in listing order, joined by a space."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("binary"), F.col("l_linenumber").alias("pos"), F.col("l_linestatus").alias("type"), F.col("l_partkey").cast("string").alias("name"))
    return corpus.names_by_binary(rows, "O")


@register("affixed_names", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: 'lib' || regexp_replace(x, 'e$', '') || '.a'), ' ') AS names FROM part")
def affixed_names(spark, d):
    """Pattern and affix maps over a list."""
    words = scalars.mapped(F.split("p_name", " "), "e$", "")
    return table(spark, d, "part").select("p_partkey", F.array_join(scalars.affixed(words, "lib", ".a"), " ").alias("names"))


@register("paired_files", "SELECT a.o_custkey AS stem, count(*) AS pairs FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderstatus = 'O' AND b.o_orderstatus = 'F' GROUP BY 1")
def paired_files(spark, d):
    """Self-join of the file table on its stem."""
    f = table(spark, d, "orders").select(F.col("o_custkey").alias("stem"), F.col("o_orderkey").cast("string").alias("path"), "o_orderstatus")
    f = f.where("o_orderstatus IN ('O', 'F')").withColumn("has_symbols", F.col("o_orderstatus") == "F")
    return corpus.paired(f).groupBy("stem").agg(F.count(F.lit(1)).alias("pairs"))


@register("guarded_arithmetic", "SELECT event_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE event_id % (user_id % 5) END AS m, CASE WHEN user_id % 5 = 0 THEN NULL ELSE round(value / (user_id % 5), 6) END AS q FROM events")
def guarded_arithmetic(spark, d):
    """C20: modulo and division that give null, not an error, for zero."""
    by = F.col("user_id") % 5
    return table(spark, d, "events").select("event_id", scalars.safe_modulo(F.col("event_id"), by).alias("m"), F.round(scalars.safe_divide(F.col("value"), by), 6).alias("q"))


@register(
    "nearest_by_label",
    """WITH v AS (SELECT vec_id, label, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings),
    s AS (SELECT label, list(x ORDER BY i) AS s, max(n) AS n FROM (SELECT label, i, CAST(sum(v[i]) AS BIGINT) AS x, count(*) AS n FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM v) GROUP BY label, i) GROUP BY label),
    d AS (SELECT v.vec_id, v.label, s.label AS other, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(v.v, s.s)]) AS DOUBLE) / s.n AS score FROM v, s)
    SELECT label, nearest, count(*) AS n FROM (SELECT vec_id, label, other AS nearest FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, other) = 1) GROUP BY label, nearest""",
)
def nearest_by_label(spark, d):
    """For each vector the label with the nearest centre, by inner product on integers: one pass over the vectors against one row that holds all centres."""
    fixed = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024))
    return vectors.labels_by_nearest(table(spark, d, "embeddings").select("vec_id", "label", fixed.alias("v")))


@register(
    "nearest_vectors",
    """WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings),
    d AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(q.v, r.v)]) AS BIGINT) AS far FROM v q JOIN v r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id)
    SELECT query_id, rank, vec_id, far FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY far, vec_id) AS INTEGER) AS rank FROM d) WHERE rank <= 10""",
)
def nearest_vectors(spark, d):
    """The ten nearest of all vectors to every fiftieth, by squared distance on integers: an inverted-file index, searched until exact."""
    fixed = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), fixed.alias("v"))
    found = vectors.nearest(vectors.indexed(rows), rows.where("id % 50 = 0"), 10)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "far")


@register("label_sizes", "SELECT label, count(*) AS n, round(avg(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings GROUP BY label")
def label_sizes(spark, d):
    e = table(spark, d, "embeddings")
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(scalars.dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm"))


@register("props_map", "SELECT event_type, 'k' AS key, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def props_map(spark, d):
    """A map column: entries of the payload as keys and values."""
    rows = table(spark, d, "events").select("event_type", F.explode(F.from_json("props", "map<string, bigint>")).alias("key", "x"))
    return rows.groupBy("event_type", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"))
