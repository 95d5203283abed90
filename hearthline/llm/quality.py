"""Operator 5 [native]: quality rules with host-level verdicts, in DataFrame functions only.

Each text is measured by its own rules; failures are counted by host (`source`) with a combine before the shuffle; each host's
failure rate is shrunk towards the corpus by a beta prior fitted to the hosts by moments; verdicts return to the
documents by an equi-join, which adaptive execution broadcasts or splits by measured size.

Repeated words are found without a shuffle: where the hashes of a text's five-word windows are not all distinct, they are sorted with their positions inside the
row; equal neighbours mark repeats, and the sorted marked positions give the number of words they cover. 64-bit hashes
stand for words and windows: within one text of a million words a false repeat has a chance of 6e-8.

Verdict: a host is rejected if its shrunk failure rate is over HOST_RATE; a document is kept if its own rules pass and its host
is not rejected.

Defined cases: null and empty texts have no words and fail; rows without source form one host of their own; equal rows count
once each; rows without doc_id are judged like others, and rows that share a doc_id each by its own text; a very long text is one row like any other; an empty table
gives no rows; further columns, of any name, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import row_hash, table

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Above this share of failing documents, after shrinkage, a host's other documents go too.
HOST_RATE = 0.5
#: Weight of the prior, in documents, where all hosts have one rate.
PLAIN_STRENGTH = 1000.0
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def bind(value: Column, use) -> Column:
    """use(value), with value computed once for the row: a lambda's variable is never inlined."""
    return F.element_at(F.transform(F.array(value), use), 1)


def covered(words: Column) -> Column:
    """How many words lie in five-word windows that occur twice or more in the same text."""

    def of(w: Column) -> Column:
        windows = F.transform(F.slice(w, F.lit(1), F.size(w) - WINDOW + 1), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)]))
        return bind(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bind(placed(h), repeated)))

    def placed(h: Column) -> Column:
        return F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        h = lambda i: F.get(s, i)["h"]
        at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(h(i) == h(i - 1), F.lit(False)) | F.coalesce(h(i) == h(i + 1), F.lit(False)))
        starts = F.array_sort(F.transform(at, lambda i: F.get(s, i)["i"]))
        first = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(starts, first, step, lambda a: a["n"])

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(bind(F.transform(words, lambda w: F.xxhash64(w)), of))


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, source, the five counts and base_failed of every row; `row` tells rows of a doc_id apart."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    texts = documents.select("doc_id", "source", text.alias("text"))
    dup = bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    counts = bind(words, lambda w: F.struct(F.size(w).alias("n"), covered(w).alias("r")))
    out = texts.select(
        "doc_id", "source", row_hash().alias("row"), counts.alias("c"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        dup.cast("long").alias("n_dup_lines"),
    )
    out = out.select("doc_id", "source", "row", F.col("c.n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("c.r").cast("long").alias("n_repeat_words"))
    return out.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"))


def host_verdicts(each: DataFrame) -> DataFrame:
    """host (source, null-safe), rejected. The prior's moments are two numbers of the whole host table."""
    hosts = each.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("base_failed").alias("failed"))
    rate = F.col("failed") / F.col("n")
    m, v = hosts.agg(F.sum("failed") / F.sum("n"), F.coalesce(F.var_samp(rate), F.lit(0.0))).first()  # two numbers
    m = m or 0.0
    k = max(m * (1 - m) / v - 1, 1.0) if v else PLAIN_STRENGTH
    shrunk = (F.col("failed") + m * k) / (F.col("n") + k)
    return hosts.select(F.col("source").alias("host"), (shrunk > HOST_RATE).alias("rejected"))


def judge(documents: DataFrame) -> DataFrame:
    each = table(measured(documents))
    hosts = host_verdicts(each)
    out = each.join(hosts, F.col("source").eqNullSafe(F.col("host")), "left")
    return out.drop("host", "source").withColumn("kept", ~F.col("base_failed") & ~F.coalesce("rejected", F.lit(False))).drop("rejected")


def digest(documents: DataFrame) -> DataFrame:
    return judge(documents).drop("row")


#: The same rows in DuckDB SQL, over the table documents.
ORACLE = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM t),
g AS (SELECT rid, i, array_to_string(words[i:i+{WINDOW - 1}], ' ') AS gram
      FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
rep AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
cov AS (SELECT rid, count(DISTINCT j) AS r FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS j FROM rep) GROUP BY rid),
c AS (SELECT w.rid, doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cov ON w.rid = cov.rid),
d AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS failed FROM d GROUP BY source),
m AS (SELECT sum(failed) / sum(n) AS m, coalesce(var_samp(failed / n), 0) AS v FROM h),
k AS (SELECT m, CASE WHEN v > 0 THEN greatest(m * (1 - m) / v - 1, 1) ELSE {PLAIN_STRENGTH} END AS k FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (h.failed + k.m * k.k) / (h.n + k.k) > {HOST_RATE} AS kept
FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source, k
"""
