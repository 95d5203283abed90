"""The extractor on stand-in source files, one for each row of part.

The stand-ins follow the grammar that the extractor reads: six files make a test case (two parts of a chain, the only parts of two others, a class with
its header) or declare its tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.operators import corpus
from hearthline.plans.registry import register
from hearthline.sources.tables import table, truth_rows

#: Path and text of the stand-ins, in SQL that both engines read; {part} stands for the table.
FILES = """
SELECT folder || '/' || name AS path,
  CASE WHEN kind = 5 THEN 'void ' || stem || '_52_bad();' || nl || 'void ' || stem || '_99_good();' || nl ELSE
  '/* Filename: ' || name || nl || 'Template File: sources.tmpl.c' || nl || '*/' || nl || '/*' || nl || ' * BadSource:' || source || ' made up' || nl
  || CASE WHEN p_size % 4 = 1 THEN ' * Sinks:' || nl WHEN p_size % 4 > 1 THEN ' * Sink: ' || lower(p_type) || nl ELSE '' END || ' * BadSink : use it' || nl || ' */' || nl
  || '#include "' || stem || '_81.h"' || nl || '#include "' || stem || '_82.h"' || nl
  || CASE kind WHEN 4 THEN 'class ' || stem || '_81_base' || nl || '{{' || nl || '}};' || nl || 'class ' || stem || '_81_bad : public ' || stem || '_81_base' || nl || '{{' || nl || '}};' || nl
    ELSE '#ifndef OMITBAD' || nl || 'static void ' || stem || '_' || flow || letter || '_badSink(int data)' || nl || '{{' || nl || '    /* POTENTIAL FLAW: use */' || nl
      || CASE WHEN kind = 0 THEN '    ' || stem || '_52c_badSink(data);' || nl ELSE '' END || '}}' || nl || '#endif /* OMITBAD */' || nl
      || '#ifndef OMITGOOD' || nl || 'int helper(int a)' || nl || '{{' || nl || '    return a % ' || p_size || ';' || nl || '}}' || nl || '#endif /* OMITGOOD */' END
  || CASE WHEN p_size % 2 = 0 THEN nl ELSE '' END END AS text
FROM (SELECT *, stem || '_' || flow || letter || polarity || ext AS full_name, CASE WHEN kind = 5 THEN 'testcases.h' ELSE stem || '_' || flow || letter || polarity || ext END AS name
  FROM (SELECT *, 'CWE' || (100 + c % 50) || '_Weak__v' || c AS stem, '/t/CWE' || (100 + c % 50) || '_Weak/s0' || (c % 3) AS folder,
      CASE kind WHEN 0 THEN '52' WHEN 1 THEN '52' WHEN 2 THEN '61' WHEN 3 THEN '63' ELSE '81' END AS flow,
      CASE kind WHEN 0 THEN 'b' WHEN 1 THEN 'c' WHEN 2 THEN 'b' WHEN 3 THEN 'b' ELSE '' END AS letter, '' AS polarity, CASE kind WHEN 4 THEN '.h' WHEN 3 THEN '.cpp' ELSE '.c' END AS ext,
      CASE WHEN p_size % 3 = 0 THEN ' ' ELSE ' ' || lower(p_type) END AS source, chr(10) AS nl
    FROM (SELECT p_size, p_type, p_partkey % 6 AS kind, CAST(floor(p_partkey / 6) AS BIGINT) AS c FROM {part}) a) b) d"""

NAME = corpus.NAME
#: The files' lines with region and next line, and the names of files, in SQL.
WITH = f"""WITH src AS ({FILES.format(part="part").replace("{{", "{").replace("}}", "}")}),
n AS (SELECT *, regexp_extract(path, '([^/]+)$', 1) AS name FROM src),
f AS (SELECT path, name, text, CASE WHEN name LIKE 'CWE%' THEN CAST(regexp_extract(name, '{NAME}', 1) AS INT) END AS cwe, nullif(regexp_extract(name, '{NAME}', 2), '') AS weakness,
  nullif(regexp_extract(name, '{NAME}', 3), '') AS functional_variant, nullif(regexp_extract(name, '{NAME}', 4), '') AS flow, nullif(regexp_extract(name, '{NAME}', 5), '') AS part,
  regexp_extract(name, '[.]([^.]+)$', 1) AS ext, CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END AS INT) AS n_lines FROM n),
l AS (SELECT path, i AS line_no, ls[i] AS text FROM (SELECT path, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT path, string_split(CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS ls FROM src))),
r AS (SELECT *, nullif(last_value(m IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING), '') AS region, lead(text) OVER (PARTITION BY path ORDER BY line_no) AS nxt
  FROM (SELECT *, CASE WHEN text LIKE '#ifndef OMITBAD%' THEN 'BAD' WHEN text LIKE '#ifndef OMITGOOD%' THEN 'GOOD' WHEN text LIKE '#endif /* OMIT%' THEN '' END AS m FROM l))
"""


def sources(spark, d):
    return spark.sql(FILES, part=table(spark, d, "part"))


def lined(spark, d):
    return corpus.lines(sources(spark, d))


@register("source_records", WITH + "SELECT path, regexp_extract(path, '/(s[0-9][0-9])/', 1) AS split, name, cwe, weakness, functional_variant, flow, part, ext, n_lines, CAST(strlen(text) AS INT) AS n_bytes FROM f")
def source_records(spark, d):
    """The file record."""
    return corpus.files(sources(spark, d)).drop("header", "text", "polarity")


@register(
    "header_fields",
    WITH + """SELECT path, nullif(regexp_extract(text, 'BadSource: ([^ ]+)', 1), '') AS bad_source_kind, trim(regexp_extract(text, 'BadSource:([^\n]*)', 1)) AS bad_source,
    CASE WHEN text LIKE '%Sink: %' OR text LIKE '%Sinks:%' THEN trim(regexp_extract(text, 'Sinks?:([^\n]*)', 1)) END AS sink, 'use it' AS bad_sink, 'sources.tmpl.c' AS template FROM f WHERE name <> 'testcases.h'""",
)
def header_fields(spark, d):
    """The header comment, by key."""
    rows = corpus.files(sources(spark, d)).where("header IS NOT NULL")
    return rows.select("path", *[f"header.{c}" for c in ("bad_source_kind", "bad_source", "sink", "bad_sink", "template")])


@register("source_functions", WITH + r"SELECT path, line_no, regexp_extract(text, '(\w+)\(', 1) AS name, region FROM r WHERE nxt = '{' AND text LIKE '%(%'")
def source_functions(spark, d):
    """Function definitions with their region."""
    return corpus.function_defs(lined(spark, d)).select("path", F.col("line_no").cast("bigint").alias("line_no"), "name", "region")


@register("chain_calls", WITH + r"SELECT path, line_no, regexp_extract(text, '^ +(CWE\w+)\(', 1) AS dst FROM l WHERE regexp_matches(text, '^ +CWE\w+\(')")
def chain_calls(spark, d):
    """Calls between parts."""
    return corpus.call_edges(lined(spark, d)).withColumn("line_no", F.col("line_no").cast("bigint"))


@register("class_inheritance", WITH + r"SELECT path, regexp_extract(text, '^class (\w+)', 1) AS class, nullif(regexp_extract(text, 'public (\w+)', 1), '') AS base FROM l WHERE text LIKE 'class %'")
def class_inheritance(spark, d):
    """Classes and what they inherit."""
    return corpus.class_edges(lined(spark, d)).drop("line_no")


@register(
    "include_targets",
    WITH + """SELECT i.path, i.target, EXISTS (SELECT 1 FROM src s WHERE s.path = regexp_replace(i.path, '[^/]+$', '') || i.target) AS resolved
    FROM (SELECT path, regexp_extract(text, '"(.+)"', 1) AS target FROM l WHERE text LIKE '#include%') i""",
)
def include_targets(spark, d):
    """Included siblings, and whether they are there."""
    files = sources(spark, d)
    return corpus.include_edges(corpus.lines(files), files).drop("line_no")


@register(
    "undeclared_tests",
    WITH + r"""SELECT DISTINCT path, test FROM (SELECT path, regexp_extract(text, 'void (CWE\w+?)_(bad|good)\(', 1) AS test FROM l WHERE path LIKE '%testcases.h')
    WHERE test NOT IN (SELECT regexp_extract(name, '^(CWE.+_\d\d)', 1) FROM n)""",
)
def undeclared_tests(spark, d):
    """C11: declared tests without a file."""
    files = sources(spark, d)
    return corpus.undeclared(corpus.declared_tests(corpus.lines(files)), corpus.files(files)).select("path", "test")


@register("source_duplicates", WITH + r"SELECT n, count(*) AS clusters FROM (SELECT count(*) AS n FROM (SELECT path, trim(regexp_replace(regexp_replace(regexp_replace(text, '(?s)/\*.*?\*/', '', 'g'), regexp_extract(name, '^(.+?)[b-e]?[.]\w+$', 1) || '[b-e]?', '', 'g'), '\s+', ' ', 'g')) AS t FROM n) GROUP BY t) GROUP BY n")
def source_duplicates(spark, d):
    """How many clusters of files are equal without comments, test name and white space, by size."""
    return corpus.duplicates(sources(spark, d)).groupBy("n").agg(F.count(F.lit(1)).alias("clusters"))


@register("source_chains", WITH + "SELECT cwe, functional_variant, flow, bool_or(part = 'b') AND bool_or(part = 'c') AS complete FROM f WHERE flow = '52' GROUP BY ALL")
def source_chains(spark, d):
    """C14: chains with all parts."""
    return corpus.chains(corpus.files(sources(spark, d))).drop("parts")


@register(
    "flow_edges",
    WITH + r""", p AS (SELECT path, flow, part, regexp_extract(path, '^(.*_\d\d)[b-e]', 1) AS c FROM f WHERE part IS NOT NULL),
    e AS (SELECT coalesce(q.path, p.c || chr(ascii(p.part) - 1)) AS a, p.path AS b, q.path IS NULL AS missing, p.flow FROM p LEFT JOIN p q ON q.c = p.c AND ascii(q.part) = ascii(p.part) - 1)
    SELECT CASE flow WHEN '61' THEN b ELSE a END AS src, CASE flow WHEN '61' THEN a ELSE b END AS dst, CASE flow WHEN '52' THEN 'argument' WHEN '61' THEN 'return' ELSE 'pointer' END AS type,
    CASE flow WHEN '52' THEN 'argument, 2 hops' WHEN '61' THEN 'return value' ELSE 'pointer to data' END AS shape, missing FROM e""",
)
def flow_edges(spark, d):
    """Edges of dataflow between parts, from a marked node where a part is not there; returned values flow back."""
    return corpus.flow_edges(corpus.files(sources(spark, d)))


@register("bad_source_kinds", WITH + "SELECT kind, count(*) AS files FROM (SELECT coalesce(nullif(regexp_extract(text, 'BadSource: ([^ ]+)', 1), ''), '') AS kind FROM f WHERE name <> 'testcases.h') GROUP BY kind")
def bad_source_kinds(spark, d):
    """C17."""
    return corpus.kinds(corpus.files(sources(spark, d)), "bad_source")


@register("sink_kinds", WITH + "SELECT kind, count(*) AS files FROM (SELECT regexp_extract(text, 'Sinks?: ([^ \n]+)', 1) AS kind FROM f WHERE regexp_matches(text, 'Sinks?:')) GROUP BY kind")
def sink_kinds(spark, d):
    """An absent line counts nowhere, a line without a value as the empty kind."""
    return corpus.kinds(corpus.files(sources(spark, d)), "sink")


@register(
    "source_profile",
    WITH + """SELECT cwe, weakness, count(*) AS files, count(*) FILTER (WHERE ext = 'c') AS c, count(*) FILTER (WHERE ext = 'cpp') AS cpp, count(*) FILTER (WHERE ext = 'h') AS h,
    CAST(sum(n_lines) AS BIGINT) AS lines, count(DISTINCT functional_variant) AS variants, count(DISTINCT functional_variant || flow) AS cases FROM f WHERE cwe IS NOT NULL GROUP BY cwe, weakness""",
)
def source_profile(spark, d):
    """C19."""
    return corpus.profile(corpus.files(sources(spark, d)))


@register("directory_extensions", WITH + "SELECT regexp_replace(path, '/[^/]+$', '') AS directory, string_agg(DISTINCT ext, ',' ORDER BY ext) AS extensions, count(*) AS files FROM f WHERE ext IN ('c', 'cpp') GROUP BY 1")
def directory_extensions(spark, d):
    """What each directory compiles."""
    return corpus.compiled(corpus.files(sources(spark, d)))


#: Scripts of areas, of which some have source files among the stand-ins, and the declarations of others.
SCRIPTS = "SELECT DISTINCT '/t/CWE' || (100 + 3 * p_size) || '_Weak/' || CASE WHEN p_partkey % 7 = 0 THEN 'testcases.h' ELSE 'CWE' || (100 + 3 * p_size) || '.bat' END AS path FROM {part}"


@register(
    "areas_without_source",
    WITH + f"""SELECT area, count(*) AS files, count(*) FILTER (WHERE path LIKE '%.bat') AS scripts FROM (SELECT path, string_split(path, '/')[3] AS area FROM
    (SELECT path FROM src UNION ALL {SCRIPTS.format(part="part")})) GROUP BY area HAVING count(*) FILTER (WHERE path LIKE '%/CWE%' AND regexp_matches(path, '/CWE[^/]*[.](c|cpp|h)$')) = 0""",
)
def areas_without_source(spark, d):
    """Folders that have a script or declarations but no source file."""
    paths = sources(spark, d).select("path").union(spark.sql(SCRIPTS, part=table(spark, d, "part")))
    return corpus.areas_without_source(paths, "/t")


@register("bad_code_only", WITH + "SELECT path, count(*) AS lines FROM r WHERE region IS DISTINCT FROM 'GOOD' AND NOT regexp_matches(text, '^#(ifndef|endif /\\*) OMIT') GROUP BY path".replace("\\\\", "\\"))
def bad_code_only(spark, d):
    """Lines that are left where the macro omits the good code."""
    return corpus.without_region(lined(spark, d), "GOOD").groupBy("path").agg(F.count(F.lit(1)).alias("lines"))


@register("truth_functions", "SELECT 'b' || l_orderkey AS binary, 'f' || l_linenumber AS name, CAST(l_partkey AS BIGINT) AS address, l_returnflag AS type FROM lineitem")
def truth_functions(spark, d):
    """One JSON document of ground truth for each binary, parsed by schema."""
    rows = table(spark, d, "lineitem").select(
        F.concat(F.lit("b"), "l_orderkey").alias("binary"),
        F.struct(F.concat(F.lit("f"), "l_linenumber").alias("name"), F.col("l_partkey").cast("bigint").alias("address"), F.col("l_returnflag").alias("type")).alias("f"),
    )
    docs = rows.groupBy("binary").agg(F.to_json(F.struct("binary", F.collect_list("f").alias("functions"))).alias("json"))
    parsed = F.from_json("json", "binary STRING, functions ARRAY<STRUCT<name: STRING, address: BIGINT, type: STRING>>, _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"})
    return truth_rows(docs.select(parsed.alias("p")).select("p.*")).drop("corrupt")
