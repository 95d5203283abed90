"""The lexer and what objects carry, on stand-in C++ files, one for each row of part.

Six files make a case, named as the corpus names them: a header with a hierarchy of classes, two files of overriders, one of a constructor and a destructor, and
two parts of a chain inside a namespace. Every fifth header is empty, so that its hierarchy is not there.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.operators import corpus, dispatch, lexer
from hearthline.plans.registry import register
from hearthline.sources.tables import table

#: One row for each file: kind, case c, its stem and text, in SQL that both engines read; {part} stands for the table.
ROWS = """SELECT p_size, kind, c, stem, '/o/CWE7_Obj/s01/' || stem || CASE kind WHEN 0 THEN '_81.h' WHEN 1 THEN '_81_bad.cpp' WHEN 2 THEN '_81_goodG2B.cpp' WHEN 3 THEN '_84_bad.cpp' WHEN 4 THEN '_52b.cpp' ELSE '_52c.cpp' END AS path
FROM (SELECT p_size, p_partkey % 6 AS kind, CAST(floor(p_partkey / 6) AS BIGINT) AS c, 'CWE7_Obj__v' || CAST(floor(p_partkey / 6) AS BIGINT) AS stem FROM {part}) a"""
FILES = """SELECT path, array_to_string(CASE kind
  WHEN 0 THEN CASE WHEN p_size % 5 = 0 THEN ['/* class ' || stem || ' {{ */'] ELSE [
    'namespace ' || stem || '_81', '{{', 'class ' || stem || '_81_mix;', 'class ' || stem || '_81_base', '{{', 'public:', '    virtual void action(int data) const = 0;', '}};',
    'class ' || stem || '_81_mid : public ' || stem || '_81_base', '{{', 'public: int other;', '}};', '#ifndef OMITBAD', 'class ' || stem || '_81_bad : public ' || stem || '_81_mid {{',
    '    void action(int data) const;', '}};', '#endif /* OMITBAD */', '#ifndef OMITGOOD', 'class ' || stem || '_81_goodG2B :', '    public ' || stem || '_81_base, private ' || stem || '_81_mix', '{{ }};',
    '#endif /* OMITGOOD */', '}}'] END
  WHEN 1 THEN ['#ifndef OMITBAD', 'namespace ' || stem || '_81', '{{', 'void ' || stem || '_81_bad::action(int data,', '    int more) const', '{{', '    if (data > ' || p_size || ') {{ helper(data); }}', '}}', '}}', '#endif /* OMITBAD */']
  WHEN 2 THEN ['#ifndef OMITGOOD', 'namespace ' || stem || '_81', '{{', 'void ' || stem || '_81_goodG2B::action(int data) const', '{{', '    printLine("}}");', '}}', '}}', '#endif /* OMITGOOD */']
  WHEN 3 THEN ['#ifndef OMITBAD', 'namespace ' || stem || '_84', '{{', stem || '_84_bad::' || stem || '_84_bad(int d)', '{{', '    data = d;', '}}', stem || '_84_bad::~' || stem || '_84_bad()', '{{', '}}', '}}', '#endif /* OMITBAD */']
  WHEN 4 THEN ['namespace ' || stem || '_52', '{{', 'void badSink_c(int data);', 'void badSink_b(int data)', '{{', '    badSink_c(data); // other(', '    printLine("x(");', '}}', '}}']
  ELSE ['namespace ' || stem || '_52', '{{', 'void', 'badSink_c(int data)', '{{', '#ifdef _WIN32', '    if (data) {{', '#else', '    while (data) {{', '#endif', '    }}', '}}', '}}'] END, chr(10)) AS text FROM (ROWS) b""".replace("ROWS", ROWS)

WITH = f"WITH r AS ({ROWS.format(part='part')})"


def sources(spark, d):
    # a row of a few bytes becomes a text, so rows are dealt out first: their file is too small to be cut into a task for each core
    rows = table(spark, d, "part").select("p_partkey", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return spark.sql(FILES.replace("[", "array(").replace("]", ")").replace("array_to_string", "array_join"), part=rows)


@register(
    "lexed_functions",
    WITH + """ SELECT path, name, scope, namespace, CAST(line AS INT) AS line, CAST(end_line AS INT) AS end_line, region FROM (
    SELECT path, 'action' AS name, stem || '_81_bad' AS scope, stem || '_81' AS namespace, 4 AS line, 8 AS end_line, 'BAD' AS region FROM r WHERE kind = 1
    UNION ALL SELECT path, 'action', stem || '_81_goodG2B', stem || '_81', 4, 7, 'GOOD' FROM r WHERE kind = 2
    UNION ALL SELECT path, stem || '_84_bad', stem || '_84_bad', stem || '_84', 4, 7, 'BAD' FROM r WHERE kind = 3
    UNION ALL SELECT path, '~' || stem || '_84_bad', stem || '_84_bad', stem || '_84', 8, 10, 'BAD' FROM r WHERE kind = 3
    UNION ALL SELECT path, 'badSink_b', NULL, stem || '_52', 4, 8, NULL FROM r WHERE kind = 4
    UNION ALL SELECT path, 'badSink_c', NULL, stem || '_52', 4, 12, NULL FROM r WHERE kind = 5)""",
)
def lexed_functions(spark, d):
    """Function definitions with scope, namespace and extent, over signatures of several lines and braces of both branches."""
    return lexer.functions(lexer.facts(sources(spark, d)))


@register("lexed_calls", WITH + " SELECT a.path AS src, b.path AS dst, 'badSink_c' AS name, CAST(6 AS INT) AS line FROM r a JOIN r b ON a.c = b.c AND a.kind = 4 AND b.kind = 5")
def lexed_calls(spark, d):
    """Calls to bare names inside a namespace."""
    return lexer.resolved_calls(lexer.facts(sources(spark, d)))


@register(
    "class_closure",
    WITH + """, h AS (SELECT stem || '_81_' AS p FROM r WHERE kind = 0 AND p_size % 5 <> 0),
    v(a, b, depth) AS (VALUES ('base', 'base', 0), ('mid', 'mid', 0), ('bad', 'bad', 0), ('goodG2B', 'goodG2B', 0), ('mix', 'mix', 0), ('mid', 'base', 1), ('bad', 'mid', 1), ('bad', 'base', 2), ('goodG2B', 'base', 1), ('goodG2B', 'mix', 1))
    SELECT p || a AS class, p || b AS ancestor, CAST(depth AS INT) AS depth FROM h, v""",
)
def class_closure(spark, d):
    """Every ancestor of every class, at its least distance."""
    found = lexer.facts(sources(spark, d)).where("kind = 'class'")
    return dispatch.closure(found.select(F.col("name").alias("class"), "base"))


@register(
    "object_edges",
    WITH + """, k AS (SELECT *, '/o/CWE7_Obj/s01/' || stem || CASE kind WHEN 3 THEN '_84a' ELSE '_81a' END AS a, stem || CASE kind WHEN 1 THEN '_81_bad' WHEN 2 THEN '_81_goodG2B' WHEN 3 THEN '_84_bad' END AS class,
      c IN (SELECT c FROM r WHERE kind = 0 AND p_size % 5 <> 0) AS known FROM r WHERE kind IN (1, 2, 3))
    SELECT a AS src, path AS dst, 'virtual' AS type, CASE WHEN known THEN stem || '_81_base' ELSE class END || '::action' AS via, true AS src_missing FROM k WHERE kind < 3
    UNION ALL SELECT a, path, 'lifetime', class || '::' || class, true FROM k WHERE kind = 3
    UNION ALL SELECT path, path, 'lifetime', class || '::~' || class, false FROM k WHERE kind = 3""",
)
def object_edges(spark, d):
    """C16 with C9: virtual calls from a root class to all overriders, and constructor to destructor."""
    files = sources(spark, d)
    return dispatch.object_edges(corpus.files(files), lexer.facts(files))
