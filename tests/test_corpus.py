"""The extractor on a small hand-written corpus with the awkward cases of the real one."""

import pytest

from hearthline.operators import corpus
from hearthline.sources import tables

HEAD = """/* TEMPLATE GENERATED TESTCASE FILE
Filename: {name}
Label Definition File: CWE9_Demo.label.xml
Template File: sources-sink-{flow}b.tmpl.c
*/
/*
 * @description
 * CWE: 9 Demo
 * BadSource:{kind} made up text
{extra} * BadSink : use it
 * Flow Variant: {flow} Data flow
 *
 * */
"""
BODY = """#include "std_testcase.h"
#include "CWE9_Demo__int_81.h"
#include "CWE9_Demo__int_99.h"

#ifndef OMITBAD

void {base}b_badSink(int data)
{{
    /* POTENTIAL FLAW: uses data */
    use(data);
    {base}c_badSink(data);
}}

#endif /* OMITBAD */

#ifndef OMITGOOD

/* goodG2B: a comment
   over two lines */
void {base}b_goodG2BSink(int data)
{{
    /* POTENTIAL FLAW: still a marker, in the good region */
    use(data);
}}

static int helper(int a,
                  int b)
{{
    /* FIX: check */
    return a + b;
}}

#endif /* OMITGOOD */
"""


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    d = root / "CWE9_Demo" / "s01"
    d.mkdir(parents=True)

    def put(name, flow, kind, extra, body, folder=d):
        (folder / name).write_text(HEAD.format(name=name, flow=flow, kind=kind, extra=extra) + body)

    for part in "bc":
        put(f"CWE9_Demo__int_52{part}.c", "52", " rand", " * Sinks: add\n *    GoodSink: check\n", BODY.format(base="CWE9_Demo__int_52"))
    put("CWE9_Demo__int_53b.c", "53", " rand", " * Sink: print\n", BODY.format(base="CWE9_Demo__int_53"))
    put("CWE9_Demo__my_var_54b.cpp", "54", " ", " * GoodSource: fixed\n * Sinks:\n", "int only = 1;\n")
    put("CWE9_Demo__int_81.h", "81", " ", " * Flow: an virtual\n", "class CWE9_Demo__int_81_base\n{\n};\nclass CWE9_Demo__int_81_bad : public CWE9_Demo__int_81_base\n{\n};\n")
    put("CWE9_Demo__int_83_bad.cpp", "83", " ", " * Flow: a virtual\n", "#ifndef OMITBAD\nCWE9_Demo__int_83_bad::CWE9_Demo__int_83_bad(int x)\n{\n}\nCWE9_Demo__int_83_bad::~CWE9_Demo__int_83_bad()\n{\n}\n#endif /* OMITBAD */\n")
    other = root / "CWE8_Hand_Written"
    other.mkdir()
    (other / "CWE8_Hand_Written__empty_01.c").write_text("/*\n * @description nothing else\n */\nint main(int argc, char * argv[])\n{\n    /* FLAW: here */\n}\n")
    (other / "testcases.h").write_text("void CWE8_Hand_Written__empty_01_bad();\nvoid CWE8_Hand_Written__gone_01_good();\n")
    (other / "CWE8.bat").write_text("cl *.c\n")
    (root / "CWE8_Hand_Written" / "Makefile").write_text("all:\n")
    (d / "Makefile").write_text("all:\n")
    return str(root)


@pytest.fixture(scope="module")
def sources(spark, root):
    return tables.source_files(spark, root).cache()


@pytest.fixture(scope="module")
def lined(sources):
    return corpus.lines(sources).cache()


def test_files(spark, sources):
    rows = {r.name: r for r in corpus.files(sources).collect()}
    assert len(rows) == 8 and rows["testcases.h"].cwe is None and rows["testcases.h"].header is None
    r = rows["CWE9_Demo__int_52b.c"]
    assert (r.cwe, r.weakness, r.functional_variant, r.flow, r.part, r.polarity, r.ext, r.split) == (9, "Demo", "int", "52", "b", None, "c", "s01")
    assert (r.header.bad_source_kind, r.header.sink_kind, r.header.good_sink, r.header.bad_sink, r.header.good_source) == ("rand", "add", "check", "use it", None)
    assert rows["CWE9_Demo__int_53b.c"].header.sink_kind == "print"
    r = rows["CWE9_Demo__my_var_54b.cpp"]
    assert (r.functional_variant, r.header.bad_source_kind, r.header.bad_source, r.header.good_source, r.header.sink_kind) == ("my_var", None, "made up text", "fixed", None)
    r = rows["CWE9_Demo__int_83_bad.cpp"]
    assert (r.polarity, r.part) == ("bad", None)
    assert rows["CWE8_Hand_Written__empty_01.c"].header is None
    assert {(r.kind, r.files) for r in corpus.kinds(corpus.files(sources), "bad_source").collect()} == {("rand", 3), ("", 3)}
    assert {(r.kind, r.files) for r in corpus.kinds(corpus.files(sources), "sink").collect()} == {("add", 2), ("print", 1), ("", 1)}
    assert rows["testcases.h"].n_lines == 2


def test_lines_markers_functions(lined):
    marks = {(m.path.rsplit("/", 1)[1], m.kind, m.region) for m in corpus.markers(lined).collect()}
    assert ("CWE9_Demo__int_52b.c", "POTENTIAL FLAW", "BAD") in marks and ("CWE9_Demo__int_52b.c", "POTENTIAL FLAW", "GOOD") in marks
    assert ("CWE9_Demo__int_52b.c", "FIX", "GOOD") in marks and ("CWE8_Hand_Written__empty_01.c", "FLAW", None) in marks
    defs = {(f.name, f.region, f.special) for f in corpus.function_defs(lined).where("path LIKE '%52b.c' OR path LIKE '%83%' OR path LIKE '%_01.c'").collect()}
    assert defs == {
        ("CWE9_Demo__int_52b_badSink", "BAD", False), ("CWE9_Demo__int_52b_goodG2BSink", "GOOD", False), ("main", None, False),
        ("CWE9_Demo__int_83_bad", "BAD", True), ("~CWE9_Demo__int_83_bad", "BAD", True),
    }


def test_edges(sources, lined):
    assert {e.dst for e in corpus.call_edges(lined).where("path LIKE '%52b.c'").collect()} == {"CWE9_Demo__int_52c_badSink"}
    assert {(e["class"], e.base) for e in corpus.class_edges(lined).collect()} == {("CWE9_Demo__int_81_base", None), ("CWE9_Demo__int_81_bad", "CWE9_Demo__int_81_base")}
    assert {(e.target, e.resolved) for e in corpus.include_edges(lined, sources).collect()} == {("CWE9_Demo__int_81.h", True), ("CWE9_Demo__int_99.h", False)}


def test_cases_chains_profile(sources, lined):
    rec = corpus.files(sources).cache()
    assert {(c.functional_variant, c.flow, c.n_files) for c in corpus.test_cases(rec).where("cwe = 9").collect()} == {("int", "52", 2), ("int", "53", 1), ("my_var", "54", 1), ("int", "81", 1), ("int", "83", 1)}
    assert {(c.flow, c.complete) for c in corpus.chains(rec).collect()} == {("52", True), ("53", False), ("54", False)}
    assert {t.test for t in corpus.undeclared(corpus.declared_tests(lined), rec).collect()} == {"CWE8_Hand_Written__gone_01"}
    p = {r.cwe: r for r in corpus.profile(rec).collect()}
    assert (p[9].files, p[9].c, p[9].cpp, p[9].h, p[9].variants, p[9].cases) == (6, 3, 2, 1, 2, 5)
    assert max(r.n for r in corpus.duplicates(sources).collect()) == 3
    assert set(corpus.FLOW_SHAPES) >= set(corpus.CHAIN_ENDS)


def test_line_ends(spark):
    texts = ["", "a", "a\n", "a\n\n", "\n", "a\r\nb\r\n"]
    rows = spark.createDataFrame([(f"/x/{i}.c", t) for i, t in enumerate(texts)], "path string, text string")
    lined = {r.path: r.n for r in corpus.lines(rows).groupBy("path").agg({"text": "count"}).withColumnRenamed("count(text)", "n").collect()}
    assert [lined.get(f"/x/{i}.c", 0) for i in range(6)] == [0, 1, 1, 2, 1, 2]
    assert [r.n_lines for r in corpus.files(rows).orderBy("path").collect()] == [0, 1, 1, 2, 1, 2]


def test_regions_and_directories(sources, lined):
    bad_gone = {r.text for r in corpus.without_region(lined, "BAD").where("path LIKE '%52b.c'").collect()}
    assert not any("BAD" in t or "_badSink(int" in t for t in bad_gone) and any("goodG2BSink" in t for t in bad_gone)
    assert {(r.directory.rsplit("/", 1)[1], r.extensions, r.files) for r in corpus.compiled(corpus.files(sources)).collect()} == {("s01", "c,cpp", 5), ("CWE8_Hand_Written", "c", 1)}
    edges = {(e.src.rsplit("/", 1)[1], e.dst.rsplit("/", 1)[1], e.type, e.missing) for e in corpus.flow_edges(corpus.files(sources)).collect()}
    assert edges == {
        ("CWE9_Demo__int_52b.c", "CWE9_Demo__int_52c.c", "argument", False), ("CWE9_Demo__int_52a", "CWE9_Demo__int_52b.c", "argument", True),
        ("CWE9_Demo__int_53a", "CWE9_Demo__int_53b.c", "argument", True), ("CWE9_Demo__my_var_54a", "CWE9_Demo__my_var_54b.cpp", "argument", True),
    }
    assert set(corpus.EDGE_KINDS) | {"01"} == set(corpus.FLOW_SHAPES)


def test_scans(spark, root, sources):
    assert tables.two_levels(spark, root, "Makefile").count() == 2
    assert tables.source_files(spark, root, "*.bat").count() == 1
    have = sources.selectExpr("regexp_extract(path, '(CWE[0-9]+)_[^/]*/', 1) AS cwe").distinct()
    want = spark.createDataFrame([("CWE9",), ("CWE7",)], "cwe string")
    assert [r.cwe for r in tables.missing(want, have, "cwe").collect()] == ["CWE7"]


def test_symbols_and_matrix(spark):
    rows = spark.createDataFrame([("b", 2, "T", "main"), ("b", 1, "T", "init"), ("b", 0, "U", "puts"), ("c", 0, "T", "f")], "binary string, pos int, type string, name string")
    assert {(r.binary, r.names) for r in corpus.names_by_binary(rows).collect()} == {("b", "init main"), ("c", "f")}
    m = corpus.build_matrix(spark.createDataFrame([("/x/t_a.c",)], "path string"))
    assert {(r.base, r.level, r.output) for r in m.collect()} == {("t_a", 0, "t_a_o0"), ("t_a", 2, "t_a_o2")}


def test_normalised_duplicates(spark):
    a = "/* one */ void CWE9_A__x_51b_f() { } // end\n"
    b = "void  CWE9_B__x_52b_f()\n{ }"
    rows = spark.createDataFrame([("/p/CWE9_A__x_51b.c", a), ("/p/CWE9_B__x_52b.c", b)], "path string, text string")
    assert [r.n for r in corpus.duplicates(rows).collect()] == [2]
