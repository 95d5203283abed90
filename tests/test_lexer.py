"""The lexer on awkward sources, and dispatch over hierarchies."""

import pytest

from hearthline.operators import corpus, dispatch, lexer
from hearthline.plans import objects

SOURCE = r'''
#include <x.h> // class NotOne { void f() {
#define WRAP(a) do { \
    a; { } while (0)
/* void gone() { */
extern "C" {
static char * table[] = { "a{", "b" };
int plain(int a,
          char * b)   /* over
   two lines */
{
    struct { int z; } s;
    if (a) { other(b, '{', "call(\"x\")"); return deeper::most::inner(a); }
    Box box(a); Box * p = new Box(1); p->open(2); box.close(); (*fn)(3);
    for (;;) sizeof(a);
}
}
namespace one { namespace two {
template <class T> class Pair : public virtual std::list<T>, protected Other { public: Pair() : a(1), b(f(2)) { init(); } int get() const { return a; } };
enum Colour { RED };
bool operator==(const Pair & a, const Pair & b) { return true; }
#ifndef OMITBAD
void
bad()
{
#ifdef _WIN32
    if (w()) {
#else
    if (u()) {
#endif
        sink();
    }
}
#endif /* OMITBAD */
} }
'''


def test_facts_of_an_awkward_source():
    facts = [dict(zip([c.split()[0] for c in lexer.FACT.split(", ")], f)) for f in lexer.Scanner(SOURCE).scan()]
    functions = [(f["name"], f["scope"], f["namespace"], f["line"], f["end_line"], f["region"]) for f in facts if f["kind"] == "function"]
    lines = SOURCE.split("\n")
    at = lambda s: next(i for i, x in enumerate(lines, 1) if s in x)
    assert functions == [
        ("plain", None, None, at("int plain"), at("sizeof") + 1, None), ("Pair", "Pair", "one::two", at("template"), at("template"), None),
        ("get", "Pair", "one::two", at("template"), at("template"), None), ("bad", None, "one::two", at("bad()"), at("OMITBAD */") - 1, "BAD"),
    ]
    calls = {(f["name"], f["scope"], f["within"], f["member"]) for f in facts if f["kind"] == "call"}
    assert calls == {
        ("other", None, "plain", False), ("inner", "deeper::most", "plain", False), ("open", None, "plain", True), ("close", None, "plain", True),
        ("init", None, "Pair", False), ("w", None, "bad", False), ("u", None, "bad", False), ("sink", None, "bad", False),
    }
    assert {(f["name"], f["within"]) for f in facts if f["kind"] == "construct"} == {("Box", "plain")}
    assert {(f["name"], f["base"]) for f in facts if f["kind"] == "class"} == {("Pair", "std::listT"), ("Pair", "Other")}


@pytest.mark.parametrize("text", ["", "}}}", "{{{", "#else\n#endif\n", '"', "/*", "'", "void f(", "x::", "class", "namespace {", "~", "(" * 1000, "{" * 5000 + "}" * 9000])
def test_broken_sources_end(text):
    lexer.Scanner(text).scan()


def test_table_function(spark):
    rows = spark.createDataFrame([("/a/x.c", "void f()\n{\n g();\n}\n"), ("/a/y.c", "namespace n {\nvoid g() { }\nvoid h() { g(); }\n}"), ("/a/z.c", "void g() { }"), ("/a/e.c", None)], "path string, text string")
    found = lexer.facts(rows)
    assert {(r.path, r.name) for r in lexer.functions(found).collect()} == {("/a/x.c", "f"), ("/a/y.c", "g"), ("/a/y.c", "h"), ("/a/z.c", "g")}
    assert {tuple(r) for r in lexer.resolved_calls(found).collect()} == {("/a/x.c", "/a/z.c", "g", 3), ("/a/y.c", "/a/y.c", "g", 3)}


def test_closure_of_deep_and_broken_hierarchies(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(100)] + [("x", "y"), ("y", "x"), ("z", None), ("w", "w"), ("c0", "c50")]
    got = {(r["class"], r.ancestor): r.depth for r in dispatch.closure(spark.createDataFrame(chain, "class string, base string")).collect()}
    assert got["c0", "c100"] == 51 and got["c1", "c100"] == 99 and got["z", "z"] == 0 and got["x", "y"] == 1 and ("c9", "c3") not in got
    assert len(got) == 101 * 102 // 2 + 2 + 2 + 2


def test_dispatch_reaches_overriders_and_inherited_methods(spark):
    inherits = spark.createDataFrame([("B", None), ("M", "B"), ("D", "M"), ("E", "B"), ("Z", None)], "class string, base string")
    methods = spark.createDataFrame([("B", "f", "/b"), ("D", "f", "/d"), ("E", "g", "/e"), ("Z", "f", "/z")], "class string, method string, path string")
    receivers = spark.createDataFrame([("B", "f"), ("M", "f"), ("E", "f"), ("E", "g"), ("D", "g")], "class string, method string")
    got = {(r["class"], r.method, r.target, r.dst) for r in dispatch.dispatched(receivers, inherits, methods).collect()}
    assert got == {("B", "f", "B", "/b"), ("B", "f", "D", "/d"), ("M", "f", "B", "/b"), ("M", "f", "D", "/d"), ("E", "f", "B", "/b"), ("E", "g", "E", "/e")}


def test_flows_without_a_header(spark):
    rows = spark.createDataFrame([
        ("/d/CWE1_W__v_82_bad.cpp", "namespace n {\nvoid CWE1_W__v_82_bad::action(int * d)\n{\n}\n}"),
        ("/d/CWE1_W__v_83_bad.cpp", "CWE1_W__v_83_bad::CWE1_W__v_83_bad(int d) : a(d)\n{\n}\nCWE1_W__v_83_bad::~CWE1_W__v_83_bad()\n{\n}"),
    ], "path string, text string")
    got = {tuple(r) for r in dispatch.object_edges(corpus.files(rows), lexer.facts(rows)).collect()}
    f = "/d/CWE1_W__v_83_bad.cpp"
    assert got == {
        ("/d/CWE1_W__v_82a", "/d/CWE1_W__v_82_bad.cpp", "virtual", "CWE1_W__v_82_bad::action", True), ("/d/CWE1_W__v_83a", f, "lifetime", "CWE1_W__v_83_bad::CWE1_W__v_83_bad", True),
        (f, f, "lifetime", "CWE1_W__v_83_bad::~CWE1_W__v_83_bad", False),
    }


def counted(spark, rows):
    """rows as a table that counts how often a row of it is read."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    return spark.createDataFrame(rows, "path string, text string").mapInArrow(count, "path string, text string"), read


def test_sources_are_scanned_once(spark):
    rows = [("/d/CWE1_W__v_82_bad.cpp", "namespace n {\nvoid CWE1_W__v_82_bad::action(int * d)\n{\n}\n}"), ("/d/CWE1_W__v_52b.cpp", "namespace n {\nvoid g()\n{\n}\nvoid f()\n{\n    g();\n}\n}")]
    source, read = counted(spark, rows)
    assert [tuple(r) for r in lexer.resolved_calls(lexer.facts(source)).collect()] == [("/d/CWE1_W__v_52b.cpp", "/d/CWE1_W__v_52b.cpp", "g", 7)]
    assert read.value == len(rows)
    source, read = counted(spark, rows)
    dispatch.object_edges(corpus.files(spark.createDataFrame(rows, "path string, text string")), lexer.facts(source)).collect()
    assert read.value == len(rows)
    source, read = counted(spark, [("/a.h", "class A {\n};\nclass B : public A {\n};")])
    found = lexer.facts(source).where("kind = 'class'").selectExpr("name AS class", "base")
    assert {tuple(r) for r in dispatch.closure(found).collect()} == {("A", "A", 0), ("B", "B", 0), ("B", "A", 1)}
    assert read.value == 1


def test_a_small_file_is_dealt_out_before_its_texts_are_made(spark, tmp_path):
    spark.range(400).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size", "'t' AS p_type").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    made = objects.sources(spark, str(tmp_path))
    assert made.count() == 400 and made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
