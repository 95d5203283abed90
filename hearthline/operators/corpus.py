"""Labelled source corpora: facts from file names, headers, lines and code, as regular expressions and windows.

Input is (path, text), one row a file. Names read CWE<id>_<weakness>__<variant>_<flow><part?><polarity?>.<ext>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The grammar of file names and the keys of header comments, as the corpus has them.
NAME = r"^CWE(\d+)_(.+?)__(.+)_(\d\d)([b-e]?)(?:_(bad|goodG2B|goodB2G|good1))?\.(c|cpp|h)$"
HEADER_KEYS = {
    "label_file": "Label Definition File", "template": "Template File", "bad_source": "BadSource", "good_source": "GoodSource",
    "sink": "Sinks?", "good_sink": "GoodSink", "bad_sink": "BadSink",
}
#: Shapes of dataflow by flow code: fixed values of the corpus.
FLOW_SHAPES = {
    "01": "single file", "51": "argument, 1 hop", "52": "argument, 2 hops", "53": "argument, 3 hops", "54": "argument, 4 hops",
    "61": "return value", "62": "reference", "63": "pointer to data", "64": "void pointer", "65": "function pointer",
    "66": "array element", "67": "struct field", "68": "global variable", "72": "vector element", "73": "list element",
    "74": "map value", "81": "virtual method, reference", "82": "virtual method, pointer", "83": "constructor and destructor, stack",
    "84": "constructor and destructor, heap",
}
#: How data moves along an edge, by flow code: how it is passed, and whether it comes back from the callee.
EDGE_KINDS = {
    "51": "argument", "52": "argument", "53": "argument", "54": "argument", "61": "return", "62": "reference", "63": "pointer", "64": "void pointer",
    "65": "indirect", "66": "element", "67": "field", "68": "global", "72": "element", "73": "element", "74": "element",
    "81": "virtual", "82": "virtual", "83": "lifetime", "84": "lifetime",
}
#: Last part of a complete chain, by flow.
CHAIN_ENDS = {"51": "b", "52": "c", "53": "d", "54": "e"}


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _value(key: str) -> Column:
    """What follows `key:` or `key :` in the header; null where the key is absent, empty where it has no value."""
    pattern = rf"(?m)^[ \t*]*{key} ?:([^\r\n]*)"
    return F.when(F.regexp_like("text", F.lit(pattern)), F.regexp_extract("text", pattern, 1))


def _kind(value: Column) -> Column:
    """The first word if exactly one space stands before it."""
    return F.nullif(F.regexp_extract(value, r"^ (\S+)", 1), F.lit(""))


def line_count(text: Column) -> Column:
    """Lines of a text; a final newline ends the last line and starts none."""
    return F.regexp_count(text, F.lit(r"\n")) + F.when((text == "") | text.endswith("\n"), 0).otherwise(1)


def files(sources: DataFrame) -> DataFrame:
    """The file record: parsed name, size, header."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    part = lambda g: _found(name, NAME, g)
    values = {k: _value(v) for k, v in HEADER_KEYS.items()}
    header = F.struct(
        _kind(values["bad_source"]).alias("bad_source_kind"), F.trim(values["bad_source"]).alias("bad_source"), F.trim(values["good_source"]).alias("good_source"),
        _kind(values["sink"]).alias("sink_kind"), F.trim(values["good_sink"]).alias("good_sink"), F.trim(values["bad_sink"]).alias("bad_sink"),
        F.trim(values["template"]).alias("template"), F.trim(values["label_file"]).alias("label_file"), F.trim(values["sink"]).alias("sink"),
    )
    return sources.select(
        "path", _found(F.col("path"), r"/(s\d\d)/[^/]+$").alias("split"), name.alias("name"), part(1).cast("int").alias("cwe"),
        part(2).alias("weakness"), part(3).alias("functional_variant"), part(4).alias("flow"), part(5).alias("part"), part(6).alias("polarity"),
        _found(name, r"\.([^.]+)$").alias("ext"), line_count(F.col("text")).alias("n_lines"), F.octet_length("text").alias("n_bytes"),
        F.when(values["bad_source"].isNotNull(), header).alias("header"), "text",
    )


def lines(sources: DataFrame) -> DataFrame:
    """(path, line_no from 1, text, region BAD or GOOD or null): a running state over the region marks of a file."""
    ended = F.regexp_replace("text", r"\r?\n\z", "")
    rows = sources.where("text <> ''").select("path", F.posexplode(F.split(ended, r"\r?\n")).alias("line_no", "text")).withColumn("line_no", F.col("line_no") + 1)
    mark = (
        F.when(F.regexp_like("text", F.lit(r"^#ifndef OMITBAD")), "BAD").when(F.regexp_like("text", F.lit(r"^#ifndef OMITGOOD")), "GOOD")
        .when(F.regexp_like("text", F.lit(r"^#endif /\* OMIT(BAD|GOOD) \*/")), "")
    )
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("region", F.nullif(F.last(mark, ignorenulls=True).over(w), F.lit("")))


def markers(lined: DataFrame) -> DataFrame:
    """Flaw and fix comments with the region they stand in; the region, not the comment, is the label."""
    kind = _found(F.col("text"), r"(POTENTIAL FLAW|FLAW|FIX):")
    return lined.select("path", "line_no", kind.alias("kind"), "region").where("kind IS NOT NULL")


def function_defs(lined: DataFrame) -> DataFrame:
    """One-line signatures followed by a brace; constructors and destructors count too, marked by `special`."""
    w = Window.partitionBy("path").orderBy("line_no")
    plain = r"^(?:static |inline |const |unsigned )*[A-Za-z_][\w:<>]*[ \*&]+(?:\w+::)*(\w+)\([^;]*\)\s*(?:const)?$"
    special = r"^(\w+)::(~?\1)\([^;]*\)$"
    rows = lined.withColumn("next", F.lead("text").over(w)).where(F.trim("next") == "{")
    name = F.coalesce(_found(F.col("text"), special, 2), _found(F.col("text"), plain))
    return rows.select("path", "line_no", name.alias("name"), "region", F.regexp_like("text", F.lit(special)).alias("special")).where("name IS NOT NULL")


def call_edges(lined: DataFrame) -> DataFrame:
    """Calls to the next part of a chain by full name: (path, line_no, dst)."""
    return lined.select("path", "line_no", _found(F.col("text"), r"^\s+(CWE\d+_\w+_\d\d[b-e]_\w+)\(").alias("dst")).where("dst IS NOT NULL")


def class_edges(lined: DataFrame) -> DataFrame:
    pattern = r"^\s*class (\w+)(?:\s*:\s*(?:public|private|protected) (\w+))?\s*\{?$"
    return lined.select("path", "line_no", _found(F.col("text"), pattern).alias("class"), _found(F.col("text"), pattern, 2).alias("base")).where("class IS NOT NULL")


def include_edges(lined: DataFrame, sources: DataFrame) -> DataFrame:
    """Includes of sibling headers, and whether that file is there."""
    folder = lambda c: F.regexp_replace(c, r"[^/]+$", "")
    found = lined.select("path", "line_no", _found(F.col("text"), r'^#include "(CWE[^"]+)"').alias("target")).where("target IS NOT NULL")
    there = sources.select(folder(F.col("path")).alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("target"), F.lit(True).alias("there"))
    out = found.withColumn("folder", folder(F.col("path"))).join(there, ["folder", "target"], "left")
    return out.select("path", "line_no", "target", F.coalesce("there", F.lit(False)).alias("resolved"))


def declared_tests(lined: DataFrame) -> DataFrame:
    """Test names that a testcases.h declares."""
    name = _found(F.col("text"), r"void (CWE\d+_\w+?)_(?:bad|good)\(")
    return lined.where(F.col("path").endswith("testcases.h")).select("path", name.alias("test")).where("test IS NOT NULL").distinct()


def undeclared(declared: DataFrame, recorded: DataFrame) -> DataFrame:
    """Declared tests that no file holds."""
    return declared.join(recorded.select(F.regexp_extract("name", r"^(CWE.+_\d\d)", 1).alias("test")).distinct(), "test", "left_anti")


def test_cases(recorded: DataFrame) -> DataFrame:
    return recorded.where("cwe IS NOT NULL").groupBy("cwe", "functional_variant", "flow").agg(F.count(F.lit(1)).alias("n_files"))


def chains(recorded: DataFrame) -> DataFrame:
    """Chains over parts: how many are complete from b to the last part of their flow."""
    ends = F.create_map(*[F.lit(x) for kv in CHAIN_ENDS.items() for x in kv])
    parts = recorded.where(F.col("flow").isin(*CHAIN_ENDS)).groupBy("cwe", "functional_variant", "flow").agg(F.collect_set("part").alias("parts"))
    want = F.expr("transform(sequence(ascii('b'), ascii(last)), x -> char(x))")
    return parts.withColumn("last", ends[F.col("flow")]).withColumn("complete", F.size(F.array_except(want, "parts")) == 0).drop("last")


def profile(recorded: DataFrame) -> DataFrame:
    """Files by extension, lines, variants and cases of each weakness."""
    return recorded.where("cwe IS NOT NULL").groupBy("cwe", "weakness").agg(
        F.count(F.lit(1)).alias("files"), *[F.count_if(F.col("ext") == e).alias(e) for e in ("c", "cpp", "h")], F.sum("n_lines").alias("lines"),
        F.count_distinct("functional_variant").alias("variants"), F.count_distinct("functional_variant", "flow").alias("cases"),
    )


def kinds(recorded: DataFrame, line: str) -> DataFrame:
    """Files by the kind that a header line (`bad_source` or `sink`) names, among those that have the line."""
    return recorded.where(f"header.{line} IS NOT NULL").groupBy(F.coalesce(f"header.{line}_kind", F.lit("")).alias("kind")).agg(F.count(F.lit(1)).alias("files"))


def without_region(lined: DataFrame, region: str) -> DataFrame:
    """What a compiler sees if the macro that omits a region (BAD or GOOD) is defined; marks go too."""
    mark = F.regexp_like("text", F.lit(r"^#(?:ifndef OMIT(?:BAD|GOOD)|endif /\* OMIT(?:BAD|GOOD) \*/)"))
    return lined.where(~(F.col("region").eqNullSafe(region) | mark))


def compiled(recorded: DataFrame, extensions: tuple[str, ...] = ("c", "cpp")) -> DataFrame:
    """Directories with the extensions that they compile and how many files of each."""
    rows = recorded.where(F.col("ext").isin(*extensions)).select(F.regexp_replace("path", r"/[^/]+$", "").alias("directory"), "ext")
    return rows.groupBy("directory").agg(F.array_join(F.array_sort(F.collect_set("ext")), ",").alias("extensions"), F.count(F.lit(1)).alias("files"))


def areas_without_source(paths: DataFrame, root: str) -> DataFrame:
    """(area, files, scripts) for each folder directly below root whose tree holds files (path) but no named source: scripts or declarations only.

    A source is a .c, .cpp or .h file under a name of the corpus, so `testcases.h` is none. One aggregate over the names; no file is read. Files that
    lie in root itself belong to no area, nor do null paths and those elsewhere.
    """
    below = paths.where(F.col("path").contains(f"{root}/")).select(F.substring_index("path", f"{root}/", -1).alias("rest")).where("contains(rest, '/')")
    name = F.regexp_extract("rest", r"([^/]+)$", 1)
    source = name.startswith("CWE") & F.regexp_like(name, F.lit(r"\.(?:c|cpp|h)$"))
    each = below.groupBy(F.substring_index("rest", "/", 1).alias("area")).agg(F.count(F.lit(1)).alias("files"), F.count_if(name.endswith(".bat")).alias("scripts"), F.count_if(source).alias("sources"))
    return each.where("sources = 0").drop("sources")


def flow_edges(recorded: DataFrame) -> DataFrame:
    """Edges between the files of a test case: (src, dst, type, shape, missing). Parts follow each other by letter; a value that is returned flows back.

    A part whose predecessor is not there (a never is, in the corpus) gets its edge from a marked node: the case's folder and name with the letter, and
    `missing` says that it stands for no file. Flows that move data in objects (81 to 84) have no letters; `dispatch.object_edges` gives theirs.
    """
    named = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    rows = recorded.where(F.col("part").isNotNull()).select("path", "flow", F.ascii("part").alias("at"), F.regexp_extract("path", r"^(.*_\d\d)[b-e]", 1).alias("case"))
    before = rows.select("case", (F.col("at") + 1).alias("at"), F.col("path").alias("from"))
    pairs = rows.join(before, ["case", "at"], "left").select(
        F.coalesce("from", F.concat("case", F.char(F.col("at") - 1))).alias("from"), F.col("path").alias("to"), named(EDGE_KINDS)[F.col("flow")].alias("type"),
        named(FLOW_SHAPES)[F.col("flow")].alias("shape"), F.col("from").isNull().alias("missing"),
    )
    back = F.col("type") == "return"
    return pairs.select(F.when(back, F.col("to")).otherwise(F.col("from")).alias("src"), F.when(back, F.col("from")).otherwise(F.col("to")).alias("dst"), "type", "shape", "missing")


def duplicates(sources: DataFrame) -> DataFrame:
    """Files that are equal without comments, test name and white space."""
    from hearthline.functions.scalars import normalised_source

    test = F.regexp_extract("path", r"([^/]+?)[b-e]?(?:_(?:bad|goodG2B|goodB2G|good1))?\.\w+$", 1)
    return sources.groupBy(F.md5(normalised_source(F.col("text"), test)).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"))


def names_by_binary(symbols: DataFrame, letter: str = "T") -> DataFrame:
    """Symbol listings (binary, pos, type, name): names of one type in listing order, joined by a space."""
    rows = symbols.where(F.col("type") == letter).groupBy("binary").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("x"))
    return rows.select("binary", F.array_join(F.transform("x", lambda r: r["name"]), " ").alias("names"))


def build_matrix(sources: DataFrame, levels: tuple[int, ...] = (0, 2)) -> DataFrame:
    """Every source at every optimisation level, with the name of its output."""
    stem = F.regexp_extract("path", r"([^/]+)\.c$", 1)
    rows = sources.select(stem.alias("base"), F.explode(F.array(*map(F.lit, levels))).alias("level"))
    return rows.withColumn("output", F.format_string("%s_o%d", "base", "level"))


def paired(files_by_stem: DataFrame) -> DataFrame:
    """Stripped binaries with the copy that kept its symbols."""
    truth = files_by_stem.where("has_symbols").select("stem", F.col("path").alias("truth"))
    return files_by_stem.where("NOT has_symbols").select("stem", F.col("path").alias("stripped")).join(truth, "stem")
