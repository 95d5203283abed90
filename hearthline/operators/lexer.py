"""A lexer for C and C++ sources, in Arrow batches: scopes, classes, functions, calls and constructions, in one pass over a text.

It knows tokens and nesting, not types: namespaces and classes by name, functions by the signature before a brace at namespace or class level (over any number
of lines), calls by a name before a parenthesis inside a function. Branches of a conditional start from the nesting that it began with, so braces that both branches
open are counted once. The region (BAD or GOOD) is the innermost conditional that omits one.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthline.operators.graph import checkpoints

#: Columns of a fact: kind is class, function, call or construct. `scope` is the class of a method or what is written before :: in a call, `namespace` the namespaces around,
#: `within` the function that a call stands in, `base` a class' base (a row for each, or one with null), `member` whether a call has an object before it.
FACT = "kind STRING, name STRING, scope STRING, namespace STRING, base STRING, within STRING, member BOOLEAN, line INT, end_line INT, region STRING"

_TOKEN = re.compile(
    r"""(?P<skip>/\*.*?(?:\*/|\Z)|//(?:\\\r?\n|[^\n])*)|(?P<text>L?"(?:\\.|[^"\\\n])*"?|L?'(?:\\.|[^'\\\n])*'?)|(?P<pre>^[ \t]*\#(?:\\\r?\n|/\*.*?\*/|[^\n])*)"""
    r"""|(?P<name>[A-Za-z_]\w*)|(?P<number>\.?\d(?:[\w.]|[eE][+-])*)|(?P<mark>::|->|[^\s\w])|(?P<line>\n)""",
    re.S | re.M | re.X,
)
#: Words of the language that may stand before a parenthesis without being called.
NOT_CALLED = {"if", "for", "while", "switch", "return", "sizeof", "catch", "defined", "alignof", "decltype", "typeid", "throw", "delete", "new", "else", "do", "case", "operator"}
#: Words that may stand before a called name; after any other name it is a variable that is declared.
BEFORE_CALL = {"return", "else", "do", "throw", "case", "goto", "in", "and", "or", "not", "delete"}
_ACCESS = {"public", "private", "protected", "virtual"}


class Scanner:
    """The facts of one text."""

    def __init__(self, text: str):
        self.text, self.line = text, 1
        self.stack: list[dict] = []
        self.branches: list[tuple[list, str | None]] = []
        self.facts: list[list] = []

    def _path(self, kind: str) -> str | None:
        return "::".join(s["name"] for s in self.stack if s["kind"] == kind) or None

    def _function(self) -> dict | None:
        return next((s for s in reversed(self.stack) if s["kind"] == "function"), None)

    def _region(self) -> str | None:
        return next((r for _, r in reversed(self.branches) if r), None)

    def _directive(self, text: str) -> None:
        words = text.lstrip(" \t#").split()
        if not words:
            return
        if words[0] in ("if", "ifdef", "ifndef"):
            omitted = {"OMITBAD": "BAD", "OMITGOOD": "GOOD"}.get(words[1]) if words[0] == "ifndef" and len(words) > 1 else None
            self.branches.append((list(self.stack), omitted))
        elif words[0] in ("else", "elif") and self.branches:
            self.stack = list(self.branches[-1][0])
        elif words[0] == "endif" and self.branches:
            self.branches.pop()

    def _fact(self, kind, name, line, scope=None, base=None, within=None, member=None) -> list:
        fact = [kind, name, scope, self._path("namespace"), base, within, member, line, None, self._region()]
        self.facts.append(fact)
        return fact

    def _open(self, head: list[tuple[str, str, int]]) -> None:
        """What a brace opens, from the tokens before it."""
        words = [w for _, w, _ in head]
        if self._function():
            self.stack.append({"kind": "block", "name": ""})
            return
        if "namespace" in words:
            at = words.index("namespace")
            self.stack.append({"kind": "namespace", "name": "".join(words[at + 1 :]) or "<unnamed>"})
            return
        paren = words.index("(") if "(" in words else -1
        kind = next((i for i, w in enumerate(words) if w in ("class", "struct", "union")), -1)
        if kind >= 0 and paren < 0:
            names = [(w, n) for k, w, n in head[kind + 1 :] if k == "name"]
            colon = words.index(":") if ":" in words else len(words)
            own = next(((w, n) for k, w, n in reversed(head[kind + 1 : colon]) if k == "name"), None)
            bases, at = [], []
            for k, w, _ in [*head[colon + 1 :], ("mark", ",", 0)]:
                if w == ",":
                    bases += ["".join(at)] if at else []
                    at = []
                elif w not in _ACCESS and (k == "name" or w == "::"):
                    at.append(w)
            if own and names:
                for base in bases or [None]:
                    self._fact("class", own[0], own[1], scope=self._path("class"), base=base)
                self.stack.append({"kind": "class", "name": own[0]})
                return
        elif paren > 0 and "=" not in words[:paren] and head[paren - 1][0] == "name" and words[paren - 1] not in NOT_CALLED:
            at, name = paren - 1, words[paren - 1]
            line = head[at][2]
            if at and words[at - 1] == "~":
                name, at = "~" + name, at - 1
            scope: list[str] = []
            while at >= 2 and words[at - 1] == "::" and head[at - 2][0] == "name":
                scope.insert(0, words[at - 2])
                at -= 2
            fact = self._fact("function", name, line, scope="::".join(scope) or self._path("class"))
            self.stack.append({"kind": "function", "name": name, "fact": fact})
            return
        self.stack.append({"kind": "block", "name": ""})

    def _called(self, head: list[tuple[str, str, int]]) -> None:
        """A parenthesis inside a function, from the tokens before it."""
        if not head or head[-1][0] != "name" or head[-1][1] in NOT_CALLED:
            return
        at, (_, name, line) = len(head) - 1, head[-1]
        scope: list[str] = []
        while at >= 2 and head[at - 1][1] == "::" and head[at - 2][0] == "name":
            scope.insert(0, head[at - 2][1])
            at -= 2
        before = head[at - 1] if at else ("", "", 0)
        within = self._function()["name"]
        written = "::".join(scope) or None
        if before[1] == "new":
            self._fact("construct", name, line, scope=written, within=within)
        elif before[0] == "name" and before[1] not in BEFORE_CALL:
            self._fact("construct", before[1], line, within=within)
        else:
            self._fact("call", name, line, scope=written, within=within, member=before[1] in (".", "->"))

    def scan(self) -> list[list]:
        head: list[tuple[str, str, int]] = []
        for m in _TOKEN.finditer(self.text):
            kind, word = m.lastgroup, m.group()
            if kind == "pre":
                self._directive(word)
            elif word == "{":
                self._open(head)
                head = []
            elif word == "}":
                if self.stack:
                    closed = self.stack.pop()
                    if "fact" in closed:
                        closed["fact"][8] = self.line
                head = []
            elif word == ";":
                head = []
            elif kind in ("name", "mark", "number", "text"):
                if word == "(" and self._function():
                    self._called(head)
                if not (word == ":" and len(head) == 1 and head[0][1] in _ACCESS):
                    head.append((kind, word, self.line))
                else:
                    head = []
            self.line += word.count("\n")
        return self.facts


#: Facts that a task gives on at once.
SOME_FACTS = 20_000
_ARROW = pa.schema([("path", pa.string()), *((c.split()[0], {"STRING": pa.string(), "BOOLEAN": pa.bool_(), "INT": pa.int32()}[c.split()[1]]) for c in FACT.split(", "))])


def facts(sources: DataFrame) -> DataFrame:
    """path and the facts of each source (path, text)."""

    def scan(batches):
        for batch in batches:
            rows: list[tuple] = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += ((path, *fact) for fact in Scanner(text or "").scan())
                if len(rows) >= SOME_FACTS:
                    yield packed(rows)
                    rows = []
            if rows:
                yield packed(rows)

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return sources.select("path", "text").mapInArrow(scan, f"path STRING, {FACT}")


def functions(found: DataFrame) -> DataFrame:
    """(path, line, end_line, name, scope, namespace, region) of function definitions, constructors and destructors too."""
    return found.where("kind = 'function'").select("path", "line", "end_line", "name", "scope", "namespace", "region")


def resolved_calls(found: DataFrame) -> DataFrame:
    """(src, dst, name, line): calls to functions that the sources define, by name within the caller's namespace, what it names before ::, or none.

    A function without a namespace is called by its name from anywhere; static ones of other files are taken for callees too where names clash.
    """
    checkpoints(found.sparkSession)
    full = F.concat_ws("::", "namespace", "name")
    # read once, as what found is made of may be read from sources again each time
    found = found.where("kind = 'function' AND scope IS NULL OR kind = 'call' AND NOT member").select("path", "line", "name", "namespace", "scope", "kind").checkpoint()
    defined = found.where("kind = 'function'").select(F.col("path").alias("dst"), full.alias("full")).distinct()
    called = found.where("kind = 'call'").select("path", "line", "name", F.array_distinct(F.array(
        F.concat_ws("::", "namespace", "scope", "name"), F.concat_ws("::", "scope", "name"))).alias("may"))
    tried = called.select("path", "line", "name", F.posexplode("may").alias("order", "full"))
    # sizes are known of files only, not of what their texts hold, so no side is broadcast by them
    hits = tried.join(defined.select("full").distinct().hint("merge"), "full", "left_semi")
    near = hits.withColumn("least", F.min("order").over(Window.partitionBy("path", "line", "name"))).where("order = least")
    return near.join(defined.hint("merge"), "full").select(F.col("path").alias("src"), "dst", "name", "line").distinct()
