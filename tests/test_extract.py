"""Extraction on hand-made files with known outcomes."""

import numpy as np
import pytest
from hypothesis import given, settings as hyp, strategies as st
from pyspark.sql import functions as F

from corpusgraph.functions import lexer
from corpusgraph.operators import build, complexity as cp, extract as xt
from corpusgraph.rules.extraction import Rule

PY = '''import os, sys as system
from .pkg.mod import (a,
    b as c)

# def not_this(x):
TEXT = """
def nor_this(y):
"""

@trace
@app.route
@cache(1)
def outer(self, a, b=(1, 2), *args, key=3):
    """doc
at column zero
    """
    def inner(x, /, y):
        return x

    return inner


class Child(Base, pkg.Other, Generic[A, B], metaclass=Meta):
    size = 1

    def go(self):
        pass

    # trailing comment

x = 1
'''
JS = "import { x, y } from './lib'\nconst z = require('zed')\nfunction big(a, b: number) {\n  if (a) { b() }\n}\nexport const go = async (q) => {\n}\nexport { p as r, s }\nclass K extends L {\n}\n"
JAVA = "class A extends B {\n\n    public static int add(int x, String y) {\n        return x;\n    }\n}\n"
RUBY = "class Car < Vehicle\n  def drive(speed)\n    go\n  end\nend\n"
PHP = "<?php\nuse App\\Order as O;\nclass P {\n  public function save($a) { }\n}\n"
OPEN = "function broken(a) {\n  if (a) {\n"
LONG = "function long(a) {\n" + "x\n" * 600 + "}\n"


@pytest.fixture(scope="module")
def ext(spark):
    rows = [("r", n, lang, text) for n, lang, text in [
        ("p.py", "python", PY), ("j.js", "javascript", JS), ("A.java", "java", JAVA), ("c.rb", "ruby", RUBY), ("o.php", "php", PHP),
        ("open.js", "javascript", OPEN), ("long.js", "javascript", LONG), ("e.py", "python", ""), ("m.md", "markdown", "def f(x):"),
        ("n.lua", "lua", "function f(x)\nend\n"), ("u.py", "python", "def größe(maß):\n    return maß\n"), ("ws.java", "java", "class W {" + " " * 30000 + "\n}")]]
    files = spark.createDataFrame(rows, "repo_id string, path string, language string, content string")
    return files


def symbols(files, **kw):
    got = xt.symbols(xt.extracted(files, **kw)).collect()
    return {(r.path, r.kind, r.name): r for r in got}


def test_python(ext):
    s = symbols(ext)
    names = {k[2] for k in s if k[0] == "p.py"}
    assert names == {"outer", "inner", "Child", "go"}
    outer = s[("p.py", "function", "outer")]
    assert (outer.line_start, outer.line_end) == (13, 20)
    assert outer.params == ["a", "b"] and outer.decorators == ["trace", "route"]
    assert s[("p.py", "function", "inner")].params == ["y"]
    child = s[("p.py", "class", "Child")]
    assert child.bases == ["Base", "Other"] and child.methods == ["go"] and child.line_end == 27
    assert s[("u.py", "function", "größe")].params == ["maß"]


def test_rule_languages(ext):
    s = symbols(ext)
    assert s[("j.js", "function", "big")].params == ["a", "number"]
    assert (s[("j.js", "function", "big")].line_start, s[("j.js", "function", "big")].line_end) == (3, 5)
    assert s[("j.js", "class", "K")].bases == ["L"]
    assert s[("A.java", "function", "add")].params == ["x", "y"]
    assert s[("c.rb", "class", "Car")].bases == ["Vehicle"]
    assert s[("c.rb", "function", "drive")].line_end == 3
    assert s[("open.js", "function", "broken")].line_end == 3          # never closed: ends with the file
    assert s[("long.js", "function", "long")].line_end == 602          # however far away the end is
    assert not [k for k in s if k[0] in ("m.md", "n.lua", "e.py")]


def test_imports_exports(ext):
    e = xt.extracted(ext)
    got = {(r.path, r.source): (r.specifiers, r.line) for r in xt.imports(e).collect()}
    assert got[("p.py", "os")] == (["os"], 1) and got[("p.py", "sys")] == (["system"], 1)
    assert got[("p.py", "pkg.mod")] == (["a", "b"], 2)
    assert got[("j.js", "./lib")] == (["x", "y"], 1) and got[("j.js", "zed")] == (["z"], 2)
    assert ("o.php", "O") in got                                         # the alias is the last group
    assert [r.name for r in xt.exports(e).where("path = 'j.js'").orderBy("seq").collect()] == ["go", "p", "s"]


def test_user_rule_and_methods(ext):
    s = symbols(ext, extra_rules={"function": {"lua": [Rule(r"function\s+(\w+)\s*\(([^)]*)\)", params=2)]}})
    assert s[("n.lua", "function", "f")].params == ["x"]
    filled = {(r.path, r.name): r.methods for r in xt.with_methods(xt.symbols(xt.extracted(ext))).where("kind = 'class'").collect()}
    assert filled[("A.java", "A")] == ["add"] and filled[("p.py", "Child")] == ["go"]


def test_nodes_first_definition_wins(spark):
    files = spark.createDataFrame([("r", "d.js", "javascript", "function a(x) {\n}\nfunction a(y, z) {\n}\nclass a {\n}\n")],
                                  "repo_id string, path string, language string, content string")
    u = build.units(files)
    n = build.nodes(u).orderBy("ord").collect()
    assert [(r.type, r.name) for r in n] == [("file", "d.js"), ("function", "a")]
    assert n[1].summary.startswith("Function (x)")
    assert build.contains_edges(u).count() == 1


def test_complexity_terms(spark):
    rows = [("python", "def f(a):\n    if a:\n        return f(a)\n", 3), ("javascript", "function g(a,b,c,d,e) { if (a) { return a ? b : c } }", 1),
            ("php", "}{ {", 1), ("cobol", "if x\n", 1)]
    df = spark.createDataFrame(rows, "lang string, src string, n int")
    s, lang = F.col("src"), F.col("lang")
    got = df.select(cp.branches(s, lang), cp.nesting(s, lang), cp.recursion_term(s), cp.ternary_term(s), cp.max_params(s, lang)).collect()
    assert [tuple(r) for r in got] == [(1, 2, 2.0, 0.0, 1), (2, 2, 0.0, 0.5, 5), (0, 2, 0.0, 0.0, 0), (1, 0, 0.0, 0.0, 0)]
    by_lines = spark.createDataFrame([("", "python", n) for n in (30, 31, 150, 151)], "src string, lang string, n int")
    assert [r.complexity for r in cp.with_complexity(by_lines, "src", "lang", "n").orderBy("n").collect()] == ["simple", "moderate", "moderate", "complex"]


def test_match_mark_in_the_text(spark):
    plain = "// c\nfunction one(a) {\n}\nclass Two {\n}\n"
    rows = [("r", "a.js", "javascript", plain), ("r", "b.js", "javascript", plain.replace("// c", "// ﷐c"))]
    s = symbols(spark.createDataFrame(rows, "repo_id string, path string, language string, content string"))
    assert {k[1:]: (v.line_start, v.line_end) for k, v in s.items() if k[0] == "a.js"} == {k[1:]: (v.line_start, v.line_end) for k, v in s.items() if k[0] == "b.js"}


def ends(language, code, extra=None):
    """(name, first line, last line) of every symbol of one text."""
    hits = lexer.Scan([code], [language], xt.rule_rows(extra)).hits[0]
    return [(h["name"], h["line"], h["end"]) for h in hits if h["family"] in ("function", "class")]


@pytest.mark.parametrize("language,code,want", [
    ("javascript", "function a() {\n b { }\n}\nc\n", [("a", 1, 3)]),
    ("javascript", "} function f() {\nx\n}\n", [("f", 1, 3)]),
    ("javascript", "function f() {\n  var s = \"{\"; // {\n  /* {\n */ var t = '{', u = `{\n`\n}\nfunction g() {\n}\n", [("f", 1, 6), ("g", 7, 8)]),
    ("javascript", "const f = (x) =>\n  x + 1\nfunction g() {\n}\n", [("g", 3, 4), ("f", 1, 2)]),
    ("javascript", "const f = (x) => ({\n  a: 1\n})\nconst g = async (y) => {\n}\n", [("f", 1, 3), ("g", 4, 5)]),
    ("javascript", "function open(a) {\n  if (a) {\n", [("open", 1, 3)]),
    ("javascript", "function f({a, b} = {}) {\n}\n", [("f", 1, 2)]),
    ("javascript", "// class of things\nclass A {\n}\n", [("of", 1, 1), ("A", 2, 3)]),
    ("typescript", "function f(a: string): void;\nfunction f(a: any) {\n  return `${a}}`\n}\n", [("f", 1, 1), ("f", 2, 4)]),
    ("java", "class A {\n  /** } */\n  public char f(int x) {\n    return '}';\n  }\n}\n", [("f", 2, 5), ("A", 1, 6)]),
    ("kotlin", "class A(val x: Int)\nfun f() = 1\nfun g() {\n  val s = \"\"\"{\n\"\"\"\n}\n", [("f", 2, 2), ("g", 3, 6), ("A", 1, 1)]),
    ("rust", "pub struct S;\nfn f<'a>(x: [u8; 4]) -> &'a str {\n  r#\"{\"#\n}\n", [("f", 2, 4), ("S", 1, 1)]),
    ("csharp", "class A {\n  public int F() {\n    var s = @\"c:\\{\";\n  }\n}\n", [("F", 1, 5), ("A", 1, 5)]),
    ("go", "func f(a []int) int {\n  s := `{\n`\n  return 1\n}\ntype T struct {\n}\n", [("f", 1, 5), ("T", 6, 7)]),
    ("php", "<?php\ninterface I {\n  public function a();\n  public function b() { # }\n  }\n}\n", [("a", 2, 6), ("b", 3, 5)]),
    ("swift", "protocol P {\n  func a()\n}\nfunc b() {\n  print(\"}\")\n}\n", [("a", 2, 2), ("b", 4, 6), ("P", 1, 3)]),
    ("ruby", "class A\n  def b\n\n    c\n  end\nend\n", [("b", 2, 4), ("A", 1, 5)]),
    ("python", "def a(x=f(g(h(k(1))))):\n    return {\n1: 2}\n\nclass B(C[D[E[F[G]]]], H):\n    def m[T: (int, str)](self) -> Dict[\n      str]:\n        \"\"\"x\ny\"\"\"\n\ny = 1\n",
     [("a", 1, 3), ("B", 5, 9), ("m", 6, 9)]),
    ("python", "def a(", []), ("javascript", "", []), ("cobol", "function f() {}", []),
])
def test_ends(language, code, want):
    assert ends(language, code) == want


@given(st.lists(st.text("(){}[]\na ", max_size=30), min_size=1, max_size=6))
@hyp(max_examples=300, deadline=None)
def test_brackets_brute_force(texts):
    starts = np.append(0, np.cumsum([len(t) for t in texts]))
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    for open_, close in ("()", "[]", "{}"):
        got, want = lexer.brackets(chars, starts, open_, close), {}
        for base, text in zip(starts, texts):
            stack = []
            for i, c in enumerate(text):
                if c == open_:
                    stack.append(base + i)
                elif c == close and stack:
                    want[stack.pop()] = base + i
        assert {a: p for a, o, p in zip(got.at, got.opens, got.pair) if o and p >= 0} == want


def test_deep_brackets():
    deep = 100_000
    code = "def f(x=" + "(" * deep + ")" * deep + "):\n    pass\n"
    assert ends("python", code) == [("f", 1, 2)]
    assert ends("javascript", "function f() {\n" + "{" * deep + "\n" + "}" * deep + "\n}\nfunction g() {\n}") == [("f", 1, 4), ("g", 5, 6)]


def test_batches_do_not_mix():
    codes = ["function a() {\n", "}\nfunction b() {\n}\n", "", "def c(x):\n  (\n", "def d(y):\n  return 1)\n"]
    langs = ["javascript", "javascript", "javascript", "python", "python"]
    together = [[{k: h[k] for k in ("name", "line", "end")} for h in own] for own in lexer.Scan(codes, langs, xt.rule_rows()).hits]
    alone = [[{k: h[k] for k in ("name", "line", "end")} for h in lexer.Scan([c], [lang], xt.rule_rows()).hits[0]] for c, lang in zip(codes, langs)]
    assert together == alone
