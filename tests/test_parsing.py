"""The readers of languages with braces: every definition of sources with nested brackets, types with braces, literals that hold brackets, and odd lay-out."""

import time

import pytest

from quarry.operators import parsing
from quarry.plans import samples

JAVA, SCRIPT, TYPED, GO, RUST, C = (x.replace("{id}", "") for x in (samples.JAVA, samples.SCRIPT, samples.TYPED, samples.GO, samples.RUST, samples.C))


def functions(source, language, *more):
    return [tuple(e[parsing.FIELDS.index(k)] for k in ("qualified_name", *more)) for e in parsing.parse("x", source, language) if e[1] == "function"]


def names(source, language, kind="function"):
    return [e[3] for e in parsing.parse("x", source, language) if e[1] == kind]


def test_java():
    assert functions(JAVA, "Java", "params", "calls") == [
        ("A.A", ["x"], []), ("A.A", [], ["this"]), ("A.go", ["id", "rest"], ["run"]), ("A.end", [], ["stop"]), ("A.max", ["all"], ["first"]), ("A.deep", [], []), ("A.array", ["a", "c"], ["made"]), ("A.later", ["a"], []),
        ("A.Kind.Kind", ["n"], []), ("A.Kind.show", [], ["name"]), ("A.Inner.must", [], []), ("A.Inner.may", [], []), ("A.Point.Point", [], ["check"]), ("A.Point.sum", [], []), ("A.Note.value", [], []),
    ]
    assert names(JAVA, "Java", "class") == ["A", "A.Kind", "A.Inner", "A.Point", "A.Note"] and names(JAVA, "Java", "import") == ["java.util.*", "java.lang.Math.max"]
    got = {e[3]: e for e in parsing.parse("x", JAVA, "Java")}
    at = {f: i for i, f in enumerate(parsing.FIELDS)}
    assert got["A.go"][at["types"]] == ["String", "final int..."] and got["A.go"][at["details"]] == ['@GetMapping("/x")'] and got["A.max"][at["returns"]] == "U"
    assert got["A"][at["details"]] == ["Base<T>", "I", "J<String>"] and got["A.array"][at["types"]] == ["int[]", "char"]
    assert got["A.end"][at["body"]] == 'public void end() { stop("}"); }' and "constructor" in got["A.A"][at["flags"]]


def test_javascript():
    assert functions(SCRIPT, "JavaScript", "params", "calls") == [
        ("A.handle", ["e"], ["go"]), ("A.re", [], ["test"]), ("A.go", ["a", "{ c, d }", "...rest"], ["run"]), ("A.size", [], ["one"]), ("A.walk", [], ["two"]), ("A.quoted name", [], []), ("A.load", [], ["inner", "deep"]), ("B.only", [], []),
        ("add", ["a", "b"], ["plus"]), ("one", ["x"], []), ("late", ["q"], ["fetchIt"]), ("top", ["{ a, b }"], ["low", "nested"]), ("nested", [], ["low"]), ("gen", [], []), ("get", ["url"], ["call"]), ("post", ["u"], []),
    ]
    assert names(SCRIPT, "JavaScript", "class") == ["A", "B"] and names(SCRIPT, "JavaScript", "import") == ["react", "./side.css", "fs"]
    got = {e[3]: e for e in parsing.parse("x", SCRIPT, "JavaScript")}
    at = {f: i for i, f in enumerate(parsing.FIELDS)}
    assert got["react"][at["details"]] == ["React", "useState", "T"] and got["A"][at["details"]] == ["B.C"] and got["A.go"][at["defaults"]] == ["f({ b: 1 })", "{}", ""]
    assert got["top"][at["flags"]] == ["async"] and got["A.walk"][at["flags"]] == ["method", "static", "async"] and got["A.handle"][at["flags"]] == ["method", "async"]


def test_typescript():
    assert functions(TYPED, "TypeScript", "params", "calls") == [
        ("P.constructor", ["x", "y"], ["super"]), ("P.get", ["id"], ["get"]), ("P.cb", ["x"], ["show"]), ("P.over", ["a"], ["pick"]), ("P.must", [], []), ("P.is", ["x"], ["test"]), ("P.fn", ["cb"], []),
        ("area", ["s", "k"], ["calc"]), ("f", ["x"], ["g"]),
    ]
    assert names(TYPED, "TypeScript", "class") == ["Shape", "Kind", "P"] and names(TYPED, "TypeScript", "import") == ["./x"]
    got = {e[3]: e for e in parsing.parse("x", TYPED, "TypeScript")}
    at = {f: i for i, f in enumerate(parsing.FIELDS)}
    assert got["P.get"][at["returns"]] == "Promise<{ a: number; b: string[] }>" and got["P.constructor"][at["types"]] == ["X", "Map<string, { z: number }>"]
    assert got["area"][at["types"]] == ["Shape", "Kind"] and got["area"][at["defaults"]] == ["", "Kind.A"] and got["P.fn"][at["defaults"]] == ["() => {}"] and got["P"][at["details"]] == ["Q<T>", "I"]


def test_go():
    assert functions(GO, "Go", "params", "calls") == [
        ("S.Get", ["a", "b", "opt"], ["load"]), ("T.Put", ["k"], ["keep"]), ("New", ["x", "f"], ["inner", "make1"]), ("Chan", [], ["open"]), ("Fn", [], []), ("raw", [], ["Sprint"]), ("external", ["x"], []), ("main", [], ["run"]),
    ]
    assert names(GO, "Go", "class") == ["S", "T", "I"] and names(GO, "Go", "import") == ["fmt", "math/big", "os"]
    got = {e[3]: e for e in parsing.parse("x", GO, "Go")}
    at = {f: i for i, f in enumerate(parsing.FIELDS)}
    assert got["S.Get"][at["types"]] == ["int", "int", "...string"] and got["S.Get"][at["returns"]] == "interface{}" and got["T.Put"][at["returns"]] == "(map[string]struct{}, error)"


def test_rust():
    assert functions(RUST, "Rust", "params", "calls") == [
        ("deep", ["x"], []), ("T.d", ["&self"], ["low"]), ("T.need", ["&self"], []), ("P.new", ["a", "f"], ["make"]), ("Q.show", ["&self"], ["other"]), ("P.drop", ["&mut self"], ["end"]), ("three", [], []), ("raw", ["p"], ["get"]),
        ("main", [], ["under", "new"]), ("nested", [], ["under"]),
    ]
    assert names(RUST, "Rust", "class") == ["P", "E", "T"] and names(RUST, "Rust", "import") == ["std", "crate::a::b"]
    got = {e[3]: e for e in parsing.parse("x", RUST, "Rust")}
    at = {f: i for i, f in enumerate(parsing.FIELDS)}
    assert got["P.new"][at["returns"]] == "Result<P<T>, Box<dyn Error>>" and got["P"][at["details"]] == ["#[derive(Debug, Clone)]"] and got["std"][at["details"]] == ["fs", "io::Read"]


def test_c():
    assert functions(C, "C++", "params", "calls") == [
        ("V.V", ["x"], ["init"]), ("V.~V", [], ["free1"]), ("V.size", [], ["one"]), ("V.operator==", ["o"], ["eq"]), ("V.In.deep", [], []), ("V.V", ["t"], ["made"]), ("V.run", ["c", "argv"], ["go"]),
        ("g", ["cb", "a"], ["cb", "h"]), ("make_node", [], ["f"]), ("wide", ["m", ""], ["size"]), ("trail", ["a"], []), ("main", ["argc", "argv"], ["run"]),
    ]
    assert names(C, "C++", "class") == ["V", "V.In", "Node", "Color"] and names(C, "C++", "import") == ["vector", "own.h"]
    got = {e[3]: e for e in parsing.parse("x", C, "C++")}
    at = {f: i for i, f in enumerate(parsing.FIELDS)}
    assert got["x"][at["attributes"]] == ["LIMIT", "SQUARE"] and got["V"][at["details"]] == ["W<T>", "X"] and got["V"][at["flags"]] == ["abstract"] and got["V.run"][at["returns"]] == "int"


def test_python():
    source = "class A:\n    def __init__(self, a: int, *b, c=1, **d) -> None: pass\n    def __secret(self): pass\n    @classmethod\n    def make(cls, x='}'): return cls(x)\n"
    assert functions(source, "Python", "flags", "types", "defaults", "returns") == [
        ("A.__init__", ["method", "constructor"], ["", "int", "", "", ""], ["", "", "", "1", ""], "None"), ("A.__secret", ["method", "private"], [""], [""], None), ("A.make", ["method", "static"], ["", ""], ["", "'}'"], None),
    ]
    broken = "import os\ndef good(a):\n    return call(a)\nclass B:\n    def m(self): return go()\ndef bad(:\n    x = (\ndef after(): return last()\n"
    assert [x[:2] for x in functions(broken, "Python", "calls")] == [("good", ["call"]), ("B.m", ["go"]), ("bad", []), ("after", ["last"])]
    assert [e[5] for e in parsing.parse("x.py", broken, "Python") if e[1] == "function"] == [2, 5, 6, 8]


@pytest.mark.parametrize("language", parsing.GRAMMARS)
def test_hostile_texts(language):
    """Unbalanced, cut and strange texts give rows or none, in time that grows as the text."""
    for text in (JAVA, SCRIPT, TYPED, GO, RUST, C):
        for cut in range(0, len(text), 97):
            parsing.parse("x", text[:cut], language)
            parsing.parse("x", text[cut:], language)
    for odd in ("{" * 50_000, "}" * 50_000, "(<[{" * 9000, "a(" * 20_000, "\n".join(["x <"] * 20_000), "class A {\n" * 5000, '"' * 5001, "`${" * 9000, "'" * 5001, "/*" * 9000, "é" * 3000, "fn a(b: C<D> {\n" * 3000, "@a\n" * 5000, "#" * 3000, "a::" * 9000):
        began = time.perf_counter()
        parsing.parse("x", "\n".join(odd[i : i + 8000] for i in range(0, len(odd), 8000)), language)
        assert time.perf_counter() - began < 12, (language, odd[:20])


def test_time_limit(spark):
    """A file that takes too long is an error, and its neighbours keep their entities."""
    files = spark.createDataFrame([("a.js", "function a() { b(); }"), ("slow.js", "function a() { b(); }\n" * 100_000), ("c.py", "def c(): pass")], "path string, content string").coalesce(1)
    got = {(r.path, r.kind, r.name) for r in parsing.parse_files(files, 0.3).collect()}
    assert got == {("a.js", "function", "a"), ("slow.js", "error", "time"), ("c.py", "function", "c")}


def test_python_too_deep_for_the_parsers_stack(spark):
    deep = "def before(): return go()\nx = " + "-" * 9000 + "1\ndef after(): return last()\n"
    with pytest.raises(MemoryError):
        __import__("ast").parse(deep)
    found = parsing.parse("x", deep, "Python")
    assert [e[3] for e in found] == ["before", "after", "syntax"] and [e[5] for e in found] == [1, 3, 1]
    rows = parsing.parse_files(spark.createDataFrame([("a.py", deep), ("b.py", 'def f():\n    "half \\ud800"\n')], "path string, content string")).collect()
    assert sorted((r.path, r.kind, r.docstring) for r in rows) == [("a.py", "error", None), ("a.py", "function", None), ("a.py", "function", None), ("b.py", "function", "half \\ud800")]


def test_entities_leave_before_a_batch_is_read(monkeypatch):
    import pyarrow as pa

    read, parse = [], parsing.parse
    monkeypatch.setattr(parsing, "parse", lambda path, *rest: read.append(path) or parse(path, *rest))
    n = 10 * parsing.FILES
    batch = pa.RecordBatch.from_arrays([pa.array([f"{i}.py" for i in range(n)]), pa.array(["def f(): pass\n"] * n), pa.array(["Python"] * n), pa.array(["sha"] * n)], ["path", "content", "language", "sha"])
    out = parsing.parsed(iter([batch]), 30)
    first = next(out)
    assert first.num_rows == len(read) == parsing.FILES
    assert first.num_rows + sum(b.num_rows for b in out) == n
