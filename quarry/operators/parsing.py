"""Sources to entities: p01-p11.

Python is read with its own grammar, a file that doesn't compile statement by statement; languages with braces by grammar.Reader; others, and Python statements that don't compile, by patterns for
definitions and imports. Each file is parsed on its own in its task, in time that grows as its text, so parsing scales with files; a file that is empty or minified gives no
entity, one that fails or takes too long an entity of kind `error`, and its neighbours keep theirs.
"""

from __future__ import annotations

import ast
import re
import signal
import threading
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import config
from quarry.operators import rules
from quarry.operators.filters import language, truncated_body
from quarry.operators.grammar import Reader, lines_of

SCHEMA = "path string, kind string, name string, qualified_name string, parent string, line int, end_line int, params array<string>, details array<string>, calls array<string>, flags array<string>, docstring string, attributes array<string>, types array<string>, defaults array<string>, returns string, body string, sha string"
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]
KINDS = [{"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}[f.split()[1]] for f in SCHEMA.split(", ")]
BODY = FIELDS.index("body")
#: Files that are read before their entities leave the task, and characters of bodies that do before that.
FILES, HELD = 64, 1 << 20

#: Of other languages: patterns of functions, classes and imports; the first group names the entity.
PATTERNS = {
    "function": r"^\s*(?:def|function|func|fn|sub|fun)\s+(\w+)",
    "class": r"^\s*(?:class|struct|interface|trait|module)\s+(\w+)",
    "import": r"""^\s*(?:import|require|include|use)\s+['"]?([\w./:-]+)""",
}
#: A statement of the outermost level begins; strings over several lines are met first.
_STATEMENT = re.compile(r"""(\"{3}|'{3})(?:\\.|.)*?\1|^(?=[^\s#)\]}])""", re.M | re.S)
#: What Python's parser raises on a text that it can't read; a MemoryError says that its stack of fixed size is full.
UNREADABLE = (SyntaxError, ValueError, RecursionError, MemoryError)
GRAMMARS = ("JavaScript", "TypeScript", "Java", "Go", "Rust", "C", "C++")

Entity = tuple


def _entity(path, kind, name, qualified, parent, line, end, params=(), details=(), calls=(), flags=(), docstring=None, attributes=(), types=(), defaults=(), returns=None, body=None) -> Entity:
    if docstring:  # halves of surrogate pairs, which a literal may hold, aren't UTF-8
        docstring = docstring.encode("utf-8", "backslashreplace").decode()
    return (path, kind, name, qualified, parent, line, end, list(params), list(details), list(calls), list(flags), docstring, list(attributes), list(types), list(defaults), returns, body)


def _targets(node: ast.AST) -> list[ast.AST]:
    """What a statement assigns to."""
    return node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []


def _dotted(node: ast.AST) -> str:
    return ast.unparse(node)


class _PythonReader(ast.NodeVisitor):
    """Entities of one module; a stack of classes and functions gives qualified names."""

    def __init__(self, path: str, source: str = "") -> None:
        self.path, self.classes, self.found, self.conditional, self.lines = path, [], [], 0, source.split("\n")

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        qualified = ".".join([*self.classes, node.name])
        members = [n.name for n in node.body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
        flags = ["abstract"] * any("ABC" in _dotted(b) for b in node.bases)
        held = [t.id for n in node.body for t in _targets(n) if isinstance(t, ast.Name)]
        made = [n for n in node.body if isinstance(n, ast.FunctionDef) and n.name == "__init__"]
        own = [t.attr for f in made for n in f.body for t in _targets(n) if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self"]
        self.found.append(_entity(self.path, "class", node.name, qualified, ".".join(self.classes) or None, node.lineno, node.end_lineno, members, map(_dotted, node.bases), flags=flags, docstring=ast.get_docstring(node), attributes=dict.fromkeys(held + own)))
        self.classes.append(node.name)
        self.generic_visit(node)
        self.classes.pop()

    def _function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        a, parent, name = node.args, ".".join(self.classes) or None, node.name
        plain = [*a.posonlyargs, *a.args]
        starred = lambda p, stars: [(p, None, stars)] if p else []
        params = [*zip(plain, [None] * (len(plain) - len(a.defaults)) + a.defaults, [""] * len(plain), strict=True), *starred(a.vararg, "*")]
        params += [*((p, d, "") for p, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)), *starred(a.kwarg, "**")]
        decorators = [_dotted(d) for d in node.decorator_list]
        private = name.startswith("_") and not (len(name) > 4 and name.startswith("__") and name.endswith("__"))
        flags = [f for f, on in (("method", parent), ("constructor", parent and name == "__init__"), ("private", private), ("static", {"staticmethod", "classmethod"} & {*decorators}), ("async", isinstance(node, ast.AsyncFunctionDef))) if on]
        calls = dict.fromkeys(_dotted(n.func).split(".")[-1] for n in ast.walk(node) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name | ast.Attribute))
        self.found.append(_entity(
            self.path, "function", name, ".".join([*self.classes, name]), parent, node.lineno, node.end_lineno, [f"{stars}{p.arg}" for p, _, stars in params], decorators, calls, flags, ast.get_docstring(node),
            types=[_dotted(p.annotation) if p.annotation else "" for p, _, _ in params], defaults=[_dotted(d) if d else "" for _, d, _ in params], returns=_dotted(node.returns) if node.returns else None,
            body="\n".join(self.lines[node.lineno - 1 : node.end_lineno]),
        ))
        self.generic_visit(node)

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_Lambda(self, node: ast.Lambda) -> None:
        name = f"lambda_line_{node.lineno}"
        self.found.append(_entity(self.path, "function", name, name, None, node.lineno, node.end_lineno, [p.arg for p in node.args.args], flags=["lambda"]))
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.found.append(_entity(self.path, "import", a.name, a.asname or a.name, None, node.lineno, node.end_lineno, flags=["absolute"] + ["conditional"] * bool(self.conditional)))

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        module = "." * node.level + (node.module or "")
        self.found.append(_entity(self.path, "import", module, module, None, node.lineno, node.end_lineno, details=[a.name for a in node.names], flags=["relative" if node.level else "absolute"] + ["conditional"] * bool(self.conditional)))

    def _branch(self, node: ast.AST) -> None:
        self.conditional += 1
        self.generic_visit(node)
        self.conditional -= 1

    visit_If = visit_Try = _branch


def parse_python(path: str, source: str) -> list[Entity]:
    reader = _PythonReader(path, source)
    tree = ast.parse(source)
    text, held = ast.get_docstring(tree), [t.id for n in tree.body for t in _targets(n) if isinstance(t, ast.Name)]
    if text or held:
        reader.found.append(_entity(path, "module", path, path, None, 1, 1, docstring=text, attributes=dict.fromkeys(held)))
    reader.visit(tree)
    return reader.found


def parse_statements(path: str, source: str) -> list[Entity]:
    """Entities of Python that doesn't compile: each statement of the outermost level by the grammar if it does by itself, else by patterns."""
    found, line = [], 0
    starts = [m.start() for m in _STATEMENT.finditer(source) if not m[0]]
    for start, end in zip([0, *starts], [*starts, len(source)], strict=True):
        part = source[start:end]
        try:
            reader = _PythonReader(path, part)
            tree = ast.parse(part)
            reader.visit(tree)
            own = reader.found
        except UNREADABLE:
            own = parse_patterns(path, part)
        found += [(*e[:5], e[5] + line, e[6] + line, *e[7:]) for e in own]
        line += part.count("\n")
    return found


def parse_patterns(path: str, source: str) -> list[Entity]:
    """Entities by the generic patterns, each name of a kind once; an indented function belongs to the class above it."""
    line, starts = lines_of(source), []
    for kind, pattern in PATTERNS.items():
        names: dict[str, re.Match] = {}
        for m in re.finditer(pattern, source, re.M):
            names.setdefault(m[1], m)
        starts += [(m.start() + len(m[0]) - len(m[0].lstrip()), kind, name, m) for name, m in names.items()]
    starts.sort(key=lambda x: x[:2])
    own = [at for at, kind, _, _ in starts if kind != "import"]
    ends = dict(zip(own, [*own[1:], len(source)], strict=False))
    out, above = [], None
    for at, kind, name, m in starts:
        first = line(at)
        if kind == "import":
            out.append(_entity(path, kind, name, name, None, first, first, flags=["relative" if name.startswith(".") else "absolute"]))
        elif kind == "class":
            above = name
            out.append(_entity(path, kind, name, name, None, first, first, flags=["interface"] * m[0].lstrip().startswith(("interface", "trait"))))
        else:
            owner = above if m[0].lstrip("\n")[:1].isspace() else None
            body = source[at : ends[at]]
            flags = [flag for flag, on in (("method", owner), ("private", name.startswith("_"))) if on]
            calls = dict.fromkeys(re.findall(r"([^\W\d]\w*)\s*\(", body[m.end() - at :]))
            out.append(_entity(path, kind, name, f"{owner}.{name}" if owner else name, owner, first, line(ends[at]), calls=calls, flags=flags, body=body))
    return out


def parse_grammar(path: str, source: str, language: str) -> list[Entity]:
    """Entities of a language with braces."""
    reader, line, out = Reader(source, language), lines_of(source), []
    if reader.macros:
        out.append(_entity(path, "module", path, path, None, 1, 1, attributes=dict.fromkeys(reader.macros)))
    for x in reader.found:
        first, last, name = line(x.start), line(max(x.start, x.end - 1)), x.name
        if x.kind == "import":
            out.append(_entity(path, "import", name, name, None, first, last, details=x.bases, flags=["relative" if name.startswith(".") or "local" in x.words else "absolute"]))
            continue
        qualified = f"{x.owner}.{name}" if x.owner else name
        if x.kind == "class":
            flags = [flag for flag, on in (("abstract", "abstract" in x.words), ("interface", {"interface", "trait"} & {*x.words}), ("enum", "enum" in x.words)) if on]
            out.append(_entity(path, "class", name, qualified, x.owner or None, first, last, details=x.marks if language == "Rust" else x.bases, flags=flags))
            continue
        flags = [
            flag for flag, on in (
                ("method", x.owner), ("constructor", x.owner and name in ("constructor", x.owner.split(".")[-1])), ("private", {"private", "protected"} & {*x.words} or name.startswith(("_", "#"))),
                ("static", "static" in x.words), ("async", "async" in x.words), ("abstract", "abstract" in x.words),
            ) if on
        ]
        out.append(_entity(path, "function", name, qualified, x.owner or None, first, last, [p.name for p in x.params], x.marks, x.calls, flags, types=[p.type for p in x.params], defaults=[p.default for p in x.params], returns=x.returns or None, body=source[x.start : x.end]))
    return out


class TooLong(Exception):
    """A file took longer than it may."""


@contextmanager
def time_limit(seconds: float) -> Iterator[None]:
    """Ends what is inside after so many seconds, where the system has alarms and this is the process's main thread, as in Spark's workers."""
    if threading.current_thread() is not threading.main_thread() or not hasattr(signal, "setitimer"):
        yield
        return

    def ring(*_) -> None:
        raise TooLong

    before = signal.signal(signal.SIGALRM, ring)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def parse(path: str, source: str, language: str | None, seconds: float = config.PARSE_SECONDS) -> list[Entity]:
    """A file's entities, by the parser of its language."""
    if not source or max(map(len, source.split("\n"))) > config.MINIFIED_LINE_CHARS:
        return []
    try:
        with time_limit(seconds):
            if language in GRAMMARS:
                return parse_grammar(path, source, language)
            if language != "Python":
                return parse_patterns(path, source)
            try:
                return parse_python(path, source)
            except UNREADABLE:
                return [*parse_statements(path, source), _entity(path, "error", "syntax", "syntax", None, 1, 1)]
    except TooLong:
        return [_entity(path, "error", "time", "time", None, 1, 1)]
    except RecursionError:
        return [_entity(path, "error", "depth", "depth", None, 1, 1)]


def parsed(batches: Iterator[pa.RecordBatch], seconds: float, columns: list[str] = FIELDS) -> Iterator[pa.RecordBatch]:
    """Entities of batches (path, content, language, sha), a few files at a time: what is held is a batch as it came, and FILES files or HELD characters of bodies."""
    rows, held, own = [], 0, [FIELDS.index(c) for c in columns]

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], KINDS[i]) for i in own], columns)

    for batch in batches:
        for at in range(0, batch.num_rows, FILES):
            for path, content, name, sha in zip(*(c.to_pylist() for c in batch.slice(at, FILES).columns), strict=True):
                for e in parse(path, content, name, seconds):
                    rows.append((*e, sha))
                    held += len(e[BODY] or "")
                    if held >= HELD:
                        yield out()
                        rows, held = [], 0
            if rows:
                yield out()
                rows, held = [], 0


def parse_files(files: DataFrame, seconds: float = config.PARSE_SECONDS, columns: list[str] = FIELDS) -> DataFrame:
    """Entities of files (path, content), stamped with their content's SHA-256; the language is that of the extension. Of an entity, only the columns that are asked for leave its task."""
    content = F.coalesce("content", F.lit(""))
    rows = files.select("path", content.alias("content"), language(F.col("path")).alias("language"), (F.sha2(content, 256) if "sha" in columns else F.lit("")).alias("sha"))
    return rows.mapInArrow(lambda batches: parsed(batches, seconds, columns), ", ".join(f for f in SCHEMA.split(", ") if f.split()[0] in columns))


def tables_of(entities: DataFrame) -> dict[str, DataFrame]:
    """file_path of each row of the tables of functions, classes, imports and errors, where no other column is asked for."""
    return {kind: entities.where(F.col("kind") == kind).select(F.col("path").alias("file_path")) for kind in ("function", "class", "import", "error")}


def errors_of(entities: DataFrame) -> DataFrame:
    return entities.where("kind = 'error'").select(F.col("path").alias("file_path"), F.col("name").alias("error"), "sha")


def functions_of(entities: DataFrame) -> DataFrame:
    return entities.where("kind = 'function'").select(F.col("path").alias("file_path"), "name", "qualified_name", "parent", "line", "end_line", "params", "types", "defaults", "returns", F.col("details").alias("decorators"), "calls", "flags", "docstring", truncated_body(F.col("body")).alias("body"), rules.complexity(F.coalesce("body", F.lit("")), language(F.col("path"))).alias("complexity"), "sha")


def classes_of(entities: DataFrame) -> DataFrame:
    return entities.where("kind = 'class'").select(F.col("path").alias("file_path"), "name", "qualified_name", "line", "end_line", F.col("params").alias("methods"), F.col("details").alias("bases"), "attributes", "flags", "docstring", "sha")


def imports_of(entities: DataFrame) -> DataFrame:
    return entities.where("kind = 'import'").select(F.col("path").alias("file_path"), F.col("name").alias("module"), F.col("details").alias("items"), "line", "flags", "sha")
