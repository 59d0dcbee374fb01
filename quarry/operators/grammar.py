"""Definitions of languages with braces (p03-p08): a lexer and a pushdown reader.

The lexer knows strings, comments, template and regular-expression literals and preprocessor lines, and pairs brackets of all kinds; a closing bracket ends what is
open inside it. The readers then follow each language's declarations: they jump over brackets, types and generics as wholes, so neither defaults, decorators, types with braces nor line
breaks end a definition early. Both take time in proportion to the text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

_PLAIN = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_DOUBLE, _SINGLE = r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'"
_CHAR = r"'(?:\\[^'\n]+|[^'\\\n])'"
#: Comments, then strings, of each language.
_QUOTES = {
    "JavaScript": [_DOUBLE, _SINGLE], "TypeScript": [_DOUBLE, _SINGLE], "Java": [r'"""(?:\\.|.)*?"""', _DOUBLE, _CHAR], "Go": [_DOUBLE, r"`[^`]*`", _CHAR],
    "Rust": [r'b?r(#*)".*?"\1', rf"b?{_DOUBLE.replace(chr(92) + 'n', '')}", rf"b?{_CHAR}", r"'[^\W\d]\w*"], "C": [_DOUBLE, _CHAR], "C++": [r'R"(\w*)\(.*?\)\1"', _DOUBLE, _CHAR],
}
_WORD, _NUMBER, _SIGN = r"(?:[^\W\d]|\$)[\w$]*", r"\d(?:\w|\.\d)*", r"=>|->|::|\.\.\.|:=|&&|\|\||\?\?|\?\.|==|!=|<=|\S"
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
_TEMPLATE = re.compile(r"(?:\\.|(?!\$\{)[^`\\])*(`|\$\{)?", re.S)
_LEXERS = {
    name: re.compile("|".join([f"(?P<skip>{_PLAIN})", *([r"(?P<line>^[ \t]*#(?:\\\n|[^\n])*)"] if name.startswith("C") else []), f"(?P<text>{'|'.join(quotes)})", f"(?P<word>{'#?' if name.endswith('Script') else ''}{_WORD})", f"(?P<number>{_NUMBER})", f"(?P<sign>{_SIGN})"]), re.S | re.M)
    for name, quotes in _QUOTES.items()
}
#: After these a slash begins a regular expression.
_BEFORE_REGEX = set("(,=:[!&|?{};+-*%~^>") | {"=>", "&&", "||", "??", "==", "!=", "<=", "...", "return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do"}
_OPEN = {"(": ")", "[": "]", "{": "}"}
_CLOSE = {v: k for k, v in _OPEN.items()}
NO_CALLS = {"if", "for", "while", "switch", "catch", "return", "function", "func", "fn", "match", "sizeof", "else", "do", "throw", "typeof", "await", "in", "with", "synchronized", "case", "decltype", "alignof", "import"}
_JS_MODIFIERS = {"public", "private", "protected", "static", "async", "override", "readonly", "abstract", "get", "set", "declare", "accessor"}
_JAVA_MODIFIERS = {"public", "private", "protected", "static", "final", "abstract", "synchronized", "default", "native", "sealed", "strictfp", "transient", "volatile"}
_RUST_MODIFIERS = {"pub", "async", "const", "unsafe", "extern", "default"}


class Parameter(NamedTuple):
    name: str
    type: str = ""
    default: str = ""


class Found(NamedTuple):
    """A definition or an import: places in the text, and what it says of itself."""

    kind: str
    name: str
    owner: str
    start: int
    end: int
    body: tuple[int, int]
    words: tuple[str, ...] = ()
    marks: tuple[str, ...] = ()
    params: tuple[Parameter, ...] = ()
    returns: str = ""
    bases: tuple[str, ...] = ()
    calls: tuple[str, ...] = ()


class Tokens:
    """The tokens of a text: kind, tok (its text), at and end (its place), shut (for an opening bracket, the one that closes it)."""

    def __init__(self, text: str, language: str) -> None:
        self.text, self.kind, self.tok, self.at, self.end = text, [], [], [], []
        self._lex(language)
        self.n = len(self.tok)
        self.shut, self.past = self._paired(), self._angles()
        self.tok += [""] * 4  # so that readers may look past the end
        self.kind += [""] * 4

    def _add(self, kind: str, tok: str, at: int) -> None:
        self.kind.append(kind)
        self.tok.append(tok)
        self.at.append(at)
        self.end.append(at + len(tok))

    def _lex(self, language: str) -> None:
        lexer, scripted, text = _LEXERS[language], language.endswith("Script"), self.text
        kinds, toks, places, ends = self.kind, self.tok, self.at, self.end
        open_now: list[bool] = []  # braces, true for those of templates
        start: int | None = 0
        while start is not None:
            for m in lexer.finditer(text, start):
                kind = m.lastgroup
                if kind == "skip" or kind is None:
                    continue
                tok, jumped = m[0], None
                if kind == "text" and not tok:
                    start = m.end() + 1
                    break
                if scripted and kind == "sign":
                    if tok == "/" and (not toks or toks[-1] in _BEFORE_REGEX) and (r := _REGEX.match(text, m.start())):
                        kind, tok, jumped = "text", r[0], r.end()
                    elif tok == "{":
                        open_now.append(False)
                    elif tok == "`" or (tok == "}" and open_now and open_now.pop()):
                        if tok == "}":
                            self._add(kind, tok, m.start())
                        rest = _TEMPLATE.match(text, m.end())
                        start = rest.end()
                        if rest[1] == "${":
                            open_now.append(True)
                            self._add("sign", "{", start - 1)
                        break
                kinds.append(kind)
                toks.append(tok)
                places.append(m.start())
                ends.append(m.start() + len(tok))
                if jumped is not None:
                    start = jumped
                    break
            else:
                start = None

    def _paired(self) -> list[int]:
        shut, open_now = [self.n] * (self.n + 4), {k: [] for k in _OPEN}
        stack: list[int] = []
        for i, tok in enumerate(self.tok):
            if self.kind[i] != "sign":
                continue
            if tok in _OPEN:
                stack.append(i)
                open_now[tok].append(i)
            elif tok in _CLOSE and open_now[_CLOSE[tok]]:
                while True:
                    last = stack.pop()
                    open_now[self.tok[last]].pop()
                    shut[last] = i
                    if self.tok[last] == _CLOSE[tok]:
                        break
        return shut

    def over(self, i: int) -> int:
        """Past the token, or past the bracket's content."""
        return self.shut[i] + 1 if self.tok[i] in _OPEN and self.kind[i] == "sign" else i + 1

    def _angles(self) -> dict[int, int]:
        """For each < the place past its >, where both are in one bracket and one statement."""
        past, levels = {}, [[]]
        for i in range(self.n):
            tok = self.tok[i]
            if self.kind[i] != "sign":
                continue
            if tok in _OPEN:
                levels.append([])
            elif tok in _CLOSE:
                levels.pop()
                levels = levels or [[]]
            elif tok == "<":
                levels[-1].append(i)
            elif tok == ">" and levels[-1]:
                past[levels[-1].pop()] = i + 1
            elif tok == ";":
                levels[-1].clear()
        return past

    def angle(self, i: int) -> int:
        """Past a <...> of types, or i where there is none."""
        return self.past.get(i, i)

    def until(self, i: int, end: int, *stops: str) -> int:
        """The next of these outside brackets, or end."""
        while i < end and self.tok[i] not in stops:
            i = self.over(i)
        return min(i, end)

    def span(self, i: int, j: int) -> str:
        return self.text[self.at[i] : self.end[j - 1]] if i < j <= self.n else ""

    def pieces(self, i: int, j: int) -> Iterator[tuple[int, int]]:
        """The parts between commas."""
        start = i
        while i < j:
            if self.tok[i] == ",":
                yield start, i
                start = i + 1
            i = max(self.angle(i), self.over(i)) if self.tok[i] == "<" else self.over(i)
        if start < j:
            yield start, j

    def dotted(self, i: int) -> int:
        """Past a name of parts, generics and all."""
        i = self.angle(i + 1)
        while self.tok[i] in (".", "::") and self.kind[i + 1] == "word":
            i = self.angle(i + 2)
        return i


class Reader:
    """Reads the definitions of a text in one of the languages with braces; found lists them in order of place."""

    def __init__(self, text: str, language: str) -> None:
        self.t, self.language, self.found, self.macros = Tokens(text, language), language, [], []
        read = {"JavaScript": self.script, "TypeScript": self.script, "Java": self.java, "Go": self.go, "Rust": self.rust}.get(language, self.c)
        read(0, self.t.n, "")
        self.found.sort(key=lambda x: x.start)

    # what all languages share

    def calls(self, i: int, j: int) -> tuple[str, ...]:
        t, met = self.t, {}
        for k in range(i, min(j, t.n)):
            if t.kind[k] == "word" and t.tok[k] not in NO_CALLS and t.tok[k - 1] not in ("function", "fn", "func"):
                after = t.angle(k + 1) if t.tok[k + 1] == "<" else k + 1
                if t.tok[after] == "(" and not (self.language.endswith("Script") and t.tok[t.shut[after] + 1] == "{" and t.tok[k - 1] in (",", "{")):
                    met[t.tok[k]] = None
        return tuple(met)

    def put(self, kind: str, name: str, owner: str, first: int, last: int, body: tuple[int, int] | None = None, **more) -> None:
        """first and last: the definition's tokens; body: the tokens inside its block."""
        t, (a, b) = self.t, body or (last, last)
        inside = (t.at[a], t.end[b - 1]) if a < b <= t.n else (t.end[min(last, t.n) - 1],) * 2
        self.found.append(Found(kind, name, owner, t.at[first], t.end[min(last, t.n) - 1], inside, calls=self.calls(a, b) if kind == "function" else (), **more))

    def block(self, i: int) -> tuple[tuple[int, int] | None, int]:
        """(the tokens inside a block at i, if there is one; past the block or the semicolon)."""
        t = self.t
        if t.tok[i] == "{":
            return (i + 1, t.shut[i]), min(t.shut[i] + 1, t.n)
        return None, i + (t.tok[i] == ";")

    def marked(self, i: int, sign: str = "@") -> tuple[int, tuple[str, ...]]:
        """Past annotations, and these."""
        t, marks = self.t, []
        while t.tok[i] == sign and not (sign == "@" and t.tok[i + 1] == "interface"):
            j = t.over(i + 1 + (t.tok[i + 1] == "!")) if sign == "#" else t.dotted(i + 1)
            j = t.over(j) if sign == "@" and t.tok[j] == "(" else j
            marks.append(t.span(i, j))
            i = j
        return i, tuple(marks)

    def modified(self, i: int, words: set[str], name_ends: tuple[str, ...] = ()) -> tuple[int, tuple[str, ...]]:
        """Past modifiers, and these; a word before one of name_ends is a name."""
        t, met = self.t, []
        while t.tok[i] in words and t.tok[i + 1] not in name_ends:
            met.append(t.tok[i])
            i += 1
            if met[-1] == "pub" and t.tok[i] == "(":
                i = t.over(i)
            i += met[-1] == "extern" and t.kind[i] == "text"
        return i, tuple(met)

    def parameters(self, i: int) -> tuple[Parameter, ...]:
        """Of the bracket at i."""
        t, out = self.t, []
        for a, b in t.pieces(i + 1, t.shut[i]):
            a, _ = self.marked(a, "#" if self.language == "Rust" else "@")
            stop = t.until(a, b, "=")
            default = t.span(stop + 1, b)
            if self.language in ("JavaScript", "TypeScript", "Rust"):
                while t.tok[a] in ("public", "private", "protected", "readonly", "mut", "override") and a + 1 < stop and t.tok[a + 1] != ":":
                    a += 1
                colon = t.until(a, stop, ":")
                out.append(Parameter(t.span(a, colon).removesuffix("?"), t.span(colon + 1, stop), default))
            elif self.language == "Go":
                named = t.kind[a] == "word" and b > a + 1 and t.tok[a + 1] not in (".", "[") or (t.kind[a] == "word" and b > a + 2 and t.tok[a + 1] == "[" and t.tok[a - 1] in ("(", ",") and t.shut[a + 1] + 1 < b)
                out.append(Parameter(t.tok[a], t.span(a + 1, b)) if named else Parameter("", t.span(a, b)))
            elif t.span(a, b) != "void":
                while stop > a and t.tok[stop - 1] == "]":
                    stop = next(k for k in range(stop - 1, a - 1, -1) if t.tok[k] == "[")
                if t.tok[stop - 1] == ")" and (star := next((k for k in range(a, stop) if t.tok[k] == "(" and t.tok[k + 1] in ("*", "&", "^")), None)) is not None:
                    out.append(Parameter(t.tok[star + 2], t.span(a, b), default))
                elif stop - 1 > a and t.kind[stop - 1] == "word":
                    after = t.span(stop, t.until(stop, b, "="))
                    out.append(Parameter(t.tok[stop - 1], t.span(a, stop - 1) + after, default))
                else:
                    out.append(Parameter("", t.span(a, stop), default))
        if self.language == "Go" and any(p.name for p in out):
            kind = ""
            for k in range(len(out) - 1, -1, -1):  # a, b int
                kind = out[k].type if out[k].name else kind
                out[k] = out[k] if out[k].name else Parameter(out[k].type, kind)
        return tuple(out)

    # JavaScript and TypeScript

    def script_type(self, i: int) -> int:
        """Past a type."""
        t = self.t
        while i < t.n:
            while t.tok[i] in ("|", "&", "keyof", "typeof", "readonly", "asserts", "infer", "unique", "new", "abstract") or (t.tok[i] == "is" and t.kind[i + 1] == "word"):
                i += 1
            grouped = t.tok[t.angle(i)] == "("
            i = t.over(t.angle(i)) if t.tok[i] in ("<", "(", "[", "{") else t.dotted(i)
            while t.tok[i] == "[":
                i = t.over(i)
            if t.tok[i] in ("|", "&", "is", "extends", "?") or (grouped and t.tok[i] == "=>") or (t.tok[i] == ":" and t.tok[i - 1] != ")" and "?" in t.tok[max(0, i - 12) : i]):
                i += 1
                continue
            return i
        return i

    def typed(self, i: int) -> tuple[int, str]:
        """Past an annotated type, and this."""
        if self.t.tok[i] != ":":
            return i, ""
        j = self.script_type(i + 1)
        return j, self.t.span(i + 1, j)

    def arrow(self, i: int) -> tuple[int, tuple[Parameter, ...], str, bool] | None:
        """Of an arrow function or a function expression at i: its body's place, parameters, type, and whether it is async."""
        t, is_async = self.t, self.t.tok[i] == "async" and self.t.tok[i + 1] not in ("=>", ",", ";", ".")
        i += is_async
        if t.tok[i] == "function":
            i += 1 + (t.tok[i + 1] == "*")
            i = t.angle(i + (t.kind[i] == "word"))
            j, kind = self.typed(t.shut[i] + 1) if t.tok[i] == "(" else (i, "")
            return (j, self.parameters(i), kind, is_async) if t.tok[j] == "{" else None
        if t.kind[i] == "word" and t.tok[i + 1] == "=>":
            return i + 2, (Parameter(t.tok[i]),), "", is_async
        i = t.angle(i)
        if t.tok[i] == "(":
            j, kind = self.typed(t.shut[i] + 1)
            if t.tok[j] == "=>":
                return j + 1, self.parameters(i), kind, is_async
        return None

    def value_end(self, i: int, end: int) -> int:
        """Past an expression: to a comma or semicolon, or to a line that can't go on with it."""
        t = self.t
        while i < end and t.tok[i] not in (";", ",", ")", "]", "}"):
            i = t.over(i)
            ended = t.kind[i - 1] != "sign" or t.tok[i - 1] in _CLOSE
            if i < end and ended and (t.kind[i] in ("word", "text") or t.tok[i] == "@") and "\n" in t.text[t.end[i - 1] : t.at[i]]:
                break
        return min(i, end)

    def script_function(self, name: str, owner: str, first: int, found: tuple, end: int, words: tuple[str, ...] = (), marks: tuple[str, ...] = ()) -> int:
        """Puts an arrow function or function expression that has a name; past it."""
        t, (at, params, kind, is_async) = self.t, found
        inside, last = self.block(at) if t.tok[at] == "{" else ((at, stop := self.value_end(at, end)), stop)
        self.put("function", name, owner, first, last, inside, words=(*words, *["async"] * is_async), marks=marks, params=params, returns=kind)
        return at

    def script(self, i: int, end: int, owner: str) -> None:
        t = self.t
        while i < end:
            tok, before, nxt = t.tok[i], t.tok[i - 1] if i else "", t.tok[i + 1]
            if t.kind[i] != "word" or before in (".", "?."):
                i += 1
            elif tok == "class" and (t.kind[i + 1] == "word" or nxt == "{"):
                i = self.script_class(i, end)
            elif tok in ("interface", "enum") and self.language == "TypeScript" and t.kind[i + 1] == "word":
                j = t.until(i + 2, end, "{", ";")
                inside, last = self.block(j)
                first = i - (before in ("const", "declare", "export"))
                self.put("class", nxt, "", first, last, inside, words=(tok,), bases=tuple(t.span(a, b) for a, b in t.pieces(i + 3 if t.tok[i + 2] == "extends" else j, j)))
                i = max(last, i + 1)
            elif tok == "import":
                i = self.script_import(i, end)
            elif tok == "require" and nxt == "(" and t.kind[i + 2] == "text" and t.tok[i + 3] == ")":
                self.put("import", t.tok[i + 2][1:-1], "", i, i + 4)
                i += 4
            elif tok == "function" and t.kind[j := i + 1 + (nxt == "*")] == "word" and (found := self.arrow(i)):
                first = i - (before == "async")
                first -= t.tok[first - 1] in ("export", "default")
                first -= t.tok[first - 1] == "export" and first > 0
                i = self.script_function(t.tok[j], "", max(first, 0), (*found[:3], before == "async"), end)
            elif tok in ("const", "let", "var") and t.kind[i + 1] == "word":
                j = self.typed(i + 2)[0]
                found = self.arrow(j + 1) if t.tok[j] == "=" else None
                i = self.script_function(nxt, "", i - (before == "export"), found, end) if found else i + 2
            elif nxt == "(" and before in ("{", ",", "async", "get", "set", "*") and tok not in NO_CALLS and t.tok[(j := self.typed(t.shut[i + 1] + 1)[0])] == "{":
                inside, last = self.block(j)
                self.put("function", tok, "", i, last, inside, words=("async",) * (before == "async"), params=self.parameters(i + 1), returns=t.span(t.shut[i + 1] + 2, j))
                i = j + 1
            else:
                i += 1

    def script_import(self, i: int, end: int) -> int:
        t, j = self.t, i + 1
        if t.tok[j] == "(":
            if t.kind[j + 1] == "text":
                self.put("import", t.tok[j + 1][1:-1], "", i, j + 3, words=("dynamic",))
            return j + 1
        items: list[str] = []
        while j < end and t.kind[j] != "text" and t.tok[j] not in (";", "(", "="):
            if t.tok[j] == "{":
                items += [t.tok[a + (t.tok[a] == "type" and b > a + 1)] for a, b in t.pieces(j + 1, t.shut[j])]
            elif t.kind[j] == "word" and t.tok[j] not in ("from", "type", "as"):
                items.append(t.tok[j])
            j = t.over(j)
        if t.kind[j] == "text":
            self.put("import", t.tok[j][1:-1], "", i, j + 1, bases=tuple(items))
            return j + 1
        return i + 1

    def script_class(self, i: int, end: int) -> int:
        t = self.t
        name = t.tok[i + 1] if t.tok[i + 1] not in ("{", "extends") else ""
        j = t.until(t.angle(i + 1 + bool(name)), end, "{")
        bases = []
        for k in range(t.angle(i + 1 + bool(name)), j):
            if t.tok[k] in ("extends", "implements"):
                stop = next((x for x in range(k + 1, j) if t.tok[x] == "implements"), j)
                bases += [t.span(a, b) for a, b in t.pieces(k + 1, stop)]
        first = i
        while first and t.tok[first - 1] in ("export", "default", "abstract", "declare"):
            first -= 1
        inside, last = self.block(j)
        if name:
            self.put("class", name, "", first, last, inside, words=tuple(t.tok[first:i]), bases=tuple(bases))
        if inside:
            self.script_members(*inside, name)
        return max(last, i + 1)

    def script_members(self, i: int, end: int, owner: str) -> None:
        t = self.t
        while i < end:
            i, marks = self.marked(i)
            first = i
            i, words = self.modified(i, _JS_MODIFIERS, ("(", "=", ";", ":", "?", "!", "<", "}", ","))
            i += t.tok[i] == "*"
            if i >= end:
                return
            j = t.angle(t.over(i) + (t.tok[t.over(i)] in ("?", "!")))
            if t.kind[i] in ("word", "text", "number") and t.tok[j] == "(":
                k, kind = self.typed(t.shut[j] + 1)
                inside, last = self.block(k)
                if inside or "abstract" in words:
                    self.put("function", t.tok[i].strip("'\""), owner, first, last, inside, words=words, marks=marks, params=self.parameters(j), returns=kind)
                self.script(j + 1, t.shut[j], "")
                if inside:
                    self.script(*inside, "")
                i = max(last, i + 1)
            elif t.kind[i] in ("word", "text") and t.tok[j] in ("=", ":"):
                k = self.typed(j)[0]
                value = k + 1 if t.tok[k] == "=" else k
                if value > k and (found := self.arrow(value)):
                    self.script_function(t.tok[i], owner, first, found, end, words, marks)
                stop = self.value_end(value, end)
                self.script(value, stop, "")
                i = max(stop, i + 1)
            else:
                if t.tok[i] == "{":
                    self.script(i + 1, t.shut[i], "")
                i = t.over(i)

    # Java

    def java(self, i: int, end: int, owner: str) -> None:
        t = self.t
        while i < end:
            i, marks = self.marked(i)
            first = i
            i, words = self.modified(i, _JAVA_MODIFIERS)
            i, more = self.marked(i)
            i, again = self.modified(i, _JAVA_MODIFIERS)
            i, marks, words = t.angle(i), marks + more, words + again
            i, more = self.marked(i)
            tok, marks = t.tok[i], marks + more
            if i >= end:
                return
            if tok in ("import", "package"):
                stop = t.until(i, end, ";")
                a = i + 1 + (t.tok[i + 1] == "static")
                if tok == "import" and a < stop:
                    self.put("import", t.span(a, stop), "", i, stop)
                i = stop + 1
            elif (kind := t.tok[i + 1] if tok == "@" else tok) in ("class", "interface", "enum", "record") and t.kind[j := i + 1 + (tok == "@")] == "word" and t.tok[j + 1] not in ("=", ";", "."):
                i = self.java_class(first, j, end, owner, kind, words, marks)
            elif t.kind[i] == "word":
                i = self.java_member(first, i, end, owner, words, marks)
            else:
                i = t.over(i)

    def java_class(self, first: int, i: int, end: int, owner: str, kind: str, words: tuple[str, ...], marks: tuple[str, ...]) -> int:
        t, name = self.t, self.t.tok[i]
        own, j = f"{owner}.{name}" if owner else name, t.until(i + 1, end, "{", ";")
        bases, k = [], i + 1
        while k < j:
            if t.tok[k] in ("extends", "implements"):
                stop = next((x for x in range(k + 1, j) if t.tok[x] in ("implements", "permits")), j)
                bases += [t.span(a, b) for a, b in t.pieces(k + 1, stop)]
                k = stop
            else:
                k = max(t.angle(k), t.over(k))
        inside, last = self.block(j)
        self.put("class", name, owner, first, last, inside, words=(*words, kind), marks=marks, bases=tuple(bases))
        if inside:
            a, b = inside
            self.java(t.until(a, b, ";") if kind == "enum" else a, b, own)
        return max(last, i + 1)

    def java_member(self, first: int, i: int, end: int, owner: str, words: tuple[str, ...], marks: tuple[str, ...]) -> int:
        t, j, simple = self.t, i, owner.split(".")[-1]
        if not (t.tok[i] == simple and t.tok[i + 1] in ("(", "{")):
            j = t.dotted(i)
            while t.tok[j] in ("[", "...") or t.tok[j] == "@":
                j = self.marked(j)[0] if t.tok[j] == "@" else t.over(j)
        if t.kind[j] == "word" and t.tok[j + 1] == "(":
            k = t.shut[j + 1] + 1
            k = t.until(k, end, "{", ";") if t.tok[k] in ("throws", "[", "default") else k
            if t.tok[k] in ("{", ";"):
                inside, last = self.block(k)
                self.put("function", t.tok[j], owner, first, last, inside, words=words, marks=marks, params=self.parameters(j + 1), returns=t.span(i, j))
                return last
        elif t.tok[j] == simple and t.tok[j + 1] == "{" and owner:  # a record's short constructor
            inside, last = self.block(j + 1)
            self.put("function", simple, owner, first, last, inside, words=words, marks=marks)
            return last
        return max(t.until(i, end, ";") + 1, i + 1)

    # Go

    def go_type(self, i: int) -> int:
        """Past a type."""
        t = self.t
        while t.tok[i] in ("*", "[", "chan", "map", "<", "-", "...", "->") or (t.tok[i] == "<" and t.tok[i + 1] == "-"):
            i = t.over(i)
        if t.tok[i] in ("interface", "struct") and t.tok[i + 1] == "{":
            return t.over(i + 1)
        if t.tok[i] == "func":
            return self.go_result(t.over(i + 1))
        if t.tok[i] == "(":
            return t.over(i)
        if t.kind[i] == "word":
            i += 1
            while t.tok[i] == "." and t.kind[i + 1] == "word":
                i += 2
            return t.over(i) if t.tok[i] == "[" else i
        return i

    def go_result(self, i: int) -> int:
        t = self.t
        return self.go_type(i) if t.tok[i] in ("(", "*", "[") or (t.kind[i] == "word" and "\n" not in t.text[t.end[i - 1] : t.at[i]]) or (t.tok[i] == "<" and t.tok[i + 1] == "-") else i

    def go(self, i: int, end: int, owner: str) -> None:
        t = self.t
        while i < end:
            if t.tok[i] == "func":
                j, receiver = i + 1, ""
                if t.tok[j] == "(":
                    held = [t.tok[k] for k in range(j + 1, t.until(j + 1, t.shut[j], "[")) if t.kind[k] == "word"]
                    receiver, j = held[-1] if held else "", t.over(j)
                k = t.over(j + 1) if t.tok[j + 1] == "[" else j + 1
                if t.kind[j] == "word" and t.tok[k] == "(":
                    stop = self.go_result(t.shut[k] + 1)
                    inside, last = self.block(stop)
                    self.put("function", t.tok[j], receiver, i, last, inside, params=self.parameters(k), returns=t.span(t.shut[k] + 1, stop))
                    i = max(last, i + 1)
                    continue
            elif t.tok[i] in ("type", "import"):
                one = self.go_spec if t.tok[i] == "type" else self.go_import
                if t.tok[i + 1] == "(":
                    j = i + 2
                    while j < t.shut[i + 1]:
                        j = one(j, j)
                    i = t.shut[i + 1] + 1
                else:
                    i = one(i, i + 1)
                continue
            i = t.over(i)

    def go_spec(self, first: int, i: int) -> int:
        t, name = self.t, self.t.tok[i]
        k = t.over(i + 1) if t.tok[i + 1] == "[" and t.tok[t.shut[i + 1] + 1] in ("struct", "interface") else i + 1
        if t.kind[i] == "word" and t.tok[k] in ("struct", "interface") and t.tok[k + 1] == "{":
            inside, last = self.block(k + 1)
            self.put("class", name, "", first, last, inside, words=(t.tok[k],))
            return last
        return max(self.go_type(i + 1 + (t.tok[i + 1] == "=")), i + 1)

    def go_import(self, first: int, i: int) -> int:
        t = self.t
        j = i + (t.kind[i] == "word" or t.tok[i] in (".", "_"))
        if t.kind[j] == "text":
            self.put("import", t.tok[j][1:-1], "", first, j + 1, bases=(t.tok[i],) * (j > i))
        return j + 1

    # Rust

    def rust(self, i: int, end: int, owner: str) -> None:
        t = self.t
        while i < end:
            i, marks = self.marked(i, "#")
            first = i
            i, words = self.modified(i, _RUST_MODIFIERS, (":", ";", "="))
            tok, nxt = t.tok[i], t.tok[i + 1]
            if i >= end:
                return
            if tok == "fn" and t.kind[i + 1] == "word" and t.tok[j := t.angle(i + 2)] == "(":
                k = stop = t.until(t.shut[j] + 1, end, "{", ";", "where")
                k = t.until(k, end, "{", ";")
                inside, last = self.block(k)
                self.put("function", nxt, owner, first, last, inside, words=words, marks=marks, params=self.parameters(j), returns=t.span(t.shut[j] + 2, stop))
                if inside:
                    self.rust(*inside, "")
                i = max(last, i + 1)
            elif tok in ("struct", "enum", "trait", "union") and t.kind[i + 1] == "word":
                j = t.until(t.angle(i + 2), end, "{", ";")
                inside, last = self.block(j)
                self.put("class", nxt, "", first, last, inside, words=(*words, tok), marks=marks)
                if tok == "trait" and inside:
                    self.rust(*inside, nxt)
                i = max(last, i + 1)
            elif tok == "impl":
                j = k = t.until(t.angle(i + 1), end, "{", ";")
                head = t.angle(i + 1)
                for x in range(head, j):
                    head = x + 1 if t.tok[x] == "for" and t.tok[x + 1] != "<" else head
                    k = x if t.tok[x] == "where" and k == j else k
                while t.tok[head] in ("&", "mut", "dyn", "!") or t.kind[head] == "text":
                    head += 1
                name = next((t.tok[x - 1] for x in range(head + 1, k + 1) if t.tok[x] not in ("::",) and t.tok[x - 1] != "::"), "")
                if t.tok[j] == "{":
                    self.rust(j + 1, t.shut[j], name)
                i = min(t.over(j), end) if j < end else end
            elif tok == "mod" and t.tok[i + 2] == "{":
                self.rust(i + 3, t.shut[i + 2], "")
                i = t.shut[i + 2] + 1
            elif tok == "use":
                stop = t.until(i, end, ";")
                cut = next((x for x in range(i + 1, stop) if t.tok[x] in ("{", "as", "*")), stop)
                items = tuple(t.span(a, b) for a, b in t.pieces(cut + 1, t.shut[cut])) if t.tok[cut] == "{" else ()
                self.put("import", t.span(i + 1, cut).strip(": "), "", first, stop, bases=items)
                i = stop + 1
            elif tok == "macro_rules":
                i = t.over(i + 3)
            else:
                i = t.over(i) if tok != "{" or owner else i + 1

    # C and C++

    def c(self, i: int, end: int, owner: str) -> None:
        t = self.t
        while i < end:
            tok = t.tok[i]
            if t.kind[i] == "line":
                self.c_line(i)
                i += 1
            elif tok == "template":
                i = max(t.angle(i + 1), i + 1)
            elif tok in ("namespace", "extern") and t.tok[j := t.until(i + 1, min(end, i + 8), "{", ";", "(")] == "{":
                self.c(j + 1, t.shut[j], "")
                i = t.shut[j] + 1
            elif tok in ("public", "private", "protected") and t.tok[i + 1] == ":":
                i += 2
            elif tok in ("class", "struct", "union", "enum") and (i_after := self.c_class(i, end, owner)):
                i = i_after
            elif tok in ("using", "friend") or (tok == "typedef" and t.tok[i + 1] not in ("struct", "union", "enum", "class")):
                i = t.until(i, end, ";") + 1
            elif t.kind[i] == "word" and tok != "typedef" or tok == "~":
                i = self.c_declaration(i, end, owner)
            else:
                i = t.over(i) if tok != "{" else i + 1

    def c_line(self, i: int) -> None:
        t = self.t
        if m := re.match(r'[ \t]*#\s*include\s*(<[^>\n]*>|"[^"\n]*")', t.tok[i]):
            self.put("import", m[1][1:-1], "", i, i + 1, words=("local",) * (m[1][0] == '"'))
        elif m := re.match(r"[ \t]*#\s*define\s+(\w+)", t.tok[i]):
            self.macros.append(m[1])

    def c_class(self, i: int, end: int, owner: str) -> int:
        """Past a class that has a body, else 0."""
        t, j = self.t, i + 1 + (self.t.tok[i] == "enum" and self.t.tok[i + 1] in ("class", "struct"))
        while t.tok[j] in ("[", "__attribute__", "alignas") or (t.kind[j] == "word" and t.kind[j + 1] == "word" and t.tok[j + 1] != "final"):
            j = t.over(j) + (t.tok[j] in ("__attribute__", "alignas") and t.tok[j + 1] == "(" and t.shut[j + 1] - j)
        if t.kind[j] != "word":
            return 0
        k = t.angle(j + 1) + (t.tok[t.angle(j + 1)] == "final")
        if t.tok[k] not in ("{", ":") or (t.tok[k] == ":" and t.tok[k + 1] == ":"):
            return 0
        body = t.until(k, end, "{", ";")
        if t.tok[body] != "{":
            return 0
        bases = tuple(t.span(next((x for x in range(a, b) if t.tok[x] not in ("public", "private", "protected", "virtual")), a), b) for a, b in t.pieces(k + 1, body)) if t.tok[k] == ":" and t.tok[i] != "enum" else ()
        inside, last = self.block(body)
        own = f"{owner}.{t.tok[j]}" if owner else t.tok[j]
        pure = re.search(r"=\s*0\s*;", t.text[t.at[body] : t.end[min(last, t.n) - 1]]) is not None
        self.put("class", t.tok[j], owner, i, last, inside, words=(t.tok[i], *["abstract"] * pure), bases=bases)
        if t.tok[i] != "enum":
            self.c(*inside, own)
        return t.until(last, end, ";") + 1 if t.tok[last] in (";", "*") or t.kind[last] == "word" and t.tok[last + 1] in (";", ",", "=", "[") else last

    def c_declaration(self, i: int, end: int, owner: str) -> int:
        """Past a declaration at i; puts it if it is a function with a body."""
        t, j, labels = self.t, i, {"if", "for", "while", "switch", "return", "else", "do", "case", "goto", "sizeof"}
        while j < end:
            tok = t.tok[j]
            if tok in (";", "}") or t.kind[j] == "line":
                return j + (tok in (";", "}"))
            if tok == "{":
                return t.over(j)
            if tok == "=":
                return t.until(j, end, ";") + 1
            if tok == "operator":
                k = j + 1
                k = k + 2 if t.tok[k] == "(" else t.until(k, end, "(", ";", "{")
                name = t.span(j, k)
            elif t.kind[j] == "word" and tok not in labels and t.tok[j + 1] == "(" and tok not in ("decltype", "alignas", "__attribute__", "noexcept", "explicit", "throw"):
                name, k = tok, j + 1
            else:
                j = max(t.angle(j), t.over(j)) if tok == "<" else t.over(j)
                continue
            if t.tok[k] == "(" and (body := self.c_body(k, end)):
                head = j
                name, head = (f"~{name}", head - 1) if t.tok[head - 1] == "~" else (name, head)
                outer = []
                while t.tok[head - 1] == "::" and head - 2 >= i:
                    head -= 2
                    if t.tok[head] == ">":
                        depth = 0
                        while head > i and (depth := depth + (t.tok[head] == ">") - (t.tok[head] == "<")):
                            head -= 1
                        head -= 1
                    outer.insert(0, t.tok[head])
                inside, last = self.block(body)
                words = tuple(x for x in t.tok[i:head] if x in ("static", "virtual", "inline", "constexpr", "extern", "explicit"))
                kept = " ".join(t.tok[x] for x in range(i, head) if t.tok[x] not in words) if head > i else ""
                self.put("function", name, ".".join(x for x in (owner, *outer) if x), i, last, inside, words=words, params=self.parameters(k), returns=kept)
                return last
            j = t.over(k)
        return end

    def c_body(self, i: int, end: int) -> int:
        """The brace of the body after the parameters at i, or 0."""
        t, i = self.t, self.t.over(i)
        while i < end and t.tok[i] in ("const", "volatile", "noexcept", "override", "final", "&", "&&", "throw", "try", "__attribute__", "requires", "->", "mutable"):
            i = t.until(i, end, "{", ";", ":") if t.tok[i] in ("->", "requires") else t.over(i + 1) if t.tok[i + 1] == "(" else i + 1
        if t.tok[i] == ":" and t.tok[i + 1] != ":":
            i += 1
            while i < end and t.kind[i] == "word":
                i = t.over(t.dotted(i))
                i += t.tok[i] == "..."
                if t.tok[i] != ",":
                    break
                i += 1
        return i if i < end and t.tok[i] == "{" else 0


def lines_of(text: str):
    """From a place to its line, by bisection."""
    breaks = [m.start() for m in re.finditer("\n", text)]
    return lambda at: bisect_right(breaks, at - 1) + 1 if at else 1
