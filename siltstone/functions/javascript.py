"""Imports, declarations and routes of JavaScript and TypeScript texts, from tokens.

A text is cut into tokens by one pattern for each kind; a stack of open brackets tells blocks from
expressions, so that a slash is a division or starts a regular expression, and a closing brace ends
a block or goes on with a template. Facts are read off the tokens and the brackets' partners. What
does not close (a quote in markup, a bracket at the end) is a plain token: every text gives a result.

The column form (``facts``) works in Arrow batches, without a shuffle; a null text gives null.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings of such files, methods of routes, and words of the language.
EXTENSIONS = (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx")
HTTP_METHODS = frozenset(("get", "post", "put", "patch", "delete", "head", "options"))
_BEFORE_EXPRESSION = frozenset("return typeof instanceof in of new delete void throw case do else yield await extends default".split())
_BEFORE_CONDITION = frozenset(("if", "while", "for", "with"))
_DECLARING = ("const", "let", "var", "import", "export")
_MODIFIERS = frozenset(("export", "default", "async", "declare", "abstract"))

_NAME = r"[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*"
_PLAIN = re.compile(
    rf"""(?P<space>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<name>\#?{_NAME})|(?P<number>\.?\d(?:[eE][+-]|[\w.])*)
    |(?P<string>'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*")|(?P<mark>=>|\?\.(?!\d)|\.\.\.|\+\+|--|.)""",
    re.S | re.X,
)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/\w*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]{1,6})\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(\r\n|[\s\S]))")
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": ""}


def _unescaped(text: str) -> str:
    def one(m: re.Match) -> str:
        digits = m[1] or m[2] or m[3]
        if digits:
            return chr(int(digits, 16)) if int(digits, 16) < 0x110000 and not 0xD800 <= int(digits, 16) < 0xE000 else "\ufffd"
        return _ESCAPED.get(m[4], m[4])

    return _ESCAPE.sub(one, text) if "\\" in text else text


@dataclass(slots=True)
class Token:
    #: name, number, string (also a template without parts; ``text`` is its value), template, regex, mark
    kind: str
    text: str
    at: int


class Tokens:
    """The tokens of a text, and the partner of each bracket among them (its own place where it has none)."""

    def __init__(self, text: str):
        self.text = text
        self.all: list[Token] = []
        self.partner: dict[int, int] = {}
        self._newlines = [m.start() for m in re.finditer("\n", text)]
        #: Open brackets: (mark, place, whether a slash after its end starts a regular expression).
        self._open: list[tuple[str, int, bool]] = []
        self._count = {"(": 0, "[": 0, "{": 0, "${": 0}
        self._starts: dict[int, int] = {}
        self._read()

    def line(self, place: int) -> int:
        return bisect_right(self._newlines, self.all[place].at - 1) + 1

    def _put(self, kind: str, text: str, at: int) -> None:
        self.all.append(Token(kind, text, at))

    def _starts_expression(self) -> bool:
        """Whether an operand is due where the tokens end."""
        if not self.all:
            return True
        last = self.all[-1]
        if last.kind == "name":
            return last.text in _BEFORE_EXPRESSION and not self.is_mark(len(self.all) - 2, ".", "?.")
        if last.kind != "mark":
            return False
        if last.text in (")", "]", "}"):
            return self._ended
        return last.text not in ("++", "--")

    def _opens_block(self) -> bool:
        """Whether a brace that comes next opens statements, rather than an object."""
        if not self.all:
            return True
        last = self.all[-1]
        if last.kind == "name":
            return last.text not in _BEFORE_EXPRESSION or last.text in ("do", "else")
        return last.kind == "mark" and last.text in (")", ";", "{", "}", "=>")

    def _read(self) -> None:
        text, at, n = self.text, 0, len(self.text)
        self._ended = True
        while at < n:
            m = _PLAIN.match(text, at)
            kind, word = m.lastgroup, m[0]
            if kind == "mark" and word == "/" and self._starts_expression():
                found = _REGEX.match(text, at)
                if found:
                    kind, word = "regex", found[0]
            elif kind == "mark" and word == "`":
                at = self._template(at, at + 1)
                continue
            elif kind == "mark" and word in "([{":
                condition = word == "(" and bool(self.all) and self.all[-1].kind == "name" and self.all[-1].text in _BEFORE_CONDITION
                self._push(word, len(self.all), condition or (word == "{" and self._opens_block()))
            elif kind == "mark" and word in ")]}":
                if word == "}" and self._open and self._open[-1][0] == "${":
                    start = self._pop()[1]
                    at = self._template(start, at + 1)
                    continue
                self._close(word)
            if kind != "space":
                self._put(kind, _unescaped(word[1:-1]) if kind == "string" else word, at)
            at += len(word)

    def _close(self, word: str) -> None:
        mark = {")": "(", "]": "[", "}": "{"}[word]
        # A bracket that was never closed inside gives way to its owner's end.
        self._ended = False
        if not self._count[mark]:
            return
        while self._open[-1][0] not in (mark, "${"):
            self._pop()
        if self._open[-1][0] == mark:
            _, place, self._ended = self._pop()
            self.partner[place], self.partner[len(self.all)] = len(self.all), place

    def _push(self, mark: str, place: int, ended: bool) -> None:
        self._open.append((mark, place, ended))
        self._count[mark] += 1

    def _pop(self) -> tuple[str, int, bool]:
        self._count[self._open[-1][0]] -= 1
        return self._open.pop()

    def _template(self, start: int, at: int) -> int:
        """Reads on in a template that began at ``start``; gives the place after it, or after its next ${."""
        m = _TEMPLATE.match(self.text, at)
        if self.text.startswith("${", m.end()):
            self._push("${", start, False)
            return m.end() + 2
        whole = self.text[start] == "`" and start + 1 == at
        self._put("string" if whole else "template", _unescaped(m[0]) if whole else "", start)
        return m.end() + 1

    # --- reading tokens ---

    def is_name(self, i: int, *words: str) -> bool:
        return 0 <= i < len(self.all) and self.all[i].kind == "name" and (not words or self.all[i].text in words)

    def is_mark(self, i: int, *marks: str) -> bool:
        return 0 <= i < len(self.all) and self.all[i].kind == "mark" and self.all[i].text in marks

    def is_string(self, i: int) -> bool:
        return 0 <= i < len(self.all) and self.all[i].kind == "string"

    def is_property(self, i: int) -> bool:
        return self.is_mark(i - 1, ".", "?.")

    def declares(self, i: int) -> bool:
        """Whether ``function`` or ``class`` at i begins a statement, not a value or a member's name."""
        i = self.first_modifier(i)
        if i == 0:
            return True
        last = self.all[i - 1]
        if last.kind == "name":
            return last.text not in _BEFORE_EXPRESSION or last.text in ("do", "else")
        return last.kind != "mark" or last.text in (";", "{", "}", ")", "]", "++", "--")

    def first_modifier(self, i: int) -> int:
        """Where a declaration at i begins, with its modifiers and decorators."""
        while True:
            if self.is_name(i - 1, *_MODIFIERS) and not self.is_property(i - 1):
                i -= 1
                continue
            j = i - 1
            if self.is_mark(j, ")") and j in self.partner:
                j = self.partner[j] - 1
            while self.is_name(j) and self.is_mark(j - 1, "."):
                j -= 2
            if self.is_name(j) and self.is_mark(j - 1, "@"):
                i = j - 1
                continue
            return i

    def call_start(self, i: int) -> int:
        """The first token of the expression whose member is named at i; a chain's calls go on from each other's."""
        first = i
        while self.is_property(i) and i not in self._starts:
            i -= 2
            while self.is_mark(i, ")", "]") and i in self.partner:
                i = self.partner[i] - 1
        self._starts[first] = self._starts[i] if i in self._starts else self._operand(i)
        return self._starts[first]

    def _operand(self, i: int) -> int:
        if not (self.is_name(i) or self.all[max(i, 0)].kind in ("string", "template", "regex")):
            i += 1  # a bracketed expression stands alone
        return i - 1 if self.is_name(i - 1, "new") else i

    def ends_statement(self, i: int) -> bool:
        """Whether token i begins a new statement by standing on a new line after a whole operand."""
        last, this = self.all[i - 1], self.all[i]
        if self.line(i) == self.line(i - 1) or (last.kind == "mark" and last.text not in (")", "]", "}")) or (last.kind == "name" and last.text in _BEFORE_EXPRESSION):
            return False
        return (this.kind == "name" and this.text not in ("in", "of", "instanceof", "as", "satisfies")) or this.kind in ("number", "string")


def _imports(t: Tokens) -> list[str]:
    out = []
    for i, token in enumerate(t.all):
        if token.kind != "name" or token.text not in ("import", "export", "require") or t.is_property(i):
            continue
        if token.text == "require" or (token.text == "import" and t.is_mark(i + 1, "(")):
            if t.is_mark(i + 1, "(") and t.is_string(i + 2) and t.is_mark(i + 3, ")", ","):
                out.append(t.all[i + 2].text)
        elif token.text == "import" and t.is_string(i + 1):
            out.append(t.all[i + 1].text)
        else:
            j = i + 1
            if token.text == "export" and not (t.is_mark(j, "*", "{") or (t.is_name(j, "type") and t.is_mark(j + 1, "*", "{"))):
                continue
            while j < len(t.all) and not t.is_name(j, "from", "import", "export") and (t.all[j].kind in ("name", "string") or t.is_mark(j, ",", "*")):
                j += 1
            if t.is_mark(j, "{") and j in t.partner:
                j = t.partner[j] + 1
            elif t.is_name(j, "from") and t.is_name(j + 1, "from"):
                j += 1
            if t.is_name(j, "from") and t.is_string(j + 1):
                out.append(t.all[j + 1].text)
    return list(dict.fromkeys(out))


def _after_type_parameters(t: Tokens, i: int) -> int:
    depth = 0
    while i < len(t.all) and (t.all[i].kind in ("name", "string", "number") or t.is_mark(i, "<", ">", ",", ".", "=", "|", "&", "[", "]", "{", "}", "(", ")", ":", ";", "=>")):
        depth += t.is_mark(i, "<") - t.is_mark(i, ">")
        if depth == 0:
            return i + 1
        i = t.partner[i] + 1 if t.is_mark(i, "{", "[", "(") and t.partner.get(i, -1) > i else i + 1
        if t.is_name(i, *_DECLARING):
            break
    return i


def _function_like(t: Tokens, i: int) -> str | None:
    """What the expression at i is: function, class or neither."""
    if t.is_name(i, "class"):
        return "class"
    if t.is_name(i, "async") and not t.is_mark(i + 1, "=>"):
        i += 1
    if t.is_name(i, "function") or (t.is_name(i) and t.is_mark(i + 1, "=>")):
        return "function"
    if t.is_mark(i, "<"):
        i = _after_type_parameters(t, i)
    if not t.is_mark(i, "(") or i not in t.partner:
        return None
    j = t.partner[i] + 1
    if t.is_mark(j, ":"):  # the type of what is returned
        j += 1
        while j < len(t.all) and not t.is_mark(j, "=>", ";", ",", ")") and not t.is_name(j, *_DECLARING) and not t.ends_statement(j):
            j = t.partner[j] + 1 if t.is_mark(j, "{", "[", "(") and t.partner.get(j, -1) > j else j + 1
    return "function" if t.is_mark(j, "=>") else None


def _declared(t: Tokens, i: int) -> list[tuple[str, int]]:
    """(kind, place of the name) of functions and classes that the statement at a const, let or var names."""
    out, n = [], len(t.all)
    skip = lambda j: t.partner[j] + 1 if t.is_mark(j, "(", "[", "{") and t.partner.get(j, -1) > j else j + 1
    while True:
        i += 1
        name, j = i, i
        while j < n and not t.is_mark(j, "=", ",", ";", ")", "]", "}") and not t.is_name(j, "of", "in", *_DECLARING) and (j == i or not t.ends_statement(j)):
            j = skip(j)
        if not t.is_mark(j, "="):
            if not t.is_mark(j, ","):
                return out
            i = j
            continue
        kind = _function_like(t, j + 1)
        if kind and t.is_name(name):
            out.append((kind, name))
        j = skip(j + 1)
        while j < n and not t.is_mark(j, ",", ";", ")", "]", "}") and not t.is_name(j, *_DECLARING) and not t.ends_statement(j):
            j = skip(j)
        if not t.is_mark(j, ","):
            return out
        i = j


def _first_line(t: Tokens, place: int) -> str:
    at = t.all[place].at
    return t.text[at:].split("\n", 1)[0].strip() if len(t.text) - at < 4000 else t.text[at : at + 4000].split("\n", 1)[0].strip()


def _symbols(t: Tokens) -> list[dict]:
    found: dict[tuple, dict] = {}

    def add(kind: str, name: str, at: int, exported: bool) -> None:
        line = t.line(at)
        found.setdefault((kind, name, line), {"kind": kind, "name": name, "start_line": line, "exported": exported, "signature": _first_line(t, at)})

    for i, token in enumerate(t.all):
        if token.kind != "name" or t.is_property(i):
            continue
        if token.text in ("function", "class"):
            j = i + 2 if t.is_mark(i + 1, "*") else i + 1
            if t.is_name(j) and not t.is_name(j, "extends", "implements") and t.declares(i):
                first = t.first_modifier(i)
                add(token.text, t.all[j].text, first, any(t.is_name(k, "export") for k in range(first, i)))
        elif token.text in ("const", "let", "var") and not t.is_name(i - 1, "as") and not (t.is_mark(i - 1, "(") and t.is_name(i - 2, "for", "await")) and not t.is_name(i + 1, "enum"):
            first = t.first_modifier(i)
            for kind, place in _declared(t, i):
                add(kind, t.all[place].text, place, any(t.is_name(k, "export") for k in range(first, i)))
    return sorted(found.values(), key=lambda s: (s["start_line"], s["name"]))


def _routes(t: Tokens) -> list[dict]:
    found: dict[tuple, dict] = {}
    for i, token in enumerate(t.all):
        if token.kind == "name" and t.is_property(i) and token.text.lower() in HTTP_METHODS and t.is_mark(i + 1, "(") and t.is_string(i + 2) and t.is_mark(i + 3, ",", ")"):
            handler = t.all[i + 4].text if t.is_mark(i + 3, ",") and t.is_name(i + 4) and t.is_mark(i + 5, ",", ")") else None
            row = {"method": token.text.upper(), "route_path": t.all[i + 2].text, "start_line": t.line(t.call_start(i)), "framework": "express", "handler": handler}
            found.setdefault((row["method"], row["route_path"], row["start_line"]), row)
    return list(found.values())


def facts_of(text: str) -> dict:
    t = Tokens(text)
    return {"imports": _imports(t), "symbols": _symbols(t), "routes": _routes(t)}


_TYPE = pa.struct([
    ("imports", pa.list_(pa.string())),
    ("symbols", pa.list_(pa.struct([("kind", pa.string()), ("name", pa.string()), ("start_line", pa.int32()), ("exported", pa.bool_()), ("signature", pa.string())]))),
    ("routes", pa.list_(pa.struct([("method", pa.string()), ("route_path", pa.string()), ("start_line", pa.int32()), ("framework", pa.string()), ("handler", pa.string())]))),
])
FACTS = "imports array<string>, symbols array<struct<kind:string,name:string,start_line:int,exported:boolean,signature:string>>, routes array<struct<method:string,route_path:string,start_line:int,framework:string,handler:string>>"


def _facts(content: pa.Array) -> pa.Array:
    return pa.array([None if c is None else facts_of(c) for c in content.to_pylist()], _TYPE)


def is_script(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(?:" + "|".join(e[1:] for e in EXTENSIONS) + ")$")


def facts(path: Column, content: Column) -> Column:
    """imports, symbols and routes of a script's text; null for other files, which are not sent to Python."""
    return F.arrow_udf(_facts, FACTS)(F.when(is_script(path), content))
