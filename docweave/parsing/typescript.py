"""Symbols, imports, exports and calls of TypeScript and JavaScript text.

One pass makes tokens (comments dropped, the doc comment before a token kept,
templates split around their expressions), one pass pairs brackets, and one
scan over the tokens finds declarations. The scan keeps a scope, (class, named
callable), and recurses only into bodies that change it, so expressions need
no grammar. Purely syntactic: nothing is resolved.

A file may hold millions of tokens: they are kept as numbers, and what was found
goes to Arrow a few thousand rows at a time.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from docweave.functions import messages

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<name>[A-Za-z_$\u0080-￿#][\w$\u0080-￿]*)
    |(?P<number>\d[\w.]*)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')
    |(?P<punct>=>|\?\.(?!\d)|\.\.\.|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|[-+*/%&|^!~<>=?:;,.(){}\[\]@`])|(?P<other>.)""",
    re.S | re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.S)
_PAIRS = {"(": ")", "[": "]", "{": "}"}
_NO_CALL = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "super", "import", "with", "void", "delete", "yield", "in", "of"}
_OPERANDS_END = {"name", "number", "string", "template"}
_KEYWORDS_BEFORE_OPERAND = {"return", "typeof", "case", "in", "of", "do", "else", "void", "delete", "await", "yield", "new", "instanceof"}
_MODIFIERS = {"export", "default", "async", "declare", "abstract", "public", "private", "protected", "static", "readonly", "override", "accessor"}


class Token:
    __slots__ = ("doc", "end", "kind", "line_before", "start", "text")

    def __init__(self, kind, text, start, end, doc, line_before):
        self.kind, self.text, self.start, self.end, self.doc, self.line_before = kind, text, start, end, doc, line_before


_KINDS = ("name", "number", "string", "punct", "other", "template")
_KIND_NUMBER = {k: i for i, k in enumerate(_KINDS)}
_NAME, _PUNCT, _BACKTICK = (_KIND_NUMBER[k] for k in ("name", "punct", "template"))


class Tokens:
    """The tokens of a text in 14 bytes each; a Token is made when one is asked for."""

    def __init__(self, text: str):
        self.source, self.kinds, self.lines_before, self.docs = text, bytearray(), bytearray(), {}
        self.starts, self.ends = array("i"), array("i")

    def add(self, kind: str, start: int, end: int, doc: str | None, line_before: bool) -> None:
        if doc is not None:
            self.docs[len(self.kinds)] = doc
        self.kinds.append(_KIND_NUMBER[kind])
        self.lines_before.append(line_before)
        self.starts.append(start)
        self.ends.append(end)

    def text(self, i: int) -> str:
        if self.kinds[i] == _BACKTICK:
            return "`"
        text = self.source[self.starts[i] : self.ends[i]]
        return "{" if text == "${" else text

    def __len__(self) -> int:
        return len(self.kinds)

    def __getitem__(self, i):
        if isinstance(i, slice):
            return [self[k] for k in range(*i.indices(len(self)))]
        i = i + len(self) if i < 0 else i
        return Token(_KINDS[self.kinds[i]], self.text(i), self.starts[i], self.ends[i], self.docs.get(i), bool(self.lines_before[i]))


def tokenize(text: str) -> Tokens:
    out = Tokens(text)
    at, doc, line, depth = 0, None, True, []
    while at < len(text):
        m = _TOKEN.match(text, at)
        kind, value = m.lastgroup, m.group()
        if kind == "space":
            line |= "\n" in value
        elif kind == "comment":
            line |= "\n" in value
            if doc is None and value.startswith("/**"):
                doc = value
        else:
            if value == "/":
                last = out[-1] if len(out) else None
                operand = last is not None and (
                    (last.kind in _OPERANDS_END and last.text not in _KEYWORDS_BEFORE_OPERAND) or last.text in (")", "]", "}")
                )
                r = None if operand else _REGEX.match(text, at)
                if r:
                    kind, value = "string", r.group()
            elif value == "`" or (value == "}" and depth and depth[-1] == 0):
                if value == "}":
                    depth.pop()
                    out.add("punct", at, at + 1, None, False)
                body = _TEMPLATE.match(text, at + 1).end()
                closes = text[body : body + 1] == "`"
                end = body + 1 if closes else min(body + 2, len(text))
                out.add("template", at, body + 1 if closes else body, doc, line)
                if not closes and end <= len(text) and text[body : body + 2] == "${":
                    out.add("punct", body, end, None, False)
                    depth.append(0)
                at, doc, line = max(end, at + 1), None, False
                continue
            elif depth and value == "{":
                depth[-1] += 1
            elif depth and value == "}":
                depth[-1] -= 1
            out.add(kind, at, at + len(value), doc, line)
            doc, line = None, False
            at += len(value)
            continue
        at = m.end()
    return out


def _matches(tokens: Tokens) -> array:
    out, stack = array("i", range(len(tokens))), []
    for i, kind in enumerate(tokens.kinds):
        if kind != _PUNCT or tokens.source[tokens.starts[i]] not in "([{)]}$":
            continue
        text = tokens.text(i)
        if text in _PAIRS:
            stack.append(i)
        elif text in (")", "]", "}"):
            while stack and _PAIRS[tokens.text(stack[-1])] != text:
                stack.pop()
            if stack:
                j = stack.pop()
                out[i], out[j] = j, i
    for j in stack:
        out[j] = len(tokens) - 1
    return out


FOUND = ("symbols", "imports", "exports", "calls", "unsupported")


class _File:
    def __init__(self, path: str, text: str, found: dict):
        self.path, self.text = path, text
        self.tokens = tokenize(text)
        self.starts, self.ends, self.count = self.tokens.starts, self.tokens.ends, len(self.tokens)
        self.pair = _matches(self.tokens)
        self.lines = array("i", [0])
        self.lines.extend(m.end() for m in re.finditer("\n", text))
        self.symbols, self.imports, self.exports, self.calls, self.unsupported = (found[k] for k in FOUND)

    # ------------------------------------------------------------------ helpers
    def at(self, i: int) -> str:
        if not 0 <= i < self.count:
            return ""
        text = self.text[self.starts[i] : self.ends[i]]
        # rare: a part of a template, whose token is not what stands there
        return self.tokens.text(i) if text[0] in "`$}" else text

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens.kinds[i] == _NAME

    def place(self, offset: int) -> tuple[int, int]:
        line = bisect_right(self.lines, offset)
        return line, offset - self.lines[line - 1] + 1

    def span(self, first: int, last: int) -> dict:
        (a, b), (c, d) = self.place(self.tokens[first].start), self.place(self.tokens[min(last, len(self.tokens) - 1)].end)
        return {"startLine": a, "startColumn": b, "endLine": c, "endColumn": d}

    def symbol(self, kind, name, first, last, exported=False, default=False, parent=None) -> str:
        qualified = f"{parent[1]}.{name}" if parent else name
        own = {
            "id": f"{self.path}#{qualified}:{kind}", "kind": kind, "name": name, "qualified_name": qualified, "path": self.path,
            "location": self.span(first, last), "exported": exported, "is_default_export": default, "doc": self.tokens[first].doc,
            "parent_id": parent[0] if parent else None,
        }
        self.symbols.append(own)
        if exported:
            self.export("default" if default else name, name, None, own["location"])
        return own["id"]

    def export(self, name, local, source, location) -> None:
        self.exports.append({"exported_name": name, "local_name": local, "re_export_from": source, "location": location})

    def skip_type(self, i: int, end: int, stops: tuple[str, ...]) -> int:
        """The first of ``stops`` outside brackets from i on."""
        angle = 0
        while i < end:
            t = self.at(i)
            if angle <= 0 and t in stops:
                return i
            angle += (t == "<") - (t == ">")
            i = self.pair[i] + 1 if t in _PAIRS else i + 1
        return i

    def function_body(self, i: int, end: int) -> tuple[int, int] | None:
        """(first, last) of the body of a function whose ``(`` is at or after i;
        first > last for a bodyless one."""
        while i < end and self.at(i) != "(":
            i += 1
        if i >= end:
            return None
        params = (i, self.pair[i])
        i = self.pair[i] + 1
        if self.at(i) == ":":
            # a return type; an object type in it is not the body
            i = i + 1
            if self.at(i) == "{":
                i = self.pair[i] + 1
            i = self.skip_type(i, end, ("{", ";"))
        self.params = params
        return (i, self.pair[i]) if self.at(i) == "{" else (i, i - 1)

    def expression_end(self, i: int, end: int) -> int:
        """Last token of the expression from i on: up to a ``;`` or ``,`` outside
        brackets, a closing bracket, or a line end where an expression may end."""
        while i < end:
            t = self.at(i)
            i = self.pair[i] if t in _PAIRS else i
            nxt = self.at(i + 1)
            if i + 1 >= end or nxt in (";", ",", ")", "]", "}"):
                return i
            ends = self.tokens[i].kind in _OPERANDS_END or self.at(i) in (")", "]", "}")
            starts = self.tokens[i + 1].kind in ("name", "number", "string") or nxt in ("@",)
            if self.tokens[i + 1].line_before and ends and starts and nxt not in ("in", "instanceof", "as", "satisfies"):
                return i
            i += 1
        return end - 1

    # ------------------------------------------------------------------- walking
    def function_value(self, i: int, end: int):
        """If an arrow function or a function expression starts at i: (body
        first, body last, last token of the whole), else None."""
        j = i + 1 if self.at(i) == "async" and not self.tokens[i + 1 : i + 2] == [] and self.at(i + 1) in ("(", "function", "<") or (self.at(i) == "async" and self.is_name(i + 1)) else i
        if self.at(j) == "function":
            body = self.function_body(j, end)
            return (*body, body[1]) if body and body[0] <= body[1] else None
        if self.at(j) == "<":
            j = self.skip_type(j + 1, end, (">",)) + 1
        if self.at(j) == "(":
            k = self.pair[j] + 1
            if self.at(k) == ":":
                k = self.skip_type(k + 1, end, ("=>", ";", ","))
        elif self.is_name(j):
            k = j + 1
        else:
            return None
        if self.at(k) != "=>":
            return None
        if self.at(k + 1) == "{":
            return k + 1, self.pair[k + 1], self.pair[k + 1]
        last = self.expression_end(k + 1, end)
        return k + 1, last, last

    def statement_start(self, i: int) -> int | None:
        """First token of the declaration whose keyword is at i (with its
        modifiers); None if the keyword stands inside an expression."""
        j = i
        while j > 0 and self.at(j - 1) in _MODIFIERS and self.is_name(j - 1):
            j -= 1
        while j > 1 and self.at(j - 2) == "@":
            j -= 2
        before = self.at(j - 1)
        if j == 0 or before in (";", "{", "}", ")") or before == ":" or (self.tokens[j].line_before and before not in ("=", "(", ",", "=>", "return", "&&", "||", "?", "??", "[", "...", "new", "typeof", "await", "!")):
            return j
        return None

    def walk(self, i: int, end: int, cls, callable_: str | None) -> None:
        while i < end:
            if self.tokens.kinds[i] != _NAME:
                i += 1
                continue
            text = self.tokens.text(i)
            dotted = self.at(i - 1) in (".", "?.")
            if not dotted:
                done = None
                if text == "import" and self.at(i + 1) not in ("(", "."):
                    done = self.import_(i, end)
                elif text == "export":
                    done = self.export_(i, end)
                elif text == "function":
                    done = self.function_(i, end, cls)
                elif text == "class":
                    done = self.class_(i, end)
                elif text in ("const", "let", "var"):
                    done = self.variables(i, end, cls, callable_)
                if done is not None:
                    i = done
                    continue
            self.call(i, callable_)
            i += 1

    def call(self, i: int, callable_: str | None) -> None:
        """Record a call whose callee is the dotted chain that starts at i."""
        if self.at(i - 1) in (".", "?.", "new", "function", "get", "set") or self.at(i) in _NO_CALL or self.at(i).startswith("#"):
            return
        if self.at(i - 1) in (")", "]") and not self.tokens[i].line_before:
            return
        j = i
        while self.at(j + 1) == "." and self.is_name(j + 2):
            j += 2
        k = j + 1
        if self.at(k) == "<":
            close = self.skip_type(k + 1, min(k + 40, len(self.tokens)), (">",))
            plain = all(t.kind == "name" or t.text in (",", ".", "[", "]", "|", "<", ">") for t in self.tokens[k : close + 1])
            k = close + 1 if plain and self.at(close) == ">" else k
        if self.at(k) != "(" or self.pair[k] <= k:
            return
        if self.at(self.pair[k] + 1) == "{" and self.at(i - 1) in ("{", ",", "}", "async", "*"):
            return  # a method of an object literal
        name = self.text[self.tokens[i].start : self.tokens[j].end]
        self.calls.append({"caller_symbol_id": callable_, "callee_name": name, "location": self.span(i, self.pair[k])})

    def modifiers(self, first: int, i: int) -> tuple[bool, bool]:
        own = {self.at(k) for k in range(first, i)}
        return "export" in own, "default" in own

    def function_(self, i: int, end: int, cls) -> int | None:
        first = self.statement_start(i)
        if first is None:
            return None
        exported, default = self.modifiers(first, i)
        j = i + 2 if self.at(i + 1) == "*" else i + 1
        name = self.at(j) if self.is_name(j) else "default" if default else None
        body = self.function_body(i, end)
        if name is None or body is None:
            return None
        own = self.symbol("function", name, first, max(body[1], body[0] - 1), exported, default)
        self.walk(*(body[0] + 1, body[1]) if body[1] >= body[0] else (0, 0), cls, own)
        return max(body[1], body[0] - 1) + 1

    def class_(self, i: int, end: int) -> int | None:
        first = self.statement_start(i)
        if first is None or not self.is_name(i + 1) or self.at(i + 1) in ("extends", "implements"):
            return None
        exported, default = self.modifiers(first, i)
        open_ = self.skip_type(i + 2, end, ("{",))
        if self.at(open_) != "{":
            return None
        close = self.pair[open_]
        name = self.at(i + 1)
        own = (self.symbol("class", name, first, close, exported, default), name)
        self.members(open_ + 1, close, own)
        return close + 1

    def members(self, i: int, end: int, own: tuple[str, str]) -> None:
        while i < end:
            if self.at(i) in (";", ","):
                i += 1
                continue
            first = i
            while self.at(i) == "@":
                i += 2
                while self.at(i) == ".":
                    i += 2
                i = self.pair[i] + 1 if self.at(i) == "(" else i
            while self.at(i) in _MODIFIERS and self.at(i + 1) not in ("(", "=", ";", ":", "?", "!", "<", ",") and i + 1 < end:
                i += 1
            if self.at(i) in ("get", "set") and self.at(i + 1) not in ("(", "=", ";", ":", "?", "<"):
                i += 1
            if self.at(i) == "*":
                i += 1
            computed = self.at(i) == "[" or (i < end and self.tokens[i].kind in ("string", "number")) or self.at(i).startswith("#")
            name_at = i
            i = self.pair[i] + 1 if self.at(i) == "[" else i + 1
            while self.at(i) in ("?", "!"):
                i += 1
            if self.at(i) == "{" and self.at(name_at) == "static":
                i = self.pair[i] + 1
                continue
            if self.at(i) in ("(", "<"):
                body = self.function_body(i, end)
                if body is None:
                    return
                last = body[1] if body[1] >= body[0] else body[0] - 1
                if computed:
                    self.unsupported.append({"description": messages.COMPUTED_NAME, "location": self.span(first, last)})
                else:
                    method = self.symbol("method", self.at(name_at), first, last, parent=own)
                    if body[1] >= body[0]:
                        self.walk(body[0] + 1, body[1], own, method)
                i = last + 1
                continue
            # a field: skip its type, look at its value
            if self.at(i) == ":":
                angle = i + 1
                while angle < end and self.at(angle) not in ("=", ";") and not (self.tokens[angle].line_before and self.at(angle - 1) not in ("|", "&", ":", "=>", ",")):
                    angle = self.pair[angle] + 1 if self.at(angle) in _PAIRS else angle + 1
                i = angle
            if self.at(i) == "=":
                value = self.function_value(i + 1, end)
                last = value[2] if value else self.expression_end(i + 1, end)
                if value and not computed:
                    closing = last + 1 if self.at(last + 1) == ";" else last
                    method = self.symbol("method", self.at(name_at), first, closing, parent=own)
                    self.walk(value[0], value[1] + 1, own, method)
                i = last + 1

    def variables(self, i: int, end: int, cls, callable_: str | None) -> int | None:
        first = self.statement_start(i)
        in_statement = first is not None and self.at(i - 1) != "("
        exported = in_statement and self.modifiers(first, i)[0]
        first = first if in_statement else i
        j = i + 1
        while j < end:
            name_at = j
            if self.at(j) in ("{", "["):
                if exported:
                    self.unsupported.append({"description": messages.DESTRUCTURED_EXPORT, "location": self.span(j, self.pair[j])})
                self.walk(j + 1, self.pair[j], cls, callable_)
                j = self.pair[j] + 1
            elif self.is_name(j):
                j += 1
            else:
                return j
            if self.at(j) == "!":
                j += 1
            if self.at(j) == ":":
                j = self.skip_type(j + 1, end, ("=", ";", ",", ")", "of", "in"))
            if self.at(j) != "=":
                return j if self.at(j) != "," else self.variables(j, end, cls, callable_)
            value = self.function_value(j + 1, end)
            if value and self.is_name(name_at):
                last = value[2] + 1 if self.at(value[2] + 1) == ";" and in_statement else value[2]
                own = self.symbol("function", self.at(name_at), first, last, exported)
                self.walk(value[0], value[1] + 1, cls, own)
                j = value[2] + 1
            else:
                last = self.expression_end(j + 1, end)
                self.walk(j + 1, last + 1, cls, callable_)
                j = last + 1
            if self.at(j) != ",":
                return j
            j += 1
        return j

    # --------------------------------------------------------- imports and exports
    def clause_end(self, i: int, end: int) -> int:
        while i < end and self.at(i) != ";" and not (self.tokens[i].kind == "string"):
            i = self.pair[i] + 1 if self.at(i) == "{" else i + 1
        return i

    def names(self, i: int) -> list[tuple[str, str]]:
        """(outer, local) of a braced list that opens at i."""
        out, j = [], i + 1
        while j < self.pair[i]:
            if self.at(j) == "type" and self.is_name(j + 1) and self.at(j + 1) != "as":
                j += 1
            outer = local = self.at(j)
            if self.at(j + 1) == "as":
                local = self.at(j + 2)
                j += 2
            out.append((outer, local))
            j += 2
        return out

    def import_(self, i: int, end: int) -> int:
        last = self.clause_end(i + 1, end)
        j = i + 1
        own = {"specifier": self.at(last)[1:-1], "named": [], "default_local": None, "namespace_local": None, "type_only": False}
        if self.at(j) == "type" and self.at(j + 1) != "from" and self.at(j + 1) != ",":
            own["type_only"], j = True, j + 1
        while j < last:
            if self.at(j) == "{":
                own["named"] = [{"imported": a, "local": b} for a, b in self.names(j)]
                j = self.pair[j] + 1
            elif self.at(j) == "*":
                own["namespace_local"], j = self.at(j + 2), j + 3
            elif self.is_name(j) and self.at(j) != "from":
                own["default_local"], j = self.at(j), j + 1
            else:
                j += 1
        closing = last + 1 if self.at(last + 1) == ";" else last
        self.imports.append(own | {"location": self.span(i, closing)})
        return closing + 1

    def export_(self, i: int, end: int) -> int | None:
        j = i + 2 if self.at(i + 1) == "type" and self.at(i + 2) in ("{", "*") else i + 1
        if self.at(j) == "=":
            last = self.expression_end(j + 1, end)
            self.unsupported.append({"description": messages.EXPORT_ASSIGNMENT, "location": self.span(i, last)})
            return j + 1
        if self.at(j) in ("{", "*"):
            k = self.pair[j] + 1 if self.at(j) == "{" else j + 3 if self.at(j + 1) == "as" else j + 1
            last, source = (k + 1, self.at(k + 1)[1:-1]) if self.at(k) == "from" else (k - 1, None)
            where = self.span(i, last + 1 if self.at(last + 1) == ";" else last)
            if self.at(j) == "*":
                self.export(self.at(j + 2) if self.at(j + 1) == "as" else "*", None, source, where)
            else:
                for local, name in self.names(j):
                    self.export(name, local, source, where)
            return last + 1
        if self.at(j) == "default" and self.at(j + 1) not in ("function", "class", "async", "abstract", "interface"):
            last = self.expression_end(j + 1, end)
            local = self.at(j + 1) if last == j + 1 and self.is_name(last) else None
            self.export("default", local, None, self.span(i, last + 1 if self.at(last + 1) == ";" else last))
            return j + 1
        return None


def parse(path: str, text: str) -> dict:
    """Symbols, imports, exports, calls and unsupported constructs of a file."""
    return _parse_into(path, text, {k: [] for k in FOUND})


def _parse_into(path: str, text: str, found: dict) -> dict:
    f = _File(path, text, found)
    f.walk(0, len(f.tokens), None, None)
    return found


_PLACE = pa.struct([(n, pa.int32()) for n in ("startLine", "startColumn", "endLine", "endColumn")])
_TEXTS = lambda *names: [(n, pa.string()) for n in names]
_ARROW = {
    "symbols": pa.struct([
        *_TEXTS("id", "kind", "name", "qualified_name", "path"), ("location", _PLACE), ("exported", pa.bool_()), ("is_default_export", pa.bool_()), *_TEXTS("doc", "parent_id"),
    ]),
    "imports": pa.struct([
        *_TEXTS("specifier"), ("named", pa.list_(pa.struct(_TEXTS("imported", "local")))), *_TEXTS("default_local", "namespace_local"), ("type_only", pa.bool_()), ("location", _PLACE),
    ]),
    "exports": pa.struct([*_TEXTS("exported_name", "local_name", "re_export_from"), ("location", _PLACE)]),
    "calls": pa.struct([*_TEXTS("caller_symbol_id", "callee_name"), ("location", _PLACE)]),
    "unsupported": pa.struct([*_TEXTS("description"), ("location", _PLACE)]),
}
_LOCATION = "struct<startLine:int,startColumn:int,endLine:int,endColumn:int>"
SCHEMA = (
    "path string, symbols array<struct<id:string,kind:string,name:string,qualified_name:string,path:string,"
    f"location:{_LOCATION},exported:boolean,is_default_export:boolean,doc:string,parent_id:string>>, "
    "imports array<struct<specifier:string,named:array<struct<imported:string,local:string>>,default_local:string,"
    f"namespace_local:string,type_only:boolean,location:{_LOCATION}>>, "
    f"exports array<struct<exported_name:string,local_name:string,re_export_from:string,location:{_LOCATION}>>, "
    f"calls array<struct<caller_symbol_id:string,callee_name:string,location:{_LOCATION}>>, "
    f"unsupported array<struct<description:string,location:{_LOCATION}>>"
)


class _Rows:
    """Rows of one kind that were found in a file, as Arrow."""

    def __init__(self, type_: pa.DataType, most: int = 4096):
        self.type, self.most, self.rows, self.done = type_, most, [], []

    def append(self, row: dict) -> None:
        self.rows.append(row)
        if len(self.rows) >= self.most:
            self.flush()

    def flush(self) -> None:
        self.done.append(pa.array(self.rows, self.type))
        self.rows = []

    def listed(self) -> pa.ListArray:
        """All of them as one list."""
        self.flush()
        values = pa.concat_arrays(self.done)
        self.done = []
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each file, which goes out before the next file is read."""
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            found = _parse_into(path.as_py(), content.as_py() or "", {k: _Rows(t) for k, t in _ARROW.items()})
            yield pa.RecordBatch.from_arrays([pa.array([path.as_py()], pa.string()), *[found[k].listed() for k in FOUND]], ["path", *FOUND])


def parse_files(files: DataFrame) -> DataFrame:
    """One row with five arrays for each of files(path, content). Parsing costs
    far more than its bytes tell, so files are dealt to a given number of tasks."""
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path", "content").repartition(tasks, "path").mapInArrow(_parse_batches, SCHEMA)
