"""TypeScript facts by a tokenizer and recursive descent, one pass per file.

The tokenizer keeps a stack of modes, so that templates may hold code that holds
templates, a slash is a division or a pattern by what stands before it, and elements of
``.tsx`` files are passed over but for the code in their braces. Declarations at the top
level and members of classes and interfaces become entities; calls are read off the
tokens of a body. What does not parse is passed over token by token, so one odd place
does not hide the declarations after it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import module_id
from .extract import FACTS, python_facts, read

_SPACE = re.compile(r"\s+|﻿")
_NAME = re.compile(r"#?[^\W\d][\w$]*|\$[\w$]*|#\$[\w$]*")
_NUMBER = re.compile(r"0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*)?\.?\d[\d_]*(?:[eE][+-]?\d+)?n?")
_STRING = re.compile(r"\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?", re.S)
_PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
_COMMENT = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)", re.S)
_MARK = re.compile(r"=>|\?\.(?!\d)|\.\.\.|\+\+|--|[-+*/%&|^!=<?]=?|.", re.S)
_TEXT = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.S)
_ELEMENT = re.compile(r"<(?:>|[A-Za-z_$][\w$.:-]*(?=[\s/>]))")

#: Words after which an expression begins, so that a slash there begins a pattern.
_BEFORE_VALUE = frozenset("return typeof case in of delete void instanceof new throw do else yield await default extends".split())
_MODIFIERS = frozenset("public private protected static async readonly abstract override declare accessor get set".split())
#: Words before a parenthesis that call nothing.
_NOT_CALLS = frozenset("if for while switch catch function return typeof await super import with in of delete void instanceof new throw do else yield case default export extends as satisfies".split())
_OPEN = {"(": ")", "[": "]", "{": "}", "${": "}"}
#: Marks that cannot end a statement, and those that go on with the one before.
_GOES_ON = frozenset("= == => ? : , . ?. + - * / % & | ^ ! < ... ( [ { ${ += -= *= |= &= != <= ?= && ||".split())
_CONTINUES = frozenset("= => ? : , . ?. + - * / % & | ^ < > ( [ ) ] ; += -= == != <=".split())


class Token(NamedTuple):
    """``kind`` is name, number, string, template, pattern, comment or mark; text[at:end] is what it covers."""

    kind: str
    text: str
    at: int
    end: int


def tokens(text: str, elements: bool = False) -> list[Token]:
    """Tokens and comments of a source; ``elements`` passes over elements such as ``<a b={c}>d</a>``."""
    out: list[Token] = []
    # What each open bracket belongs to: the bracket and whether an expression begins after it closes.
    stack: list[tuple[str, bool]] = []
    at, n, last = 0, len(text), None

    def value_next() -> bool:
        """Whether an expression, not an operator, comes next."""
        if last is None:
            return True
        if last.kind == "name":
            return last.text in _BEFORE_VALUE
        if last.kind == "mark":
            return closed if last.text in ")}" else last.text not in ("]", "++", "--")
        return False

    def template(start: int) -> int:
        """Passes a template's text from ``start`` on, up to its end or to code inside it."""
        nonlocal last
        end = _TEXT.match(text, start).end()
        if text.startswith("${", end):
            stack.append(("${", False))
            last = Token("mark", "${", end, end + 2)
            out.append(last)
            return end + 2
        last = Token("template", "`", end, min(end + 1, n))
        out.append(last)
        return end + 1

    def element(start: int) -> int:
        """Passes an element from its ``<`` on; code in braces is left in the tokens."""
        nonlocal at
        depth, at = 0, start
        while at < n:
            if text.startswith("</", at):
                at, depth = text.find(">", at) + 1 or n, depth - 1
            elif m := _ELEMENT.match(text, at):
                at, depth = m.end(), depth + 1
                while m[0] != "<>" and at < n and text[at] != ">" and not text.startswith("/>", at):
                    inside()
                if m[0] != "<>":
                    depth -= text.startswith("/>", at)
                    at += 2 if text.startswith("/>", at) else 1
            elif text[at] == "{":
                inside()
            else:
                at += 1
            if depth <= 0:
                break
        return at

    def inside() -> None:
        """Of an element: a string, code in braces or one other character."""
        nonlocal at, last
        if text[at] == "{":
            base = len(stack)
            push("{", False)
            while at < n and len(stack) > base:
                step()
        elif text[at] in "\"'":
            at = text.find(text[at], at + 1) + 1 or n
        else:
            at += 1

    def push(mark: str, then_value: bool) -> None:
        nonlocal at, last
        stack.append((mark, then_value))
        last = Token("mark", mark, at, at + len(mark))
        out.append(last)
        at += len(mark)

    closed = False

    def step() -> None:
        nonlocal at, last, closed
        if m := _SPACE.match(text, at):
            at = m.end()
            return
        c = text[at]
        if m := _COMMENT.match(text, at):
            out.append(Token("comment", m[0], at, m.end()))
            at = m.end()
            return
        if c == "`":
            out.append(Token("template", "`", at, at + 1))
            at = template(at + 1)
            return
        if c == "<" and elements and value_next() and _ELEMENT.match(text, at) and not re.match(r"<\w+\s+extends\b", text[at : at + 80]):
            start = at
            at = element(at)
            last = Token("string", "<>", start, at)
            out.append(last)
            return
        for kind, what in (("name", _NAME), ("number", _NUMBER), ("string", _STRING)):
            if m := what.match(text, at):
                last = Token(kind, m[0], at, m.end())
                out.append(last)
                at = m.end()
                return
        if c == "/" and value_next() and (m := _PATTERN.match(text, at)):
            last = Token("pattern", m[0], at, m.end())
            out.append(last)
            at = m.end()
            return
        if c in "([":
            push(c, c == "(" and last is not None and last.text in ("if", "while", "for", "with"))
            return
        if c == "{":
            # A block, after which a statement begins, unless the brace stands where a value does.
            block = last is None or last.text in (")", ";", "{", "}", "=>", "else", "try", "finally", "do") or last.kind == "name" and last.text not in _BEFORE_VALUE
            push(c, block)
            return
        if c in ")]}":
            mark, then_value = stack.pop() if stack else (c, True)
            closed = then_value
            if mark == "${":
                out.append(Token("mark", "}", at, at + 1))
                at = template(at + 1)
                return
            last = Token("mark", c, at, at + 1)
            out.append(last)
            at += 1
            return
        m = _MARK.match(text, at)
        last = Token("mark", m[0], at, m.end())
        out.append(last)
        at = m.end()

    while at < n:
        step()
    return out


class _TypeScript:
    """Facts of one TypeScript file."""

    def __init__(self, repo: str, path: str, text: str, module: str):
        self.repo, self.path, self.text, self.module, self.rows = repo, path, text, module, []
        self.every = tokens(text, path.endswith("x"))
        self.places = [i for i, t in enumerate(self.every) if t.kind != "comment"]
        self.code = [self.every[i] for i in self.places]
        self.lines = [i for i, c in enumerate(text) if c == "\n"]
        self.pair = self._pairs()

    def _pairs(self) -> list[int]:
        """For every bracket, the place of its partner; the last token for those that never close."""
        pair, stack = [-1] * len(self.code), []
        for i, t in enumerate(self.code):
            if t.kind != "mark":
                continue
            if t.text in _OPEN:
                stack.append(i)
            elif t.text in ")]}":
                while stack and _OPEN[self.code[stack[-1]].text] != t.text:
                    pair[stack.pop()] = i - 1
                if stack:
                    pair[i] = stack[-1]
                    pair[stack.pop()] = i
        for i in stack:
            pair[i] = len(self.code) - 1
        return pair

    def add(self, kind: str, **x) -> None:
        self.rows.append({"repo_id": self.repo, "file_path": self.path, "kind": kind, "seq": len(self.rows), **x})

    def line(self, at: int) -> int:
        return bisect_left(self.lines, at) + 1

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.code) and self.code[i].kind in ("mark", "name") and self.code[i].text in texts

    def name_at(self, i: int) -> bool:
        return 0 <= i < len(self.code) and self.code[i].kind == "name"

    def new_line(self, i: int) -> bool:
        """Whether a line ends between a token and the one before."""
        return i == 0 or i >= len(self.code) or "\n" in self.text[self.code[i - 1].end : self.code[i].at]

    def documented(self, i: int) -> bool:
        """Whether, of the comments right before a token (commas and semicolons aside), one has two stars."""
        k = self.places[i] - 1
        while k >= 0:
            t = self.every[k]
            if t.kind == "comment" and t.text.startswith("/**"):
                return True
            if t.kind != "comment" and t.text not in (";", ","):
                return False
            k -= 1
        return False

    def entity(self, name: str, kind: str, parent: str, first: int, last: int, doc: bool) -> str:
        own, a, b = f"{parent}.{name}", self.code[first].at, self.code[last].end
        self.add("entity", id=own, parent_id=parent, name=name, type=kind, line=self.line(a), end_line=self.line(b - 1), has_docstring=doc, source=self.text[a:b])
        return own

    # --- passing over tokens: each takes a place and gives the place after what it passes

    def angles(self, i: int) -> int | None:
        """After the type parameters or arguments that begin at ``i``, or None if that is no list of types."""
        i += 1
        while i < len(self.code):
            if self.is_(i, ">"):
                return i + 1
            if self.is_(i, "in", "out", "const", "extends", ",", "=") and not self.is_(i + 1, ">", "[") or self.is_(i, ",", "="):
                i += 1
                continue
            after = self.type_(i)
            if after == i:
                return None
            i = after
        return None

    def type_(self, i: int) -> int:
        """After the type that begins at ``i``."""
        while True:
            while self.is_(i, "|", "&", "keyof", "typeof", "readonly", "unique", "infer", "asserts", "new", "abstract", "-") and not (self.is_(i + 1, ">", ",", ")", ";", "=") or self.code[i].kind == "name" and self.new_line(i + 1)):
                i += 1
            if i >= len(self.code):
                return i
            t = self.code[i]
            if t.text == "<" and (after := self.angles(i)):
                i = after
            if self.is_(i, "(", "{", "["):
                i = self.pair[i] + 1
                if self.is_(i, "=>"):
                    i += 1
                    continue
            elif t.kind in ("string", "number"):
                i += 1
            elif t.kind == "template":
                i += 1
                while i < len(self.code) and self.code[i].kind != "template":
                    i = self.pair[i] + 1 if self.pair[i] > i else i + 1
                i += 1
            elif t.kind == "name":
                i += 1
                while self.is_(i, ".") and self.name_at(i + 1):
                    i += 2
                if self.is_(i, "<") and (after := self.angles(i)):
                    i = after
            else:
                return i
            while self.is_(i, "[") and not self.new_line(i):
                i = self.pair[i] + 1
            if self.is_(i, "is") and not self.new_line(i):
                i += 1
                continue
            if self.is_(i, "extends"):
                i += 1
                continue
            if self.is_(i, "?") and self.conditional(i):
                i = self.type_(i + 1)
                i += self.is_(i, ":")
                continue
            if not self.is_(i, "|", "&"):
                return i

    def conditional(self, i: int) -> bool:
        return any(self.is_(k, "extends") for k in range(max(0, i - 12), i))

    def expression(self, i: int, end: int) -> int:
        """After the initialiser that begins at ``i``: at a semicolon, or where a line ends a statement."""
        first = i
        while i < end:
            if self.is_(i, ";"):
                return i
            if i > first and self.new_line(i) and not (self.code[i].kind == "mark" and self.code[i].text in _CONTINUES) and not (self.code[i - 1].kind == "mark" and self.code[i - 1].text in _GOES_ON) and not self.is_(i - 1, *_BEFORE_VALUE) and not self.is_(i, "in", "instanceof", "as", "satisfies"):
                return i
            i = self.pair[i] + 1 if self.pair[i] > i else i + 1
        return end

    def decorators(self, i: int) -> int:
        while self.is_(i, "@"):
            i += 1
            if self.is_(i, "("):
                i = self.pair[i] + 1
                continue
            i += 1
            while self.is_(i, "."):
                i += 2
            if self.is_(i, "("):
                i = self.pair[i] + 1
        return i

    def signature(self, i: int) -> int:
        """After type parameters, parameters and the type of what is returned."""
        if self.is_(i, "<"):
            i = self.angles(i) or i + 1
        if self.is_(i, "("):
            i = self.pair[i] + 1
        if self.is_(i, ":"):
            i = self.type_(i + 1)
        return i

    # --- facts

    def run(self) -> list[dict]:
        name = self.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        self.add("entity", id=self.module, name=name, type="module", line=1, end_line=len(self.lines) + 1, has_docstring=self.top_comment(), source=self.text)
        i, spans = 0, []
        while i < len(self.code):
            if self.starts(i):
                if self.is_(i, "import") and not self.is_(i + 1, "(", "."):
                    i = self.imports(i)
                    continue
                if after := self.declaration(i):
                    spans.append((i, after))
                    i = after
                    continue
            i = self.pair[i] + 1 if self.pair[i] > i else i + 1
        self.calls(self.module, 0, len(self.code), spans)
        self.types(self.module, 0, len(self.code))
        return self.rows

    def top_comment(self) -> bool:
        """Whether a comment of two stars stands at the top level."""
        depth = 0
        for t in self.every:
            if t.kind == "comment" and depth == 0 and t.text.startswith("/**"):
                return True
            if t.kind == "mark":
                depth += (t.text in _OPEN) - (t.text in ")]}")
        return False

    def starts(self, i: int) -> bool:
        """Whether a statement may begin at ``i``, a token of the top level."""
        if i == 0 or self.is_(i - 1, ";", "}"):
            return True
        before = self.code[i - 1]
        return self.new_line(i) and not (before.kind == "mark" and before.text in _GOES_ON)

    def declaration(self, first: int) -> int | None:
        """After the class, interface or function that begins at ``first``, if one does."""
        i = self.decorators(first)
        while self.is_(i, "export", "default", "declare", "abstract", "async") and not self.is_(i + 1, "(", "=", ":", ",", ";", "."):
            i = self.decorators(i + 1)
        if not self.is_(i, "class", "interface", "function"):
            return None
        kind, at = self.code[i].text, i
        i += 1 + (kind == "function" and self.is_(i + 1, "*"))
        if not self.name_at(i) or self.is_(i, "extends", "implements"):
            return None
        name, i = self.code[i].text, i + 1
        # A comment may stand before the export or, rarely, between it and the declaration.
        doc = self.documented(first) or self.documented(at)
        if kind == "function":
            i = self.signature(i)
            if not self.is_(i, "{"):  # an overload or a declaration without a body
                return None
            end = self.pair[i]
            own = self.entity(name, kind, self.module, first, end, doc)
            self.body(own, i, end)
            return end + 1
        if self.is_(i, "<"):
            i = self.angles(i) or i + 1
        bases: list[tuple[str, str]] = []
        while i < len(self.code) and not self.is_(i, "{"):
            if self.is_(i, "extends", "implements"):
                word, i = self.code[i].text, i + 1
                while i < len(self.code):
                    a = i
                    while self.name_at(i) and not self.is_(i, "implements", "extends"):
                        i += 1 + self.is_(i + 1, ".")
                    b = i
                    if self.is_(i, "<"):
                        i = self.angles(i) or i + 1
                    called = self.is_(i, "(")
                    i = self.pair[i] + 1 if called else i
                    if b > a and not called:
                        bases.append((word, self.text[self.code[a].at : self.code[b - 1].end]))
                    if not self.is_(i, ","):
                        i += i == a
                        break
                    i += 1
            else:
                i += 1
        if i >= len(self.code):
            return None
        end = self.pair[i]
        own = self.entity(name, kind, self.module, first, end, doc)
        for word, base in bases:
            self.add("base", id=own, name=base, line=self.line(self.code[first].at), receiver=word)
        self.members(own, i + 1, end)
        return end + 1

    def members(self, own: str, i: int, end: int) -> None:
        while i < end:
            if self.is_(i, ";", ","):
                i += 1
                continue
            i = first = self.decorators(i)
            while self.name_at(i) and self.code[i].text in _MODIFIERS and not self.is_(i + 1, "(", "<", "=", ":", ";", "?", "!", ",", "}") and not (self.new_line(i + 1) and i + 1 < end and self.code[i].text in ("get", "set", "static")):
                i += 1
            i += self.is_(i, "*")
            if i >= end:
                return
            if self.is_(i, "static") and self.is_(i + 1, "{") or self.is_(i, "{"):
                i = self.pair[i + self.is_(i, "static")] + 1
                continue
            token = self.code[i]
            if token.text == "[":  # computed, or an index signature
                name, i = self.text[token.at : self.code[self.pair[i]].end], self.pair[i] + 1
            elif token.text in ("(", "<"):  # what an interface's value is called with
                name = ""
            else:
                name, i = token.text.strip("\"'") if token.kind == "string" else token.text, i + 1
            i += self.is_(i, "?", "!")
            if not self.is_(i, "(", "<"):
                i = self.type_(i + 1) if self.is_(i, ":") else i
                i = self.expression(i + 1, end) if self.is_(i, "=") else i if self.is_(i, ";", ",") or i > first else i + 1
                continue
            opened = self.angles(i) or i + 1 if self.is_(i, "<") else i
            i = self.signature(i)
            last = self.pair[i] if self.is_(i, "{") else i - 1
            if name:
                child = self.entity(name, "method", own, first, min(last, end), self.documented(first) and not self.is_(first - 1, ")"))
                if name == "constructor" and self.is_(opened, "("):
                    self.attributes(own, opened, self.pair[opened])
                if self.is_(i, "{"):
                    self.body(child, i, last)
            i = last + 1

    def attributes(self, own: str, i: int, end: int) -> None:
        """Parameters of a constructor that are attributes as well."""
        for k in range(i, end):
            if self.is_(k, "private", "public", "protected", "readonly", "override") and self.name_at(k + 1) and self.code[k + 1].text not in _MODIFIERS:
                at = k + 2 + self.is_(k + 2, "?")
                if self.is_(at, ":") and self.name_at(at + 1) and self.code[at + 1].text[0].isupper():
                    self.add("attr", id=own, local=self.code[k + 1].text, name=self.code[at + 1].text, line=0)

    def body(self, own: str, a: int, b: int) -> None:
        self.calls(own, a, b + 1, [])
        self.types(own, a, b + 1)

    def calls(self, own: str, a: int, b: int, without: list[tuple[int, int]]) -> None:
        inside = {k for x, y in without for k in range(x, y)}
        for i in range(a, b):
            if i in inside or not self.name_at(i):
                continue
            if self.is_(i, "new") and self.name_at(i + 1) and not self.is_(i - 1, "."):
                k = i + 1
                while self.is_(k + 1, ".") and self.name_at(k + 2):
                    k += 2
                who = self.text[self.code[i + 1].at : self.code[k].end]
                self.add("call", id=own, name="constructor", receiver=who, on_self=False, line=self.line(self.code[i].at))
                self.add("site", id=own, name=self.code[k].text, line=self.line(self.code[i].at))
            elif self.called(i):
                self.call(own, i)

    def called(self, i: int) -> bool:
        """Whether the name at ``i`` is what a pair of parentheses after it calls."""
        after = i + 1
        if self.is_(after, "<"):
            after = self.angles(after) or -1
        if self.is_(after, "?.") and self.is_(after + 1, "("):
            after += 1
        if not self.is_(after, "("):
            return False
        member = self.is_(i - 1, ".", "?.")
        if not member:
            if self.code[i].text in _NOT_CALLS or self.is_(i - 1, "function", "new", "@", "#"):
                return False
        k = i
        while self.is_(k - 1, ".", "?.") and k >= 2:
            k -= 2
        if self.is_(k - 1, "new", "@"):  # a name of what is made, or a decorator
            return False
        close = self.pair[after] + 1
        if self.code[i].text == "async" and self.is_(close, "=>"):
            return False
        if not member and self.is_(i - 1, "{", ",", "}", ";", "*", "async", "get", "set", "static", "public", "private", "protected"):
            close = self.type_(close + 1) if self.is_(close, ":") else close
            if self.is_(close, "{") and not self.new_line(close):  # a method of an object or of a class inside
                return False
        return True

    def call(self, own: str, i: int) -> None:
        """A call by name, of a member of a name or of ``this``, or of a member of a member; no others are told apart."""
        line, name = self.line(self.first(i)), self.code[i].text
        if not self.is_(i - 1, ".", "?."):
            self.add("call", id=own, name=name, on_self=False, line=line)
            return
        who = i - 2
        if not self.name_at(who) or self.is_(who, "super"):
            return
        if self.is_(who - 1, ".", "?."):
            on_self = self.is_(who - 2, "this") and not self.is_(who - 3, ".", "?.")
            self.add("call", id=own, name=name, receiver=self.code[who].text, on_self=on_self, line=line)
        elif self.is_(who, "this"):
            self.add("call", id=own, name=name, on_self=True, line=line)
        elif self.code[who].text not in _BEFORE_VALUE:
            self.add("call", id=own, name=name, receiver=self.code[who].text, on_self=False, line=line)

    def first(self, i: int) -> int:
        """Where the expression that a member's name ends begins."""
        while self.is_(i - 1, ".", "?.") and i >= 2:
            i -= 2
            while self.is_(i, ")", "]") and self.pair[i] > 0 and not self.is_(i, "."):
                i = self.pair[i] - 1
                if not (self.name_at(i) or self.is_(i, ")", "]")):
                    i += 1
                    break
        return self.code[max(i, 0)].at

    def types(self, own: str, a: int, b: int) -> None:
        for i in range(a, b):
            if self.is_(i, "const", "let", "var") and self.name_at(i + 1):
                k = self.type_(i + 3) if self.is_(i + 2, ":") else i + 2
                if self.is_(k, "=") and self.is_(k + 1, "new") and self.name_at(k + 2) and self.code[k + 2].text[0].isupper() and (self.is_(k + 3, "(") or self.is_(k + 3, "<")):
                    self.add("var", id=own, local=self.code[i + 1].text, name=self.code[k + 2].text, line=0)

    def imports(self, first: int) -> int:
        """After the import statement that begins at ``first``."""
        i, names, plain = first + 1, [], []
        i += self.is_(i, "type") and not self.is_(i + 1, "from", ",", "=")
        while i < len(self.code) and self.code[i].kind != "string" and not self.is_(i, ";"):
            if self.is_(i, "{"):
                end, k = self.pair[i], i + 1
                while k < end:
                    k += self.is_(k, "type") and not self.is_(k + 1, ",", "as") and k + 1 < end
                    got = [self.code[k].text.strip("\"'")]
                    while k + 1 < end and not self.is_(k + 1, ","):
                        k += 1
                        got += [self.code[k].text] if not self.is_(k, "as") or len(got) == 0 else []
                    names.append((got[0], got[-1]))
                    k += 2
                i = end + 1
            elif self.name_at(i) and not self.is_(i, "from", "as"):
                plain.append(self.code[i].text)
                i += 1
            elif self.is_(i, "="):  # import x = require("y")
                return self.expression(i + 1, len(self.code))
            else:
                i += 1
        if i >= len(self.code) or self.code[i].kind != "string":
            return i + 1
        target, line = self.code[i].text[1:-1], self.line(self.code[first].at)
        if target.startswith("."):
            parts: list[str] = []
            for p in (self.path.split("/")[:-1]) + target.split("/"):
                if p == "..":
                    parts = parts[:-1]
                elif p != ".":
                    parts.append(p)
            target = "/".join(parts)
        for name, local in [*names, *((x, x) for x in plain)]:
            self.add("import", id=self.module, module=target, level=0, name=name, local=local, line=line)
        return i + 1 + self.is_(i + 1, ";")


def _facts(repo: str, path: str, text: str, module: str) -> list[dict]:
    return _TypeScript(repo, path, text, module).run()


def typescript_facts(files: DataFrame) -> DataFrame:
    """Facts of TypeScript files (repo_id, file_path, content), like those of Python files."""
    df = files.select("repo_id", "file_path", F.coalesce("content", F.lit("")).alias("content"), module_id(F.col("file_path"), F.lit("typescript")).alias("module"))

    return df.mapInArrow(read(_facts), FACTS)


#: Which facts the files of an extension give.
ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {".py": python_facts, ".ts": typescript_facts, ".tsx": typescript_facts}


def facts(files: DataFrame) -> DataFrame:
    """Facts of all files (repo_id, file_path, content) whose extension has an adapter; others give none.

    Files are dealt out by name: few bytes are much work, so tasks are not joined by size.
    """
    spark = files.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    files, out = files.repartition(tasks, "repo_id", "file_path"), None
    for adapter in dict.fromkeys(ADAPTERS.values()):
        mine = [e for e, a in ADAPTERS.items() if a is adapter]
        found = adapter(files.filter(F.regexp_extract("file_path", r"(\.[^./]*)$", 1).isin(*mine)))
        out = found if out is None else out.unionByName(found)
    return out
