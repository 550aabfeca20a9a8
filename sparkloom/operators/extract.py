"""Source text to rows: declarations and raw facts, one pass per file.

A file is parsed in the task that holds it; all that follows (names, imports, calls,
inheritance) are joins over the rows that come out, in ``resolve``.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import module_id

#: Kinds of fact: entity, import, call, base, site (a name that may be an instantiation), attr and var (types of attributes and variables).
FACTS = (
    "repo_id string, file_path string, kind string, seq int, id string, parent_id string, name string, type string, line int, end_line int,"
    " has_docstring boolean, source string, receiver string, on_self boolean, module string, level int, local string"
)
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
ARROW = pa.schema([(n, _ARROW[t]) for n, t in (c.split() for c in FACTS.split(","))])

#: Where a line of Python ends.
_LINES = re.compile(r"(?<=\n)|(?<=\r)(?!\n)")
#: Facts that are handed on at once, but for those of one file.
BATCH_FACTS = 10_000

# Private names that still count as variables, and values that make one.
_KEPT = ("__all__", "__version__", "__slots__", "__author__")
_VALUES = (ast.Dict, ast.List, ast.Set, ast.Call, ast.ListComp, ast.DictComp, ast.SetComp, ast.GeneratorExp, ast.IfExp, ast.BinOp, ast.BoolOp, ast.Lambda)


def _documented(body: list[ast.stmt]) -> bool:
    for s in body:
        if isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str):
            return True
        if not isinstance(s, (ast.Import, ast.ImportFrom, ast.Pass)):
            return False
    return False


class _Python(ast.NodeVisitor):
    """Facts of one Python file."""

    def __init__(self, repo: str, path: str, text: str, module: str):
        self.repo, self.path, self.lines, self.module, self.rows, self.seq = repo, path, text.split("\n"), module, [], 0
        self.text, self.ended = text, _LINES.split(text)

    def add(self, kind: str, **x) -> None:
        self.rows.append({"repo_id": self.repo, "file_path": self.path, "kind": kind, "seq": self.seq, **x})
        self.seq += 1

    def cut(self, a: int, b: int) -> str:
        return "\n".join(self.lines[a - 1 : b])

    def segment(self, n: ast.stmt) -> str:
        """What a node covers, as ``ast.get_source_segment``, which splits the whole text each time."""
        part = [x.encode() for x in self.ended[n.lineno - 1 : n.end_lineno]]
        part[-1] = part[-1][: n.end_col_offset]
        part[0] = part[0][n.col_offset :]
        return b"".join(part).decode()

    def run(self) -> list[dict]:
        try:
            tree = ast.parse(self.text)
        except (SyntaxError, ValueError):
            tree = None
        doc = bool(tree) and _documented(tree.body)
        name = self.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        self.add("entity", id=self.module, name=name, type="module", line=1, end_line=len(self.lines), has_docstring=doc, source=self.text)
        if tree:
            self.imports(tree.body)
            spans = [(min([n.lineno, *(d.lineno for d in n.decorator_list)]), n.end_lineno) for n in self.inner(tree.body) if not isinstance(n, (ast.Assign, ast.AnnAssign))]
            self.walk(tree.body, self.module, False, False)
            self.calls(self.module, tree.body, spans)
            self.types(self.module, self.text)
        return self.rows

    def inner(self, body: list[ast.stmt]) -> Iterator[ast.stmt]:
        """Declarations of a scope, through compound statements."""
        for s in body:
            if isinstance(s, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef, ast.Assign, ast.AnnAssign)):
                yield s
            else:
                for part in ("body", "orelse", "finalbody"):
                    yield from self.inner(getattr(s, part, None) or [])
                for h in getattr(s, "handlers", None) or getattr(s, "cases", None) or []:
                    yield from self.inner(h.body)

    def walk(self, body: list[ast.stmt], parent: str, in_class: bool, in_method: bool) -> None:
        for s in self.inner(body):
            if isinstance(s, (ast.Assign, ast.AnnAssign)):
                self.variable(s, parent)
                continue
            start = min([s.lineno, *(d.lineno for d in s.decorator_list)])
            at = f"{parent}.{s.name}"
            source = self.cut(start, s.end_lineno)
            if isinstance(s, ast.ClassDef):
                kind = "interface" if "interfaces" in self.path else "class"
                self.add("entity", id=at, parent_id=parent, name=s.name, type=kind, line=start, end_line=s.end_lineno, has_docstring=_documented(s.body), source=source)
                for b in s.bases:
                    text = ast.unparse(b)
                    if text != "object":
                        self.add("base", id=at, name=text, line=start)
                self.walk(s.body, at, True, False)
            else:
                kind = "method" if in_class or in_method else "function"
                self.add("entity", id=at, parent_id=parent, name=s.name, type=kind, line=start, end_line=s.end_lineno, has_docstring=_documented(s.body), source=source)
                self.calls(at, s.body, [])
                self.types(at, source)
                if s.name == "__init__" and in_class:
                    self.attributes(parent, s)
                self.walk(s.body, at, False, kind == "method" and not s.decorator_list)

    def variable(self, s: ast.Assign | ast.AnnAssign, parent: str) -> None:
        targets = s.targets if isinstance(s, ast.Assign) else [s.target]
        if s.value is None or len(targets) != 1 or not isinstance(targets[0], ast.Name):
            return
        name = targets[0].id
        if name.startswith("_") and name not in _KEPT or not name.isupper() and not isinstance(s.value, _VALUES):
            return
        self.add("entity", id=f"{parent}.{name}", parent_id=parent, name=name, type="variable", line=s.lineno, end_line=s.end_lineno, has_docstring=False, source=self.segment(s))

    def imports(self, body: list[ast.stmt]) -> None:
        for s in body:
            if isinstance(s, ast.Import):
                for a in s.names:
                    self.add("import", id=self.module, module=a.name, level=0, local=a.asname or a.name, line=s.lineno)
            elif isinstance(s, ast.ImportFrom):
                for a in s.names:
                    self.add("import", id=self.module, module=s.module or "", level=s.level, name=a.name, local=a.asname or a.name, line=s.lineno)
            elif isinstance(s, ast.Try):
                for part in (s.body, *(h.body for h in s.handlers), s.orelse, s.finalbody):
                    self.imports(part)
            elif isinstance(s, ast.If) and "__name__" in ast.dump(s.test):
                self.imports(s.body)

    def calls(self, owner: str, body: list[ast.stmt], spans: list[tuple[int, int]]) -> None:
        """Calls below a body; inside a call only its arguments are entered."""
        stack: list[ast.AST] = list(reversed(body))
        spans = sorted(spans)
        starts, ends = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))
        while stack:
            n = stack.pop()
            if not isinstance(n, ast.Call):
                stack.extend(reversed(list(ast.iter_child_nodes(n))))
                continue
            before = bisect_right(starts, n.lineno)
            if not before or ends[before - 1] < n.lineno:
                f = n.func
                if isinstance(f, ast.Name):
                    self.add("call", id=owner, name=f.id, on_self=False, line=n.lineno)
                elif isinstance(f, ast.Attribute):
                    o = f.value
                    if isinstance(o, ast.Attribute):
                        on_self = isinstance(o.value, ast.Name) and o.value.id == "self"
                        self.add("call", id=owner, name=f.attr, receiver=o.attr, on_self=on_self, line=n.lineno)
                    elif isinstance(o, (ast.Name, ast.Call)):
                        who = o.id if isinstance(o, ast.Name) else "super"
                        self.add("call", id=owner, name=f.attr, receiver=None if who == "self" else who, on_self=who == "self", line=n.lineno)
            stack.extend(reversed([*n.args, *(k.value for k in n.keywords)]))

    def types(self, owner: str, source: str) -> None:
        """``var = Name(``: what may give a variable its type, and what may be an instantiation."""
        for m in re.finditer(r"(\w+)\s*=\s*([A-Z]\w*)\s*\(", source):
            self.add("var", id=owner, local=m[1], name=m[2], line=0)
        for i, text in enumerate(source.split("\n")):
            for m in re.finditer(r"(?<![\w.])([A-Z]\w*)\s*\(", text.split("#")[0]):
                if not re.match(r"\s*(class|def)\b", text):
                    self.add("site", id=owner, name=m[1], line=i)

    def attributes(self, owner: str, init: ast.FunctionDef) -> None:
        source = self.cut(init.lineno, init.end_lineno)
        for a in [*init.args.args, *init.args.kwonlyargs]:
            m = re.match(r"[A-Z]\w*", ast.unparse(a.annotation)) if a.annotation else None
            if m:
                self.add("attr", id=owner, local=a.arg, name=m[0], line=0)
                for x in re.finditer(rf"self\.(\w+)\s*=\s*{a.arg}\b", source):
                    self.add("attr", id=owner, local=x[1], name=m[0], line=0)


def read(facts_of: Callable[[str, str, str, str], list[dict]]) -> Callable:
    """Facts of files (repo_id, file_path, content, module), some files at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for b in batches:
            for x in zip(*(b.column(n) for n in ("repo_id", "file_path", "content", "module")), strict=True):
                rows += facts_of(*(v.as_py() for v in x))
                if len(rows) >= BATCH_FACTS:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                    rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return run


def python_facts(files: DataFrame) -> DataFrame:
    """Facts of Python files (repo_id, file_path, content). A file that does not parse has its module row alone."""
    df = files.select("repo_id", "file_path", F.coalesce("content", F.lit("")).alias("content"), module_id(F.col("file_path"), F.lit("python")).alias("module"))

    return df.mapInArrow(read(lambda *x: _Python(*x).run()), FACTS)


def entities(facts: DataFrame) -> DataFrame:
    """Entities; of those with one id in a repository the first stays."""
    from ..sources.tables import keep_first

    e = facts.filter("kind = 'entity'").select("repo_id", "file_path", "seq", "id", "parent_id", "name", "type", F.col("line").alias("start_line"), "end_line", "has_docstring", "source")
    return keep_first(e, ["repo_id", "id"], ["file_path", "seq"])


def contains(entities_: DataFrame) -> DataFrame:
    return entities_.filter("parent_id is not null").select("repo_id", F.col("parent_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("CONTAINS").alias("type"), "file_path", F.col("start_line").alias("line"))
