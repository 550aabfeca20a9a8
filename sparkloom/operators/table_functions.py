"""Extraction as table functions, so that SQL can call it: ``FROM files f, LATERAL source_facts(f.repo_id, f.file_path, f.content)``."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .extract import ARROW, FACTS, _Python
from .extract_ts import _TypeScript

_NAMES = ARROW.names
#: Which parser reads the files of an extension.
PARSERS = {".py": ("python", _Python), ".ts": ("typescript", _TypeScript), ".tsx": ("typescript", _TypeScript)}


def module_of(path: str, language: str) -> str:
    """The id of a file's module, as ``functions.text.module_id`` has it for a column."""
    if language == "python":
        return "py." + re.sub(r"\.py$", "", path.removeprefix("python/")).replace("/", ".")
    plain = re.sub(r"\.tsx?$", "", path.removeprefix("typescript/"))
    folder, _, name = plain.rpartition("/")
    return "ts." + (folder.replace("/", ".") + "." if folder else "") + name.replace(".", "_")


def _rows(repo: str, path: str, text: str | None, languages: tuple[str, ...]) -> Iterator[tuple]:
    end = re.search(r"(\.[^./]*)$", path or "")
    language, parser = PARSERS.get(end[1] if end else "", ("", None))
    if language in languages:
        for r in parser(repo, path, text or "", module_of(path, language)).run():
            yield tuple(r.get(n) for n in _NAMES)


class PythonFacts:
    """Facts of one Python file; none of any other."""

    def eval(self, repo_id: str, file_path: str, content: str) -> Iterator[tuple]:
        yield from _rows(repo_id, file_path, content, ("python",))


class TypeScriptFacts:
    """Facts of one TypeScript file; none of any other."""

    def eval(self, repo_id: str, file_path: str, content: str) -> Iterator[tuple]:
        yield from _rows(repo_id, file_path, content, ("typescript",))


class SourceFacts:
    """Facts of one file by the parser of its extension; none where there is no parser."""

    def eval(self, repo_id: str, file_path: str, content: str) -> Iterator[tuple]:
        yield from _rows(repo_id, file_path, content, ("python", "typescript"))


FUNCTIONS = {"python_facts": PythonFacts, "typescript_facts": TypeScriptFacts, "source_facts": SourceFacts}


def register(spark: SparkSession) -> None:
    """Make the table functions of ``FUNCTIONS`` known to SQL; each gives the columns of ``extract.FACTS``."""
    for name, cls in FUNCTIONS.items():
        spark.udtf.register(name, udtf(cls, returnType=FACTS))
