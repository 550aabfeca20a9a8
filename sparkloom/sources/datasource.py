"""A Spark data source of repositories: ``spark.read.format("repository").load(path)``.

The driver lists folders only, down to a few levels; which files there are, and what is
in them, is found by tasks, one part a folder. Options say which repositories, languages and paths are
wanted; folders and files without any are passed over before anything is opened. (These
are options, not pushed filters: Spark 4.1 keeps what one query of a frame has pushed
for the next one, if that has nothing to push.) As a stream, the source gives files as
they change.

Spark's own file sources pass over names that begin with an underscore; ``__init__.py``
is needed here.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..schemas import SUPPORTED_EXTENSIONS

# Directories that an extraction does not enter.
SKIP_DIRS = ("node_modules", "venv", "__pycache__", "platform")
#: The language of files, by what their names end with.
LANGUAGES = {e: "python" if e == ".py" else "typescript" for e in SUPPORTED_EXTENSIONS}
SCHEMA = "repo_id string, file_path string, language string, content string"
#: Bytes of contents after which a task hands a batch on.
BATCH_BYTES = 8 << 20


@dataclass
class Folder(InputPartition):
    """One folder of a repository: its own files, and all below it if ``deep``; changed within (since, until] if those are set."""

    repo_id: str
    root: str
    folder: str
    deep: bool
    since: int = -1
    until: int = -1


@dataclass
class Wanted:
    """What the options leave; None: all."""

    repos: frozenset | None = None
    languages: frozenset | None = None
    prefix: str = ""

    def folder(self, path: str) -> bool:
        """Whether a folder (relative, empty for the root) can hold a wanted file."""
        below = f"{path}/" if path else ""
        return below.startswith(self.prefix) or self.prefix.startswith(below)

    def file(self, path: str, language: str) -> bool:
        return (self.languages is None or language in self.languages) and path.startswith(self.prefix)


def _wanted(options: dict) -> Wanted:
    several = lambda k: frozenset(x.strip() for x in options[k].split(",")) if options.get(k) else None
    return Wanted(several("repos"), several("languages"), options.get("prefix") or "")


def _entered(name: str) -> bool:
    return not name.startswith(".") and name not in SKIP_DIRS


def _folders(path: str, repo: str, depth: int, wanted: Wanted) -> Iterator[Folder]:
    """The folders of a repository; those ``depth`` levels down stand for all below them."""
    level = [""]
    for d in range(depth + 1):
        below = []
        for folder in level:
            yield Folder(repo, path, folder, d == depth)
            if d < depth:
                with os.scandir(os.path.join(path, folder)) as found:
                    names = sorted(e.name for e in found if e.is_dir(follow_symlinks=False) and _entered(e.name))
                below += [f"{folder}/{n}" if folder else n for n in names]
        level = [f for f in below if wanted.folder(f)]


def _files(part: Folder, wanted: Wanted) -> Iterator[tuple[str, str, str]]:
    """(relative path, language, place) of the wanted files of a part."""
    for root, dirs, files in os.walk(os.path.join(part.root, part.folder)):
        inside = os.path.relpath(root, part.root).replace(os.sep, "/").removeprefix(".").lstrip("/")
        dirs[:] = sorted(d for d in dirs if part.deep and _entered(d) and wanted.folder(f"{inside}/{d}" if inside else d))
        for name in sorted(files):
            end = next((e for e in sorted(LANGUAGES, key=len, reverse=True) if name.endswith(e)), None)
            path = f"{inside}/{name}" if inside else name
            if end and wanted.file(path, LANGUAGES[end]):
                place = os.path.join(root, name)
                if part.since < 0 or part.since < os.stat(place).st_mtime_ns <= part.until:
                    yield path, LANGUAGES[end], place


def _batches(part: Folder, wanted: Wanted) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    size = 0
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["repo_id", "file_path", "language", "content"])
    for path, language, place in _files(part, wanted):
        try:
            with open(place, "rb") as f:
                raw = f.read()
        except FileNotFoundError:  # gone since it was listed
            continue
        rows.append((part.repo_id, path, language, raw.decode("utf-8", "replace")))
        size += len(raw)
        if size >= BATCH_BYTES:
            yield make()
            rows, size = [], 0
    if rows:
        yield make()


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.wanted = options, _wanted(options)

    def partitions(self) -> list[Folder]:
        return list(_parts(self.options, self.wanted))

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        return _batches(partition, self.wanted)


def _parts(options: dict, wanted: Wanted) -> Iterator[Folder]:
    path = options["path"].removeprefix("file://")
    if options.get("repo_id"):
        repos = [(options["repo_id"], path)]
    else:  # every folder of the path is a repository
        repos = sorted((e.name, e.path) for e in os.scandir(path) if e.is_dir() and _entered(e.name))
    for repo, root in repos:
        if wanted.repos is None or repo in wanted.repos:
            yield from _folders(root, repo, int(options.get("depth", 2)), wanted)


class _Stream(DataSourceStreamReader):
    """Files whose time of change lies between two offsets. A file that changes again comes again."""

    def __init__(self, options: dict):
        self.options, self.settle = options, int(float(options.get("settle_seconds", 1)) * 1e9)

    def initialOffset(self) -> dict:
        return {"ns": 0}

    def latestOffset(self) -> dict:
        # A file that is being written now has a later time than this, or is read again.
        return {"ns": time.time_ns() - self.settle}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        parts = list(_parts(self.options, _wanted(self.options)))
        for p in parts:
            p.since, p.until = start["ns"], end["ns"]
        return parts

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        return _batches(partition, _wanted(self.options))


class RepositorySource(DataSource):
    """Options: ``path``; ``repo_id`` if the path is one repository, else each folder of it is one;
    ``repos`` and ``languages``, separated by commas, and ``prefix`` of paths, to leave the others out; ``depth``, how many
    levels of folders the driver lists; ``settle_seconds``, for streams, how old a change must be."""

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(dict(self.options))

    def streamReader(self, schema: StructType) -> _Stream:
        return _Stream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(RepositorySource)
