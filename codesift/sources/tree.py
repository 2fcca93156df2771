"""Reads a source tree as a table, or follows its changes as a stream.

The built-in file sources skip names that start with a dot or an underscore,
which are the files several rules look for, so the walk is a small data source.
Dependency directories are never entered, and filters on ``repo``, ``path``, ``ext`` and
``size`` are applied before a file is opened.

    spark.dataSource.register(SourceTree)
    spark.read.format("source_tree").option("root", "/corpus/repos").load()
    spark.readStream.format("source_tree").option("root", "/corpus/repos").load()

Each directory directly below ``root`` is one repository.  ``root`` must be a path that
every executor can read.  The driver lists repositories only; each is walked inside its
task.  Where single repositories are large, ``read_tree`` walks in two levels, so that a
repository is spread over as many tasks as it has directories.

A directory that cannot be listed is a row with ``walk_error``; a file that cannot be
opened is a row with ``read_error`` and no content.
"""

from __future__ import annotations

import datetime
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith,
)

from codesift.operators.inventory import DEFAULT_MAX_BYTES, DEPENDENCY_DIRS

SCHEMA = (
    "repo string, path string, ext string, content string, size bigint, symlink boolean, non_regular boolean, inaccessible boolean, "
    "read_error boolean, walk_error boolean, changed timestamp"
)
ARROW = pa.schema([
    ("repo", pa.string()), ("path", pa.string()), ("ext", pa.string()), ("content", pa.string()), ("size", pa.int64()),
    *[(c, pa.bool_()) for c in ("symlink", "non_regular", "inaccessible", "read_error", "walk_error")], ("changed", pa.timestamp("us", "UTC")),
])


@dataclass
class Wanted:
    """What a walk looks for; the rest is passed over unopened."""

    max_bytes: int = DEFAULT_MAX_BYTES
    repo: str | None = None
    paths: list[str] = field(default_factory=list)  # beginnings, all of which a path must have
    path: str | None = None
    exts: set[str] | None = None
    after: int | None = None  # changed later than this, in nanoseconds
    until: int | None = None

    def push(self, filters) -> Iterator:
        """Takes the filters that the walk can apply; gives back those that Spark must still apply."""
        for item in filters:
            column = item.attribute[0] if getattr(item, "attribute", None) and len(item.attribute) == 1 else None
            if isinstance(item, EqualTo) and column == "repo" and self.repo in (None, item.value):
                self.repo = item.value
            elif isinstance(item, EqualTo) and column == "path" and self.path in (None, item.value):
                self.path = item.value
            elif isinstance(item, StringStartsWith) and column == "path":
                self.paths.append(item.value)
            elif isinstance(item, (EqualTo, In)) and column == "ext":
                some = set(item.value) if isinstance(item, In) else {item.value}
                self.exts = some if self.exts is None else self.exts & some
            elif isinstance(item, (LessThan, LessThanOrEqual)) and column == "size":
                # Larger files are listed without content; Spark still filters them.
                self.max_bytes = min(self.max_bytes, item.value)
                yield item
            else:
                yield item

    def takes(self, path: str, ext: str) -> bool:
        return (
            (self.path is None or path == self.path) and (self.exts is None or ext in self.exts)
            and all(path.startswith(p) for p in self.paths)
        )


def extension_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1].lower()
    return name[name.rindex(".") :] if "." in name else ""


def repositories(root: str, only: str | None = None) -> list[str]:
    return [only] if only is not None else sorted(e.name for e in os.scandir(root) if e.is_dir(follow_symlinks=False))


def walk(root: str, repo: str, start: str, deep: bool, wanted: Wanted) -> Iterator[tuple]:
    """Rows of the files under ``start`` in a repository, or directly in it."""
    top = os.path.join(root, repo)
    todo = [os.path.join(top, start) if start else top]
    while todo:
        folder = todo.pop()
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            where = os.path.relpath(folder, top).replace(os.sep, "/")
            where = repo if where == "." else where
            if wanted.takes(where, extension_of(where)):
                yield repo, where, extension_of(where), None, 0, False, False, False, False, True, None
            continue
        for entry in entries:
            if entry.is_dir(follow_symlinks=False):
                if deep and entry.name.lower() not in DEPENDENCY_DIRS:
                    todo.append(entry.path)
                continue
            path = os.path.relpath(entry.path, top).replace(os.sep, "/")
            ext = extension_of(path)
            if wanted.takes(path, ext):
                row = file_row(entry, repo, path, ext, wanted)
                if row is not None:
                    yield row


def file_row(entry: os.DirEntry, repo: str, path: str, ext: str, wanted: Wanted) -> tuple | None:
    link, regular = entry.is_symlink(), entry.is_file(follow_symlinks=False)
    try:
        info = entry.stat(follow_symlinks=False)
    except OSError:
        return repo, path, ext, None, 0, link, not regular and not link, True, False, False, None
    # The inode's change time also moves when an old file is moved in.
    if (wanted.after is not None and info.st_ctime_ns <= wanted.after) or (wanted.until is not None and info.st_ctime_ns > wanted.until):
        return None
    changed = datetime.datetime.fromtimestamp(info.st_ctime_ns // 1000 / 1e6, datetime.UTC)
    content, unread = None, False
    if regular and not link and info.st_size <= wanted.max_bytes:
        try:
            with open(entry.path, "rb") as handle:
                content = handle.read().decode("utf-8", errors="replace")
        except OSError:
            unread = True
    return repo, path, ext, content, info.st_size, link, not regular and not link, False, unread, False, changed


class Repository(InputPartition):
    def __init__(self, repo: str, wanted: Wanted):
        self.repo, self.wanted = repo, wanted


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TreeStream(self.options)


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["root"]
        self.wanted = Wanted(int(options.get("max_bytes", DEFAULT_MAX_BYTES)))

    def pushFilters(self, filters) -> Iterator:
        yield from self.wanted.push(filters)

    def partitions(self) -> list[InputPartition]:
        return [Repository(repo, self.wanted) for repo in repositories(self.root, self.wanted.repo)]

    def read(self, partition: Repository) -> Iterator[tuple]:
        yield from walk(self.root, partition.repo, "", True, partition.wanted)


class TreeStream(DataSourceStreamReader):
    """Files that were added or changed.  An offset is the time of a listing: a batch holds
    what changed between two of them, found by walking in the tasks, so a retried batch sees
    the same files unless they changed again, and then the next batch has them."""

    def __init__(self, options):
        self.root = options["root"]
        self.max_bytes = int(options.get("max_bytes", DEFAULT_MAX_BYTES))
        # Files younger than this wait for the next listing: clocks and writers need a moment.
        self.settle = int(float(options.get("settle_seconds", 2)) * 1e9)

    def initialOffset(self) -> dict:
        return {"listed": 0}

    def latestOffset(self) -> dict:
        return {"listed": time.time_ns() - self.settle}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        wanted = Wanted(self.max_bytes, after=start["listed"], until=end["listed"])
        return [Repository(repo, wanted) for repo in repositories(self.root)]

    def read(self, partition: Repository) -> Iterator[tuple]:
        yield from walk(self.root, partition.repo, "", True, partition.wanted)


ROWS_AT_ONCE = 64


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS_AT_ONCE:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), ARROW, strict=True)], schema=ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), ARROW, strict=True)], schema=ARROW)


def read_tree(spark: SparkSession, root: str, tasks: int | None = None, max_bytes: int = DEFAULT_MAX_BYTES) -> DataFrame:
    """The same rows, walked in two levels: tasks list the directories of each repository,
    and other tasks walk one directory each, so a repository of any size is spread."""
    tasks = tasks or 4 * spark.sparkContext.defaultParallelism
    wanted = Wanted(max_bytes)
    repos = spark.createDataFrame(pa.table({"repo": pa.array(repositories(root), pa.string())})).repartition(tasks, "repo")

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for repo in batch.column(0).to_pylist():
                found = [(repo, "", False)]
                try:
                    with os.scandir(os.path.join(root, repo)) as entries:
                        found += [(repo, e.name, True) for e in entries if e.is_dir(follow_symlinks=False) and e.name.lower() not in DEPENDENCY_DIRS]
                except OSError:
                    pass  # the walk of the repository itself says so
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["repo", "start", "deep"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for repo, start, deep in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from _batches(walk(root, repo, start, deep, wanted))

    spread = repos.mapInArrow(units, "repo string, start string, deep boolean").repartition(tasks, "repo", "start")
    return spread.mapInArrow(rows, SCHEMA)
