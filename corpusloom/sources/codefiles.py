"""`spark.read.format("codefiles")`: source files below directories.

The built-in file sources hide every name that starts with `_` or `.`, which
loses files such as `__init__.py`; this source does not.

Options (names in any case)
    path        mounted directories below which to look, separated by commas; each
                child directory of one is a repository, unless `repo` is given
    repo        name of the one repository that `path` holds
    splits      partitions at most (256)
    planDirs    directories that the driver opens to plan them (4096)
    extensions  which files to read, separated by commas; `*` for all
    ignored     parts of paths that leave a file out, separated by commas
    pathMatch   `substring` (default) or `segment`: how those parts are compared
    minBytes, maxBytes   sizes of files
    errors      `skip` (default), or `rows` for a column `error` and a row for
                every file and directory that cannot be read, without content

The rules that no option names are those `register` was given.

Planning opens directories level by level and weighs their files; what is
left unopened weighs as much as an opened directory on average.  A directory
that outweighs a partition is shared by several; then the heaviest work goes
to the lightest partition.  So a session with a few large and very many small
repositories gets even partitions, never more than `splits`.

Filters on `repo`, `path`, `name`, `ext` and `size` are taken over from the
query: those on `repo` before planning, the others before a file is opened.
"""

from __future__ import annotations

import heapq
import os
import sys
import zlib
from collections import Counter, deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_COLUMNS = [
    ("repo", pa.string()), ("path", pa.string()), ("name", pa.string()),
    ("ext", pa.string()), ("size", pa.int64()), ("content", pa.binary()),
]
_BATCH_BYTES = 8 << 20
# what a row costs besides its content, so that very many small files make small batches too
_ROW_BYTES = 1 << 10


@dataclass(frozen=True)
class Rules:
    """Which files are read."""

    extensions: tuple[str, ...] | None = None
    ignored: tuple[str, ...] = ()
    match: str = "substring"
    low: int = 0
    high: int = sys.maxsize

    @staticmethod
    def of(options, base: "Rules") -> "Rules":
        def listed(text: str) -> tuple[str, ...]:
            return tuple(p.strip() for p in text.split(",") if p.strip())

        given = {}
        if "extensions" in options:
            given["extensions"] = None if options["extensions"].strip() == "*" else listed(options["extensions"])
        if "ignored" in options:
            given["ignored"] = listed(options["ignored"])
        for field, option in (("low", "minBytes"), ("high", "maxBytes")):
            if option in options:
                given[field] = int(options[option])
        if "pathMatch" in options:
            given["match"] = options["pathMatch"]
        rules = replace(base, **given)
        if rules.match not in ("substring", "segment"):
            raise ValueError(f"option `pathMatch` is `substring` or `segment`, not `{rules.match}`")
        return rules

    def takes(self, path: str, ext: str) -> bool:
        if self.extensions is not None and ext not in self.extensions:
            return False
        if self.match == "segment":
            return not set(path.split("/")).intersection(self.ignored)
        return not any(part in path for part in self.ignored)


@dataclass(frozen=True)
class Work:
    """A directory, with all below it or its own files alone, or a share of these."""

    repo: str
    prefix: str
    root: str
    directory: str
    recursive: bool
    slice: int = 0
    slices: int = 1


@dataclass
class Share(InputPartition):
    work: tuple[Work, ...]


def mounted_path(path: str) -> str:
    """A path that tasks can open as a file; only mounted folders have one."""
    plain = path.removeprefix("file://").removeprefix("file:")
    if "://" in plain:
        raise ValueError(f"not a mounted folder: {path}")
    return plain


def text_of(name: str) -> str:
    """A name as text; bytes that are no UTF-8 are written as `\\xff`."""
    return os.fsencode(name).decode("utf-8", "backslashreplace")


def _children(directory: str) -> list[os.DirEntry]:
    with os.scandir(directory) as entries:
        return sorted(entries, key=lambda e: os.fsencode(e.name))


def _streamed(directory: str, failed: list[OSError]) -> Iterator[os.DirEntry]:
    """The entries of a directory as they come; what ends the listing goes to `failed`."""
    try:
        with os.scandir(directory) as entries:
            yield from entries
    except OSError as error:
        failed.append(error)


def _is_directory(entry: os.DirEntry) -> bool:
    return entry.is_dir(follow_symlinks=False)


def _leads_to_directory(entry: os.DirEntry) -> bool:
    """Links to directories are not followed, as they may lead back."""
    return entry.is_symlink() and entry.is_dir()


def _path_in(work: Work, full: str) -> str:
    inner = text_of(os.path.relpath(full, work.root))
    return work.prefix if inner == "." else f"{work.prefix}/{inner}"


def _test_of(condition) -> tuple[str, Callable] | None:
    """(column, test of a value) of a filter that this source can apply."""
    if isinstance(condition, D.Not):
        inner = _test_of(condition.child)
        return inner and (inner[0], lambda v, t=inner[1]: not t(v))
    attribute = getattr(condition, "attribute", ())
    if len(attribute) != 1 or attribute[0] not in ("repo", "path", "name", "ext", "size"):
        return None
    value = getattr(condition, "value", None)
    tests = {
        D.EqualTo: lambda v: v == value,
        D.In: lambda v: v in condition.value,
        D.GreaterThan: lambda v: v > value,
        D.GreaterThanOrEqual: lambda v: v >= value,
        D.LessThan: lambda v: v < value,
        D.LessThanOrEqual: lambda v: v <= value,
        D.StringStartsWith: lambda v: v.startswith(value),
        D.StringEndsWith: lambda v: v.endswith(value),
        D.StringContains: lambda v: value in v,
        D.IsNotNull: lambda v: v is not None,
    }
    test = tests.get(type(condition))
    if test is None or (value is None and not isinstance(condition, D.IsNotNull)):
        return None
    if isinstance(condition, D.In) and None in condition.value:
        return None
    return attribute[0], test


class CodeFilesReader(DataSourceReader):
    def __init__(self, options, rules: Rules):
        self.roots = [mounted_path(p).rstrip("/") for p in options.get("path", "").split(",") if p]
        if not self.roots:
            raise ValueError("option `path` is required")
        self.repo = options.get("repo")
        self.splits = max(1, int(options.get("splits", "256")))
        self.plan_dirs = max(1, int(options.get("planDirs", "4096")))
        self.error_rows = options.get("errors", "skip") == "rows"
        self.rules = Rules.of(options, rules)
        self.tests: list[tuple[str, Callable]] = []

    def pushFilters(self, filters: list) -> Iterable:
        for condition in filters:
            test = _test_of(condition)
            # rows of errors have no size
            if test is None or (self.error_rows and test[0] == "size"):
                yield condition
            else:
                self.tests.append(test)

    def _passes(self, **values) -> bool:
        return all(test(values[column]) for column, test in self.tests if column in values)

    # --- planning, on the driver ---------------------------------------------------

    def repositories(self) -> list[Work]:
        """The repositories.  Paths begin with the directory's name; where several
        roots have it, with as much of what stands before it as tells them apart."""
        found = self.roots if self.repo else [e.path for r in self.roots for e in _children(r) if _is_directory(e)]
        names = [text_of(os.path.basename(d)) for d in found]
        for parents in (1, sys.maxsize):
            seen = Counter(names)
            names = [n if seen[n] == 1 else "/".join(text_of(d).strip("/").split("/")[-1 - parents:]) for n, d in zip(names, found)]
        return [Work(self.repo or name, name, d, d, True) for name, d in zip(names, found) if self._passes(repo=self.repo or name)]

    def weighed(self) -> list[tuple[int | None, int, Work]]:
        """Bytes and number of a work's files, and the work; None where the driver did not look."""
        pending, done = deque(self.repositories()), []
        for _ in range(self.plan_dirs):
            if not pending:
                break
            work = pending.popleft()
            size, files = 0, 0
            below, failed = [], []
            for entry in _streamed(work.directory, failed):
                if _is_directory(entry):
                    below.append(replace(work, directory=entry.path))
                elif self._listed(work, entry):
                    files += 1
                    try:
                        size += min(entry.stat().st_size, self.rules.high)
                    except OSError:
                        pass
            if failed:
                files = files or 1  # the task that reads it tells the error
            pending.extend(sorted(below, key=lambda w: os.fsencode(w.directory)))
            if files:
                done.append((size, files, replace(work, recursive=False)))
        return done + [(None, 1, work) for work in pending]

    def partitions(self) -> list[Share]:
        weighed = self.weighed()
        known = [size for size, _, _ in weighed if size is not None]
        usual = max(1, sum(known) // len(known)) if known else 1
        target = max(1, sum(usual if s is None else s for s, _, _ in weighed) // self.splits)
        parts = []
        for size, files, work in weighed:
            size = usual if size is None else size
            slices = max(1, min(self.splits, files, -(-size // target)))
            parts += [(size // slices, replace(work, slice=i, slices=slices)) for i in range(slices)]
        parts.sort(key=lambda p: -p[0])
        bins = [(0, i, []) for i in range(min(self.splits, len(parts)))]
        for size, work in parts:
            held, i, inside = bins[0]
            inside.append(work)
            # an empty file costs something as well
            heapq.heapreplace(bins, (held + size + 1, i, inside))
        return [Share(tuple(inside)) for _, _, inside in sorted(bins, key=lambda b: b[1])]

    # --- reading, in tasks -----------------------------------------------------------

    def _listed(self, work: Work, entry: os.DirEntry) -> bool:
        name = text_of(entry.name)
        path, ext = _path_in(work, entry.path), os.path.splitext(name)[1]
        return self.rules.takes(path, ext) and self._passes(path=path, name=name, ext=ext)

    def _entries(self, work: Work) -> Iterator[tuple[str, os.DirEntry | None, str | None]]:
        """(path, file, None), or (path, None, error) of a directory that cannot be listed.

        Entries pass one by one, in no order: a directory of any size is never held."""
        pending = [work.directory]
        while pending:
            directory = pending.pop()
            failed = []
            for entry in _streamed(directory, failed):
                if _is_directory(entry):
                    if work.recursive:
                        pending.append(entry.path)
                elif zlib.crc32(os.fsencode(entry.path)) % work.slices == work.slice:
                    if self._listed(work, entry) and not _leads_to_directory(entry):
                        yield _path_in(work, entry.path), entry, None
            for error in failed:
                path = _path_in(work, directory)
                if work.slice == 0 and self._passes(path=path, name=text_of(os.path.basename(directory)), ext=""):
                    yield path, None, type(error).__name__

    def read(self, part: Share) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for work in part.work:
            for path, entry, error in self._entries(work):
                name = path.rpartition("/")[2] if entry is None else text_of(entry.name)
                ext, size, content = os.path.splitext(name)[1] if entry else "", None, None
                if entry is not None:
                    try:
                        size = entry.stat().st_size
                        if not self.rules.low <= size <= self.rules.high or not self._passes(size=size):
                            continue
                        with open(entry.path, "rb") as f:
                            content = f.read()
                    except OSError as problem:
                        size, error = None, type(problem).__name__
                if error is not None and not self.error_rows:
                    continue
                rows.append((work.repo, path, name, ext, size, content, error))
                held += (size or 0) + _ROW_BYTES
                if held >= _BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows) -> pa.RecordBatch:
        columns = _COLUMNS + [("error", pa.string())] * self.error_rows
        return pa.RecordBatch.from_arrays(
            [pa.array(values, kind) for (_, kind), values in zip(columns, zip(*rows))], schema=pa.schema(columns))


class CodeFiles(DataSource):
    rules = Rules()

    @classmethod
    def name(cls) -> str:
        return "codefiles"

    def schema(self) -> str:
        plain = "repo string, path string, name string, ext string, size bigint, content binary"
        return plain + ", error string" * (self.options.get("errors", "skip") == "rows")

    def reader(self, schema) -> DataSourceReader:
        return CodeFilesReader(self.options, type(self).rules)


def register(spark: SparkSession, registry=None, rules: Rules | None = None) -> None:
    """Make `format("codefiles")` known to a session.

    Files have the extensions of `registry` (the default one unless given) and
    pass the default rules, or those given.  Filter pushdown is switched on in
    the session, without which Spark refuses sources that offer it."""
    from corpusloom import constants as K
    from corpusloom.operators.registry import DEFAULT_REGISTRY

    if rules is None:
        extensions = tuple(ext for ext, _ in (registry or DEFAULT_REGISTRY).extensions)
        rules = Rules(extensions, tuple(K.IGNORED_PATH_PARTS), "substring", K.MIN_FILE_BYTES, K.MAX_FILE_BYTES)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(type("CodeFiles", (CodeFiles,), {"rules": rules, "__module__": __name__}))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
