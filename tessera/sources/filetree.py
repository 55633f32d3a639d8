"""A directory tree as a Spark data source: `spark.read.format("filetree").load(root)`, and the same as a stream."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tessera.config import DATA_DIR, Settings
from tessera.functions.text import file_name, suffix
from tessera.sources import gitignore, registry

SCHEMA = "root string, rel_path string, name string, suffix string, size bigint, mtime double, content binary"
FILES_PER_PARTITION = 256
BYTES_PER_PARTITION = 64 << 20


def normalise_extensions(values) -> set[str] | None:
    """Lower case with a leading dot; nothing given means no restriction."""
    out = {(v if v.startswith(".") else "." + v).lower() for v in values or () if v}
    return out or None


def py_suffix(name: str) -> str:
    at = name.rfind(".")
    return name[at:] if 0 < at < len(name) - 1 else ""


def walk(root: str, options: dict) -> list[str]:
    """Relative paths below root in order, pruned and filtered before any file is opened.

    Checks run in the order prune, gitignore, extractor, include, exclude, size.
    """
    skip = set(options["skip"].split(",")) if options.get("skip") else set(Settings().pruned)
    include = normalise_extensions((options.get("include") or "").split(","))
    exclude = normalise_extensions((options.get("exclude") or "").split(","))
    limit = int(options.get("maxsize", Settings().max_file_size_bytes))
    every = options.get("everyfile", "false") == "true"
    rules: list = []
    ignore = os.path.join(root, ".gitignore")
    if not every and os.path.isfile(ignore):
        with open(ignore, encoding="utf-8", errors="ignore") as fh:
            rules = gitignore.compile_lines(fh.read().split("\n"))
    keys = set(registry.resolved())
    out = []
    for base, dirs, files in os.walk(root):
        dirs[:] = sorted(d for d in dirs if not d.startswith(".") and d not in skip)
        for f in sorted(files):
            full = os.path.join(base, f)
            rel = os.path.relpath(full, root).replace(os.sep, "/")
            low = py_suffix(f).lower()
            if not every:
                if rules and gitignore.is_ignored(rel, rules):
                    continue
                if f not in keys and low not in keys:
                    continue
                if include and low not in include and f not in include:
                    continue
                if exclude and (low in exclude or f in exclude):
                    continue
                try:
                    if os.path.getsize(full) > limit:
                        continue
                except OSError:
                    continue
            out.append(rel)
    return out


class Part(InputPartition):
    def __init__(self, paths: list[str], gone: bool = False):
        self.paths, self.gone = paths, gone


def read_files(root: str, paths: list[str]) -> Iterator[tuple]:
    for rel in paths:
        full = os.path.join(root, rel)
        try:
            stat = os.stat(full)
            with open(full, "rb") as fh:
                data = fh.read()
        except OSError:
            continue  # gone or unreadable since the listing
        name = os.path.basename(rel)
        yield root, rel, name, py_suffix(name), stat.st_size, stat.st_mtime, data


def packed(root: str, paths: list[str]) -> list[list[str]]:
    """Paths in runs of at most FILES_PER_PARTITION files and about BYTES_PER_PARTITION bytes; a larger file has a run of its own."""
    out: list[list[str]] = []
    room = 0
    for rel in paths:
        try:
            size = os.path.getsize(os.path.join(root, rel))
        except OSError:
            size = 0
        if not out or len(out[-1]) == FILES_PER_PARTITION or size > room:
            out.append([])
            room = BYTES_PER_PARTITION
        out[-1].append(rel)
        room -= size
    return out


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.abspath(options.get("path", "."))
        self.options = options

    def partitions(self) -> list[Part]:
        return [Part(run) for run in packed(self.root, walk(self.root, self.options))] or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        return read_files(self.root, partition.paths)


class Listings:
    """Listings of the tree (path -> size:mtime) kept as files, so that an offset is a name and not the listing itself."""

    def __init__(self, root: str, folder: str | None):
        self.folder = folder or os.path.join(root, DATA_DIR, "listings")

    def put(self, listing: dict) -> str:
        data = json.dumps(listing, sort_keys=True).encode()
        name = hashlib.sha256(data).hexdigest()
        path = os.path.join(self.folder, name)
        if not os.path.exists(path):
            os.makedirs(self.folder, exist_ok=True)
            with open(f"{path}.{os.getpid()}", "wb") as fh:
                fh.write(data)
            os.replace(fh.name, path)
        return name

    def get(self, name: str) -> dict:
        if not name:
            return {}
        with open(os.path.join(self.folder, name), "rb") as fh:
            return json.loads(fh.read())


class StreamReader(DataSourceStreamReader):
    """Each batch holds the files whose size or mtime differ between two listings. The driver lists names only; contents are read by the tasks
    of the batch's partitions."""

    def __init__(self, options: dict):
        self.root = os.path.abspath(options.get("path", "."))
        self.options = options
        self.deletions = options.get("deletions", "false") == "true"
        self.listings = Listings(self.root, options.get("listings"))

    def initialOffset(self) -> dict:
        return {"listing": ""}

    def latestOffset(self) -> dict:
        out = {}
        for rel in walk(self.root, self.options):
            try:
                s = os.stat(os.path.join(self.root, rel))
                out[rel] = f"{s.st_size}:{s.st_mtime}"
            except OSError:
                pass
        return {"listing": self.listings.put(out)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        was, now = self.listings.get(start["listing"]), self.listings.get(end["listing"])
        changed = [p for p, v in now.items() if was.get(p) != v]
        gone = [p for p in was if p not in now] if self.deletions else []
        n = FILES_PER_PARTITION
        return [Part(run) for run in packed(self.root, changed)] + [Part(gone[i : i + n], True) for i in range(0, len(gone), n)]

    def read(self, partition: Part) -> Iterator[tuple]:
        extra = (partition.gone,) if self.deletions else ()
        if partition.gone:
            for rel in partition.paths:
                name = os.path.basename(rel)
                yield (self.root, rel, name, py_suffix(name), None, None, None, *extra)
            return
        for row in read_files(self.root, partition.paths):
            yield (*row, *extra)

    def commit(self, end: dict) -> None:
        pass


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA + (", deleted boolean" if self.options.get("deletions") == "true" else "")

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(dict(self.options))


def files(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """root, rel_path, name, suffix, size, mtime, content of the files below root that may be ingested."""
    spark.dataSource.register(FileTree)
    return spark.read.format("filetree").options(**options).load(os.path.abspath(root))


# the same predicates over a table of paths
def not_pruned(path: Column, settings: Settings = Settings()) -> Column:
    """No directory of the path is hidden or on the skip list."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return ~F.exists(dirs, lambda d: (F.startswith(d, F.lit(".")) & ~d.isin("", ".", "..")) | d.isin(*settings.pruned))


def included(path: Column, include=None, exclude=None) -> Column:
    inc, exc = normalise_extensions(include), normalise_extensions(exclude)
    low, name = F.lower(suffix(path)), file_name(path)
    ok = F.lit(True)
    if inc:
        ok = ok & (low.isin(*inc) | name.isin(*inc))
    if exc:
        ok = ok & ~(low.isin(*exc) | name.isin(*exc))
    return ok


def within_size(size: Column, settings: Settings = Settings()) -> Column:
    return size <= settings.max_file_size_bytes
