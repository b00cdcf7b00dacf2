"""Source trees and archives as Spark data sources.

Spark's own file sources skip paths that begin with "_" or "." and empty files, so packages would lose
their `__init__.py`; these sources list files themselves. The driver lists names only; executors read the
contents, FILES_PER_PARTITION files or about BYTES_PER_PARTITION bytes in a task. A folder must be visible
to every executor.
"""

from __future__ import annotations

import os
import posixpath
import re
import stat
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codeweft.functions.entities import LANGUAGES

#: Folders that are not read, suffixes of minified files.
IGNORED = set(
    ".git .hg .svn venv .venv env __pycache__ .mypy_cache .pytest_cache .tox .ruff_cache node_modules .next .nuxt bower_components coverage "
    "dist build out target .gradle .idea .vscode __MACOSX".split()
)
MINIFIED = (".min.js", ".min.mjs", ".min.cjs")
MAX_FILE_BYTES, MAX_TOTAL_BYTES, MAX_ENTRIES, BINARY_BYTES = 1024 << 10, 500 << 20, 20_000, 8192
FILES_PER_PARTITION, BYTES_PER_PARTITION = 500, 32 << 20
SCHEMA = "project_id string, path string, language string, size_bytes long, scan_ord int, admitted boolean, content binary"


class UnsafePath(ValueError):
    """A path that leads out of its root."""


class ImportTooLarge(ValueError):
    """An archive beyond the limits of an import."""


def language(path: str) -> str | None:
    base = posixpath.basename(path)
    return LANGUAGES.get(base.rsplit(".", 1)[1].lower()) if "." in base.lstrip(".") else None


def member_path(name: str) -> str:
    """The member's path below the root; UnsafePath if it is absolute, has a drive, climbs, or is empty."""
    path = name.replace("\\", "/")
    parts = [p for p in path.split("/") if p not in ("", ".")]
    if path.startswith("/") or re.match(r"[A-Za-z]:", path) or ".." in parts or not parts or "\0" in path:
        raise UnsafePath(name)
    return "/".join(parts)


def listed(root: str) -> Iterator[tuple[str, int, bool]]:
    """(path, size, link) below root: a folder's files by name, then its folders by name; links are not followed."""
    todo = [""]
    while todo:
        folder = todo.pop()
        with os.scandir(os.path.join(root, folder)) as found:
            entries = sorted(found, key=lambda e: e.name)
        for e in entries:
            if not e.is_dir(follow_symlinks=False):
                yield posixpath.join(folder, e.name), e.stat(follow_symlinks=False).st_size, e.is_symlink()
        below = [posixpath.join(folder, e.name) for e in entries if e.is_dir(follow_symlinks=False) and e.name not in IGNORED]
        todo += reversed(below)


def wanted(path: str, size: int, limit: int) -> bool:
    """Admission by name and size."""
    return language(path) is not None and not path.lower().endswith(MINIFIED) and size <= limit


@dataclass
class Files(InputPartition):
    files: list[tuple[int, str, int, bool, str]]


def _split(files: Iterator[tuple[int, str, int, bool, str]]) -> list[Files]:
    out, size = [Files([])], 0
    for f in files:
        if out[-1].files and (len(out[-1].files) >= FILES_PER_PARTITION or size + f[2] > BYTES_PER_PARTITION):
            out.append(Files([]))
            size = 0
        out[-1].files.append(f)
        size += f[2]
    return out


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root, self.project = options["path"], options.get("project_id", "")
        self.limit = int(options.get("max_file_bytes", MAX_FILE_BYTES))

    def row(self, ord_: int, path: str, size: int, content: bytes | None) -> tuple:
        ok = content is not None and b"\0" not in content[:BINARY_BYTES]
        return (self.project, path, language(path), size, ord_, ok, content if ok else None)


class _TreeReader(_Reader):
    def partitions(self):
        return _split((k, p, n, wanted(p, n, self.limit) and not link, p) for k, (p, n, link) in enumerate(listed(self.root)))

    def read(self, partition):
        for ord_, path, size, take, name in partition.files:
            content = None
            if take:
                try:
                    with open(os.path.join(self.root, name), "rb") as f:
                        content = f.read(self.limit + 1)
                except OSError:
                    pass  # an unreadable file is listed, not admitted
            yield self.row(ord_, path, size, content if content is None or len(content) <= self.limit else None)


class SourceTree(DataSource):
    """Files of a folder. Options: path, project_id, max_file_bytes."""

    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _TreeReader(self.options)


class _ZipReader(_Reader):
    def partitions(self):
        with zipfile.ZipFile(self.root) as z:
            members = [m for m in z.infolist() if not m.is_dir()]
        if len(members) > MAX_ENTRIES or sum(m.file_size for m in members) > MAX_TOTAL_BYTES:
            raise ImportTooLarge(self.root)
        paths = {}
        for m in members:
            path = member_path(m.filename)
            if not stat.S_ISLNK(m.external_attr >> 16):
                paths[path] = m
        # one folder at the top is the root; folders that are not read count as well
        tops = {p.split("/")[0] for p in paths}
        cut = len(next(iter(tops))) + 1 if len(tops) == 1 and all("/" in p for p in paths) else 0
        paths = {p: m for p, m in paths.items() if not IGNORED & set(p[cut:].split("/")[:-1])}
        order = sorted(paths, key=lambda p: [(1, x) for x in p[cut:].split("/")[:-1]] + [(0, p.rsplit("/", 1)[-1])])
        return _split((k, p[cut:], paths[p].file_size, wanted(p, paths[p].file_size, self.limit), paths[p].filename) for k, p in enumerate(order))

    def read(self, partition):
        with zipfile.ZipFile(self.root) as z:
            for ord_, path, size, take, name in partition.files:
                content = None
                if take:
                    with z.open(name) as f:
                        content = f.read(size + 1)  # a member longer than it declares is refused
                    if len(content) > size:
                        raise ImportTooLarge(name)
                yield self.row(ord_, path, size, content)


class SourceZip(SourceTree):
    """Files of a ZIP archive; a single top folder is taken off. Links and ignored folders are left out."""

    @classmethod
    def name(cls):
        return "source_zip"

    def reader(self, schema):
        return _ZipReader(self.options)


def scan(spark: SparkSession, path: str, project_id: str, max_file_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Every listed file of a folder or ZIP archive; `admitted` tells which are source files, only those have content."""
    spark.dataSource.register(SourceTree)
    spark.dataSource.register(SourceZip)
    kind = "source_zip" if zipfile.is_zipfile(path) else "source_tree"
    return spark.read.format(kind).option("project_id", project_id).option("max_file_bytes", max_file_bytes).load(path)


def files(scanned: DataFrame) -> DataFrame:
    """The admitted files and the hash of their bytes."""
    return scanned.where("admitted").drop("admitted").withColumn("sha256", F.sha2("content", 256))


def scan_totals(scanned: DataFrame) -> DataFrame:
    """For each language (null: not admitted): files and bytes."""
    return scanned.groupBy("project_id", F.when(F.col("admitted"), F.col("language")).alias("language")).agg(
        F.count("*").alias("files"), F.sum("size_bytes").alias("size_bytes")
    )


def github_repository(url: str) -> tuple[str, str, str]:
    """(owner, name, clone URL) of a public https address; ValueError for any other."""
    m = re.fullmatch(r"https://(?:www\.)?github\.com/([A-Za-z0-9](?:[A-Za-z0-9-]{0,38}))/([A-Za-z0-9._-]{1,100}?)(?:\.git)?/?", url.strip())
    if not m or m[2] in (".", ".."):
        raise ValueError(f"not a repository address: {url!r}")
    return m[1], m[2], f"https://github.com/{m[1]}/{m[2]}.git"
