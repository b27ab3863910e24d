"""Source trees as a data source: folders that don't belong to the sources are never listed, and files are read in
partitions of about the same size. It reads what the driver and all executors see under the same path."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Folders that a source tree scan leaves out, and its size limit.
IGNORED = (".git", ".hg", ".svn", ".venv", "venv", "node_modules", "__pycache__", "dist", "build", ".mypy_cache")
MAX_FILE_BYTES = 200_000
#: Bytes of text that one task reads, about.
SHARE = 8 << 20
NAME = "source_tree"
Listing = Callable[[str], list[tuple[str, bool, int]]]


def listing(folder: str) -> list[tuple[str, bool, int]]:
    """(name, whether it is a folder, bytes); links to folders aren't followed, and what has gone meanwhile isn't there."""
    out = []
    with os.scandir(folder) as entries:
        for e in entries:
            try:
                if e.is_dir(follow_symlinks=False):
                    out.append((e.name, True, 0))
                elif e.is_file():
                    out.append((e.name, False, e.stat().st_size))
            except OSError:
                continue
    return out


def walk(root: str, allowed: list[str] | None = None, most: int = MAX_FILE_BYTES, ls: Listing = listing) -> Iterator[tuple[str, int]]:
    """(path relative to root, bytes) of the files that are to be read, by path within each folder."""
    wanted = re.compile("|".join(allowed)) if allowed else None
    folders = [""]
    while folders:
        at = folders.pop()
        for name, is_folder, size in sorted(ls(f"{root}/{at}")):
            path = f"{at}{name}"
            if is_folder:
                if name not in IGNORED:
                    folders.append(f"{path}/")
            elif size <= most and (wanted is None or wanted.search(path)):
                yield path, size


def shares(files: Iterator[tuple[str, int]], share: int = SHARE, most: int = 1000) -> Iterator[list[str]]:
    """Paths in parts of about so many bytes, and at most so many files."""
    part, size = [], 0
    for path, n in files:
        if part and (size + n > share or len(part) >= most):
            yield part
            part, size = [], 0
        part.append(path)
        size += n
    if part:
        yield part


class Share(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["root"].rstrip("/")
        self.allowed = options["allowed"].split("\n") if options.get("allowed") else None
        self.most = int(options.get("maxbytes", MAX_FILE_BYTES))
        self.share = int(options.get("share", SHARE))

    def partitions(self) -> list[InputPartition]:
        return [Share(part) for part in shares(walk(self.root, self.allowed, self.most), self.share)] or [Share([])]

    def read(self, partition: Share) -> Iterator[tuple[str, str]]:
        for path in partition.paths:
            try:
                with open(f"{self.root}/{path}", "rb") as f:
                    text = f.read().decode()
            except (OSError, UnicodeDecodeError):  # gone since it was listed, or no text
                continue
            if "\0" not in text:
                yield path, text


class TreeSource(DataSource):
    """Options: root, allowed (patterns, one a line), maxBytes, share."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, text string"

    def reader(self, schema: object) -> DataSourceReader:
        return TreeReader({k.lower(): v for k, v in self.options.items()})


def source_tree(spark: SparkSession, root: str, allowed: list[str] | None = None, most: int = MAX_FILE_BYTES, share: int = SHARE) -> DataFrame:
    """(path, text) of the UTF-8 files under a local root; allowed: patterns of which a path must have one."""
    spark.dataSource.register(TreeSource)
    return spark.read.format(NAME).options(root=root, allowed="\n".join(allowed or []), maxBytes=str(most), share=str(share)).load()
