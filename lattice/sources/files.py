"""A folder tree as a table of files: a Spark data source that walks, prunes and lists without reading contents.

Every folder directly below the root is walked by a task of its own; files of the root form one more. Symbolic links are
never followed. Unreadable folders are passed over.
"""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lattice.functions.glob import glob_regex

# Folders that are never entered, and the files taken for tests.
SKIP_DIRS = ["node_modules", ".git", "vendor", "dist", "build", "__pycache__", ".venv", "venv", ".next", ".nuxt", ".svelte-kit", "target"]
TEST_GLOBS = ["**/tests/**", "**/test/**", "**/__tests__/**", "**/__mocks__/**", "**/testdata/**", "*_test.go", "*.test.ts", "*.test.tsx", "*.spec.ts", "*.spec.tsx", "*.test.js", "*.spec.js", "test_*.py", "*_test.py", "conftest.py"]

LISTING = "path string, rel_path string, name string, ext string, size bigint, mtime_ns bigint, skipped boolean"


class Folder(InputPartition):
    def __init__(self, rel: str, deep: bool):
        self.rel, self.deep = rel, deep


class Walk(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.abspath(options["root"])
        split = lambda key: [x for x in options.get(key, "").split("\n") if x]
        self.skip_dirs = set(split("skip_dirs"))
        self.globs = [glob_regex(g.removeprefix("./")) for g in split("skip_globs")]
        self.extensions = set(split("extensions"))

    def partitions(self) -> list[Folder]:
        below = [e.name for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False) and e.name not in self.skip_dirs]
        return [Folder("", False), *(Folder(name, True) for name in sorted(below))]

    def read(self, part: Folder) -> Iterator[tuple]:
        globs = [re.compile(g, re.S) for g in self.globs]
        waiting = [part.rel]
        while waiting:
            rel = waiting.pop()
            try:
                entries = sorted(os.scandir(os.path.join(self.root, rel)), key=lambda e: e.name)
            except OSError:
                continue
            for e in entries:
                own = f"{rel}/{e.name}" if rel else e.name
                if e.is_dir(follow_symlinks=False):
                    if part.deep and e.name not in self.skip_dirs:
                        waiting.append(own)
                    continue
                ext = os.path.splitext(e.name)[1].lower()
                # A link or an excluded file is listed as skipped, so that it can be counted.
                skipped = e.is_symlink() or any(g.search(own) for g in globs)
                if not skipped and self.extensions and ext not in self.extensions:
                    continue
                try:
                    info = e.stat(follow_symlinks=False)
                except OSError:
                    continue
                if skipped or stat.S_ISREG(info.st_mode):
                    yield e.path, own, e.name, ext, info.st_size, info.st_mtime_ns, skipped


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lattice_files"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> Walk:
        return Walk(self.options)


def listing(spark: SparkSession, root: str, extensions: list[str] | None = None, skip_dirs: list[str] = SKIP_DIRS, skip_globs: list[str] | None = None, include_tests: bool = False) -> DataFrame:
    """path, rel_path, name, ext, size, mtime_ns, skipped of the files below root; without extensions, of all."""
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    spark.dataSource.register(Files)
    globs = [*(skip_globs or []), *([] if include_tests else TEST_GLOBS)]
    lines = lambda x: "\n".join(x or [])
    return spark.read.format("lattice_files").options(root=root, skip_dirs=lines(skip_dirs), skip_globs=lines(globs), extensions=lines(extensions)).load()


def walk_order() -> "F.Column":
    """Folder by folder, names in byte order."""
    return F.split("rel_path", "/")


def first_files(files: DataFrame, max_files: int) -> tuple[DataFrame, bool]:
    """The first max_files accepted files in walk order, and whether any were left out."""
    accepted = files.where("not skipped")
    if max_files <= 0:
        return accepted, False
    return accepted.orderBy(walk_order()).limit(max_files), accepted.count() > max_files


def hashed(files: DataFrame) -> DataFrame:
    """files with hash, the SHA-256 of their contents; null where one can't be read."""
    def run(batches):
        import hashlib

        for batch in batches:
            found = []
            for path in batch["path"]:
                try:
                    with open(path, "rb") as f:
                        found.append(hashlib.file_digest(f, "sha256").hexdigest())
                except OSError:
                    found.append(None)
            yield batch.assign(hash=found)

    return files.mapInPandas(run, f"{LISTING}, hash string")


def changes(files: DataFrame, state: DataFrame) -> DataFrame:
    """path, status against a state (path, mtime_ns, hash). Only files whose time differs from the state's are read."""
    old = state.select("path", F.col("mtime_ns").alias("old_ns"), F.col("hash").alias("old_hash"), F.lit(True).alias("known"))
    met = files.where("not skipped").join(old, "path", "full_outer")
    gone = met.where("rel_path is null").select("path", F.lit("deleted").alias("status"))
    sure = met.where("rel_path is not null and (known is null or mtime_ns = old_ns)").select("path", F.when(F.col("known").isNull(), "added").otherwise("unchanged").alias("status"))
    doubt = met.where("rel_path is not null and known and mtime_ns <> old_ns")
    now = hashed(doubt.select(*files.columns)).select("path", "hash").join(old, "path")
    return gone.unionByName(sure).unionByName(now.select("path", F.when(F.col("hash").eqNullSafe(F.col("old_hash")), "unchanged").otherwise("modified").alias("status")))
