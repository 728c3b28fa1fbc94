"""What an extractor is, and running them over a listing.

An extractor turns one source file into node and edge rows. It is registered for extensions; of two for the same one the
later counts. Each task reads its own files; rows carry the place of their file in walk order and their place in the
file as ord, so that the first row of a key is the same however the files were spread.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.model import Graph, first_nodes

MAX_BYTES = 5 * 1024 * 1024
ROW = "kind string, id string, name string, type string, language string, path string, source string, target string, label string, confidence double, properties map<string,string>, file array<string>, k int"
COLUMNS = ["kind", "id", "name", "type", "language", "path", "source", "target", "label", "confidence", "properties", "file", "k"]


@dataclass
class Found:
    """The rows of one file. path is absolute, rel relative to the scan's root."""

    path: str
    rel: str
    language: str
    rows: list[tuple] = field(default_factory=list)
    #: The node that stands for the file, where it isn't its module.
    owner: str = ""

    @property
    def root(self) -> str:
        return self.path[: -len(self.rel) - 1]

    @property
    def origin(self) -> str:
        return self.owner or self.module

    @property
    def stem(self) -> str:
        return os.path.splitext(os.path.basename(self.rel))[0]

    @property
    def module(self) -> str:
        return "mod:" + os.path.splitext(self.rel)[0]

    def endpoint_id(self, line: int) -> str:
        return f"endpoint:{self.rel}:{line}"

    def node(self, id_: str, name: str, kind: str, language: str = "", path: str = "", **properties: str) -> None:
        self.rows.append(("node", id_, name, kind, language, path, "", None, None, None, properties, self.rel.split("/"), len(self.rows)))

    def edge(self, source: str, target: str, kind: str, label: str, confidence: float, **properties: str) -> None:
        self.rows.append(("edge", None, None, kind, None, None, source, target, label, confidence, properties, self.rel.split("/"), len(self.rows)))

    def call(self, host: str, label: str, url: str, line: int) -> None:
        self.node(f"service:{host}", host, "external_api", detected_via="http_call")
        self.edge(self.origin, f"service:{host}", "api_call", label, 0.7, url=url, line=str(line))

    def route(self, method: str, route: str, line: int, framework: str, name: str = "") -> None:
        id_ = self.endpoint_id(line)
        self.node(id_, name or f"{method.upper()} {route}", "endpoint", self.language, self.path, method=method, route=route, line=str(line), framework=framework)
        self.edge(self.origin, id_, "api_call", "serves", 0.85)


@dataclass(frozen=True)
class Extractor:
    language: str
    extensions: tuple[str, ...]
    read: Callable[[Found, str], None]
    #: The node that stands for a file too large to be read; None: files of any size are read.
    stub: Callable[[Found, dict], None] | None


REGISTRY: dict[str, Extractor] = {}


def register(extractor: Extractor) -> Extractor:
    REGISTRY.update(dict.fromkeys(extractor.extensions, extractor))
    return extractor


def module_stub(found: Found, properties: dict) -> None:
    found.node(found.module, found.stem, "module", found.language, os.path.dirname(found.path), **properties)


def uncapped_stub(found: Found, properties: dict) -> None:
    """A module_stub that doesn't say what the most was."""
    module_stub(found, {k: v for k, v in properties.items() if k != "max_capacity"})


def rows_of(path: str, rel: str, ext: str, size: int) -> list[tuple]:
    own = REGISTRY[ext]
    found = Found(path, rel, own.language)
    if own.stub and size > MAX_BYTES:
        own.stub(found, {"skipped": "size", "size_bytes": str(size), "max_capacity": str(MAX_BYTES)})
        return found.rows
    try:
        with open(path, encoding="utf-8", errors="replace", newline="") as f:
            text = f.read()
    except OSError:
        return []
    own.read(found, text)
    return found.rows


def signature_of(extractor: Extractor) -> str:
    """What rows depend on besides the file: the extractor's language and code."""
    import hashlib
    import inspect

    code = inspect.getsource(inspect.getmodule(extractor.read))
    return f"{extractor.language}:{hashlib.sha256(code.encode()).hexdigest()[:16]}"


def raw_rows(files: DataFrame) -> DataFrame:
    """The rows of a listing's files as their extractors give them."""
    def run(batches):
        import lattice.extractors.languages  # noqa: F401  registers them in this worker

        for batch in batches:
            for path, rel, ext, size in zip(batch["path"], batch["rel_path"], batch["ext"], batch["size"]):
                rows = rows_of(path, rel, ext, size) if ext in REGISTRY else []
                if rows:
                    yield pd.DataFrame(rows, columns=COLUMNS)

    return files.where("not skipped").select("path", "rel_path", "ext", "size").mapInPandas(run, ROW)


def graph_of(rows: DataFrame, root: str = "") -> Graph:
    """Nodes once for an id and edges once for a key, the first of each."""
    rows = rows.withColumn("ord", F.struct("file", "k"))
    nodes = rows.where("kind = 'node'").select("id", "name", "type", "language", "path", F.coalesce(F.expr("nullif(source, '')"), F.lit(root)).alias("source"), "properties", "ord")
    edges = rows.where("kind = 'edge'").select("source", "target", "type", "label", "confidence", "properties", "ord")
    best = edges.groupBy("source", "target", "type").agg(F.min_by(F.struct("label", "confidence", "properties", "ord"), "ord").alias("r"))
    return Graph(first_nodes(nodes), best.select("source", "target", "type", "r.*"))


def extract(files: DataFrame, root: str = "") -> Graph:
    return graph_of(raw_rows(files), root)
