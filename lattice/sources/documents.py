"""Small files that steer the engine: snapshots, baselines, rules, JSON with comments, the registry, and git."""

from __future__ import annotations

import contextlib
import datetime
import json
import os
import re
import shutil
import subprocess
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.model import EDGES, NODES, Graph, first_nodes
from lattice.operators.rules import Matcher, Rule

NODE_KEYS = ["id", "name", "type", "language", "path", "source", "properties"]
EDGE_KEYS = ["source", "target", "type", "label", "confidence", "properties"]
ALIAS = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*")
MAX_ALIAS = 64


def now() -> str:
    return datetime.datetime.now(datetime.UTC).isoformat()


def save_snapshot(graph: Graph, file: str, root: str = "", topology: str = "unknown", label: str = "") -> None:
    """One indented JSON document, written row by row."""
    plain = lambda row, keys: {k: v for k in keys if k in row and (v := row[k]) not in (None, "", {})}
    head = {"version": "1", **({"label": label} if label else {}), "created_at": now(), "root_path": root, "topology": topology}
    nodes = graph.nodes.orderBy("id")
    edges = graph.edges.orderBy("source", "target", "type")
    with open(file, "w", encoding="utf-8") as out:
        out.write(json.dumps(head, indent=2)[:-2])
        for name, rows, keys in (("nodes", nodes, NODE_KEYS), ("edges", edges, EDGE_KEYS)):
            out.write(f',\n  "{name}": [')
            for k, row in enumerate(rows.toLocalIterator()):
                out.write(("," if k else "") + "\n    " + json.dumps(plain(row.asDict(), keys), ensure_ascii=False))
            out.write("\n  ]")
        out.write("\n}\n")


def load_snapshot(spark: SparkSession, file: str) -> Graph:
    """Nodes once for an id, edges once for a key, the first of each."""
    nodes = f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in NODES.split(', ')[:-1])}>>"
    edges = f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in EDGES.split(', ')[:-1])}>>"
    whole = spark.read.schema(f"nodes {nodes}, edges {edges}").json(file, multiLine=True, mode="FAILFAST")
    rows = lambda name: whole.select(F.posexplode(name).alias("ord", "r")).select("r.*", F.col("ord").cast("bigint").alias("ord"))
    best = rows("edges").groupBy("source", "target", "type").agg(F.min_by(F.struct("label", "confidence", "properties", "ord"), "ord").alias("r"))
    return Graph(first_nodes(rows("nodes")), best.select("source", "target", "type", "r.*"))


def save_baseline(violations: DataFrame, file: str) -> None:
    known = [r.asDict() for r in violations.select("rule", "subject").distinct().orderBy("rule", "subject").toLocalIterator()]
    with open(file, "w", encoding="utf-8") as out:
        json.dump({"version": "1", "created_at": now(), "violations": known}, out, indent=2)


def load_baseline(spark: SparkSession, file: str) -> DataFrame:
    with open(file, encoding="utf-8") as f:
        known = json.load(f).get("violations") or []
    return spark.createDataFrame([(x["rule"], x["subject"]) for x in known], "rule string, subject string")


def load_rules(file: str) -> list[Rule]:
    """Rules of a YAML file; one without a name or of an unknown type is an error."""
    import yaml

    with open(file, encoding="utf-8") as f:
        content = yaml.safe_load(f) or {}
    out = []
    for r in content.get("rules") or []:
        if not r.get("name"):
            raise ValueError("a rule has no name")
        if r.get("type") not in ("no_dependency", "require_dependency"):
            raise ValueError(f"rule {r['name']}: unknown type {r.get('type')!r}")
        end = lambda key: Matcher((r.get(key) or {}).get("type") or "", (r.get(key) or {}).get("path") or "")  # noqa: B023, E731
        out.append(Rule(r["name"], r["type"], end("from"), end("to"), r.get("severity") or "medium", r.get("description") or ""))
    return out


TOKEN = re.compile(r'("(?:\\.|[^"\\])*"?)|//[^\n]*|/\*.*?(?:\*/|\Z)', re.S)
COMMA = re.compile(r'("(?:\\.|[^"\\])*"?)|,(?=\s*[}\]])', re.S)


def plain_json(text: str) -> str:
    """JSON without line and block comments, then without commas before a closing bracket; strings stay as they are."""
    for pattern in (TOKEN, COMMA):
        text = pattern.sub(lambda m: m[1] or "", text)
    return text


class Registry:
    """Aliases of repositories in one JSON file. Entries with an invalid alias are dropped when read."""

    def __init__(self, file: str):
        self.file = file
        self.repos: dict[str, dict] = {}
        if os.path.exists(file):
            with open(file, encoding="utf-8") as f:
                self.repos = {a: r for a, r in (json.load(f).get("repos") or {}).items() if valid_alias(a)}

    def _save(self) -> None:
        os.makedirs(os.path.dirname(os.path.abspath(self.file)), exist_ok=True)
        with open(f"{self.file}.new", "w", encoding="utf-8") as out:
            json.dump({"repos": self.repos}, out, indent=2)
        os.replace(f"{self.file}.new", self.file)

    def add(self, alias: str, path: str) -> None:
        if not valid_alias(alias):
            raise ValueError(f"alias {alias!r}: 1 to {MAX_ALIAS} of letters, digits, _, - and ., beginning with a letter or digit")
        self.repos[alias] = {"path": os.path.abspath(path), "added_at": now()}
        self._save()

    def remove(self, alias: str) -> None:
        del self.repos[alias]
        self._save()

    def get(self, alias: str) -> dict:
        return self.repos[alias]

    def update(self, alias: str, nodes: int, edges: int) -> None:
        self.repos[alias] |= {"last_scan": now(), "node_count": nodes, "edge_count": edges}
        self._save()

    def list(self) -> list[dict]:
        """By alias; stale ones have lost their folder."""
        return [{"alias": a, **r, "stale": not os.path.isdir(r["path"])} for a, r in sorted(self.repos.items())]


def valid_alias(alias: str) -> bool:
    return len(alias) <= MAX_ALIAS and bool(ALIAS.fullmatch(alias))


def commits(spark: SparkSession, repo: str, limit: int = 10) -> DataFrame:
    """seq (0 is the newest), ref, date, message of the last commits that aren't merges; 20 at most."""
    n = min(limit if limit > 0 else 10, 20)
    out = subprocess.run(["git", "log", "--format=%H|%aI|%s", f"-n{n}", "--no-merges"], cwd=repo, check=True, capture_output=True, text=True).stdout
    rows = [line.split("|", 2) for line in out.splitlines()]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(r for r in rows if len(r) == 3)], "seq int, ref string, date string, message string")


def check_ref(ref: str) -> str:
    if not ref or ref.startswith("-") or not all(c.isalpha() or c.isdecimal() or c in "./-_~^" for c in ref):
        raise ValueError(f"invalid ref: {ref!r}")
    return ref


@contextlib.contextmanager
def checkout(repo: str, ref: str, parent: str | None = None) -> Iterator[str]:
    """A detached work tree at ref, gone afterwards. On a cluster, parent has to be a folder that executors share."""
    check_ref(ref)
    own = tempfile.mkdtemp(prefix="lattice-ref-", dir=parent)
    tree = os.path.join(own, "tree")
    try:
        subprocess.run(["git", "worktree", "add", "--detach", tree, ref], cwd=repo, check=True, capture_output=True, text=True)
        yield tree
    finally:
        subprocess.run(["git", "worktree", "remove", "--force", tree], cwd=repo, check=False, capture_output=True)
        shutil.rmtree(own, ignore_errors=True)
