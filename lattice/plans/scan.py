"""From a folder to its graph, and the questions that are asked of it."""

from __future__ import annotations

import contextlib
import os
import threading
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import lattice.extractors.languages  # noqa: F401
from lattice.extractors.base import REGISTRY, graph_of
from lattice.model import SEVERITIES, Graph, merge, relative_paths, severity_rank
from lattice.operators import boundaries, drift, environment, kernels, metrics, resolve, rules
from lattice.sources import documents, files, topology
from lattice.sources.state import State, rescan
from lattice.storage import stored


@dataclass(frozen=True)
class Scanned:
    """truncated: whether a limit left files or nodes out."""

    graph: Graph
    root: str
    truncated: bool
    stats: dict[str, int]
    state: State


@contextlib.contextmanager
def time_limit(spark: SparkSession, seconds: float) -> Iterator[None]:
    """Cancels the jobs of the block after so many seconds and raises TimeoutError; 0 is no limit."""
    if seconds <= 0:
        yield
        return
    sc, group, over, done = spark.sparkContext, f"scan-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        if not done.wait(seconds):
            over.set()
            while not done.wait(0.2):  # the next job may not have begun yet
                sc.cancelJobGroup(group)

    sc.setJobGroup(group, "scan", interruptOnCancel=True)
    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
        if over.is_set():
            raise TimeoutError(f"the scan took more than {seconds} s")
    except Exception as error:
        if over.is_set():
            raise TimeoutError(f"the scan took more than {seconds} s") from error
        raise
    finally:
        done.set()
        sc.setLocalProperty("spark.jobGroup.id", None)


def scan_folder(spark: SparkSession, root: str, max_files: int = 0, max_nodes: int = 0, skip_dirs: list[str] | None = None, skip_globs: list[str] | None = None,
                include_tests: bool = False, timeout: float = 0, state: State | None = None) -> Scanned:
    """The stored graph of a folder, with paths relative to it. With a state of an earlier scan only what has changed is
    read. skip_dirs are added to those that are always passed over."""
    began, root = time.monotonic(), root.rstrip("/") or "/"
    with time_limit(spark, timeout):
        found = stored(files.listing(spark, root, [*REGISTRY], skip_dirs=files.SKIP_DIRS + (skip_dirs or []), skip_globs=skip_globs, include_tests=include_tests), "listing")
        first, cut = files.first_files(found, max_files)
        now, stats = rescan(first, state)
        g = graph_of(now.rows.drop("rel_path"), root)
        nodes, edges = stored(relative_paths(g.nodes, root), "nodes"), stored(g.edges, "edges")
        if max_nodes > 0 and nodes.count() > max_nodes:
            cut, last = True, nodes.orderBy("ord").limit(max_nodes).agg(F.max("ord").alias("last"))
            upto = lambda df: stored(df.join(F.broadcast(last)).where("ord <= last").drop("last"), "limited")  # noqa: E731  one row
            nodes, edges = upto(nodes), upto(edges)
        stats |= {"files_skipped": found.where("skipped").count(), "nodes_found": nodes.count(), "edges_found": edges.count(), "duration_ms": int(1000 * (time.monotonic() - began))}
    return Scanned(Graph(nodes, edges), root, cut, stats, now)


def scan(spark: SparkSession, root: str, max_files: int = 0, skip_globs: list[str] | None = None, include_tests: bool = False) -> Graph:
    return scan_folder(spark, root, max_files, skip_globs=skip_globs, include_tests=include_tests).graph


def scan_all(spark: SparkSession, roots: list[str], **options) -> Scanned:
    """Several folders as one graph: nodes of the first one that has them, all edges, sums of the statistics."""
    each = [scan_folder(spark, r, **options) for r in roots]
    total = {k: sum(s.stats.get(k, 0) for s in each) for k in ("files_analyzed", "files_skipped", "nodes_found", "edges_found", "duration_ms")}
    return Scanned(merge([s.graph for s in each]), roots[0], any(s.truncated for s in each), total, each[0].state)


def project(spark: SparkSession, root: str) -> dict:
    """topology, reason, ambiguous, signals, boundaries (rows in order)."""
    listing = stored(files.listing(spark, root, skip_dirs=topology.MARKER_SKIP_DIRS, include_tests=True), "listing")
    out = topology.detect(listing)
    found = stored(boundaries.build(listing, os.path.basename(os.path.abspath(root))), "boundaries")
    out["signals"]["deployable_units"] = boundaries.deployable(found).first()["units"]
    return out | {"boundaries": found}


def graph_signals(graph: Graph, found: DataFrame) -> dict:
    """Edges between boundaries, and databases that several of them use."""
    edges, owner = resolved(graph), stored(drift.boundary_of(graph.nodes, found), "owner")
    shared = [r["id"] for r in drift.shared_databases(graph.nodes, edges, owner).orderBy("id").collect()]  # few databases
    return {"cross_boundary_edges": drift.cross_boundary(edges, owner).first()["crossing"], "shared_database": bool(shared), "shared_database_ids": shared}


def resolved(graph: Graph) -> DataFrame:
    return stored(resolve.resolved_edges(graph.nodes, graph.edges), "resolved")


def environment_of(spark: SparkSession, root: str) -> DataFrame:
    listing = stored(files.listing(spark, root, include_tests=True), "listing")
    return environment.broken(environment.configs(listing), listing.select(F.col("rel_path").alias("path")))


def validate(graph: Graph, own: list[rules.Rule] = (), known: DataFrame | None = None, root: str = "") -> DataFrame:
    """place, rule, severity, subject, detail, ids (of a cycle's nodes), and is_new against a baseline: cycles, orphans,
    layers, build files (if root is given) and own rules, in this order."""
    edges = resolved(graph)
    out = [rules.cycles(edges, graph.edges), rules.orphans(graph.nodes, graph.edges), rules.layering(graph.nodes, graph.edges)]
    out += [environment_of(graph.nodes.sparkSession, root)] if root else []
    out += [rules.custom(graph.nodes, edges, r) for r in own]
    found = None
    for place, df in enumerate(out):
        df = df if "ids" in df.columns else df.withColumn("ids", F.array().cast("array<string>"))
        df = df.select(F.lit(place).alias("place"), "rule", "severity", "subject", "detail", "ids")
        found = df if found is None else found.unionByName(df)
    return found if known is None else rules.split_known(found, known)


def recommend(graph: Graph, found: DataFrame, category: str = "") -> DataFrame:
    edges = resolved(graph)
    return rules.of_category(rules.recommendations(graph.nodes, edges, stored(metrics.fan_in_out(graph.nodes, edges), "metrics"), found), category)


def changes(old: Graph, new: Graph) -> DataFrame:
    """change_type, category, subject, severity of nodes and raw edges; cycles of the new graph are critical, new or not."""
    found = drift.node_changes(old.nodes, new.nodes).unionByName(drift.edge_changes(old.edges, new.edges))
    bad = rules.cycles(resolved(new), new.edges)
    return found.unionByName(bad.select(F.lit("added").alias("change_type"), F.lit("validation").alias("category"), "subject", "severity"))


def report(found: DataFrame) -> dict:
    """How many changes of each type, and the worst severity."""
    row = found.agg(*(F.count_if(F.col("change_type") == k).alias(k) for k in ("added", "removed", "modified")), F.max(severity_rank(F.col("severity"))).alias("worst")).first()
    return {k: row[k] for k in ("added", "removed", "modified")} | {"max_severity": SEVERITIES[row["worst"] - 1] if row["worst"] else "none"}


def changes_at_least(found: DataFrame, severity: str = "", change_type: str = "") -> DataFrame:
    out = found.where(F.col("change_type") == change_type) if change_type else found
    return out.where(severity_rank(F.col("severity")) >= SEVERITIES.index(severity) + 1) if severity else out


def drift_between(spark: SparkSession, repo: str, base: str, head: str = "HEAD", parent: str | None = None, **options) -> DataFrame:
    """changes between two refs of a git repository; on a cluster, parent is a folder that executors share. A scan that a
    limit cut short is an error: what it left out would look removed."""
    graphs = []
    for ref in (base, head):
        with documents.checkout(repo, ref, parent) as tree:
            got = scan_folder(spark, tree, **options)
        if got.truncated:
            raise ValueError(f"the scan of {ref} reached a limit; raise max_files or max_nodes")
        graphs.append(got.graph)
    return changes(*graphs)


def history(spark: SparkSession, repo: str, limit: int = 10, parent: str | None = None, **options) -> list[dict]:
    """The last commits, newest first: their sizes and topology, and the changes since the one before that could be scanned."""
    entries, graphs = [], []
    for c in documents.commits(spark, repo, limit).orderBy("seq").collect():  # 20 at most
        entry = {"ref": c["ref"][:8], "date": c["date"], "message": c["message"], "node_count": 0, "edge_count": 0, "topology": "unknown", "changes_from_previous": 0}
        graph = None
        with contextlib.suppress(Exception):  # one commit that can't be scanned doesn't end the history
            with documents.checkout(repo, c["ref"], parent) as tree:
                graph = scan_folder(spark, tree, **options).graph
                entry |= {"node_count": graph.nodes.count(), "edge_count": graph.edges.count(), "topology": project(spark, tree)["topology"]}
        entries.append(entry)
        graphs.append(graph)
    before = None
    for entry, graph in zip(reversed(entries), reversed(graphs)):
        if graph is not None:
            entry["changes_from_previous"] = changes(before, graph).count() if before is not None else 0
            before = graph
    return entries


# What the beginning of an id says of a node.
KINDS = {"mod": "module", "pkg": "package", "endpoint": "endpoint", "note": "note", "infra": "infrastructure component", "service": "service", "dir": "folder"}


def counted(n: int, noun: str) -> str:
    return f"{n} {noun}" if n == 1 else f"{n} {noun[:-1]}ies" if noun.endswith("y") else f"{n} {noun}s"


def narrate(found: DataFrame, base: str = "baseline", head: str = "current") -> str:
    """One paragraph on changes: counts, then the nodes by kind with a few names, then the cycles."""
    kind = F.when(F.col("category") == "node", F.substring_index("subject", ":", 1)).otherwise("")
    rows = found.groupBy("change_type", "category", kind.alias("kind")).agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("subject")), 1, 3).alias("first")).collect()  # a row a kind
    if not rows:
        return f"No structural change between {base} and {head}."
    total = lambda change, category: sum(r["n"] for r in rows if (r["change_type"], r["category"]) == (change, category))
    parts = [f"{counted(n, 'component')} {change}" for change in ("added", "removed", "modified") if (n := total(change, "node"))]
    if edges := total("added", "edge") + total("removed", "edge"):
        parts.append(f"{counted(edges, 'dependency edge')} changed")
    out = [f"Between {base} and {head}: {', '.join(parts) or 'findings only'}."]
    for change in ("added", "removed", "modified"):
        groups = []
        for r in sorted((r for r in rows if (r["change_type"], r["category"]) == (change, "node")), key=lambda r: r["kind"]):
            names = ", ".join(s.split(":", 1)[-1] for s in r["first"]) + (f" and {r['n'] - len(r['first'])} more" if r["n"] > len(r["first"]) else "")
            groups.append(f"{counted(r['n'], KINDS.get(r['kind'], 'component'))} ({names})")
        if groups:
            out.append(f"{change.capitalize()}: {'; '.join(groups)}.")
    if cycles := [s for r in rows if r["category"] == "validation" for s in r["first"]]:
        out.append(f"Now in the graph: {'; '.join(cycles)}.")
    return " ".join(out)


# Uses of infrastructure, by the type of its node.
USES = {"database": "Keeps data in {}", "queue": "Sends messages by {}", "cache": "Caches in {}", "external_api": "Calls outside services ({})"}


def explain(graph: Graph, about: dict | None = None) -> dict[str, list[str]]:
    """summary, topology, patterns, decisions and risks, from counts by type; about is what project() found."""
    n = {r["type"]: r["n"] for r in metrics.counts_by_type(graph.nodes).collect()}  # a row a type
    get = lambda *kinds: sum(n.get(k, 0) for k in kinds)
    calls = graph.edges.where("type = 'api_call' and label <> 'serves'").count()
    parts, db, ends = get("service", "module"), get("database"), get("endpoint")
    edges = resolved(graph)
    alone = rules.disconnected(graph.nodes, graph.edges).count()
    cyclic = not rules.cycles(edges, graph.edges).isEmpty()
    chosen = lambda rows: [text for fits, text in rows if fits]
    patterns = chosen([
        (parts > 1 and db == 1, "One database that several services share"),
        (parts > 1 and db > 1, f"{db} databases beside several services"),
        (get("queue"), "Events go through a message queue"),
        (calls, f"Parts call each other: {counted(calls, 'API call')}"),
        (get("cache"), "A cache is in use"),
        (ends, f"An HTTP API of {counted(ends, 'endpoint')}"),
    ])
    risks = chosen([
        (db == 1 and parts > 2, "All services depend on one database, in its schema and in its load"),
        (ends > 5 and not get("cache"), f"{ends} endpoints and no cache: load reaches the data at once"),
        (cyclic, "Dependencies form a cycle, so that its parts can't be built or owned apart"),
        (alone, f"{counted(alone, 'node')} without any connection: unused, or not wired in yet"),
    ])
    via = F.col("properties")["detected_via"]
    uses = graph.nodes.where(F.col("type").isin([*USES]) & via.isNotNull()).select("type", "name", via.alias("via")).orderBy("id").limit(1000).collect() if "properties" in graph.nodes.columns else []
    decisions = [f"{USES[r['type']].format(r['name'])}, seen by {r['via']}" for r in uses]
    spoken = metrics.languages(graph.nodes).orderBy("language").collect() if "language" in graph.nodes.columns else []  # a row a language
    if len(spoken) == 1:
        decisions.append(f"Written in {spoken[0]['language']} alone")
    elif spoken:
        decisions.append("Written in " + ", ".join(f"{r['language']} ({counted(r['n'], 'component')})" for r in spoken))
    return {"summary": [metrics.summary(graph.nodes, graph.edges).first()[0]], "topology": [topology_text(about)], "patterns": patterns or ["No pattern stands out"], "decisions": decisions, "risks": risks}


def topology_text(about: dict | None) -> str:
    if not about:
        return "Nothing is known of its boundaries."
    found = about["boundaries"].orderBy("stage", "file").select("markers").limit(1000).collect()
    markers = ", ".join(dict.fromkeys(m for r in found for m in r["markers"]))
    return {
        "monolith": "A monolith: one project root and at most one service.",
        "monorepo": f"A monorepo of several project roots, marked by {markers or 'its workspace file'}.",
        "microservice": f"Microservices: {len(found)} boundaries with containers.",
    }.get(about["topology"], "No project file tells its kind.")
