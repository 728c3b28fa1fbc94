"""The part of a graph that a diagram shows.

Spark filters, prunes and reduces; only what is left, of a checked size, comes to the driver. A larger graph is an error
that names the ways to make it smaller, never a cut diagram.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Row
from pyspark.sql import functions as F

from lattice.model import Graph
from lattice.operators import kernels, metrics, resolve

MAX_ROWS = 50_000


@dataclass(frozen=True)
class Options:
    title: str = "Architecture"
    view_level: str = "container"
    direction: str = "TB"
    prune_threshold: float = 0.0  # 0 prunes nothing
    min_degree: int = 0
    max_chars: int = 100_000
    root: str = ""
    topology: str = "unknown"
    theme: tuple[str, str] = ("", "")  # background and foreground, #rgb or #rrggbb
    group_depth: int = 0  # folders instead of files, cut to so many segments


@dataclass
class Visible:
    nodes: list[Row]
    edges: list[Row]
    names: dict[str, str] = field(default_factory=dict)


def visible(graph: Graph, options: Options, reduce: bool = True) -> Visible:
    """Nodes by id and edges by source, target and type, after the view, pruning, core and reduction."""
    nodes, edges = graph.nodes, resolve.resolved_edges(graph.nodes, graph.edges)
    if options.group_depth > 0:
        grouped = metrics.group_by_folder(nodes, edges, options.group_depth)
        edges = grouped.select("source", "target", "type", "label", F.lit(1.0).alias("confidence"))
        nodes, reduce = metrics.folder_nodes(nodes, options.group_depth), False  # a count isn't implied by other counts
    nodes, edges = metrics.view(nodes, edges, options.view_level)
    if options.prune_threshold > 0:
        nodes, edges, _ = metrics.prune_super_nodes(nodes, edges, options.prune_threshold)
    if options.min_degree > 0:
        kept = kernels.k_core(nodes, edges, options.min_degree).select("id")
        nodes = nodes.join(kept, "id", "left_semi")
        for end in ("source", "target"):
            edges = edges.join(kept.withColumnRenamed("id", end), end, "left_semi")
    if reduce:
        left = kernels.transitive_reduction(edges)
        edges = edges.join(left.select("source", "target", "type"), ["source", "target", "type"], "left_semi")
    own = nodes.select(*(c if c in nodes.columns else F.lit("").alias(c) for c in ("id", "name", "type", "language", "path"))).na.fill("")
    out = []
    for rows, order in ((own, ["id"]), (edges.select("source", "target", "type", "label", "confidence"), ["source", "target", "type"])):
        got = rows.orderBy(*order).limit(MAX_ROWS + 1).collect()
        if len(got) > MAX_ROWS:
            raise ValueError(f"over {MAX_ROWS} rows to draw: choose a higher view level, prune, or group by folder")
        out.append(got)
    return Visible(*out, {n["id"]: n["name"] for n in out[0]})


def edge_label(edge: Row, names: dict[str, str]) -> str:
    """Nothing where the label only repeats the edge's type or its target's name."""
    return "" if edge["label"] in (None, "", edge["type"], names.get(edge["target"])) else edge["label"]


def safe_id(id_: str) -> str:
    return re.sub(r"[^A-Za-z0-9_]", "_", id_.replace("/", "__").replace(":", "___"))


def clipped(text: str, most: int) -> str:
    """At most so many characters, with a note of the cut; 0 is no limit."""
    return text if most <= 0 or len(text) <= most else f"{text[:most]}\n... (truncated: {most} of {len(text)} characters)"
