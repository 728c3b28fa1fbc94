"""The graph's two tables and their closed domains."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = "id string, name string, type string, language string, path string, source string, properties map<string,string>, ord bigint"
EDGES = "source string, target string, type string, label string, confidence double, properties map<string,string>, ord bigint"

# The domains of types.
NODE_TYPES = ["service", "module", "database", "queue", "cache", "external_api", "package", "endpoint", "note"]
EDGE_TYPES = ["dependency", "api_call", "data_flow", "publish", "subscribe", "read_write"]
TOPOLOGIES = ["monolith", "monorepo", "microservice", "unknown"]
SEVERITIES = ["none", "low", "medium", "high", "critical"]
INFRA = ["database", "queue", "cache", "external_api"]
NOT_ORPHANS = ["endpoint", *INFRA]


@dataclass(frozen=True)
class Graph:
    """ord orders rows wherever the first one counts."""

    nodes: DataFrame
    edges: DataFrame


def is_infra(kind: Column) -> Column:
    return kind.isin(INFRA)


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int")


def first_nodes(nodes: DataFrame) -> DataFrame:
    """One row per id, the first."""
    rest = [c for c in nodes.columns if c not in ("id", "ord")]
    best = nodes.groupBy("id").agg(F.min_by(F.struct(*rest), "ord").alias("r"), F.min("ord").alias("ord"))
    return best.select("id", *(F.col(f"r.{c}").alias(c) for c in rest), "ord")


def merge(graphs: list[Graph]) -> Graph:
    """Nodes first-wins in the order of the list, edges all."""
    nodes, edges = graphs[0].nodes.withColumn("k", F.lit(0)), graphs[0].edges
    for k, g in enumerate(graphs[1:], 1):
        nodes, edges = nodes.unionByName(g.nodes.withColumn("k", F.lit(k)), True), edges.unionByName(g.edges, True)
    ordered = nodes.withColumn("ord", F.struct("k", "ord"))
    return Graph(first_nodes(ordered.drop("k")).withColumn("ord", F.col("ord.ord")), edges)


def nodes_of_type(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.where(F.col("type") == kind).orderBy("id")


def edges_from(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("source") == node)


def edges_to(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("target") == node)


def relative_paths(nodes: DataFrame, root: str) -> DataFrame:
    root = root.rstrip("/")
    inside = F.col("path").startswith(f"{root}/")
    return nodes.withColumn("path", F.when(inside, F.expr(f"substring(path, {len(root) + 2})")).when(F.col("path") == root, ".").otherwise(F.col("path")))
