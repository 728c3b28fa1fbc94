"""Counts and coupling over resolved edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattice.model import is_infra


def counts_by_type(rows: DataFrame) -> DataFrame:
    return rows.groupBy("type").agg(F.count("*").alias("n"))


def fan_in_out(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, fan_out, fan_in, coupling, instability over dependency edges; isolated nodes count, infrastructure doesn't."""
    ends = edges.where("type = 'dependency'").select(F.explode(F.array(
        F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    degree = ends.groupBy("e.id").agg(F.sum("e.o").alias("fan_out"), F.sum("e.i").alias("fan_in"))
    rows = nodes.where(~is_infra(F.col("type"))).select("id").join(degree, "id", "left").select("id", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("fan_out", "fan_in")))
    total = F.col("fan_in") + F.col("fan_out")
    return rows.select("id", "fan_out", "fan_in", total.alias("coupling"), F.when(total > 0, F.col("fan_out") / total).otherwise(0.0).alias("instability"))


def metrics_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return fan_in_out(nodes, edges).agg(F.avg("coupling").alias("avg_coupling"), F.avg("instability").alias("avg_instability"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One line: node and edge counts by type, in the order of their text."""
    part = lambda df: counts_by_type(df).agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%d %s", "n", "type"))), ", ").alias("s"))
    return part(nodes).crossJoin(part(edges).withColumnRenamed("s", "e")).select(F.format_string("Nodes: %s. Edges: %s.", "s", "e").alias("summary"))  # two rows of one


def languages(nodes: DataFrame) -> DataFrame:
    return nodes.where("language <> ''").groupBy("language").agg(F.count("*").alias("n"))


def view(nodes: DataFrame, edges: DataFrame, level: str) -> tuple[DataFrame, DataFrame]:
    """The nodes of a view level, and the edges between them."""
    # What each level shows.
    kind = F.col("type")
    keep = {"system": kind.isin("service", "external_api"), "container": ~kind.isin("package", "endpoint"), "component": F.lit(True)}[level]
    shown = nodes.where(keep)
    ids = shown.select("id").distinct()
    inside = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return shown, inside


def prune_super_nodes(nodes: DataFrame, edges: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without targets of a share of distinct sources over the threshold: nodes, edges and the pruned (id, share)."""
    total = edges.agg(F.count_distinct("source").alias("total"))
    per = edges.groupBy("target").agg(F.count_distinct("source").alias("n"))
    gone = per.join(F.broadcast(total)).select(F.col("target").alias("id"), (F.col("n") / F.col("total")).alias("share")).where(F.col("share") > threshold)  # total is one row
    left = edges.join(gone.select(F.col("id").alias("target")), "target", "left_anti").join(gone.select(F.col("id").alias("source")), "source", "left_anti")
    return nodes.join(gone.select("id"), "id", "left_anti"), left, gone


def folder_of(depth: int) -> Column:
    """The folder node that a node is drawn in: the first folders of its path; nodes that stand for no file are their own."""
    is_file = F.col("type").isin("endpoint", "note") | F.regexp_like(F.coalesce("path", F.lit("")), F.lit(r"\.[^./]*$"))
    folder = F.when(is_file, F.regexp_replace("path", r"/?[^/]*$", "")).otherwise(F.col("path"))
    short = F.array_join(F.slice(F.filter(F.split(folder, "/"), lambda s: ~s.isin("", ".")), 1, depth), "/")
    filed = F.col("type").isin("module", "package", "endpoint", "note") & (F.coalesce("path", F.lit("")) != "")
    return F.when(filed, F.concat(F.lit("dir:"), F.when(short == "", "(root)").otherwise(short))).otherwise(F.col("id"))


def folder_nodes(nodes: DataFrame, depth: int) -> DataFrame:
    """id, name, type, path, members: the folders with the number of their nodes, and the nodes that aren't in one."""
    own = nodes.select("id", "name", "type", "path", folder_of(depth).alias("g"))
    inside = own.where("g <> id").groupBy("g").agg(F.count("*").alias("members"))
    folder = F.expr("substring(g, 5)")
    rows = inside.select(F.col("g").alias("id"), F.format_string("%s (%d)", folder, "members").alias("name"), F.lit("module").alias("type"), folder.alias("path"), "members")
    return rows.unionByName(own.where("g = id").select("id", "name", "type", "path", F.lit(None).cast("bigint").alias("members")))


def count_label(n: Column, kind: Column) -> Column:
    """1 import, 12 calls."""
    noun = F.when(kind == "dependency", "import").when(kind == "api_call", "call").otherwise(F.translate(kind, "_", " "))
    return F.concat_ws(" ", n.cast("string"), F.concat(noun, F.when(n == 1, "").otherwise("s")))


def group_by_folder(nodes: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """source, target, type, n, label of the edges between folders and nodes outside of them. A single edge that touches no
    folder keeps its label; of several the last one's is lost in their number."""
    key = nodes.select("id", folder_of(depth).alias("g"))
    both = edges.join(key.select(F.col("id").alias("source"), F.col("g").alias("s")), "source").join(key.select(F.col("id").alias("target"), F.col("g").alias("t")), "target")
    merged = both.where("s <> t").groupBy(F.col("s").alias("source"), F.col("t").alias("target"), "type").agg(F.count("*").alias("n"), F.max_by("label", "ord").alias("own"))
    touches = F.col("source").startswith("dir:") | F.col("target").startswith("dir:") | (F.col("n") > 1)
    return merged.select("source", "target", "type", "n", F.when(touches, count_label(F.col("n"), F.col("type"))).otherwise(F.col("own")).alias("label"))
