"""What changed between two graphs, file listings or months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def node_severity(kind: Column) -> Column:
    # How much a node's type weighs.
    return F.when(kind.isin("service", "database", "queue", "cache"), "high").when(kind.isin("external_api", "module", "package"), "medium").otherwise("low")


def node_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """change_type, category, subject, severity of nodes added, removed, or changed in name or type."""
    a, b = old.select("id", F.struct("name", "type").alias("a")), new.select("id", F.struct("name", "type").alias("b"))
    both = a.join(b, "id", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("modified")
    return both.select(change.alias("change_type"), F.lit("node").alias("category"), F.col("id").alias("subject"), node_severity(F.coalesce("b.type", "a.type")).alias("severity"))


def edge_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    key = lambda df, flag: df.select("source", "target", "type").distinct().withColumn(flag, F.lit(True))
    both = key(old, "a").join(key(new, "b"), ["source", "target", "type"], "full_outer").where("a is null or b is null")
    return both.select(F.when(F.col("a").isNull(), "added").otherwise("removed").alias("change_type"), F.lit("edge").alias("category"), F.format_string("%s -> %s (%s)", "source", "target", "type").alias("subject"), F.lit("medium").alias("severity"))


def listing_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, status from listings (path, hash)."""
    both = old.select("path", F.col("hash").alias("a")).join(new.select("path", F.col("hash").alias("b")), "path", "full_outer")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") == F.col("b"), "unchanged").otherwise("modified")
    return both.select("path", status.alias("status"))


def history(edges: DataFrame, period: Column) -> DataFrame:
    """month, nodes, edges, changes: sizes of each period's graph, and the edges that came or went since the one before."""
    e = edges.select(period.alias("month"), "source", "target").distinct()
    months = e.select("month").distinct().withColumn("k", F.row_number().over(Window.orderBy("month")))  # one row a period
    ranked = e.join(F.broadcast(months), "month")
    size = ranked.groupBy("month", "k").agg(F.count("*").alias("edges"))
    nodes = e.select("month", F.explode(F.array("source", "target")).alias("id")).groupBy("month").agg(F.count_distinct("id").alias("nodes"))
    kept = ranked.join(ranked.select("source", "target", (F.col("k") + 1).alias("k")), ["source", "target", "k"]).groupBy("k").agg(F.count("*").alias("kept"))
    rows = size.join(kept, "k", "left").join(nodes, "month").withColumn("before", F.lag("edges").over(Window.orderBy("k")))
    changes = F.when(F.col("before").isNull(), 0).otherwise(F.col("edges") + F.col("before") - 2 * F.coalesce("kept", F.lit(0)))
    return rows.select("month", "nodes", "edges", changes.cast("bigint").alias("changes"))


def boundary_of(nodes: DataFrame, boundaries: DataFrame) -> DataFrame:
    """id, boundary: the one with the longest path that is the node's path or a folder above it; '.' holds the rest."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    spread = nodes.where("path is not null").select("id", F.explode(F.concat(above, F.array(F.lit(".")))).alias("path"))
    found = spread.join(boundaries.select("path", F.col("name").alias("boundary")), "path")
    return found.groupBy("id").agg(F.max_by("boundary", F.when(F.col("path") == ".", 0).otherwise(F.octet_length("path"))).alias("boundary"))


def cross_boundary(edges: DataFrame, owner: DataFrame) -> DataFrame:
    o = lambda x: owner.select(F.col("id").alias(x), F.col("boundary").alias(f"{x}_b"))
    both = edges.join(o("source"), "source").join(o("target"), "target")
    return both.agg(F.count_if(F.col("source_b") != F.col("target_b")).alias("crossing"), F.count("*").alias("total"))


def shared_databases(nodes: DataFrame, edges: DataFrame, owner: DataFrame) -> DataFrame:
    """id, boundaries: databases used from two boundaries or more."""
    db = nodes.where("type = 'database'").select(F.col("id").alias("target"))
    used = edges.join(db, "target").join(owner.withColumnRenamed("id", "source"), "source")
    return used.groupBy(F.col("target").alias("id")).agg(F.count_distinct("boundary").alias("boundaries")).where("boundaries >= 2")
