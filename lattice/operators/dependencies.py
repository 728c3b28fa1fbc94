"""What a graph depends on: its own packages, outside ones and infrastructure; and its data paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds that count as infrastructure here, and modules that are taken for the standard library's.
INFRASTRUCTURE = ["database", "queue", "cache"]
EXTENDED_LIBRARY = "golang.org/x/"


def is_library(name: Column, module: str = "") -> Column:
    """Whether an import is of a standard library: its first segment has no dot. module is the project's own path."""
    outside = ~F.substring_index(name, "/", 1).contains(".") | name.startswith(EXTENDED_LIBRARY)
    return outside & ~name.startswith(module) if module else outside


def kinds(nodes: DataFrame, edges: DataFrame, module: str = "") -> DataFrame:
    """label, kind (infrastructure or external): each label once, as its first dependency edge has it."""
    types = nodes.select(F.col("id").alias("target"), F.col("type").alias("to")).distinct()
    label = F.coalesce(F.expr("nullif(label, '')"), F.col("target"))
    own = edges.where("type = 'dependency'").join(types, "target", "left").select(label.alias("label"), F.col("to").isin(INFRASTRUCTURE).alias("infra"), "ord")
    kind = F.when(F.col("infra"), "infrastructure").when(~is_library(F.col("label"), module), "external")
    return own.withColumn("kind", kind).where("kind is not null").groupBy("label").agg(F.min_by("kind", F.struct("ord", "kind")).alias("kind"), F.min("ord").alias("ord"))


def names_of(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.where(F.col("type") == kind).select("id", "name")


def data_paths(edges: DataFrame) -> DataFrame:
    """source -> target (label) of raw edges that carry or keep data."""
    return edges.where("type in ('data_flow', 'read_write')").select(F.format_string("%s -> %s (%s)", "source", "target", F.coalesce("label", F.lit(""))).alias("path"), "ord")
