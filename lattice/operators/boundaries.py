"""Boundaries of services and modules from marker files, and what is deployed on its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which marker makes which boundary; where several share a folder, the first in this order names its type.
KINDS = [("go.mod", "module"), ("cmd/ directory", "service"), ("Dockerfile", "service"), ("pyproject.toml", "module"), ("setup.py", "module"), ("setup.cfg", "module"),
         ("Cargo.toml", "module"), ("pom.xml", "module"), ("build.gradle", "module"), ("build.gradle.kts", "module")]
#: A marker that is noted even where another one has made the boundary; all others are passed over there.
ADDS = "Dockerfile"
#: Files of one kind come in the order of the walk, whatever they are called.
STAGES = {"go.mod": 0, "cmd/ directory": 1, "Dockerfile": 2, "pyproject.toml": 3, "setup.py": 3, "setup.cfg": 3, "Cargo.toml": 4, "pom.xml": 5, "build.gradle": 6, "build.gradle.kts": 6}


def markers(files: DataFrame) -> DataFrame:
    """path (of the folder, '.' for the root), marker, stage and file of a listing (rel_path, name)."""
    folder = F.regexp_replace("rel_path", "/?[^/]*$", "")
    marker = F.when(F.col("name") == "dockerfile", ADDS).otherwise(F.col("name"))
    stage = lambda m: F.create_map(*(F.lit(x) for kv in STAGES.items() for x in kv))[m]
    dot = lambda path: F.when(path == "", ".").otherwise(path)
    own = files.select(dot(folder).alias("path"), marker.alias("marker"), F.split("rel_path", "/").alias("file")).where(F.col("marker").isin([m for m, _ in KINDS]))
    commands = files.select(F.regexp_extract("rel_path", "^((?:.*/)?cmd/[^/]+)/", 1).alias("path")).where("path <> ''").distinct().select("path", F.lit("cmd/ directory").alias("marker"), F.split("path", "/").alias("file"))
    return own.unionByName(commands).withColumn("stage", stage(F.col("marker")))


def build(files: DataFrame, root_name: str) -> DataFrame:
    """path, name, type, markers (in order) of a listing's boundaries, one for each folder that holds a marker."""
    kind = F.create_map(*(F.lit(x) for kv in KINDS for x in kv))
    found = markers(files).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("stage", "file", "marker"))).alias("m"))
    first = F.get("m", 0)
    # A folder has one go.mod and one cmd entry; of the first marker's kind only one is there, and Dockerfiles add themselves.
    more = F.filter(F.slice("m", 2, 1_000_000), lambda x: (x["marker"] == ADDS) & (x["stage"] >= first["stage"]))
    named = F.when(F.col("path") == ".", F.lit(root_name)).otherwise(F.substring_index("path", "/", -1))
    return found.select("path", named.alias("name"), kind[first["marker"]].alias("type"), F.concat(F.array(first["marker"]), F.transform(more, lambda x: x["marker"])).alias("markers"), first["stage"].alias("stage"), first["file"].alias("file"))


def in_order(found: DataFrame) -> DataFrame:
    """As a reader would list them: by the kind of the marker that made them, then as walked."""
    return found.orderBy("stage", "file").drop("stage", "file")


def deployable(found: DataFrame) -> DataFrame:
    """One row, units: services, and modules with a Dockerfile."""
    return found.agg(F.count_if((F.col("type") == "service") | F.array_contains("markers", ADDS)).alias("units"))


def distinct_markers(found: DataFrame) -> Column:
    """Each marker once, as first seen, of boundaries in order: an expression over one row that holds them as lists."""
    return F.array_distinct(F.flatten(F.col("lists")))
