"""Links from notes to the packages whose paths they quote as code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a link is, and how sure.
LABEL, CONFIDENCE = "documents", 0.6
SOURCES = r"\.(go|ts|tsx|py|js)$"


def quoted_path(span: Column) -> Column:
    """A code span as the path of a folder, null where it isn't one: without line numbers, slashes at the end and the name of
    a source file; at least two segments."""
    whole = F.regexp_replace(F.regexp_replace(F.trim(span), r":\d+(-\d+)?$", ""), "/+$", "")
    folder = F.when(F.regexp_like(whole, F.lit(SOURCES)), F.regexp_replace(whole, "/[^/]*$", "")).otherwise(whole)
    fits = whole.contains("/") & F.regexp_like(whole, F.lit(r"^[a-zA-Z_][\w./-]*$")) & folder.contains("/")
    return F.when(fits, folder)


def link(notes: DataFrame, packages: DataFrame) -> DataFrame:
    """source, target, type, label, confidence from notes (id, text) and packages (id, path): a quoted path is a package's path
    or its last segments, two or more."""
    spans = F.regexp_extract_all("text", F.lit("`([^`\n]+)`"), F.lit(1))
    wanted = notes.select(F.col("id").alias("source"), F.explode(F.transform(spans, quoted_path)).alias("tail")).where("tail is not null").distinct()
    parts = F.filter(F.split("path", "/"), lambda s: ~s.isin("", "."))
    ends = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    known = packages.where(F.size(parts) > 1).select(F.col("id").alias("target"), F.explode(ends).alias("tail"))
    return wanted.join(known, "tail").select("source", "target").distinct().select("source", "target", F.lit("dependency").alias("type"), F.lit(LABEL).alias("label"), F.lit(CONFIDENCE).alias("confidence"))
