"""What an earlier scan found, file by file, so that a later one reads only what has changed."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.extractors.base import REGISTRY, raw_rows, signature_of
from lattice.sources import files
from lattice.storage import stored

FILES = "path string, rel_path string, ext string, mtime_ns bigint, hash string, signature string"


@dataclass(frozen=True)
class State:
    """files (FILES) and the rows that their extractors gave, with their rel_path."""

    files: DataFrame
    rows: DataFrame

    def remove(self, path: str) -> State:
        gone = self.files.where(F.col("path") == path).select("rel_path")
        return State(self.files.where(F.col("path") != path), self.rows.join(gone, "rel_path", "left_anti"))

    def rows_of(self, path: str) -> DataFrame:
        return self.rows.join(self.files.where(F.col("path") == path).select("rel_path"), "rel_path", "left_semi")

    def save(self, folder: str) -> None:
        """Written beside what is there, then put in its place."""
        for name, df in (("files", self.files), ("rows", self.rows)):
            df.write.mode("overwrite").parquet(os.path.join(folder, name))

    @staticmethod
    def load(spark: SparkSession, folder: str) -> State:
        return State(*(stored(spark.read.parquet(os.path.join(folder, name)), f"state-{name}") for name in ("files", "rows")))


def current(column: str = "ext"):
    """The signature of the extractor that reads an extension now."""
    own = {ext: signature_of(e) for ext, e in REGISTRY.items()}
    return F.create_map(*(F.lit(x) for kv in own.items() for x in kv))[F.col(column)]


def partition(listing: DataFrame, state: State) -> DataFrame:
    """path, rel_path, ext, how: changed (added or modified), again (unchanged, but never read or by another extractor),
    kept, or deleted."""
    status = files.changes(listing, state.files)
    now = listing.where("not skipped").select("path", "rel_path", "ext")
    held = state.files.select("path", "signature")
    met = status.join(now, "path", "left").join(held, "path", "left")
    how = (F.when(F.col("status") == "deleted", "deleted").when(F.col("status").isin("added", "modified"), "changed")
           .when(F.col("signature").eqNullSafe(current()), "kept").otherwise("again"))
    return met.select("path", "rel_path", "ext", how.alias("how"))


def rescan(listing: DataFrame, state: State | None) -> tuple[State, dict[str, int]]:
    """The rows of all files of a listing, read anew only where needed, as the next state; and how many files were read,
    kept, changed, and read again for another extractor."""
    own = listing.where("not skipped")
    if state is None:
        todo, kept, n = own, None, {}
    else:
        parts = stored(partition(listing, state), "partition")
        n = {r["how"]: r["n"] for r in parts.groupBy("how").agg(F.count("*").alias("n")).collect()}
        todo = own.join(parts.where("how in ('changed', 'again')").select("path"), "path", "left_semi")
        kept = parts.where("how = 'kept'").select("path")
    fresh = stored(files.hashed(todo.select(*listing.columns)).withColumn("signature", current()).select(*(c.split()[0] for c in FILES.split(", "))), "state-files")
    rows = stored(raw_rows(todo).withColumn("rel_path", F.array_join("file", "/")), "state-rows")
    if kept is not None:
        old = state.files.join(kept, "path", "left_semi")
        # A file that was only touched keeps its rows, and gets its new time.
        old = old.drop("mtime_ns").join(own.select("path", "mtime_ns"), "path").select(*fresh.columns)
        fresh, rows = fresh.unionByName(old), rows.unionByName(state.rows.join(old.select("rel_path"), "rel_path", "left_semi"))
    stats = {"files_analyzed": fresh.count() - n.get("kept", 0), "files_cached": n.get("kept", 0), "files_changed": n.get("changed", 0), "files_invalidated": n.get("again", 0)}
    return State(fresh, rows), stats
