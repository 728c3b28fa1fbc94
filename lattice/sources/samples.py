"""The first lines of what a node stands for, with secrets masked."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.functions.mask import mask_secrets

# Lines of a sample, and the largest file that is read for one.
LINES, MAX_BYTES = 6, 2 * 1024 * 1024


def snippet(lines: list[str], start: int, count: int) -> str:
    """count lines from start (from 1); from the first line that isn't blank, if the start is the first."""
    at = start - 1
    while start == 1 and at < len(lines) and not lines[at].strip():
        at += 1
    return "\n".join(lines[at : at + count]) if 0 <= at < len(lines) else ""


def with_samples(nodes: DataFrame, root: str, lines: int = LINES) -> DataFrame:
    """nodes with sample; null where a node's path (absolute or relative to root) is no file that can be read."""
    def run(parts):
        for pdf in parts:
            held, out = {}, []
            for path, line in zip(pdf["path"], pdf["line"]):
                file = os.path.join(root, path or "")
                if file not in held:
                    held = {file: None}  # nodes of one file come together
                    try:
                        if path and os.path.isfile(file) and os.path.getsize(file) <= MAX_BYTES:
                            with open(file, encoding="utf-8", errors="replace") as f:
                                held[file] = f.read().split("\n")
                    except OSError:
                        pass
                own = held[file]
                out.append(snippet(own, int(line) if line and line.isdigit() and int(line) > 0 else 1, lines or LINES) if own else "")
            yield pdf.assign(text=out)[["id", "text"]]

    asked = nodes.select("id", "path", F.col("properties")["line"].alias("line")).repartition("path").sortWithinPartitions("path")
    texts = asked.mapInPandas(run, "id string, text string").where("text <> ''").select("id", mask_secrets(F.col("text")).alias("sample"))
    return nodes.join(texts, "id", "left")
