"""Whether build files name folders that exist: replace directives of go.mod, baseUrl and paths of tsconfig.json."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Folders that the search doesn't enter, the files it reads, and the rules' names and severities.
CONFIGS = ["go.mod", "tsconfig.json"]
SEVERITIES = {"go_mod_replace_target_missing": "high", "tsconfig_baseurl_missing": "high", "tsconfig_path_target_missing": "medium"}
LOCAL = re.compile(r"(?:^|\s)=>\s*\"?(\.\.?/[^\s\"]*)")
CLAIMS = "config string, rule string, subject string, needs string, base string"


def replacements(text: str) -> Iterator[str]:
    """Local targets of replace directives, single or in a block."""
    block = False
    for line in text.splitlines():
        line = line.split("//", 1)[0].strip()
        if block and line == ")":
            block = False
        elif line == "replace (":
            block = True
        elif (block or line.startswith("replace ")) and (m := LOCAL.search(line)):
            yield m[1]


def claims(path: str, text: str) -> Iterator[tuple[str, str, str, str]]:
    """rule, subject, the folder or file that has to exist, and the baseUrl's folder that has to exist before ("" for none);
    paths relative to the root."""
    from lattice.sources.documents import plain_json

    folder = posixpath.dirname(path)
    at = lambda *parts: posixpath.normpath(posixpath.join(folder or ".", *parts))
    if posixpath.basename(path) == "go.mod":
        for target in replacements(text):
            yield "go_mod_replace_target_missing", f"{path}: {target}", at(target), ""
        return
    try:
        options = json.loads(plain_json(text)).get("compilerOptions") or {}
        base, paths = options.get("baseUrl") or "", options.get("paths") or {}
        pairs = [(alias, p) for alias, own in paths.items() for p in own if isinstance(p, str)]
    except (ValueError, AttributeError, TypeError):
        return  # whether a file can be parsed is the compiler's matter
    before = at(base) if base else ""
    if base:
        yield "tsconfig_baseurl_missing", f"{path}: baseUrl {base}", before, ""
    for alias, pattern in pairs:
        wanted = pattern.split("*", 1)[0].removesuffix("/") if "*" in pattern else pattern
        if wanted or "*" not in pattern:
            yield "tsconfig_path_target_missing", f"{path}: {alias} -> {pattern}", at(base, wanted), before


def read_claims(configs: DataFrame) -> DataFrame:
    """CLAIMS of configs (path, text), whose paths are relative to the root."""
    def run(parts):
        for pdf in parts:
            rows = [(p, *c) for p, t in zip(pdf["path"], pdf["text"]) for c in claims(p, t or "")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CLAIMS.split(", ")])

    return configs.select("path", "text").mapInPandas(run, CLAIMS)


def broken(configs: DataFrame, listing: DataFrame) -> DataFrame:
    """rule, severity, subject, detail: claims whose target is neither a file of the listing (path) nor a folder above one.
    A missing baseUrl stands for all paths that build on it. Targets outside of the root count as missing."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    there = listing.select(F.explode(F.concat(folders, F.array(F.lit(".")))).alias("needs")).distinct()
    found = read_claims(configs)
    lost = found.join(there, "needs", "left_anti")
    bases = lost.where("rule = 'tsconfig_baseurl_missing'").select("config", F.col("needs").alias("base"))
    kept = lost.join(bases, ["config", "base"], "left_anti")
    severity = F.create_map(*(F.lit(x) for kv in SEVERITIES.items() for x in kv))
    return kept.select("rule", severity[F.col("rule")].alias("severity"), "subject", F.format_string("%s doesn't exist below the root", "needs").alias("detail"))


def configs(files: DataFrame) -> DataFrame:
    """path and text of a listing's build files, read where they are."""
    def run(parts):
        for pdf in parts:
            texts = []
            for path in pdf["file"]:
                try:
                    with open(path, encoding="utf-8", errors="replace") as f:
                        texts.append(f.read())
                except OSError:
                    texts.append("")
            yield pdf.assign(text=texts)[["path", "text"]]

    return files.where(F.col("name").isin(CONFIGS)).select(F.col("rel_path").alias("path"), F.col("path").alias("file")).mapInPandas(run, "path string, text string")
