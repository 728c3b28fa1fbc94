"""URL block and allow rules, matched by a sorted sweep over reversed-host intervals.

A host is keyed by its labels in reverse (``www.example.com`` gives ``com.example.www.``), so a rule's host and all
its subdomains are one interval of keys, and two rules' intervals are nested or apart. Pages and rules in key order
are merged; a stack holds the rules whose interval is open. Of those, the longest one whose path begins the page's
path decides.

Small rule tables (their size is checked) go to every task, which sorts and sweeps its own pages: no shuffle. Larger
ones are range-partitioned with the pages; the few rules that are open where a partition begins (ancestors of its
first key) are looked up and given to it.

Null urls and urls without ``://`` have an empty host and path; no rule fits them and they get the default verdict.
Repeated pages and rules are judged one by one; of rules with the same host and path, block wins over allow.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm.common import stored, table


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = [
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
]
MAX_SENT_RULES = 50_000
SCHEMA = "page_id bigint, host string, path string, rule string, verdict string"


def host_key(host: str) -> str:
    """Labels in reverse, each ended by a dot, so that no label is a prefix of another one."""
    return "".join(f"{x}." for x in reversed(host.split("."))) if host else ""


def url_host(url: Column) -> Column:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Sweep:
    """One pass over rules and pages in key order (rules before the pages of their key); the stack holds the rules whose
    interval is open, and nothing else is kept."""

    def __init__(self):
        self.stack: list[tuple[str, Rule]] = []

    def _close(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def rule(self, key: str, rule: Rule) -> None:
        self._close(key)
        self.stack.append((key, rule))

    def page(self, key: str, path: str) -> Rule | None:
        if not key:
            return None
        self._close(key)
        fits = [r for _, r in self.stack if path.startswith(r.path)]
        return max(fits, key=lambda r: (len(r.text), len(r.host), r.verdict)) if fits else None


def sweep(keys: list[str], paths: list[str], rules: list[Rule]) -> list[Rule | None]:
    """The deciding rule of each page."""
    opening = sorted(((host_key(r.host), r) for r in rules), key=lambda x: x[0])
    out: list[Rule | None] = [None] * len(keys)
    own, k = Sweep(), 0
    for i in sorted(range(len(keys)), key=keys.__getitem__):
        while k < len(opening) and opening[k][0] <= keys[i]:
            own.rule(*opening[k])
            k += 1
        out[i] = own.page(keys[i], paths[i])
    return out


def _judged(pdf: pd.DataFrame, rules: list[Rule], default: str) -> pd.DataFrame:
    found = sweep(pdf["key"].tolist(), pdf["path"].tolist(), rules)
    return pd.DataFrame({
        "page_id": pdf["page_id"], "host": pdf["host"], "path": pdf["path"],
        "rule": pd.Series([r.text if r else None for r in found], index=pdf.index, dtype=object),
        "verdict": pd.Series([r.verdict if r else default for r in found], index=pdf.index, dtype=object),
    })


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", max_sent_rules: int = MAX_SENT_RULES) -> DataFrame:
    """pages (page_id, url) and rules (host, path, verdict) to page_id, host, path, rule, verdict."""
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    keyed = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"))
    key = lambda h: F.when(h == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(h, r"\.", -1)), "."), F.lit(".")))
    keyed = keyed.withColumn("key", key(F.col("host")))
    rules = rules.select("host", "path", "verdict").where("host is not null and path is not null and verdict is not null").distinct()
    some = [Rule(*r) for r in rules.limit(max_sent_rules + 1).collect()]
    if len(some) <= max_sent_rules:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                yield _judged(pdf, some, default)

        return keyed.mapInPandas(run, SCHEMA)
    return _ranged(keyed, rules.withColumn("key", key(F.col("host"))), default)


def _ranged(keyed: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """Pages and rules in ranges of keys, swept as a stream. A hot host's pages spread by path and id; rules open at a
    range's start are ancestors of its first key, and few."""
    both = keyed.select("key", "page_id", "host", "path", F.lit(None).cast("string").alias("verdict")).unionByName(
        rules.select("key", F.lit(None).cast("bigint").alias("page_id"), "host", "path", "verdict"))
    ranged = stored(both.repartitionByRange("key", "path", "page_id").withColumn("part", F.spark_partition_id()), "urls")
    ends = ranged.groupBy("part").agg(F.min("key").alias("low"))
    labels = F.split(F.col("low"), r"\.")
    ancestors = ends.select("part", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))).alias("key"))
    carried = ancestors.join(rules, "key").select("key", F.lit(None).cast("bigint").alias("page_id"), "host", "path", "verdict", "part")
    # A rule of the first key itself may lie in the range, too, and one key may span ranges: a rule is there once.
    own = ranged.where("verdict is not null").select(*carried.columns).unionByName(carried).distinct()
    every = ranged.where("verdict is null").select(*carried.columns).unionByName(own)

    types, names = [pa.int64(), *[pa.string()] * 4], ["page_id", "host", "path", "rule", "verdict"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = None, Sweep()
        for batch in batches:
            out = []
            for key, page, host, path, verdict, part in zip(*(c.to_pylist() for c in batch.columns)):
                if part != at:
                    at, now = part, Sweep()
                if verdict is not None:
                    now.rule(key, Rule(host, path, verdict))
                else:
                    r = now.page(key, path)
                    out.append((page, host, path, r.text if r else None, r.verdict if r else default))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return every.repartition("part").sortWithinPartitions("part", "key", F.col("verdict").isNull()).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


SQL = r"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (
  SELECT page_id, host, path, h || p AS rule, v,
    row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || p) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM f WHERE k = 1
"""
