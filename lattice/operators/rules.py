"""Checks over nodes and edges, a baseline of known violations, recommendations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattice.functions.glob import glob_regex
from lattice.model import NOT_ORPHANS
from lattice.operators import kernels
from lattice.storage import stored


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes at no end of an edge; endpoints and infrastructure may be so."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    lonely = nodes.where(~F.col("type").isin(NOT_ORPHANS)).join(ends, "id", "left_anti")
    return lonely.select(F.lit("no_orphan_nodes").alias("rule"), F.lit("low").alias("severity"), F.col("id").alias("subject"), F.format_string('Node "%s" (%s) has no connections', "name", "type").alias("detail"))


def with_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the type and path of both ends."""
    end = lambda x: nodes.select(F.col("id").alias(x), F.col("type").alias(f"{x}_type"), F.col("path").alias(f"{x}_path"))
    return edges.join(end("source"), "source").join(end("target"), "target")


def layering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges from endpoints straight to databases, by the names of both."""
    name = lambda end: nodes.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name"))
    bad = with_ends(nodes, edges.drop("type")).where("source_type = 'endpoint' and target_type = 'database'").join(name("source"), "source").join(name("target"), "target")
    return bad.select(F.lit("no_endpoint_to_database").alias("rule"), F.lit("medium").alias("severity"), F.concat_ws(" -> ", "source_name", "target_name").alias("subject"),
                      F.format_string('Endpoint "%s" uses database "%s" itself, without a service between them', "source_name", "target_name").alias("detail"))


def cycles(edges: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """A violation for each strong component of two nodes or more over resolved dependency edges; where there is none,
    one if a raw edge begins and ends at the same node."""
    found = kernels.strong_components(edges.where("type = 'dependency'")).groupBy("scc").agg(F.array_sort(F.collect_list("id")).alias("ids")).where("size(ids) > 1")
    head = [F.lit("no_circular_dependencies").alias("rule"), F.lit("critical").alias("severity")]
    rows = stored(found.select(*head, F.format_string("cycle(%d nodes): %s", F.size("ids"), F.array_join("ids", ", ")).alias("subject"), F.concat(F.lit("These depend on each other: "), F.array_join("ids", ", ")).alias("detail"), "ids"), "cycles")
    if raw is None or not rows.isEmpty():
        return rows
    loops = raw.where("type = 'dependency' and source = target").agg(F.count("*").alias("n")).where("n > 0")
    return loops.select(*head, F.lit("cycle").alias("subject"), F.lit("A node depends on itself").alias("detail"), F.array().cast("array<string>").alias("ids"))


@dataclass(frozen=True)
class Matcher:
    type: str = ""
    path: str = ""

    def column(self, prefix: str = "") -> Column:
        """An empty matcher fits nothing; a path fits a node's path or its folder."""
        if not self.type and not self.path:
            return F.lit(False)
        fits = F.lit(True)
        if self.type:
            fits &= F.col(f"{prefix}type") == self.type
        if self.path:
            own = F.coalesce(F.col(f"{prefix}path"), F.lit(""))
            fits &= own.rlike(glob_regex(self.path)) | F.regexp_replace(own, "/[^/]*$", "").rlike(glob_regex(self.path))
        return fits


@dataclass(frozen=True)
class Rule:
    name: str
    type: str  # no_dependency or require_dependency
    source: Matcher
    target: Matcher
    severity: str = "medium"
    description: str = ""


def custom(nodes: DataFrame, edges: DataFrame, rule: Rule) -> DataFrame:
    both = with_ends(nodes, edges.drop("type"))
    if rule.type == "no_dependency":
        bad = both.where(rule.source.column("source_") & rule.target.column("target_")).select(F.concat_ws(" -> ", "source", "target").alias("subject")).distinct()
    elif rule.type == "require_dependency":
        good = both.where(rule.target.column("target_")).select(F.col("source").alias("id")).distinct()
        bad = nodes.where(rule.source.column()).join(good, "id", "left_anti").select(F.col("id").alias("subject"))
    else:
        raise ValueError(f"{rule.name}: unknown rule type {rule.type}")
    return bad.select(F.lit(rule.name).alias("rule"), F.lit(rule.severity).alias("severity"), "subject", F.lit(rule.description).alias("detail"))


def split_known(violations: DataFrame, known: DataFrame) -> DataFrame:
    """violations with is_new: whether rule and subject are not in the baseline."""
    base = known.select("rule", "subject").distinct().withColumn("k", F.lit(True))
    return violations.join(base, ["rule", "subject"], "left").withColumn("is_new", F.col("k").isNull()).drop("k")


def by_margin(value: Column, threshold: Column) -> Column:
    """How far a value is over its threshold, as a grade."""
    ratio = value / threshold
    return F.when(threshold <= 0, "medium").when(ratio >= 1.5, "high").when(ratio >= 1.2, "medium").otherwise("low")


def threshold_recommendations(metrics: DataFrame) -> DataFrame:
    """category, subject, priority, confidence from id, fan_in, coupling, instability."""
    avg = metrics.agg(F.avg("coupling").alias("avg"))
    m = metrics.join(F.broadcast(avg))  # one row
    rows = lambda df, category, priority, grade: df.select(F.lit(category).alias("category"), F.col("id").alias("subject"), priority.alias("priority"), grade.alias("confidence"))
    c, a = F.col("coupling"), F.col("avg")
    out = rows(m.where((a > 2) & (c > 2 * a)), "reduce_coupling", F.when(c > 3 * a, "high").otherwise("medium"), by_margin(c, 2 * a))
    out = out.unionByName(rows(m.where("fan_in > 3 and instability > 0.7"), "stabilize_core", F.lit("high"), by_margin(F.col("instability"), F.lit(0.7))))
    out = out.unionByName(rows(m.where(c > 8), "split_module", F.lit("medium"), by_margin(c, F.lit(8.0))))
    often = out.groupBy("subject").agg(F.count("*").alias("flags"))
    raised = out.join(often, "subject").join(metrics.select(F.col("id").alias("subject"), "fan_in"), "subject")
    return raised.select("category", "subject", F.when((F.col("priority") == "medium") & ((F.col("fan_in") > 3) | (F.col("flags") > 1)), "high").otherwise(F.col("priority")).alias("priority"), "confidence")


def structure_rules(nodes: DataFrame) -> DataFrame:
    """One row: whether one database is shared by many, and whether endpoints lack a cache."""
    n = lambda *kinds: F.count_if(F.col("type").isin(*kinds))
    return nodes.agg(((n("database") == 1) & (n("service", "module") > 2)).alias("split_database"), ((n("endpoint") > 5) & (n("cache") == 0)).alias("add_caching"))


GRADES = ["high", "medium", "low"]


def rank_of(grade: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, GRADES)), grade).cast("int")


def weakest(*grades: Column) -> Column:
    """What rests on several thresholds is as certain as the least certain of them."""
    return F.element_at(F.array(*map(F.lit, GRADES)), F.greatest(*map(rank_of, grades)))


RECOMMENDATION = ["category", "priority", "confidence", "subjects", "value", "threshold", "title", "action"]
# What each category asks for.
ACTIONS = {
    "break_cycle": "Let one side depend on an interface or an event instead",
    "reduce_coupling": "Move shared parts out or merge what always changes together",
    "stabilize_core": "Turn its dependencies around, so that the core depends on less",
    "add_layer": "Put a service or repository between the two",
    "split_database": "Give each service a database or at least a schema of its own",
    "add_caching": "Find the endpoints that mostly read and put a cache in front of them",
    "split_module": "Cut it into parts with one task each",
    "remove_orphan": "Remove it, or connect it to what should use it",
}


def recommendations(nodes: DataFrame, edges: DataFrame, metrics: DataFrame, found: DataFrame) -> DataFrame:
    """RECOMMENDATION's columns and rank (from 1): what eight rules say, by priority, then by the number of subjects.

    edges are resolved, metrics has id, fan_in, fan_out, coupling and instability, found the violations (rule, subject,
    and ids for cycles). A medium priority is raised where a subject has a fan-in over 3 or is named by two rules."""
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))

    def rows(df: DataFrame, category: str, priority: Column, grade: Column, subjects: Column, value: Column, threshold: float | Column, title: Column) -> DataFrame:
        threshold = threshold if isinstance(threshold, Column) else F.lit(threshold)
        columns = [F.lit(category), priority, grade, subjects, value.cast("double"), threshold.cast("double"), title, F.lit(ACTIONS[category])]
        return df.select(*(c.alias(n) for c, n in zip(columns, RECOMMENDATION)))

    one, high, medium, low = lambda c: F.array(F.col(c)), F.lit("high"), F.lit("medium"), F.lit("low")
    rule = lambda name: found.where(F.col("rule") == name)
    kept = lambda kind: F.count_if(F.col("type") == kind)
    own = metrics.join(F.broadcast(metrics.agg(F.avg("coupling").alias("avg"))))  # one row
    c, a = F.col("coupling"), F.col("avg")
    shape = nodes.agg(kept("database").alias("db"), F.min(F.when(F.col("type") == "database", F.col("id"))).alias("db_id"), F.count_if(F.col("type").isin("service", "module")).alias("parts"), kept("endpoint").alias("ends"), kept("cache").alias("caches"))
    parts = [
        rows(rule("no_circular_dependencies").where("size(ids) > 1"), "break_cycle", high, high, F.col("ids"), F.size("ids"), 1, text("Break the cycle of ", F.size("ids").cast("string"), " components")),
        rows(own.where((a > 2) & (c > 2 * a)), "reduce_coupling", F.when(c > 3 * a, "high").otherwise("medium"), by_margin(c, 2 * a), one("id"), c, 2 * a, text("Loosen the coupling of ", F.col("id"))),
        rows(own.where("fan_in > 3 and instability > 0.7"), "stabilize_core", high, weakest(by_margin(F.col("fan_in"), F.lit(3.0)), by_margin(F.col("instability"), F.lit(0.7))), one("id"), F.col("instability"), 0.7, text("Steady ", F.col("id"), ", on which many depend")),
        rows(rule("no_endpoint_to_database"), "add_layer", medium, high, one("subject"), F.lit(1), 1, text("Put a layer into ", F.col("subject"))),
        rows(shape.where("db = 1 and parts > 2"), "split_database", medium, by_margin(F.col("parts"), F.lit(2.0)), one("db_id"), F.col("parts"), 2, text("Consider to split the shared database ", F.col("db_id"))),
        rows(shape.where("ends > 5 and caches = 0"), "add_caching", low, by_margin(F.col("ends"), F.lit(5.0)), F.array(F.lit("infrastructure")), F.col("ends"), 5, text("Add a cache for ", F.col("ends").cast("string"), " endpoints")),
        rows(own.where(c > 8), "split_module", medium, by_margin(c, F.lit(8.0)), one("id"), c, 8, text("Split ", F.col("id"))),
        rows(rule("no_orphan_nodes"), "remove_orphan", low, high, one("subject"), F.lit(0), 1, text("Remove or connect ", F.col("subject"))),
    ]
    every = parts[0].withColumn("place", F.lit(0))
    for k, more in enumerate(parts[1:], 1):
        every = every.unionByName(more.withColumn("place", F.lit(k)))
    every = stored(every.withColumn("key", F.xxhash64("category", "subjects")), "recommendations")
    flags = every.select("key", "priority", F.explode("subjects").alias("subject"))
    often = flags.groupBy("subject").agg(F.count("*").alias("flags"))
    degree = edges.where("type = 'dependency'").groupBy(F.col("target").alias("subject")).agg(F.count("*").alias("fan_in"))
    raised = flags.where("priority = 'medium'").join(often, "subject").join(degree, "subject", "left").where("flags > 1 or fan_in > 3").select("key").distinct().withColumn("raised", F.lit(True))
    done = every.join(raised, "key", "left").withColumn("priority", F.when(F.col("raised"), "high").otherwise(F.col("priority")))
    order = Window.orderBy(rank_of(F.col("priority")), F.desc(F.size("subjects")), "place", "subjects")  # a report that is read by people
    return done.withColumn("rank", F.row_number().over(order)).select("rank", *RECOMMENDATION)


def of_category(found: DataFrame, category: str = "") -> DataFrame:
    return found.where(F.col("category") == category) if category else found


def disconnected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes at no end of a raw edge; only endpoints may be so."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return nodes.where("type <> 'endpoint'").join(ends, "id", "left_anti")
