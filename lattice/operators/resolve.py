"""Symbolic edge targets to node ids: best-match joins rewritten as equi joins over exploded path tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tails(path: Column) -> Column:
    """a/b/c to [a/b/c, b/c, c]."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))


def resolve_imports(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """target (import:<key>) to id: the node whose path is the key or a tail of it; longest path, then smallest id."""
    keys = targets.select("target").distinct().withColumn("tail", F.explode(tails(F.expr("substring(target, 8)"))))
    known = nodes.where("path is not null and path <> ''").select(F.col("path").alias("tail"), "id")
    return keys.join(known, "tail").groupBy("target").agg(F.min_by("id", F.struct(-F.octet_length("tail"), F.col("id"))).alias("id"))


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def resolve_wikilinks(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """target (wikilink:<name>) to id: the node whose path without extension is the name, else ends in it; the nearest
    to the root, then the smallest id. Case doesn't count."""
    keys = targets.select("target").distinct().withColumn("tail", F.lower(F.expr("substring(target, 10)")))
    own = nodes.where("path is not null").select("id", F.lower(stem(F.col("path"))).alias("whole"))
    known = own.select("id", "whole", F.explode(tails(F.col("whole"))).alias("tail"))
    depth = F.size(F.split("whole", "/"))
    order = F.struct(F.when(F.col("whole") == F.col("tail"), 0).otherwise(depth), F.col("id"))
    return keys.join(known, "tail").groupBy("target").agg(F.min_by("id", order).alias("id"))


def segments(route: Column) -> Column:
    """Parts of a path without query or fragment."""
    return F.filter(F.split(F.regexp_replace(route, r"[?#].*$", ""), "/"), lambda s: s != "")


def is_parameter(s: Column) -> Column:
    return s.rlike(r"^[:\[{<*]")


def is_rest(s: Column) -> Column:
    return s.rlike(r"^(\*|\[\.\.\.|\{[^}]*\.\.\.\})")


def match_routes(called: DataFrame, endpoints: DataFrame) -> DataFrame:
    """called (target, method, route) to the endpoint (id, method, route) that fits best: most literal segments, the same
    method before any, then the smallest id. Routes without a rest segment meet by their number of segments and first
    literal or parameter; those with one, few, are compared by prefix."""
    c = called.select("target", "method", segments(F.col("route")).alias("parts")).distinct()
    e = endpoints.select("id", F.upper("method").alias("e_method"), segments(F.col("route")).alias("e_parts")).distinct()
    method = (F.col("e_method").isin("ANY", "") | F.col("e_method").isNull() | F.col("method").isNull() | (F.col("method") == "") | (F.upper("method") == F.col("e_method")))
    plain = ~F.exists("e_parts", is_rest)
    same = F.forall(F.zip_with("parts", "e_parts", lambda a, b: is_parameter(b) | (a == b)), lambda x: x)
    first = F.coalesce(F.get("e_parts", 0), F.lit(""))
    keyed_e = e.where(plain).withColumn("n", F.size("e_parts")).withColumn("first", F.when(is_parameter(first), F.lit(":")).otherwise(first))
    keyed_c = c.withColumn("n", F.size("parts")).withColumn("first", F.explode(F.array_distinct(F.array(F.lit(":"), F.coalesce(F.get("parts", 0), F.lit(""))))))
    found = keyed_c.join(keyed_e, ["n", "first"]).where(method & same)
    head = F.filter("e_parts", lambda s: ~is_rest(s))
    rest = e.where(~plain).withColumn("head", head).withColumn("n", F.size("head"))
    cut = c.withColumn("n", F.explode(F.sequence(F.lit(0), F.size("parts"))))
    fits = F.forall(F.zip_with(F.expr("slice(parts, 1, n)"), F.col("head"), lambda a, b: is_parameter(b) | (a == b)), lambda x: x)
    found = found.select("target", "id", "method", "e_method", "e_parts").unionByName(cut.join(rest, "n").where(method & fits).select("target", "id", "method", "e_method", "e_parts"))
    literal = F.size(F.filter("e_parts", lambda s: ~is_parameter(s) & ~is_rest(s)))
    score = 2 * literal + (F.upper("method") == F.col("e_method")).cast("int")
    return found.groupBy("target").agg(F.min_by("id", F.struct(-F.coalesce(score, 2 * literal), F.col("id"))).alias("id"))


def confidence(target: Column, c: Column) -> Column:
    """An import that had to be looked up is a little less certain."""
    return F.when(target.startswith("import:") & (c > 0), F.greatest(c - 0.1, F.lit(0.5))).otherwise(c)


def resolved_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """source, target, type, label, confidence, ord: form actions, routes, imports and links looked up, unknown targets
    and self loops gone, the first edge of each source, target and type."""
    symbolic = edges.select("target").distinct()
    routes = symbolic.where("target like 'route:%'").select(
        "target", F.upper(F.regexp_extract("target", r"^route:(\S+) ", 1)).alias("method"), F.regexp_extract("target", r"^route:\S+ (.*)$", 1).alias("route"))
    ends = nodes.where("type = 'endpoint'")
    if "properties" in nodes.columns:
        ends = ends.select("id", F.col("properties")["method"].alias("method"), F.col("properties")["route"].alias("route"))
        by_route = match_routes(routes, ends)
    else:
        by_route = routes.limit(0).select("target", F.lit("").alias("id"))
    found = (resolve_imports(symbolic.where("target like 'import:%'"), nodes)
             .unionByName(resolve_wikilinks(symbolic.where("target like 'wikilink:%'"), nodes)).unionByName(by_route))
    columns = ["source", F.coalesce("id", "target").alias("target"), "type", "label", confidence(F.col("target"), F.col("confidence")).alias("confidence"), "ord"]
    both = edges.join(found, "target", "left").select(*columns)
    if "properties" in nodes.columns and not symbolic.where("target like 'action:%'").isEmpty():
        from lattice.operators import actions

        both = both.unionByName(edges.join(actions.resolve_actions(nodes, edges), ["source", "target"]).select(*columns))
    known = both.where(F.col("source") != F.col("target")).join(nodes.select(F.col("id").alias("target")).distinct(), "target", "left_semi")
    best = known.groupBy("source", "target", "type").agg(F.min_by(F.struct("label", "confidence", "ord"), "ord").alias("r"))
    return best.select("source", "target", "type", "r.label", "r.confidence", "r.ord")


def target_binding(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """wanted (target) to id: the id itself, else the shortest id that ends in it or whose path does, then the smallest.
    Only ends of the lengths that are asked for are looked up."""
    ends = nodes.select("id", F.explode(F.array_distinct(F.array("id", F.coalesce("path", F.col("id"))))).alias("text"))
    lengths = wanted.where("target <> ''").agg(F.array_distinct(F.collect_set(F.length("target"))).alias("lengths"))
    every = ends.join(F.broadcast(lengths)).select("id", "text", F.explode("lengths").alias("n")).where("n <= length(text)")  # lengths is one row
    suffix = wanted.where("target <> ''").join(every.select("id", F.expr("right(text, n)").alias("target")), "target").select("target", "id", F.when(F.col("id") == F.col("target"), 0).otherwise(1).alias("how"))
    return suffix.groupBy("target").agg(F.min_by("id", F.struct("how", F.octet_length("id"), "id")).alias("id"))
