"""Form actions to the endpoints that serve them.

A form names its action as action:<page>?/<name>. With a page, the page's route decides. Without one the form lands on
whatever page renders its module: importers are followed upwards, by the names under which they pass on what they take,
until a module stands in a folder that declares the action.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.operators import resolve
from lattice.storage import stored

# How such a target is written, and the name that stands for all names.
PREFIX, SEPARATOR, ANY = "action:", "?/", "*"


def actions(edges: DataFrame) -> DataFrame:
    """source, target, page, name of the edges that name an action."""
    rest = F.expr(f"substring(target, {len(PREFIX) + 1})")
    name = F.when(rest.contains(SEPARATOR), F.regexp_replace(rest, r"^.*?\?/", "")).otherwise("")
    page = F.regexp_replace(rest, r"\?/.*$", "")
    return edges.where(F.col("target").startswith(PREFIX)).select("source", "target", page.alias("page"), name.alias("name")).distinct()


def serving(nodes: DataFrame) -> DataFrame:
    """id, name, route, folder of the endpoints that serve an action."""
    of = lambda key: F.col("properties")[key]
    return nodes.where("type = 'endpoint'").where(of("action") != "").select("id", of("action").alias("name"), of("route").alias("route"), F.regexp_replace(F.coalesce("path", F.lit("")), "/?[^/]*$", "").alias("folder"))


def on_named_pages(asked: DataFrame, served: DataFrame) -> DataFrame:
    """source, target, id. The action's name goes in front of both routes as one more literal segment."""
    marked = lambda route: F.concat(F.lit("/="), F.col("name"), F.lit("/"), F.coalesce(route, F.lit("")))
    own = asked.where("page <> ''")
    called = own.select("target", F.lit("").alias("method"), marked(F.col("page")).alias("route")).distinct()
    ends = served.select("id", F.lit("").alias("method"), marked(F.col("route")).alias("route"))
    return own.select("source", "target").join(resolve.match_routes(called, ends), "target").select("source", "target", "id")


def importers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """module, importer, and what the import takes: tracked (whether names are known), names, reexports (from, as)."""
    imports = edges.where("type = 'dependency'").select("source", "target", "properties")
    found = resolve.resolve_imports(imports.select("target").where("target like 'import:%'"), nodes)
    known = nodes.select(F.col("id").alias("module")).distinct()
    to = imports.join(found, "target", "left").select(F.coalesce("id", "target").alias("module"), F.col("source").alias("importer"), "properties").join(known, "module", "left_semi")
    listed = lambda key: F.filter(F.split(F.coalesce(F.col("properties")[key], F.lit("")), ","), lambda x: x != "")
    pairs = F.transform(F.filter(listed("reexports"), lambda x: x.contains("=")), lambda x: F.struct(F.substring_index(x, "=", 1).alias("from"), F.regexp_replace(x, "^[^=]*=", "").alias("as")))
    tracked = F.col("properties")["names"].isNotNull() | F.col("properties")["reexports"].isNotNull()
    return to.select("module", "importer", F.coalesce(tracked, F.lit(False)).alias("tracked"), listed("names").alias("names"), pairs.alias("reexports"))


def on_rendering_pages(asked: DataFrame, served: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """source, target, id. A row of the frontier is a module that exposes what a form is part of under one name."""
    own = asked.where("page = ''").select("source", "target", "name")
    beside = served.groupBy("folder", "name").agg(F.min("id").alias("id"))
    modules = nodes.select(F.col("id").alias("module"), F.coalesce("path", F.lit("")).alias("folder"))
    into = stored(importers(nodes, edges), "importers")
    clause = lambda x: (F.when(x["from"] != ANY, F.when((F.col("exposed") == ANY) | (F.col("exposed") == x["from"]), x["as"]))
                        .when(x["as"] != ANY, x["as"]).when(F.col("exposed") != "default", F.col("exposed")))
    whole = ~F.col("tracked") | F.exists("names", lambda n: (n == ANY) | (F.col("exposed") == ANY) | (n == F.col("exposed")))
    carried = F.when(whole, F.array(F.lit(ANY))).otherwise(F.filter(F.transform("reexports", clause), lambda x: x.isNotNull()))
    key = ["source", "target", "name", "module", "exposed"]
    front = stored(own.select("source", "target", "name", F.col("source").alias("module"), F.lit(ANY).alias("exposed")), "front")
    seen, found = front, None
    for k in itertools.count(1):  # ends, as there are finitely many modules and names
        placed = stored(front.join(modules, "module", "left").join(beside, ["folder", "name"], "left").select(*key, "id"), "placed")
        here = placed.where("id is not null").select("source", "target", "id").distinct()
        found = here if found is None else found.unionByName(here)
        on = placed.where("id is null").join(into, "module").select("source", "target", "name", F.col("importer").alias("module"), F.explode(carried).alias("exposed")).distinct()
        front = stored(on.join(seen, key, "left_anti"), "front")
        if front.isEmpty():
            return found.distinct()
        seen = seen.unionByName(front)
        if k % 20 == 0:
            seen, found = stored(seen, "seen"), stored(found.distinct(), "found")


def resolve_actions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """source, target (of the edge that names an action) and the ids that it reaches."""
    asked, served = stored(actions(edges), "actions"), stored(serving(nodes), "serving")
    return on_named_pages(asked, served).unionByName(on_rendering_pages(asked, served, nodes, edges))
