"""The engine's queries over the parquet tables: a property graph derived from them, and their SQL.

Regions are databases, nations services, suppliers modules, parts packages and customers endpoints. Suppliers import
their nation's path by a symbolic target; parts depend on the suppliers that any lineitem names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.functions.mask import mask_secrets, masked_sql
from lattice.model import Graph
from lattice.operators import boundaries, dependencies, drift, environment, kernels, metrics, notes, resolve, rules
from lattice.storage import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graph(spark: SparkSession, sf_dir: str, supply_of: str = "true") -> Graph:
    """supply_of says which lineitems make a part depend on a supplier."""
    t = lambda name: table(spark, sf_dir, name)
    region, nation = t("region").select("r_regionkey", "r_name"), t("nation").select("n_nationkey", "n_name", "n_regionkey")
    supplier = t("supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("n_nationkey")).join(nation, "n_nationkey")
    customer = t("customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey")).join(nation, "n_nationkey")
    node = lambda df, id_, name, kind, path: df.select(F.expr(id_).alias("id"), F.expr(name).alias("name"), F.lit(kind).alias("type"), F.expr(path).alias("path"))
    place = "concat('region/', n_regionkey, '/nation/', n_nationkey"
    nodes = (node(region, "concat('db:region/', r_regionkey)", "r_name", "database", "cast(null as string)")
             .unionByName(node(nation, "concat('svc:nation/', n_nationkey)", "n_name", "service", f"{place})"))
             .unionByName(node(supplier, "concat('mod:supplier/', s_suppkey)", "s_name", "module", f"{place}, '/supplier/', s_suppkey)"))
             .unionByName(node(t("part").select("p_partkey", "p_name", "p_brand", "p_type"), "concat('pkg:part/', p_partkey)", "p_name", "package", "concat('parts/', p_brand, '/', p_type, '/', p_partkey)"))
             .unionByName(node(customer, "concat('endpoint:customer/', c_custkey)", "c_name", "endpoint", f"{place}, '/customer/', c_custkey)")))
    edge = lambda df, source, target, kind, c: df.select(F.expr(source).alias("source"), F.expr(target).alias("target"), F.lit(kind).alias("type"), F.lit("").alias("label"), F.lit(c).alias("confidence"), F.lit(0).alias("ord"))
    supply = t("lineitem").where(supply_of).select("l_partkey", "l_suppkey").distinct()
    edges = (edge(nation, "concat('svc:nation/', n_nationkey)", "concat('db:region/', n_regionkey)", "read_write", 0.8)
             .unionByName(edge(supplier, "concat('mod:supplier/', s_suppkey)", f"concat('import:acme/', {place}))", "dependency", 0.9))
             .unionByName(edge(customer, "concat('endpoint:customer/', c_custkey)", "concat('svc:nation/', n_nationkey)", "dependency", 0.85))
             .unionByName(edge(supply, "concat('pkg:part/', l_partkey)", "concat('mod:supplier/', l_suppkey)", "dependency", 0.9)))
    return Graph(nodes, edges)


def resolved(spark: SparkSession, sf_dir: str, supply_of: str = "true") -> Graph:
    """Resolved once: what a query asks of it several times is read from a table."""
    g = graph(spark, sf_dir, supply_of)
    return Graph(g.nodes, stored(resolve.resolved_edges(g.nodes, g.edges), "resolved"))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each event type to the type that follows for the same user."""
    from pyspark.sql import Window

    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf_dir, "events").select("event_type", after.alias("next")).where("next is not null and next <> event_type")
    return e.select(F.concat(F.lit("q:"), "event_type").alias("source"), F.concat(F.lit("q:"), "next").alias("target"), F.lit("dependency").alias("type")).distinct()


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one day of a year are a ring in the order of their keys, with chords of two steps."""
    from pyspark.sql import Window

    own = Window.partitionBy("day").orderBy("o_orderkey")
    n = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderkey")
    n = n.withColumn("k", F.row_number().over(own)).withColumn("n", F.count("*").over(Window.partitionBy("day")))
    to = n.select("day", F.col("k").alias("j"), F.col("o_orderkey").alias("other"))
    jump = F.explode(F.array(F.lit(1), F.lit(2)))
    on = n.where("n > 1").withColumn("jump", jump).where("jump = 1 or k % 3 = 0").withColumn("j", (F.col("k") - 1 + F.col("jump")) % F.col("n") + 1).where("j <> k").join(to, ["day", "j"])
    node = lambda c: F.concat(F.lit("o:"), c)
    return on.select(node("o_orderkey").alias("source"), node("other").alias("target"), F.lit("dependency").alias("type")).distinct()


def project(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A project's listing (rel_path, name) and its build files (path, text), from suppliers: a folder each."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    folder = F.concat(F.lit("n"), "s_nationkey", F.lit("/s"), "s_suppkey")
    k = F.col("s_suppkey")
    name = F.element_at(F.array(*map(F.lit, ["go.mod", "Dockerfile", "pyproject.toml", "Cargo.toml", "pom.xml", "build.gradle", "main.py", "tsconfig.json"])), (k % 8 + 1).cast("int"))
    more = F.element_at(F.array(*map(F.lit, ["Dockerfile", "setup.py", "x.txt"])), (k % 3 + 1).cast("int"))
    files = s.select(F.explode(F.array_distinct(F.array(F.concat(folder, F.lit("/"), name), F.concat(folder, F.lit("/"), more), F.concat(folder, F.lit("/cmd/c"), k % 2, F.lit("/main.go"))))).alias("rel_path"))
    listing = files.select("rel_path", F.substring_index("rel_path", "/", -1).alias("name"))
    mods = s.where(k % 8 == 0).select(F.concat(folder, F.lit("/go.mod")).alias("path"), F.concat(F.lit("module x\nreplace (\n a => ../s"), k + 1, F.lit(" // next\n b v1 => ./cmd/c0\n)\nreplace c => ../../n0\nreplace d => other v1\n")).alias("text"))
    base = F.when(k % 16 == 7, "cmd").otherwise("gone")
    confs = s.where(k % 8 == 7).select(F.concat(folder, F.lit("/tsconfig.json")).alias("path"), F.concat(F.lit('{"compilerOptions": { // base\n"baseUrl": "'), base, F.lit('", "paths": {"@/*": ["c0/*", "c1/*"], "all": ["*"],}}}')).alias("text"))
    return listing, mods.unionByName(confs)


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("pkg:part/"), "l_partkey").alias("source"), F.concat(F.lit("mod:supplier/"), "l_suppkey").alias("target"), F.lit("dependency").alias("type"), "l_shipdate")


G = """
WITH RECURSIVE cn AS (SELECT c_custkey, c_name, n_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
sn AS (SELECT s_suppkey, s_name, n_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
nodes AS (
  SELECT 'db:region/' || r_regionkey AS id, r_name AS name, 'database' AS type, NULL::VARCHAR AS path FROM region
  UNION ALL SELECT 'svc:nation/' || n_nationkey, n_name, 'service', 'region/' || n_regionkey || '/nation/' || n_nationkey FROM nation
  UNION ALL SELECT 'mod:supplier/' || s_suppkey, s_name, 'module', 'region/' || n_regionkey || '/nation/' || n_nationkey || '/supplier/' || s_suppkey FROM sn
  UNION ALL SELECT 'pkg:part/' || p_partkey, p_name, 'package', 'parts/' || p_brand || '/' || p_type || '/' || p_partkey FROM part
  UNION ALL SELECT 'endpoint:customer/' || c_custkey, c_name, 'endpoint', 'region/' || n_regionkey || '/nation/' || n_nationkey || '/customer/' || c_custkey FROM cn),
raw AS (
  SELECT 'svc:nation/' || n_nationkey AS source, 'db:region/' || n_regionkey AS target, 'read_write' AS type, 0.8::DOUBLE AS confidence FROM nation
  UNION ALL SELECT 'mod:supplier/' || s_suppkey, 'import:acme/region/' || n_regionkey || '/nation/' || n_nationkey, 'dependency', 0.9 FROM sn
  UNION ALL SELECT 'endpoint:customer/' || c_custkey, 'svc:nation/' || n_nationkey, 'dependency', 0.85 FROM cn
  UNION ALL SELECT DISTINCT 'pkg:part/' || l_partkey, 'mod:supplier/' || l_suppkey, 'dependency', 0.9 FROM lineitem),
tail AS (SELECT DISTINCT target, array_to_string(list_slice(string_split(target[8:], '/'), k, len(string_split(target[8:], '/'))), '/') AS t
  FROM (SELECT target, unnest(range(1, len(string_split(target[8:], '/')) + 1)) AS k FROM (SELECT DISTINCT target FROM raw WHERE target LIKE 'import:%'))),
found AS (SELECT target, arg_min(id, (-strlen(t), id)) AS id FROM tail JOIN nodes ON path = t GROUP BY target),
edges AS (SELECT DISTINCT source, coalesce(id, target) AS target, type,
    CASE WHEN target LIKE 'import:%' AND confidence > 0 THEN greatest(confidence - 0.1, 0.5) ELSE confidence END AS confidence
  FROM raw LEFT JOIN found USING (target) WHERE coalesce(id, target) IN (SELECT id FROM nodes) AND source <> coalesce(id, target)),
dep AS (SELECT source, target FROM edges WHERE type = 'dependency'),
fio AS (SELECT id, coalesce(o, 0)::BIGINT AS fan_out, coalesce(i, 0)::BIGINT AS fan_in,
    CASE WHEN coalesce(o, 0) + coalesce(i, 0) > 0 THEN coalesce(o, 0) / (coalesce(o, 0) + coalesce(i, 0)) ELSE 0.0 END::DOUBLE AS instability
  FROM nodes LEFT JOIN (SELECT source AS id, count(*) AS o FROM dep GROUP BY 1) USING (id) LEFT JOIN (SELECT target AS id, count(*) AS i FROM dep GROUP BY 1) USING (id)
  WHERE type NOT IN ('database', 'queue', 'cache', 'external_api')),
tr AS (SELECT DISTINCT 'q:' || event_type AS source, 'q:' || nxt AS target FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt <> event_type),
blast AS (SELECT 'db:region/0' AS id, 0 AS depth UNION SELECT source, depth + 1 FROM blast JOIN edges ON target = id WHERE depth < 50),
down AS (SELECT source AS a, target AS b FROM tr UNION SELECT a, target FROM down JOIN tr ON source = b),
und AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges),
long AS (SELECT source AS id, target AS tip, 1 AS depth FROM dep UNION SELECT id, target, depth + 1 FROM long JOIN dep ON source = tip)
"""

#: Questions about missing links are asked of the graph of bulk orders: any order at all reaches nearly every part.
BULK = "l_quantity >= 49"
OLD_NEW = "l_shipdate < timestamp '1998-01-01'"


def _bound(spark: SparkSession, sf_dir: str) -> tuple[Graph, DataFrame]:
    """Every region is a boundary, by path."""
    g = resolved(spark, sf_dir)
    b = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.concat(F.lit("region/"), "r_regionkey").alias("path"))
    return g, drift.boundary_of(g.nodes, b.unionByName(spark.createDataFrame([("root", ".")], "name string, path string")))


def q_resolve_edges(s, d):
    return resolved(s, d).edges.select("source", "target", "type", F.round("confidence", 6).alias("confidence"))


def q_node_type_counts(s, d):
    return metrics.counts_by_type(graph(s, d).nodes)


def q_edge_type_counts(s, d):
    return metrics.counts_by_type(resolved(s, d).edges)


def q_fan_in_out(s, d):
    g = resolved(s, d)
    return metrics.fan_in_out(g.nodes, g.edges).select("id", "fan_out", "fan_in", F.round("instability", 6).alias("instability"))


def q_metrics_summary(s, d):
    g = resolved(s, d)
    return metrics.metrics_summary(g.nodes, g.edges).select(F.round("avg_coupling", 6).alias("avg_coupling"), F.round("avg_instability", 6).alias("avg_instability"))


def q_blast_radius(s, d):
    return kernels.blast_radius(resolved(s, d).edges, "db:region/0").select("id", "depth")


def q_blast_radius_summary(s, d):
    return kernels.blast_radius(resolved(s, d).edges, "db:region/0").agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count("*").alias("total"))


def q_dataflow_traces(s, d):
    g = resolved(s, d)
    return kernels.traces(g.nodes, g.edges).select("entry", F.array_join("chain", " > ").alias("chain"), "terminal", F.round("confidence", 6).alias("confidence"))


def q_scc_members(s, d):
    return kernels.strong_components(transitions(s, d)).select("id", F.col("scc").alias("scc_min_id"))


def q_has_cycle(s, d):
    return kernels.has_cycle(transitions(s, d))


def q_max_depth(s, d):
    return kernels.depths(resolved(s, d).edges.where("type = 'dependency'")).agg(F.max("depth").cast("bigint").alias("max_depth"))


def q_components(s, d):
    g = resolved(s, d)
    return kernels.components(g.nodes, g.edges).select("id", F.col("root").alias("component"))


def q_transitive_reduce(s, d):
    way = s.createDataFrame([("pkg:part/0", "svc:nation/0", "dependency")], "source string, target string, type string")
    return kernels.transitive_reduction(resolved(s, d).edges.where("type = 'dependency'").select("source", "target", "type").unionByName(way))


def q_transitive_reduce_cycles(s, d):
    """Of a graph full of cycles: the transitions, and each month's shipping modes in a ring with some chords."""
    return kernels.transitive_reduction(transitions(s, d).unionByName(rings(s, d)))


def q_ranked_components(s, d):
    """Of the rings of orders: each day is a component."""
    edges = rings(s, d)
    nodes = table(s, d, "orders").select(F.concat(F.lit("o:"), "o_orderkey").alias("id"))
    return kernels.ranked_components(nodes, edges).select("id", "size", F.col("rank").cast("bigint").alias("rank"))


def q_k_core(s, d):
    g = resolved(s, d)
    return kernels.k_core(g.nodes, g.edges, 2)


def q_prune_super_nodes(s, d):
    g = resolved(s, d)
    return metrics.prune_super_nodes(g.nodes, g.edges, 0.015)[2].select("id", F.round("share", 6).alias("share"))


def q_group_by_folder(s, d):
    g = resolved(s, d)
    return metrics.group_by_folder(g.nodes, g.edges, 2).select("source", "target", "type", "n", "label")


def q_view_filter(s, d):
    g = resolved(s, d)
    return metrics.view(g.nodes, g.edges, "container")[1].select("source", "target", "type")


def q_orphans(s, d):
    g = graph(s, d, BULK)
    return rules.orphans(g.nodes, g.edges).select(F.col("subject").alias("id"), "rule", "severity")


def q_layering_violations(s, d):
    g = resolved(s, d)
    short = g.edges.where("source like 'endpoint:%'").select("source", F.col("target").alias("via")).join(g.edges.select(F.col("source").alias("via"), "target"), "via").select("source", "target", F.lit("dependency").alias("type"))
    return rules.layering(g.nodes, short.distinct()).select("subject", "rule", "severity")


def q_no_dependency(s, d):
    g = resolved(s, d)
    rule = rules.Rule("parts-off-region-3", "no_dependency", rules.Matcher("package", "parts/**"), rules.Matcher("module", "region/3/**"))
    return rules.custom(g.nodes, g.edges, rule).select("rule", "subject")


def q_require_dependency(s, d):
    g = resolved(s, d, BULK)
    rule = rules.Rule("parts-need-supplier", "require_dependency", rules.Matcher("package"), rules.Matcher("module"))
    return rules.custom(g.nodes, g.edges, rule).select("rule", "subject")


def q_baseline_split(s, d):
    g = graph(s, d, BULK)
    found = rules.orphans(g.nodes, g.edges)
    known = g.nodes.where("type = 'package' and length(name) % 2 = 0").select(F.lit("no_orphan_nodes").alias("rule"), F.col("id").alias("subject"))
    return rules.split_known(found, known).select("rule", "subject", "is_new")


def q_graph_diff(s, d):
    e = dated(s, d)
    return drift.edge_changes(e.where(OLD_NEW), e.where(f"not ({OLD_NEW})"))


def q_node_diff(s, d):
    n = graph(s, d).nodes.where("type in ('package', 'module')")
    old = n.where("length(id) % 5 <> 0")
    new = n.where("length(id) % 4 <> 0").withColumn("name", F.when(F.col("id").endswith("7"), "renamed").otherwise(F.col("name")))
    return drift.node_changes(old, new)


def q_history_lag(s, d):
    return drift.history(dated(s, d), F.date_format("l_shipdate", "yyyy-MM"))


def q_cross_boundary(s, d):
    g, owner = _bound(s, d)
    return drift.cross_boundary(g.edges, owner)


def q_shared_database(s, d):
    g, owner = _bound(s, d)
    return drift.shared_databases(g.nodes, g.edges.where("type = 'read_write'").unionByName(g.edges.where("source like 'pkg:%'").withColumn("target", F.lit("db:region/1"))), owner)


def q_boundaries(s, d):
    found = boundaries.build(project(s, d)[0], "shop")
    return found.select("path", "name", "type", F.array_join("markers", ",").alias("markers"))


def q_deployable_units(s, d):
    return boundaries.deployable(boundaries.build(project(s, d)[0], "shop"))


def q_environment(s, d):
    listing, configs = project(s, d)
    return environment.broken(configs, listing.withColumnRenamed("rel_path", "path")).select("rule", "severity", "subject")


def q_dependency_kinds(s, d):
    g = graph(s, d)
    host = F.when(F.length("target") % 3 == 0, F.concat(F.lit("example.com/"), "target")).otherwise(F.when(F.length("target") % 3 == 1, F.concat(F.lit("golang.org/x/"), "target")).otherwise(F.col("target")))
    to = F.when(F.col("source").endswith("7"), F.lit("db:region/1")).otherwise(F.col("target"))
    return dependencies.kinds(g.nodes, g.edges.where("type = 'dependency'").withColumn("label", host).withColumn("target", to)).select("label", "kind")


def q_data_paths(s, d):
    return dependencies.data_paths(graph(s, d).edges).select("path")


def q_note_links(s, d):
    """Notes that quote the folders of parts, with line numbers, file names and slashes behind them."""
    p = table(s, d, "part").select("p_partkey", "p_brand", "p_type")
    k, path = F.col("p_partkey"), F.concat("p_brand", F.lit("/"), "p_type", F.lit("/"), "p_partkey")
    span = F.when(k % 5 == 0, F.concat(path, F.lit("/"))).when(k % 5 == 1, F.concat("p_type", F.lit("/"), k, F.lit("/main.go:12-14"))).when(k % 5 == 2, F.concat(F.lit("parts/"), path, F.lit(":7"))).when(k % 5 == 3, k.cast("string")).otherwise(F.concat(F.lit("/"), path))
    clean = F.translate(span, " ", "_")
    texts = p.select(F.concat(F.lit("note:"), k % 50).alias("id"), F.concat(F.lit("see `"), clean, F.lit("` and `this one`\n")).alias("t")).groupBy("id").agg(F.array_join(F.collect_list("t"), "").alias("text"))
    packages = graph(s, d).nodes.where("type = 'package'").select("id", F.translate("path", " ", "_").alias("path"))
    return notes.link(texts, packages).select("source", "target", "label", "confidence")


def q_folder_nodes(s, d):
    return metrics.folder_nodes(graph(s, d).nodes, 2).select("id", "name", "type", F.coalesce("members", F.lit(0)).alias("members"))


def q_disconnected(s, d):
    g = graph(s, d, BULK)
    return rules.disconnected(g.nodes, g.edges).select("id")


def _mixed(s, d) -> tuple[Graph, DataFrame]:
    """The bench graph with the transitions as modules, and endpoints of every tenth customer that use the region's database."""
    g, t = resolved(s, d, BULK), transitions(s, d)
    steps = t.select(F.explode(F.array("source", "target")).alias("id")).distinct().select("id", F.col("id").alias("name"), F.lit("module").alias("type"), F.lit(None).cast("string").alias("path"))
    short = g.nodes.where("type = 'endpoint' and id like '%0'").select(F.col("id").alias("source"), F.lit("db:region/1").alias("target"), F.lit("read_write").alias("type"), F.lit("").alias("label"), F.lit(0.5).alias("confidence"), F.lit(0).alias("ord"))
    edges = g.edges.unionByName(t.select("source", "target", "type", F.lit("").alias("label"), F.lit(0.9).alias("confidence"), F.lit(0).alias("ord"))).unionByName(short)
    raw = graph(s, d, BULK).edges.unionByName(edges.where("source like 'q:%'")).unionByName(short)
    return Graph(g.nodes.unionByName(steps), stored(edges, "mixed")), raw


def q_cycles(s, d):
    g, raw = _mixed(s, d)
    return rules.cycles(g.edges, raw).select("rule", "severity", "subject")


def q_recommend(s, d):
    g, raw = _mixed(s, d)
    found = rules.cycles(g.edges, raw)
    for more in (rules.orphans(g.nodes, raw), rules.layering(g.nodes, raw)):
        found = found.unionByName(more.withColumn("ids", F.array().cast("array<string>")).select(*found.columns))
    m = stored(metrics.fan_in_out(g.nodes, g.edges), "metrics")
    return rules.recommendations(g.nodes, g.edges, m, found).select("category", F.array_join("subjects", ", ").alias("subjects"), "priority", "confidence", F.round("value", 6).alias("value"), F.round("threshold", 6).alias("threshold"))


def q_target_binding(s, d):
    wanted = s.createDataFrame([("nation/3",), ("svc:nation/4",), ("supplier/5",), ("plier/5",), ("5",), ("nothing",), ("",)], "target string")
    return resolve.target_binding(wanted, graph(s, d).nodes)


def q_wikilink_resolve(s, d):
    n = graph(s, d).nodes
    wanted = n.where("type in ('service', 'module')").select(F.concat(F.lit("wikilink:"), F.regexp_extract("path", "([^/]+/[^/]+)$", 1)).alias("target"))
    return resolve.resolve_wikilinks(wanted, n).select(F.col("target").alias("link"), "id")


def q_route_match(s, d):
    url = table(s, d, "pages").select(F.regexp_extract("url", r"^[^:]+://[^/]+(/[^?#]*)", 1).alias("route")).distinct()
    first = F.regexp_extract("route", r"^/([^/]+)", 1)
    ends = url.select(first.alias("lang")).distinct().where("lang <> ''").select(F.concat(F.lit("endpoint:"), "lang").alias("id"), F.lit("GET").alias("method"), F.concat(F.lit("/"), "lang", F.lit("/:id")).alias("route"))
    return resolve.match_routes(url.select(F.col("route").alias("target"), F.lit("GET").alias("method"), "route"), ends).select(F.col("target").alias("called"), F.col("id").alias("endpoint"))


def q_url_host(s, d):
    return table(s, d, "pages").select("page_id", F.lower(F.regexp_extract("url", r"^(?:https?:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)).alias("host"))


def q_mask_secrets(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(mask_secrets(F.col("text"))).alias("masked_md5"))


def q_structure_rules(s, d):
    return rules.structure_rules(graph(s, d).nodes)


def q_recommend_thresholds(s, d):
    g = resolved(s, d)
    m = stored(metrics.fan_in_out(g.nodes, g.edges), "metrics")
    return rules.threshold_recommendations(m)


def q_changes_detect(s, d):
    docs = table(s, d, "documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("hash"))
    path = lambda df: df.select(F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 2)).alias("path"), "hash").groupBy("path").agg(F.min("hash").alias("hash"))
    return drift.listing_changes(path(docs.where("doc_id % 2 = 0")), path(docs.where("doc_id % 2 = 1")))


def q_file_hash(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


QUERIES = {name[2:]: f for name, f in dict(globals()).items() if name.startswith("q_")}

_DATED = "x AS (SELECT DISTINCT 'pkg:part/' || l_partkey AS source, 'mod:supplier/' || l_suppkey AS target, l_shipdate FROM lineitem)"
_OWNER = """, ob AS (SELECT id, arg_max(b, l) AS boundary FROM (
  SELECT id, 'root' AS b, 0 AS l FROM nodes WHERE path IS NOT NULL UNION ALL SELECT id, r_name, 1 FROM nodes JOIN region ON path = 'region/' || r_regionkey OR starts_with(path, 'region/' || r_regionkey || '/')) GROUP BY id)"""
_FOLDER = "CASE WHEN type IN ('module', 'package', 'endpoint') THEN 'dir:' || array_to_string(list_slice(string_split(CASE WHEN type = 'endpoint' THEN regexp_replace(path, '/?[^/]*$', '') ELSE path END, '/'), 1, 2), '/') ELSE id END"

_ORDERS = """SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey, row_number() OVER w AS k, count(*) OVER (PARTITION BY strftime(o_orderdate, '%Y-%m-%d')) AS n
FROM orders WINDOW w AS (PARTITION BY strftime(o_orderdate, '%Y-%m-%d') ORDER BY o_orderkey)"""
_RING = """SELECT DISTINCT 'o:' || a.o_orderkey AS source, 'o:' || b.o_orderkey AS target FROM (SELECT *, unnest([1, 2]) AS jump FROM ord WHERE n > 1) a JOIN ord b ON a.day = b.day AND b.k = (a.k - 1 + jump) % a.n + 1
WHERE (jump = 1 OR a.k % 3 = 0) AND b.k <> a.k"""
_FILES = """WITH s AS (SELECT s_suppkey AS k, 'n' || s_nationkey || '/s' || s_suppkey AS f FROM supplier),
files AS (SELECT f || '/' || (['go.mod', 'Dockerfile', 'pyproject.toml', 'Cargo.toml', 'pom.xml', 'build.gradle', 'main.py', 'tsconfig.json'])[k % 8 + 1] AS p FROM s
  UNION SELECT f || '/' || (['Dockerfile', 'setup.py', 'x.txt'])[k % 3 + 1] FROM s UNION SELECT f || '/cmd/c' || (k % 2) || '/main.go' FROM s),
mark AS (SELECT regexp_replace(p, '/[^/]*$', '') AS path, regexp_extract(p, '([^/]*)$', 1) AS m FROM files UNION SELECT regexp_replace(p, '/[^/]*$', ''), 'cmd/ directory' FROM files WHERE p LIKE '%/cmd/%'),
staged AS (SELECT path, m, CASE m WHEN 'go.mod' THEN 0 WHEN 'cmd/ directory' THEN 1 WHEN 'Dockerfile' THEN 2 WHEN 'pyproject.toml' THEN 3 WHEN 'setup.py' THEN 3 WHEN 'Cargo.toml' THEN 4 WHEN 'pom.xml' THEN 5 WHEN 'build.gradle' THEN 6 END AS st FROM mark),
b AS (SELECT path, arg_min(m, (st, m)) AS first, count(*) FILTER (WHERE m = 'Dockerfile') AS docker FROM (SELECT path, m, st FROM staged WHERE st IS NOT NULL) GROUP BY path),
bounds AS (SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name, CASE WHEN first IN ('cmd/ directory', 'Dockerfile') THEN 'service' ELSE 'module' END AS type,
    CASE WHEN docker > 0 AND first IN ('go.mod', 'cmd/ directory') THEN first || ',Dockerfile' ELSE first END AS markers FROM b)"""
_BULK = G.replace(" FROM lineitem)", f" FROM lineitem WHERE {BULK})")
_MIXED = _BULK + """, mnodes AS (SELECT id, name, type FROM nodes UNION SELECT source, source, 'module' FROM tr UNION SELECT target, target, 'module' FROM tr),
medges AS (SELECT source, target, type FROM edges UNION ALL SELECT source, target, 'dependency' FROM tr UNION ALL SELECT id, 'db:region/1', 'read_write' FROM nodes WHERE type = 'endpoint' AND id LIKE '%0'),
mdep AS (SELECT source, target FROM medges WHERE type = 'dependency'),
scc AS (SELECT a AS id, least(a, min(b)) AS scc FROM (SELECT x.a, x.b FROM down x JOIN down y ON x.a = y.b AND x.b = y.a) GROUP BY a),
cyc AS (SELECT string_agg(id, ', ' ORDER BY id) AS ids, count(*) AS n FROM scc GROUP BY scc HAVING count(*) > 1)"""

ORACLE_SQL = {
    "boundaries": _FILES + " SELECT path, name, type, markers FROM bounds",
    "deployable_units": _FILES + " SELECT count(*) AS units FROM bounds WHERE type = 'service' OR markers LIKE '%Dockerfile%'",
    "environment": """WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n, 'n' || s_nationkey || '/s' || s_suppkey AS f FROM supplier)
SELECT 'go_mod_replace_target_missing' AS rule, 'high' AS severity, a.f || '/go.mod: ../s' || (a.k + 1) AS subject FROM s a LEFT JOIN s b ON b.n = a.n AND b.k = a.k + 1 WHERE a.k % 8 = 0 AND b.k IS NULL
UNION ALL SELECT 'go_mod_replace_target_missing', 'high', f || '/go.mod: ../../n0' FROM s WHERE k % 8 = 0 AND NOT EXISTS (SELECT 1 FROM s WHERE n = 0)
UNION ALL SELECT 'tsconfig_baseurl_missing', 'high', f || '/tsconfig.json: baseUrl gone' FROM s WHERE k % 16 = 15
UNION ALL SELECT 'tsconfig_path_target_missing', 'medium', f || '/tsconfig.json: @/* -> c0/*' FROM s WHERE k % 16 = 7""",
    "dependency_kinds": G + """, e AS (SELECT CASE length(target) % 3 WHEN 0 THEN 'example.com/' || target WHEN 1 THEN 'golang.org/x/' || target ELSE target END AS label, source LIKE '%7' AS infra FROM raw WHERE type = 'dependency')
SELECT label, CASE WHEN bool_and(infra) OR NOT bool_or(NOT infra AND label LIKE 'example.com/%') THEN 'infrastructure' ELSE 'external' END AS kind FROM e WHERE infra OR label LIKE 'example.com/%' GROUP BY label""",
    "data_paths": G + "SELECT source || ' -> ' || target || ' ()' AS path FROM raw WHERE type = 'read_write'",
    "note_links": """WITH p AS (SELECT p_partkey AS k, replace(p_brand || '/' || p_type || '/' || p_partkey, ' ', '_') AS path, replace(p_type || '/' || p_partkey, ' ', '_') AS short FROM part)
SELECT 'note:' || (k % 50) AS source, 'pkg:part/' || k AS target, 'documents' AS label, 0.6::DOUBLE AS confidence FROM p
WHERE k % 5 < 3 AND regexp_full_match(CASE k % 5 WHEN 0 THEN path WHEN 1 THEN short ELSE 'parts/' || path END, '[a-zA-Z_][\\w./-]*')""",
    "folder_nodes": G + f", g AS (SELECT id, name, type, {_FOLDER} AS g FROM nodes) SELECT g AS id, g[5:] || ' (' || count(*) || ')' AS name, 'module' AS type, count(*) AS members FROM g WHERE g <> id GROUP BY g UNION ALL SELECT id, name, type, 0 FROM g WHERE g = id",
    "disconnected": _BULK + "SELECT id FROM nodes WHERE type <> 'endpoint' AND id NOT IN (SELECT source FROM raw) AND id NOT IN (SELECT target FROM raw)",
    "cycles": _MIXED + " SELECT 'no_circular_dependencies' AS rule, 'critical' AS severity, 'cycle(' || n || ' nodes): ' || ids AS subject FROM cyc",
    "recommend": _MIXED + """, f AS (SELECT id, coalesce(o, 0) AS o, coalesce(i, 0) AS i FROM mnodes LEFT JOIN (SELECT source AS id, count(*) AS o FROM mdep GROUP BY 1) USING (id) LEFT JOIN (SELECT target AS id, count(*) AS i FROM mdep GROUP BY 1) USING (id)
  WHERE type NOT IN ('database', 'queue', 'cache', 'external_api')),
m AS (SELECT id, i, o + i AS c, CASE WHEN o + i > 0 THEN o / (o + i) ELSE 0 END AS inst, avg(o + i) OVER () AS a FROM f),
deg AS (SELECT target AS s, count(*) AS fan FROM mdep GROUP BY 1),
sh AS (SELECT count(*) FILTER (WHERE type = 'database') AS db, count(*) FILTER (WHERE type = 'endpoint') AS ends, count(*) FILTER (WHERE type = 'cache') AS caches FROM mnodes),
r AS (
  SELECT 'break_cycle' AS category, string_split(ids, ', ') AS subjects, 'high' AS priority, 9.0 AS ratio, n::DOUBLE AS value, 1.0::DOUBLE AS threshold FROM cyc
  UNION ALL SELECT 'reduce_coupling', [id], CASE WHEN c > 3 * a THEN 'high' ELSE 'medium' END, c / (2 * a), c, 2 * a FROM m WHERE a > 2 AND c > 2 * a
  UNION ALL SELECT 'stabilize_core', [id], 'high', least(CASE WHEN i / 3.0 >= 1.5 THEN 9 WHEN i / 3.0 >= 1.2 THEN 1.3 ELSE 1 END, CASE WHEN inst / 0.7 >= 1.5 THEN 9 WHEN inst / 0.7 >= 1.2 THEN 1.3 ELSE 1 END), inst, 0.7 FROM m WHERE i > 3 AND inst > 0.7
  UNION ALL SELECT 'add_layer', [s.name || ' -> ' || t.name], 'medium', 9, 1, 1 FROM medges JOIN mnodes s ON s.id = source JOIN mnodes t ON t.id = target WHERE s.type = 'endpoint' AND t.type = 'database'
  UNION ALL SELECT 'add_caching', ['infrastructure'], 'low', ends / 5.0, ends, 5 FROM sh WHERE ends > 5 AND caches = 0
  UNION ALL SELECT 'split_module', [id], 'medium', c / 8.0, c, 8 FROM m WHERE c > 8
  UNION ALL SELECT 'remove_orphan', [id], 'low', 9, 0, 1 FROM nodes WHERE type NOT IN ('endpoint', 'database') AND id NOT IN (SELECT source FROM raw) AND id NOT IN (SELECT target FROM raw)),
k AS (SELECT row_number() OVER () AS k, * FROM r),
flag AS (SELECT k, s, count(*) OVER (PARTITION BY s) AS flags FROM (SELECT k, unnest(subjects) AS s FROM k)),
up AS (SELECT DISTINCT k FROM flag LEFT JOIN deg USING (s) WHERE flags > 1 OR fan > 3)
SELECT category, array_to_string(subjects, ', ') AS subjects, CASE WHEN priority = 'medium' AND k IN (FROM up) THEN 'high' ELSE priority END AS priority,
  CASE WHEN ratio >= 1.5 THEN 'high' WHEN ratio >= 1.2 THEN 'medium' ELSE 'low' END AS confidence, round(value, 6) AS value, round(threshold, 6) AS threshold FROM k""",
    "resolve_edges": G + "SELECT source, target, type, round(confidence, 6) AS confidence FROM edges",
    "node_type_counts": G + "SELECT type, count(*) AS n FROM nodes GROUP BY type",
    "edge_type_counts": G + "SELECT type, count(*) AS n FROM edges GROUP BY type",
    "fan_in_out": G + "SELECT id, fan_out, fan_in, round(instability, 6) AS instability FROM fio",
    "metrics_summary": G + "SELECT round(avg(fan_in + fan_out), 6) AS avg_coupling, round(avg(instability), 6) AS avg_instability FROM fio",
    "blast_radius": G + "SELECT id, min(depth)::INT AS depth FROM blast WHERE id <> 'db:region/0' GROUP BY id",
    "blast_radius_summary": G + "SELECT count(*) FILTER (WHERE depth = 1) AS direct, count(*) AS total FROM (SELECT id, min(depth) AS depth FROM blast WHERE id <> 'db:region/0' GROUP BY id)",
    "dataflow_traces": G + "SELECT a.source AS entry, a.source || ' > ' || a.target || ' > ' || b.target AS chain, b.target AS terminal, round(least(a.confidence, b.confidence), 6) AS confidence FROM edges a JOIN edges b ON b.source = a.target WHERE a.source LIKE 'endpoint:%'",
    "scc_members": G + "SELECT a AS id, least(a, min(b)) AS scc_min_id FROM (SELECT x.a, x.b FROM down x JOIN down y ON x.a = y.b AND x.b = y.a UNION SELECT source, source FROM tr UNION SELECT target, target FROM tr) GROUP BY a",
    "has_cycle": G + "SELECT count(*) > 0 AS has_cycle FROM down WHERE a = b",
    "max_depth": G + "SELECT max(depth)::BIGINT AS max_depth FROM long",
    "components": G + ", cc(id, root) USING KEY (id) AS (SELECT id, id FROM nodes UNION SELECT und.b, min(cc.root) FROM cc JOIN und ON und.a = cc.id JOIN recurring.cc r ON r.id = und.b WHERE cc.root < r.root GROUP BY und.b) SELECT id, root AS component FROM cc",
    "transitive_reduce": G + """, t AS (SELECT source, target FROM edges WHERE type = 'dependency' UNION SELECT 'pkg:part/0', 'svc:nation/0'),
far AS (SELECT a.source, b.target FROM t a JOIN t b ON b.source = a.target), further AS (SELECT source, target FROM far UNION SELECT far.source, t.target FROM far JOIN t ON t.source = far.target)
SELECT source, target, 'dependency' AS type FROM t WHERE NOT EXISTS (SELECT 1 FROM further WHERE further.source = t.source AND further.target = t.target)""",
    "transitive_reduce_cycles": G + f""", ord AS ({_ORDERS}), ring AS ({_RING}), t AS (FROM tr UNION FROM ring),
walk AS (SELECT t.source, t.target, n.target AS at FROM t JOIN t n ON n.source = t.source WHERE n.target <> t.target
  UNION SELECT walk.source, walk.target, t.target FROM walk JOIN t ON t.source = walk.at WHERE walk.at <> walk.target AND t.target <> walk.source)
SELECT source, target, 'dependency' AS type FROM t WHERE NOT EXISTS (SELECT 1 FROM walk WHERE walk.source = t.source AND walk.target = t.target AND walk.at = t.target)""",
    "ranked_components": f"""WITH ord AS ({_ORDERS}), c AS (SELECT 'o:' || o_orderkey AS id, day FROM ord), s AS (SELECT day, count(*) AS size, min(id) AS root FROM c GROUP BY day),
r AS (SELECT day, size, row_number() OVER (ORDER BY size DESC, root) - 1 AS rank FROM s) SELECT id, size, rank FROM c JOIN r USING (day)""",
    "k_core": G + "".join(f""", e{k} AS (SELECT source, target FROM {'edges' if k == 0 else f'e{k - 1}'} WHERE source IN (SELECT id FROM d{k}) AND target IN (SELECT id FROM d{k})), d{k + 1} AS (SELECT id FROM (SELECT unnest([source, target]) AS id FROM e{k}) GROUP BY id HAVING count(*) >= 2)"""
        if k else """, d0 AS (SELECT id FROM (SELECT unnest([source, target]) AS id FROM edges) GROUP BY id HAVING count(*) >= 2), e0 AS (SELECT source, target FROM edges WHERE source IN (SELECT id FROM d0) AND target IN (SELECT id FROM d0)), d1 AS (SELECT id FROM (SELECT unnest([source, target]) AS id FROM e0) GROUP BY id HAVING count(*) >= 2)""" for k in range(7)) + " SELECT id FROM d7",
    "prune_super_nodes": G + "SELECT target AS id, round(count(DISTINCT source) / (SELECT count(DISTINCT source) FROM edges), 6) AS share FROM edges GROUP BY target HAVING count(DISTINCT source) / (SELECT count(DISTINCT source) FROM edges) > 0.015",
    "group_by_folder": G + f", g AS (SELECT id, {_FOLDER} AS g FROM nodes) SELECT s.g AS source, t.g AS target, type, count(*) AS n, CASE WHEN count(*) > 1 OR s.g LIKE 'dir:%' OR t.g LIKE 'dir:%' THEN count(*) || CASE type WHEN 'dependency' THEN ' import' ELSE ' read write' END || CASE WHEN count(*) = 1 THEN '' ELSE 's' END ELSE '' END AS label FROM edges JOIN g s ON s.id = source JOIN g t ON t.id = target WHERE s.g <> t.g GROUP BY s.g, t.g, type",
    "view_filter": G + ", v AS (SELECT id FROM nodes WHERE type NOT IN ('package', 'endpoint')) SELECT source, target, type FROM edges WHERE source IN (FROM v) AND target IN (FROM v)",
    "orphans": _BULK + "SELECT id, 'no_orphan_nodes' AS rule, 'low' AS severity FROM nodes WHERE type NOT IN ('endpoint', 'database', 'queue', 'cache', 'external_api') AND id NOT IN (SELECT source FROM raw) AND id NOT IN (SELECT target FROM raw)",
    "layering_violations": G + "SELECT s.name || ' -> ' || t.name AS subject, 'no_endpoint_to_database' AS rule, 'medium' AS severity FROM (SELECT DISTINCT a.source, b.target FROM edges a JOIN edges b ON b.source = a.target WHERE a.source LIKE 'endpoint:%' AND b.target LIKE 'db:%') e JOIN nodes s ON s.id = source JOIN nodes t ON t.id = target",
    "no_dependency": G + "SELECT 'parts-off-region-3' AS rule, source || ' -> ' || target AS subject FROM edges JOIN nodes ON id = target WHERE source LIKE 'pkg:%' AND path LIKE 'region/3/%' AND nodes.type = 'module'",
    "require_dependency": _BULK + "SELECT 'parts-need-supplier' AS rule, id AS subject FROM nodes WHERE type = 'package' AND id NOT IN (SELECT source FROM edges WHERE target LIKE 'mod:%')",
    "baseline_split": _BULK + "SELECT 'no_orphan_nodes' AS rule, id AS subject, NOT (type = 'package' AND length(name) % 2 = 0) AS is_new FROM nodes WHERE type NOT IN ('endpoint', 'database') AND id NOT IN (SELECT source FROM raw) AND id NOT IN (SELECT target FROM raw)",
    "graph_diff": f"WITH {_DATED}, o AS (SELECT DISTINCT source, target FROM x WHERE l_shipdate < TIMESTAMP '1998-01-01'), n AS (SELECT DISTINCT source, target FROM x WHERE l_shipdate >= TIMESTAMP '1998-01-01') SELECT c AS change_type, 'edge' AS category, source || ' -> ' || target || ' (dependency)' AS subject, 'medium' AS severity FROM (SELECT 'added' AS c, * FROM (FROM n EXCEPT FROM o) UNION ALL SELECT 'removed', * FROM (FROM o EXCEPT FROM n))",
    "node_diff": G + ", o AS (SELECT id, name FROM nodes WHERE type IN ('package', 'module') AND length(id) % 5 <> 0), n AS (SELECT id, CASE WHEN id LIKE '%7' THEN 'renamed' ELSE name END AS name FROM nodes WHERE type IN ('package', 'module') AND length(id) % 4 <> 0) SELECT CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'modified' END AS change_type, 'node' AS category, id AS subject, 'medium' AS severity FROM o FULL JOIN n USING (id) WHERE o.name IS DISTINCT FROM n.name",
    "history_lag": f"""WITH {_DATED}, e AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS month, source, target FROM x), m AS (SELECT month, row_number() OVER (ORDER BY month) AS k FROM (SELECT DISTINCT month FROM e)), r AS (SELECT * FROM e JOIN m USING (month)),
s AS (SELECT month, k, count(*) AS edges FROM r GROUP BY ALL), kept AS (SELECT b.k, count(*) AS kept FROM r a JOIN r b ON a.source = b.source AND a.target = b.target AND b.k = a.k + 1 GROUP BY b.k), n AS (SELECT month, count(DISTINCT id) AS nodes FROM (SELECT month, unnest([source, target]) AS id FROM e) GROUP BY month)
SELECT month, nodes, edges, CASE WHEN lag(edges) OVER (ORDER BY k) IS NULL THEN 0 ELSE edges + lag(edges) OVER (ORDER BY k) - 2 * coalesce(kept, 0) END::BIGINT AS changes FROM s LEFT JOIN kept USING (k) JOIN n USING (month)""",
    "cross_boundary": G + _OWNER + " SELECT count(*) FILTER (WHERE s.boundary <> t.boundary) AS crossing, count(*) AS total FROM edges JOIN ob s ON s.id = source JOIN ob t ON t.id = target",
    "shared_database": G + _OWNER + " SELECT target AS id, count(DISTINCT boundary) AS boundaries FROM (SELECT source, target FROM edges WHERE type = 'read_write' UNION ALL SELECT source, 'db:region/1' FROM edges WHERE source LIKE 'pkg:%') JOIN ob ON ob.id = source GROUP BY target HAVING count(DISTINCT boundary) >= 2",
    "target_binding": G + ", w(target) AS (VALUES ('nation/3'), ('svc:nation/4'), ('supplier/5'), ('plier/5'), ('5'), ('nothing')) SELECT target, arg_min(id, (CASE WHEN id = target THEN 0 ELSE 1 END, strlen(id), id)) AS id FROM w JOIN nodes ON ends_with(id, target) OR ends_with(path, target) GROUP BY target",
    "wikilink_resolve": G + ", w AS (SELECT regexp_extract(path, '([^/]+/[^/]+)$', 1) AS t FROM nodes WHERE type IN ('service', 'module')) SELECT 'wikilink:' || t AS link, arg_min(id, (CASE WHEN lower(path) = lower(t) THEN 0 ELSE len(string_split(path, '/')) END, id)) AS id FROM (SELECT DISTINCT t FROM w) JOIN nodes ON lower(path) = lower(t) OR ends_with(lower(path), '/' || lower(t)) GROUP BY t",
    "route_match": "WITH u AS (SELECT DISTINCT regexp_extract(url, '^[^:]+://[^/]+(/[^?#]*)', 1) AS route FROM pages), p AS (SELECT route, list_filter(string_split(route, '/'), lambda s: s <> '') AS parts FROM u) SELECT route AS called, 'endpoint:' || parts[1] AS endpoint FROM p WHERE len(parts) = 2",
    "url_host": "SELECT page_id, lower(regexp_extract(url, '^(?:https?:)?//(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host FROM pages",
    "mask_secrets": f"SELECT doc_id, md5({masked_sql('text')}) AS masked_md5 FROM documents",
    "structure_rules": G + "SELECT count(*) FILTER (WHERE type = 'database') = 1 AND count(*) FILTER (WHERE type IN ('service', 'module')) > 2 AS split_database, count(*) FILTER (WHERE type = 'endpoint') > 5 AND count(*) FILTER (WHERE type = 'cache') = 0 AS add_caching FROM nodes",
    "recommend_thresholds": G + """, m AS (SELECT id, fan_in, fan_in + fan_out AS c, instability, avg(fan_in + fan_out) OVER () AS a FROM fio),
r AS (SELECT 'reduce_coupling' AS category, id AS subject, CASE WHEN c > 3 * a THEN 'high' ELSE 'medium' END AS priority, c / (2 * a) AS ratio, fan_in FROM m WHERE a > 2 AND c > 2 * a
  UNION ALL SELECT 'stabilize_core', id, 'high', instability / 0.7, fan_in FROM m WHERE fan_in > 3 AND instability > 0.7
  UNION ALL SELECT 'split_module', id, 'medium', c / 8.0, fan_in FROM m WHERE c > 8)
SELECT category, subject, CASE WHEN priority = 'medium' AND (fan_in > 3 OR count(*) OVER (PARTITION BY subject) > 1) THEN 'high' ELSE priority END AS priority, CASE WHEN ratio >= 1.5 THEN 'high' WHEN ratio >= 1.2 THEN 'medium' ELSE 'low' END AS confidence FROM r""",
    "changes_detect": "WITH d AS (SELECT doc_id, source || '/' || lang || '/' || (doc_id // 2) AS path, sha256(text) AS h FROM documents), o AS (SELECT path, min(h) AS h FROM d WHERE doc_id % 2 = 0 GROUP BY path), n AS (SELECT path, min(h) AS h FROM d WHERE doc_id % 2 = 1 GROUP BY path) SELECT path, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'deleted' WHEN o.h = n.h THEN 'unchanged' ELSE 'modified' END AS status FROM o FULL JOIN n USING (path)",
    "file_hash": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
}
