"""Iterative graph kernels: frontier and label loops over DataFrames, cut by tables in the shared folder."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattice.model import INFRA
from lattice.operators.in_task import PART, reduced, united
from lattice.storage import stored

#: Links that one task unites, edges of a component that one task reduces, and of the longest way in a flat graph.
IN_TASK, WHOLE, FLAT = 1_000_000, 500_000, 2


def dependents(edges: DataFrame, target: str, max_depth: int = 50) -> tuple[list[DataFrame], bool]:
    """A table (id, depth, parent, place) for each depth, nearest first, and whether the walk stopped at max_depth with
    ways left. Of several parents the one that a queue would have met first counts: place holds, for each step, the
    order of the edge and the id."""
    ord_ = F.col("ord") if "ord" in edges.columns else F.lit(0)
    back = stored(edges.select(F.col("source").alias("id"), F.col("target").alias("parent"), ord_.alias("ord")).groupBy("id", "parent").agg(F.min("ord").alias("ord")), "edges")
    none = F.expr(f"cast(array() as array<struct<ord: {back.schema['ord'].dataType.simpleString()}, id: string>>)")
    front = back.sparkSession.createDataFrame([(target,)], "id string").select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), none.alias("place"))
    seen, rounds = front.select("id"), []
    for depth in range(1, max_depth + 1):
        step = back.join(front.select(F.col("id").alias("parent"), "place"), "parent")
        best = step.groupBy("id").agg(F.min(F.struct(F.concat("place", F.array(F.struct("ord", "id"))).alias("place"), "parent")).alias("b"))
        front = stored(best.join(seen, "id", "left_anti").select("id", F.lit(depth).alias("depth"), "b.parent", "b.place"), "front")
        if front.isEmpty():
            return rounds, False
        rounds.append(front)
        seen = seen.unionByName(front.select("id"))
        if depth % 10 == 0:  # else each round reads one table more
            seen = stored(seen, "seen")
    return rounds, not back.join(front.select(F.col("id").alias("parent")), "parent", "left_semi").isEmpty()


def blast_radius(edges: DataFrame, target: str, max_depth: int = 50) -> DataFrame:
    """id, depth, path_back of all that depend on the target."""
    rounds, _ = dependents(edges, target, max_depth)
    return path_back(edges.sparkSession, rounds, target)


def path_back(spark: SparkSession, rounds: list[DataFrame], target: str) -> DataFrame:
    """id, depth, path_back from the tables of dependents: each depth's ways are those of its parents, one node longer."""
    out = ways = spark.createDataFrame([(target, [target])], "id string, path_back array<string>").withColumn("depth", F.lit(0)).select("id", "depth", "path_back")
    for level in rounds:
        ways = level.select("id", "depth", "parent").join(ways.select(F.col("id").alias("parent"), "path_back"), "parent").select("id", "depth", F.concat(F.array("id"), "path_back").alias("path_back"))
        out = out.unionByName(ways)
    return out.where("depth > 0")


def traces(nodes: DataFrame, edges: DataFrame, max_nodes: int = 20) -> DataFrame:
    """entry, chain, terminal, confidence: simple paths from endpoints to infrastructure or to a node without a way on."""
    step = stored(edges.select("source", "target", F.when(F.col("confidence") > 0, F.col("confidence")).alias("c")), "edges")
    kinds = nodes.select(F.col("id").alias("at"), F.col("type").isin(INFRA).alias("stops")).distinct()
    open_ = step.select(F.col("source").alias("at")).distinct().withColumn("goes_on", F.lit(True))
    front = nodes.where("type = 'endpoint'").select(F.col("id").alias("at"), F.array("id").alias("chain"), F.lit(None).cast("double").alias("conf"))
    found = None
    for _ in range(max_nodes - 1):
        new = front.join(step.withColumnRenamed("source", "at"), "at").where(~F.array_contains("chain", F.col("target"))).select(
            F.col("target").alias("at"), F.concat("chain", F.array("target")).alias("chain"), F.least("conf", "c").alias("conf"))
        new = stored(new.join(kinds, "at", "left").join(open_, "at", "left"), "front")
        if new.isEmpty():
            break
        over = new.where("stops or goes_on is null").select(F.get("chain", 0).alias("entry"), "chain", F.col("at").alias("terminal"), F.coalesce("conf", F.lit(0.0)).alias("confidence"))
        found = over if found is None else found.unionByName(over)
        front = new.where("not coalesce(stops, false) and goes_on").select("at", "chain", "conf")
    if found is None:
        return front.limit(0).select(F.col("at").alias("entry"), "chain", F.col("at").alias("terminal"), F.col("conf").alias("confidence"))
    return found.groupBy("entry", "chain", "terminal").agg(F.max("confidence").alias("confidence"))


def mixed(name: Column) -> Column:
    """Another number for each number, none for two: names without an order that a graph could follow."""
    for shift, n in ((F.shiftleft, 13), (F.shiftrightunsigned, 7), (F.shiftleft, 17)):
        name = name.bitwiseXOR(shift(name, n))
    return name


def contracted(links: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """n, up: a number for each component of links (a, b, numbers) and each number in them. Each round, a node goes to the
    least name around it; links between what is left, half as many nodes or fewer, are the next round's. The last ones are
    settled in one task."""
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    left, rounds = stored(links.where("a <> b").select(*pair).distinct(), "links"), []
    while left.count() > in_task:
        a, b = F.col("a"), F.col("b")
        near = left.select(a.alias("n"), mixed(b).alias("near")).union(left.select(b, mixed(a))).groupBy("n").agg(F.min("near").alias("near"))
        up = stored(near.select("n", F.least("near", mixed(F.col("n"))).alias("up")), "up")
        rounds.append(up)
        to = lambda end: up.select(F.col("n").alias(end), F.col("up").alias(f"{end}_up"))  # noqa: B023, E731
        met = left.join(to("a"), "a").join(to("b"), "b").select(F.col("a_up").alias("a"), F.col("b_up").alias("b"))
        left = stored(met.where("a <> b").select(*pair).distinct(), "links")
    top = left.coalesce(1).mapInArrow(united, "n bigint, up bigint")
    for up in reversed(rounds):
        top = up.join(top.select(F.col("n").alias("up"), F.col("up").alias("top")), "up", "left").select("n", F.coalesce("top", "up").alias("up"))
    return top


def components(nodes: DataFrame, edges: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """id, root: the smallest id that is connected."""
    ids = stored(nodes.select("id").distinct().select("id", F.monotonically_increasing_id().alias("n")), "ids")  # written, so that numbers stay
    end = lambda of, n: ids.select(F.col("id").alias(of), F.col("n").alias(n))
    links = edges.select("source", "target").join(end("source", "a"), "source").join(end("target", "b"), "target").select("a", "b")
    found = stored(ids.join(contracted(links, in_task), "n", "left").select("id", F.coalesce("up", "n").alias("top")), "tops")
    return found.join(found.groupBy("top").agg(F.min("id").alias("root")), "top").select("id", "root")


def ranked_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, root, size, rank: components in order of size, largest first, then of their smallest id, from 0."""
    found = stored(components(nodes, edges), "components")
    sizes = found.groupBy("root").agg(F.count("*").alias("size"))
    ranks = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), "root")) - 1)  # a row for each component
    return found.join(ranks, "root").select("id", "root", "size", "rank")


def _reach(edges: DataFrame, start: DataFrame, rounds: int) -> DataFrame:
    """id, color: smallest color that reaches the id along edges (a, b); start holds every id with its own color."""
    now = start
    for _ in range(rounds):
        near = edges.join(now.select(F.col("id").alias("a"), "color"), "a").groupBy(F.col("b").alias("id")).agg(F.min("color").alias("near"))
        after = stored(now.join(near, "id", "left").select("id", F.col("color").alias("old"), F.least("color", "near").alias("color")), "colors")
        now = after.select("id", "color")
        if after.where("old <> color").isEmpty():
            return now
    raise RuntimeError("colors did not settle")


def strong_components(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """id, scc (its smallest id). Colors run forward; what reaches a color's own node within its color is one component
    with it; those go, and the rest is colored anew."""
    left = stored(edges.select(F.col("source").alias("a"), F.col("target").alias("b")).where("a <> b").distinct(), "edges")
    ids = stored(edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct(), "ids")
    found = None
    for _ in range(rounds):
        color = _reach(left, ids.select("id", F.col("id").alias("color")), rounds)
        c = color.withColumnRenamed("color", "c")
        inside = stored(left.join(c.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(c.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b").where("ca = cb").select(F.col("b").alias("a"), F.col("a").alias("b"), "ca"), "inside")
        back = color.where("id = color").select("id", "color")
        front = back
        for _ in range(rounds):
            new = inside.join(front.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id"), F.col("ca").alias("color")).distinct().join(back, "id", "left_anti")
            front = stored(new, "front")
            if front.isEmpty():
                break
            back = back.unionByName(front)
        else:
            raise RuntimeError("strong components did not settle")
        done = stored(back, "strong")
        found = done if found is None else found.unionByName(done)
        ids = stored(ids.join(done, "id", "left_anti"), "ids")
        if ids.isEmpty():
            break
        left = stored(left.join(done.select(F.col("id").alias("a")), "a", "left_anti").join(done.select(F.col("id").alias("b")), "b", "left_anti"), "edges")
    else:
        raise RuntimeError("strong components did not settle")
    low = found.groupBy("color").agg(F.min("id").alias("scc"))
    return found.join(low, "color").select("id", "scc")


def has_cycle(edges: DataFrame) -> DataFrame:
    """Of resolved dependency edges; raw self loops count."""
    loops = edges.where("source = target").agg((F.count("*") > 0).alias("loop"))
    sizes = strong_components(edges).groupBy("scc").agg(F.count("*").alias("n")).agg((F.coalesce(F.max("n"), F.lit(0)) > 1).alias("cycle"))
    return loops.join(F.broadcast(sizes)).select((F.col("loop") | F.col("cycle")).alias("has_cycle"))  # one row each


def depths(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """id, depth: edges of the longest way out of each node. Strong components are contracted first, so that cycles
    have one value, that of their component."""
    scc = stored(strong_components(edges), "scc")
    flat = edges.join(scc.select(F.col("id").alias("source"), F.col("scc").alias("a")), "source").join(scc.select(F.col("id").alias("target"), F.col("scc").alias("b")), "target").where("a <> b").select("a", "b").distinct()
    flat = stored(flat, "flat")
    now = stored(scc.select(F.col("scc").alias("id"), F.lit(0).alias("depth")).distinct(), "depths")
    for _ in range(rounds):
        far = flat.join(now.select(F.col("id").alias("b"), "depth"), "b").groupBy(F.col("a").alias("id")).agg((F.max("depth") + 1).alias("far"))
        after = stored(now.join(far, "id", "left").select("id", F.col("depth").alias("old"), F.greatest("depth", "far").alias("depth")), "depths")
        now = after.select("id", "depth")
        if after.where("old <> depth").isEmpty():
            break
    else:
        raise RuntimeError("depths did not settle")
    return scc.join(now.withColumnRenamed("id", "scc"), "scc").select("id", "depth")


def transitive_reduction(edges: DataFrame, whole: int = WHOLE) -> DataFrame:
    """Without edges u-v of a type for which v is reached from u by two or more edges of the type, neither beginning with
    u-v nor passing u again.

    A flat graph is searched from all its sources at once. Where ways go on, each component of up to `whole` edges is
    reduced in one task, in time near its size; only larger ones are searched to the end."""
    every = stored(edges.select("source", "target", "type").distinct().where("source is not null and target is not null"), "edges")
    own, loops = every.where("source <> target and type is not null"), every.where("source = target or type is null")
    if not _goes_on(own, FLAT):
        found = _searched(own)
    else:
        node = lambda end: F.xxhash64("type", end)  # noqa: E731  two nodes of one number only share a component
        tops = contracted(own.select(node("source").alias("a"), node("target").alias("b")))
        placed = stored(own.withColumn("n", node("source")).join(tops, "n", "left").select("source", "target", "type", F.coalesce("up", "n").alias("top")), "placed")
        large = stored(placed.groupBy("top").agg(F.count("*").alias("n")).where(F.col("n") > whole).select("top"), "large")
        n_parts = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-placed.count() // PART))
        if large.isEmpty():
            small, found = placed, None
        else:
            small, found = placed.join(large, "top", "left_anti"), _searched(stored(placed.join(large, "top", "left_semi").drop("top"), "edges"))
        kept = small.select("source", "target", "type", "top").repartition(n_parts, "top").sortWithinPartitions("top").mapInArrow(reduced, small.select("source", "target", "type").schema)
        found = kept if found is None else found.unionByName(kept)
    return found.unionByName(loops)


def _goes_on(own: DataFrame, n: int) -> bool:
    """Whether a way has more than n edges."""
    last = own
    for _ in range(n):
        last = own.join(last.select(F.col("target").alias("source"), "type").distinct(), ["source", "type"], "left_semi")
    return not last.isEmpty()


def _searched(own: DataFrame) -> DataFrame:
    """The edges that transitive_reduction keeps of a stored table.

    Only sources of several edges, some of whose targets have other ways in, are searched from. For each node that is
    reached, up to two of the first steps that lead there are kept: v has another way if one of them isn't v itself."""
    several = own.groupBy("source", "type").agg(F.count("*").alias("n")).where("n > 1").select("source", "type")
    entered = own.groupBy("target", "type").agg(F.count("*").alias("n")).where("n > 1").select("target", "type")
    open_ = stored(own.join(several, ["source", "type"], "left_semi").join(entered, ["target", "type"], "left_semi"), "open")
    sources = open_.select("source", "type").distinct()
    step = own.select(F.col("source").alias("at"), F.col("target").alias("next"), "type")
    front = stored(own.join(sources, ["source", "type"], "left_semi").select("source", "type", F.col("target").alias("at"), F.col("target").alias("low"), F.col("target").alias("high")), "front")
    seen = front
    for k in itertools.count(1):  # ends, as a node is reached anew at most twice
        on = front.join(step, ["at", "type"]).where("next <> source").groupBy("source", "type", F.col("next").alias("at")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
        old = seen.groupBy("source", "type", "at").agg(F.min("low").alias("l"), F.max("high").alias("h"))
        met = on.join(old, ["source", "type", "at"], "left").where("l is null or (l = h and (low <> l or high <> l))")
        front = stored(met.select("source", "type", "at", F.coalesce(F.least("low", "l"), "low").alias("low"), F.coalesce(F.greatest("high", "h"), "high").alias("high")), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if k % 10 == 0:
            seen = stored(seen, "seen")
    other = seen.where((F.col("low") != F.col("at")) | (F.col("high") != F.col("at"))).select("source", F.col("at").alias("target"), "type").distinct()
    return own.join(open_.join(other, ["source", "target", "type"], "left_semi"), ["source", "target", "type"], "left_anti")


def k_core(nodes: DataFrame, edges: DataFrame, least: int, rounds: int = 1000) -> DataFrame:
    """id of the nodes that keep at least so many edge ends, again and again."""
    left, ids = stored(edges.select("source", "target"), "edges"), stored(nodes.select("id").distinct(), "ids")
    n = ids.count()
    for _ in range(rounds):
        degree = left.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
        ids = stored(ids.join(degree.where(F.col("d") >= least), "id", "left_semi"), "ids")
        now = ids.count()
        if now == n:
            break
        n = now
        left = stored(left.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target"), "edges")
    else:
        raise RuntimeError("k-core did not settle")
    return ids
