"""Directed graphs as edge tables (a, b): resolution of link names, breadth-first reach, strongly connected components.

Every round is a few joins and pre-aggregated groupings; its table is written to the shared folder, so that a lost
executor costs one round. A node of very many edges is split by Spark's adaptive skew join, as one side of each join
holds a node once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.session import scratch

#: Edges that are few enough to be finished on the driver.
FEW_EDGES = 20_000


def resolve(links: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of named links, and the links that do not lead to just one place.

    links: src, name; names: node, path (in parts between '/'). A name that is one node's path is an edge to it. One that
    is several nodes' path is left out as `ambiguous`. One that is no path but the beginning of some (in whole parts) is a
    hub: an edge leads to the name itself and edges from there to all nodes below it, so that links to a name of many
    nodes stay linear; it is noted as `prefix`. All others are `missing`. Edges: a, b; notes: src, name, kind, candidates."""
    paths = names.where("path is not null").select("node", F.concat(F.lit("/"), F.array_join(F.filter(F.split("path", "/"), lambda x: x != ""), "/")).alias("path"))
    wanted = links.select("src", "name", F.concat(F.lit("/"), F.array_join(F.filter(F.split("name", "/"), lambda x: x != ""), "/")).alias("path")).distinct()
    exact = paths.groupBy("path").agg(F.count("*").alias("n_exact"), F.min("node").alias("only"))
    parts = F.split("path", "/")
    above = paths.select("node", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/")))).alias("path"))
    above = above.where("path <> ''")
    below = above.groupBy("path").agg(F.count("*").alias("n_below"))
    found = wanted.join(exact, "path", "left").join(below, "path", "left")
    kind = F.when(F.col("n_exact") == 1, "exact").when(F.col("n_exact") > 1, "ambiguous").when(F.col("n_below") > 0, "prefix").otherwise("missing")
    found = found.withColumn("kind", kind)
    hubs = found.where("kind = 'prefix'").select("path").distinct()
    edges = found.where("kind in ('exact', 'prefix')").select(F.col("src").alias("a"), F.when(F.col("kind") == "exact", F.col("only")).otherwise(F.col("path")).alias("b"))
    edges = edges.union(above.join(hubs, "path").select(F.col("path").alias("a"), F.col("node").alias("b"))).where("a <> b").distinct()
    count = F.when(F.col("kind") == "ambiguous", F.col("n_exact")).when(F.col("kind") == "prefix", F.col("n_below")).otherwise(0)
    return edges, found.where("kind <> 'exact'").select("src", "name", "kind", count.cast("long").alias("candidates"))


def reach(edges: DataFrame, sources: DataFrame, most_depth: int) -> tuple[DataFrame, DataFrame]:
    """Breadth-first search from all sources (node) at once: node, depth and via (the least node before it, null at a source) of
    each node within most_depth steps; and the edges (a, b) that lead on from there to nodes that are not reached."""
    spark = edges.sparkSession
    edges = scratch(spark, edges.select("a", "b").distinct(), "reach-edges")
    start = sources.select("node").where("node is not null").distinct().select("node", F.lit(0).alias("depth"), F.lit(None).cast(edges.schema["a"].dataType).alias("via"))
    seen = frontier = scratch(spark, start, "reach-0")
    for depth in range(1, most_depth + 1):
        step = edges.join(frontier.select(F.col("node").alias("a")), "a").groupBy("b").agg(F.min("a").alias("via"))
        new = step.join(seen.select(F.col("node").alias("b")), "b", "left_anti").select(F.col("b").alias("node"), F.lit(depth).alias("depth"), "via")
        frontier = scratch(spark, new, f"reach-{depth}")
        if frontier.isEmpty():
            return seen, edges.limit(0)
        seen = seen.union(frontier)
    beyond = edges.join(frontier.select(F.col("node").alias("a")), "a").join(seen.select(F.col("node").alias("b")), "b", "left_anti")
    return seen, beyond.select("a", "b")


def _tarjan(edges: list[tuple]) -> list[tuple]:
    """(node, component) of a small graph: one walk with a stack of its own."""
    out: dict = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    order, low, held, kept, found = {}, {}, [], set(), []
    for root in out:
        if root in order:
            continue
        walk = [(root, iter(out[root]))]
        order[root] = low[root] = len(order)
        held.append(root)
        kept.add(root)
        while walk:
            node, rest = walk[-1]
            ahead = next(rest, None)
            if ahead is None:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
                if low[node] == order[node]:
                    while True:
                        member = held.pop()
                        kept.discard(member)
                        found.append((member, node))
                        if member == node:
                            break
            elif ahead not in order:
                order[ahead] = low[ahead] = len(order)
                held.append(ahead)
                kept.add(ahead)
                walk.append((ahead, iter(out[ahead])))
            elif ahead in kept:
                low[node] = min(low[node], order[ahead])
    return found


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges without those of nodes that none leads to, or that lead to none: such a node is a component alone."""
    into, out_of = edges.select(F.col("b").alias("a")).distinct(), edges.select(F.col("a").alias("b")).distinct()
    return edges.join(into, "a", "left_semi").join(out_of, "b", "left_semi").select("a", "b")


def _passed(edges: DataFrame, turn: int) -> DataFrame:
    """v, u, w: nodes with just one edge into them (u, v) and one out of them (v, w), no two of them neighbours.

    Of neighbours, the one with the lowest hash in this turn is taken, which takes a fixed share of any long chain."""
    one_in = edges.groupBy("b").agg(F.min("a").alias("u"), F.count("*").alias("n")).where("n = 1").select(F.col("b").alias("v"), "u")
    one_out = edges.groupBy("a").agg(F.min("b").alias("w"), F.count("*").alias("n")).where("n = 1").select(F.col("a").alias("v"), "w")
    both = scratch(edges.sparkSession, one_in.join(one_out, "v").withColumn("h", F.xxhash64(F.lit(turn), "v")), "scc-chain")
    before = both.select(F.col("v").alias("u"), F.struct("h", "v").alias("hu"))
    after = both.select(F.col("v").alias("w"), F.struct("h", "v").alias("hw"))
    own = F.struct("h", "v")
    free = both.join(before, "u", "left").join(after, "w", "left").where((F.col("hu").isNull() | (own < F.col("hu"))) & (F.col("hw").isNull() | (own < F.col("hw"))))
    return free.select("v", "u", "w")


def _without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which neither end is among the nodes (v)."""
    return edges.join(nodes.select(F.col("v").alias("a")), "a", "left_anti").join(nodes.select(F.col("v").alias("b")), "b", "left_anti").select("a", "b")


def _coloured(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One step of forward and backward colouring: (v, component) of every component that holds the greatest node that
    reaches it, at least one, and the edges that are left within a colour."""
    spark = edges.sparkSession
    nodes = edges.select(F.col("a").alias("v")).union(edges.select(F.col("b").alias("v"))).distinct()
    colours = scratch(spark, nodes.select("v", F.col("v").alias("colour")), "scc-colours")
    while True:
        moved = edges.join(colours.select(F.col("v").alias("a"), "colour"), "a").groupBy("b").agg(F.max("colour").alias("other"))
        new = colours.join(moved.withColumnRenamed("b", "v"), "v", "left").select("v", F.greatest("colour", "other").alias("colour"), (F.col("other") > F.col("colour")).alias("changed"))
        written = scratch(spark, new, "scc-colours")
        colours = written.select("v", "colour")
        if written.where("changed").isEmpty():
            break
    of = lambda end: colours.select(F.col("v").alias(end), F.col("colour").alias(f"colour_{end}"))
    inner = scratch(spark, edges.join(of("a"), "a").join(of("b"), "b").where("colour_a = colour_b").select("a", "b"), "scc-inner")
    found = frontier = scratch(spark, colours.where("v = colour"), "scc-back")
    while True:
        back = inner.join(frontier.select(F.col("v").alias("b"), "colour"), "b").select(F.col("a").alias("v"), "colour").distinct().join(found, "v", "left_anti")
        frontier = scratch(spark, back, "scc-back")
        if frontier.isEmpty():
            break
        found = found.union(frontier)
    found = scratch(spark, found.withColumnRenamed("colour", "component"), "scc-found")
    return found, scratch(spark, _without(inner, found), "scc-edges")


def strongly_connected(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """node, component (its least node) and size of every component of two nodes or more; edges from a node to itself say nothing.

    Nodes at the rims are trimmed and nodes inside chains passed over, until what is left has neither; then one step of
    colouring takes at least the component of each colour's greatest node. Edges only ever get fewer. As soon as `few`
    are left they are finished in one go."""
    spark = edges.sparkSession
    edges = scratch(spark, edges.select("a", "b").where("a <> b").distinct(), "scc-edges")
    kind = edges.schema["a"].dataType
    found = spark.createDataFrame([], f"v {kind.simpleString()}, component {kind.simpleString()}")
    chains: list[DataFrame] = []
    left = edges.count()
    while left > few:
        edges = scratch(spark, _trimmed(edges), "scc-edges")
        chain = scratch(spark, _passed(edges, len(chains)), "scc-passed")
        chains.append(chain)
        bridged = chain.where("u <> w").select(F.col("u").alias("a"), F.col("w").alias("b"))
        edges = scratch(spark, _without(edges, chain).union(bridged).distinct(), "scc-edges")
        now = edges.count()
        if now > few and now >= left - left // 16:  # little is left to trim
            some, edges = _coloured(edges)
            found = found.union(some)
            now = edges.count()
        left = now
    if left:
        few_found = _tarjan([tuple(r) for r in edges.collect()])
        found = found.union(spark.createDataFrame(few_found, found.schema))
    for chain in reversed(chains):  # a node passed over is with its neighbours if they are together
        of = lambda end: found.select(F.col("v").alias(end), F.col("component").alias(f"of_{end}"))  # noqa: E731,B023
        known = chain.join(of("u"), "u", "left").join(of("w"), "w", "left")
        known = known.select("v", F.coalesce("of_u", "u").alias("x"), F.coalesce("of_w", "w").alias("y"), "u").where("x = y")
        alone = known.join(found.select(F.col("v").alias("u")), "u", "left_anti").select(F.col("u").alias("v"), F.col("u").alias("component"))
        found = scratch(spark, found.union(known.select("v", F.col("x").alias("component"))).union(alone.distinct()), "scc-found")
    sizes = found.groupBy("component").agg(F.min("v").alias("least"), F.count("*").alias("size")).where("size > 1")
    return found.join(sizes, "component").select(F.col("v").alias("node"), F.col("least").alias("component"), "size")
