"""Graph algorithms (GRA, AGG): degrees, paths, neighbourhoods, components, cycles."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.plans.graph import Graph, component_count, components, cut, drop, inside

#: Rounds of trimming before chains are looked for; twice as many each time after.
TRIMS = 8


def ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("id")).union(edges.select("target"))


def degree(g: Graph) -> DataFrame:
    """(id, degree) of every node; both ends count, so a self loop counts twice; inferred edges count."""
    n = ends(g.edges).groupBy("id").agg(F.count("*").alias("degree"))
    return g.nodes.select("id").join(n, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def top_degree(g: Graph, k: int = 8) -> DataFrame:
    return degree(g).orderBy(F.desc("degree"), "id").limit(k)


def isolated(g: Graph) -> DataFrame:
    return g.nodes.select("id").join(ends(g.edges), "id", "left_anti")


def counts(df: DataFrame, key: str, missing: str = "(none)") -> DataFrame:
    """Rows by key; null and empty keys count under one name."""
    k = F.col(key)
    return df.groupBy(F.when(k.isNull() | (k == ""), F.lit(missing)).otherwise(k).alias(key)).agg(F.count("*").alias("count"))


def search(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes whose label, description or type holds the trimmed query, whatever the case; none for an empty query."""
    q = query.strip().lower()
    hit = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(q)), F.lit(False))
    return nodes.where((hit("label") | hit("description") | hit("type")) & F.lit(q != ""))


def neighbours(edges: DataFrame) -> DataFrame:
    """Both directions of every edge: u, v."""
    e = edges.select(F.col("source").alias("u"), F.col("target").alias("v"))
    return e.union(e.select("v", "u")).where("u <> v").distinct()


def distances(g: Graph, seeds: DataFrame, hops: int | None = None, edges: DataFrame | None = None) -> DataFrame:
    """(id, distance) of all nodes within ``hops`` undirected steps of the seeds (a frame with id); all of them if None.

    One join a step: the frontier, not the whole set, meets the edges, and only new nodes go on.
    """
    steps = cut(neighbours(g.edges if edges is None else edges))
    seen = cut(seeds.select("id").distinct().join(g.nodes.select("id").distinct(), "id", "left_semi").withColumn("distance", F.lit(0)))
    frontier, at = seen, 0
    while hops is None or at < hops:
        at += 1
        near = frontier.select(F.col("id").alias("u")).join(steps, "u").select(F.col("v").alias("id")).distinct()
        new = cut(near.join(seen.select("id"), "id", "left_anti").withColumn("distance", F.lit(at)))
        if new.isEmpty():
            break
        seen = seen.union(new)
        if at % 6 == 0:
            seen = cut(seen)
        frontier = new
    return seen


def khop(g: Graph, seeds: DataFrame, hops: int, direct_only: bool = False) -> Graph:
    """The subgraph induced by the nodes within ``hops`` steps."""
    edges = g.direct() if direct_only else g.edges
    ids = cut(distances(g, seeds, hops, edges).select("id"))
    return induced(Graph(g.nodes, edges), ids)


def induced(g: Graph, ids: DataFrame) -> Graph:
    ids = ids.select("id").distinct()
    e = g.edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return Graph(g.nodes.join(ids, "id", "left_semi"), e.select(*g.edges.columns))


def _meet(steps: DataFrame, source: str, target: str) -> tuple[list[DataFrame], list[DataFrame]] | None:
    """Breadth-first levels (id) from both ends until they meet: the smaller of the two frontiers grows. None: they never do.

    The last levels of the two sides then hold the same node for each shortest path.
    """
    spark = steps.sparkSession
    sides = [[cut(spark.createDataFrame([(end,)], "id string"))] for end in (source, target)]
    seen, size = [sides[0][0], sides[1][0]], [1, 1]
    while True:
        k = 0 if size[0] <= size[1] else 1
        near = sides[k][-1].join(steps, F.col("id") == F.col("u")).select(F.col("v").alias("id")).distinct()
        new = cut(near.join(seen[k], "id", "left_anti"))
        size[k] = new.count()
        if not size[k]:
            return None
        sides[k].append(new)
        seen[k] = cut(seen[k].union(new)) if len(sides[k]) % 6 == 0 else seen[k].union(new)
        if not new.join(sides[1 - k][-1], "id", "left_semi").isEmpty():
            return sides[0], sides[1]


def shortest_path(g: Graph, source: str, target: str) -> DataFrame:
    """One row with ``path``, a shortest undirected path (ties: least ids from the target back); none if unconnected.

    The search goes from both ends, so it sees two balls of half the length and not the whole component. From where they
    meet, the target's side is thinned to the nodes that lie on a shortest path; then one step a level is taken.
    """
    spark = g.spark
    if source == target:
        return g.nodes.where(F.col("id") == source).select(F.array("id").alias("path")).limit(1)
    steps = neighbours(g.edges)
    met = _meet(steps, source, target)
    if met is None:
        return spark.createDataFrame([], "path array<string>")
    ahead, back = met
    good = [cut(back[-1].join(ahead[-1], "id", "left_semi"))]
    for level in reversed(back[1:-1]):
        on = good[-1].join(steps, F.col("id") == F.col("u")).select(F.col("v").alias("id"))
        good.append(cut(level.join(on, "id", "left_semi")))
    # A target without a level of its own is the meeting point.
    ways = [*reversed(good), *reversed(ahead[:-1])] if len(back) > 1 else list(reversed(ahead[:-1]))
    path = [target]
    for level in ways:
        near = steps.where(F.col("u") == path[-1]).select(F.col("v").alias("id"))
        path.append(level.join(near, "id", "left_semi").agg(F.min("id")).head()[0])
    return spark.createDataFrame([(path[::-1],)], "path array<string>")


def connected_components(g: Graph, edges: DataFrame | None = None) -> DataFrame:
    """(id, component) of every node; inferred edges connect too; edges to missing nodes do not."""
    e = g.edges if edges is None else edges
    ids = g.nodes.select("id").distinct()
    found = components(inside(e.where("source <> target").select("source", "target"), ids))
    return ids.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def components_total(g: Graph) -> DataFrame:
    """One row: the number of ``connected_components``, which are not told apart for it."""
    nodes, found = component_count(inside(g.edges.where("source <> target").select("source", "target"), g.nodes))
    return g.nodes.agg((F.count_distinct("id") - nodes + found).alias("components"))


def _reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Forward reach by label within groups: (id, group), from seeds (id, group) along edges (u, v) inside groups."""
    seen, frontier, at = seeds, seeds, 0
    while True:
        at += 1
        near = frontier.withColumnRenamed("id", "u").join(edges, "u").select(F.col("v").alias("id"), "group").distinct()
        new = cut(near.join(seen, ["id", "group"], "left_anti"))
        if new.isEmpty():
            return seen
        seen = seen.union(new)
        if at % 6 == 0:
            seen = cut(seen)
        frontier = new


def _coded(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) with numbers for names, and the names (id, name). The numbers are hashes; where two names share one,
    all are made anew from another seed."""
    for seed in count():
        code = lambda c: F.xxhash64(F.lit(seed), c)  # noqa: B023, E731
        ends = edges.select(F.col("u").alias("name")).union(edges.select("v"))
        names = cut(ends.distinct().select(code("name").alias("id"), "name"))
        if names.agg(F.count("*") == F.count_distinct("id")).head()[0]:
            return edges.select(code("u").alias("u"), code("v").alias("v")), names
        drop(names)


def _trimmed(e: DataFrame, rounds: int) -> tuple[DataFrame, bool]:
    """Edges without the nodes that have no way in or no way out, so many times over; and whether none is left."""
    for _ in range(rounds):
        ways = e.select(F.col("u").alias("id"), F.lit(1).alias("way")).union(e.select("v", F.lit(2)))
        ends = cut(ways.groupBy("id").agg(F.bit_or("way").alias("way")).where("way < 3"))
        if ends.isEmpty():
            return e, True
        # A node without a way in is no edge's v, one without a way out no edge's u.
        starts, stops = (ends.where(f"way = {way}").select(F.col("id").alias(c)) for way, c in ((1, "u"), (2, "v")))
        before, e = e, cut(e.join(starts, "u", "left_anti").join(stops, "v", "left_anti").select("u", "v"))
        drop(before, ends)
    return e, e.isEmpty()


def strong_components(edges: DataFrame) -> DataFrame:
    """Strongly connected groups of two nodes or more, and self loops: (id, component named by its least id).

    Trimming first: nodes without a way in or a way out leave, again and again. Every few rounds what remains is cut into
    undirected groups, and groups that are trees leave at once: a long chain goes whole, not a node a round. When nothing
    is left to trim, from a pivot of each group, forward and backward reach meet in one strong component; it leaves, and
    the rest goes another round. All that runs on numbers for names.
    """
    named = cut(edges.select(F.col("source").alias("u"), F.col("target").alias("v")).where("u is not null and v is not null"))
    loops = named.where("u = v").select(F.col("u").alias("id")).distinct().select("id", F.col("id").alias("component"))
    e, names = _coded(named.where("u <> v"))
    out, rounds, group = None, TRIMS, None
    while True:
        before = e
        e, done = _trimmed(e, rounds)
        if e.isEmpty():
            break
        if group is None or e is not before:
            group = components(e, "u", "v").withColumnRenamed("component", "group")
        if not done:
            edges = e.join(group.withColumnRenamed("id", "u"), "u").groupBy("group").agg(F.count("*").alias("m"))
            trees = cut(group.groupBy("group").agg(F.count("*").alias("n")).join(edges, "group").where("m < n").select("group"))
            gone = group.join(trees, "group", "left_semi").select(F.col("id").alias("u"))
            # Whole groups leave, so the others stay as they are.
            e, group, rounds = cut(e.join(gone, "u", "left_anti").select("u", "v")), cut(group.join(trees, "group", "left_anti")), 2 * rounds
            continue
        pivots = cut(group.groupBy("group").agg(F.min("id").alias("id")).select("id", "group"))
        ahead = _reach(e, pivots)
        behind = _reach(e.select(F.col("v").alias("u"), F.col("u").alias("v")), pivots)
        strong = cut(ahead.join(behind, ["id", "group"]))
        size = strong.groupBy("group").agg(F.count("*").alias("n"), F.min("id").alias("component")).where("n > 1")
        found = cut(strong.join(size, "group").select("id", "component"))
        out = found if out is None else out.union(found)
        gone = strong.select("id")
        e = cut(e.join(gone.withColumnRenamed("id", "u"), "u", "left_anti").join(gone.withColumnRenamed("id", "v"), "v", "left_anti").select("u", "v"))
        group = None
    if out is None:
        return loops
    told = cut(out.join(names, "id").select(F.col("name").alias("id"), "component"))
    told = told.join(told.groupBy("component").agg(F.min("id").alias("least")), "component").select("id", F.col("least").alias("component"))
    return told.union(loops.join(told.select("id"), "id", "left_anti"))


def round_trips(steps: DataFrame) -> DataFrame:
    """(id): the nodes that may lie on a cycle of steps (k, u, v) of one group k; others may be among them.

    In a group whose nodes have one way on, nodes jump twice as far each round, and those that come to an end leave. If
    none leaves in a round, none ever does, as whoever has an end has behind it one that is half as far from that end.
    Other groups go through their strong components.
    """
    now = cut(steps.where("u is not null and v is not null").distinct())
    every, size = now, now.count()
    forked = [r["k"] for r in now.groupBy("k", "u").count().where("count > 1").select("k").distinct().collect()]  # a row a group
    strong = [strong_components(now.where(F.col("k") == k).select(F.col("u").alias("source"), F.col("v").alias("target"))).select("id") for k in forked]
    if forked:
        now = now.where(~F.col("k").isin(*forked))
        size = now.count()
    while size:
        far = now.withColumnRenamed("v", "at").join(now.withColumnRenamed("u", "at"), ["at", "k"]).select("k", "u", "v")
        before, now = now, cut(far)
        if before is not every:
            drop(before)
        last, size = size, now.count()
        if size == last:
            break
    out = cut(reduce(DataFrame.union, [now.select(F.col("u").alias("id")), *strong]).distinct())
    drop(every, now)
    return out


def cycle_count(g: Graph) -> DataFrame:
    """One row: the number of strongly connected groups with a cycle in them."""
    return strong_components(g.direct()).agg(F.count_distinct("component").alias("cycles"))
