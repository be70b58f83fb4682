"""Shortest paths from both ends against plain breadth-first search, and how little of the graph they see."""

import random
from collections import deque

from pyspark.sql import functions as F

from kgspark.operators import graph as ga
from kgspark.plans.graph import from_rows, graph


def plain(edges, a, b):
    """Distances from a, then least ids from b back."""
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    far, queue = {a: 0}, deque([a])
    while queue:
        u = queue.popleft()
        for v in near.get(u, ()):
            if v not in far:
                far[v] = far[u] + 1
                queue.append(v)
    if b not in far:
        return []
    path = [b]
    while path[-1] != a:
        path.append(min(v for v in near[path[-1]] if far[v] == far[path[-1]] - 1))
    return [path[::-1]]


def test_paths_and_ties_against_plain_search(spark):
    rnd = random.Random(3)
    names = [f"n{k:02}" for k in range(40)]
    edges = [(rnd.choice(names), rnd.choice(names)) for _ in range(44)] + [("p0", "p1"), ("n00", "n00")]
    g = from_rows(spark, [(x, x, "Instance") for x in [*names, "p0", "p1", "alone"]], [(f"e{k}", u, v, "x") for k, (u, v) in enumerate(edges)])
    ends = [("n00", "n01"), ("n02", "n30"), ("n05", "n33"), ("p0", "p1"), ("n00", "p0"), ("n00", "alone"), edges[0]]
    for a, b in ends:
        assert [r["path"] for r in ga.shortest_path(g, a, b).collect()] == (plain(edges, a, b) if a != b else [[a]]), (a, b)
    assert [r["path"] for r in ga.shortest_path(g, "n00", "n00").collect()] == [["n00"]]


def test_both_ends_see_little_of_a_wide_graph(spark):
    """Two trees of 8 children a node that meet at their leaves' first: from one end alone all 70,000 nodes would be seen."""
    n = (8**6 - 1) // 7
    child = spark.range(1, n).select(F.col("id").alias("c"), F.expr("(id - 1) div 8").alias("p"))
    tree = lambda t: child.select(F.concat(F.lit(t), "c").alias("source"), F.concat(F.lit(t), "p").alias("target"))
    bridge = spark.createDataFrame([("a1", "b1")], "source string, target string")
    e = tree("a").union(tree("b")).union(bridge).withColumn("id", F.concat("source", F.lit("-"), "target")).withColumn("label", F.lit("x"))
    nodes = e.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    g = graph(nodes, e)
    ahead, back = ga._meet(ga.neighbours(g.edges), "a1", "b2")
    assert sum(x.count() for x in ahead + back) < 200
    assert ga.shortest_path(g, "a1", "b2").head()["path"] == ["a1", "b1", "b0", "b2"]
