"""Components are counted without telling them apart."""

import random

from pyspark.sql import functions as F

from kgspark.operators import graph as ga
from kgspark.plans.graph import component_count, from_rows


def test_count(spark):
    r = random.Random(3)
    for n, m in ((60, 40), (60, 90), (5, 0)):
        edges = [(f"e{k}", f"{r.randrange(n):02d}", f"{r.randrange(n + 3):02d}", "x") for k in range(m)] + [("l", "00", "00", "x")]
        g = from_rows(spark, [(f"{k:02d}", "", "Class") for k in range(n)], edges)
        want = ga.connected_components(g).agg(F.count_distinct("component")).head()[0]
        assert ga.components_total(g).head()["components"] == want
    chain = spark.range(40).select(F.format_string("%02d", "id").alias("source"), F.format_string("%02d", F.col("id") + 1).alias("target"))
    assert component_count(chain) == (41, 1)


def test_groups_are_told_once(spark, monkeypatch):
    """Trees leave as whole groups, and the groups that stay are not looked for again."""
    calls = []
    whole = ga.components
    monkeypatch.setattr(ga, "components", lambda *a: (calls.append(1), whole(*a))[1])
    monkeypatch.setattr(ga, "TRIMS", 1)
    edges = [(f"c{k:02d}", f"c{k + 1:02d}") for k in range(20)] + [("a", "b"), ("b", "a")]
    got = ga.strong_components(spark.createDataFrame(edges, "source string, target string"))
    assert {(r["id"], r["component"]) for r in got.collect()} == {("a", "a"), ("b", "a")}
    assert len(calls) == 1
