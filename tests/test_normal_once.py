"""A run normalizes an edge again only where a stage may have changed it, and stores no edges of a rewrite that loses nodes."""

from pyspark.sql import functions as F

from kgspark.operators.normalize import normalize
from kgspark.plans import finalize as plan
from kgspark.plans.graph import Graph, from_rows


def test_known_normal_graphs_pass(spark, tmp_path):
    g = from_rows(spark, [(x, x, "Instance") for x in "abcde"], [("1", "a", "b", "belongs to"), ("2", "b", "a", "has part"), ("3", "a", "c", ""), ("4", "b", "a", "related"), ("5", "a", "b", "related")])
    once = normalize(g)
    rows = lambda x: sorted(map(str, x.edges.collect()))
    assert rows(normalize(once)) == rows(normalize(Graph(once.nodes, once.edges)))
    assert "Window" not in normalize(once.stored()).edges._jdf.queryExecution().optimizedPlan().toString()

    def loses(x):
        return Graph(x.nodes.where("id < 'c'"), x.edges.withColumn("label", F.raise_error(F.lit("edges of it were stored")).cast("string")))

    out = plan.finalize(g, str(tmp_path / "run"), plan.Options(rewrites=(loses,)), strict=True)
    assert [r["status"] for r in out.log.where("name = 'rewrite 1'").collect()] == ["rolled back"]
    assert rows(Graph(out.graph.nodes, out.graph.edges.select("source", "target", "label"))) == rows(Graph(once.nodes, once.edges.select("source", "target", "label")))
