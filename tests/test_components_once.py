"""Components hold an edge once, and edges are not moved to find the few ends that are no nodes."""

from kgspark.plans import graph as plans
from kgspark.plans.graph import from_rows


def test_an_edge_is_held_once(spark, monkeypatch):
    held = []
    whole = plans.cut

    def counted(df):
        out = whole(df)
        held.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(plans, "cut", counted)
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(0, 40, 2)] + [("b", "a"), ("a", "b"), ("a", "a"), (None, "a"), ("x", None)], "source string, target string")
    got = {r["id"]: r["component"] for r in plans.components(edges).collect()}
    assert got == {"a": "a", "b": "a"} | {f"n{k}": min(f"n{k - k % 2}", f"n{k - k % 2 + 1}") for k in range(40)}
    assert held[0] == (["u", "v"], 22)


def test_inside(spark):
    g = from_rows(spark, [("a", "A", "Class"), ("b", "B", "Class")], [("1", "a", "b", "x"), ("2", "a", "gone", "x"), ("3", "gone", "b", "x"), ("4", None, "b", "x"), ("5", "a", None, "x")])
    assert [r["id"] for r in plans.inside(g.edges, g.nodes).collect()] == ["1"]
