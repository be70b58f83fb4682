"""Normalization of the edges of some labels only: the others leave before nodes are met, and nothing else changes."""

import pytest

from kgspark.operators import normalize as N
from kgspark.plans.graph import Graph, from_rows

NODES = [("a", "A", "Class"), ("b", "B", "Class"), ("i", "I", "Instance"), ("j", "J", "Instance"), ("l", "3", "Literal")]
EDGES = [
    ("e1", "a", "b", "is-a"), ("e2", "i", "a", "is-a"), ("e3", "i", "j", "type"), ("e4", "i", "j", "same as"), ("e5", "a", "b", "equivalent"),
    ("e6", "i", "j", "made by"), ("e7", "j", "i", "makes"), ("e8", "i", "j", ""), ("e9", "j", "i", "related"), ("f1", "i", "j", "likes"),
    ("f2", "i", "gone", "part of"), ("f3", "i", "l", " likes "), ("f4", "i", "i", "uses"), ("f5", "i", "j", None),
]
COLUMNS = ("id", "source", "target", "label", "relation", "original_label", "normalization_note")


@pytest.mark.parametrize("labels, literals", ((["related-to", "likes", "part-of", "owl:sameAs"], 100), (["rdf:type", "produces", "owl:equivalentClass"], 1)))
def test_some_labels_as_all_then_filtered(spark, monkeypatch, labels, literals):
    monkeypatch.setattr(N, "LITERALS", literals)
    g = from_rows(spark, NODES, EDGES)
    rows = lambda df: sorted(map(str, df.select(*COLUMNS).collect()))
    whole = N.normalize(g).edges
    assert rows(N.normalize(g, labels=labels).edges) == rows(whole.where(whole["label"].isin(*labels)))


def test_edges_of_other_labels_are_not_read(spark):
    g = from_rows(spark, NODES, EDGES)
    odd = g.edges.where("label <> 'part of'").unionByName(g.edges.where("label = 'part of'").selectExpr("raise_error('read') as id", *g.edges.columns[1:]))
    got = N.normalize(Graph(g.nodes, odd), labels=["produces"]).edges
    assert {r["id"] for r in got.select("id").collect()} == {"e6"}
