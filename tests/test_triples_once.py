"""Triples: repeats among edges and between node names and axioms leave; normalization is planned once."""

from kgspark.plans.graph import from_rows
from kgspark.sinks.exports import to_triples


def test_repeats_leave_and_edges_are_read_once(spark):
    nodes = [("a", "uses", "Instance"), ("b", "B", "Instance"), ("c", "B", "Class")]
    edges = [("1", "a", "b", "uses"), ("2", "a", "b", "new  word"), ("3", "a", "b", "new__word"), ("4", "a", "c", "type"), ("5", "a", "gone", "odd")]
    t = to_triples(from_rows(spark, nodes, edges))
    rows = [tuple(r) for r in t.collect()]
    assert len(rows) == len(set(rows))
    own = lambda s: s.rsplit("#", 1)[1]
    said = {(own(s), own(p), own(o)) for s, p, o, literal, _ in rows if not literal and "example.org" in o}
    assert {p for s, p, o in said if (s, o) == ("uses", "B")} >= {"uses"} and ("uses", "type", "B_2") in said
    assert not any("odd" in x for r in rows for x in r[:3])
    assert sum(1 for s, p, o, literal, _ in rows if literal and o == "uses") == 1
    assert t._jdf.queryExecution().optimizedPlan().toString().count("row_number") == 0
