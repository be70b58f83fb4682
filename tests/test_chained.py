"""Closing relations under which a node has one way on: a row a node, also round cycles; and no rule meets facts twice."""

from pyspark.sql import functions as F

from kgspark.operators import reason
from kgspark.operators.normalize import normalize
from kgspark.operators.reason import closure, entailed
from kgspark.plans.graph import from_rows


def told(df):
    return sorted((x.s, x.p, x.o, x.edge_id or "") for x in df.select("s", "p", "o", "edge_id").collect())


def test_a_row_a_node_and_cycles(spark, monkeypatch):
    rows = []
    whole = reason.cut

    def counted(df):
        out = whole(df)
        if "way" in out.columns:
            rows.append(out.count())
        return out

    monkeypatch.setattr(reason, "cut", counted)
    n = [(f"{k:02d}", "", "Instance") for k in range(30)]
    e = [(f"e{k:02d}", f"{k:02d}", f"{k + 1:02d}", "precedes") for k in range(19)] + [("r1", "20", "21", "precedes"), ("r2", "21", "22", "precedes"), ("r3", "22", "20", "precedes"), ("r4", "23", "20", "precedes")]
    g = normalize(from_rows(spark, n, e))
    assert told(entailed(g)) == told(closure(g))
    assert max(rows) == 23 and sum(rows) < 120


def test_rules_meet_once(spark, monkeypatch):
    met = []
    whole = reason._met
    monkeypatch.setattr(reason, "_met", lambda a, b, rules, thin=False: (met.append((thin, rules)), whole(a, b, rules, thin))[1])
    n = [(x, x, "Instance") for x in "abcdef"]
    e = [("1", "a", "b", "part-of"), ("2", "b", "c", "part-of"), ("3", "c", "d", "located-in"), ("4", "d", "e", "located-in"), ("5", "f", "a", "member-of")]
    g = normalize(from_rows(spark, n, e))
    assert told(entailed(g)) == told(closure(g))
    again = [r for thin, rules in met if thin for r in rules]
    assert set(again) == {("located-in",) * 3}


def test_normalized_edges_are_facts_without_a_shuffle(spark):
    g = normalize(from_rows(spark, [("a", "a", "Instance"), ("b", "b", "Instance")], [("1", "a", "b", "uses"), ("2", "a", "b", "utilizes")]))
    assert g.simple and not from_rows(spark, [("a", "a", "Class")], [("1", "a", "a", "uses")]).simple
    facts = reason.asserted(g.stored())
    assert "Aggregate" not in facts._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in facts.select("s", "p", "o", "edge_id").collect()] == [("a", "uses", "b", "1")]


def test_original_labels_stay(spark):
    g = from_rows(spark, [(x, x, "Class") for x in "abc"], [("1", "a", "b", "Uses"), ("2", "b", "c", "makes"), ("3", "a", "c", ""), ("4", "c", "a", "  odd ")])
    once = normalize(g)
    rows = lambda x: {r["id"]: (r["label"], r["original_label"]) for r in x.edges.collect()}
    assert rows(once) == {"1": ("uses", None), "2": ("produces", "makes"), "3": ("related-to", ""), "4": ("odd", None)}
    assert once.edges.where(F.col("label") == "odd").count() == 1
