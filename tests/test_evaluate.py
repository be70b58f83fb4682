"""Verdicts, metrics over several runs, and fact sets compared."""

from kgspark.operators import evaluate as E

ROWS = [
    ("1", "llm", ["a"], ["a"]), ("1", "rule", ["a", "b"], ["c"]), ("1", None, ["a"], []), ("1", "llm", None, ["x"]), ("1", None, [], None), ("1", None, None, []),
    ("2", "llm", ["a"], ["x", "a"]), ("2", "llm", ["b"], ["b"]), ("3", None, [], []),
]


def test_metrics_of_runs_and_over_them(spark):
    judged = E.verdicts(spark.createDataFrame(ROWS, "run string, method string, accept array<string>, got array<string>"))
    assert [r["verdict"] for r in judged.collect()] == ["correct", "wrong", "missed", "false link", "abstained", "abstained", "correct", "correct", "abstained"]
    got = {(r["grouping"], r["run"]): r for r in E.metrics(judged, [["run"], []]).collect()}
    one, two, three = (got["run", k] for k in "123")
    assert (one["precision"], one["recall"], one["abstention"], one["positives"], one["negatives"]) == (33.3, 33.3, 66.7, 3, 3)
    assert (two["precision"], two["recall"], two["abstention"]) == (100.0, 100.0, None) and (three["precision"], three["recall"], three["abstention"]) == (None, None, 100.0)
    assert (got["", None]["correct"], got["", None]["false_link"], got["", None]["abstained"]) == (3, 1, 3)
    over = {r["metric"]: (r["mean"], r["least"], r["most"], r["runs"]) for r in E.over_runs(E.metrics(judged, [["run"]])).collect()}
    assert over == {"precision": (66.7, 33.3, 100.0, 2), "recall": (66.7, 33.3, 100.0, 2), "abstention": (83.4, 66.7, 100.0, 2)}
    assert {(r["run"], r["method"], r["links"]) for r in E.methods(judged, ["run"]).collect()} == {("1", "llm", 2), ("1", "rule", 1), ("2", "llm", 2)}
    assert E.failures(judged).count() == 3
    assert E.over_runs(E.metrics(judged.limit(0), [["run"]])).count() == 0


def test_a_core_relation_is_no_link(spark):
    rows = [(["core:uses"], ["core:uses"], False), (["P1"], ["core:uses"], False), ([], ["core:uses"], False), ([], ["P1"], True)]
    judged = E.verdicts(spark.createDataFrame(rows, "accept array<string>, got array<string>, linked boolean"))
    assert [r["verdict"] for r in judged.collect()] == ["correct", "missed", "abstained", "false link"]


def test_fact_sets(spark):
    facts = lambda *x: spark.createDataFrame([tuple(f.split()) for f in x], "s string, p string, o string")
    found = E.differences(facts("a r b", "a r b", "b r c", "x q y"), facts("a r b", "c r d", "d r e"))
    assert sorted(map(tuple, found.collect())) == [("both", "a", "r", "b"), ("extra", "b", "r", "c"), ("extra", "x", "q", "y"), ("missing", "c", "r", "d"), ("missing", "d", "r", "e")]
    got = {r["p"]: r for r in E.agreement(found, examples=2).collect()}
    assert (got["r"]["soundness"], got["r"]["completeness"], got["r"]["examples"]) == (50.0, 33.3, ["extra b r c", "missing c r d"])
    assert (got["q"]["soundness"], got["q"]["completeness"]) == (0.0, None) and got[None]["total"] and got[None]["missing"] == 2
