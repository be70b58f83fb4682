"""Edit history against a plain undo stack, at every number; links of exported relations."""

import random

from pyspark.sql import functions as F

from kgspark.operators import history as H
from kgspark.plans.graph import cut, from_rows
from kgspark.sinks import exports


def plain(actions, keep, most):
    """Content after each action: (graph, seq) → dict."""
    out, of = {}, {}
    for g, seq, action, name, change in actions:
        hist, at, shots = of.setdefault(g, ([{}], 0, {}))
        if action in ("edit", "restore") and (action == "edit" or name in shots):
            new = {k: v for k, v in {**hist[at], **dict([change])}.items() if v is not None} if action == "edit" else dict(shots[name])
            hist = [*hist[: at + 1], new][-keep:]
            at = len(hist) - 1
        elif action == "undo":
            at = max(0, at - 1)
        elif action == "redo":
            at = min(at + 1, len(hist) - 1)
        elif action == "snapshot":
            shots.pop(name, None)
            shots[name] = hist[at]
            while len(shots) > most:
                del shots[next(iter(shots))]
        elif action == "forget":
            shots.pop(name, None)
        of[g] = hist, at, shots
        out[g, seq] = dict(hist[at])
    return out


def test_any_version_is_the_one_of_an_undo_stack(spark):
    rnd = random.Random(6)
    actions = []
    for g in ("a", "b", "c"):
        for seq in range(1, 61):
            kind = rnd.choices(H.ACTIONS, (8, 4, 3, 1, 1, 1))[0]
            actions.append((g, seq, kind, rnd.choice(["x", "y", "z"]), (rnd.choice("pqrs"), rnd.choice([None, str(seq), str(seq)]))))
    mixed = actions[:]
    rnd.shuffle(mixed)
    log = spark.createDataFrame([a[:4] for a in mixed], "graph string, seq long, action string, name string").repartition(3)
    changes = spark.createDataFrame([(g, s, "node", *c) for g, s, k, _, c in mixed if k == "edit"], "graph string, seq long, element string, id string, value string")
    for keep, most in ((60, 20), (5, 2)):
        want = plain(actions, keep, most)
        resolved = cut(H.resolve(log, keep, most))
        for number in (None, 23) if keep == 60 else (47,):
            upto = None if number is None else spark.createDataFrame([(g, number) for g in "abc"], "graph string, seq long")
            got = {}
            for r in H.version(resolved, changes, upto).collect():
                got.setdefault(r["graph"], {})[r["id"]] = r["value"]
            assert got == {g: want[g, number or 60] for g in "abc" if want[g, number or 60]}, (keep, number)
    assert H.resolve(log.limit(0)).count() == 0


def test_an_edit_behind_an_undo_drops_the_redo(spark):
    log = spark.createDataFrame([("g", k, a, None) for k, a in enumerate(["edit", "edit", "undo", "edit", "redo", "undo", "undo", "undo"], 1)], "graph string, seq long, action string, name string")
    got = {r["seq"]: (r["state"], r["parent"], r["redoable"]) for r in H.resolve(log).collect()}
    assert got == {1: (1, 0, 0), 2: (2, 1, 0), 3: (1, None, 1), 4: (4, 1, 0), 5: (4, None, 0), 6: (1, None, 1), 7: (0, None, 2), 8: (0, None, 2)}


def test_an_inverse_super_relation_is_exported_as_one(spark):
    g = from_rows(spark, [("a", "A", "Instance"), ("b", "B", "Instance")], [("1", "a", "b", "hatched from"), ("2", "b", "a", "hatches")])
    e = g.edges.withColumns({"super_relation": F.lit("part-of"), "super_inverse": F.col("id") == "1"})
    t = {tuple(r) for r in exports.to_triples(type(g)(g.nodes, e)).select("s", "p", "o").collect()}
    own = lambda x: exports.BASE + x
    below = {(s, o) for s, p, o in t if p == exports.RDFS + "subPropertyOf"}
    assert below == {(own("hatched_from"), own("inv-part-of")), (own("hatches"), own("part-of"))}
    assert (own("inv-part-of"), exports.OWL + "inverseOf", own("part-of")) in t and (own("part-of"), exports.RDF + "type", exports.OWL + "TransitiveProperty") in t
