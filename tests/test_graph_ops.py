"""Fixtures of the graph operators with exact expected rows."""

import pytest
from pyspark.sql import functions as F

from kgspark.functions import vocabulary as V
from kgspark.operators import chunks, dedup, explore, kb, link, merge, repair, retrieve, rules, score
from kgspark.operators import graph as ga
from kgspark.operators.normalize import normalize
from kgspark.operators.reason import closure, materialize
from kgspark.operators.validate import analyze
from kgspark.plans import patterns
from kgspark.plans.graph import Graph, cut, from_rows, graph
from kgspark.sinks import exports
from kgspark.sources import graphs

# A port: kinds of ships, one ship with its parts, a sailor and where the fleet lies.
PORT_NODES = [(x, x, "Class") for x in ("vessel", "ship", "tanker", "gas-tanker", "building")] + [
    (x, x, "Instance") for x in ("aurora", "hull", "plate", "mara", "watch", "fleet", "quay", "bergen")
]
PORT_EDGES = [
    ("p1", "gas-tanker", "tanker", "subclass of"), ("p2", "tanker", "ship", "kind of"), ("p3", "ship", "vessel", "is-a"), ("p4", "aurora", "gas-tanker", "instance of"),
    ("p5", "plate", "hull", "component of"), ("p6", "aurora", "hull", "has component"), ("p7", "mara", "watch", "is a member of"), ("p8", "watch", "fleet", "belongs to"),
    ("p9", "fleet", "quay", "situated in"), ("p10", "quay", "bergen", "located at"), ("p11", "ship", "building", "mutually exclusive"),
]


def port(spark, nodes=(), edges=()):
    return from_rows(spark, [*PORT_NODES, *nodes], [*PORT_EDGES, *edges])


def triples(df):
    return {(r.s, r.p, r.o) for r in df.select("s", "p", "o").collect()}


def codes(issues):
    return {r.code for r in issues.select("code").collect()}


def test_port_closure(spark):
    g, facts, issues = analyze(port(spark))
    facts = cut(facts)
    new = {(r["s"], r["p"], r["o"]) for r in facts.where("edge_id is null and s <> o").collect()}
    assert new == {
        ("gas-tanker", V.SUBCLASS, "ship"), ("gas-tanker", V.SUBCLASS, "vessel"), ("tanker", V.SUBCLASS, "vessel"),
        *(("aurora", V.TYPE, x) for x in ("tanker", "ship", "vessel")), ("plate", "part-of", "aurora"), ("mara", "member-of", "fleet"),
        ("watch", "located-in", "quay"), ("watch", "located-in", "bergen"), ("fleet", "located-in", "bergen"), ("building", V.DISJOINT, "ship"),
    }
    row = materialize(g, facts).where("source = 'plate' and target = 'aurora'").head()
    assert (row["rule"], row["premises"], row["mirror"]) == ("prp-trp", ["p5", "p6"], False)
    assert issues.where("severity = 'error'").count() == 0


def test_closure_of_random_graphs_against_a_plain_fixpoint(spark):
    import random

    rnd = random.Random(17)
    meet = {
        (V.SUBCLASS, V.SUBCLASS): V.SUBCLASS, ("part-of", "part-of"): "part-of", ("located-in", "located-in"): "located-in", ("precedes", "precedes"): "precedes",
        ("member-of", "part-of"): "member-of", ("part-of", "located-in"): "located-in", (V.TYPE, V.SUBCLASS): V.TYPE,
    }
    for _ in range(2):
        nodes = [(f"c{k}", f"c{k}", "Class") for k in range(5)] + [(f"i{k}", f"i{k}", "Instance") for k in range(7)]
        edges = []
        for k in range(26):
            label = rnd.choice([V.SUBCLASS, V.TYPE, "part-of", "located-in", "member-of", "precedes", "related-to"])
            s, o = {V.SUBCLASS: "cc", V.TYPE: "ic"}.get(label, "ii")
            edges.append((str(k), f"{s}{rnd.randrange(5)}", f"{o}{rnd.randrange(5)}", label))
        n = normalize(from_rows(spark, nodes, edges))
        want = {(r["source"], r["label"], r["target"]) for r in n.edges.collect()}
        while True:
            more = {(a, meet[p, q], d) for a, p, b in want for c, q, d in want if b == c and (p, q) in meet} | {(o, p, s) for s, p, o in want if p == "related-to"}
            if more <= want:
                break
            want |= more
        assert {t for t in triples(closure(n)) if t[0] != t[2]} == {t for t in want if t[0] != t[2]}


def test_symmetric_mirror_and_two_steps(spark):
    people = [(x, x, "Instance") for x in ("ann", "bo", "cy")]
    n = normalize(from_rows(spark, people, [("k1", "bo", "ann", "associated with"), ("k2", "ann", "cy", "uses")]))
    row = materialize(n, closure(n)).collect()
    assert [(r["source"], r["target"], r["rule"], r["mirror"], r["premises"]) for r in row] == [("ann", "bo", "prp-symp", True, ["k1"])]
    n = normalize(from_rows(spark, people, [("k1", "bo", "ann", "before"), ("k2", "cy", "ann", "follows")]))
    assert [(r["source"], r["label"], r["target"]) for r in materialize(n, closure(n)).collect()] == [("bo", "precedes", "cy")]


def test_cycle_disjoint_unsatisfiable(spark):
    ring = [("1", "mon", "tue", "precedes"), ("2", "tue", "wed", "before"), ("3", "wed", "thu", "prior to"), ("4", "thu", "mon", "precedes"), ("5", "mon", "sun", "precedes")]
    _, _, issues = analyze(from_rows(spark, [(x, x, "Instance") for x in ("mon", "tue", "wed", "thu", "sun")], ring))
    rows = issues.where("code = 'cycle'").collect()
    assert [(r["severity"], r["node_ids"], r["edge_ids"]) for r in rows] == [("error", ["mon", "thu", "tue", "wed"], ["1", "2", "3", "4"])]
    houseboat = [("x", "houseboat", "tanker", "is-a"), ("y", "houseboat", "building", "is-a"), ("z", "nina", "gas-tanker", "type"), ("w", "nina", "building", "type")]
    _, _, issues = analyze(port(spark, [("houseboat", "houseboat", "Class"), ("nina", "nina", "Instance")], houseboat))
    found = issues.where("code in ('disjoint_violation', 'unsatisfiable_class')").collect()
    assert {(r["code"], r["node_ids"][0]) for r in found} == {("disjoint_violation", "nina"), ("unsatisfiable_class", "houseboat")}


def test_structural_codes(spark):
    nodes = [("a", "a", "Instance"), ("b", "b", "Instance"), ("l", "1", "Literal"), ("o", "o", "Instance"), ("c", "c", "Class")]
    edges = [("1", "a", "b", "part-of"), ("2", "b", "a", "has part"), ("3", "a", "a", "uses"), ("4", "a", "gone", "uses"), ("5", "l", "a", "uses"), ("6", "a", "b", "is-a"), ("7", "c", "l", "type"), ("8", "a", "b", "admires")]
    _, _, issues = analyze(from_rows(spark, nodes, edges))
    assert codes(issues) >= {"duplicate_edge", "self_loop", "dangling_edge", "orphan_node", "literal_source", "type_target_not_class", "relation_downgraded", "custom_relation"}


def test_labels(spark):
    i = ("Instance", "Instance")
    cases = [
        ("type of", "Class", "Class", V.SUBCLASS, False), ("kind of", "Instance", "Class", V.TYPE, False), ("alias", *i, V.SAME_AS, False), ("별칭", "Class", "Class", V.EQUIVALENT, False),
        ("was a component of", *i, "part-of", False), ("Situated_In", *i, "located-in", False), ("consists-of", *i, "part-of", True), ("developed by", *i, "produces", True),
        ("is the cause", *i, "causes", False), ("are needed by", *i, "depends-on", True), ("Takes Part In", *i, "participates-in", False),
        # An ending, active and passive; a particle in front; a particle behind; two edits; a noun form.
        ("활용한다", *i, "uses", False), ("초래했다", *i, "causes", False), ("포함됩니다", *i, "part-of", False), ("요구된다", *i, "depends-on", False), ("참여하고 있다", *i, "participates-in", False),
        ("에서 소재", *i, "located-in", False), ("연관이 있다", *i, "related-to", False), ("부품입니다", *i, "part-of", False), ("기인이다", *i, "causes", True), ("멤버이에요", *i, "member-of", False), ("다음에 발생", *i, "precedes", True),
        *((x, *i, "custom", False) for x in ("부럽다", "읽은 책", "가르친 제자", "모르는 사이", "admires")), ("  ", *i, "related-to", False), (None, *i, "related-to", False),
    ]
    from kgspark.operators.normalize import resolve_labels

    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, label string, source_type string, target_type string, want string, turn boolean")
    bad = resolve_labels(df).where("relation <> want or flipped <> turn").collect()
    assert not bad and resolve_labels(df).count() == len(cases)


def test_normalize_is_idempotent_and_first_wins(spark):
    g = from_rows(spark, [("a", "a", "Instance"), ("b", "b", "Instance")], [("1", "a", "b", "part-of"), ("2", "b", "a", "has part"), ("3", "b", "a", "related"), ("4", "a", "b", "related")])
    once = normalize(g)
    rows = lambda x: sorted((r["id"], r["source"], r["target"], r["label"]) for r in x.edges.collect())
    assert rows(once) == [("1", "a", "b", "part-of"), ("3", "b", "a", "related-to")] == rows(normalize(once))


# An orchestra: a string of a violin of a section of the orchestra, its maker and its kind.
HALL_NODES = [(x, x.title(), "Instance") for x in ("string", "violin", "section", "orchestra", "luthier", "hall")] + [(x, x.title(), "Class") for x in ("fiddle", "instrument", "thing")]
HALL_EDGES = [
    ("h1", "string", "violin", "part of"), ("h2", "violin", "section", "belongs to"), ("h3", "section", "orchestra", "component of"), ("h4", "luthier", "violin", "makes"),
    ("h5", "orchestra", "hall", "situated in"), ("h6", "violin", "fiddle", "instance of"), ("h7", "fiddle", "instrument", "subclass of"), ("h8", "instrument", "thing", "subclass of"),
]


def ids(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "id string")


def test_paths_facts_and_proofs(spark):
    n = normalize(from_rows(spark, HALL_NODES, HALL_EDGES))
    facts = cut(closure(n))
    found = explore.paths(facts, ids(spark, "string"), ids(spark, "orchestra")).collect()
    assert (found[0]["hops"], found[0]["inferred_steps"], found[0]["nodes"]) == (1, 1, ["string", "orchestra"]) and ["string", "violin", "section", "orchestra"] in [r["nodes"] for r in found]
    told = facts.where("round = 0")
    text = explore.rendered(explore.paths(told, ids(spark, "section"), ids(spark, "luthier")), n.nodes).head()
    assert text["text"] == "Section ←part-of— Violin ←produces— Luthier" and text["backward_steps"] == 2
    assert explore.paths(facts, ids(spark, "hall"), ids(spark, "string"), directed=True).count() == 0
    assert explore.paths(facts, ids(spark, "luthier"), ids(spark, "hall"), relations=["produces"]).count() == 0
    assert [explore.paths(told, ids(spark, "string"), ids(spark, "luthier"), max_hops=h).count() for h in (1, 2)] == [0, 1]
    about = explore.facts_about(facts, ids(spark, "violin"), V.TYPE, "out").collect()
    assert {(r["o"], r["inferred"]) for r in about} == {("fiddle", False), ("instrument", True), ("thing", True)}
    ways = {d: explore.facts_about(facts, ids(spark, "section"), "part-of", d).count() for d in ("out", "in", "both")}
    assert ways == {"out": 1, "in": 2, "both": 3}
    ev = explore.evidence(facts).where("s = 'violin' and o = 'hall'").head()
    assert ev["edges"] == ["h2", "h3", "h5"]
    proof = explore.derivation(facts, facts.where("s = 'string' and o = 'section'")).collect()
    assert {(r["depth"], r["edge_id"]) for r in proof} == {(0, None), (1, "h1"), (1, "h2")}


def test_path_in_a_dense_graph(spark):
    nodes = [(str(k), str(k), "Instance") for k in range(12)]
    edges = [(f"{a}-{b}", str(a), str(b), "related-to") for a in range(12) for b in range(a + 1, 12)]
    found = explore.paths(closure(normalize(from_rows(spark, nodes, edges))), ids(spark, "0"), ids(spark, "1"), max_hops=3, max_paths=5).collect()
    assert len(found) == 5 and found[0]["hops"] == 1


def test_resolve_tiers(spark):
    n = spark.createDataFrame([("a", "Big Cat", ["tiger"], None), ("b", "Catalog", None, "Q7")], "id string, label string, aliases array<string>, wikidata_id string")
    q = spark.createDataFrame([(x,) for x in ("tiger", "big-cat", "Q7", "talo", "a", "zzz")], "query string")
    assert {(r["query"], r["id"]) for r in explore.resolve(n, q).collect()} == {("tiger", "a"), ("big-cat", "a"), ("Q7", "b"), ("talo", "b"), ("a", "a")}


def test_graph_algorithms(spark):
    g = from_rows(spark, [(x, x, "Instance") for x in "abcdefg"], [("1", "a", "b", "x"), ("2", "b", "c", "x"), ("3", "c", "a", "x"), ("4", "c", "d", "x"), ("5", "e", "e", "x"), ("6", "f", "a", "x")])
    assert {r["id"]: r["degree"] for r in ga.degree(g).collect()} == {"a": 3, "b": 2, "c": 3, "d": 1, "e": 2, "f": 1, "g": 0}
    assert [r["id"] for r in ga.isolated(g).collect()] == ["g"]
    assert ga.shortest_path(g, "f", "d").head()["path"] == ["f", "a", "c", "d"] and ga.shortest_path(g, "f", "g").count() == 0
    assert ga.shortest_path(g, "a", "a").head()["path"] == ["a"]
    assert {r["id"]: r["component"] for r in ga.connected_components(g).collect()} == {**{x: "a" for x in "abcdf"}, "e": "e", "g": "g"}
    assert {(r["id"], r["component"]) for r in ga.strong_components(g.edges).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("e", "e")}
    near = ga.khop(g, ids(spark, "d"), 1)
    assert {r["id"] for r in near.nodes.collect()} == {"c", "d"} and [r["id"] for r in near.edges.collect()] == ["4"]


def test_strong_components_against_reachability(spark):
    import random

    random.seed(5)
    for _ in range(2):
        e = {(random.randrange(25), random.randrange(25)) for _ in range(40)}
        reach = {a: {a} for a in range(25)}
        for _ in range(25):
            for a, b in e:
                for s in reach.values():
                    if a in s:
                        s.add(b)
        want = {}
        for a in range(25):
            same = [b for b in range(25) if b in reach[a] and a in reach[b]]
            if len(same) > 1 or (a, a) in e:
                want[str(a)] = min(map(str, same))
        df = spark.createDataFrame([(str(a), str(b)) for a, b in e], "source string, target string")
        assert {r["id"]: r["component"] for r in ga.strong_components(df).collect()} == want


def test_rules_fold_in_order(spark):
    g = from_rows(spark, [("a", "A", "Class"), ("b", "B", "Class"), ("x", "x", "Instance"), ("y", "y", "Instance")], [("1", "x", "y", "knows")])
    rs = [
        {"type": "domain", "id": "1", "active": True, "edgeLabel": "Knows", "domainClass": "a"}, {"type": "equivalentClass", "id": "2", "active": True, "leftClass": "A", "rightClass": "B"},
        {"type": "inverse", "id": "3", "active": False}, {"type": "custom", "id": "4", "active": True},
    ]
    got = {(r["source"], r["target"], r["label"], r["rule_id"]) for r in rules.apply_rules(g, rs).collect()}
    assert got == {("x", "a", V.TYPE, "1"), ("a", "b", V.EQUIVALENT, "2"), ("b", "a", V.EQUIVALENT, "2"), ("x", "b", V.TYPE, "2")}
    assert rules.apply_rules(g, []).count() == 0 and rules.check_rules(g, []).count() == 0


def test_knowledge_base(spark):
    def g(nodes, edges):
        n = spark.createDataFrame(nodes, "id string, label string, type string, wikidata_id string, properties array<struct<key:string,value:string>>")
        return graph(n, spark.createDataFrame(edges, "id string, source string, target string, label string"))

    run1 = g([("a", "Nordbank", "Instance", "Q11", []), ("b", "Ines Vale", "Instance", None, []), ("c", "Ledger 9", "Instance", None, []), ("d", "Account book", "Class", None, []), ("e", "Oslo", "Instance", None, [])],
             [("1", "b", "a", "member of"), ("2", "a", "c", "makes"), ("3", "c", "d", "is-a"), ("4", "a", "e", "located in")])
    run2 = g([("x", "The North Bank", "Instance", "Q11", []), ("y", "ines vale", "Instance", None, [("born", "1970")]), ("z", "Riverside Choir", "Instance", None, []), ("d", "Account book", "Instance", None, [])],
             [("1", "y", "z", "is a member of"), ("2", "y", "x", "member of")])
    one = kb.ingest(kb.KnowledgeBase.empty(spark), run1, "s1")
    assert one.report().head().asDict() == {"nodes_added": 5, "nodes_merged": 0, "edges_added": 4, "edges_existing": 0, "conflicts": 0}
    two = kb.ingest(one.kb, run2, "s2", created=1)
    assert {(r["label"], r["how"]) for r in two.id_map.where("how <> 'new'").collect()} == {("The North Bank", "wikidata"), ("ines vale", "label")}
    assert two.report().head().asDict() == {"nodes_added": 2, "nodes_merged": 2, "edges_added": 1, "edges_existing": 1, "conflicts": 0}
    assert kb.stats(kb.delete_source(two.kb, "s2")).head().asDict() == {"nodes": 5, "linked": 1, "edges": 4, "sources": 1}
    seed = kb.search(two.kb, "Riverside").select("id")
    names = lambda h: {r["label"] for r in two.kb.nodes.join(kb.neighbourhood(two.kb, seed, h), "id").collect()}
    assert names(1) == {"Riverside Choir", "Ines Vale"} and "Nordbank" in names(2)
    twins = kb.ingest(kb.KnowledgeBase.empty(spark), g([("a", "Lind", "Instance", "Q1", []), ("b", "Lind", "Instance", "Q2", [])], [("1", "a", "b", "x")]), "m")
    assert twins.kb.nodes.count() == 2
    p1 = kb.ingest(kb.KnowledgeBase.empty(spark), g([("a", "Tower", "Instance", None, [("floors", "12")])], [("1", "a", "a", "x")]), "1").kb
    assert [(r["key"], r["kept"], r["refused"]) for r in kb.ingest(p1, g([("a", "tower", "Instance", None, [("floors", "14")])], [("1", "a", "a", "x")]), "2").conflicts.collect()] == [("floors", "12", "14")]


def test_repair(spark):
    g = from_rows(spark, [(x, x, "Instance") for x in ("attic", "house", "street")], [("r1", "attic", "house", "part-of"), ("r2", "house", "attic", "part-of"), ("r3", "house", "street", "part-of")])
    fixed, report = repair.repair(g, lambda message, options: "r2")
    assert {r["id"] for r in fixed.edges.collect()} == {"r1", "r3"} and report[0]["status"] == "removed"


def test_display_form_of_labels(spark):
    rows = [("  sub-class   of\tall", "Class", "Sub-Class Of All"), ("o'neil (2nd) x_y", "Class", "O'Neil (2nd) X_y"), ("élan vital", "Class", "éLan Vital"), (" new   york city", "Instance", "New york city"), ("'12'", "Literal", "12"), ("a  b", "Other", "a b"), ("é" * 1_000_005, "Class", "é" * 1_000_005), ("e" * 1_000_005, "Instance", "E" + "e" * 1_000_004), ("", "Class", "")]
    df = spark.createDataFrame([(str(k), *r) for k, r in enumerate(rows)], "id string, label string, type string, want string")
    got = {r["id"]: r["label"] for r in dedup.normalized_labels(df).collect()}
    assert got == {str(k): r[2] for k, r in enumerate(rows)}


def test_scores_of_an_empty_graph(spark):
    g = from_rows(spark, [], [])
    assert [f(g).head()["score"] for f in (score.structure, score.ontology, score.completeness, score.cognition)] == [0, 0, 0, 0]


def test_similar_against_all_pairs(spark):
    import random

    random.seed(3)
    labels = {"".join(random.choice("abc") for _ in range(random.randrange(2, 13))) for _ in range(90)}
    df = spark.createDataFrame([(x, x, "Class") for x in labels], "id string, label string, type string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {(a, b) for a in labels for b in labels if a < b and 1 - distance(a, b) / max(len(a), len(b)) >= 0.75}
    assert {(r["a"], r["b"]) for r in dedup.similar(df).collect()} == want and want


def test_merge_and_links(spark):
    parts = spark.createDataFrame([(0, "1", "Cat", "Class", "", [("k", "1")]), (1, "9", "cat", "Class", "an animal", [("k", "2"), ("j", "3")]), (1, "8", "Dog", "Class", None, None)],
                                  "part int, id string, label string, type string, description string, properties array<struct<key:string,value:string>>")
    edges = spark.createDataFrame([(1, "9", "Dog", "likes"), (1, "cat", "8", "LIKES"), (1, "9", "9", "x")], "part int, source string, target string, label string")
    m = merge.merge_graphs(parts, edges)
    assert {(r["label"], r["description"], tuple(map(tuple, r["properties"]))) for r in m.nodes.collect()} == {("Cat", "an animal", (("k", "1"), ("j", "3"))), ("Dog", "", ())}
    assert m.edges.count() == 1
    props = spark.createDataFrame([("P1", {"en": "invented by"}, {"en": "x"}, None, ["P2"], [], False), ("P2", {"en": "made"}, {}, None, [], [], True)],
                                  "id string, label map<string,string>, description map<string,string>, aliases map<string,array<string>>, super array<string>, inverse array<string>, transitive boolean")
    g = normalize(from_rows(spark, [("a", "a", "Instance"), ("b", "b", "Instance")], [("1", "a", "b", "Invented By")]))
    links = link.choose(link.candidates(g, props), props, None)
    mapping = retrieve.core_mapping(props, spark.createDataFrame([("P2", "produces", True)], "id string, relation string, flipped boolean"))
    e = link.apply_links(g, links, props, mapping).edges.head()
    assert (e["wikidata"]["id"], e["super_relation"], e["super_inverse"]) == ("P1", "produces", True)


def test_text_sources_and_chunks(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(1200)))), (2, ""), (3, None), (4, "a b")], "doc_id long, text string")
    got = {(r["doc_id"], r["chunk"]): r["text"] for r in chunks.word_chunks(df).collect()}
    assert got[1, 0].split() == list(map(str, range(1150))) and got[1, 1].split() == list(map(str, range(995, 1200))) and got[4, 0] == "a b"
    lines = spark.createDataFrame([('<x:a> <x:p> "q\\"t"@en .',), ("<x:a> <x:k> <x:b> .",), ("# no",)], "value string")
    t = graphs.parse_ntriples(lines)
    assert {(r["s"], r["p"], r["o"], r["literal"], r["lang"]) for r in t.collect()} == {("x:a", "x:p", 'q"t', True, "en"), ("x:a", "x:k", "x:b", False, None)}


def test_triples_round_trip(spark):
    g = from_rows(spark, [("1", "Mercury", "Instance"), ("2", "Mercury", "Instance"), ("3", "Planet", "Class"), ("4", "사람", "Class")], [("a", "1", "3", "is-a"), ("b", "1", "2", "part of")])
    t = exports.to_triples(g)
    assert exports.unique_locals(g.nodes).select("local").distinct().count() == 4
    assert t.where(F.col("p").endswith("label") & (F.col("o") == "사람")).head()["lang"] == "ko"
    back = graphs.from_triples(graphs.parse_ntriples(exports.ntriples(t)))
    assert sorted(r["label"] for r in back.nodes.collect()) == ["Mercury", "Mercury", "Planet", "사람"]
    assert {r["label"] for r in back.edges.where("label in ('rdf:type', 'part-of')").collect()} == {"rdf:type", "part-of"}


def test_patterns(spark):
    t = spark.createDataFrame([("a", "p", "b"), ("b", "p", "c"), ("c", "p", "a"), ("a", "q", "x")], "s string, p string, o string")
    assert patterns.select(t, [("?x", "p+", "?y")]).count() == 9
    rows = patterns.select(t, [("?x", "p", "?y")], optional=[[("?x", "q", "?z")]]).collect()
    assert {(r["x"], r["y"], r["z"]) for r in rows} == {("a", "b", "x"), ("b", "c", None), ("c", "a", None)}
    assert {r["x"] for r in patterns.select(t, [("?x", "p", "?y")], minus=[[("?x", "q", "?z")]]).collect()} == {"b", "c"}


def test_graph_with_shared_result_under_other_partitioning(spark):
    g = port(spark)
    a = triples(closure(normalize(g)))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert triples(closure(normalize(Graph(g.nodes, g.edges.repartition(3))))) == a
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_core_mapping_searches_whole_chains_and_ends_on_cycles(spark):
    supers = [(f"P{k}", [f"P{k + 1}"]) for k in range(12)] + [("P12", [])] + [("Q1", ["Q2"]), ("Q2", ["Q1"])]
    table = spark.createDataFrame([("P12", "top", False)], "id string, relation string, flipped boolean")
    got = retrieve.core_mapping(spark.createDataFrame(supers, "id string, super array<string>"), table).collect()
    assert {r["id"]: (r["relation"], r["distance"]) for r in got} == {f"P{k}": ("top", 12 - k) for k in range(13)}


def test_turtle_and_rdfxml_round_trips(spark, tmp_path):
    from kgspark.sources.rdf import rdfxml_graph, rdfxml_triples, turtle_graph, turtle_triples

    n = spark.createDataFrame(
        [("Lamp", "desk lamp", "Class", 'gives "light" & <warmth>', [("maker", "A\\B\nC")]), ("L1", "lamp 1", "Instance", "", []), ("v", "40 W", "Literal", None, None)],
        "id string, label string, type string, description string, properties array<struct<key:string,value:string>>",
    )
    e = spark.createDataFrame([("a", "L1", "Lamp", "rdf:type"), ("b", "L1", "v", "draws power")], "id string, source string, target string, label string")
    g = graph(n, e)
    for lines, read in ((exports.turtle(g), turtle_graph), (exports.owl_xml(g), rdfxml_graph)):
        (tmp_path / read.__name__).write_text("\n".join(r["line"] for r in lines.orderBy("section", "key", "part", "line").collect()))
        (tmp_path / (read.__name__ + ".empty")).write_text("")
        back = read(spark, str(tmp_path / (read.__name__ + "*")))
        tail = lambda x: x.split("#")[1]
        nodes = {(tail(r["id"]), r["label"], r["type"], r["description"], tuple(map(tuple, r["properties"]))) for r in back.nodes.collect()}
        assert nodes == {("Lamp", "desk lamp", "Class", 'gives "light" & <warmth>', (("maker", "A\\B\nC"),)), ("L1", "lamp 1", "Instance", "", ()), ("v", "40 W", "Literal", "", ())}
        assert {(tail(r["source"]), r["label"], tail(r["target"])) for r in back.edges.collect()} == {("L1", "rdf:type", "Lamp"), ("L1", "draws_power", "v")}

    text = """@prefix x: <http://x.org/> . # a remark with . and ;
    PREFIX y: <http://y.org/#>
    x:a a y:K ; x:p x:b , "t\\u00e9\\"\\n"@fr , 'it' , 3.5 , -2 , true , "5"^^x:int ; x:q [ x:r x:c ; x:s [ ] ] .
    <http://z.org/a#b> x:a.b \"\"\"two
    "quoted" lines\"\"\" . x:broken . x:end x:p ( x:m x:n )"""
    got = [t[:4] for t in turtle_triples(text, "f")]
    x, b = "http://x.org/", [t[2] for t in turtle_triples(text, "f") if t[2].startswith("_:")]
    assert got == [
        (x + "a", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://y.org/#K", False), (x + "a", x + "p", x + "b", False), (x + "a", x + "p", 'té"\n', True),
        (x + "a", x + "p", "it", True), (x + "a", x + "p", "3.5", True), (x + "a", x + "p", "-2", True), (x + "a", x + "p", "true", True), (x + "a", x + "p", "5", True),
        (x + "a", x + "q", b[0], False), (b[0], x + "r", x + "c", False), (b[0], x + "s", b[1], False),
        ("http://z.org/a#b", x + "a.b", 'two\n    "quoted" lines', True), (x + "end", x + "p", x + "m", False), (x + "end", x + "p", x + "n", False),
    ]
    assert [t[4] for t in turtle_triples(text, "f")][2] == "fr" and list(turtle_triples("@prefix", "f")) == [] == list(rdfxml_triples(" ", "f"))
    xml = '<r:RDF xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:x="http://x.org/" xml:lang="de"><x:K r:about="http://x.org/a"><x:p><x:L r:nodeID="n"><x:q>ja</x:q></x:L></x:p></x:K></r:RDF>'
    assert [(t[1].split("/")[-1], t[3], t[4]) for t in rdfxml_triples(xml, "f")] == [("22-rdf-syntax-ns#type", False, None), ("p", False, None), ("22-rdf-syntax-ns#type", False, None), ("q", True, "de")]
    with pytest.raises(ValueError, match="f"):
        list(rdfxml_triples("<a>", "f"))


def test_mean_distance_has_no_last_hop(spark):
    names = ["a0", *(f"n{k:03d}" for k in range(65)), "a1"]
    chain = from_rows(spark, [(x, x, "Instance") for x in names], [(str(k), a, b, "uses") for k, (a, b) in enumerate(zip(names, names[1:], strict=False))])
    assert score.average_path(chain, sample=2).head()[0] == 66


def test_chains_leave_whole_from_strong_components(spark, monkeypatch):
    rounds = []
    real = ga._trimmed
    monkeypatch.setattr(ga, "_trimmed", lambda e, n: rounds.append(n) or real(e, n))
    chain = [(f"n{k:03}", f"n{k + 1:03}") for k in range(200)]
    ring = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("x", "y"), ("y", "x"), ("x", "y")]
    df = spark.createDataFrame(chain + ring, "source string, target string")
    assert {r["id"]: r["component"] for r in ga.strong_components(df).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "x": "x", "y": "x"}
    assert sum(rounds) < 60  # 100 if a layer a round


def test_prefixes_that_documents_share_are_read_once():
    from kgspark.sources import rdf

    rdf._prefixes.cache_clear()
    head = "@prefix : <http://a.org/> .\n@prefix x: <http://x.org/#> .\n"
    for k in range(50):
        assert list(rdf.turtle_triples(f"{head}:s{k} x:p 'o' .", "d")) == [(f"http://a.org/s{k}", "http://x.org/#p", "o", True, None)]
    assert rdf._prefixes.cache_info().misses == 1
    # Other forms of a head are read token by token, a later prefix counts from where it stands.
    for text in (
        "@prefix : <http://b.org/> . # one\n:s x:p 'o' .", "@base <http://b.org/> .\n@prefix : <> .\n:s x:p 'o' .", "PREFIX : <http://b.org/>\n:s x:p 'o' .",
        "@prefix : <http://a.org/> .\n@prefix : <http://b.org/> .\n:s x:p 'o' .", "@prefix : <http://b.org/> .\n:s x:p 'o' .\n@prefix : <http://c.org/> .\n",
    ):
        assert list(rdf.turtle_triples(text, "d")) == [("http://b.org/s", "x:p", "o", True, None)]
    assert list(rdf.turtle_triples(":s :p '@prefix '\n .", "d")) == [(rdf.BASE + "s", rdf.BASE + "p", "@prefix ", True, None)]


def test_exports_look_up_the_ends_of_an_edge_once(spark):
    g = from_rows(spark, [("a", "A", "Instance"), ("b", "B", "Class")], [("1", "a", "b", "is"), ("2", "b", "a", ""), ("3", "a", "b", "x")])
    g = type(g)(g.nodes, g.edges.withColumn("inferred", F.when(F.col("id") == "3", True)))
    lines = exports.markdown(g)
    got = {(r["section"], r["key"], r["part"], r["line"]) for r in lines.where("section > 0 and part <> 0 or section > 3").collect()}
    assert got == {
        (2, "a", 3, "- → `is` → **B**"), (1, "b", 4, "- ← `is` ← **A**"), (1, "b", 3, "- → `related` → **A**"), (2, "a", 4, "- ← `related` ← **B**"),
        (4, "1", 0, "| A | `is` | B |"), (4, "2", 0, "| B | `—` | A |"), (5, "3", 0, "| A | `x` | B |"),
    }
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join Inner, (")
    assert joins(lines) == joins(exports.context_text(g)) == 2
