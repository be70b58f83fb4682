"""Shapes look only at the predicates that they name and what those follow from; the results are the same."""

from kgspark.operators import shapes as S

TRIPLES = [
    ("cat", "rdfs:subClassOf", "pet", False), ("owns", "rdfs:subPropertyOf", "has", False), ("buys", "rdfs:subPropertyOf", "owns", False), ("holds", "rdfs:range", "thing", False), ("buys", "rdfs:domain", "person", False),
    ("tom", "rdf:type", "cat", False), ("ann", "buys", "tom", False), ("ann", "buys", "tom", False), ("bob", "holds", "box", False), ("ann", "likes", "x", False), ("bob", "likes", "y", False), ("tom", "name", "Tom", True),
]
RULES = [
    ("class", "pet", "minCount", "chip", "1"), ("class", "thing", "minCount", "chip", "1"), ("class", "person", "maxCount", "has", "0"), ("subjectsOf", "has", "class", "owns", "person"),
    ("objectsOf", "owns", "minLength", "name", "9"), ("node", "cat", "class", "rdfs:subClassOf", "dog"), ("class", "cat", "datatype", "name", "xsd:date"),
]


def test_only_what_shapes_name(spark, monkeypatch):
    data = spark.createDataFrame(TRIPLES, "s string, p string, o string, literal boolean")
    rules = spark.createDataFrame(RULES, "target string, of string, kind string, path string, value string")
    rows = lambda: sorted(map(str, S.results(data, rules).collect()))
    held, whole, inferred = [], S.cut, S.inferred

    def watched(df):
        out = whole(df)
        if {"s", "p", "o"} <= set(out.columns):
            held.append({r["p"] for r in out.select("p").distinct().collect()})
        return out

    monkeypatch.setattr(S, "cut", watched)
    narrow = rows()
    assert held and not any("likes" in x for x in held)
    monkeypatch.setattr(S, "inferred", lambda t, wanted=None: inferred(t))
    assert rows() == narrow and len(narrow) >= 6
