"""Shapes: inference ahead of the check, every constraint, target kinds, and the report read back."""

import pytest
from pyspark.sql import functions as F

from kgspark.operators import shapes as S

IRI = [
    ("cat", "rdfs:subClassOf", "pet"), ("pet", "rdfs:subClassOf", "animal"), ("owns", "rdfs:subPropertyOf", "has"), ("has", "rdfs:range", "thing"), ("owns", "rdfs:domain", "person"),
    ("tom", "rdf:type", "cat"), ("ann", "owns", "tom"), ("ann", "likes", "_:b"),
]
LITERAL = [
    ("tom", "age", "7", "xsd:integer", None), ("tom", "name", "Tom", None, "en"), ("ann", "age", "7x", "xsd:integer", None), ("ann", "born", "2001-02-03", "xsd:date", None), ("ann", "born", "soon", "xsd:date", None),
    ("tom", "code", "ab", None, None), ("tom", "code", "abcd", None, None),
]


def data(spark):
    t = [(s, p, o, False, None, None) for s, p, o in IRI] + [(s, p, o, True, d, x) for s, p, o, d, x in LITERAL]
    return spark.createDataFrame(t, "s string, p string, o string, literal boolean, datatype string, lang string")


def found(spark, *rows, inference=True):
    shapes = spark.createDataFrame([tuple(r) for r in rows], "target string, of string, kind string, path string, value string")
    return S.results(data(spark), shapes, inference)


def test_inference_and_what_only_it_shows(spark):
    t = {tuple(r)[:3] for r in S.inferred(data(spark)).collect()}
    assert {("tom", "rdf:type", "pet"), ("tom", "rdf:type", "animal"), ("tom", "rdf:type", "thing"), ("ann", "rdf:type", "person"), ("ann", "has", "tom"), ("cat", "rdfs:subClassOf", "animal")} <= t
    rule = ("class", "animal", "minCount", "chip", "1")
    assert [r["focus"] for r in found(spark, rule).collect()] == ["tom"] and found(spark, rule, inference=False).count() == 0
    assert found(spark, ("class", "person", "class", "has", "animal")).count() == 0
    assert S.inferred(data(spark).limit(0)).count() == 0


def test_constraints_and_targets(spark):
    got = found(
        spark, ("subjectsOf", "age", "datatype", "age", "xsd:integer"), ("node", "ann", "datatype", "born", "xsd:date"), ("subjectsOf", "name", "datatype", "name", "xsd:string"),
        ("node", "ann", "nodeKind", "likes", "sh:IRI"), ("node", "ann", "nodeKind", "owns", "sh:IRI"), ("node", "tom", "nodeKind", "name", "sh:IRI"),
        ("objectsOf", "owns", "maxCount", "code", "1"), ("node", "tom", "maxLength", "code", "3"), ("node", "tom", "minLength", "code", "3"), ("node", "tom", "pattern", "code", "^abc"),
        ("node", "tom", "in", "code", "ab"), ("node", "tom", "in", "code", "zz"), ("node", "tom", "hasValue", "code", "ab"), ("node", "tom", "hasValue", "code", "zz"),
        ("subjectsOf", "age", "minInclusive", "age", "8"), ("node", "tom", "maxInclusive", "age", "8"), ("node", "ann", "class", "owns", "dog"), ("class", "dog", "minCount", "x", "1"),
    )
    rows = {(r["kind"], r["path"], r["focus"], r["value"]) for r in got.collect()}
    assert rows == {
        ("datatype", "age", "ann", "7x"), ("datatype", "born", "ann", "soon"), ("datatype", "name", "tom", "Tom"), ("nodeKind", "likes", "ann", "_:b"), ("nodeKind", "name", "tom", "Tom"),
        ("maxCount", "code", "tom", None), ("maxLength", "code", "tom", "abcd"), ("minLength", "code", "tom", "ab"), ("pattern", "code", "tom", "ab"), ("in", "code", "tom", "abcd"),
        ("hasValue", "code", "tom", None), ("minInclusive", "age", "tom", "7"), ("minInclusive", "age", "ann", "7x"), ("class", "owns", "ann", "tom"),
    }
    with pytest.raises(ValueError, match="odd"):
        found(spark, ("node", "ann", "odd", "owns", "1"))


def test_report_is_read_back(spark):
    bad = found(spark, ("node", "tom", "maxLength", "code", "3"), ("class", "animal", "minCount", "chip", "1"))
    ok, rows = S.read_report(S.report(bad))
    told = lambda df: sorted(map(str, df.collect()))
    assert not ok and told(rows) == told(bad.select("focus", "path", F.when(F.col("kind") == "minCount", S.COMPONENTS["minCount"]).otherwise(S.COMPONENTS["maxLength"]).alias("component"), "value"))
    ok, rows = S.read_report(S.report(bad.limit(0)))
    assert ok and rows.count() == 0
