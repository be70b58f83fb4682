"""Text exports as ordered lines (SNK): frames of (section, key, part, line), so that any size can be written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kgspark.functions import vocabulary as V
from kgspark.functions.text import cypher_escape, iri_local, language, local_name, mermaid_escape, turtle_escape, xml_escape
from kgspark.operators.normalize import normalize
from kgspark.plans.graph import Graph, cut
from kgspark.sources.graphs import EXACT, OWL, RDF, RDFS

BASE = "https://example.org/graph#"
ENTITY = "http://www.wikidata.org/entity/"


def _line(df: DataFrame, section: int, key, part: int, line: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), (F.lit("") if key is None else F.col(key)).cast("string").alias("key"), F.lit(part).alias("part"), line.alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Part files in order: read one after another they are the document."""
    lines.orderBy("section", "key", "part", "line").select("line").write.text(path)


def write_json(g: Graph, path: str) -> None:
    """Nodes and direct edges as JSON lines in two folders."""
    g.nodes.write.json(f"{path}/nodes")
    g.direct().write.json(f"{path}/edges")


def _safe(c) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_]", "_")


def mermaid(g: Graph) -> DataFrame:
    head = g.spark.createDataFrame([("graph TD",)], "line string")
    label = mermaid_escape("label")
    shape = F.when(F.col("type") == "Class", F.concat(F.lit('["'), label, F.lit('"]'))).when(F.col("type") == "Instance", F.concat(F.lit('("'), label, F.lit('")'))).otherwise(F.concat(F.lit('(["'), label, F.lit('"])')))
    arrow = F.when(F.coalesce("inferred", F.lit(False)), F.lit("-.->")).otherwise(F.lit("-->"))
    text = F.when(F.coalesce("label", F.lit("")) != "", F.concat(F.lit('|"'), label, F.lit('"|'))).otherwise(F.lit(""))
    edge = F.concat(F.lit("  "), _safe("source"), F.lit(" "), arrow, text, F.lit(" "), _safe("target"))
    return _line(head, 0, None, 0, F.col("line")).union(_line(g.nodes, 1, "id", 0, F.concat(F.lit("  "), _safe("id"), shape))).union(_line(g.edges, 2, "id", 0, edge))


def cypher(g: Graph) -> DataFrame:
    quoted = lambda name, c: F.concat(F.lit(f"{name}: '"), cypher_escape(c), F.lit("'"))
    props = F.transform(F.coalesce("properties", F.array().cast("array<struct<key:string,value:string>>")), lambda p: F.concat(F.regexp_replace(p["key"], r"\s+", "_"), F.lit(": '"), cypher_escape(p["value"]), F.lit("'")))
    described = F.when(F.coalesce("description", F.lit("")) != "", quoted("description", "description"))
    body = F.array_join(F.concat(F.array_compact(F.array(quoted("id", "id"), quoted("label", "label"), described)), props), ", ")
    node = F.concat(F.lit("MERGE (:"), F.col("type"), F.lit(" {"), body, F.lit("})"))
    name = F.upper(F.regexp_replace(F.when(F.coalesce("label", F.lit("")) == "", F.lit("RELATED_TO")).otherwise(F.col("label")), "[^a-zA-Z0-9_]", "_"))
    match = F.concat(F.lit("MATCH (a {id: '"), cypher_escape("source"), F.lit("'}), (b {id: '"), cypher_escape("target"), F.lit("'})"))
    merge = F.concat(F.lit("MERGE (a)-[:"), name, F.lit("]->(b)"))
    d = g.direct()
    return _line(g.nodes, 0, "id", 0, node).union(_line(d, 1, "id", 0, match)).union(_line(d, 1, "id", 1, merge))


def _ends(g: Graph, edges: DataFrame) -> DataFrame:
    n = g.nodes.select("id", "label", "type")
    return (
        edges.select("id", "source", "target", F.col("label").alias("rel"), F.coalesce("inferred", F.lit(False)).alias("inferred"))
        .join(n.select(F.col("id").alias("source"), F.col("label").alias("s_label"), F.col("type").alias("s_type")), "source")
        .join(n.select(F.col("id").alias("target"), F.col("label").alias("t_label"), F.col("type").alias("t_type")), "target")
    )


def _said(section: Column, key: str, part: int, line: Column) -> Column:
    """A line as a struct: all lines of an edge are made at once, so its ends are looked up once."""
    return F.struct(section.cast("int").alias("section"), F.col(key).alias("key"), F.lit(part).alias("part"), line.alias("line"))


def markdown(g: Graph) -> DataFrame:
    """Counts, a section a node by kind, and the relation tables."""
    kinds = ("Class", "Instance", "Literal")
    n = g.nodes.agg(F.count("*").alias("nodes"), *(F.count_if(F.col("type") == k).alias(k) for k in kinds))
    e = g.edges.agg(F.count_if(~F.coalesce("inferred", F.lit(False))).alias("direct"), F.count_if("inferred").alias("inferred"))
    rows = F.array(*(F.struct(F.lit(i).alias("i"), F.concat(F.lit(f"| {c} | "), F.col(c).cast("string"), F.lit(" |")).alias("line")) for i, c in enumerate(("nodes", *kinds, "direct", "inferred"))))
    out = n.join(F.broadcast(e)).select(F.explode(rows).alias("r")).select(F.lit(0).alias("section"), F.lit("").alias("key"), F.col("r.i").alias("part"), F.col("r.line").alias("line"))
    section = F.array_position(F.array(*map(F.lit, kinds)), F.col("type")).cast("int")
    at = lambda part, line: g.nodes.select(section.alias("section"), F.col("id").alias("key"), F.lit(part).alias("part"), line.alias("line"))
    out = out.union(at(0, F.concat(F.lit("### "), F.col("label")))).union(at(1, F.col("description")).where("coalesce(line, '') <> ''"))
    props = g.nodes.select(section.alias("section"), F.col("id").alias("key"), F.explode("properties").alias("p"))
    out = out.union(props.select("section", "key", F.lit(2).alias("part"), F.concat(F.lit("- `"), F.col("p.key"), F.lit("`: "), F.col("p.value")).alias("line")))
    rel = F.when(F.coalesce("rel", F.lit("")) == "", F.lit("related")).otherwise(F.col("rel"))
    of = lambda c: F.array_position(F.array(*map(F.lit, kinds)), F.col(c)).cast("int")
    table = F.concat(F.lit("| "), F.col("s_label"), F.lit(" | `"), F.coalesce(F.nullif("rel", F.lit("")), F.lit("—")), F.lit("` | "), F.col("t_label"), F.lit(" |"))
    forth = F.concat(F.lit("- → `"), rel, F.lit("` → **"), F.col("t_label"), F.lit("**"))
    back = F.concat(F.lit("- ← `"), rel, F.lit("` ← **"), F.col("s_label"), F.lit("**"))
    direct = F.array(_said(of("s_type"), "source", 3, forth), _said(of("t_type"), "target", 4, back), _said(F.lit(4), "id", 0, table))
    said = F.when(F.col("inferred"), F.array(_said(F.lit(5), "id", 0, table))).otherwise(direct)
    return out.union(_ends(g, g.edges).select(F.explode(said).alias("r")).select("r.*"))


def context_text(g: Graph, anchors: DataFrame | None = None) -> DataFrame:
    """What an assistant reads: each node with its description, properties and edges both ways."""
    n = g.nodes if anchors is None else g.nodes.join(anchors.select("id", F.lit(True).alias("anchor")), "id", "left")
    star = F.lit("") if anchors is None else F.when(F.col("anchor"), F.lit(" ★")).otherwise(F.lit(""))
    out = _line(n, 0, "id", 0, F.concat(F.lit("["), F.col("type"), F.lit("] "), F.col("label"), star))
    out = out.union(_line(n.where("coalesce(description, '') <> ''"), 0, "id", 1, F.concat(F.lit("  설명: "), F.col("description"))))
    out = out.union(_line(n.select("id", F.explode("properties").alias("p")), 0, "id", 2, F.concat(F.lit("  "), F.col("p.key"), F.lit(": "), F.col("p.value"))))
    both = _ends(g, g.direct())
    rel = F.when(F.coalesce("rel", F.lit("")) == "", F.lit("related")).otherwise(F.col("rel"))
    said = lambda arrow, label, kind: F.concat(F.lit(f"  {arrow} ["), rel, F.lit(f"] {arrow} "), F.col(label), F.lit(" ["), F.col(kind), F.lit("]"))
    lines = F.array(_said(F.lit(0), "source", 3, said("→", "t_label", "t_type")), _said(F.lit(0), "target", 4, said("←", "s_label", "s_type")))
    return out.union(both.select(F.explode(lines).alias("r")).select("r.*"))


def unique_locals(nodes: DataFrame) -> DataFrame:
    """(id, local): IRI names from labels; repeats of a base get _2, _3 in the order of ids.

    A suffixed name that is also some label's own base goes on to a hash of its id, so names never collide.
    """
    base = iri_local(F.when(F.coalesce("label", F.lit("")) == "", F.col("id")).otherwise(F.col("label")))
    n = nodes.select("id", base.alias("base")).withColumn("k", F.row_number().over(W.partitionBy("base").orderBy("id")))
    named = n.withColumn("local", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("k").cast("string"))))
    taken = n.where("k = 1").select(F.col("base").alias("local"), F.lit(True).alias("taken"))
    clash = named.join(taken, "local", "left").withColumn("bad", (F.col("k") > 1) & F.coalesce("taken", F.lit(False)))
    return clash.select("id", F.when(F.col("bad"), F.concat_ws("_", "local", F.substring(F.sha2("id", 256), 1, 12))).otherwise(F.col("local")).alias("local"))


def to_triples(g: Graph, include_inferred: bool = False) -> DataFrame:
    """A graph as triples s, p, o, literal, lang: nodes, properties, edges by resolved relation, and the axioms they use.

    Named nodes and normalized edges are stored, as several parts read them. Repeats among edges leave by their ends' ids,
    before the ends have names; no edge says what a node or an axiom says, so those are made distinct apart.
    """
    local = unique_locals(g.nodes)
    iri = F.concat(F.lit(BASE), F.col("local"))
    n = cut(g.nodes.join(local, "id").select("id", "label", "type", "description", "wikidata_id", "properties", iri.alias("iri")))
    row = lambda df, s, p, o, literal=False, lang=None: df.select(
        s.alias("s"), (F.lit(p) if isinstance(p, str) else p).alias("p"), o.alias("o"), F.lit(literal).alias("literal"), (F.lit(None).cast("string") if lang is None else lang).alias("lang")
    )
    kind = F.when(F.col("type") == "Literal", F.lit(RDFS + "Datatype")).when(F.col("type") == "Instance", F.lit(OWL + "NamedIndividual")).otherwise(F.lit(OWL + "Class"))
    me = F.col("iri")
    out = row(n, me, RDF + "type", kind)
    out = out.union(row(n.where("coalesce(label, '') <> ''"), me, RDFS + "label", F.col("label"), True, language("label")))
    out = out.union(row(n.where("coalesce(description, '') <> ''"), me, RDFS + "comment", F.col("description"), True, language("description")))
    out = out.union(row(n.where("wikidata_id is not null"), me, EXACT, F.concat(F.lit(ENTITY), F.col("wikidata_id"))))
    props = n.select("iri", F.explode("properties").alias("pr")).where("coalesce(pr.key, '') <> ''")
    out = out.union(row(props, me, F.concat(F.lit(BASE), iri_local("pr.key")), F.coalesce("pr.value", F.lit("")), True))
    built = {V.TYPE: RDF + "type", V.SUBCLASS: RDFS + "subClassOf", V.EQUIVALENT: OWL + "equivalentClass", V.SAME_AS: OWL + "sameAs", V.DISJOINT: OWL + "disjointWith"}
    m = normalize(g)
    e = m.direct() if not include_inferred else m.edges
    ends = g.nodes.select("id").distinct()
    e = e.join(ends.withColumnRenamed("id", "source"), "source", "left_semi").join(ends.withColumnRenamed("id", "target"), "target", "left_semi")
    e = cut(e.select("source", "target", "relation", "label", "wikidata", "super_relation", "super_inverse"))
    known = F.create_map(*(F.lit(x) for kv in built.items() for x in kv))
    own = F.concat(F.lit(BASE), iri_local(F.coalesce("label", F.lit(""))))
    said = e.select("source", F.coalesce(known[F.coalesce(F.col("relation"), F.col("label"))], own).alias("p"), "target").distinct()
    ids = n.select("id", "iri").distinct()
    said = said.join(ids.select(F.col("id").alias("source"), F.col("iri").alias("si")), "source").join(ids.select(F.col("id").alias("target"), F.col("iri").alias("ti")), "target")
    used = cut(e.select(F.coalesce("relation", "label").alias("relation"), "label").distinct().where(~F.col("relation").isin(*built)).withColumn("pi", own))
    out = out.union(row(used.select("pi").distinct(), F.col("pi"), RDF + "type", F.lit(OWL + "ObjectProperty")))
    out = out.union(row(used.select("pi", "label").distinct(), F.col("pi"), RDFS + "label", F.col("label"), True, language("label")))
    out = out.union(row(used.where(F.col("relation").isin(*V.TRANSITIVE)), F.col("pi"), RDF + "type", F.lit(OWL + "TransitiveProperty")))
    out = out.union(row(used.where(F.col("relation").isin(*V.SYMMETRIC)), F.col("pi"), RDF + "type", F.lit(OWL + "SymmetricProperty")))
    kinds = cut(e.where(F.col("relation") == V.CUSTOM).select("label", "wikidata.id", "wikidata.transitive", "super_relation", "super_inverse").distinct())
    kinds = kinds.withColumn("wikidata", F.struct("id", "transitive"))
    return out.union(_linked(kinds, own, row)).distinct().union(row(said, F.col("si"), F.col("p"), F.col("ti")))


def _linked(e: DataFrame, own: Column, row) -> DataFrame:
    """What relations outside the core vocabulary are linked to: a Wikidata property, and a core relation above them, with
    its own axioms. A relation that is the inverse of a core one is below a helper, the inverse of that."""
    links = e.select(own.alias("pi"), F.col("wikidata.id").alias("wd"), F.col("wikidata.transitive").alias("transitive")).where("coalesce(wd, '') <> ''").distinct()
    core = [r.id for r in V.CORE if r.id not in V.BUILTIN]
    sup = e.where(F.col("super_relation").isin(core)).select(own.alias("pi"), "super_relation", F.coalesce("super_inverse", F.lit(False)).alias("turned")).distinct()
    up = lambda prefix: F.concat(F.lit(BASE), iri_local(F.concat(F.lit(prefix), F.col("super_relation"))))
    plain, turned = sup.where("not turned"), sup.where("turned")
    inv, su = up("inv-"), up("")
    above = F.col("super_relation")
    return (
        row(links, F.col("pi"), EXACT, F.concat(F.lit(ENTITY), F.col("wd")))
        .union(row(links.where("transitive"), F.col("pi"), RDF + "type", F.lit(OWL + "TransitiveProperty")))
        .union(row(plain, F.col("pi"), RDFS + "subPropertyOf", su)).union(row(turned, F.col("pi"), RDFS + "subPropertyOf", inv))
        .union(row(turned, inv, RDF + "type", F.lit(OWL + "ObjectProperty"))).union(row(turned, inv, OWL + "inverseOf", su))
        .union(row(sup, su, RDF + "type", F.lit(OWL + "ObjectProperty"))).union(row(sup, su, RDFS + "label", above, True, language("super_relation")))
        .union(row(sup.where(above.isin(*V.TRANSITIVE)), su, RDF + "type", F.lit(OWL + "TransitiveProperty")))
        .union(row(sup.where(above.isin(*V.SYMMETRIC)), su, RDF + "type", F.lit(OWL + "SymmetricProperty")))
    )


def ntriples(triples: DataFrame) -> DataFrame:
    tag = F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), F.col("lang"))).otherwise(F.lit(""))
    o = F.when(F.col("literal"), F.concat(F.lit('"'), turtle_escape("o"), F.lit('"'), tag)).otherwise(F.concat(F.lit("<"), F.col("o"), F.lit(">")))
    return triples.select(F.concat(F.lit("<"), F.col("s"), F.lit("> <"), F.col("p"), F.lit("> "), o, F.lit(" .")).alias("value"))


def turtle(g: Graph) -> DataFrame:
    """Prefixes, then one block of lines a node: type, label, comment, its edges."""
    name = lambda c: F.concat(F.lit(":"), local_name(c))
    kind = F.when(F.col("type") == "Class", "owl:Class").when(F.col("type") == "Instance", "owl:NamedIndividual").otherwise("rdfs:Datatype")
    n = g.nodes.where(F.col("type").isin("Class", "Instance", "Literal"))
    head = g.spark.createDataFrame([(f"@prefix {k}: <{v}> .",) for k, v in (("", BASE), ("owl", OWL), ("rdf", RDF), ("rdfs", RDFS))], "line string")
    out = _line(head, 0, None, 0, F.col("line")).union(_line(n, 1, "id", 0, F.concat(name("id"), F.lit(" a "), kind, F.lit(" ."))))
    out = out.union(_line(n, 1, "id", 1, F.concat(name("id"), F.lit(' rdfs:label "'), turtle_escape("label"), F.lit('" .'))))
    out = out.union(_line(n.where("coalesce(description, '') <> ''"), 1, "id", 2, F.concat(name("id"), F.lit(' rdfs:comment "'), turtle_escape("description"), F.lit('" .'))))
    p = n.select("id", F.explode("properties").alias("p"))
    out = out.union(_line(p, 1, "id", 3, F.concat(name("id"), F.lit(" "), name("p.key"), F.lit(' "'), turtle_escape("p.value"), F.lit('" .'))))
    rel = F.when(F.col("label").isin(V.TYPE, V.SUBCLASS, V.EQUIVALENT, V.DISJOINT, V.SAME_AS), F.col("label")).otherwise(name("label"))
    return out.union(_line(g.direct(), 1, "source", 4, F.concat(name("source"), F.lit(" "), rel, F.lit(" "), name("target"), F.lit(" ."))))


def owl_xml(g: Graph) -> DataFrame:
    """RDF/XML between its first and last line: a line a node with label, comment and properties, a line an edge."""
    ends = g.spark.createDataFrame([(0, f'<rdf:RDF xmlns="{BASE}" xmlns:rdf="{RDF}" xmlns:rdfs="{RDFS}" xmlns:owl="{OWL}">'), (3, "</rdf:RDF>")], "section int, line string")
    tag = F.when(F.col("type") == "Class", "owl:Class").when(F.col("type") == "Instance", "owl:NamedIndividual").otherwise("rdfs:Datatype")
    n = g.nodes.where(F.col("type").isin("Class", "Instance", "Literal"))
    about = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit("<rdfs:comment>"), xml_escape("description"), F.lit("</rdfs:comment>"))).otherwise(F.lit(""))
    said = F.transform(F.coalesce("properties", F.array().cast("array<struct<key:string,value:string>>")), lambda p: F.concat(F.lit("<"), local_name(p["key"]), F.lit(">"), xml_escape(p["value"]), F.lit("</"), local_name(p["key"]), F.lit(">")))
    line = F.concat(F.lit("<"), tag, F.lit(f' rdf:about="{BASE}'), xml_escape(iri_local("id")), F.lit('"><rdfs:label>'), xml_escape("label"), F.lit("</rdfs:label>"), about, F.array_join(said, ""), F.lit("</"), tag, F.lit(">"))
    rel = F.when(F.col("label").isin(V.TYPE, V.SUBCLASS, V.EQUIVALENT, V.DISJOINT, V.SAME_AS), F.col("label")).otherwise(local_name("label"))
    edge = F.concat(F.lit(f'<rdf:Description rdf:about="{BASE}'), xml_escape(iri_local("source")), F.lit('"><'), rel, F.lit(f' rdf:resource="{BASE}'), xml_escape(iri_local("target")), F.lit('"/></rdf:Description>'))
    border = ends.select("section", F.lit("").alias("key"), F.lit(0).alias("part"), "line")
    return border.union(_line(n, 1, "id", 0, line)).union(_line(g.direct(), 2, "id", 0, edge))


def sparql_texts(g: Graph) -> DataFrame:
    """Ready-made queries over an export: two overviews, one a class, one a relation, one a property key."""
    pre = F.lit("PREFIX : <" + BASE + "> ")
    fixed = g.spark.createDataFrame([("0", "SELECT ?type (COUNT(?s) AS ?count) WHERE { ?s a ?type } GROUP BY ?type ORDER BY DESC(?count)"), ("1", "SELECT ?s ?p ?o WHERE { ?s ?p ?o } LIMIT 100")], "key string, q string")
    out = _line(fixed, 0, "key", 0, F.concat(pre, F.col("q")))
    c = g.nodes.where("type = 'Class'").select("label").distinct()
    out = out.union(_line(c, 1, "label", 0, F.concat(pre, F.lit("SELECT ?x WHERE { ?x a :"), local_name("label"), F.lit(" }"))))
    r = g.direct().select("label").where("coalesce(label, '') <> ''").distinct()
    out = out.union(_line(r, 2, "label", 0, F.concat(pre, F.lit("SELECT ?s ?o WHERE { ?s :"), local_name("label"), F.lit(" ?o }"))))
    k = g.nodes.select(F.explode("properties.key").alias("label")).distinct()
    return out.union(_line(k, 3, "label", 0, F.concat(pre, F.lit("SELECT ?s ?v WHERE { ?s :"), local_name("label"), F.lit(" ?v }"))))


def shapes(g: Graph) -> DataFrame:
    """Constraints by class (class, kind, path, value): label at least once, string keys, relations, a single target class."""
    typed = g.direct().where(F.col("label") == V.TYPE).select(F.col("source").alias("id"), F.col("target").alias("class"))
    cls = g.nodes.where("type = 'Class'").select(F.col("id").alias("class"))
    typed = typed.join(cls, "class", "left_semi")
    none = F.lit(None).cast("string")
    out = cls.select("class", F.lit("minCount").alias("kind"), F.lit("rdfs:label").alias("path"), F.lit("1").alias("value"))
    keys = typed.join(g.nodes.select("id", F.explode("properties.key").alias("path")), "id").select("class", F.lit("datatype").alias("kind"), "path", F.lit("xsd:string").alias("value")).distinct()
    e = g.direct().where(F.col("label") != V.TYPE).select(F.col("source").alias("id"), F.col("label").alias("path"), "target").join(typed, "id")
    e = e.join(typed.select(F.col("id").alias("target"), F.col("class").alias("tc")), "target", "left")
    rel = e.groupBy("class", "path").agg(F.count_distinct("tc").alias("n"), F.min("tc").alias("one"), F.count_if(F.col("tc").isNull()).alias("untyped"))
    node = rel.select("class", F.lit("nodeKind").alias("kind"), "path", F.lit("sh:IRI").alias("value"))
    single = rel.where("n = 1 and untyped = 0").select("class", F.lit("class").alias("kind"), "path", F.col("one").alias("value"))
    return out.union(keys).union(node).union(single).select("class", "kind", "path", F.coalesce("value", none).alias("value"))
