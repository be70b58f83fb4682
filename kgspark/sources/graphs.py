"""Readers of graphs: JSON documents, CSV tables, text, N-Triples, property dictionaries (SRC)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.functions.text import iri_tail
from kgspark.plans.graph import EDGE, NODE, PROPERTY, Graph, content_id, graph

LABEL_COLUMNS = ("함명", "이름", "name", "label", "명칭", "제품명", "품명")
CATEGORY_COLUMNS = ("함종", "함급", "종류", "분류", "type", "class", "category", "카테고리")


def read_json(spark: SparkSession, path: str) -> Graph:
    """Graph documents {nodes, edges}; missing labels become Node, missing types Class, missing places a grid of four."""
    schema = T.StructType([
        T.StructField("nodes", T.ArrayType(T.StructType.fromDDL(NODE))), T.StructField("edges", T.ArrayType(T.StructType.fromDDL(EDGE))),
    ])
    doc = spark.read.schema(schema).json(path, multiLine=True)
    n = doc.select(F.posexplode("nodes").alias("at", "n")).select("at", "n.*")
    nodes = n.withColumns({
        "label": F.coalesce(F.nullif("label", F.lit("")), F.lit("Node")), "type": F.coalesce(F.nullif("type", F.lit("")), F.lit("Class")),
        "x": F.coalesce("x", (F.col("at") % 4 * 220 + 80).cast("double")), "y": F.coalesce("y", (F.floor(F.col("at") / 4) * 160 + 80).cast("double")),
        "properties": F.coalesce("properties", F.array().cast(PROPERTY)),
    }).drop("at")
    e = doc.select(F.posexplode("edges").alias("pos_", "e")).select("e.*", "pos_")
    edges = e.withColumns({"pos": F.coalesce("pos", F.col("pos_").cast("long")), "label": F.coalesce("label", F.lit("")), "inferred": F.coalesce("inferred", F.lit(False))}).drop("pos_")
    return graph(nodes, edges)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))


def csv_readable(text) -> Column:
    """Comma-separated lines as tab-joined ones, fields trimmed and without outer quotes."""
    text = F.col(text) if isinstance(text, str) else text
    field = lambda x: F.regexp_replace(F.trim(x), '^"|"$', "")
    return F.array_join(F.transform(F.split(text, "\r?\n"), lambda line: F.array_join(F.transform(F.split(line, ","), field), "\t")), "\n")


def csv_graph(rows: DataFrame, order: str | None = None, label: str | None = None, categories: list[str] | None = None) -> Graph:
    """A table as a graph: a class for each category value, an instance for each row, the other columns as properties.

    Label and category columns are found by name if not given (else the third column, else the first, is the label; at
    most two categories). Values of the second category are is-a values of the first on their rows; rows belong to their
    last category. ``order`` is a unique column that numbers the rows; without it equal rows are one instance.
    """
    names = [c for c in rows.columns if c != order]
    label = label or next((c for c in LABEL_COLUMNS if c in names), names[2] if len(names) > 2 else names[0])
    categories = (categories if categories is not None else [c for c in CATEGORY_COLUMNS if c in names])[:2]
    text = rows.select(*(F.trim(F.col(c).cast("string")).alias(c) for c in names), *([F.col(order).cast("string").alias("__key")] if order else []))
    if not order:
        text = text.withColumn("__key", content_id("", *(F.coalesce(F.col(c), F.lit("")) for c in names))).distinct()
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    class_id = lambda c: F.concat(F.lit(f"cls:{c}:"), F.col(c))
    no_props = F.array().cast(PROPERTY)
    parts = [
        text.where(filled(c)).select(class_id(c).alias("id"), F.col(c).alias("label"), F.lit("Class").alias("type"), F.concat(F.lit(f"{c}: "), F.col(c)).alias("description"), F.array(F.struct(F.lit("분류기준").alias("key"), F.lit(c).alias("value"))).alias("properties")).distinct()
        for c in categories
    ]
    others = [c for c in names if c != label and c not in categories]
    props = F.array_compact(F.array(*(F.when(filled(c), F.struct(F.lit(c).alias("key"), F.col(c).alias("value"))) for c in others))) if others else no_props
    about = F.concat_ws(" / ", *(F.when(filled(c), F.concat(F.lit(f"{c}: "), F.col(c))) for c in categories)) if categories else F.lit("")
    inst = F.concat(F.lit("inst:"), F.col("__key"))
    named = F.when(filled(label), F.col(label)).otherwise(F.concat(F.lit("항목_"), F.col("__key")))
    nodes = text.select(inst.alias("id"), named.alias("label"), F.lit("Instance").alias("type"), about.alias("description"), props.alias("properties"))
    for p in parts:
        nodes = nodes.unionByName(p)
    edge = lambda s, t, lab: (F.concat_ws("→", s, t).alias("id"), s.alias("source"), t.alias("target"), F.lit(lab).alias("label"))
    edges = None
    if categories:
        last = categories[-1]
        edges = text.where(filled(last)).select(*edge(inst, class_id(last), "소속"))
        if len(categories) > 1:
            a, b = categories
            edges = edges.union(text.where(filled(a) & filled(b)).select(*edge(class_id(b), class_id(a), "is-a")).distinct())
    if edges is None:
        edges = rows.sparkSession.createDataFrame([], "id string, source string, target string, label string")
    return graph(nodes, edges)


_TRIPLE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$'


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Triples s, p, o, literal, lang of N-Triples lines; other lines are left out."""
    return parse_ntriples(spark.read.text(path))


def parse_ntriples(lines: DataFrame) -> DataFrame:
    part = lambda k: F.regexp_extract("value", _TRIPLE, k)
    bare = lambda c: F.regexp_replace(c, "^<|>$", "")
    t = lines.where(F.col("value").rlike(_TRIPLE)).select(part(1).alias("s"), part(2).alias("p"), part(3).alias("o"))
    literal = F.startswith("o", F.lit('"'))
    body = F.regexp_extract("o", r'^"((?:[^"\\]|\\.)*)"', 1)
    for a, b in (("\\n", "\n"), ("\\t", "\t"), ('\\"', '"'), ("\\\\", "\\")):
        body = F.replace(body, F.lit(a), F.lit(b))
    return t.select(bare(F.col("s")).alias("s"), "p", F.when(literal, body).otherwise(bare(F.col("o"))).alias("o"), literal.alias("literal"), F.nullif(F.regexp_extract("o", r"@([A-Za-z0-9-]+)$", 1), F.lit("")).alias("lang"))


RDF, RDFS, OWL = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#"
EXACT = "http://www.w3.org/2004/02/skos/core#exactMatch"
_SCHEMA_TYPES = tuple(OWL + x for x in ("ObjectProperty", "DatatypeProperty", "AnnotationProperty", "TransitiveProperty", "SymmetricProperty", "FunctionalProperty", "Ontology")) + (RDF + "Property",)


def from_triples(triples: DataFrame, properties: bool = False) -> Graph:
    """Nodes and edges of a triple table. Property and ontology declarations, predicates and W3C terms make no nodes.

    With ``properties``, other literals become properties of their subjects, in the order of key and value.
    """
    t = triples.select("s", "p", "o", "literal")
    is_type = F.col("p") == RDF + "type"
    schema = t.where(is_type & F.col("o").isin(*_SCHEMA_TYPES)).select(F.col("s").alias("id")).union(t.select("p")).distinct()
    w3 = lambda c: F.startswith(c, F.lit("http://www.w3.org/"))
    terms = t.select(F.col("s").alias("id")).union(t.where("not literal").select("o")).distinct()
    ids = terms.where(~w3("id")).join(schema, "id", "left_anti")
    about = t.groupBy(F.col("s").alias("id")).agg(
        F.min(F.when(F.col("p") == RDFS + "label", F.col("o"))).alias("label"), F.min(F.when(F.col("p") == RDFS + "comment", F.col("o"))).alias("description"),
        F.max(is_type & F.col("o").isin(OWL + "Class", RDFS + "Class")).alias("class"), F.max(is_type & (F.col("o") == RDFS + "Datatype")).alias("datatype"),
        F.min(F.when(F.col("p") == EXACT, iri_tail("o"))).alias("wikidata_id"),
    )
    kind = F.when(F.col("datatype"), "Literal").when(F.col("class"), "Class").otherwise("Instance")
    nodes = ids.join(about, "id", "left").select("id", F.coalesce("label", iri_tail("id")).alias("label"), kind.alias("type"), F.coalesce("description", F.lit("")).alias("description"), "wikidata_id")
    if properties:
        said = t.where("literal").where(~w3("p")).groupBy(F.col("s").alias("id")).agg(F.array_sort(F.collect_set(F.struct(iri_tail("p").alias("key"), F.col("o").alias("value")))).alias("properties"))
        nodes = nodes.join(said, "id", "left").withColumn("properties", F.coalesce("properties", F.array().cast(PROPERTY)))
    e = t.where(~F.col("literal") & ~F.col("p").isin(RDFS + "label", RDFS + "comment", EXACT))
    e = e.join(ids.withColumnRenamed("id", "s"), "s", "left_semi").join(ids.withColumnRenamed("id", "o"), "o", "left_semi")
    short = F.when(F.startswith("p", F.lit(RDF)), F.concat(F.lit("rdf:"), iri_tail("p"))).when(F.startswith("p", F.lit(RDFS)), F.concat(F.lit("rdfs:"), iri_tail("p"))).when(F.startswith("p", F.lit(OWL)), F.concat(F.lit("owl:"), iri_tail("p")))
    edges = e.select("s", "o", F.coalesce(short, iri_tail("p")).alias("label")).distinct().select(content_id("e_", F.col("s"), F.col("label"), F.col("o")).alias("id"), F.col("s").alias("source"), F.col("o").alias("target"), "label")
    return graph(nodes, edges)


PROPERTY_ROW = "id string, label map<string,string>, description map<string,string>, aliases map<string,array<string>>, super array<string>, inverse array<string>, transitive boolean, symmetric boolean"


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROPERTY_ROW).json(path)


def merge_facets(labels: DataFrame, aliases: DataFrame, relations: DataFrame) -> DataFrame:
    """A property dictionary of three facet tables: (id, lang, label), (id, lang, alias), (id, kind, value)."""
    a = labels.where("label is not null").groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("lang", "label")))).alias("label"))
    b = aliases.groupBy("id", "lang").agg(F.array_sort(F.collect_set("alias")).alias("alias")).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "alias")))).alias("aliases"))
    c = relations.groupBy("id").agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") == "super", F.col("value")))).alias("super"), F.array_sort(F.collect_set(F.when(F.col("kind") == "inverse", F.col("value")))).alias("inverse"),
        F.bool_or(F.col("kind") == "transitive").alias("transitive"), F.bool_or(F.col("kind") == "symmetric").alias("symmetric"),
    )
    return a.join(b, "id", "left").join(c, "id", "left").orderBy(F.regexp_extract("id", "[0-9]+", 0).cast("long"))
