"""Shape validation (SHC-1): RDFS inference ahead of the check, constraints by focus node and path, a report as triples.

Triples have s, p, o and may have literal, datatype and lang; a literal without a datatype is an xsd:string, one with a
language an rdf:langString. Shapes are rows: target (class, subjectsOf, objectsOf or node), of, kind, path, value; the
rows of one target make one shape, and ``in`` has a row a value that is allowed. Constraints are joins on the focus nodes
and their values, so what moves follows those.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.plans.graph import content_id, cut

# Predicates, datatypes and their forms, components of a report.
TYPE, SUBCLASS, SUBPROPERTY, DOMAIN, RANGE = "rdf:type", "rdfs:subClassOf", "rdfs:subPropertyOf", "rdfs:domain", "rdfs:range"
FORMS = {
    "xsd:integer": r"^[+-]?[0-9]+$", "xsd:decimal": r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$", "xsd:boolean": "^(true|false|0|1)$",
    "xsd:double": r"^([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN)$", "xsd:date": r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2})?$",
    "xsd:dateTime": r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?$",
}
COMPONENTS = {
    "minCount": "sh:MinCountConstraintComponent", "maxCount": "sh:MaxCountConstraintComponent", "datatype": "sh:DatatypeConstraintComponent",
    "nodeKind": "sh:NodeKindConstraintComponent", "class": "sh:ClassConstraintComponent", "pattern": "sh:PatternConstraintComponent", "in": "sh:InConstraintComponent",
    "hasValue": "sh:HasValueConstraintComponent", "minInclusive": "sh:MinInclusiveConstraintComponent", "maxInclusive": "sh:MaxInclusiveConstraintComponent",
    "minLength": "sh:MinLengthConstraintComponent", "maxLength": "sh:MaxLengthConstraintComponent",
}
_KEY = ("s", "p", "o", "literal", "datatype", "lang")


def full(triples: DataFrame) -> DataFrame:
    """Triples with all columns; what is not said is null, and no literal."""
    kinds = {"literal": "boolean"}
    known = [F.col(c) if c in triples.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in _KEY]
    t = triples.select(*known).withColumn("literal", F.coalesce("literal", F.lit(False)))
    kind = F.when(F.col("lang").isNotNull(), F.lit("rdf:langString")).otherwise(F.coalesce("datatype", F.lit("xsd:string")))
    return t.withColumn("datatype", F.when(F.col("literal"), kind))


def _above(pairs: DataFrame) -> DataFrame:
    """(a, b): b is above a over any number of steps; paths double, so rounds follow the logarithm of the depth."""
    seen = cut(pairs.where("a <> b").distinct())
    while True:
        far = seen.join(seen.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")).where("a <> b")
        new = cut(far.distinct().join(seen, ["a", "b"], "left_anti"))
        if new.isEmpty():
            return seen
        seen = cut(seen.union(new))


def inferred(triples: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The triples and what RDFS adds: super-properties, types by domain and range, superclasses.

    With ``wanted`` (p), only triples of those predicates, whose number is small: others leave before anything moves, but
    for those that wanted ones follow from.
    """
    t = full(triples)
    pairs = lambda p: t.where(F.col("p") == p).where("not literal").select(F.col("s").alias("a"), F.col("o").alias("b"))
    classes, properties = _above(pairs(SUBCLASS)), _above(pairs(SUBPROPERTY))
    if wanted is not None:
        typing = pairs(DOMAIN).union(pairs(RANGE)).select(F.col("a").alias("p"))
        asked = cut(wanted.select("p").union(typing).union(t.sparkSession.createDataFrame([(TYPE,)], "p string")).distinct())
        under = properties.join(asked.withColumnRenamed("p", "b"), "b", "left_semi").select(F.col("a").alias("p"))
        axioms = t.where(F.col("p").isin(DOMAIN, RANGE))
        t = t.join(cut(asked.union(under).distinct()), "p", "left_semi").select(*_KEY)
    else:
        axioms = t
    every = t
    if not properties.isEmpty():
        up = t.join(properties.withColumnRenamed("a", "p"), "p").select("s", F.col("b").alias("p"), "o", "literal", "datatype", "lang")
        every = cut(t.union(up.select(*_KEY)).distinct())
    said = lambda p: axioms.where(F.col("p") == p).where("not literal").select(F.col("s").alias("p"), F.col("o").alias("b"))
    typed = lambda df, end: df.select(F.col(end).alias("s"), F.lit(TYPE).alias("p"), F.col("b").alias("o"))
    domain = typed(every.join(said(DOMAIN), "p"), "s")
    range_ = typed(every.where("not literal").join(said(RANGE), "p"), "o")
    types = every.where(F.col("p") == TYPE).select("s", "p", "o").union(domain).union(range_).distinct()
    above = types.join(classes.withColumnRenamed("a", "o"), "o").select("s", "p", F.col("b").alias("o"))
    sub = classes.select(F.col("a").alias("s"), F.lit(SUBCLASS), F.col("b").alias("o")).union(properties.select("a", F.lit(SUBPROPERTY), "b"))
    made = full(types.union(above).union(sub).toDF("s", "p", "o"))
    out = every.union(made.select(*_KEY)).distinct()
    return out if wanted is None else out.join(F.broadcast(asked), "p", "left_semi").select(*_KEY)


def _scope(t: DataFrame, shapes: DataFrame) -> DataFrame:
    """Shapes with their focus nodes."""
    member = t.where(F.col("p") == TYPE).select(F.lit("class").alias("target"), F.col("o").alias("of"), F.col("s").alias("focus"))
    subject = t.select(F.lit("subjectsOf"), "p", "s")
    object_ = t.where("not literal").select(F.lit("objectsOf"), "p", "o")
    # A row a target; what no shape names leaves first.
    names = cut(shapes.select("target", "of").distinct())
    by_data = member.union(subject).union(object_).join(F.broadcast(names), ["target", "of"], "left_semi").distinct()
    named = shapes.where("target = 'node'").select("target", "of", F.col("of").alias("focus")).distinct()
    return shapes.join(by_data.union(named), ["target", "of"])


def results(triples: DataFrame, shapes: DataFrame, inference: bool = True) -> DataFrame:
    """target, of, kind, path, focus, value (null where a whole focus node fails) of all that does not hold."""
    s = cut(shapes.select("target", "of", "kind", "path", F.col("value").alias("want")))
    wanted = s.select(F.col("path").alias("p")).union(s.where("target in ('subjectsOf', 'objectsOf')").select("of")).distinct()
    t = cut(inferred(triples, wanted) if inference else full(triples))
    unknown = s.where(~F.col("kind").isin(*COMPONENTS)).select("kind").head()
    if unknown:
        raise ValueError(f"constraint {unknown['kind']!r}")
    scope = cut(_scope(t, s))
    values = t.select(F.col("s").alias("focus"), F.col("p").alias("path"), F.col("o").alias("value"), "literal", "datatype", "lang")
    columns = ["target", "of", "kind", "path", "focus", "value"]
    number = F.col("want").try_cast("double")
    numbered = F.broadcast(s.where(F.col("kind").isin("minCount", "maxCount")).select("path").distinct())
    n = values.join(numbered, "path", "left_semi").groupBy("focus", "path").agg(F.count("*").alias("n"))
    counted = scope.where(F.col("kind").isin("minCount", "maxCount")).join(n, ["focus", "path"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    off = ((F.col("kind") == "minCount") & (F.col("n") < number)) | ((F.col("kind") == "maxCount") & (F.col("n") > number))
    none = F.lit(None).cast("string").alias("value")
    few = counted.where(off).select(*columns[:-1], none)
    has = scope.where("kind = 'hasValue'").join(values.select("focus", "path", F.col("value").alias("want")), ["focus", "path", "want"], "left_anti").select(*columns[:-1], none)
    each = scope.join(values, ["focus", "path"])
    lacks = each.where("kind = 'class'").join(t.where(F.col("p") == TYPE).select(F.col("s").alias("value"), F.col("o").alias("want")), ["value", "want"], "left_anti").select(*columns)
    listed = s.where("kind = 'in'").select("target", "of", "kind", "path", F.col("want").alias("value"))
    other = each.where("kind = 'in'").select(*columns).distinct().join(listed, ["target", "of", "kind", "path", "value"], "left_anti").select(*columns)
    alone = each.where(~F.col("kind").isin("minCount", "maxCount", "hasValue", "class", "in")).where(~F.coalesce(_holds(number), F.lit(False))).select(*columns)
    return reduce(DataFrame.unionByName, [few, has, lacks, other, alone]).distinct()


def _holds(number: Column) -> Column:
    """Whether a value by itself meets its constraint."""
    kind, value, want, literal = F.col("kind"), F.col("value"), F.col("want"), F.col("literal")
    form = F.create_map(*(F.lit(x) for kv in FORMS.items() for x in kv))[want]
    blank = value.startswith("_:") & ~literal
    iri = ~literal & ~blank
    node = F.when(want == "sh:IRI", iri).when(want == "sh:Literal", literal).when(want == "sh:BlankNode", blank).when(want == "sh:BlankNodeOrIRI", ~literal).when(want == "sh:IRIOrLiteral", ~blank).when(want == "sh:BlankNodeOrLiteral", ~iri)
    return (
        F.when(kind == "datatype", literal & (F.col("datatype") == want) & (form.isNull() | F.rlike(value, F.coalesce(form, F.lit("")))))
        .when(kind == "nodeKind", node).when(kind == "pattern", ~blank & F.rlike(value, want))
        .when(kind == "minInclusive", value.try_cast("double") >= number).when(kind == "maxInclusive", value.try_cast("double") <= number)
        .when(kind == "minLength", ~blank & (F.length(value) >= number)).when(kind == "maxLength", ~blank & (F.length(value) <= number))
    )


def report(found: DataFrame) -> DataFrame:
    """A validation report as triples s, p, o, literal: whether all holds, and a result a row of ``results``."""
    component = F.create_map(*(F.lit(x) for kv in COMPONENTS.items() for x in kv))[F.col("kind")]
    r = found.withColumn("id", content_id("_:r", *(F.coalesce(c, F.lit("\x02")) for c in ("target", "of", "kind", "path", "focus", "value"))))
    row = lambda p, o, literal=False: r.select(F.col("id").alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(literal).alias("literal")).where("o is not null")
    head = found.agg((F.count("*") == 0).cast("string").alias("ok"))
    said = lambda p, o, literal: F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(literal).alias("literal"))
    both = F.array(said("rdf:type", F.lit("sh:ValidationReport"), False), said("sh:conforms", F.col("ok"), True))
    top = head.select(F.lit("_:report").alias("s"), F.explode(both).alias("x")).select("s", "x.*")
    parts = [
        r.select(F.lit("_:report").alias("s"), F.lit("sh:result").alias("p"), F.col("id").alias("o"), F.lit(False).alias("literal")), row(TYPE, F.lit("sh:ValidationResult")),
        row("sh:focusNode", F.col("focus")), row("sh:resultPath", F.col("path")), row("sh:value", F.col("value"), True), row("sh:resultSeverity", F.lit("sh:Violation")),
        row("sh:sourceConstraintComponent", component), row("sh:sourceShape", F.concat("target", F.lit(" "), "of")),
    ]
    return reduce(DataFrame.union, [top, *parts])


def read_report(triples: DataFrame) -> tuple[bool, DataFrame]:
    """(conforms, rows focus, path, component, value) of a report."""
    ok = triples.where("p = 'sh:conforms'").head()["o"] == "true"
    of = triples.where("p = 'sh:result'").select(F.col("o").alias("s"))
    get = lambda p: F.max(F.when(F.col("p") == p, F.col("o")))
    rows = triples.join(of, "s", "left_semi").groupBy("s").agg(get("sh:focusNode").alias("focus"), get("sh:resultPath").alias("path"), get("sh:sourceConstraintComponent").alias("component"), get("sh:value").alias("value"))
    return ok, rows.drop("s")
