"""Graph patterns over triples as DataFrame joins (SPQ), and shape checks (SHC).

Patterns are data, not query text: a list of (subject, predicate, object), variables as ``?name``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.plans.graph import cut

Pattern = tuple[str, str, str]


def is_var(term: str) -> bool:
    return term.startswith("?")


def match_one(triples: DataFrame, pattern: Pattern) -> DataFrame:
    """Bindings of one pattern: a column a variable. A predicate that ends in ``+`` is followed once or more often."""
    s, p, o = pattern
    rows = triples.select("s", "p", "o")
    if not is_var(p) and p.endswith("+"):
        rows, p = transitive(rows, p[:-1]), p[:-1]
    elif not is_var(p) and p.startswith("^"):
        return match_one(triples, (o, p[1:], s))
    names = {}
    for column, term in (("s", s), ("p", p), ("o", o)):
        if not is_var(term):
            rows = rows.where(F.col(column) == term)
        elif term in names:
            rows = rows.where(F.col(column) == F.col(names[term]))
        else:
            names[term] = column
    return rows.select(*(F.col(c).alias(v[1:]) for v, c in names.items())).distinct() if names else rows.select(F.lit(True).alias("__found")).limit(1)


def transitive(triples: DataFrame, predicate: str) -> DataFrame:
    """Pairs joined by one or more steps of a predicate, path lengths doubling each round."""
    # Concatenation with nothing drops what the optimizer knows of the columns: it can't carry that through the unions
    # of a stored frame with itself.
    fresh = (F.concat(c, F.lit("")).alias(c) for c in ("s", "o"))
    known = cut(triples.where(F.col("p") == predicate).select(*fresh).distinct())
    delta = known
    while True:
        step = _followed(delta, known)
        back = _followed(known, delta)
        new = cut(step.union(back).distinct().join(known, ["s", "o"], "left_anti"))
        if new.isEmpty():
            return known.select("s", F.lit(predicate).alias("p"), "o")
        known, delta = known.union(new), new


def _followed(a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select(F.col("s").alias("first"), F.col("o").alias("m"))
    right = b.select(F.col("s").alias("m"), F.col("o").alias("last"))
    return left.join(right, "m").select(F.col("first").alias("s"), F.col("last").alias("o"))


def _joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("a pattern shares no variable with those before it")
    return left.join(right, shared, how)


def select(
    triples: DataFrame, where: list[Pattern], optional: list[list[Pattern]] = (), minus: list[list[Pattern]] = (),
    condition: Column | None = None, variables: list[str] | None = None, distinct: bool = False,
) -> DataFrame:
    """Rows of a basic pattern with optional and excluded groups. Patterns with more fixed terms are joined first."""
    group = lambda ps: reduce(lambda a, b: _joined(a, b, "inner"), map(lambda p: match_one(triples, p), _ordered(ps)))
    rows = group(where)
    for ps in optional:
        rows = _joined(rows, group(ps), "left")
    for ps in minus:
        rows = _joined(rows, group(ps), "left_anti")
    if condition is not None:
        rows = rows.where(condition)
    if variables:
        rows = rows.select(*variables)
    return rows.distinct() if distinct else rows


def _ordered(patterns: list[Pattern]) -> list[Pattern]:
    """Most fixed terms first, each next one sharing a variable with what is joined already."""
    todo = sorted(patterns, key=lambda p: sum(map(is_var, p)))
    out, seen = [todo.pop(0)], set()
    seen |= {t for t in out[0] if is_var(t)}
    while todo:
        k = next((k for k, p in enumerate(todo) if seen & {t for t in p if is_var(t)}), 0)
        out.append(todo.pop(k))
        seen |= {t for t in out[-1] if is_var(t)}
    return out


def graph_triples(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Plain triples of a graph: kinds, labels and edges."""
    kind = nodes.select(F.col("id").alias("s"), F.lit("kind").alias("p"), F.col("type").alias("o"))
    label = nodes.select("id", F.lit("rdfs:label"), "label")
    return kind.union(label).union(edges.select("source", "label", "target")).where("o is not null")


def violations(triples: DataFrame, shapes: DataFrame, type_predicate: str = "rdf:type") -> DataFrame:
    """(class, kind, path, focus, value) where a shape does not hold; shapes as ``exports.shapes`` gives them."""
    member = triples.where(F.col("p") == type_predicate).select(F.col("s").alias("focus"), F.col("o").alias("class"))
    values = triples.select(F.col("s").alias("focus"), F.col("p").alias("path"), F.col("o").alias("value"))
    scope = shapes.select("class", "kind", "path", F.col("value").alias("want")).join(member, "class")
    none = F.lit(None).cast("string")
    few = scope.where("kind = 'minCount'").join(values.groupBy("focus", "path").agg(F.count("*").alias("n")), ["focus", "path"], "left")
    few = few.where(F.coalesce("n", F.lit(0)) < F.col("want").try_cast("int")).select("class", "kind", "path", "focus", none.alias("value"))
    subjects = triples.select(F.col("s").alias("value")).distinct()
    kind = scope.where("kind = 'nodeKind'").join(values, ["focus", "path"]).join(subjects, "value", "left_anti").select("class", "kind", "path", "focus", "value")
    typed = member.select(F.col("focus").alias("value"), F.col("class").alias("want"))
    wrong = scope.where("kind = 'class'").join(values, ["focus", "path"]).join(typed, ["value", "want"], "left_anti").select("class", "kind", "path", "focus", "value")
    return few.union(kind).union(wrong)
