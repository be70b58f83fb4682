"""User rules over raw edges (RUL): a fold over the rules, each one a projection or a join.

A rule is a dict: type, id, active and the type's own keys. Rules are few and stated by the user; edges are data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions import vocabulary as V
from kgspark.functions.text import lower_trim
from kgspark.plans.graph import Graph, cut

KEYS = ["source", "target", "label"]


def selected(nodes: DataFrame, selector: str | None) -> str | None:
    """The first node, by id, whose label, type or id equals the selector without regard to case."""
    wanted = (selector or "").strip().lower()
    if not wanted:
        return None
    hit = nodes.where((lower_trim("label") == wanted) | (lower_trim("type") == wanted) | (lower_trim("id") == wanted))
    row = hit.agg(F.min("id").alias("id")).head()
    return row["id"]


def _labelled(edges: DataFrame, expected: str | None) -> DataFrame:
    wanted = (expected or "").strip().lower()
    return edges.where(lower_trim(F.coalesce("label", F.lit(""))) == wanted) if wanted else edges


def _first(rule: dict, *names: str):
    return next((rule[n] for n in names if rule.get(n)), None)


def apply_rules(g: Graph, rules: list[dict]) -> DataFrame:
    """Inferred edges source, target, label, rule_id; earlier rules win; nothing that exists, and no self loops."""
    direct = g.direct().select(*KEYS)
    existing = g.edges.select("source", "target", F.coalesce("label", F.lit("")).alias("label"))
    out: DataFrame | None = None

    def add(found: DataFrame, rule: dict) -> None:
        nonlocal out
        new = found.select(*KEYS).where("source <> target").distinct().join(existing, KEYS, "left_anti")
        if out is not None:
            new = new.join(out, KEYS, "left_anti")
        new = cut(new.withColumn("rule_id", F.lit(rule.get("id"))))
        out = new if out is None else out.union(new)

    def types() -> DataFrame:
        known = direct if out is None else direct.union(out.select(*KEYS))
        return known.where(F.col("label") == V.TYPE)

    def edge(source: str, target: str, label: str) -> DataFrame:
        return g.spark.createDataFrame([(source, target, label)], "source string, target string, label string")

    for rule in rules:
        if not rule.get("active"):
            continue
        kind = rule["type"]
        if kind == "transitivity":
            label = rule.get("edgeLabel")
            pool = direct.where(F.col("label") == label) if label else direct
            a, b = pool.select("source", F.col("target").alias("at")), pool.select(F.col("source").alias("at"), "target")
            add(a.join(b, "at").select("source", "target", F.lit(rule.get("conclusionLabel") or label or "inferred").alias("label")), rule)
        elif kind == "inverse":
            label = rule.get("sourceLabel")
            pool = direct.where(F.col("label") == label) if label else direct
            add(pool.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit(rule.get("inverseLabel") or "inverse").alias("label")), rule)
        elif kind in ("domain", "range"):
            node = selected(g.nodes, _first(rule, f"{kind}Class", "conclusion"))
            if node is not None:
                end = "source" if kind == "domain" else "target"
                pool = _labelled(direct, _first(rule, "edgeLabel", "sourceLabel"))
                add(pool.select(F.col(end).alias("source"), F.lit(node).alias("target"), F.lit(V.TYPE).alias("label")), rule)
        elif kind == "subclass":
            parent, child = selected(g.nodes, _first(rule, "parentClass", "conclusion")), selected(g.nodes, _first(rule, "childClass", "condition"))
            if parent is not None and child is not None:
                add(edge(child, parent, V.SUBCLASS), rule)
                add(types().where(F.col("target") == child).select("source", F.lit(parent).alias("target"), "label"), rule)
        elif kind == "equivalentClass":
            left, right = selected(g.nodes, _first(rule, "leftClass", "condition")), selected(g.nodes, _first(rule, "rightClass", "conclusion"))
            if left is not None and right is not None:
                add(edge(left, right, V.EQUIVALENT).union(edge(right, left, V.EQUIVALENT)), rule)
                t = types()
                add(t.where(F.col("target") == left).select("source", F.lit(right).alias("target"), "label").union(t.where(F.col("target") == right).select("source", F.lit(left).alias("target"), "label")), rule)
    return g.edges.select(*KEYS, F.lit(None).cast("string").alias("rule_id")).limit(0) if out is None else out


def of_class(g: Graph, name: str) -> DataFrame:
    """Ids of nodes of a class: their type or a direct or inferred rdf:type edge names it."""
    wanted = name.strip().lower()
    node = selected(g.nodes, name)
    ids = g.nodes.where(lower_trim("type") == wanted).select("id")
    if node is not None:
        ids = ids.union(g.edges.where((F.col("label") == V.TYPE) & (F.col("target") == node)).select("source"))
        ids = ids.union(g.nodes.where(F.col("id") == node).select("id"))
    return ids.distinct()


def check_rules(g: Graph, rules: list[dict]) -> DataFrame:
    """Violations: rule_id, severity, code, node_id, edge_id, count."""
    direct = g.direct()
    none = F.lit(None).cast("string")
    out = None

    def add(df: DataFrame, rule: dict, severity: str, code: str, node, edge=none, count=None) -> None:
        nonlocal out
        rows = df.select(
            F.lit(rule.get("id")).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), node.alias("node_id"),
            edge.alias("edge_id"), (F.lit(None).cast("long") if count is None else count).alias("count"),
        )
        out = rows if out is None else out.union(rows)

    for rule in rules:
        if rule.get("active") is False:
            continue
        kind = rule["type"]
        if kind in ("domain", "range") and rule.get(f"{kind}Class"):
            end = "source" if kind == "domain" else "target"
            pool = _labelled(direct, _first(rule, "edgeLabel", "sourceLabel"))
            good = of_class(g, rule[f"{kind}Class"]).withColumnRenamed("id", end)
            add(pool.join(good, end, "left_anti"), rule, "error", kind, F.col(end), F.col("id"))
        elif kind == "disjointWith":
            left, right = selected(g.nodes, _first(rule, "leftClass", "condition")), selected(g.nodes, _first(rule, "rightClass", "conclusion"))
            if left is not None and right is not None:
                typed = g.edges.where(F.col("label") == V.TYPE)
                both = typed.where(F.col("target") == left).select("source").intersect(typed.where(F.col("target") == right).select("source"))
                add(both.join(g.nodes.select(F.col("id").alias("source")), "source", "left_semi"), rule, "error", "disjointWith", F.col("source"))
        elif kind == "cardinality":
            scope = g.nodes.select("id")
            if rule.get("domainClass"):
                scope = scope.join(of_class(g, rule["domainClass"]), "id", "left_semi")
            pool = _labelled(direct, _first(rule, "edgeLabel", "sourceLabel"))
            n = pool.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n"))
            counted = scope.join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))
            low, high = rule.get("minCardinality"), rule.get("maxCardinality")
            if low not in (None, ""):
                add(counted.where(F.col("n") < float(low)), rule, "warn", "minCardinality", F.col("id"), count=F.col("n"))
            if high not in (None, ""):
                add(counted.where(F.col("n") > float(high)), rule, "error", "maxCardinality", F.col("id"), count=F.col("n"))
    if out is None:
        return g.spark.createDataFrame([], "rule_id string, severity string, code string, node_id string, edge_id string, count long")
    return out
