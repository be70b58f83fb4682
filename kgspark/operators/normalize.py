"""Label resolution and graph normalization (NRM, JN-1, JN-2, WIN-1)."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kgspark.functions import vocabulary as V
from kgspark.functions.text import relation_key
from kgspark.plans.graph import Graph, cut


def typed(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with source_type and target_type (null for dangling ends)."""
    kinds = nodes.select("id", "type")
    s = kinds.select(F.col("id").alias("source"), F.col("type").alias("source_type"))
    t = kinds.select(F.col("id").alias("target"), F.col("type").alias("target_type"))
    return edges.join(s, "source", "left").join(t, "target", "left")


def resolve_labels(rows: DataFrame, words: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Adds found, flipped, relation, new_label and note to rows with label, source_type and target_type."""
    known = V.resolved_labels(rows, words) if known is None else known
    joined = rows.join(known.withColumnRenamed("label", "__label"), F.col("label").eqNullSafe(F.col("__label"))).drop("__label")
    new = V.resolve(F.col("found"), F.col("flipped"), F.col("label"), F.col("source_type"), F.col("target_type"))
    return joined.withColumns({"relation": new["relation"], "new_label": new["label"], "note": new["note"]})


#: So many labels are told as literals, which lets a plan leave out inputs that have none of them; more are joined.
LITERALS = 100


def labelled(edges: DataFrame, labels: DataFrame, keep: bool = True) -> DataFrame:
    """Edges whose label is in a frame of distinct labels, or, without ``keep``, the others."""
    few = [r["label"] for r in labels.select("label").limit(LITERALS + 1).collect()]
    if len(few) > LITERALS:
        same = F.col("label").eqNullSafe(F.col("__label"))
        return edges.join(labels.select(F.col("label").alias("__label")), same, "left_semi" if keep else "left_anti")
    hit = reduce(or_, (F.col("label").eqNullSafe(F.lit(x)) for x in few), F.lit(False))
    return edges.where(hit if keep else ~hit)


def normalize(g: Graph, words: DataFrame | None = None, labels: list[str] | None = None) -> Graph:
    """Canonical labels and directions, without empty ends, self loops and repeats; inferred edges pass through.

    Of equal edges the first by (pos, id) stays; for symmetric labels the two directions are equal. Applying it twice
    changes nothing more: the first label that was rewritten and the last note stay with an edge.

    With ``labels``, only the edges that have one of these labels then: raw labels that can't become one leave first.
    Only edges whose label depends on the types of their ends meet the nodes.
    """
    if g.simple and words is None and labels is None:
        return replace(g, edges=g.edges.withColumn("original_label", F.nullif("original_label", F.lit(""))))
    before = lambda c: F.nullif(F.col(c), F.lit("")) if c in g.edges.columns else F.lit(None).cast("string")
    given, passed = g.direct(), g.edges.where(F.coalesce("inferred", F.lit(False)))
    # A row a distinct label, stored, so that plans see how few there are.
    # What becomes of a label is told there too, with whether that is another label to the eye.
    other = lambda x: F.struct(x.alias("new"), (relation_key("label") != relation_key(x)).alias("other"))
    changes = F.map_from_entries(F.transform(V.outcomes(F.col("found"), F.col("label")), other))
    known = cut(V.resolved_labels(given, words).withColumn("changes", changes))
    if labels is not None:
        known = known.where(F.arrays_overlap(V.outcomes(F.col("found"), F.col("label")), F.array(*map(F.lit, labels))))
        given, passed = labelled(given, known), passed.where(F.col("label").isin(*labels))
    by_type = known.where(V.by_type(F.col("found")))
    unseen = F.lit(None).cast("string")
    free = labelled(given, by_type, keep=False).withColumns({"source_type": unseen, "target_type": unseen})
    rows = resolve_labels(typed(labelled(given, by_type), g.nodes).unionByName(free), words, known)
    earlier, changed = before("original_label"), F.element_at("changes", F.col("new_label"))
    if "original_label" in g.edges.columns:
        changed = F.when(earlier.isNull(), changed).otherwise(relation_key(earlier) != relation_key("new_label"))
    kept = [c for c in g.edges.columns if c not in ("source", "target", "label", "relation", "original_label", "normalization_note")]
    turned = rows.select(
        *kept,
        F.when(F.col("flipped"), F.col("target")).otherwise(F.col("source")).alias("source"),
        F.when(F.col("flipped"), F.col("source")).otherwise(F.col("target")).alias("target"),
        F.col("new_label").alias("label"),
        F.col("relation"),
        F.when(changed, F.coalesce(earlier, F.col("label"))).otherwise(earlier).alias("original_label"),
        F.coalesce(F.col("note"), before("normalization_note")).alias("normalization_note"),
    ).where("coalesce(source, '') <> '' and coalesce(target, '') <> '' and source <> target")
    both = F.col("label").isin(*V.SYMMETRIC)
    a = F.when(both, F.least("source", "target")).otherwise(F.col("source"))
    b = F.when(both, F.greatest("source", "target")).otherwise(F.col("target"))
    first = W.partitionBy("__a", "__b", "label").orderBy(F.col("pos").asc_nulls_last(), "id")
    direct = (
        turned.withColumns({"__a": a, "__b": b}).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__a", "__b", "__n")
    )
    if labels is not None:
        direct = direct.where(F.col("label").isin(*labels))
    return Graph(g.nodes, direct.unionByName(passed, allowMissingColumns=True), simple=True)
