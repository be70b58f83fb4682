"""Merging graphs and nodes, edits (SET, EDT, JN-9, JN-19)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kgspark.functions.text import connect_norm, lower_trim
from kgspark.plans.graph import Graph, content_id

NO_PROPERTIES = "array<struct<key:string,value:string>>"


def _properties(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, properties): the union of property lists, the first value of each property key by order."""
    p = rows.select(key, order, F.posexplode("properties").alias("at", "p")).groupBy(key, F.col("p.key").alias("k")).agg(
        F.min(F.struct(order, "at", F.col("p.value").alias("v"))).alias("m")
    )
    merged = F.transform(F.sort_array(F.collect_list(F.struct(F.col(f"m.{order}").alias("o"), F.col("m.at").alias("at"), "k", F.col("m.v").alias("v")))), lambda x: F.struct(x["k"].alias("key"), x["v"].alias("value")))
    return p.groupBy(key).agg(merged.alias("properties"))


def merge_graphs(parts: DataFrame, edges: DataFrame) -> Graph:
    """One graph of many parts. Nodes: part, id, label, type, description, properties; edges: part, source, target, label.

    Nodes are one by lower-case label and type: the first part's label, the first non-empty description, all property
    keys. Edges find their ends by id or label in their own part; equal ends and lower-case labels are one edge.
    """
    key = F.concat_ws("|", F.lower("label"), "type")
    n = parts.withColumns({"key": key, "ord": F.struct("part", "id")})
    described = F.when(F.coalesce("description", F.lit("")) != "", F.struct("ord", "description"))
    merged = n.groupBy("key").agg(F.min(F.struct("ord", "label", "type")).alias("first"), F.min(described)["description"].alias("description"))
    merged = merged.join(_properties(n.withColumn("properties", F.coalesce("properties", F.array().cast(NO_PROPERTIES))), "key", "ord"), "key", "left")
    nodes = merged.select(
        content_id("node_", F.col("key")).alias("id"), "first.label", "first.type", F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("properties", F.array().cast(NO_PROPERTIES)).alias("properties"), "key",
    )
    names = n.select("part", F.col("id").alias("name"), "id", "key").union(n.select("part", F.col("label").alias("name"), "id", "key"))
    names = names.groupBy("part", "name").agg(F.min(F.struct("id", "key"))["key"].alias("key"))
    s = names.select("part", F.col("name").alias("source"), F.col("key").alias("sk"))
    t = names.select("part", F.col("name").alias("target"), F.col("key").alias("tk"))
    e = edges.join(s, ["part", "source"]).join(t, ["part", "target"]).where("sk <> tk").withColumn("low", F.lower(F.coalesce("label", F.lit(""))))
    first = W.partitionBy("sk", "tk", "low").orderBy("part", "label")
    e = e.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    sid, tid = content_id("node_", F.col("sk")), content_id("node_", F.col("tk"))
    e = e.select(content_id("edge_", sid, tid, F.col("low")).alias("id"), sid.alias("source"), tid.alias("target"), F.coalesce("label", F.lit("")).alias("label"), F.lit(False).alias("inferred"))
    return Graph(nodes.drop("key"), e)


def merge_into(current: Graph, incoming: Graph, shift: float = 400.0) -> Graph:
    """Incoming nodes whose trimmed lower-case label is new come in, moved aside; edges follow to the existing nodes."""
    have = current.nodes.groupBy(lower_trim("label").alias("k")).agg(F.min("id").alias("to"))
    inc = incoming.nodes.withColumn("k", lower_trim("label"))
    first = inc.groupBy("k").agg(F.min("id").alias("keep"))
    new = inc.join(first, "k").where("id = keep").join(have, "k", "left_anti").withColumn("x", F.col("x") + shift)
    to = inc.join(have, "k", "left").join(first, "k").select("id", F.coalesce("to", "keep").alias("to"))
    e = remap(incoming.direct(), to)
    known = current.edges.select("source", "target", F.coalesce("label", F.lit("")).alias("label"))
    e = e.withColumn("label", F.coalesce("label", F.lit(""))).dropDuplicates(["source", "target", "label"]).join(known, ["source", "target", "label"], "left_anti")
    return Graph(
        current.nodes.unionByName(new.select(*[c for c in current.nodes.columns if c in new.columns]), allowMissingColumns=True),
        current.edges.unionByName(e.select(*[c for c in current.edges.columns if c in e.columns]), allowMissingColumns=True),
    )


def remap(edges: DataFrame, to: DataFrame) -> DataFrame:
    """Edges with ends replaced by ``to`` (id, to); edges with an unmapped end and self loops go."""
    s, t = to.select(F.col("id").alias("source"), F.col("to").alias("__s")), to.select(F.col("id").alias("target"), F.col("to").alias("__t"))
    moved = edges.join(s, "source").join(t, "target").where("__s <> __t")
    return moved.withColumns({"source": F.col("__s"), "target": F.col("__t")}).drop("__s", "__t")


def accept_merges(g: Graph, pairs: DataFrame) -> Graph:
    """Nodes ``gone`` become ``kept``: edges are redirected, self loops go, and one edge of each (source, target) stays."""
    to = g.nodes.select("id").join(pairs.select(F.col("gone").alias("id"), "kept"), "id", "left").select("id", F.coalesce("kept", "id").alias("to"))
    moved = remap(g.edges, to)
    first = W.partitionBy("source", "target").orderBy(F.col("pos").asc_nulls_last(), "id")
    moved = moved.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return Graph(g.nodes.join(pairs.select(F.col("gone").alias("id")), "id", "left_anti"), moved.select(*g.edges.columns))


def delete_nodes(g: Graph, ids: DataFrame) -> Graph:
    ids = ids.select("id").distinct()
    e = g.edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti").join(ids.withColumnRenamed("id", "target"), "target", "left_anti")
    return Graph(g.nodes.join(ids, "id", "left_anti"), e.select(*g.edges.columns))


def add_edges(g: Graph, new: DataFrame) -> Graph:
    """New edges whose (source, target) has no edge yet."""
    fresh = new.dropDuplicates(["source", "target"]).join(g.edges.select("source", "target"), ["source", "target"], "left_anti")
    return Graph(g.nodes, g.edges.unionByName(fresh, allowMissingColumns=True))


def clear_inferred(g: Graph) -> Graph:
    return Graph(g.nodes, g.direct())


def apply_inferred(g: Graph, inferred: DataFrame) -> Graph:
    return Graph(g.nodes, g.direct().unionByName(inferred.withColumn("inferred", F.lit(True)), allowMissingColumns=True))


def copy_nodes(nodes: DataFrame, offset: float = 32.0) -> DataFrame:
    return nodes.withColumns({"id": content_id("copy_", F.col("id")), "x": F.col("x") + offset, "y": F.col("y") + offset})


def autoconnect(g: Graph, label: str = "has-property") -> DataFrame:
    """Edges from nodes to the literal nodes that their property values name: source, target, label, new literal's label.

    Values find a literal by normal form; values without one make a new literal, one for equal forms.
    """
    p = g.nodes.where("type <> 'Literal'").select("id", F.explode("properties").alias("p")).select("id", connect_norm("p.value").alias("k"), F.col("p.value").alias("value")).where("k <> ''")
    lit = g.nodes.where("type = 'Literal'").groupBy(connect_norm("label").alias("k")).agg(F.min("id").alias("to"))
    first = p.groupBy("k").agg(F.min("value").alias("made"))
    e = p.join(lit, "k", "left").join(first, "k").select(
        F.col("id").alias("source"), F.coalesce("to", content_id("lit_", F.col("k"))).alias("target"), F.lit(label).alias("label"), F.when(F.col("to").isNull(), F.col("made")).alias("new_literal"),
    ).distinct()
    return e.join(g.edges.select("source", "target"), ["source", "target"], "left_anti")
