"""Node places (LAY): a grid by tiers and rings by distance from a hub."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.operators.graph import degree, distances
from kgspark.plans.graph import Graph, cut
from kgspark.plans.ranks import numbered

TIERS = ("Class", "Instance", "Literal")


def tiered(g: Graph, columns: int = 8, gap_x: int = 220, gap_y: int = 160) -> DataFrame:
    """(id, x, y): kinds one below another, busiest nodes first in rows of ``columns``."""
    tier = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, TIERS)), F.col("type")), F.lit(0)), F.lit(1))
    n = g.nodes.select("id", tier.alias("tier")).join(degree(g), "id")
    n = cut(numbered(n, ["tier"], [F.desc("degree"), F.col("id")]))
    rows = n.groupBy("tier").agg(F.ceil(F.count("*") / columns).alias("rows"))
    above = rows.alias("a").join(F.broadcast(rows.alias("b")), F.col("b.tier") < F.col("a.tier"), "left").groupBy("a.tier").agg(F.coalesce(F.sum("b.rows"), F.lit(0)).alias("above"))
    # One row a tier.
    return n.join(F.broadcast(above), "tier").select("id", (80 + F.col("k") % columns * gap_x).cast("double").alias("x"), (80 + (F.col("above") + F.floor(F.col("k") / columns)) * gap_y).cast("double").alias("y"))


def radial(g: Graph, ring: float = 220.0) -> DataFrame:
    """(id, x, y): the busiest node in the middle, others on rings by distance; unreached nodes on a last ring."""
    hub = cut(degree(g).orderBy(F.desc("degree"), "id").limit(1).select("id"))
    level = cut(distances(g, hub))
    last = level.agg(F.max("distance").alias("last"))
    n = g.nodes.select("id").join(level, "id", "left").join(F.broadcast(last)).select("id", F.coalesce("distance", F.col("last") + 1).alias("level"))
    n = numbered(n, ["level"], [F.col("id")], size="size")
    angle = F.col("k") * (2 * math.pi) / F.col("size")
    return n.select("id", (F.col("level") * ring * F.cos(angle)).alias("x"), (F.col("level") * ring * F.sin(angle)).alias("y"))
