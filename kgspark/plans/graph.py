"""The graph type, its schemas and the reliable checkpoint that iterative operators use."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROPERTY = "array<struct<key:string,value:string>>"
NODE = f"id string, label string, type string, description string, x double, y double, properties {PROPERTY}, aliases array<string>, wikidata_id string"
EDGE = (
    "id string, source string, target string, label string, style string, inferred boolean, pos long, "
    "super_relation string, super_inverse boolean, wikidata struct<id:string,label:map<string,string>,transitive:boolean,method:string>"
)


@dataclass(frozen=True)
class Graph:
    """A property graph. Missing columns of the two schemas are added as nulls by ``graph``.

    ``simple``: edges are known to be as ``normalize`` leaves them, so of those with the same ends and label there is one.
    """

    nodes: DataFrame
    edges: DataFrame
    simple: bool = False

    def stored(self) -> Graph:
        """The same graph, its edges stored."""
        return replace(self, edges=cut(self.edges))

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def direct(self) -> DataFrame:
        return self.edges.where(~F.coalesce("inferred", F.lit(False)))


def _padded(df: DataFrame, ddl: str) -> DataFrame:
    from pyspark.sql.types import StructType

    return df.select(
        *(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(ddl)),
        *(c for c in df.columns if c not in {f.name for f in StructType.fromDDL(ddl)}),
    )


def graph(nodes: DataFrame, edges: DataFrame) -> Graph:
    return Graph(_padded(nodes, NODE), _padded(edges, EDGE))


def from_rows(spark: SparkSession, nodes: list[tuple], edges: list[tuple]) -> Graph:
    """A small graph: nodes (id, label, type), edges (id, source, target, label); positions follow the lists."""
    n = spark.createDataFrame([tuple(x) for x in nodes], "id string, label string, type string")
    e = spark.createDataFrame([(*x, k) for k, x in enumerate(edges)], "id string, source string, target string, label string, pos long")
    return graph(n, e)


def is_class(kind: Column) -> Column:
    """Class-like for label resolution: a known type that is neither Instance nor Literal."""
    return F.coalesce(~kind.isin("Instance", "Literal"), F.lit(False))


def class_like(kind: Column) -> Column:
    """Class-like for validation: as above, and also an unknown type."""
    return F.coalesce(~kind.isin("Instance", "Literal"), F.lit(True))


def content_id(prefix: str, *columns: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x01", *columns), 256), 1, 24))


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for reliable checkpoints, as the session names it; a temporary one only where everything runs on one
    machine. On a cluster a folder that executors don't share would lose rows, so there it has to be named."""
    sc = spark.sparkContext
    where = sc._jsc.sc().getCheckpointDir()
    if where.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="kgspark-checkpoint-"))
        where = sc._jsc.sc().getCheckpointDir()
    return where.get()


_cuts: list[str] = []
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def cut(df: DataFrame) -> DataFrame:
    """A Parquet copy in the shared folder: lineage ends there, and plans see its true size.

    (A checkpoint keeps the size that was guessed for its plan; over the rounds of a fixpoint such guesses multiply.)
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _cuts.append(path)
    if _scope.get() is not None:
        _scope.get().append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes copies that ``cut`` gave, once what is made from them is stored; other frames are left alone."""
    for table in tables:
        path = getattr(table, "cut_path", None)
        if path in _cuts:
            _cuts.remove(path)
            _delete(table.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what ``cut`` has written inside it, in this thread; for work whose results are stored by then."""
    mine: list[str] = []
    token = _scope.set(mine)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in mine:
            if path in _cuts:
                _cuts.remove(path)
                _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cuts_made() -> int:
    return len(_cuts)


def clear(spark: SparkSession, first: int = 0, last: int | None = None) -> None:
    """Deletes what ``cut`` has left in the shared folder, all of it or the copies from ``first`` to before ``last`` (as
    ``cuts_made`` counts them): to be called when the results made from it are written or no longer needed."""
    for path in _cuts[first:last]:
        _delete(spark, path)
    del _cuts[first:last]


def missing(edges: DataFrame, nodes: DataFrame, a: str = "source", b: str = "target") -> DataFrame:
    """(id): ends of edges that are no nodes, stored. They are looked up once an id, not once an edge."""
    ends = edges.select(F.col(a).alias("id")).union(edges.select(b)).distinct()
    return cut(ends.where("id is not null").join(nodes.select("id"), "id", "left_anti"))


def inside(edges: DataFrame, nodes: DataFrame, a: str = "source", b: str = "target") -> DataFrame:
    """Edges whose two ends are nodes; where the ends that are none are few, edges don't move for it."""
    gone = missing(edges, nodes, a, b)
    known = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return known.join(gone.withColumnRenamed("id", a), a, "left_anti").join(gone.withColumnRenamed("id", b), b, "left_anti").select(*edges.columns)


def _pairs(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where(f"{a} <> {b}")


def _levels(now: DataFrame) -> Iterator[DataFrame]:
    """The rounds of ``components`` on stored edges (u, v), u the lesser: each node that is left, and where it points (id, up)."""
    first = now
    while not now.isEmpty():
        # u is the lesser end: a node's least neighbour is less than itself only where the node is some edge's v.
        least = cut(now.select(F.col("v").alias("id"), F.col("u").alias("p")).union(now.select("u", "u")).groupBy("id").agg(F.min("p").alias("p")))
        hop = least.select(F.col("id").alias("p"), F.col("p").alias("up"))
        # A pointer leads to a node of this round, so every one finds its next.
        level = cut(least.join(hop, "p").select("id", "up"))
        yield level
        one, two = level.select(F.col("id").alias("u"), F.col("up").alias("x")), level.select(F.col("id").alias("v"), F.col("up").alias("y"))
        renamed = now.join(one, "u").join(two, "v").where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
        before, now = now, cut(renamed.distinct())
        drop(before, least)
    if now is not first:
        drop(now)


def component_count(edges: DataFrame, a: str = "source", b: str = "target") -> tuple[int, int]:
    """(nodes that have an edge, undirected components of them). Where a round's pointers lead is a component, or a node of
    the next round, so nothing is followed back and a round is forgotten once counted."""
    nodes = total = 0
    for k, level in enumerate(_levels(cut(_pairs(edges, a, b)))):
        n, ups = level.agg(F.count("*"), F.count_distinct("up")).head()
        nodes, total = (n, ups) if k == 0 else (nodes, total + ups - n)
    return nodes, total


def components(edges: DataFrame, a: str = "source", b: str = "target") -> DataFrame:
    """Undirected components of an edge list: (id, component), the component named by its least id.

    By contraction: each node points to its least neighbour where that is less than itself, follows the pointer once
    more, and edges are renamed by where their ends point, until no edge is left. A node's least neighbour combines
    before it moves, so a hub is a row a partition; edges and nodes shrink each round, and the pointers of all rounds
    are followed at the end, from the smallest table to the largest. An edge is held in one direction. Nulls and self
    loops are dropped.
    """
    first = cut(_pairs(edges, a, b))
    levels = list(_levels(first))
    if not levels:
        return first.select(F.col("u").alias("id"), F.col("v").alias("component"))
    named = levels.pop().withColumnRenamed("up", "component")
    while levels:
        top = named.select(F.col("id").alias("up"), "component")
        named = cut(levels.pop().join(top, "up", "left").select("id", F.coalesce("component", "up").alias("component")))
    return named
