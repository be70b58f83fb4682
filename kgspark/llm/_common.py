"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.plans.graph import components, cut, drop

__all__ = ["connected", "cut", "drop", "map_columns", "table", "worker_state"]

#: Rows of a batch that are Python objects at one time. Batches themselves are bounded by bytes, by Spark
#: (spark.sql.execution.arrow.maxBytesPerBatch).
SLICE = 512
_ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "string": pa.string(),
    "boolean": pa.bool_(),
    "double": pa.float64(),
    "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
    "array<float>": pa.list_(pa.float32()),
    "array<string>": pa.list_(pa.string()),
}


BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Sets Spark's limit of bytes a batch that goes to Python, unless the session has one of its own.

    For the driver's queries and the pipeline, which own the run; operators leave the session as it is.
    """
    if spark.conf.get(_LIMIT) in ("67108864b", "67108864", "64MB"):
        spark.conf.set(_LIMIT, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_columns(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable], carry: tuple[str, ...] = ()) -> DataFrame:
    """Applies a row-block function inside Arrow batches.

    ``make`` runs once a task and returns ``f(*column lists) -> tuple of output lists``. Columns in ``carry`` pass
    through untouched, before the made ones; the function must then give one output row for each input row.
    """
    fields = []
    inputs = len(columns)
    for part in schema.split(", "):
        name, kind = part.split(" ", 1)
        fields.append(pa.field(name, _ARROW[kind]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                out = f(*(c.to_pylist() for c in part.columns[:inputs]))
                kept = part.columns[inputs:]
                made = [pa.array(v, t.type) for v, t in zip(out, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=[*carry, *(t.name for t in fields)])

    given = df.select(*columns, *(F.col(c).alias(f"__carry_{k}") for k, c in enumerate(carry)))
    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in carry)
    return given.mapInArrow(run, kinds + schema)


_held: dict[str, tuple[str, object]] = {}


def worker_state(what: str, name: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps between the tasks it runs, such as a loaded tokenizer and its remembered words: one
    thing of each kind, made anew where another one is named."""
    if what not in _held or _held[what][0] != name:
        _held[what] = name, make()
    return _held[what][1]


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list: rows (node, label), label the least node of each component."""
    return components(edges, a, b).select(F.col("id").alias("node"), F.col("component").alias("label"))
