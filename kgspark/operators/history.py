"""Edit history (EDT-2, WIN-7): a log of changes with undo, redo and snapshots; any version by its number.

The log has a row an action: graph, seq, action (edit, undo, redo, snapshot, restore, forget) and name (of a snapshot).
An edit's changes are rows of their own: graph, seq, element, id, value (null: deleted). A state is named by the number of
the edit or restore that made it, and state 0 is the empty graph; the states form a tree, as an edit behind an undo starts
a new branch.

``resolve`` folds each graph's actions in order. What it holds is what the user can reach: the last ``KEEP`` states, a
place among them, and the last ``SNAPSHOTS`` snapshots; a new state drops those that could be redone. The fold reads a
stream of actions without their changes, one exchange by graph; a graph's own actions come one after another by their
nature. ``version`` then joins: the states above one, by doubling of their parents, and of each element the last change.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kgspark.plans.graph import cut

# States and snapshots that are kept.
KEEP, SNAPSHOTS = 60, 20
ACTIONS = ("edit", "undo", "redo", "snapshot", "restore", "forget")


class _Fold:
    """One graph's reachable states, while its actions go by."""

    def __init__(self, keep: int, snapshots: int):
        self.keep, self.most = keep, snapshots
        self.states, self.at, self.shots = [0], 0, {}

    def step(self, seq: int, action: str, name: str | None) -> tuple[int, int | None]:
        """(state after the action, parent of the state that it made, if any)."""
        parent = None
        if action == "edit" or (action == "restore" and name in self.shots):
            parent = self.states[self.at] if action == "edit" else self.shots[name]
            self.states = [*self.states[: self.at + 1], seq][-self.keep :]
            self.at = len(self.states) - 1
        elif action == "undo":
            self.at = max(self.at - 1, 0)
        elif action == "redo":
            self.at = min(self.at + 1, len(self.states) - 1)
        elif action == "snapshot":
            self.shots.pop(name, None)
            self.shots[name] = self.states[self.at]
            while len(self.shots) > self.most:
                del self.shots[next(iter(self.shots))]
        elif action == "forget":
            self.shots.pop(name, None)
        return self.states[self.at], parent


def resolve(log: DataFrame, keep: int = KEEP, snapshots: int = SNAPSHOTS) -> DataFrame:
    """graph, seq, action, state (after the action), parent (of the state made here, else null), undoable, redoable.

    Numbers start at 1 and tell a graph's actions apart. Unknown actions and snapshots change nothing.
    """
    out = pa.schema([("graph", pa.string()), ("seq", pa.int64()), ("action", pa.string()), ("state", pa.int64()), ("parent", pa.int64()), ("undoable", pa.int32()), ("redoable", pa.int32())])

    def run(batches):
        graph, fold = None, None
        for batch in batches:
            made = []
            for g, seq, action, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if fold is None or g != graph:
                    graph, fold = g, _Fold(keep, snapshots)
                state, parent = fold.step(seq, action, name)
                made.append((g, seq, action, state, parent, fold.at, len(fold.states) - 1 - fold.at))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), out, strict=True)] if made else [pa.array([], f.type) for f in out], schema=out)

    told = log.select(F.col("graph").cast("string").alias("graph"), F.col("seq").cast("long").alias("seq"), "action", "name")
    return told.repartition("graph").sortWithinPartitions("graph", "seq").mapInArrow(
        run, "graph string, seq long, action string, state long, parent long, undoable int, redoable int"
    )


def lineage(resolved: DataFrame, wanted: DataFrame) -> DataFrame:
    """(graph, state, above): each wanted state (graph, state) with itself and all states that it was made from.

    Parents are doubled: after k rounds a state knows those up to 2^k steps above.
    """
    jump = cut(resolved.where("parent is not null").select("graph", F.col("seq").alias("above"), "parent"))
    seen = front = cut(wanted.select("graph", "state", F.col("state").alias("above")).distinct())
    while True:
        front = cut(seen.join(jump, ["graph", "above"]).select("graph", "state", F.col("parent").alias("above")).join(seen, ["graph", "state", "above"], "left_anti").distinct())
        if front.isEmpty():
            return seen
        seen = cut(seen.union(front))
        next_ = jump.select("graph", F.col("above").alias("parent"), F.col("parent").alias("up"))
        jump = cut(jump.join(next_, ["graph", "parent"]).select("graph", "above", F.col("up").alias("parent")))


def version(resolved: DataFrame, changes: DataFrame, upto: DataFrame | None = None) -> DataFrame:
    """graph, element, id, value: each graph's content now, or right after a number (``upto``: graph, seq).

    Of a state's ancestors the greatest number made the last change, as a state's parent is always older.
    """
    rows = resolved if upto is None else resolved.join(upto.select("graph", F.col("seq").alias("upto")), "graph").where("seq <= upto")
    state = cut(rows.groupBy("graph").agg(F.max_by("state", "seq").alias("state")))
    made = lineage(resolved, state).select("graph", F.col("above").alias("seq"))
    last = W.partitionBy("graph", "element", "id").orderBy(F.desc("seq"))
    rows = changes.withColumn("graph", F.col("graph").cast("string")).join(made, ["graph", "seq"], "left_semi")
    return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1 and value is not null").select("graph", "element", "id", "value")
