"""Centroid clustering by delta Lloyd rounds over an integer grid.

A vector is kept if it has exactly ``dims`` components, none null or non-finite, and each becomes floor(256 * x). The
assignment of every vector is stored with its squared distance; sums and counts by cluster are global. A round compares
a vector whose owner has stayed where it was with the centroids that have moved only (its stored distance still holds),
and one whose owner has moved with all of them. Vectors that change hands give signed transfers, which are summed by
task, then by cluster, and added to the global sums; what the driver holds is one row a cluster. All of it is integer
arithmetic, so results do not depend on the partitioning. Distances are products of matrices in doubles while they are
exact there, which each batch checks, and in 64-bit integers otherwise.

Result: one row a kept vector row. Seeds are the vectors of the smallest hashes of their ids; equal ids (repeated rows)
are ordered by components; rows with a null id are clustered, and are seeds only where too few others are there. With
fewer vectors than clusters each is a seed, and clusters that have the same seed leave all but the first empty. A
component beyond ``LIMIT`` in size has squared distances that a long cannot hold: such a vector is not kept. Sums of
distances that do not fit a long are null. No kept vectors, or an empty table: an empty result. Other columns are not
read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm._common import cut, drop

CLUSTERS = 40
ROUNDS = 5
DIMS = 64
SCALE = 256
SEED = 2
#: Largest size of a grid component: 64 squares of twice as much stay below 2^63.
LIMIT = 2**27
_STATE = "vec_id long, grid array<int>, owner int, distance long"


def grid(vectors: DataFrame, dims: int = DIMS) -> DataFrame:
    """vec_id, grid of the kept vectors."""
    x = F.col("embedding")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) <= LIMIT / SCALE - 1))
    floored = F.transform(x, lambda v: F.floor(v.cast("double") * SCALE).cast("int"))
    return vectors.where((F.size(x) == dims) & whole).select(F.col("vec_id").cast("long").alias("vec_id"), floored.alias("grid"))


def seeds(kept: DataFrame, clusters: int = CLUSTERS) -> np.ndarray:
    """The first centroids: a row of components each."""
    rank = F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(rank.alias("rank"), "grid").orderBy(F.asc_nulls_last("rank"), "grid").limit(clusters).collect()
    return np.array([r["grid"] for r in rows], np.int64)


def _distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, exact."""
    exact = max(int(np.abs(v).max(initial=0)), int(np.abs(c).max(initial=0))) ** 2 * 4 * v.shape[1] < 2**53
    x, y = (v.astype(np.float64), c.astype(np.float64)) if exact else (v, c)
    if not exact:
        return np.stack([((x - row) ** 2).sum(axis=1) for row in y], axis=1)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)).astype(np.int64)


def _nearest(v: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, moved: np.ndarray):
    """(owner, distance) after centroids have moved; the places of those are ``moved``. An owner below 0: none yet."""
    owner, distance = owner.copy(), distance.copy()
    anew = (owner < 0) | np.isin(owner, moved)
    if anew.any():
        d = _distances(v[anew], centroids)
        owner[anew] = d.argmin(axis=1)
        distance[anew] = d.min(axis=1)
    if len(moved) and not anew.all():
        d = _distances(v[~anew], centroids[moved])
        best = d.argmin(axis=1)
        near, who = d.min(axis=1), moved[best]
        better = (near < distance[~anew]) | ((near == distance[~anew]) & (who < owner[~anew]))
        at = np.flatnonzero(~anew)[better]
        owner[at], distance[at] = who[better], near[better]
    return owner, distance


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims).astype(np.int64)


def assign(state: DataFrame, centroids: np.ndarray, moved: np.ndarray) -> DataFrame:
    """The state after a comparison, with ``was``, the owner before it."""
    dims = centroids.shape[1]

    def run(batches):
        for batch in batches:
            was, before = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3))
            owner, distance = _nearest(_matrix(batch.column(1), dims), was, before, centroids, moved)
            made = [pa.array(owner.astype(np.int32)), pa.array(distance), batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], names=["vec_id", "grid", "owner", "distance", "was"])

    return state.select("vec_id", "grid", "owner", "distance").mapInArrow(run, f"{_STATE}, was int")


def transfers(state: DataFrame, clusters: int, dims: int) -> DataFrame:
    """cluster, place (dims: the count), amount: what each cluster has gained, less what it has lost."""

    def run(batches):
        total = np.zeros((clusters, dims + 1), np.int64)
        for batch in batches:
            v = _matrix(batch.column(0), dims)
            v = np.concatenate([v, np.ones((len(v), 1), np.int64)], axis=1)
            owner, was = (batch.column(k).to_numpy() for k in (1, 2))
            np.add.at(total, owner, v)
            np.subtract.at(total, was[was >= 0], v[was >= 0])
        c, p = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(p), pa.array(total[c, p])], names=["cluster", "place", "amount"])

    moved = state.where("owner <> was").select("grid", "owner", "was")
    return moved.mapInArrow(run, "cluster long, place long, amount long").groupBy("cluster", "place").agg(F.sum("amount").alias("amount"))


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS) -> tuple[DataFrame, np.ndarray]:
    """(rows vec_id, owner, distance; the final centroids). The rows are a stored table."""
    kept = grid(vectors, dims)
    state = cut(kept.withColumn("owner", F.lit(-1)).withColumn("distance", F.lit(0).cast("long")))
    centroids = seeds(state, clusters)
    if not len(centroids):
        return state.select("vec_id", "owner", "distance"), centroids
    sums = np.zeros((len(centroids), dims + 1), np.int64)
    moved = np.arange(len(centroids))
    for k in range(rounds + 1):
        if not len(moved):
            break  # no centroid has moved: nothing else would
        before, state = state, cut(assign(state, centroids, moved))
        drop(before)
        if k == rounds:
            break
        for r in transfers(state, len(centroids), dims).collect():
            sums[r["cluster"], r["place"]] += r["amount"]
        filled = sums[:, dims] > 0
        after = centroids.copy()
        after[filled] = sums[filled, :dims] // sums[filled, dims:]
        moved = np.flatnonzero((after != centroids).any(axis=1))
        centroids = after
    return state.select("vec_id", "owner", "distance"), centroids


def digest(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    spark = rows.sparkSession
    by_cluster = {r["owner"]: r["d"] for r in rows.groupBy("owner").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    fits = lambda x: x if x < 2**63 else None
    whole = fits(int(sum(by_cluster.values())))
    hashes = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    known = [(k, fits(int(by_cluster.get(k, 0))), whole, h) for k, h in enumerate(hashes)]
    # A row a cluster.
    side = spark.createDataFrame(known, "owner int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(side), "owner").select("vec_id", F.col("owner").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS) -> str:
    ctes = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS g
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        """f AS MATERIALIZED (SELECT r, p, g[p] AS x FROM v, range(1, 65) t(p))""".replace("65", str(dims + 1)),
        f"""s AS (SELECT r, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), g) - 1 AS c FROM v)""",
        f"""c0 AS MATERIALIZED (SELECT c, p, x FROM s JOIN f USING (r) WHERE c < {clusters})""",
    ]
    for k in range(rounds + 1):
        ctes.append(f"""a{k} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM
  (SELECT f.r, c.c, CAST(sum((f.x - c.x) * (f.x - c.x)) AS BIGINT) AS d FROM f JOIN c{k} c USING (p) GROUP BY f.r, c.c) GROUP BY r)""")
        if k < rounds:
            ctes.append(f"""m{k} AS (SELECT c, p, CAST(sum(x) AS BIGINT) AS t, count(*) AS n FROM a{k} JOIN f USING (r) GROUP BY c, p),
c{k + 1} AS MATERIALIZED (SELECT c, p, CAST(coalesce((t - ((t % n) + n) % n) // n, x) AS BIGINT) AS x FROM c{k} LEFT JOIN m{k} USING (c, p))""")
    last = f"c{rounds}"
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p)) AS h FROM {last} GROUP BY c) USING (c)"""
