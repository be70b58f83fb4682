"""N-gram Jaccard join by MinHash banding.

Shingles are runs of ``SHINGLE`` words (lower-cased letters, digits and non-ASCII characters); a shorter text is one
shingle. Documents with equal shingle sets are one node, named by 128 bits of the set's digest. Bands and rows are
chosen for a target recall at the threshold. Nodes that share a band hash are in one bucket, and pairs are verified on
their full shingle sets:

* Every node is dealt to a group, named by the least node that it shares a bucket with; a group is cut into blocks of
  about ``BLOCK`` nodes.
* Two blocks that meet in some bucket are one unit of work, and so is a block with itself. A unit holds the nodes that
  stand in such a bucket, once each, so what moves follows the buckets and not the square of a chain of them; only a
  dense group of near copies is compared all with all, block by block.
* A unit gives one row a node, its number of links and a representative of its linked neighbours. No pair is ever a
  row, and no bucket or group is gathered in a task. As each node has one block, no pair is met in two units.

Result: one row a document row, with its class (connected by links; the least doc_id names it) and its number of links,
copies included. Null, empty and wordless texts have no shingles: no links, a class of its own. Repeated rows are copies
of each other. A very long text is one set of 8 bytes a word. Rows are told apart by (doc_id, text key), so a doc_id may
be null or stand on different texts: each such row has the class and links of its own text, and a class that has only
null ids is named by null. An empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm._common import connected, cut, map_columns
from kgspark.llm.decontam import words

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.99999
HASHES = 350
#: Nodes of a block: two blocks are compared at once, in matrices of four times its square.
BLOCK = 1024
#: Words whose hashes a task remembers.
CACHE = 200_000
#: A node that has one of so many rows, or more, is hot: there are at most so many of them, whatever the table.
HOT_SHARE = 1000


def banding(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective rows whose bands reach the recall at the threshold within the hash budget."""
    best = (hashes, 1)
    for rows in range(1, 64):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


class _WordHashes(dict):
    def __missing__(self, w: bytes) -> int:
        import xxhash

        self[w] = h = xxhash.xxh64_intdigest(w)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, memo: dict, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, w), np.uint64, len(w))
    k = min(size, len(w))
    total = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[i : len(w) - k + 1 + i]
    return np.unique(_mix(total + np.uint64(k)))


class MinHash:
    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(2024)
        n = bands * rows
        self.shape = bands, rows
        self.a = (rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = rng.integers(0, 2**32, n, dtype=np.uint32)[:, None]
        self.m = rng.integers(0, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.band = rng.integers(0, 2**63, bands, dtype=np.uint64)
        self.buffer = np.empty((n, 256), np.uint32)

    def bands(self, s: np.ndarray) -> np.ndarray:
        v = (s >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.a), 2**32 - 1, np.uint32)
        for at in range(0, len(v), 256):
            part = v[at : at + 256]
            out = self.buffer[:, : len(part)]
            np.multiply(self.a, part, out=out)
            np.add(out, self.b, out=out)
            np.minimum(least, out.min(axis=1), out=least)
        rows = _mix(least.astype(np.uint64) + np.uint64(1)).reshape(self.shape)
        return _mix((rows * self.m).sum(axis=1, dtype=np.uint64) + self.band).view(np.int64)


def signatures(docs: DataFrame, bands: int, rows: int, size: int = SHINGLE) -> DataFrame:
    """doc_id, key, node (null without words), bands; docs has doc_id, key, text."""

    def make():
        memo, minhash = _WordHashes(), MinHash(bands, rows)

        def f(texts):
            if len(memo) > CACHE:
                memo.clear()
            nodes, hashes = [], []
            for t in texts:
                s = shingles(t, memo, size)
                if len(s):
                    nodes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    hashes.append(minhash.bands(s))
                else:
                    nodes.append(None)
                    hashes.append(None)
            return nodes, hashes

        return f

    return map_columns(docs, ["text"], "node binary, bands array<long>", make, ("doc_id", "key"))


def _verified(copies: np.ndarray, sets: list[np.ndarray], side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of each node of a unit. Side is 0 or 1 for two blocks, of which only pairs across count, or 2 for
    a block with itself; root is the least place among the node and what it is linked to, over any number of links."""
    k = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(k), sizes)
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    keep = shared[place]
    owner, place = owner[keep], column[place[keep]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    common = np.zeros((k, k), np.float32)  # counts, exact below 2^24
    width = max(1, 8_000_000 // k)
    total = int(shared.sum())
    for at in range(0, total, width):
        lo, hi = np.searchsorted(place, (at, at + width))
        m = np.zeros((k, min(width, total - at)), np.float32)
        m[owner[lo:hi], place[lo:hi] - at] = 1
        common += m @ m.T
    linked = np.empty((k, k), bool)
    for at in range(0, k, 256):
        rows = slice(at, at + 256)
        union = sizes[rows, None] + sizes[None, :] - common[rows].astype(np.float64)
        linked[rows] = (common[rows] >= threshold * union - 1e-9) & ((side[rows, None] != side[None, :]) | (side[rows, None] == 2))
    np.fill_diagonal(linked, False)
    root = np.arange(k, dtype=np.int32)
    while True:
        near = np.minimum(root, np.where(linked, root[None, :], np.int32(k)).min(axis=1, initial=k))
        near = near[near]
        if (near == root).all():
            return linked @ copies, root
        root = near


def verify(units: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows node, links, root; input rows: a, b (blocks), side, node, copies, shingles, with units whole and in a row."""
    out = pa.schema([("node", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])

    def run(batches):
        key, group = None, {}

        def close():
            nodes = list(group)
            rows = list(group.values())
            if len(rows) < 2:
                return None
            links, root = _verified(
                np.array([r[1] for r in rows], np.int64), [np.frombuffer(r[2], np.uint64) for r in rows], np.array([r[0] for r in rows]), threshold
            )
            hit = np.flatnonzero(links)
            return pa.RecordBatch.from_arrays(
                [pa.array([nodes[k] for k in hit], pa.binary()), pa.array(links[hit]), pa.array([nodes[root[k]] for k in hit], pa.binary())], schema=out
            )

        for batch in batches:
            for a, b, side, node, copies, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (a, b):
                    if (made := close()) is not None:
                        yield made
                    key, group = (a, b), {}
                group[node] = (side, copies, data)
        if (made := close()) is not None:
            yield made

    return units.select("a", "b", "side", "node", "copies", "shingles").mapInArrow(run, "node binary, links long, root binary")


def shingle_sets(docs: DataFrame, columns: list[str], kinds: str, size: int = SHINGLE) -> DataFrame:
    def make():
        memo = _WordHashes()

        def f(texts, *rest):
            if len(memo) > CACHE:
                memo.clear()
            return (*rest, [shingles(t, memo, size).tobytes() for t in texts])

        return f

    return map_columns(docs, ["text", *columns], f"{kinds}, shingles binary", make)


PLACE = ["void", "id", "key"]
#: A character that is part of a word.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def _place(doc_id, key) -> list:
    """Columns PLACE, without nulls: what tells rows apart. Rows with a null doc_id come last."""
    return [F.isnull(doc_id).alias("void"), F.coalesce(doc_id, F.lit(0)).cast("long").alias("id"), (F.col(key) if isinstance(key, str) else key).alias("key")]


def units_of(dealt: DataFrame) -> DataFrame:
    """Rows a, b, side, node: which nodes meet in which unit of work; dealt has (node, h), h a band hash."""
    dealt = dealt.repartition("h")
    buckets = dealt.groupBy("h").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    met = cut(dealt.join(buckets.select("h", "least"), "h"))
    groups = met.groupBy("node").agg(F.min("least").alias("lead"))
    parts = groups.groupBy("lead").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    block = F.xxhash64("lead", F.pmod(F.xxhash64("node"), F.col("parts")))
    blocks = groups.join(parts, "lead").select("node", block.alias("block"))
    placed = cut(met.select("h", "node").join(blocks, "node"))
    present = placed.groupBy("h", "block").agg(F.count("*").alias("n"))
    here, there = placed.alias("x"), present.alias("y")
    pairs = here.join(there, F.col("x.h") == F.col("y.h")).where("x.block <> y.block or y.n > 1")
    mine, other = F.col("x.block"), F.col("y.block")
    side = F.when(mine == other, 2).otherwise(F.when(mine < other, 0).otherwise(1))
    return pairs.select(F.least(mine, other).alias("a"), F.greatest(mine, other).alias("b"), side.alias("side"), F.col("x.node").alias("node")).distinct()


def _classed(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, size: int = SHINGLE) -> DataFrame:
    """doc_id, key, keeper (PLACE of the row that names the class; null without words), n_links of every document row."""
    bands, rows = banding(threshold, recall)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    signed = cut(signatures(keyed, bands, rows, size))
    first = F.min(F.struct(*_place("doc_id", "key"))).alias("first")
    nodes = cut(signed.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), first))
    meeting = cut(units_of(signed.where("node is not null").select("node", F.explode("bands").alias("h"))))
    chosen = meeting.select("node").distinct().join(nodes, "node")
    # One text for each node that meets another: its first row, once.
    texts = keyed.select(*_place("doc_id", "key"), "text").join(chosen.select("first.*", "node", "copies"), PLACE).dropDuplicates(PLACE)
    sets = shingle_sets(texts, ["node", "copies"], "node binary, copies long", size)
    units = meeting.join(sets, "node").repartition("a", "b").sortWithinPartitions("a", "b")
    found = cut(verify(units, threshold))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected(found.where("node <> root"), "node", "root")
    named = (
        nodes.join(links, "node", "left").join(classes, "node", "left")
        .select("node", "copies", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "node").alias("label"))
    )
    least = named.groupBy("label").agg(F.min("first").alias("keeper"))
    known = cut(named.join(least, "label").select("node", "copies", "keeper", (F.col("links") + F.col("copies") - 1).alias("n_links")))
    worded = signed.select("doc_id", "key", "node").where("node is not null")
    total = nodes.agg(F.sum("copies")).head()[0] or 0
    # At most HOT_SHARE nodes can hold that share of all rows.
    hot = known.where(F.col("copies") * HOT_SHARE > total).where(F.col("copies") > 1)
    columns = ["doc_id", "key", "keeper", "n_links"]
    return (
        worded.join(F.broadcast(hot), "node").select(*columns)
        .unionByName(worded.join(F.broadcast(hot.select("node")), "node", "left_anti").join(known, "node").select(*columns))
        .unionByName(signed.where("node is null").select("doc_id", "key", F.lit(None).cast(known.schema["keeper"].dataType).alias("keeper"), F.lit(0).cast("long").alias("n_links")))
    )


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, size: int = SHINGLE) -> DataFrame:
    """doc_id, class_id, n_links of every document row."""
    named = F.when(F.col("keeper.void"), F.lit(None)).otherwise(F.coalesce("keeper.id", "doc_id")).alias("class_id")
    return _classed(docs, threshold, recall, size).select("doc_id", named, "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document row of each class; all columns as they were.

    The least doc_id stays, of rows that share it the one with the least text key, and of rows that repeat both any one;
    a row without a doc_id stays only where its class has no other. Rows without words are classes of their own and stay.
    """
    keepers = _classed(docs).where("keeper is not null").select("keeper.*").distinct()
    told = docs.select(*(F.col(c).alias(f"__d{k}") for k, c in enumerate(docs.columns)), *_place(docs["doc_id"], F.xxhash64(docs["text"])))
    one = told.join(keepers, PLACE, "left_semi").dropDuplicates(PLACE)
    text = f"__d{docs.columns.index('text')}"
    wordless = told.where(F.col(text).isNull() | ~F.col(text).rlike(WORD))
    return one.unionByName(wordless).select(*(F.col(f"__d{k}").alias(c) for k, c in enumerate(docs.columns)))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, least(doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = doc_id), doc_id)) AS class_id,
  (SELECT count(*) FROM l WHERE l.a = doc_id) AS n_links
FROM documents
"""
