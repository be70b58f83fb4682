"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has 64 bits: one is set where over half of a text's shingle hashes (XXH64, seed 42, repeats included) have
it. Two fingerprints link at ``distance`` differing bits or fewer. Fingerprints are cut into b blocks; at most
``distance`` of them can differ in a close pair, so it agrees in b - distance whole blocks: there is a key for each choice
of so many blocks, pairs meet on keys, and the Hamming distance of what meets is verified. b grows slowly with the number
of different fingerprints (``blocks_for``), so that a key stays selective; every b finds every pair.

Equal fingerprints are one node. A key's nodes are cut into parts of about ``PART``, and two parts of a key are one unit
of work, as is a part with itself, so no key is gathered in a task. A unit grows each of its linked groups from one
member and meets only what no group has yet, and gives a row a linked node (its group's least): never a row a pair.

Result: one row a document row. Null, empty and wordless texts have fingerprint zero and link like any other; a text of
fewer words than a shingle is one shingle; a very long text is hashed whole, ``CHUNK`` shingles at a time. Repeated rows
and ids are documents like others. A row without an id takes part; the component is named by the least id that its
members have, and by null where none has one. An empty table gives an empty result; columns other than doc_id and text
are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm._common import connected, cut, map_columns

SHINGLE = 4
DISTANCE = 4
SEED = 42
BITS = 64
#: Nodes of a key that are one part of it.
PART = 2048
#: Shingle hashes whose bits are spread out at one time.
CHUNK = 1 << 15
#: Bits that a key has beyond the logarithm of the number of nodes: an unrelated node meets 2 ** -SLACK others by a key.
SLACK = 8
#: Bits of a key that are enough for any number of nodes, as keys grow in number with them.
WIDEST = 38
#: A fingerprint that one of so many rows has, or more, is hot: there are at most so many of them, whatever the table.
HOT_SHARE = 1000


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The unsigned fingerprint of a text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    k = min(size, len(words))
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - k + 1]
    ends = ends[k - 1 :]
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), CHUNK):
        spans = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)
        h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], ">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long) of every row."""

    def make():
        def f(texts):
            return (np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64),)

        return f

    return map_columns(docs, ["text"], "fp long", make, ("doc_id",))


def blocks_for(nodes: int, distance: int = DISTANCE) -> int:
    """The least number of blocks whose keys have SLACK bits more than it takes to tell the nodes apart."""
    want = min(np.log2(max(nodes, 2)) + SLACK, WIDEST)
    return next(b for b in range(distance + 1, BITS) if BITS * (b - distance) / b >= want)


def masks(blocks: int, distance: int = DISTANCE) -> list[int]:
    """The bits of each key: every choice of all blocks but ``distance``."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(block, blocks - distance)]


def units_of(nodes: DataFrame, blocks: int, distance: int = DISTANCE, part: int = PART) -> DataFrame:
    """Rows key, a, b (parts), side, fp: which nodes meet in which unit of work.

    Side is 0 or 1 for two parts, of which only pairs across count, and 2 for a part with itself.
    """
    signed = [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in masks(blocks, distance)]
    keys = F.array(*(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for k, m in enumerate(signed)))
    keyed = nodes.select("fp", F.explode(keys).alias("key")).repartition("key")
    crowds = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / part).alias("parts"))
    placed = keyed.join(crowds, "key").withColumn("mine", F.pmod(F.xxhash64("fp", "key"), F.col("parts")))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    side = F.when(F.col("mine") == F.col("other"), 2).otherwise(F.when(F.col("mine") < F.col("other"), 0).otherwise(1))
    return met.select("key", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), side.alias("side"), "fp")


def grouped(fp: np.ndarray, side: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """The place of the first member of each node's linked group."""
    root = np.arange(len(fp))
    rest = np.arange(len(fp))
    while len(rest) > 1:
        seed, rest = rest[0], rest[1:]
        stack = [seed]
        while stack and len(rest):
            u = stack.pop()
            near = np.bitwise_count(fp[rest] ^ fp[u]) <= distance
            if side[u] != 2:
                near &= side[rest] != side[u]
            if near.any():
                hit = rest[near]
                root[hit] = seed
                stack.extend(hit.tolist())
                rest = rest[~near]
    return root


def verify(units: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Rows a, b: a linked node and its group's first; input rows key, a, b, side, fp with units whole and in a row."""

    def run(batches):
        held = [np.empty(0, np.int64)] * 5
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                end = len(held[0])
            else:
                held = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns, strict=True)]
                # The last unit may go on in the next batch.
                same = (held[0] == held[0][-1:]) & (held[1] == held[1][-1:]) & (held[2] == held[2][-1:])
                end = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if not end:
                continue
            key, a, b, side, fp = (h[:end] for h in held)
            held = [h[end:] for h in held]
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            left, right = [], []
            for lo, hi in zip(starts, np.r_[starts[1:], end], strict=True):
                if hi - lo > 1:
                    values = fp[lo:hi].astype(np.int64)
                    root = grouped(values.view(np.uint64), side[lo:hi], distance)
                    away = root != np.arange(hi - lo)
                    left.append(values[away])
                    right.append(values[root[away]])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    return units.select("key", "a", "b", "side", "fp").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, size: int = SHINGLE, part: int = PART) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id of every row."""
    signed = cut(fingerprints(docs, size))
    nodes = cut(signed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    met = units_of(nodes.select("fp"), blocks_for(nodes.count(), distance), distance, part)
    found = cut(verify(met.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b"), distance).distinct())
    classes = connected(found).withColumnRenamed("node", "fp")
    named = nodes.join(classes, "fp", "left").select("fp", "least", "copies", F.coalesce("label", "fp").alias("label"))
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    known = cut(named.join(ids, "label").select("fp", "copies", "component_id"))
    total = nodes.agg(F.sum("copies")).head()[0] or 0
    # At most HOT_SHARE fingerprints can hold that share of all rows.
    hot = known.where(F.col("copies") * HOT_SHARE > total).where("copies > 1")
    columns = ["doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"]
    common = signed.join(F.broadcast(hot), "fp").select(*columns)
    rare = signed.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(known, "fp").select(*columns)
    return common.unionByName(rare)
