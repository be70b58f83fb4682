"""Ranked lexical search over inverted treaps.

A first pass over the documents gives the number of documents and of terms, and in how many documents each term stands.
Items are then searched in blocks of about ``BLOCK_BYTES`` of terms. A task deals its documents to segments of about
``SEGMENT`` postings of the block's terms, and a segment has a treap a term: a search tree by document place and a heap
by impact, the part of a score that needs no weight. An item's treaps are traversed together over intervals of places:
the roots in an interval hold the largest impact of each term there, so their weighted sum bounds every score; where the
bound cannot enter the task's k best so far, the interval goes unseen; one of few postings is scored whole; of any other,
the document that promises most is scored and both sides of it follow. The k best of a task, over all its segments, go
on to one ranking by item.

Nothing but counts and the best rows moves; a task holds a segment, a block of items and their best rows, whatever the
table. Blocks pass through the driver one at a time, and their rows are stored.

Result: the k highest-scoring documents with a score above 0 by item, ties by ascending doc_id. A document is a row:
repeated rows and ids are ranked each for itself; rows with a null id rank behind those of equal score that have one.
Null, empty and wordless texts have no terms: they count nowhere and are never found. Rows of one item_id, null ids
too, are one item with the terms of all; an item without known terms has no rows. Texts are read whole whatever their
length. Empty tables: no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm._common import SLICE, cut, map_columns

TOP = 10
BLOCK_BYTES = 4_000_000
#: Postings of a segment, at least, but for a task's last.
SEGMENT = 1 << 19
#: Postings of an interval that is scored whole.
LEAF = 4096
#: Terms that a task counts before it passes them on.
COUNTED = 300_000
#: Null ids rank last.
_LAST = 2**63 - 1

_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """All terms of a text, in order."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(tf: int, length: int, n_docs: int, n_terms: int) -> int:
    m = 100 - 90 + (90 * length * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def counts(docs: DataFrame) -> DataFrame:
    """term, df; and one row for the null term: df is the number of documents with terms, n_terms that of all terms."""

    def run(batches):
        df, n, total = Counter(), 0, 0

        def rows(more: list):
            words = list(df)
            made = pa.array([*words, *(None for _ in more)], pa.binary()), pa.array([*df.values(), *(x[0] for x in more)], pa.int64())
            return pa.RecordBatch.from_arrays([*made, pa.array([0] * len(words) + [x[1] for x in more], pa.int64())], names=["term", "df", "n_terms"])

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for text in batch.column(0).slice(at, SLICE).to_pylist():
                    found = terms(text)
                    n, total = n + bool(found), total + len(found)
                    df.update(set(found))
                    if len(df) > COUNTED:
                        yield rows([])
                        df.clear()
        yield rows([(n, total)])

    made = docs.select("text").mapInArrow(run, "term binary, df long, n_terms long")
    return made.groupBy("term").agg(F.sum("df").alias("df"), F.sum("n_terms").alias("n_terms"))


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term)."""

    def make():
        def f(ids, texts):
            rows = [(i, t) for i, text in zip(ids, texts, strict=True) for t in sorted(set(terms(text)))]
            return [r[0] for r in rows], [r[1] for r in rows]

        return f

    return map_columns(items.select(F.col("item_id").cast("long").alias("item_id"), "text"), ["item_id", "text"], "item_id long, term binary", make).distinct()


class Treap:
    """The postings of a term in a segment: places ascending, impacts, and the children of each posting by number."""

    __slots__ = ("impacts", "left", "places", "right", "root")

    def __init__(self, places: np.ndarray, impacts: np.ndarray):
        self.places, self.impacts = places.tolist(), impacts.tolist()
        # Equal impacts are ordered by a mixed number, so that a run of them makes no chain.
        mixed = (np.arange(len(places), dtype=np.uint32) * np.uint32(2654435761)) >> np.uint32(8)
        heat = (impacts * (1 << 24) + mixed).tolist()
        left, right = [-1] * len(heat), [-1] * len(heat)
        spine: list[int] = []
        for k, x in enumerate(heat):
            last = -1
            while spine and heat[spine[-1]] < x:
                last = spine.pop()
            left[k] = last
            if spine:
                right[spine[-1]] = k
            spine.append(k)
        self.left, self.right, self.root = left, right, spine[0] if spine else -1

    def within(self, node: int, low: int, high: int) -> int:
        """The root of what the subtree of ``node`` holds from place ``low`` to before ``high``."""
        places = self.places
        while node >= 0:
            p = places[node]
            if p >= high:
                node = self.left[node]
            elif p < low:
                node = self.right[node]
            else:
                return node
        return -1


class Best:
    """The k best (score, doc_id) of an item; of equal scores the lesser ids."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def floor(self) -> tuple[int, int]:
        """A document enters if its (score, -doc_id) is above it."""
        return self.heap[0] if len(self.heap) == self.k else (0, 0)

    def add(self, score: int, doc: int) -> None:
        if score > 0:
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, (score, -doc))
            else:
                heapq.heappushpop(self.heap, (score, -doc))


class Segment:
    """Treaps of some documents, whose places follow their ids."""

    def __init__(self, ids: list[int], places: np.ndarray, numbers: np.ndarray, impacts: np.ndarray):
        """ids by place; one posting in each of the other three: the document's place, the term's number, the impact."""
        by_id = np.argsort(np.array(ids, np.int64), kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[by_id] = np.arange(len(ids))
        self.ids = np.array(ids, np.int64)[by_id]
        places = rank[places]
        order = np.lexsort((places, numbers))
        places, numbers, self.impacts = places[order], numbers[order], impacts[order]
        self.places = places
        edges = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]]) if len(numbers) else np.empty(0, np.int64)
        self.range = {int(numbers[a]): (int(a), int(b)) for a, b in zip(edges, np.r_[edges[1:], len(numbers)], strict=True)} if len(edges) else {}
        self.treaps: dict[int, Treap] = {}

    def treap(self, number: int) -> Treap:
        if number not in self.treaps:
            a, b = self.range[number]
            self.treaps[number] = Treap(self.places[a:b], self.impacts[a:b])
        return self.treaps[number]

    def search(self, item: list[tuple[int, int]], best: Best, leaf: int = LEAF) -> int:
        """Brings ``best`` up to date for an item of (term number, weight); gives how many postings were scored."""
        held = [(t, w, *self.range[t]) for t, w in item if t in self.range]
        seen = 0
        # Intervals of places, with the range of postings and the root of each term in it.
        stack = [(0, len(self.ids), [(t, w, a, b, self.treap(t).root) for t, w, a, b in held])]
        while stack:
            low, high, terms_ = stack.pop()
            bound = sum(w * self.treaps[t].impacts[r] for t, w, _, _, r in terms_)
            if bound <= 0 or (bound, -int(self.ids[low])) <= best.floor():
                continue
            count = sum(b - a for _, _, a, b, _ in terms_)
            if count <= leaf:
                seen += count
                self._score(low, high, terms_, best)
                continue
            t, _, _, _, r = max(terms_, key=lambda x: x[1] * self.treaps[x[0]].impacts[x[4]])
            middle = self.treaps[t].places[r]
            score, sides = 0, ([], [])
            for t, w, a, b, r in terms_:
                tree, start = self.treaps[t], self.range[t][0]
                m = a + int(np.searchsorted(self.places[a:b], middle))
                n = m + (m < b and self.places[m] == middle)
                if n > m:
                    score += w * tree.impacts[m - start]
                    seen += 1
                if m > a:
                    sides[0].append((t, w, a, m, tree.within(r, low, middle)))
                if b > n:
                    sides[1].append((t, w, n, b, tree.within(r, middle + 1, high)))
            best.add(score, int(self.ids[middle]))
            stack += [x for x in ((middle + 1, high, sides[1]), (low, middle, sides[0])) if x[2]]
        return seen

    def _score(self, low: int, high: int, terms_: list, best: Best) -> None:
        places = np.concatenate([self.places[a:b] for _, _, a, b, _ in terms_])
        scores = np.concatenate([w * self.impacts[a:b] for _, w, a, b, _ in terms_])
        found, back = np.unique(places, return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, back, scores)
        floor = best.floor()[0]
        for p, s in zip(found[total >= max(floor, 1)].tolist(), total[total >= max(floor, 1)].tolist(), strict=True):
            best.add(s, int(self.ids[p]))


def _searched(docs: DataFrame, block, n_docs: int, n_terms: int, top: int, segment: int, leaf: int) -> DataFrame:
    """place (of the item in the block), doc_id (null as _LAST), score: the best rows of each task."""

    def run(batches):
        numbers, items = block.value
        best = [Best(top) for _ in items]
        ids: list[int] = []
        parts: list[tuple] = []
        held = 0

        def close() -> None:
            made = Segment(ids, *(np.concatenate([p[k] for p in parts]) for k in range(3)))
            for item, b in zip(items, best, strict=True):
                made.search(item, b, leaf)

        for batch in batches:
            for doc, text in _rows(batch):
                words = terms(text)
                known = Counter(numbers[w] for w in words if w in numbers)
                if not known:
                    continue
                values = [impact(tf, len(words), n_docs, n_terms) for tf in known.values()]
                parts.append((np.full(len(known), len(ids)), np.fromiter(known, np.int64, len(known)), np.array(values, np.int64)))
                ids.append(_LAST if doc is None else doc)
                held += len(known)
                if held >= segment:
                    close()
                    ids, parts, held = [], [], 0
        if ids:
            close()
        rows = [(k, -d, s) for k, b in enumerate(best) for s, d in b.heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["place", "doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "place long, doc_id long, score long")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    for at in range(0, batch.num_rows, SLICE):
        yield from zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns), strict=True)


def blocks(items: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """Items in blocks of about ``limit`` bytes of terms: lists of (item_id, [(term, df)])."""
    block, size = [], 0
    for r in items.toLocalIterator():
        found = [(bytes(t["term"]), t["df"]) for t in r["terms"]]
        block.append((r["item_id"], found))
        size += sum(len(t) + 40 for t, _ in found)
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES, segment: int = SEGMENT, leaf: int = LEAF) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of every item."""
    spark = docs.sparkSession
    known = cut(counts(docs))
    n_docs, n_terms = known.where("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).head()
    wanted = item_terms(items).join(known.where("term is not null").select("term", "df"), "term")
    asked = cut(wanted.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("term", "df"))).alias("terms")))
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for block in blocks(asked, block_bytes):
        numbers = {t: k for k, t in enumerate(sorted({t for _, ts in block for t, _ in ts}))}
        weighed = [[(numbers[t], w) for t, df in ts if (w := weight(n_docs, df)) > 0] for _, ts in block]
        sent = spark.sparkContext.broadcast((numbers, weighed))
        by_place = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], "place long, item_id long")
        best = _searched(docs, sent, n_docs, n_terms, top, segment, leaf)
        # The ids of a block, which is bounded.
        found = found.unionByName(cut(best.join(F.broadcast(by_place), "place").select("item_id", "doc_id", "score")))
        sent.destroy()
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", F.when(F.col("doc_id") < _LAST, F.col("doc_id")).alias("doc_id"), "score")


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
p AS MATERIALIZED (SELECT r, doc_id, term, n, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM t) GROUP BY r, doc_id, n, term),
g AS (SELECT count(*) AS nd, sum(len(w))::BIGINT AS nt FROM t WHERE len(w) > 0),
d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
u AS (SELECT item_id, term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS w FROM q JOIN d USING (term), g),
s AS (SELECT item_id, r, any_value(doc_id) AS doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nd) // nt)))) AS BIGINT) AS score
  FROM u JOIN p USING (term), g GROUP BY item_id, r),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10
"""
