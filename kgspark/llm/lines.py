"""Repeated lines and passages by hashing.

Units are lines, and pieces of running words: a piece ends behind words whose hash is least among their neighbours,
line breaks and sentence ends do not count, so a long passage yields the same pieces wherever it stands and however it
is wrapped, but for its first and last words. Units are normalised (case, white space), hashed to 128 bits and grouped
globally; the earliest occurrence by (doc_id, text key, position) is kept, later ones are taken out:

* a repeated line of at least ``MIN_WORDS`` words, whole;
* repeated pieces that go on for at least ``MIN_RUN`` words. Such a passage is taken from its first to its last whole
  sentence or line where those hold half of it or more, so that sentences around it stay whole; else as it stands.

Nothing else is touched: a sentence or phrase that also stands elsewhere stays. Removed spans keep their original
offsets (code points, end exclusive).

Null, empty and wordless texts have no units and stay as they are. Documents that repeat a doc_id are told apart by
their text; where that is equal too, the copies count as one document and stay alike. Documents with a null id rank
first, in the order of their text's key. Equal lines within a document: the first stays. A very long text is read
whole, its words are one array at a time. An empty table gives an empty result; columns other than doc_id and text are
not read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm._common import cut, map_columns

MIN_WORDS = 5
MIN_RUN = 20
#: A piece ends where a word's hash is the least among so many words on either side.
NEIGHBOURS = 5
#: Words whose hashes a task remembers.
CACHE = 200_000

_WORD = re.compile(r"\S+")
_BREAK = re.compile(r"\n")
_POWERS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordTable:
    """Two 64-bit hashes of each lower-cased word that a task has met."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.hashes = np.empty((2, 1024), np.uint64)

    def of(self, words: list[str]) -> np.ndarray:
        import xxhash

        if len(self.place) > CACHE:
            self.place.clear()
        place = self.place
        for w in set(words).difference(place):
            k = place[w] = len(place)
            if k == self.hashes.shape[1]:
                self.hashes = np.concatenate([self.hashes, np.empty_like(self.hashes)], axis=1)
            self.hashes[:, k] = struct.unpack("<QQ", xxhash.xxh3_128_digest(w.encode("utf-8", "surrogatepass")))
        return self.hashes[:, np.fromiter(map(place.__getitem__, words), np.int64, len(words))]


def text_key(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


def _piece_ends(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces end (exclusive): where a text does, and behind words that are least within NEIGHBOURS words of their
    text on either side, of equal ones the first."""
    cut = np.zeros(len(h) + 1, bool)
    cut[NEIGHBOURS : len(h) - NEIGHBOURS] = True
    for e in (0, *ends.tolist()):
        cut[max(0, e - NEIGHBOURS) : e + NEIGHBOURS] = False
    k = np.flatnonzero(cut)
    for i in range(1, NEIGHBOURS + 1):
        k = k[(h[k] < h[k - i]) & (h[k] <= h[k + i])]
    return np.union1d(k + 1, ends[np.diff(ends, prepend=0) > 0])


def _digests(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(2, n): 128 bits of each run of words; runs do not overlap and are in order."""
    out = np.empty((2, len(starts)), np.uint64)
    if not len(starts):
        return out
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    inside = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    words = np.repeat(starts, sizes) + inside
    for row, p in enumerate(_POWERS):
        powers = np.cumprod(np.full(int(sizes.max()), p, np.uint64))
        total = np.add.reduceat(h[row, words] * powers[inside], first) + sizes.astype(np.uint64)
        total = (total ^ (total >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        out[row] = total ^ (total >> np.uint64(31))
    return out


def units(texts: list[str | None], table: WordTable):
    """Units of a block of texts, by text: arrays text, first word, end (word places within the text), digest (2, n) and
    whether the unit is a line; the lines of MIN_WORDS words or more of a text in order, then its pieces."""
    words: list[str] = []
    sizes, lines, line_texts = [], [], []
    for k, t in enumerate(texts):
        parts = [x.split() for x in (t or "").lower().split("\n")]
        for x in parts:
            words += x
        counts = list(map(len, parts))
        lines += counts
        line_texts += [k] * len(counts)
        sizes.append(sum(counts))
    h = table.of(words)
    text_ends = np.cumsum(sizes)
    text_starts = text_ends - sizes
    line_ends = np.cumsum(lines)
    long = np.array(lines) >= MIN_WORDS
    starts, ends = (line_ends - lines)[long], line_ends[long]
    last = _piece_ends(h[0], text_ends)
    first = np.concatenate([[0], last[:-1]]).astype(np.int64)[: len(last)]
    # A line and a piece of the same words are different units.
    found = np.concatenate([_digests(h, starts, ends), _digests(h, first, last) ^ np.uint64(0x5555555555555555)], axis=1)
    text = np.concatenate([np.array(line_texts, np.int64)[long], np.searchsorted(text_ends, first, "right")])
    order = np.argsort(text, kind="stable")
    a, b = np.concatenate([starts, first])[order], np.concatenate([ends, last])[order]
    text = text[order]
    return text, a - text_starts[text], b - text_starts[text], found.view(np.int64)[:, order], order < len(starts)


def hashed_units(docs: DataFrame) -> DataFrame:
    """Rows doc_id, key (of the text), hi, lo: the digests of each document's units, once each."""

    def make():
        table = WordTable()

        def f(ids, texts):
            text, _, _, d, _ = units(texts, table)
            text, hi, lo = np.unique(np.stack([text, *d]), axis=1) if len(text) else (text, *d)
            keys = np.array([text_key(t) if t else 0 for t in texts], np.int64)
            return [ids[k] for k in text.tolist()], keys[text], hi, lo

        return f

    return map_columns(docs, ["doc_id", "text"], "doc_id long, key long, hi long, lo long", make)


def repeats(docs: DataFrame) -> DataFrame:
    """Digests that an earlier document keeps: doc_id, key, hi, lo, keep_doc (-2^63 for a null id).

    Documents are ordered by (doc_id, key), null ids first. Digests and ids are stored once, for the count and for the
    join; nothing else is shuffled. The count only spares single units the join; the order alone decides.
    """
    rank = F.struct("doc_id", "key")
    every = cut(hashed_units(docs))
    first = every.groupBy("hi", "lo").agg(F.min(rank).alias("keep"), F.count("*").alias("n")).where("n > 1").select("hi", "lo", "keep")
    keep_doc = F.coalesce("keep.doc_id", F.lit(-(2**63))).alias("keep_doc")
    return every.join(first, ["hi", "lo"]).where(F.col("keep") < rank).select("doc_id", "key", "hi", "lo", keep_doc)


def _runs(marked: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    yield from zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True)


def _opens(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Whether a sentence or line starts at each word place, and at the end."""
    out = np.zeros(len(spans) + 1, bool)
    out[[0, -1]] = True
    out[np.searchsorted([a for a, _ in spans], [m.start() for m in _BREAK.finditer(text)])] = True
    out[1:] |= np.fromiter((text[b - 1] in ".!?" for _, b in spans), bool, len(spans))
    return out


def removal(text: str, lines: list[tuple[int, int]], pieces: list[tuple[int, int]]):
    """(clean text, spans, number of passages, words that go) of one text, given its repeated units by words."""
    spans = [m.span() for m in _WORD.finditer(text)]
    gone, passage = np.zeros(len(spans), bool), np.zeros(len(spans), bool)
    for a, b in lines:
        gone[a:b] = True
    for a, b in pieces:
        passage[a:b] = True
    passages = 0
    opens = None
    for a, b in _runs(passage):
        if b - a < MIN_RUN:
            continue
        opens = _opens(text, spans) if opens is None else opens
        inner = np.flatnonzero(opens[a : b + 1]) + a
        if len(inner) > 1 and 2 * (inner[-1] - inner[0]) >= b - a:
            a, b = int(inner[0]), int(inner[-1])
        passages += not gone[a:b].all()
        gone[a:b] = True
    cuts = [(spans[a][0], spans[b - 1][1]) for a, b in _runs(gone)]
    kept, at = [], 0
    for a, b in cuts:
        kept.append(text[at:a])
        at = b + (text[b : b + 1] == "\n")
    return "".join([*kept, text[at:]]), cuts, passages, gone


def cleaned(ids: list, texts: list[str | None], keepers: list[dict[tuple[int, int], int]], table: WordTable) -> list[tuple]:
    """Rows text, n_removed, n_lines, n_passages, removed_chars, removed_spans, keep_docs of a block of texts; keepers
    name the earlier documents by digest. What repeats within a text keeps its first place."""
    out = [(t, 0, 0, 0, 0, "", []) for t in texts]
    text, first, last, d, line = units(texts, table)
    edges = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
    for k, (i, t, known) in enumerate(zip(ids, texts, keepers, strict=True)):
        lo, hi = edges[k], edges[k + 1]
        names = list(zip(d[0, lo:hi].tolist(), d[1, lo:hi].tolist(), strict=True))
        if not known and len(set(names)) == len(names):
            continue
        again, seen = [], set()
        for at, name in enumerate(names, lo):
            if name in known or name in seen:
                again.append((at, known.get(name, i)))
            seen.add(name)
        spans = {at: (int(first[at]), int(last[at])) for at, _ in again}
        lines = [spans[at] for at, _ in again if line[at]]
        clean, cuts, passages, gone = removal(t, lines, [spans[at] for at, _ in again if not line[at]])
        named = {keeper for at, keeper in again if gone[spans[at][0] : spans[at][1]].any()}
        chars = sum(b - a for a, b in cuts)
        out[k] = clean, len(cuts), len(lines), passages, chars, ",".join(f"{a}:{b}" for a, b in cuts), sorted(x for x in named if x is not None and x != -(2**63))
    return out


def dedup(docs: DataFrame) -> DataFrame:
    """Each document with its text after removal.

    Rows doc_id, text, n_removed (spans), n_lines (whole lines), n_passages (runs of MIN_RUN words or more that are not
    whole lines), removed_chars, removed_spans (start:end, comma-joined, of the original text), keep_docs (sorted ids
    of the documents that keep what was removed).
    """
    # A set: rows that repeat a document give its digests once.
    grouped = repeats(docs).groupBy("doc_id", "key").agg(F.collect_set(F.struct("hi", "lo", "keep_doc")).alias("units"))
    grouped = grouped.select("doc_id", "key", F.col("units.hi").alias("hi"), F.col("units.lo").alias("lo"), F.col("units.keep_doc").alias("keep"))

    def make():
        table = WordTable()

        def f(ids, texts, his, los, keeps):
            known = [dict(zip(zip(a or (), b or (), strict=True), c or (), strict=True)) for a, b, c in zip(his, los, keeps, strict=True)]
            return ids, *map(list, zip(*cleaned(ids, texts, known, table), strict=True))

        return f

    keyed = map_columns(docs, ["text"], "key long", lambda: lambda t: ([text_key(x) if x else None for x in t],), ("doc_id", "text"))
    d, g = keyed.alias("d"), grouped.alias("g")
    joined = d.join(g, F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.key") == F.col("g.key")), "left")
    schema = "doc_id long, text string, n_removed int, n_lines int, n_passages int, removed_chars long, removed_spans string, keep_docs array<long>"
    columns = ["doc_id", "text", "hi", "lo", "keep"]
    return map_columns(joined.select("d.doc_id", "d.text", "g.hi", "g.lo", "g.keep"), columns, schema, make)
