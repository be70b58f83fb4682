"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Test strings are windows of ``WINDOW`` consecutive words of the benchmark items (shorter items: one window). A scan
looks at the last two words of the current position: the block shift table says how far no window can end, the
suffix-hash bucket (narrowed by the window's first two words) lists the few windows that can, and direct comparison
confirms. Windows of each length have their own table, so short items do not shorten the shifts of the others.

Words are runs of [0-9a-z] and non-ASCII characters after lower-casing A-Z. Null, empty or wordless texts are never
contaminated; items without words have no window. Items with a null id hit words like others and count together as one
item, but are not named. Repeated document rows give repeated results, repeated items count once. Very long texts are
scanned whole. Empty tables: no documents, no rows; no items, no hits. Other columns are not read, but for those to
carry; ``carry`` may not name n_words, n_hit, n_items or items.

Windows are searched in blocks of at most about ``BLOCK_BYTES`` of window text and ids. A task scans each of its batches
with one block's tables after the other, so it holds one block's tables (about eight times those bytes) and the blocks
themselves compressed; no text is moved or written for it. The driver passes on the windows a block at a time.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm._common import SLICE, cut, map_columns, worker_state

WINDOW = 10
BLOCK_BYTES = 8_000_000

_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def windows(benchmark: DataFrame) -> DataFrame:
    """Distinct (item_id, window), the window's words joined by a space."""

    def make():
        def f(ids, texts):
            out: set = set()
            for i, text in zip(ids, texts, strict=True):
                w = words(text)
                size = min(WINDOW, len(w))
                if size:
                    out.update((i, b" ".join(w[k : k + size]).decode("utf-8", "surrogatepass")) for k in range(len(w) - size + 1))
            rows = list(out)
            return [r[0] for r in rows], [r[1] for r in rows]

        return f

    return map_columns(benchmark, ["item_id", "text"], "item_id long, window string", make).distinct()


class WuManber:
    """Shift and bucket tables over windows of one length in words."""

    def __init__(self, size: int, patterns: dict[tuple[bytes, ...], list]):
        self.size, self.block = size, min(2, size)
        self.default = size - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for w, items in patterns.items():
            for end in range(self.block, size + 1):
                key = self._key(w, end)
                self.shift[key] = min(self.shift.get(key, self.default), size - end)
            self.buckets.setdefault(self._key(w, size), {}).setdefault(self._key(w, self.block), []).append((w, items))

    def _key(self, w, end: int):
        return (w[end - 2], w[end - 1]) if self.block == 2 else w[end - 1]

    def scan(self, w: list[bytes], mask: bytearray, items: set) -> None:
        size, shift, default, n = self.size, self.shift.get, self.default, len(w)
        pair = self.block == 2
        hit = b"\1" * size
        end = size
        while end <= n:
            key = (w[end - 2], w[end - 1]) if pair else w[end - 1]
            step = shift(key, default)
            if step:
                end += step
                continue
            start = end - size
            first = (w[start], w[start + 1]) if pair else w[start]
            for pattern, ids in self.buckets[key].get(first, ()):
                if tuple(w[start:end]) == pattern:
                    mask[start:end] = hit
                    items.update(ids)
            end += 1


def tables(pairs: list[tuple[int | None, str]]) -> list[WuManber]:
    by_size: dict[int, dict] = {}
    same: dict[bytes, bytes] = {}  # one object a word
    for item, window in pairs:
        w = tuple(same.setdefault(x, x) for x in window.encode("utf-8", "surrogatepass").split(b" "))
        by_size.setdefault(len(w), {}).setdefault(w, []).append(item)
    return [WuManber(size, rows) for size, rows in sorted(by_size.items())]


def _packed(rows) -> bytes:
    """Windows hold words and single blanks only, so lines and tabs are free; compressed, as a worker keeps each block."""
    return zlib.compress("\n".join(f"{'' if i is None else i}\t{w}" for i, w in rows).encode("utf-8", "surrogatepass"))


def _unpacked(data: bytes) -> list[tuple[int | None, str]]:
    rows = (line.split("\t") for line in zlib.decompress(data).decode("utf-8", "surrogatepass").split("\n") if line)
    return [(int(i) if i else None, w) for i, w in rows]


def search(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row a document row: the carried columns, n_words, n_hit, n_items and items (sorted ids of named items with
    occurring windows)."""
    context = docs.sparkSession.sparkContext
    found = cut(windows(benchmark))
    size = found.agg(F.sum(F.octet_length("window") + 8)).head()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    dealt = found.withColumn("block", F.pmod(F.xxhash64("window", "item_id"), F.lit(n_blocks)))
    name = uuid.uuid4().hex
    blocks = [context.broadcast(_packed(dealt.where(F.col("block") == k).select("item_id", "window").collect())) for k in range(n_blocks)]

    def block_tables(k: int) -> list[WuManber]:
        if n_blocks == 1:
            return worker_state("windows", name, lambda: tables(_unpacked(blocks[0].value)))
        return tables(_unpacked(blocks[k].value))

    made = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.int64()))])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, whole.num_rows if n_blocks > 1 else SLICE):
                batch = whole.slice(at, whole.num_rows if n_blocks > 1 else SLICE)
                split = [words(t) for t in batch.column(0).to_pylist()]
                masks, items = [bytearray(len(w)) for w in split], [set() for _ in split]
                for k in range(n_blocks):
                    for machine in block_tables(k):
                        for w, mask, got in zip(split, masks, items, strict=True):
                            machine.scan(w, mask, got)
                columns = [len(w) for w in split], [m.count(1) for m in masks], [len(x) for x in items], [sorted(i for i in x if i is not None) for x in items]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(c, t.type) for c, t in zip(columns, made, strict=True))], names=[*carry, *made.names])

    given = docs.select("text", *(F.col(c).alias(f"__carry_{k}") for k, c in enumerate(carry)))
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in carry)
    return given.mapInArrow(run, kinds + "n_words long, n_hit long, n_items long, items array<long>")


def digest(found: DataFrame) -> DataFrame:
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def brute(text: str | None, items: dict[int, str]) -> tuple[int, int, list[int]]:
    """All windows at all positions, for tests."""
    w = words(text)
    hit, got = set(), set()
    for i, t in items.items():
        v = words(t)
        size = min(WINDOW, len(v))
        if not size:
            continue
        wins = {tuple(v[k : k + size]) for k in range(len(v) - size + 1)}
        for k in range(len(w) - size + 1):
            if tuple(w[k : k + size]) in wins:
                hit.update(range(k, k + size))
                got.add(i)
    return len(w), len(hit), sorted(got)


def items_sha256(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, k, grams.n, item_id FROM grams JOIN win USING (s) WHERE grams.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
