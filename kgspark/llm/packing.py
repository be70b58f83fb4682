"""Best-fit packing planned on a histogram of lengths.

Tokens: each document's ids, then id 0; only documents over the sequence length are cut. The plan sees nothing but
the number of pieces of each length (at most ``SEQUENCE`` of them): best fit in decreasing length over counts, which
places whole runs of equal pieces into runs of equally full sequences. Pieces then take planned slots by joining on
their rank within their length. Ranks come from counts of hashed sub-groups, so a length that a third of all pieces
share is not gathered anywhere.

Null and empty texts: one piece that holds id 0. Repeated rows are packed each for itself, null ids too. A very long
text is encoded whole, one at a time, and cut. Texts of equal length are placed in the order of hashed sub-groups and
ids. An empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import bisect
import json
import unicodedata
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kgspark.llm._common import cut, map_columns, worker_state

SEQUENCE = 2048
TOKENIZER = "word_bpe_49k.json"
#: Words that a Python worker remembers: the first ones it meets, which tend to be the frequent ones. Others are kept
#: for one block of texts.
CACHE = 300_000


class WordEncoder:
    """The tokenizer's ids of whole texts, made word by word where the tokenizer works by words.

    A tokenizer that lower-cases, splits at white space and marks the ends of words drops white space and never joins
    what it separates, so a text's ids are its words' ids in order. Words are remembered as little-endian 32-bit ids.
    Texts with the few control characters on which Python and the tokenizer differ about white space go to the
    tokenizer whole, and so do all texts of other tokenizers.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        made = json.loads(self.tokenizer.to_str())
        parts = [json.dumps(made.get(k) or {}) for k in ("normalizer", "pre_tokenizer")]
        self.by_word = made["model"].get("end_of_word_suffix") == "</w>" and '"Lowercase"' in parts[0] and '"Removed"' in parts[1]
        self.words: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}

    def _direct(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def _plain(self, words: list[str]) -> dict[str, bytes]:
        """Words of letters only, each one token group: many to a call, told apart by the word-end ids."""
        out: dict[str, bytes] = {}
        for at in range(0, len(words), 1000):
            part = words[at : at + 1000]
            ids = np.array(self._direct([" ".join(part)])[0], "<u4")
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(ends) == len(part) and ends[-1] == 4 * len(ids):
                data = ids.tobytes()
                out.update(zip(part, [data[a:b] for a, b in zip([0, *ends], ends)]))  # noqa: B905
            else:
                out.update(zip(part, map(self._packed, self._direct(part)), strict=True))
        return out

    def _cores(self, words: list[str]) -> list[str]:
        """Lower-cased words without trailing stops and commas; an empty one where that isn't all letters or where Python
        and the tokenizer might lower-case or compose the word differently."""
        lows = "\n".join(words).lower().split("\n")
        joined = "".join(words)
        simple = joined.isascii() or (unicodedata.is_normalized("NFC", "\n".join(words)) and "Σ" not in joined and "ς" not in joined and "İ" not in joined)
        cores = [low.rstrip(".,") for low in lows]
        if simple:
            return [c if c.isalpha() else "" for c in cores]
        same = [w.isascii() or (unicodedata.is_normalized("NFC", w) and len(w) == len(low) and "ς" not in low and "Σ" not in w) for w, low in zip(words, lows, strict=True)]
        return [c if ok and c.isalpha() else "" for c, ok in zip(cores, same, strict=True)]

    def learned(self, missing: list[str]) -> dict[str, bytes]:
        """The ids of words that aren't remembered; their letters without trailing stops and commas may be."""
        found = self._cores(missing)
        cores = self.cores
        new = self._plain([c for c in set(found) if c and c not in cores])
        # A word without a core goes to the tokenizer whole, one with a core by what stands after it.
        rest = [w[len(c) :] for w, c in zip(missing, found, strict=True)]
        others = list(set(rest) - {""})
        direct = dict(zip(others, map(self._packed, self._direct(others)), strict=True)) if others else {}
        direct[""] = b""
        new[""] = b""
        out = {w: (new[c] if c in new else cores[c]) + direct[r] for w, c, r in zip(missing, found, rest, strict=True)}
        if len(cores) < CACHE:
            del new[""]
            cores.update(new)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return list(map(self._packed, self._direct(texts)))
        odd = {k for k, t in enumerate(texts) if "\x1c" in t or "\x1d" in t or "\x1e" in t or "\x1f" in t}
        split = [() if k in odd else t.split() for k, t in enumerate(texts)]
        known = self.words
        missing = [w for w in set().union(*split) if w not in known]
        new = self.learned(missing) if missing else {}
        room = len(known) < CACHE
        known.update(new)
        get = known.__getitem__
        out = [
            self._packed(self._direct([texts[k]])[0]) if k in odd else b"".join(map(get, s)) for k, s in enumerate(split)
        ]
        if not room:
            for w in new:
                del known[w]
        return out


def pieces(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE) -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32."""

    def make():
        encoder = worker_state("words", tokenizer_path, lambda: WordEncoder(tokenizer_path))

        def f(ids, texts):
            out = []
            at = 0
            while at < len(ids):
                end, size = at, 0
                while end < len(ids) and size < 1_000_000:
                    size += len(texts[end] or "")
                    end += 1
                for i, data in zip(ids[at:end], encoder.encode([t or "" for t in texts[at:end]]), strict=True):
                    data += b"\0\0\0\0"
                    for k, start in enumerate(range(0, len(data), 4 * sequence)):
                        part = data[start : start + 4 * sequence]
                        out.append((i, k, start // 4, len(part) // 4, zlib.crc32(part)))
                at = end
            return tuple(map(list, zip(*out, strict=True)))

        return f

    return map_columns(docs, ["doc_id", "text"], "doc_id long, piece int, start long, length long, ids_crc32 long", make)


def plan(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Best fit in decreasing length over counts.

    Rows (length, first rank, number, first sequence, offset): as many pieces of a length, from that rank on, go one
    each to consecutive sequences, at that offset.
    """
    free: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []  # remaining sizes that some sequence has, sorted
    out, opened = [], 0

    def put(room: int, first: int, number: int) -> None:
        if room and number:
            if room not in free:
                free[room] = []
                bisect.insort(sizes, room)
            free[room].append((first, number))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect.bisect_left(sizes, length)
            if k < len(sizes):
                room = sizes[k]
                first, number = free[room].pop()
                if not free[room]:
                    del free[room]
                    del sizes[k]
                used = min(left, number)
                out.append((length, rank, used, first, sequence - room))
                put(room, first + used, number - used)
                put(room - length, first, used)
                rank, left = rank + used, left - used
            else:
                each = sequence // length
                full, rest = divmod(left, each)
                for number, fill in ((full, each), (1, rest)):
                    if number and fill:
                        for j in range(fill):
                            out.append((length, rank, number, opened, j * length))
                            rank += number
                        put(sequence - fill * length, opened, number)
                        opened += number
                left = 0
    return out


def place(parts: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Gives each piece its sequence_id and offset. ``parts`` is read three times: pass a stored table."""
    spark = parts.sparkSession
    histogram = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    total = sum(histogram.values())
    salts = max(64, total // 50_000)
    salted = parts.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = (
        salted.groupBy("length", "__salt")
        .count()
        .withColumn("__before", F.sum("count").over(W.partitionBy("length").orderBy("__salt")) - F.col("count"))
        .drop("count")
    )
    own = F.row_number().over(W.partitionBy("length", "__salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = (
        salted.withColumn("__own", own)
        .join(before, ["length", "__salt"])
        .withColumn("__rank", F.col("__own") + F.col("__before"))
    )
    slots = spark.createDataFrame(
        plan(histogram, sequence), "length long, __first long, __number long, __sequence long, __offset long"
    )
    # At most a few runs for each of the sequence's possible lengths, whatever the number of documents.
    inside = (F.col("__rank") >= F.col("__first")) & (F.col("__rank") < F.col("__first") + F.col("__number"))
    return (
        ranked.join(F.broadcast(slots), "length")
        .where(inside)
        .select(
            *parts.columns,
            (F.col("__sequence") + F.col("__rank") - F.col("__first")).alias("sequence_id"),
            F.col("__offset").alias("offset"),
        )
    )


def pack(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE) -> DataFrame:
    return place(cut(pieces(docs, tokenizer_path, sequence)), sequence)
