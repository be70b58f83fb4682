"""Document preparation (DOC): overlapping word chunks and row chunks with a repeated header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.text import strip, words

SIZE, OVERLAP, ROWS = 1150, 155, 25
STEP = SIZE - OVERLAP


def word_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk, text): frames of ``size`` words, ``overlap`` of them shared; a short text is one trimmed chunk."""
    w = docs.select("doc_id", "text", words("text").alias("w"))
    step = size - overlap
    starts = F.when(F.size("w") > size, F.sequence(F.lit(0), F.size("w") - 1, F.lit(step))).otherwise(F.array(F.lit(0)))
    at = w.select("doc_id", "text", "w", F.posexplode(starts).alias("chunk", "start"))
    cut = F.array_join(F.slice("w", F.col("start") + 1, F.lit(size)), " ")
    return at.select("doc_id", "chunk", F.when(F.size("w") > size, cut).otherwise(strip("text")).alias("text"))


def word_chunk_estimate(text) -> Column:
    n = F.size(words(text))
    return F.when(n <= SIZE, 1).otherwise(F.ceil((n - OVERLAP) / STEP)).cast("int")


def _lines(c) -> Column:
    return F.filter(F.split(F.col(c) if isinstance(c, str) else c, "\r?\n"), lambda x: strip(x) != "")


def row_chunks(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """(doc_id, chunk, text): groups of ``rows`` lines, each under the first line; up to rows + 1 lines are one chunk."""
    w = docs.select("doc_id", "text", _lines("text").alias("w"))
    many = F.size("w") > rows + 1
    starts = F.when(many, F.sequence(F.lit(1), F.size("w") - 1, F.lit(rows))).otherwise(F.array(F.lit(0)))
    at = w.select("doc_id", "text", "w", many.alias("many"), F.posexplode(starts).alias("chunk", "start"))
    cut = F.array_join(F.concat(F.slice("w", 1, 1), F.slice("w", F.col("start") + 1, F.lit(rows))), "\n")
    return at.select("doc_id", "chunk", F.when(F.col("many"), cut).otherwise(F.col("text")).alias("text"))


def row_chunk_estimate(text) -> Column:
    return F.greatest(F.lit(1), F.ceil((F.size(_lines(text)) - 1) / ROWS)).cast("int")


def csv_like(text) -> Column:
    """Three lines or more, three columns or more by comma or tab, and the next four lines at most one field short."""
    lines = _lines(text)
    head = F.get(lines, 0)
    by = lambda sep: F.size(F.split(head, sep))
    fits = lambda sep: F.forall(F.slice(lines, 2, 4), lambda x: F.size(F.split(x, sep)) >= by(sep) - 1)
    return (F.size(lines) >= 3) & F.when(by(",") >= 3, fits(",")).when(by("\t") >= 3, fits("\t")).otherwise(False)


def routed(docs: DataFrame) -> DataFrame:
    """(doc_id, route): csv for table text, rows above ten lines, words otherwise."""
    return docs.select("doc_id", F.when(csv_like("text"), "csv").when(F.size(_lines("text")) > 10, "rows").otherwise("words").alias("route"))
