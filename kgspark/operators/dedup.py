"""Label normal forms and fuzzy duplicates (NRM-4, NRM-5, JN-10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions.text import by_kind, lower_trim, similarity

THRESHOLD = 0.75
MIN_LENGTH = 2


def normalized_labels(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", by_kind("label", "type").alias("label"))


def _edits(length):
    """Most edits that still reach the threshold for a longer label of this length."""
    return F.floor(length * (1 - THRESHOLD) + 1e-9).cast("int")


def similar(nodes: DataFrame) -> DataFrame:
    """Pairs of nodes a < b with label similarity of at least 0.75: a, b, score, reason.

    Partition filter: a label of length n at most k edits away from another keeps one of the other's k + 1 even
    segments unchanged, at nearly the same place. Labels meet on (length, segment number, segment), so only labels that
    share a segment are compared. Equal labels are compared once, as groups.
    """
    rows = nodes.select("id", "label", "type").where(F.length("label") >= MIN_LENGTH)
    labels = rows.select("label").distinct().withColumn("n", F.length("label"))
    # The longer label is cut into k + 1 segments, k by its own length.
    k = _edits(F.col("n"))
    size = F.floor(F.col("n") / (k + 1)).cast("int")
    extra = F.col("n") - size * (k + 1)
    begin = lambda i: i * size + F.greatest(F.lit(0), i - (k + 1 - extra))
    width = lambda i: size + F.when(i >= k + 1 - extra, F.lit(1)).otherwise(F.lit(0))
    cut = labels.select(
        F.col("label").alias("long"), "n",
        F.posexplode(F.transform(F.sequence(F.lit(0), k), lambda i: F.substring(F.col("label"), begin(i) + 1, width(i)))).alias("seg", "piece"),
    )
    # The shorter label offers, for each possible length of a longer partner, its substrings near each segment's place.
    partner = F.explode(F.sequence(F.col("n"), F.floor(F.col("n") / THRESHOLD + 1e-9).cast("int"))).alias("m")
    offers = labels.select("label", F.col("n").alias("short_n"), partner)
    k = _edits(F.col("m"))
    size = F.floor(F.col("m") / (k + 1)).cast("int")
    extra = F.col("m") - size * (k + 1)
    offers = offers.withColumns({"k": k, "size": size, "extra": extra})
    offers = offers.select("label", "short_n", "m", "k", "size", "extra", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("seg"))
    start = F.col("seg") * F.col("size") + F.greatest(F.lit(0), F.col("seg") - (F.col("k") + 1 - F.col("extra")))
    wide = F.col("size") + F.when(F.col("seg") >= F.col("k") + 1 - F.col("extra"), 1).otherwise(0)
    offers = offers.withColumns({"start": start, "wide": wide}).where("wide <= short_n")
    low, high = F.greatest(F.lit(0), F.col("start") - F.col("k")), F.least(F.col("short_n") - F.col("wide"), F.col("start") + F.col("k"))
    offers = offers.where(low <= high).select(
        F.col("label").alias("short"), F.col("m").alias("n"), "seg",
        F.explode(F.array_distinct(F.transform(F.sequence(low, high), lambda p: F.substring(F.col("label"), p + 1, F.col("wide"))))).alias("piece"),
    )
    met = offers.join(cut, ["n", "seg", "piece"]).where("short <> long").select("short", "long").distinct()
    scored = met.withColumn("score", similarity("short", "long")).where(F.col("score") >= THRESHOLD)
    pairs = scored.select(F.least("short", "long").alias("x"), F.greatest("short", "long").alias("y"), "score").distinct()
    both = pairs.union(labels.select("label", "label", F.lit(1.0)))
    a = rows.select(F.col("id").alias("ia"), F.col("label").alias("x"), F.col("type").alias("ta"))
    b = rows.select(F.col("id").alias("ib"), F.col("label").alias("y"), F.col("type").alias("tb"))
    out = both.join(a, "x").join(b, "y").where((F.col("x") != F.col("y")) | (F.col("ia") < F.col("ib")))
    swap = F.col("ia") > F.col("ib")
    pick = lambda p, q: F.when(swap, F.col(q)).otherwise(F.col(p))
    out = out.select(
        pick("ia", "ib").alias("a"), pick("ib", "ia").alias("b"), lower_trim(pick("x", "y")).alias("la"), lower_trim(pick("y", "x")).alias("lb"),
        pick("ta", "tb").alias("ta"), pick("tb", "ta").alias("tb"), "score",
    )
    reason = (
        F.when((F.col("la") == F.col("lb")) & ~F.col("ta").eqNullSafe(F.col("tb")), F.lit("same label, other type"))
        .when(F.col("la") == F.col("lb"), F.lit("same label"))
        .when(F.startswith("la", F.col("lb")) | F.startswith("lb", F.col("la")), F.lit("prefix"))
        .when(F.contains("la", F.col("lb")) | F.contains("lb", F.col("la")), F.lit("containment"))
        .otherwise(F.format_string("similarity %d%%", F.floor(F.col("score") * 100 + 0.5)))
    )
    return out.select("a", "b", "score", reason.alias("reason"))
