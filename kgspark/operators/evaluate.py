"""Evaluation (AGG-15, SET-3): verdicts of links against what is accepted, metrics by run and over runs, fact sets compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Verdicts, and those that are a link made.
VERDICTS = ("correct", "wrong", "missed", "false link", "abstained")
LINKED = VERDICTS[0], VERDICTS[1], VERDICTS[3]
METRICS = ("precision", "recall", "abstention")


def verdicts(rows: DataFrame) -> DataFrame:
    """Adds ``verdict`` to rows with accept and got (arrays of ids; empty or null: none).

    With something to accept: correct if one of it was got, wrong if something else was linked, else missed. With nothing
    to accept: a false link if something was linked, else abstained. Linked is what was got, or a column ``linked`` if
    not all of that is a link (a core relation is right where it is accepted, but no link).
    """
    none = F.array().cast("array<string>")
    accept, got = F.coalesce("accept", none), F.coalesce("got", none)
    linked = F.coalesce(F.col("linked"), F.lit(False)) if "linked" in rows.columns else F.size(got) > 0
    verdict = F.when(F.size(accept) > 0, F.when(F.arrays_overlap(accept, got), VERDICTS[0]).when(linked, VERDICTS[1]).otherwise(VERDICTS[2]))
    return rows.withColumn("verdict", verdict.otherwise(F.when(linked, VERDICTS[3]).otherwise(VERDICTS[4])))


def pct(part: Column, whole: Column) -> Column:
    """A share in per cent with one decimal; null of nothing."""
    return F.when(whole > 0, F.round(100.0 * part / whole, 1))


def metrics(judged: DataFrame, groups: list[list[str]]) -> DataFrame:
    """precision, recall and abstention in per cent, and the counts, for each of the groupings: one pass over the rows.

    Columns of other groupings are null; ``grouping`` tells which one a row belongs to, as its columns joined.
    """
    columns = sorted({c for g in groups for c in g})
    n = {v: F.count_if(F.col("verdict") == v) for v in VERDICTS}
    positive = n["correct"] + n["wrong"] + n["missed"]
    negative = n["false link"] + n["abstained"]
    label = F.concat_ws(",", *(F.when(F.grouping(c) == 0, F.lit(c)) for c in columns)) if columns else F.lit("")
    return judged.groupingSets([[F.col(c) for c in g] for g in groups], *(F.col(c) for c in columns)).agg(
        label.alias("grouping"), pct(n["correct"], n["correct"] + n["wrong"] + n["false link"]).alias("precision"), pct(n["correct"], positive).alias("recall"),
        pct(n["abstained"], negative).alias("abstention"), *(c.alias(v.replace(" ", "_")) for v, c in n.items()), positive.alias("positives"), negative.alias("negatives"),
    )


def over_runs(by_run: DataFrame, names: tuple[str, ...] = METRICS) -> DataFrame:
    """metric, mean, least, most, runs over rows that have one run each; runs without a value are left out of its metric."""
    long = by_run.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in names))).alias("m")).select("m.*").where("v is not null")
    return long.groupBy("metric").agg(F.round(F.avg("v"), 1).alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"), F.count("*").alias("runs"))


def methods(judged: DataFrame, by: list[str]) -> DataFrame:
    """How many links each method made, by the given columns."""
    return judged.where(F.col("verdict").isin(*LINKED)).groupBy(*by, F.coalesce("method", F.lit("-")).alias("method")).agg(F.count("*").alias("links"))


def failures(judged: DataFrame) -> DataFrame:
    return judged.where(~F.col("verdict").isin("correct", "abstained"))


def differences(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """side (both, extra, missing), s, p, o of two fact sets; repeats count once."""
    key = ["s", "p", "o"]
    a, b = ours.select(*key).distinct(), theirs.select(*key).distinct()
    side = lambda df, name: df.select(F.lit(name).alias("side"), *key)
    return side(a.intersect(b), "both").union(side(a.exceptAll(b), "extra")).union(side(b.exceptAll(a), "missing"))


def agreement(found: DataFrame, examples: int = 8) -> DataFrame:
    """By relation and over all (null): both, extra, missing, soundness and completeness in per cent, and the first few
    that differ."""
    n = lambda side: F.count_if(F.col("side") == side)
    counts = found.groupingSets([[F.col("p")], []], F.col("p")).agg(
        (F.grouping("p") == 1).alias("total"), n("both").alias("both"), n("extra").alias("extra"), n("missing").alias("missing"),
        pct(n("both"), n("both") + n("extra")).alias("soundness"), pct(n("both"), n("both") + n("missing")).alias("completeness"),
    )
    said = F.concat_ws(" ", "side", "s", "p", "o")
    rows = found.where("side <> 'both'").select("p", said.alias("text"))
    every = rows.select("p", "text", F.explode(F.array(F.lit(False), F.lit(True))).alias("total")).withColumn("p", F.when(~F.col("total"), F.col("p")))
    first = every.withColumn("n", F.row_number().over(W.partitionBy("total", "p").orderBy("text"))).where(F.col("n") <= examples)
    told = first.groupBy("total", "p").agg(F.sort_array(F.collect_list("text")).alias("examples"))
    out = counts.join(told, counts["p"].eqNullSafe(told["p"]) & (counts["total"] == told["total"]), "left")
    return out.select(counts["p"], counts["total"], "both", "extra", "missing", "soundness", "completeness", F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))
