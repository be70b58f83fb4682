"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Stages return the columns of documents, the last one packed pieces; other columns of their input are not carried. An
empty table passes through every stage as one. What a stage decides takes effect:
  language_id        documents whose language is ``und`` or scored below ``MIN_SCORE`` go
  ngram_jaccard      one document of each class stays, the one with the least doc_id; of equal rows one
  decontaminate      documents that hold a benchmark window go
  secrets            secrets are replaced in the text; the document stays
  packing            the rest is packed into sequences
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm import decontam, jaccard, langid, packing, secrets
from kgspark.llm._common import small_batches, table
from kgspark.llm.queries import tokenizer_path
from kgspark.plans.graph import clear, cut, cuts_made

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MIN_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = langid.predict(docs, langid.fitted(docs), COLUMNS)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(*COLUMNS)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard.keep_one(docs).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontam.search(docs, table(spark, sf_dir, "benchmark"), carry=COLUMNS).where("n_hit = 0").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("decontaminate", decontaminate),
    ("secrets", redact_secrets),
    ("packing", pack),
]
#: A trained network and a tokenizer are not SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. Each stage's output is a table of its own; what a stage made on its way there is deleted."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        made = cuts_made()
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
            clear(spark, made, cuts_made() - 1)
    return docs
