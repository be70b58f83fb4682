"""Queries of this subpackage for the driver, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kgspark.llm import audio, chat, decontam, jaccard, langid, lines, lloyd, packing, pii, secrets, simhash, treaps, urlgraph
from kgspark.llm._common import small_batches
from kgspark.llm._common import table as stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return stored(spark, sf_dir, name)


def tokenizer_path(name: str = packing.TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents")))


def op2_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digest(audio.featured(audio.media(table(spark, sf_dir, "documents"))))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat.read_back(chat.render(chat.fold(chat.log_of(rows))))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.judge(table(spark, sf_dir, "pages"))


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op11_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.digest(*lloyd.cluster(table(spark, sf_dir, "embeddings")))


def op12_treaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treaps.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_audio": op2_audio,
        "op3_langid": op3_langid,
        "op4_chat": op4_chat,
        "op5_jaccard": op5_jaccard,
        "op6_urls": op6_urls,
        "op7_decontam": op7_decontam,
        "op8_packing": op8_packing,
        "op9_lines": op9_lines,
        "op10_secrets": op10_secrets,
        "op11_lloyd": op11_lloyd,
        "op12_treaps": op12_treaps,
        "op13_simhash": op13_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_chat": chat.SQL,
        "op5_jaccard": jaccard.SQL,
        "op6_urls": urlgraph.sql(),
        "op7_decontam": decontam.SQL,
        "op10_secrets": secrets.sql(),
        "op11_lloyd": lloyd.sql(),
        "op12_treaps": treaps.SQL,
    }
