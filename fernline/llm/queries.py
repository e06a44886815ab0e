"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown_lm, decontaminate, langid, mixing, mpeg_audio, pii, sharding, simhash, token_counts, url_filters

#: (host, path, verdict)
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*columns)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir, "doc_id", "text"))


def op3_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.class_lm_scores(documents(spark, sf_dir, "doc_id", "text"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op5_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.media_columns(documents(spark, sf_dir, "doc_id", "text"))


def fitted_languages(docs: DataFrame) -> langid.Model:
    """Learned from the documents whose crc32(doc_id as text) modulo 4 is not 2."""
    from .common import id_bucket

    return langid.fit(docs.where(id_bucket(F.col("doc_id"), 4) != 2))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import id_bucket

    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    found = langid.identify(docs.select("doc_id", "text"), fitted_languages(docs))
    return found.select("doc_id", (id_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(documents(spark, sf_dir, "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(documents(spark, sf_dir, "doc_id", "text"), str(public_tokenizers.path(token_counts.MODEL)))


def op10_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir, "doc_id", "text"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_url_filters, op2_pii, op3_brown_lm, op4_decontaminate, op5_mpeg_audio, op6_langid, op7_simhash, op8_mix_sources, op9_token_counts, op10_shard_tree)}
