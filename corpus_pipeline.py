"""A corpus pipeline of five stages: language ID, near-duplicate removal, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``docs``, whatever further columns it has and whatever their names. Decisions are joined back to rows by id and text
together, so that different texts of one id are judged each on its own. Texts of any length are judged whole.
An empty table gives an empty result in every stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fernline.llm import decontaminate, langid, mixing, queries, sharding, simhash
from fernline.llm.common import remove, scratch, shared_dir

#: The stages need a fitted model, fingerprints and hash draws, which SQL can't express.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents in which no language is found, or none with a score of `langid.LEAST`.

    A null text and one without a letter have no language. Without labelled documents there is nothing to tell languages by, and
    every text with a letter stays. Equal texts fare equally; rows that repeat stay as often as they come.
    """
    return langid.with_language(docs, queries.fitted_languages(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: the one with the least id, of equal ids the one with the least digest of its text.

    Null texts and texts without a word are one group; a null id comes after all others; of rows that repeat id and text one stays.
    """
    return simhash.without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of the benchmark.

    A null text holds none; without benchmark items all rows stay; rows that repeat fare equally.
    """
    return decontaminate.without_contaminated(docs, queries.table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    A null source is one more source, the last; a null text has size 0; equal rows share what falls to them in any order.
    """
    return mixing.mixed_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each row.

    A null id is the empty key; a null text has 0 bytes; rows that repeat get a slot each.
    """
    return sharding.shard_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written as Parquet in the shared folder and read again; what a stage read is then removed."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark).rstrip('/')}/pipeline-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return docs
