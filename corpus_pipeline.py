"""The corpus pipeline: quality classifier, language ID, SimHash near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of ``documents``; a document that the mix takes more than once is as many rows. Models learn from rows that are
not held out: quality from the labelled rows of the table ``documents``, languages from what the first stage kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import language, mixing, packing, quality_model, simhash
from tessera.llm.common import crc32_mod, table, written
from tessera.operators.kept import dealt


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_model.keep_good(docs, quality_model.fit_tables(spark, table(spark, sf_dir, "documents"), sf_dir))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs, language.fit(docs.where(crc32_mod("doc_id", 4) != 2)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), remember=150_000)  # workers hold the other stages' models too


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources", mix),
    ("best-fit packing", pack),
]

#: Models, near-duplicate components and packing are beyond SQL; tests hold stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written as Parquet and read again."""
    docs = dealt(table(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
