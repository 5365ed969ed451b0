"""A corpus pipeline: recognised language, no toxicity, one document of each near-duplicate group, no benchmark text, token ids."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strata.llm.common import new_shared_path
from strata.llm.decontaminate import remove_contamination
from strata.llm.language import keep_known_languages, train_language_model
from strata.llm.near_duplicates import keep_representatives
from strata.llm.pieces import round_trip
from strata.llm.toxicity import drop_toxic, train_toxicity_model


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model, trained on docs, recognises."""
    return keep_known_languages(docs, train_language_model(docs))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of toxicity."""
    return drop_toxic(docs, train_toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each component."""
    return keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; a document that is mostly such passages goes whole."""
    return remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, text (decoded from the ids), restored (whether it is the text that was encoded)."""
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return round_trip(docs, f.read())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Trained models, components and merges have no SQL form; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
