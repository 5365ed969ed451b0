"""The registered query of each operator, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.llm.decontaminate import WINDOW, contamination
from strata.llm.language import predict_language, train_language_model
from strata.llm.licenses import scan_licenses
from strata.llm.near_duplicates import near_duplicates
from strata.llm.pieces import round_trip
from strata.llm.quality import score_quality, train_quality_model
from strata.llm.sharding import shard_documents
from strata.llm.tokens import tokenize_to_files
from strata.llm.topk import top_k
from strata.llm.toxicity import score_toxicity, train_toxicity_model


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return predict_language(docs, train_language_model(docs))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_toxicity(docs, train_toxicity_model(docs, _table(spark, sf_dir, "labels")))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return round_trip(_table(spark, sf_dir, "documents"), f.read())


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality_model(docs, _table(spark, sf_dir, "labels")))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenize_to_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2:3].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


#: Characters A to Z and a to z, for SQL's translate.
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP6_PATTERNS = {
    "mit": "(released )?(licensed )?under the (terms of the )?mit license",
    "mit-permission": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files( the software)? to deal in the software without restriction",
    "apache-2": "apache license version 2",
    "apache-2-notice": "licensed under the apache license version 2 0( the license)?",
    "apache-2-terms": "you may not use this file except in compliance with the license",
    "cc-by-nc": "cc by nc",
    "cc-by-nc-4": "licensed under (a )?(creative commons )?cc by nc (license )?4 0",
    "cc-by": "licensed under (a )?creative commons attribution( [^ ]+){0,2} (4 0 )?international license",
    "gpl-3": "licensed under the (terms of the )?gnu general public license( as published by the free software foundation)?( either)? version 3( of the license)?",
    "gpl-2": "under the terms of the gnu general public license( as published by the free software foundation)?( either)? version 2( of the license)?",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl-2": "subject to the terms of the mozilla public license v 2 0",
    "all-rights-reserved": "all rights reserved",
}


def _op6_sql() -> str:
    def places(phrase: str) -> str:
        words = phrase.split()
        return " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words, 1))

    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    base = ", ".join(f"list_filter(range(len(w)), lambda i: {places(p)}) AS p{k}" for k, p in enumerate(phrases.values()))
    named = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in enumerate(phrases))
    every = ", ".join(f"CASE WHEN regexp_matches(s, ' {p} ') THEN '{label}' END" for label, p in _OP6_PATTERNS.items())
    return f"""
WITH words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
found AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s, {base} FROM words),
told AS (
  SELECT doc_id, len(w) AS n_words, list_concat(list_concat(p0, p1), p2) AS places,
    list_sort(list_filter([{named}], lambda x: x IS NOT NULL)) AS b, list_sort(list_filter([{every}], lambda x: x IS NOT NULL)) AS l
  FROM found)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
  array_to_string(b, ',') AS base_labels, array_to_string(l, ',') AS labels, len(l) / (len(l) + 1) AS score
FROM told"""


_OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
k AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS k, array_to_string(w[i + 1 : i + least(len(w), {WINDOW})], ' ') AS s
      FROM (SELECT item_id, w, unnest(range(greatest(len(w) - {WINDOW} + 1, 1))) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT k FROM k),
places AS (SELECT r, w, k, unnest(range(len(w) - k + 1)) AS i FROM d, lengths WHERE len(w) >= k),
hits AS (SELECT r, i, k, item_id FROM (SELECT r, i, k, array_to_string(w[i + 1 : i + k], ' ') AS s FROM places) JOIN k USING (s, k)),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN items USING (r)"""


_OP9_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score,
    row_number() OVER (PARTITION BY q.r ORDER BY list_inner_product(q.e, v.e) DESC, v.vec_id) AS rank
  FROM v AS q, v WHERE q.vec_id % 50 = 0 AND q.r <> v.r)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM s WHERE rank <= 5"""


def oracle_sql() -> dict[str, str]:
    return {"op6_licenses": _op6_sql(), "op8_decontamination": _OP8_SQL, "op9_top_k": _OP9_SQL}
