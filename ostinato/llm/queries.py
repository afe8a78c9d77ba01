"""The text operators as queries over the sample tables, with their contracts' columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .exact import exact_duplicates
from .extraction import extract_main_text
from .langid import held_out_languages
from .packing import pack_documents
from .pieces import piece_digests
from .pii import find_pii
from .ranked import RANKED_SQL, ranked_search
from .repetition import repetition_rules
from .simhash import near_duplicates
from .substring import remove_repeats
from .tokenfiles import token_file_digests
from .toxicity import held_out_toxicity
from .whitening import whiten


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return held_out_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    return held_out_languages(table(spark, folder, "documents"))


def op3_substring(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents"), digests=True)


def op4_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return piece_digests(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(table(spark, folder, "documents"))


def op6_repetition(spark: SparkSession, folder: str) -> DataFrame:
    return repetition_rules(table(spark, folder, "documents"))


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract_main_text(table(spark, folder, "pages"))


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    return find_pii(table(spark, folder, "documents")).drop("text_hash")


def op11_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_file_digests(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"))


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_toxicity,
            op2_language,
            op3_substring,
            op4_sentencepiece,
            op5_exact_dedup,
            op6_repetition,
            op7_packing,
            op8_extraction,
            op9_simhash,
            op10_pii,
            op11_token_files,
            op12_whitening,
            op13_ranked_search,
        )
    }


def llm_sql() -> dict[str, str]:
    return {"op5_exact_dedup": EXACT_SQL, "op13_ranked_search": RANKED_SQL}


EXACT_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256, n_points FROM g
"""
