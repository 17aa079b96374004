"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, embedding_join, jaccard_join, language_id, lexical_search, license_scan, nearest, quality, token_counts, token_store, url_filter, vector_codes
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, tokenizer="word_bpe_49k.json", limit=2048).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer="byte_bpe_50k.json")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score", F.size("detections").cast("long").alias("n_detections"))


def queries() -> dict[str, Query]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_bpe_round_trip": op2_bpe_round_trip,
        "op3_license_scan": op3_license_scan,
        "op4_token_store": token_store.op4_token_store,
        "op5_embedding_join": embedding_join.op5_embedding_join,
        "op6_url_filter": url_filter.op6_url_filter,
        "op7_jaccard_join": jaccard_join.op7_jaccard_join,
        "op8_language_id": language_id.op8_language_id,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_quality": quality.op10_quality,
        "op11_nearest": nearest.op11_nearest,
        "op12_lexical_search": lexical_search.op12_lexical_search,
        "op13_vector_codes": vector_codes.op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_embedding_join": embedding_join.OP5_SQL, "op6_url_filter": url_filter.OP6_SQL, "op7_jaccard_join": jaccard_join.OP7_SQL, "op9_decontaminate": decontaminate.OP9_SQL, "op12_lexical_search": lexical_search.OP12_SQL, "op13_vector_codes": vector_codes.OP13_SQL}
