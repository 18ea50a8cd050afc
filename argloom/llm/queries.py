"""The operators as queries over the whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, impact_search, license_scan, mixing, near_dedup, ngram_model, packing, pii, quality_rules, sentencepiece_codec, token_shards, vector_codes, warc
from .shared import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.run(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.run(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.run(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.run(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_ngram_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_model.run(table(spark, sf_dir, "documents"), order=3)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.run(table(spark, sf_dir, "documents"))


def op9_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.run(table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.run(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.run(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_quality_rules, op3_mixing, op4_pii, op5_warc, op6_token_shards, op7_ngram_model, op8_near_dedup, op9_impact_search, op10_license_scan, op11_packing, op12_vector_codes, op13_collocations)}


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": mixing.PLAN_SQL, "op5_warc": warc.PAGES_SQL, "op8_near_dedup": near_dedup.LINKS_SQL, "op9_impact_search": impact_search.TOP_SQL, "op12_vector_codes": vector_codes.CODES_SQL, "op13_collocations": collocations.PHRASES_SQL}
