"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op01_langid, op02_decontaminate, op03_lm, op04_license, op05_warc, op06_jaccard, op07_mixing, op08_pii, op09_exact_dedup, op10_html
from .textkit import crc_mod, read


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = op01_langid.fit_on(docs, crc_mod("doc_id", 3) != 1)
    out = op01_langid.detect(docs, model)
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_decontaminate.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op03_lm.score(read(spark, sf_dir, "documents"), crc_mod("doc_id", 5) != 1)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_license.digest(op04_license.scan(read(spark, sf_dir, "documents")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_warc.round_trip(read(spark, sf_dir, "pages"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_jaccard.jaccard_components(read(spark, sf_dir, "documents"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_html.extract(read(spark, sf_dir, "pages"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_mixing.mix(read(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_pii.digest(op08_pii.detect(read(spark, sf_dir, "documents")))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_decontaminate": op2_decontaminate,
        "op3_lm_score": op3_lm_score,
        "op4_license_scan": op4_license_scan,
        "op5_warc": op5_warc,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_mixing": op7_mixing,
        "op8_personal_data": op8_personal_data,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_main_text": op10_main_text,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_warc": op05_warc.ORACLE, "op7_mixing": op07_mixing.oracle(), "op9_exact_dedup": op09_exact_dedup.ORACLE}
