"""The queries opN_<name>: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, common, decontaminate, imatch, licenses, pieces, pii, quality, simhash, tokenbin, wrappers


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file; it is the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, max_bits=4)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_report(table(spark, sf_dir, "documents"))


def op4_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "tokens")
    tokenbin.write(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return tokenbin.read(spark, path)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op5_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extracted(table(spark, sf_dir, "pages"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", told), (-7, 1, "assistant", told)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(common.written(chat.formatted(turns), "chat"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_pii": op2_pii,
    "op3_pieces": op3_pieces,
    "op4_token_planes": op4_token_planes,
    "op5_wrappers": op5_wrappers,
    "op6_chat": op6_chat,
    "op7_quality": op7_quality,
    "op8_decontamination": op8_decontamination,
    "op9_licenses": op9_licenses,
    "op10_imatch": op10_imatch,
}

ORACLE_SQL: dict[str, str] = {
    "op2_pii": pii.oracle_sql(),
    "op8_decontamination": decontaminate.oracle_sql(),
    "op9_licenses": licenses.oracle_sql(),
}
