"""A corpus pipeline of five stages over ``documents``; each stage works on all that the one before it kept.

1. quality: documents that the classifier rejects go.
2. near_duplicates: of each class of near duplicates (five-word shingles, similarity 0.8) the document of the least doc_id stays.
3. decontamination: documents that hold a passage of the benchmark go.
4. pii: personal data in the texts is replaced by its kind.
5. pieces: the texts as SentencePiece ids, with proof that they decode to the texts.

A stage's result is written and read again before the next one.

Null and empty texts pass every stage as empty ones (they have no shingles, so one of them stays); a null doc_id is kept, as no other
row can name it.  Rows that repeat doc_id and text are near duplicates of each other; different texts of one doc_id are not,
unless they are similar.  Further columns, whatever their names, come out as they went in, of all but the last stage.  An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import common, decontaminate, pieces, pii, quality, simhash
from weftgraph.llm.queries import table, tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs, words=5, similarity=0.8, max_bits=10)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the texts, where it told their length before."""
    out = pii.redacted(docs)
    if "n_chars" not in out.columns:
        return out
    kind = out.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNull(), F.col("n_chars")).otherwise(F.coalesce(F.char_length("text").cast(kind), F.col("n_chars")))).select(docs.columns)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encoded(docs, tokenizer_path("piece_bpe_32k.model"), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("pieces", pieces_stage),
]

#: The first and the last stage are beyond SQL; tests/llm/test_pipeline.py holds run() against every stage done by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
