"""A training-data pipeline over ``documents``: each stage filters or rewrites what the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rtlake.llm import language, lines, mixing, near, pieces
from rtlake.llm.common import checkpoint_folder, remove, small

#: Near duplicates: words of a shingle, least similarity in per cent.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language can be told: text with letters, and a posterior of at least a half.

    Text, stated language and source are the evidence. Rows that share an id stand or fall together; rows without
    an id are judged as one document and stay if any of them would.
    """
    found = language.identify(language.of_documents(docs), language.train(docs))
    rejected = found.groupBy("doc_id").agg(F.max("accepted").alias("any")).filter(~F.col("any")).select(F.col("doc_id").alias("__rejected"), F.lit(True).alias("__out"))
    joined = docs.join(small(rejected), docs["doc_id"].eqNullSafe(F.col("__rejected")), "left")
    return joined.filter(F.col("__out").isNull()).select(*[docs[c] for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated and nearly repeated lines out of all documents but the earliest; documents left without words go, if they had any."""
    had = mixing.words(F.col("text")) > 0
    out = lines.dedup(docs.select(*docs.columns, had.alias("__had")))
    out = out.filter(~F.col("__had") | (mixing.words(F.col("text")) > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least id, of each group of near duplicates. Rows that repeat an id are one document and stay or go together."""
    found = near.linked(docs, NEAR_SHINGLE, NEAR_PERCENT).groupBy("doc_id").agg(F.min("kept").alias("kept"))
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("__gone"))
    return docs.join(small(gone), docs["doc_id"] == F.col("__gone"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix does: three times at most, and not at all beyond its source's target.

    Null texts and texts without words count no words and go with their id's hash; null sources are one source; rows
    that repeat an id are decided alike.
    """
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, exact, parity of every row. Null and empty texts have no ids."""
    return pieces.encode(docs, decoded=False).select("doc_id", "n_tokens", "token_ids", "exact", "parity")


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("SentencePiece", encode_pieces),
]
#: Trained language models and a tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written as Parquet in the shared folder and read again.

    A stage's folder goes once the next one's is written; the last stays, as the result is read from it.
    """
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
