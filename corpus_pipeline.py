"""From raw documents to token ids: five stages, each over all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupelens.llm import bpe, decontam, langid, pii, simhash
from dupelens.llm.common import drop, scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; those without a letter go, null and empty texts among them.

    Without any labelled document no language is known, and none stays. Repeated rows give a row each.
    """
    model = langid.train_language_model(docs, F.lit(True))
    judged = langid.predict_language(docs, model, carry=COLUMNS)
    return judged.where("lang_pred != 'und'").select(*[F.col(f"carried_{n}").alias(c) for n, c in enumerate(COLUMNS)])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the least doc_id; of rows that share it, see one_of_each().

    A row goes only if another of its group stays, so unrelated texts under one doc_id all stay.
    """
    return simhash.one_of_each(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none."""
    return decontam.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data redacted; n_chars follows the text. Null texts stay null, repeated rows give a row each."""
    found = pii.find_pii(docs, pii.train_pii_model(docs), carry=("lang", "source"))
    return pii.redact(found).select("doc_id", "text", F.col("carried_0").alias("lang"), F.col("carried_1").alias("source"), F.length("text").cast("long").alias("n_chars"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids (little-endian unsigned 32-bit integers) of each document.

    A null or empty text has no ids. Repeated rows give a row each, null keys are kept.
    """
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    decoded = bpe.bpe_decode(bpe.bpe_encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("redact", redact), ("encode", encode)]

#: SQL can express neither the classifiers nor the encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what each keeps is written to the shared folder and read again.

    Only the last stays there, until the driver ends. An empty table gives no rows.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    folder = scratch(spark, "corpus")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop(spark, before)
        before = path
    return docs
