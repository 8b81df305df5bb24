"""The logical tables of the engine, read from the stored ones. Ids are longs; every function gives a lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write(df: DataFrame, path: str, *partitions: str) -> None:
    """The sink of every stage: Parquet, replaced as a whole, partitioned by e.g. the data set."""
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, question_id, score, body, post_date, accepted: the assistant's turns of a conversation answer its question."""
    turns = read(spark, sf_dir, "conversations").where("role = 'assistant'")
    return turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("question_id"), F.length("text").cast("long").alias("score"), F.col("text").alias("body"), F.col("turn").alias("post_date"), (F.col("turn") % 3 == 1).alias("accepted")
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title, body, tags of each document."""
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("body"), F.concat("lang", F.lit(","), "source").alias("tags"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, n_answers, title, body, tags of each document."""
    counts = answers(spark, sf_dir).groupBy(F.col("question_id").alias("q")).agg(F.count("*").alias("n"))
    docs = read(spark, sf_dir, "documents")
    return docs.join(counts, docs["doc_id"] == counts["q"], "left").select(
        F.col("doc_id").alias("id"), F.coalesce("n", F.lit(0)).alias("n_answers"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("body"), F.concat("lang", F.lit(","), "source").alias("tags")
    )


def dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dup_id, main_id: equal texts are duplicates of the one with the least id. Digests are compared, so texts aren't shuffled."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("dup_id"), F.sha2("text", 256).alias("digest"))
    mains = docs.groupBy(F.col("digest").alias("d")).agg(F.min("dup_id").alias("main_id"), F.count("*").alias("n")).where("n > 1")
    return docs.join(mains, F.col("digest") == F.col("d")).where("dup_id != main_id").select("dup_id", "main_id")
