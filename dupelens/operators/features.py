"""Wide feature tables of candidate pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import similarity


def feature_table(candidates: DataFrame, postings: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """dup_id, candidate_id and {part}_{measure}_sim for each (part, measure) of the postings."""
    pairs = candidates.select("dup_id", F.col("candidate_id").alias("main_id")).distinct()
    return similarity.score_features(pairs, postings).withColumnRenamed("main_id", "candidate_id")


def merge_features(candidates: DataFrame, *tables: DataFrame) -> DataFrame:
    """The candidates with the columns of all feature tables, joined on the pair."""

    def add(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right, ["dup_id", "candidate_id"], "left")

    return reduce(add, tables, candidates)


def feature_faults(merged: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row of counts that are all 0 for a sound set: self pairs, repeated pairs, missing pairs, nulls in features."""
    sims = [c for c in merged.columns if c.endswith("_sim")]
    nulls = sum(F.col(c).isNull().cast("int") for c in sims) if sims else F.lit(0)
    one = merged.agg(F.sum((F.col("dup_id") == F.col("candidate_id")).cast("int")).alias("self_pairs"), (F.count("*") - F.count_distinct("dup_id", "candidate_id")).alias("repeated"), F.sum(nulls).alias("nulls"))
    keys = merged.select(F.col("dup_id").alias("d"), F.col("candidate_id").alias("c"))
    missing = candidates.join(keys, (F.col("dup_id") == F.col("d")) & (F.col("candidate_id") == F.col("c")), "left_anti").agg(F.count("*").alias("missing"))
    return one.withColumn("missing", missing.scalar())
