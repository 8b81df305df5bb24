"""Ranks of known duplicates among all comparison questions, and recall rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KS = (5, 10, 20)


def pair_ranks(scores: DataFrame, pairs: DataFrame, comp: DataFrame, digits: int = 6) -> DataFrame:
    """dup_id, main_id, score, rank of each labelled pair whose main is a comparison question.

    The rank is that of the score, highest first, among all comparison questions but the duplicate itself; ties share the
    mean of their ranks. Questions that share no term score 0 and have no row in `scores`: they are counted, not listed.
    Scores are compared as rounded to `digits`.
    """
    inside = comp.select(F.col("id").alias("k"))
    labelled = pairs.join(inside, F.col("main_id") == F.col("k"), "left_semi").where("dup_id != main_id").distinct()
    totals = labelled.select("dup_id").distinct().join(inside, F.col("dup_id") == F.col("k"), "left").select(F.col("dup_id").alias("td"), F.col("k").isNotNull().cast("long").alias("self"))
    rounded = scores.select(F.col("dup_id").alias("d"), F.col("main_id").alias("m"), F.round("score", digits).alias("s"))
    rounded = rounded.join(labelled.select("dup_id").distinct(), F.col("d") == F.col("dup_id"), "left_semi")
    # counts by distinct score, so a duplicate's window holds scores, not questions
    levels = rounded.groupBy("d", "s").agg(F.count("*").alias("n"))
    below = Window.partitionBy("d").orderBy(F.desc("s"))
    levels = levels.withColumn("above", F.sum("n").over(below) - F.col("n"))
    sums = levels.groupBy(F.col("d").alias("d2")).agg(F.sum("n").alias("listed"), F.sum(F.when(F.col("s") > 0, F.col("n")).otherwise(0)).alias("positive"), F.sum(F.when(F.col("s") == 0, F.col("n")).otherwise(0)).alias("listed_zero"))
    own = labelled.join(rounded, (F.col("dup_id") == F.col("d")) & (F.col("main_id") == F.col("m")), "left").select("dup_id", "main_id", F.coalesce("s", F.lit(0.0)).alias("score"))
    own = own.join(totals, F.col("dup_id") == F.col("td")).join(sums, F.col("dup_id") == F.col("d2"), "left")
    own = own.join(levels.select(F.col("d").alias("d3"), F.col("s").alias("s3"), "n", "above"), (F.col("dup_id") == F.col("d3")) & (F.col("score") == F.col("s3")), "left")
    none = comp.agg(F.count("*")).scalar() - F.col("self") - F.coalesce("listed", F.lit(0))
    zero = F.coalesce("listed_zero", F.lit(0)) + none
    above = F.when(F.col("score") > 0, F.col("above")).when(F.col("score") == 0, F.coalesce("positive", F.lit(0))).otherwise(F.col("above") + none)
    tied = F.when(F.col("score") == 0, zero).otherwise(F.col("n"))
    return own.select("dup_id", "main_id", "score", (above + (tied + 1) / 2).alias("rank"))


def average_ranks(scores: DataFrame, digits: int = 6) -> DataFrame:
    """The rows of a complete table of scores with `rank`, ties sharing the mean of their ranks."""
    s = F.round("score", digits)
    highest = Window.partitionBy("dup_id").orderBy(F.desc(s))
    return scores.withColumn("rank", F.rank().over(highest) + (F.count("*").over(Window.partitionBy("dup_id", s)) - 1) / 2)


def recall_rates(ranks: DataFrame, *by: str, ks: tuple[int, ...] = KS) -> DataFrame:
    """Share of the duplicates that have a labelled pair within the first k ranks, for each k; duplicates without one aren't there."""
    dups = ranks.groupBy(*by, "dup_id").agg(*[F.bool_or(F.col("rank") <= k).alias(f"hit_{k}") for k in ks])
    return dups.groupBy(*by).agg(*[F.avg(F.col(f"hit_{k}").cast("double")).alias(f"recall_{k}") for k in ks])


def recall_by_score(predictions: DataFrame, score: str, *by: str, ks: tuple[int, ...] = KS) -> DataFrame:
    """Share of all duplicates in the pair set that have a true pair among the k best by the score; one that wasn't retrieved is a miss."""
    best = Window.partitionBy(*by, "dup_id").orderBy(F.desc(score), "candidate_id")
    ranked = predictions.select(*by, "dup_id", "candidate_id", "is_dup", score).withColumn("r", F.row_number().over(best))
    dups = ranked.groupBy(*by, "dup_id").agg(*[F.bool_or(F.col("is_dup") & (F.col("r") <= k)).alias(f"hit_{k}") for k in ks])
    return dups.groupBy(*by).agg(*[F.avg(F.col(f"hit_{k}").cast("double")).alias(f"rr_{k}") for k in ks])
