"""Candidate pairs: retrieval, labels, truncation and undersampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .corpus import dense_index
from .ids import SEED, half_even, lot


def top_candidates(scores: DataFrame, dups: DataFrame, comp: DataFrame, n: int, digits: int = 6) -> DataFrame:
    """dup_id, candidate_id, score, rk: the n comparison questions of the highest scores, ties to the smaller id.

    Where fewer than n share a term, questions that score 0 fill up, smallest ids first. As many as n + the listed ones are
    looked at for that, so only the n smallest ids that a duplicate hasn't listed are ever made.
    """
    best = Window.partitionBy("dup_id").orderBy(F.desc("score"), "candidate_id")
    listed = scores.select("dup_id", F.col("main_id").alias("candidate_id"), F.round("score", digits).alias("score"))
    ranked = listed.where("score > 0").withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= n)
    short = dups.select(F.col("id").alias("dup_id")).join(ranked.groupBy(F.col("dup_id").alias("d")).agg(F.count("*").alias("got")), F.col("dup_id") == F.col("d"), "left").select("dup_id", F.coalesce("got", F.lit(0)).alias("got")).where(F.col("got") < n)
    # a duplicate that lists g < n questions lacks n - g; these are among the 2n + 1 smallest ids, less those listed and itself
    first = comp.select("id").orderBy("id").limit(2 * n + 1).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    mine = listed.join(short.select(F.col("dup_id").alias("s")), F.col("dup_id") == F.col("s"), "left_semi").groupBy(F.col("dup_id").alias("d2")).agg(F.collect_list(F.when(F.col("score") > 0, F.col("candidate_id"))).alias("have"), F.collect_list(F.when(F.col("score") < 0, F.col("candidate_id"))).alias("negative"))
    filled = short.join(mine, F.col("dup_id") == F.col("d2"), "left").withColumn("ids", first.scalar())
    free = F.array_except("ids", F.concat(F.coalesce("have", F.array().cast("array<bigint>")), F.coalesce("negative", F.array().cast("array<bigint>")), F.array("dup_id")))
    padding = filled.select("dup_id", "got", F.posexplode(F.slice(free, F.lit(1), F.lit(n) - F.col("got"))).alias("pos", "candidate_id")).select("dup_id", "candidate_id", F.lit(0.0).alias("score"), (F.col("got") + F.col("pos") + 1).cast("int").alias("rk"))
    return ranked.union(padding)


def with_dup_labels(candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """is_dup: whether the pair is a known one."""
    known = pairs.select(F.col("dup_id").alias("pd"), F.col("main_id").alias("pm")).distinct()
    return candidates.join(known, (F.col("dup_id") == F.col("pd")) & (F.col("candidate_id") == F.col("pm")), "left").withColumn("is_dup", F.col("pd").isNotNull()).drop("pd", "pm")


def with_noise_labels(candidates: DataFrame, noise: DataFrame) -> DataFrame:
    """is_noise: whether the duplicate only plays one."""
    ids = noise.select(F.col("id").alias("nid"))
    return candidates.join(ids, F.col("dup_id") == F.col("nid"), "left").withColumn("is_noise", F.col("nid").isNotNull()).drop("nid")


def limit_candidates(candidates: DataFrame, n: int) -> DataFrame:
    """The n best of each duplicate, by the rank that retrieval gave."""
    return candidates.where(F.col("rk") <= n)


def undersample(candidates: DataFrame, share: float, seed: int = SEED) -> DataFrame:
    """All true pairs and so many others that the true ones are about `share`; duplicates take equal parts of the others.

    Of the duplicates in order of id, the first few give one more where it doesn't divide. Without false pairs, or with
    fewer than a duplicate's part, all there are stay.
    """
    true = candidates.where("is_dup")
    false = candidates.where("not is_dup")
    quota = half_even(1 / share - 1) * true.count()
    dups = dense_index(false.select(F.col("dup_id").alias("q")).distinct(), "q", "pos")
    n = max(dups.count(), 1)
    parts = dups.select("q", (F.lit(quota // n) + F.when(F.col("pos") < quota % n, 1).otherwise(0)).alias("part"))
    drawn = false.withColumn("draw", F.row_number().over(Window.partitionBy("dup_id").orderBy(lot(F.concat_ws("-", "dup_id", "candidate_id"), seed), "candidate_id")))
    kept = drawn.join(parts, F.col("dup_id") == F.col("q")).where(F.col("draw") <= F.col("part")).select(*candidates.columns)
    return true.unionByName(kept)


def undersample_if_rare(candidates: DataFrame, share: float, seed: int = SEED) -> DataFrame:
    """Undersampled only if the true pairs are rarer than `share`."""
    now = candidates.agg(F.avg(F.col("is_dup").cast("double")).alias("p")).first()["p"]
    return undersample(candidates, share, seed) if now is not None and now < share else candidates


def merged(*candidates: DataFrame) -> DataFrame:
    """Distinct pairs of several candidate sets."""
    columns = ("dup_id", "candidate_id", "score", "is_dup", "is_noise")
    out = candidates[0].select(*columns)
    for c in candidates[1:]:
        out = out.unionByName(c.select(*columns))
    return out.distinct()
