"""Sets of question ids, and sampling that any engine can repeat: rows in the order of the md5 of id and seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .corpus import dense_index

SEED = 42
NOISE_SHARE = 0.2
TEST_SHARE = 0.2
#: Rows of a sample that one task may merge.
SMALL_SAMPLE = 50_000


def lot(key: str | Column, seed: int = SEED) -> Column:
    """The lot that a row draws."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary"))


def sample(rows: DataFrame, n: int, key: str = "id", seed: int = SEED, clip: bool = False) -> DataFrame:
    """n rows without replacement, by the key, which is unique. Fewer rows are an error unless clip is set.

    A small sample is the top of the lots; a large one is cut off their numbered order, so that no task merges it.
    """
    if not clip and (there := rows.count()) < n:
        raise ValueError(f"{n} rows asked for, {there} there")
    if n <= SMALL_SAMPLE:
        return rows.orderBy(lot(key, seed), key).limit(n)
    drawn = F.concat_ws(":", lot(key, seed), F.col(key).cast("string"))
    return dense_index(rows.withColumn("_lot", drawn), "_lot", "_n").where(F.col("_n") < n).drop("_lot", "_n")


def half_even(x: float) -> int:
    return round(x)


def duplicates(questions: DataFrame, pairs: DataFrame) -> DataFrame:
    return questions.select("id").join(pairs.select(F.col("dup_id").alias("k")), F.col("id") == F.col("k"), "left_semi")


def mains(questions: DataFrame, pairs: DataFrame) -> DataFrame:
    return questions.select("id").join(pairs.select(F.col("main_id").alias("k")), F.col("id") == F.col("k"), "left_semi")


def answered(questions: DataFrame) -> DataFrame:
    return questions.where("n_answers > 0").select("id")


def comparison(questions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Questions that duplicates are compared with: answered ones and mains."""
    return answered(questions).union(mains(questions, pairs)).distinct()


def within(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Pairs with both ends in the set."""
    some = ids.select(F.col("id").alias("k"))
    return pairs.join(some, F.col("dup_id") == F.col("k"), "left_semi").join(some, F.col("main_id") == F.col("k"), "left_semi")


def in_pairs(questions: DataFrame, pairs: DataFrame) -> DataFrame:
    ends = pairs.select(F.col("dup_id").alias("k")).union(pairs.select("main_id"))
    return questions.join(ends, F.col("id") == F.col("k"), "left_semi")


def not_in_pairs(questions: DataFrame, pairs: DataFrame) -> DataFrame:
    ends = pairs.select(F.col("dup_id").alias("k")).union(pairs.select("main_id"))
    return questions.join(ends, F.col("id") == F.col("k"), "left_anti")


def noise(questions: DataFrame, pairs: DataFrame, share: float = NOISE_SHARE, seed: int = SEED) -> DataFrame:
    """Questions in no pair that play duplicates in training, as many as the share of the duplicates."""
    n = half_even(duplicates(questions, pairs).count() * share)
    return sample(not_in_pairs(questions, pairs).select("id"), n, "id", seed)


def split(ids: DataFrame, share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """id, part: 'test' for the share of the ids with the first lots, 'train' for the rest."""
    n = half_even(ids.count() * share)
    test = sample(ids.select("id"), n, "id", seed).select(F.col("id").alias("t"))
    return ids.select("id").join(test, F.col("id") == F.col("t"), "left").select("id", F.when(F.col("t").isNull(), "train").otherwise("test").alias("part"))


def sample_with_pairs(questions: DataFrame, pairs: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """id of n questions: all in the pairs, and others by lot."""
    fixed = in_pairs(questions, pairs).select("id")
    rest = n - fixed.count()
    if rest < 0:
        raise ValueError("more questions in pairs than asked for")
    return fixed.union(sample(not_in_pairs(questions, pairs).select("id"), rest, "id", seed)).distinct()


def folds(candidates: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """dup_id, fold (1 to k; 0: noise, always trained on). The first folds have one more where sizes differ."""
    dups = candidates.groupBy("dup_id").agg(F.max("is_noise").alias("noise"))
    real = dense_index(dups.where("not noise").select("dup_id", lot("dup_id", seed).alias("lot")), "lot", "n")
    count = real.count()
    size, more = count // k, count % k
    large = F.lit(more * (size + 1))
    fold = F.when(F.col("n") < large, F.floor(F.col("n") / (size + 1)) + 1).otherwise(F.lit(more) + F.floor((F.col("n") - large) / max(size, 1)) + 1)
    return real.select("dup_id", fold.cast("int").alias("fold")).union(dups.where("noise").select("dup_id", F.lit(0)))
