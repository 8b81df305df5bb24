"""Evaluation summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .corpus import PARTS

# Shown names and orders.
SHOWN = {"jaccard": "Jaccard", "tfidf": "TF-IDF", "bm25": "BM25", "topic": "Topic", "doc2vec": "Doc2Vec", "bertoverflow": "BERTOverflow", "mpnet": "MPNet"}
SITES = {"gamedev_se": "https://gamedev.stackexchange.com/questions/"}
OTHER_SITE = "https://stackoverflow.com/questions/"


def misclassified(predictions: DataFrame, pairs: DataFrame, k: int = 20, site: str = OTHER_SITE) -> DataFrame:
    """Duplicates without a true pair among the k best: dup_id, main_id, top_ranked, has_dup and their addresses.

    main_id is the best-ranked true candidate if there is one, else the first main of the duplicate.
    """
    best = Window.partitionBy("dup_id").orderBy(F.desc("pred"), "candidate_id")
    ranked = predictions.withColumn("r", F.row_number().over(best))
    dups = ranked.groupBy("dup_id").agg(
        F.bool_or(F.col("is_dup") & (F.col("r") <= k)).alias("hit"), F.bool_or("is_dup").alias("has_dup"), F.min_by("candidate_id", F.when(F.col("is_dup"), F.col("r"))).alias("true_main"), F.min_by("candidate_id", F.when(~F.col("is_dup"), F.col("r"))).alias("top_ranked")
    )
    firsts = pairs.groupBy(F.col("dup_id").alias("d")).agg(F.min("main_id").alias("first_main"))
    missed = dups.where("not hit").join(firsts, F.col("dup_id") == F.col("d"), "left").select("dup_id", F.coalesce("true_main", "first_main").alias("main_id"), "top_ranked", "has_dup")
    url = lambda c: F.concat(F.lit(site), F.col(c).cast("string"), F.lit("/")).alias(f"{c}_url")
    return missed.select("*", url("dup_id"), url("main_id"), url("top_ranked"))


def shown_mean(value: str) -> tuple:
    """Text of mean and standard deviation, two decimals; the deviation of one value isn't shown."""
    std = F.stddev_samp(value)
    return F.concat(F.format_string("%.2f", F.avg(value)), F.lit(" "), F.when(std.isNull(), "").otherwise(F.concat(F.lit("("), F.format_string("%.2f", F.round(std, 2)), F.lit(")"))))


def similarity_summary(rates: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """dataset_name, score, similarity and a column for each part: recall in percent, mean and deviation over data sets."""
    long = rates.select("dataset_name", "feature", "col", F.explode(F.array(*[F.struct(F.lit(f"recall-rate@{k}").alias("score"), F.round(F.col(f"recall_{k}") * 100, 2).alias("value")) for k in ks])).alias("x")).select("dataset_name", "feature", "col", "x.*")
    names = F.create_map(*[F.lit(x) for pair in SHOWN.items() for x in pair])
    out = long.withColumn("similarity", names[F.col("feature")]).groupBy("dataset_name", "score", "similarity").pivot("col", list(PARTS)).agg(shown_mean("value"))
    order = F.array_position(F.array(*[F.lit(v) for v in SHOWN.values()]), F.col("similarity"))
    return out.orderBy("dataset_name", F.length("score"), "score", order)


def rate_summary(results: DataFrame, *by: str, columns: tuple[str, ...] = ("rr_5", "rr_10", "rr_20")) -> DataFrame:
    """Mean and deviation of rates in percent."""
    percent = results.select(*by, *[F.round(F.col(c) * 100, 2).alias(c) for c in columns])
    return percent.groupBy(*by).agg(*[shown_mean(c).alias(c) for c in columns])


def dataset_sizes(counts: DataFrame) -> DataFrame:
    """Mean sizes by source and topic, shown with separators; counts has questions, duplicates, pairs of each data set."""
    means = counts.groupBy("source", "topic").agg(*[F.avg(c).alias(c) for c in ("questions", "duplicates", "pairs")])
    share = F.round(F.col("duplicates") / F.col("questions") * 100, 1)
    shown = lambda c: F.format_number(c, 0)
    return means.select("source", "topic", shown(F.col("questions")).alias("questions"), shown(F.col("questions") - F.col("duplicates")).alias("non_duplicates"), F.concat(shown(F.col("duplicates")), F.lit(" ("), F.format_string("%.1f", share), F.lit("%)")).alias("duplicates"), shown(F.col("pairs")).alias("pairs"))


def misclassified_counts(tested: DataFrame, missed: DataFrame) -> DataFrame:
    """Duplicates in the test set, those misclassified and their share, and those whose main wasn't retrieved and their share of the missed."""
    one = tested.agg(F.count_distinct("dup_id").alias("tested"))
    two = missed.agg(F.struct(F.count("*").alias("missed"), F.coalesce(F.sum((~F.col("has_dup")).cast("long")), F.lit(0)).alias("not_retrieved")))
    percent = lambda a, b: F.coalesce(F.bround(F.try_divide(a, b) * 100).cast("long"), F.lit(0))
    out = one.withColumn("m", two.scalar()).select("tested", "m.*")
    return out.select("tested", "missed", percent(F.col("missed"), F.col("tested")).alias("missed_percent"), "not_retrieved", percent(F.col("not_retrieved"), F.col("missed")).alias("not_retrieved_percent"))


def rank_outliers(ranks: DataFrame, *by: str) -> DataFrame:
    """The ranks with log10_rank and whether it lies 1.5 interquartile ranges below the first quartile of its group."""
    logs = ranks.withColumn("log10_rank", F.log10("rank"))
    bounds = logs.groupBy(*[F.col(b).alias(f"_{b}") for b in by]).agg(F.percentile("log10_rank", 0.25).alias("q1"), F.percentile("log10_rank", 0.75).alias("q3"))
    match = [F.col(b) == F.col(f"_{b}") for b in by]
    joined = logs.join(bounds, match) if by else logs.crossJoin(bounds)
    return joined.withColumn("outlier", F.col("log10_rank") < F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).drop("q1", "q3", *[f"_{b}" for b in by])
