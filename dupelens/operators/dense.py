"""Duplicates against all comparison questions by vectors, in blocks: matrices of scores stay in the workers, which put out counts or the best."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import index, similarity

#: Rows of a block; a matrix of scores has as many by as many.
BLOCK = 2048


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    def unit(x: np.ndarray) -> np.ndarray:
        norms = np.sqrt((x * x).sum(1, keepdims=True))
        return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)

    return unit(a) @ unit(b).T


def _jensen_shannon(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    def half(x: np.ndarray, m: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0.0)

    rows = [((half(x[None, :], m) + half(b, m)) / 2).sum(1) for x in a for m in [(x[None, :] + b) / 2]]
    return 1.0 - np.sqrt(np.maximum(np.array(rows), 0.0))


#: By the same names as similarity.DENSE.
MEASURES: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {"topic": _cosine, "topic_jsd": _jensen_shannon, "doc2vec": _cosine, "bertoverflow": _cosine, "mpnet": _cosine, "dense": _cosine}


def _whole(ids: DataFrame, key: str, vectors: DataFrame) -> DataFrame:
    """The rows of ids with v; a question without a vector has zeros."""
    size = vectors.agg(F.max(F.size("v"))).first()[0] or 1
    there = vectors.select(F.col("id").alias("vid"), F.col("v").cast("array<double>").alias("v"))
    return ids.join(there, F.col(key) == F.col("vid"), "left").drop("vid").withColumn("v", F.coalesce("v", F.array_repeat(F.lit(0.0), size)))


def _blocks(rows: DataFrame, *keys: str) -> DataFrame:
    """A row for each block: an array for each column, the vectors one after another; rows of a block are in the order of the keys."""
    n = max(1, -(-rows.count() // BLOCK))
    dealt = rows.groupBy(F.pmod(F.xxhash64(*keys), F.lit(n)).alias("block")).agg(F.sort_array(F.collect_list(F.struct(*keys, *[c for c in rows.columns if c not in keys]))).alias("r"))
    return dealt.select(*[(F.flatten(F.col(f"r.{c}")) if c == "v" else F.col(f"r.{c}")).alias(c) for c in rows.columns]).coalesce(n)  # the product has a task for each two partitions


def _crossed(left: DataFrame, right: DataFrame, vectors: DataFrame, left_keys: tuple[str, ...]) -> DataFrame:
    a = _blocks(index.materialise(_whole(left, "dup_id", vectors)), *left_keys)
    b = _blocks(index.materialise(_whole(right.select("id"), "id", vectors)), "id").select(F.col("id").alias("ids"), F.col("v").alias("w"))
    return index.materialise(a).crossJoin(index.materialise(b))


def _matrices(batches: Iterator[pa.RecordBatch], measure: str, digits: int) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """The columns of the duplicates' block, the comparison questions' ids and the rounded scores, minus infinity for a question and itself."""
    for batch in batches:
        for n in range(batch.num_rows):
            x = {c: batch.column(c)[n].values.to_numpy(zero_copy_only=False) for c in batch.schema.names}
            scores = np.round(MEASURES[measure](x["v"].reshape(len(x["dup_id"]), -1), x["w"].reshape(len(x["ids"]), -1)), digits)
            scores[x["dup_id"][:, None] == x["ids"][None, :]] = -np.inf
            yield x, x["ids"], scores


def scores(vectors: DataFrame, measure: str, dups: DataFrame, comp: DataFrame) -> DataFrame:
    """dup_id, main_id, score of all duplicates and comparison questions but themselves: as many rows as that, so ranks and the best are made without it."""

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, ids, found in _matrices(batches, measure, 15):
            for k, row in enumerate(found):
                some = row > -np.inf
                yield pa.RecordBatch.from_pydict({"dup_id": np.full(some.sum(), x["dup_id"][k]), "main_id": ids[some], "score": row[some]})

    left = dups.select(F.col("id").cast("long").alias("dup_id"))
    return _crossed(left, comp, vectors, ("dup_id",)).mapInArrow(every, "dup_id long, main_id long, score double")


def pair_ranks(vectors: DataFrame, measure: str, pairs: DataFrame, comp: DataFrame, digits: int = 6) -> DataFrame:
    """dup_id, main_id, score, rank as ranking.pair_ranks gives them, among all comparison questions; vectors has id and v."""
    inside = comp.select(F.col("id").alias("k"))
    labelled = pairs.select(F.col("dup_id").cast("long"), F.col("main_id").cast("long")).join(inside, F.col("main_id") == F.col("k"), "left_semi").where("dup_id != main_id").distinct()
    both = _whole(labelled, "dup_id", vectors).withColumnRenamed("v", "v1")
    both = _whole(both, "main_id", vectors)
    own = both.select("dup_id", "main_id", similarity.DENSE[measure](F.col("v1"), F.col("v")).alias("own"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, _, scores in _matrices(batches, measure, digits):
            mine = np.round(x["own"], digits)
            above, tied = (scores > mine[:, None]).sum(1), (scores == mine[:, None]).sum(1)
            yield pa.RecordBatch.from_pydict({"dup_id": x["dup_id"], "main_id": x["main_id"], "score": mine, "above": above, "tied": tied})

    counted = _crossed(own, comp, vectors, ("dup_id", "main_id")).mapInArrow(count, "dup_id long, main_id long, score double, above long, tied long")
    return counted.groupBy("dup_id", "main_id", "score").agg((F.sum("above") + (F.sum("tied") + 1) / 2).alias("rank"))


def top_candidates(vectors: DataFrame, measure: str, dups: DataFrame, comp: DataFrame, n: int, digits: int = 6) -> DataFrame:
    """dup_id, candidate_id, score, rk: the n comparison questions of the highest scores, ties to the smaller id."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, ids, scores in _matrices(batches, measure, digits):
            k = min(n, len(ids))
            least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
            over, even = scores > least, scores == least
            taken = (over | even & (np.cumsum(even, axis=1) <= k - over.sum(1, keepdims=True))) & (scores > -np.inf)  # ids ascend
            row, column = np.nonzero(taken)
            yield pa.RecordBatch.from_pydict({"dup_id": x["dup_id"][row], "candidate_id": ids[column], "score": scores[row, column]})

    left = dups.select(F.col("id").cast("long").alias("dup_id"))
    found = _crossed(left, comp, vectors, ("dup_id",)).mapInArrow(best, "dup_id long, candidate_id long, score double")
    order = Window.partitionBy("dup_id").orderBy(F.desc("score"), "candidate_id")
    return found.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= n)
