"""Approximate nearest neighbours by an inverted multi-index.

Vectors are normalised and their halves quantised apart, each with a codebook fitted on a bounded sample; a cell is a
pair of centroids, and every vector is in one. A query walks through the pairs by summed distance with a heap until the
cells seen hold a share of all vectors, and the entries of these cells are reranked by the exact cosine of the original
vectors. The share is measured, not guessed: it is what sampled queries need to find `recall` of their true neighbours
among the sampled vectors. Clustered vectors need a small share; vectors without structure need a large one. Equal vectors are one entry, with the smallest of their ids
that a result can need. Neighbouring cells make up regions of about `REGION` entries, which are what tasks work on; a
cell with more entries is dealt over several regions, and more than `ASKING` queries go in turns.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import bounded_batches, lean, use_shared_folder

#: Vectors that the codebooks are fitted on, about.
SAMPLE_VECTORS = 20_000
#: Sampled queries that the share of vectors to visit is measured with.
SAMPLE_QUERIES = 200
#: Entries in a region, about.
REGION = 2000
#: Queries that visit a region together, about.
ASKING = 20_000
#: Centroids of a half, at most; the table of cell sizes is broadcast and has the square of it.
MOST_CENTROIDS = 512


def _codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's k-means; empty clusters are put on the points that lie farthest off."""
    generator = np.random.default_rng(seed)
    centres = x[generator.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        far = ((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1))
        near = far.argmin(1)
        sizes = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        full = sizes > 0
        centres[full] = sums[full] / sizes[full, None]
        lost = np.flatnonzero(~full)
        if len(lost):
            centres[lost] = x[np.argsort(-far.min(1))[: len(lost)]]
    return centres


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled first, so that large and tiny components neither overflow nor vanish."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def _distances(halves: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (halves**2).sum(1)[:, None] - 2 * halves @ centres.T + (centres**2).sum(1)


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, enough: int) -> list[int]:
    """Cells in the order of first[i] + second[j], until they hold `enough` entries or none is left; empty cells are passed over."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, cells, got = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and got < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(second) + int(b[j])
        if sizes[cell]:
            cells.append(cell)
            got += int(sizes[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))
    return cells


def share_to_visit(units: np.ndarray, cut: int, books: list[np.ndarray], k: int, recall: float) -> float:
    """The share of the sampled vectors that the walk has to see to find `recall` of the k true neighbours of sampled queries."""
    cells = _distances(units[:, :cut], books[0]).argmin(1) * len(books[1]) + _distances(units[:, cut:], books[1]).argmin(1)
    sizes = np.bincount(cells, minlength=len(books[0]) * len(books[1]))
    needed = []
    for q in range(0, len(units), max(1, len(units) // SAMPLE_QUERIES)):
        near = units @ units[q]
        near[q] = -np.inf
        true = np.argpartition(-near, min(k, len(near) - 1))[:k]
        sums = (_distances(units[q : q + 1, :cut], books[0])[0][:, None] + _distances(units[q : q + 1, cut:], books[1])[0]).ravel()
        order = np.argsort(sums)
        seen = np.empty(len(order))
        seen[order] = np.cumsum(sizes[order])
        needed += (seen[cells[true]] / len(units)).tolist()
    return float(np.quantile(needed, recall))


def regions(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First region and number of regions of each cell. Cells in order fill regions; one with over REGION entries has its own."""
    count = np.maximum(1, -(-sizes // REGION))
    alone = count > 1
    filled = np.cumsum(np.where(alone, REGION, sizes)) - np.where(alone, REGION, sizes)
    place = filled // REGION + np.cumsum(alone) * 2  # a large cell never shares its number
    _, first = np.unique(np.stack([place, np.cumsum(alone) * 2 - alone], 1), axis=0, return_inverse=True)
    first = first.ravel()
    width = np.zeros(first.max() + 1, np.int64)
    np.maximum.at(width, first, count)
    return (np.cumsum(width) - width)[first], count


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def valid_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id, v of the vectors that can take part: not null or zero, all components finite, of the commonest dimension (of equally common ones the largest)."""
    kept = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    kept = kept.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(finite & F.exists("v", lambda x: x != 0))
    shapes = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(2).collect()
    return kept.where(F.size("v") == shapes[0]["d"]) if len(shapes) > 1 else kept


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, recall: float = 0.95, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE_VECTORS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query among all rows but those of its own id.

    Nearness is the largest cosine in double precision; ties go to the smaller vec_id. Vectors that are null, zero or of
    another dimension, or hold null or non-finite components, take no part; nor do null ids. Rows that repeat id and
    vector count once. Queries without any candidate, and empty tables, give no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    use_shared_folder(spark)
    bounded_batches(spark, 5000)
    rows = valid_vectors(vectors.where(F.col(vector).isNotNull()), key, vector)
    window = Window.partitionBy("v").orderBy("vec_id")
    # ids of equal vectors: the k + 1 least are all that a result can show
    firsts = rows.distinct().withColumn("r", F.row_number().over(window)).where(F.col("r") <= k + 1)
    classes = firsts.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("class"), "ids", F.col("v"))
    # one class a vector; a vec_id with several vectors may lead several classes, so the vector's hash is part of the name
    classes = classes.withColumn("hash", F.xxhash64("v")).checkpoint()
    total = classes.count()
    queries = rows.where(is_query).distinct().withColumnRenamed("vec_id", "query_id")
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    share = min(1.0, sample / total)
    chosen = classes.where(F.pmod(F.xxhash64("hash", "class"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("v").toPandas()
    units = _unit(np.array([np.asarray(v, np.float64) for v in (chosen["v"] if len(chosen) else [classes.first()["v"]])]))
    cut = (units.shape[1] + 1) // 2
    centroids = int(min(MOST_CENTROIDS, max(4, round((total / 50) ** 0.5))))
    books = [_codebook(units[:, :cut], centroids), _codebook(units[:, cut:], centroids) if units.shape[1] > cut else np.zeros((1, 0))]
    enough = int(np.ceil(share_to_visit(units, cut, books, k, recall) * total)) + k
    shared = spark.sparkContext.broadcast(books)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = shared.value
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.column("v")))
                cell = _distances(x[:, :cut], one).argmin(1) * len(two) + _distances(x[:, cut:], two).argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *batch.columns], ["cell", *batch.schema.names])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    entries = classes.mapInArrow(lean(place), f"cell int, {kinds}")
    sizes = np.zeros(len(books[0]) * len(books[1]), np.int64)
    for r in entries.groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]
    plan = spark.sparkContext.broadcast((sizes, *regions(sizes)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first, count = plan.value
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            region = first[cell] + batch.column("hash").to_numpy() % count[cell]
            yield pa.RecordBatch.from_arrays([pa.array(region, pa.int64()), *batch.columns], ["region", *batch.schema.names])

    dealt = entries.mapInArrow(lean(deal), f"region long, cell int, {kinds}")
    asked = queries.select("v").distinct().withColumn("hash", F.xxhash64("v"))
    asked = asked.join(classes.select(F.col("v").alias("w"), "class"), F.col("v") == F.col("w")).select("class", "hash", "v")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = shared.value
        held, start, count = plan.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(_matrix(batch.column("v")))
            first, second = _distances(x[:, :cut], one), _distances(x[:, cut:], two)
            at, where, cells = [], [], []
            for n in range(batch.num_rows):
                visited: dict[int, list[int]] = {}
                for c in walk(first[n], second[n], held, enough):
                    for r in range(int(start[c]), int(start[c] + count[c])):
                        visited.setdefault(r, []).append(c)
                at += [n] * len(visited)
                where += visited
                cells += visited.values()
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(cells, pa.list_(pa.int32())), *batch.take(pa.array(at, pa.int32())).columns], ["region", "cells", *batch.schema.names])

    element = next(f.dataType for f in classes.schema if f.name == "v")
    element = element.simpleString() if isinstance(element, T.ArrayType) else "array<double>"
    probes = asked.mapInArrow(lean(probe), f"region long, cells array<int>, class long, hash long, v {element}")

    def rerank(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        columns = ["qclass", "qhash", "ids", "score"]
        if not len(asking) or not len(held):
            return pd.DataFrame({c: [] for c in columns})
        entry = np.stack(held["v"].to_numpy()).astype(np.float64)
        norm, order = np.sqrt((entry**2).sum(1)), held["class"].to_numpy()
        cell = held["cell"].to_numpy()
        ids, names, tags = held["ids"].to_numpy(), asking["class"].to_numpy(), asking["hash"].to_numpy()
        out = []
        for first in range(0, len(asking), 256):
            queries = np.stack(asking["v"].to_numpy()[first : first + 256]).astype(np.float64)
            lengths = np.sqrt((queries**2).sum(1))
            # the product finds who may be among the best; those are measured one by one, alike wherever they stand
            rough = (entry @ queries.T) / np.outer(norm, lengths)
            for n, mine in enumerate(asking["cells"].to_numpy()[first : first + 256]):
                rough[~np.isin(cell, mine), n] = -np.inf
            last = np.partition(rough, max(len(entry) - k - 1, 0), axis=0)[max(len(entry) - k - 1, 0)] - 1e-9
            for n in range(len(queries)):
                may = np.flatnonzero((rough[:, n] >= last[n]) & (rough[:, n] > -np.inf))
                score = (entry[may] * queries[n]).sum(1) / (norm[may] * lengths[n])
                best = np.lexsort((order[may], -score))[: k + 1]
                out += [(names[first + n], tags[first + n], ids[may[b]], float(score[b])) for b in best.tolist()]
        return pd.DataFrame(out, columns=columns)

    turns = -(-asked.count() // ASKING)
    probes = probes.withColumn("turn", F.pmod("hash", F.lit(max(turns, 1))).cast("int"))
    dealt = dealt.withColumn("turn", F.explode(F.array(*[F.lit(t) for t in range(turns)])) if turns > 1 else F.lit(0))
    found = probes.groupBy("region", "turn").cogroup(dealt.groupBy("region", "turn")).applyInPandas(rerank, "qclass long, qhash long, ids array<long>, score double")
    best = Window.partitionBy("qclass", "qhash").orderBy(F.desc("score"), F.col("ids")[0])
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).select("qclass", "qhash", "score", F.explode("ids").alias("vec_id"))
    named = queries.withColumn("qh", F.xxhash64("v")).join(asked.select(F.col("class").alias("c"), F.col("hash").alias("h"), F.col("v").alias("w")), (F.col("qh") == F.col("h")) & (F.col("v") == F.col("w"))).select("query_id", "c", "h")
    pairs = named.join(found, (F.col("c") == F.col("qclass")) & (F.col("h") == F.col("qhash"))).where("query_id != vec_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
