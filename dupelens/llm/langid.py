"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of a bounded sample of labelled documents into a table of `buckets` log-probabilities for
each language; the matrix is broadcast (buckets x languages x 4 bytes) and batches are scored sparsely in numpy: every
n-gram of the whole text gathers its row of the matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded_batches, lean, texts_of

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Labelled documents that the classifier is fitted on, about; more are thinned by a hash of their key.
SAMPLE_DOCUMENTS = 20_000
#: Languages with rows in the matrix; a label set beyond it is refused, for the matrix is broadcast.
MOST_LANGUAGES = 512


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    #: buckets x languages, natural logarithms
    weights: np.ndarray
    prior: np.ndarray


class _Letters:
    """Whether code points are letters, found out as they occur."""

    def __init__(self):
        self.known = np.zeros(0x110000, np.int8)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        kinds = self.known[points]
        if (kinds == 0).any():
            for p in np.unique(points[kinds == 0]).tolist():
                self.known[p] = 1 if chr(p).isalpha() else -1
            kinds = self.known[points]
        return kinds > 0


def _grams(texts: list[str], letters: _Letters, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, the text that each is of, and the letters of each text.

    Texts are lower-cased; what isn't a letter is a word boundary. An n-gram has a boundary at its ends at most.
    """
    lowered = [f" {t.lower()} " for t in texts]
    sizes = np.array([len(t) for t in lowered])
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters(points)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    points = np.where(letter, points, 32).astype(np.uint64)
    found, of = [], []
    for n in ORDERS:
        if len(points) < n:
            continue
        end = len(points) - n + 1
        good = letter[:end].copy() if n == 1 else np.ones(end, bool)
        for k in range(1, n - 1):
            good &= letter[k : k + end]
        if n == 2:
            good &= letter[:-1] | letter[1:]
        h = np.full(end, n, np.uint64)
        for k in range(n):
            h = (h ^ points[k : k + end]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        found.append(((h[good] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32))
        of.append(owner[:end][good])
    return np.concatenate(found), np.concatenate(of), np.bincount(owner[letter], minlength=len(texts))


def train_language_model(documents: DataFrame, use: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_DOCUMENTS, buckets: int = BUCKETS, smoothing: float = 0.5) -> LanguageModel:
    """The model of the rows for which `use` holds and whose text and lang are not null.

    Of more than `sample` such rows, those with the lowest hashes of key and text are taken, about `sample` of them; rows
    that repeat count once. Without any labelled row the model has no language and predicts `und`.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    labelled = documents.where(use & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    by_language = labelled.groupBy("lang").count().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(by_language) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    languages = tuple(r["lang"] for r in by_language)
    if not languages:
        return LanguageModel((), np.zeros((buckets, 0), np.float32), np.zeros(0))
    share = sample / sum(r["count"] for r in by_language)
    if share < 1:
        labelled = labelled.where(F.pmod(F.xxhash64("key", "text"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    labelled = labelled.distinct()
    row_of = {x: k for k, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _Letters()
        sums = np.zeros(len(row_of) * buckets, np.int64)
        for block in blocks(batches, "text", 1 << 20):
            rows = np.array([row_of[x] for x in block.column("lang").to_pylist()])
            grams, of, _ = _grams(texts_of(block, "text"), letters, buckets)
            sums += np.bincount(rows[of] * buckets + grams, minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.record_batch({"cell": pa.array(at, pa.int64()), "n": pa.array(sums[at], pa.int64())})

    cells = labelled.select("lang", "text").mapInArrow(lean(count), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(languages) * buckets)
    counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    counts = counts.reshape(len(languages), buckets).T + smoothing
    totals = np.array([r["count"] for r in by_language], float)
    return LanguageModel(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32), np.log(totals / totals.sum()))


def predict_language(documents: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score of each document, over its whole text, and the columns to carry as carried_<n>.

    A text that is null, empty or without a letter is `und` with score 0. score is the posterior of the predicted
    language, with evidence tempered by the square root of the number of n-grams, for those of one text depend on each
    other. Ties go to the language first in order. Repeated rows give a row each; other columns are ignored.
    """
    bounded_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    more = [documents[c].alias(f"carried_{n}") for n, c in enumerate(carry)]
    source = documents.select(documents[key].alias("doc_id"), documents[text].alias("text"), *more)
    kind = source.schema["doc_id"].dataType.simpleString()
    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in source.schema[2:])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, letters = shared.value, _Letters()
        for block in blocks(batches, "text", 1 << 20):
            grams, of, n_letters = _grams(texts_of(block, "text"), letters, len(m.weights))
            size = block.num_rows
            n = np.bincount(of, minlength=size)
            likely = np.stack([np.bincount(of, m.weights[:, k][grams], size) for k in range(len(m.languages))], 1) if m.languages else np.zeros((size, 1))
            logits = (likely + (m.prior if m.languages else 0)) / np.sqrt(np.maximum(n, 1))[:, None]
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            best = odds.argmax(axis=1)
            score = odds.max(axis=1) / odds.sum(axis=1)
            known = (n_letters > 0) & bool(m.languages)
            yield pa.record_batch(
                {
                    "doc_id": block.column("doc_id"),
                    "lang_pred": pa.array([m.languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)], pa.string()),
                    "score": pa.array(np.where(known, score, 0.0), pa.float64()),
                    **{f"carried_{n}": block.column(f"carried_{n}") for n in range(len(carry))},
                }
            )

    return source.mapInArrow(lean(predict), f"doc_id {kind}, lang_pred string, score double{kinds}")
