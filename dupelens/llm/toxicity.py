"""Toxicity by maximum-scoring segments.

Each word has a log-odds weight under Dirichlet priors, learned from the document frequencies of a bounded sample of
labelled documents, less a drift that makes clean text fall on average. The prior of a word is what its beginning says:
beginnings of 4, 5 and 6 letters have weights of their own, each with the shorter one as prior, and stand in for words that
training hasn't seen. A linear-time scan finds all maximal-scoring
segments of a text. Their scores follow an extreme-value law with parameters from the clean documents, which gives each
segment an expected number of chance occurrences; segments below `significance` are passages. A logistic curve, fitted on
labelled documents that took no part in the weights, turns the evidence into a probability.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded_batches, lean, texts_of, use_shared_folder

#: Labelled documents that the classifier is fitted on, about; more are thinned by a hash of their key.
SAMPLE_DOCUMENTS = 40_000
#: Documents of the training sample that a word must be in to have a weight; more where over MOST_WORDS words would have one.
LEAST_DOCUMENTS = 3
#: Words and beginnings that may have weights, which are broadcast.
MOST_WORDS = 1_000_000
#: Mass of the Dirichlet prior of a word, in documents.
PRIOR = 10.0
#: Lengths of beginnings, and what marks them in the table.
BEGINNINGS = (4, 5, 6)
MARK = "*"
#: Words within which a repeated word counts once.
NEAR = 8
#: Words whose weights a worker remembers.
REMEMBERED = 500_000
WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    drift: float
    #: Of the extreme-value law.
    rate: float
    scale: float
    significance: float
    #: Of the logistic curve.
    curve: tuple[float, ...]


def maximal_segments(steps: np.ndarray) -> list[tuple[int, int, float]]:
    """(begin, end, sum) of all maximal-scoring segments, in linear time.

    A stack holds segments as (begin, end, sum before, sum after). A new one is merged with the nearest earlier segment
    that begins lower, as long as it also ends higher.
    """
    total, stack = 0.0, []
    for at in range(len(steps)):
        s = float(steps[at])
        before, total = total, total + s
        if s <= 0:
            continue
        begin, low, high = at, before, total
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= low:
                k = stack[k][4]
            if k < 0 or stack[k][3] >= high:
                stack.append((begin, at + 1, low, high, k))
                break
            begin, low = stack[k][0], stack[k][2]
            del stack[k:]
    return [(b, e, high - low) for b, e, low, high, _ in stack]


class _Weights(dict):
    """Weights by word: its own, or that of its longest known beginning, or 0."""

    def __init__(self, table: dict[str, float]):
        super().__init__()
        self.table = table

    def __missing__(self, word: str) -> float:
        found = self.table.get(word)
        for n in reversed(BEGINNINGS):
            if found is None and len(word) > n:
                found = self.table.get(word[:n] + MARK)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = found or 0.0
        return found


def _units(words: set[str]) -> set[str]:
    """Words and their beginnings."""
    return words | {w[:n] + MARK for w in words for n in BEGINNINGS if len(w) > n}


def _steps(words: list[str], weights: _Weights, drift: float) -> np.ndarray:
    """Weights less the drift. A word that was among the NEAR words before it is no further evidence, so it isn't above 0."""
    found = np.fromiter(map(weights.__getitem__, words), np.float64, len(words))
    if len(found) and found.max() > 0:
        names = np.fromiter(map(hash, words), np.int64, len(words))
        again = np.zeros(len(words), bool)
        for k in range(1, min(NEAR, len(words) - 1) + 1):
            again[k:] |= names[k:] == names[:-k]
        found[again & (found > 0)] = 0.0
    return found - drift


def _log_odds(table: dict[str, tuple[int, int]], share: float) -> dict[str, float]:
    """Weights of the words and beginnings that differ from what their beginning says.

    The rate of each is its toxic documents over all, with PRIOR documents at the rate of the next shorter beginning.
    """
    rates: dict[str, float] = {}
    shown: dict[str, float] = {}
    base = np.log(share / (1 - share))

    def parent(unit: str) -> str | None:
        letters = unit.rstrip(MARK)
        lengths = [n for n in BEGINNINGS if n < len(letters) and letters[:n] + MARK in rates]
        return letters[: lengths[-1]] + MARK if lengths else None

    for unit in sorted(table, key=lambda u: (u[-1] != MARK, len(u), u)):
        n0, n1 = table[unit]
        above = parent(unit)
        rates[unit] = (n1 + PRIOR * (share if above is None else rates[above])) / (n0 + n1 + PRIOR)
        weight = float(np.log(rates[unit] / (1 - rates[unit])) - base)
        while above is not None and above not in shown:
            above = parent(above)
        if abs(weight - (0.0 if above is None else shown[above])) >= 0.2:
            shown[unit] = weight
    return shown


def _best(steps: np.ndarray) -> float:
    """The largest sum of a segment, 0 if none is positive."""
    if not len(steps):
        return 0.0
    sums = np.concatenate(([0.0], np.cumsum(steps)))
    return float((sums - np.minimum.accumulate(sums)).max())


def _expected(best, n, rate: float, scale: float):
    return scale * np.maximum(n, 1) * np.exp(-rate * best)


def _evidence(steps: np.ndarray, rate: float, scale: float, significance: float) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """Features of a text and its significant passages as (begin, end, expected number)."""
    best = _best(steps)
    least = _expected(best, len(steps), rate, scale)
    found = []
    if best > 0 and least < significance:
        found = [(b, e, x) for b, e, s in maximal_segments(steps) if (x := float(_expected(s, len(steps), rate, scale))) < significance]
    strength = -np.log(max(float(least), 1e-60))
    return np.array([1.0, max(strength, 0.0), min(strength, 0.0) if best > 0 else -5.0, np.log1p(sum(-np.log(max(x, 1e-60)) for _, _, x in found))]), found


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (y - p) - 1e-2 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train_toxicity_model(documents: DataFrame, labels: DataFrame, use: Column, key: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE_DOCUMENTS, significance: float = 0.05) -> ToxicityModel:
    """The model of the labelled documents for whose key `use` holds.

    A key with several labels counts as toxic if any is 1; null labels, null texts and null keys are ignored, and rows
    that repeat key and text count once. Four
    fifths of the sample give the weights, the rest the extreme-value law and the curve. Without labels of both kinds
    the weights are empty and the score is the share of toxic labels.
    """
    bounded_batches(documents.sparkSession)
    use_shared_folder(documents.sparkSession)
    marks = labels.where(F.col(key).isNotNull() & F.col(toxic).isNotNull() & use).groupBy(F.col(key).alias("k")).agg(F.max(F.col(toxic).cast("int")).alias("y"))
    n = marks.count()
    if n > sample:
        marks = marks.where(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < int(sample / n * 1_000_000) + 1)
    part = F.pmod(F.xxhash64("k", F.lit(7)), F.lit(5))
    labelled = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null").join(F.broadcast(marks), F.col("key") == F.col("k"))
    # the sample is written once, for five passes read it
    labelled = labelled.select("key", "text", "y", part.alias("part")).distinct().drop("key").checkpoint()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies, sizes = (Counter(), Counter()), [0, 0]
        for block in blocks(batches, "text"):
            for t, y in zip(texts_of(block, "text"), block.column("y").to_pylist(), strict=True):
                tallies[y > 0].update(_units(set(WORD.findall(t.lower()))))
                sizes[y > 0] += 1
        words = list(tallies[0].keys() | tallies[1].keys())
        yield pa.record_batch({"word": pa.array(["", *words], pa.string()), "n0": pa.array([sizes[0], *(tallies[0][w] for w in words)], pa.int64()), "n1": pa.array([sizes[1], *(tallies[1][w] for w in words)], pa.int64())})

    counted = labelled.where("part != 0").select("text", "y").mapInArrow(lean(count), "word string, n0 long, n1 long")
    sums = counted.groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(f"word = '' or n0 + n1 >= {LEAST_DOCUMENTS}").checkpoint()
    # how many words are in so many documents, from which the least number follows
    sizes = sorted(((r["n"], r["count"]) for r in sums.where("word != ''").groupBy(F.least(F.col("n0") + F.col("n1"), F.lit(10_000)).alias("n")).count().collect()), reverse=True)
    least, words = LEAST_DOCUMENTS, 0
    for n, c in sizes:
        words += c
        if words > MOST_WORDS:
            least = n + 1
            break
    table = sums.where(f"word = '' or n0 + n1 >= {least}").toPandas()
    totals = table[table.word == ""]
    all0, all1 = (int(totals[c].sum()) for c in ("n0", "n1"))
    if not all0 or not all1:
        share = all1 / max(all0 + all1, 1)
        return ToxicityModel({}, 0.1, 1.0, 1.0, significance, (float(np.log((share + 1e-3) / (1 - share + 1e-3))), 0.0, 0.0, 0.0))
    table = table[table.word != ""]
    share = all1 / (all0 + all1)
    weights = _log_odds(dict(zip(table.word, zip(table.n0, table.n1, strict=True), strict=True)), share)

    # the clean documents that took no part in the weights give the drift and the law of chance segments
    shared = documents.sparkSession.sparkContext.broadcast(weights)
    grid = np.linspace(-12, 12, 481)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, w = np.zeros(len(grid), np.int64), _Weights(shared.value)
        for block in blocks(batches, "text"):
            for t in texts_of(block, "text"):
                sums += np.bincount(np.clip(np.rint((_steps(WORD.findall(t.lower()), w, 0.0) + 12) * 20), 0, 480).astype(int), minlength=len(grid))
        yield pa.record_batch({"cell": pa.array(np.arange(len(grid)), pa.int64()), "n": pa.array(sums, pa.int64())})

    rest = labelled.where("part = 0").select("text", "y")
    cells = rest.where("y = 0").mapInArrow(lean(spread), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    p = np.zeros(len(grid))
    p[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    if p.sum() == 0:
        p[240] = 1.0
    p /= p.sum()
    mean = float(p @ grid)
    drift = mean + max(0.5 * float(np.sqrt(p @ (grid - mean) ** 2)), 0.05)
    low, high = 1e-6, 50.0
    for _ in range(200):  # the rate solves E[exp(rate * step)] = 1
        rate = (low + high) / 2
        low, high = (rate, high) if p @ np.exp(np.clip(rate * (grid - drift), -700, 50)) < 1 else (low, rate)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = _Weights(shared.value)
        for block in blocks(batches, "text"):
            steps = [_steps(WORD.findall(t.lower()), w, drift) for t in texts_of(block, "text")]
            yield pa.record_batch({"n": pa.array([len(s) for s in steps], pa.int64()), "best": pa.array([_best(s) for s in steps], pa.float64())})

    law = rest.where("y = 0").mapInArrow(lean(features), "n long, best double").toPandas()
    scale = 1 / max(float(np.mean(np.maximum(law["n"], 1) * np.exp(-rate * law["best"]))), 1e-12) if len(law) else 1.0
    first = ToxicityModel(weights, drift, rate, scale, significance, ())
    curve = rest.mapInArrow(lean(_curve_rows(documents.sparkSession.sparkContext.broadcast(first))), "y int, x array<double>").toPandas()
    x, y = np.array(curve["x"].tolist()).reshape(-1, 4), curve["y"].to_numpy(float)
    fitted = _fit(x, y) if len(set(y.tolist())) == 2 else np.array([np.log((share + 1e-3) / (1 - share + 1e-3)), 0, 0, 0])
    return ToxicityModel(weights, drift, rate, scale, significance, tuple(float(v) for v in fitted))


def _curve_rows(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        w = _Weights(m.weights)
        for block in blocks(batches, "text"):
            found = [_evidence(_steps(WORD.findall(t.lower()), w, m.drift), m.rate, m.scale, m.significance)[0].tolist() for t in texts_of(block, "text")]
            yield pa.record_batch({"y": block.column("y"), "x": pa.array(found, pa.list_(pa.float64()))})

    return rows


def score_toxicity(documents: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score and passages (start, end in code points, end exclusive; expected) of each document.

    Whole texts are scored. A null or empty text has no passage and the score of no evidence. Repeated rows give a row
    each, null keys are kept; other columns are ignored.
    """
    bounded_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    source = documents.select(documents[key].alias("doc_id"), documents[text].alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        curve, w = np.array(m.curve), _Weights(m.weights)
        for block in blocks(batches, "text", 4 << 20):
            scores, passages = [], []
            for t in texts_of(block, "text"):
                evidence, found = _evidence(_steps(WORD.findall(t.lower()), w, m.drift), m.rate, m.scale, m.significance)
                scores.append(1 / (1 + np.exp(-np.clip(evidence @ curve, -700, 700))))
                places = []
                if found:
                    # lower-casing may change a text's length, so places are taken in the text as it is, word by word
                    spans = [x.span() for x in WORD.finditer(t)]
                    same = len(t.lower()) == len(t)
                    spans = spans if same and len(spans) == len(WORD.findall(t.lower())) else _spans_of_lowered(t)
                    places = [{"start": spans[b][0], "end": spans[e - 1][1], "expected": x} for b, e, x in found]
                passages.append(places)
            yield pa.record_batch({"doc_id": block.column("doc_id"), "score": pa.array(scores, pa.float64()), "passages": pa.array(passages, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("expected", pa.float64())])))})

    return source.mapInArrow(lean(score), f"doc_id {kind}, score double, passages array<struct<start: bigint, end: bigint, expected: double>>")


def _spans_of_lowered(text: str) -> list[tuple[int, int]]:
    """Places in the text of the words of its lower case, where that is longer than the text."""
    at = [k for k, c in enumerate(text) for _ in c.lower()]
    lowered = "".join(c.lower() for c in text)
    return [(at[m.start()], at[m.end() - 1] + 1) for m in WORD.finditer(lowered)]
