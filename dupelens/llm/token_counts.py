"""Token counts without a shuffle: a map-side lookup in two tiers.

Tier one is a broadcast hash table of the lengths of frequent pre-tokens: those that occur most in a bounded sample of
documents, and those that are whole entries of the vocabulary; it has `TABLE_ENTRIES` of each at most. Tier two encodes what
the table misses, once for each worker, in a cache that is kept from task to task and emptied when it reaches
`CACHE_ENTRIES`. No pre-token of a counted document is shuffled, and neither tier changes a count.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded_batches, lean, texts_of

#: Entries of the table from either source; a larger vocabulary is refused.
TABLE_ENTRIES = 300_000
CACHE_ENTRIES = 300_000
#: Distinct documents whose pre-tokens are counted for the table, about.
SAMPLE_DOCUMENTS = 5_000


def _alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def whole_entries(vocabulary_json: str, pattern: str) -> dict[str, int]:
    """Lengths (1) of the vocabulary's entries that are whole pre-tokens."""
    data = json.loads(vocabulary_json)
    if len(data["model"]["vocab"]) > TABLE_ENTRIES:
        raise ValueError("the vocabulary is larger than the table that is broadcast")
    byte_of, find = _alphabet(), regex.compile(pattern)
    found = {}
    for entry in data["model"]["vocab"]:
        if all(c in byte_of for c in entry):
            try:
                text = bytes(byte_of[c] for c in entry).decode()
            except UnicodeDecodeError:
                continue
            if text and (m := find.match(text)) and m.end() == len(text):
                found[text] = 1
    return found


def frequent_pre_tokens(documents: DataFrame, pattern: str, key: str, text: str, sample: int = SAMPLE_DOCUMENTS) -> list[str]:
    """The pre-tokens that occur most in about `sample` of the documents, and at least twice, by falling count."""
    share = min(1.0, sample / max(documents.count(), 1))
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    chosen = rows.where(F.pmod(F.xxhash64("k", "text"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("text").distinct()

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        for block in blocks(batches, "text"):
            counts = Counter()
            for t in texts_of(block, "text"):
                counts.update(find(t))
            yield pa.record_batch({"word": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})

    counted = chosen.mapInArrow(lean(tally), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    return [r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(TABLE_ENTRIES).collect()]


#: The counter that a worker keeps from task to task, by what it is made of.
_kept: dict[str, TwoTier] = {}


def kept_counter(name: str, parts: tuple) -> TwoTier:
    if name not in _kept:
        _kept.clear()
        _kept[name] = TwoTier(*parts)
    return _kept[name]


class TwoTier:
    """Counts tokens of texts in a worker."""

    def __init__(self, vocabulary_json: str, pattern: str, table: dict[str, int], cache_entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_str(vocabulary_json)
        self.encoder.no_padding()
        self.encoder.no_truncation()
        self.find = regex.compile(pattern).findall
        self.special = [t["content"] for t in json.loads(vocabulary_json)["added_tokens"]]
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.table, self.cache, self.cache_entries = table, {}, cache_entries

    def counts(self, texts: list[str]) -> list[int]:
        pieces, extra = [], []
        for text in texts:
            parts = self.split.split(text) if self.split and any(s in text for s in self.special) else (text,)
            extra.append(len(parts) - 1)  # each special string is one token, as the library takes it by default
            pieces.append([w for p in parts for w in self.find(p)] if len(parts) > 1 else self.find(parts[0]))
        table, cache = self.table, self.cache
        missed = list({w for words in pieces for w in words if w not in table and w not in cache})
        if len(cache) + len(missed) > self.cache_entries:
            cache.clear()
            missed = list({w for words in pieces for w in words if w not in table})
        for k in range(0, len(missed), 20_000):
            some = missed[k : k + 20_000]
            cache.update(zip(some, map(len, self.encoder.encode_batch_fast(some, add_special_tokens=False)), strict=True))
        known = table.get
        return [n + sum([known(w) or cache[w] for w in words]) for n, words in zip(extra, pieces, strict=True)]

    def lengths(self, words: list[str]) -> dict[str, int]:
        return dict(zip(words, map(len, self.encoder.encode_batch_fast(words, add_special_tokens=False)), strict=True)) if words else {}


def token_counts(documents: DataFrame, vocabulary_path: str, pattern: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each document.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows give a row each, null keys are kept, an empty table
    gives no rows. Other columns are ignored.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = f.read()
    table = whole_entries(vocabulary, pattern)
    frequent = frequent_pre_tokens(documents, pattern, key, text)
    table |= TwoTier(vocabulary, pattern, table).lengths([w for w in frequent if w not in table])
    name = hashlib.sha256(json.dumps([vocabulary, pattern, frequent]).encode()).hexdigest()
    shared = spark.sparkContext.broadcast((vocabulary, pattern, table))
    source = documents.select(documents[key].alias("doc_id"), documents[text].alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept_counter(name, shared.value)
        for block in blocks(batches, "text", 4 << 20):
            texts = texts_of(block, "text")
            n = counter.counts(texts)
            yield pa.record_batch(
                {
                    "doc_id": block.column("doc_id"),
                    "n_bytes": pc.fill_null(pc.binary_length(block.column("text")), 0).cast(pa.int64()),
                    "n_tokens": pa.array(n, pa.int64()),
                    "over_limit": pa.array([x > limit for x in n], pa.bool_()),
                }
            )

    return source.mapInArrow(lean(count), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
