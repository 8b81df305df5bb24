"""Byte-level BPE by a global shuffle of distinct words.

Documents are exploded into pre-tokens with their positions, block by block: a block lists its distinct words and, for
each document, the sequence of their numbers. The words travel to the bucket of their hash, where the lists of all blocks
meet and each distinct word of the corpus is encoded once; the ids are joined back to the blocks, which reassemble their
documents by position. No row stands for a single occurrence, so a word that is half of the corpus costs one entry a
block. The number of buckets follows the input, so that a worker holds a bucket of bounded size at a time. Decoding joins
ids with the table of token bytes, whose size is that of the vocabulary, on the map side.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded_batches, bucket_number, lean, pack, rows_of, runs, unpack

#: Bytes of text in a block; its distinct words and positions are held at once.
ENCODE_BLOCK = 16 << 20
#: Words that are reassembled at once, about; a longer document is one slice.
SLICE_WORDS = 100_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ranks from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class _Numbers(dict):
    """Numbers words in the order of their first use."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _explode(pattern: str, buckets: int):
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        find, task = regex.compile(pattern).findall, TaskContext.get().partitionId()
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for n, block in enumerate(blocks(batches, "text", ENCODE_BLOCK)):
            numbers = _Numbers()
            sequences = []
            for text in block.column("text"):
                words = find(text.as_py() or "")
                sequences.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
            lengths = np.array([len(s) for s in sequences])
            flat = np.concatenate(sequences)
            encoded = [w.encode() for w in numbers]
            del sequences, numbers
            # frequent words get small numbers, which pack into a byte or two
            order = np.argsort(-np.bincount(flat, minlength=len(encoded)), kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            flat = place[flat]
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in encoded), np.int32, len(encoded))
            dealt = np.lexsort((place, bucket))
            there, cuts = np.unique(bucket[dealt], return_index=True)
            words = []
            for b, mine in zip(there.tolist(), np.split(dealt, cuts[1:]), strict=False):
                some = [encoded[k] for k in mine.tolist()]
                words.append({"bucket": b, "places": pack(np.diff(place[mine], prepend=0)), "lengths": pack(np.array([len(w) for w in some])), "bytes": squeeze(b"".join(some))})
            # documents in slices of about SLICE_WORDS words
            ends = np.cumsum(lengths)
            last = np.flatnonzero(np.diff((ends - lengths) // SLICE_WORDS)) + 1
            heads = np.r_[0, ends[last - 1]].astype(np.int64)
            positions = [squeeze(pack(flat[a:z])) for a, z in zip(heads.tolist(), [*heads[1:].tolist(), len(flat)], strict=True)]
            yield pa.record_batch(
                {
                    "block": pa.array([task << 32 | n], pa.int64()),
                    "digest": pa.array([xxhash.xxh3_64_intdigest(b"".join([pack(lengths), *positions, *[w["bytes"] for w in words]])) >> 1], pa.int64()),
                    "n_words": pa.array([len(order)], pa.int64()),
                    "ids": pa.array([block.column("doc_id").to_pylist()], pa.list_(block.column("doc_id").type)),
                    "lengths": pa.array([pack(lengths)], pa.binary()),
                    "slices": pa.array([pack(np.diff(np.r_[0, last, len(lengths)]))], pa.binary()),
                    "positions": pa.array([positions], pa.list_(pa.binary())),
                    "words": pa.array([words], pa.list_(pa.struct([("bucket", pa.int32()), ("places", pa.binary()), ("lengths", pa.binary()), ("bytes", pa.binary())]))),
                }
            )

    return explode


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block and bucket. It takes whole rows, for the exchange below it serves both branches only if neither prunes it."""
    for batch in batches:
        words = batch.column("words")
        of = pc.list_parent_indices(words)
        parts = pc.list_flatten(words)
        yield pa.record_batch([pc.take(batch.column("block"), of), pc.take(batch.column("digest"), of), *parts.flatten()], ["block", "digest", "bucket", "places", "lengths", "bytes"])


def _encode(ranks, pattern: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a partition come sorted by bucket. All lists of a bucket are held, so that a word is encoded once for all blocks."""
        import tiktoken

        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        for rows in runs(rows_of(batches), "bucket"):
            numbers, lists = _Numbers(), []
            for row in rows:
                data, ends = zstandard.decompress(row["bytes"]), np.cumsum(unpack(row["lengths"])).tolist()
                lists.append(np.fromiter((numbers[data[a:b]] for a, b in zip([0, *ends], ends, strict=False)), np.int32, len(ends)))
            found = coder.encode_ordinary_batch([w.decode() for w in numbers], num_threads=1)
            counts = np.fromiter(map(len, found), np.int64, len(found))
            pool = np.fromiter(chain.from_iterable(found), np.int64)
            begin = np.cumsum(counts) - counts
            for row, mine in zip(rows, lists, strict=True):
                yield pa.record_batch(
                    {
                        "block": pa.array([row["block"]], pa.int64()),
                        "digest": pa.array([row["digest"]], pa.int64()),
                        "places": pa.array([row["places"]], pa.binary()),
                        "counts": pa.array([pack(counts[mine])], pa.binary()),
                        "tokens": pa.array([pack(pool[_gather(begin[mine], counts[mine])])], pa.binary()),
                    }
                )

    return encode


def _gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indexes of runs that begin at `starts` and are `counts` long."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            ids = batch.column("ids").slice(row, 1).flatten()
            lengths, positions = unpack(batch.column("lengths")[row].as_py()), batch.column("positions").slice(row, 1).flatten()
            places, counts, tokens = [], [], []
            digest = batch.column("digest")[row].as_py()
            for part in batch.column("found")[row].as_py() or ():
                if part["digest"] != digest:
                    raise RuntimeError("a block and its words are of different runs; the stage has to run again")
                places.append(np.cumsum(unpack(part["places"])))
                counts.append(unpack(part["counts"]))
                tokens.append(unpack(part["tokens"]))
            words = batch.column("n_words")[row].as_py()
            if sum(map(len, places)) != words:
                raise RuntimeError("a block misses words; the stage has to run again")
            at = np.concatenate([*places, np.empty(0, np.int64)])
            n = np.zeros(words, np.int64)
            begin = np.zeros(words, np.int64)
            found = np.concatenate([*counts, np.empty(0, np.int64)])
            n[at], begin[at] = found, np.cumsum(found) - found
            pool = np.concatenate([*tokens, np.empty(0, np.int64)]).astype("<u4")
            first = 0
            for size, packed in zip(unpack(batch.column("slices")[row].as_py()).tolist(), positions, strict=True):
                last = first + size
                some = unpack(zstandard.decompress(packed.as_py()))
                sequence = pool[_gather(begin[some], n[some])].tobytes()
                stops = np.concatenate(([0], np.cumsum(n[some])))[np.cumsum(lengths[first:last])] * 4
                yield pa.record_batch(
                    {
                        "doc_id": ids.slice(first, last - first),
                        "n_tokens": pa.array(np.diff(stops, prepend=0) // 4, pa.int64()),
                        "ids": pa.array([sequence[x:y] for x, y in zip([0, *stops], stops, strict=False)], pa.binary()),
                    }
                )
                first = last


def bpe_encode(documents: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of each document.

    A null or empty text has no ids. Repeated rows give a row each, null keys are kept, an empty table gives no rows.
    Other columns are ignored.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    buckets = buckets or bucket_number(documents)
    source = documents.select(documents[key].alias("doc_id"), documents[text].alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(ranks)
    word = "struct<bucket: int, places: binary, lengths: binary, bytes: binary>"
    # one exchange by block serves both branches, so texts are split once
    exploded = source.mapInArrow(lean(_explode(pattern, buckets)), f"block long not null, digest long, n_words long, ids array<{kind}>, lengths binary, slices binary, positions array<binary>, words array<{word}>").repartition("block")
    words = exploded.mapInArrow(lean(_spread), "block long, digest long, bucket int, places binary, lengths binary, bytes binary").repartition("bucket").sortWithinPartitions("bucket")
    encoded = words.mapInArrow(lean(_encode(shared, pattern)), "block long not null, digest long, places binary, counts binary, tokens binary")
    found = encoded.groupBy("block").agg(F.collect_list(F.struct("digest", "places", "counts", "tokens")).alias("found"))
    whole = exploded.join(found.withColumnRenamed("block", "b").hint("merge"), F.col("block") == F.col("b"), "left")
    return whole.select("digest", "n_words", "ids", "lengths", "slices", "positions", "words", "found").mapInArrow(lean(_assemble), f"doc_id {kind}, n_tokens long, ids binary")


def bpe_decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """The columns of `encoded` and `decoded`, the bytes that its ids stand for; null ids give null.

    A column named decoded is replaced. An id that the vocabulary lacks is an error.
    """
    encoded = encoded.drop(*[c for c in encoded.columns if c.lower() == "decoded"])
    bounded_batches(encoded.sparkSession)
    of_id = {rank: token for token, rank in ranks.items()}
    table = encoded.sparkSession.sparkContext.broadcast([of_id.get(k) for k in range(max(of_id, default=-1) + 1)])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(table.value, pa.binary())
        for batch in batches:
            column = batch.column(ids)
            flat = np.frombuffer(b"".join([x.as_buffer() for x in column if x.is_valid]), "<u4")
            ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy() // 4)))
            found = tokens.take(pa.array(flat, pa.uint32()))
            if found.null_count:
                raise KeyError("an id that the vocabulary lacks")
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found), b"")
            joined = pc.if_else(column.is_valid(), joined, pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns, joined], [*batch.schema.names, "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(lean(decode), f"{kinds}, decoded binary")
