"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is mapped to the bit counts of its 32 two-bit segments. The Manhattan distance of two such vectors is never
above the Hamming distance of the fingerprints, so links lie within it. The segments are dealt to groups, and grids are
made of so many groups that two vectors within the radius are within distance 2 in one grid: for radius 4, each two of
three groups, of 21 or 22 segments. The cells of a grid are its bit-count vectors. A fingerprint lives in its own cell
(home) and reaches those one count up and one count down; two vectors at distance 0 share their home, at distance 1 the
home of one is one up from the other, and at distance 2 they meet one up from both or one up from one and one down from
the other. Pairs that meet are held against the Manhattan bound over coarser segments and then verified exactly. Of N
independent fingerprints, about N * N / 700,000 pairs meet.

Only distinct fingerprints take part, as the nodes of the graph of links, and a worker puts out the links that join two
sets it had not joined yet, so thousands of copies do not become all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded_batches, lean, use_shared_folder
from .components import connected_components

SEED = 42
#: Candidate pairs that a worker verifies at once.
PAIRS = 1 << 20
#: Nodes of the sets that a worker remembers.
REMEMBERED = 2_000_000


def fingerprint(shingle_hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    if not len(shingle_hashes):
        return 0
    bits = np.unpackbits(shingle_hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    set_in = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_in * 2 > len(shingle_hashes), bitorder="little").view("<u8")[0])


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of the whole sequence where it is shorter."""
    tokens = text.encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    w = min(words, len(tokens))
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    pieces = [joined[a:b] for a, b in zip(starts[: len(tokens) - w + 1].tolist(), ends[w - 1 :].tolist(), strict=True)]
    return np.fromiter(map(digest, pieces), np.uint64, len(pieces))


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """doc_id, digest of the text, and fp, the 64 bits as a signed long. A null, empty or blank text has fingerprint 0."""
    bounded_batches(documents.sparkSession)
    source = documents.select(documents[key].cast("long").alias("doc_id"), digest_of(documents[text]).alias("digest"), documents[text].alias("text"))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            found = np.array([fingerprint(shingle_hashes(t.as_py() or "", words)) for t in block.column("text")], np.uint64)
            yield pa.record_batch({"doc_id": block.column("doc_id"), "digest": block.column("digest"), "fp": pa.array(found.view(np.int64), pa.int64())})

    return source.mapInArrow(lean(prints), "doc_id long, digest string, fp long")


def digest_of(text: Column) -> Column:
    """Tells texts apart; a null text is none of them."""
    return F.coalesce(F.md5(text.cast("binary")), F.lit(""))


def _counts(prints: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 segments, two bits each, in one word."""
    return prints - ((prints >> np.uint64(1)) & np.uint64(0x5555555555555555))


def _grids(radius: int) -> list[list[int]]:
    """The segments of each grid, such that two vectors within the radius are within distance 2 in one of them."""
    if radius <= 2:
        return [list(range(32))]
    if radius <= 4:  # of three distances that add up to 4 at most, two add up to 2 at most
        return [[s for s in range(32) if s % 3 != g] for g in range(3)]
    n = radius // 3 + 1
    return [list(range(g, 32, n)) for g in range(n)]


#: What a row is in its cell: at home, one count up in segment kind - 1, or one count down. The rows of a cell come in this order.
_HOME, _DOWN = 0, 64


def _place(radius: int):
    """The cells of each fingerprint in each grid, named by a hash."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 10_000):
                part = batch.slice(first, 10_000)
                counts = _counts(part.column("fp").to_numpy().view(np.uint64))
                for g, segments in enumerate(_grids(radius)):
                    home = counts & np.uint64(sum(3 << 2 * s for s in segments))
                    cells, kinds, who = [home], [np.zeros(len(home), np.int8)], [np.arange(len(home))]
                    for s in segments:
                        one, here = np.uint64(1) << np.uint64(2 * s), (home >> np.uint64(2 * s)) & np.uint64(3)
                        for can, kind in ((np.flatnonzero(here < 2), 1 + s), (np.flatnonzero(here > 0), _DOWN)):
                            cells.append(home[can] - one if kind == _DOWN else home[can] + one)
                            kinds.append(np.full(len(can), kind, np.int8))
                            who.append(can)
                    names = (np.concatenate(cells) + np.uint64(g + 1)) * np.uint64(0x9E3779B97F4A7C15)
                    names = (names ^ (names >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                    yield pa.record_batch({"cell": pa.array(names.view(np.int64), pa.int64()), "kind": pa.array(np.concatenate(kinds), pa.int8()), "fp": part.column("fp").take(pa.array(np.concatenate(who)))})

    return place


class _Forest:
    """Sets of nodes; join() tells whether two were apart."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        if len(self.parent) > REMEMBERED:
            self.parent.clear()
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def _verify(fp: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int, forest: _Forest) -> list[tuple[int, int]]:
    x, y = fp[left], fp[right]
    bound = np.zeros(len(x), np.int16)
    for k in range(4):
        mask = np.uint64(0xFFFF << 16 * k)
        bound += np.abs(np.bitwise_count(x & mask).astype(np.int16) - np.bitwise_count(y & mask).astype(np.int16))
    near = np.flatnonzero(bound <= radius)
    near = near[np.bitwise_count(x[near] ^ y[near]) <= radius]
    x, y = x[near].view(np.int64), y[near].view(np.int64)
    return [(a, b) for a, b in zip(x.tolist(), y.tolist(), strict=True) if a != b and forest.join(a, b)]


def _meet(radius: int):
    """Links among the fingerprints of each cell; the rows of a partition come sorted by cell and kind."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()

        def links(cell, kind, fp) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            ends = np.r_[starts[1:], len(cell)]
            group = np.repeat(np.arange(len(starts)), ends - starts)
            own = np.arange(len(cell))
            # a home meets the homes after it and all that reach up; one up in a segment meets those up in later segments and
            # those one down. Two that are up in one segment are equal there, so they share their home.
            runs = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1])])
            after = np.repeat(np.r_[runs[1:], len(cell)], np.diff(np.r_[runs, len(cell)]))
            begin = np.where(kind == _HOME, own + 1, after)
            up_to = starts + np.add.reduceat((kind < _DOWN).astype(np.int64), starts)
            stop_at = np.where(kind == _HOME, up_to[group], ends[group])
            count = np.where(kind == _DOWN, 0, np.maximum(stop_at - begin, 0))
            edges, row = [], 0
            total = np.cumsum(count)
            while row < len(cell):
                stop = max(row + 1, int(np.searchsorted(total, (total[row - 1] if row else 0) + PAIRS, "right")))
                for part in range(0, max(int(count[row]), 1) if stop == row + 1 else 1, PAIRS):  # a row of more pairs than that goes in parts
                    n = np.minimum(count[row:stop], PAIRS) if stop > row + 1 else np.array([min(PAIRS, int(count[row]) - part)])
                    left = np.repeat(own[row:stop], n)
                    if len(left):
                        ends = np.cumsum(n)
                        right = np.repeat(begin[row:stop] + part - (ends - n), n) + np.arange(len(left))
                        edges += _verify(fp, left, right, radius, forest)
                row = stop
            if edges:
                a, b = zip(*edges, strict=True)
                yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        held = None
        for batch in batches:
            new = [batch.column("cell").to_numpy(), batch.column("kind").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)]
            rows = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            if not len(rows[0]):
                continue
            last = int(np.searchsorted(rows[0] == rows[0][-1], True))  # the last cell may go on in the next batch
            held = [x[last:] for x in rows]
            if last:
                yield from links(*(x[:last] for x in rows))
        if held is not None and len(held[0]):
            yield from links(*held)

    return meet


def near_links(prints: DataFrame, radius: int = 4) -> DataFrame:
    """a, b: links between the distinct fingerprints (column fp) that connect all within the radius."""
    bounded_batches(prints.sparkSession, 50_000)
    placed = prints.select("fp").mapInArrow(lean(_place(radius)), "cell long, kind byte, fp long")
    return placed.repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(lean(_meet(radius)), "a long, b long")


def _components(prints: DataFrame, radius: int) -> DataFrame:
    """f, root, least of each fingerprint: its component, named by a fingerprint, and the component's least document.

    Fingerprints are the nodes, so documents that share an id are neither linked nor parted by that. `least` is
    (no_id, doc_id, digest) of the document of the least id, ids before nulls, and of the least digest among equal ids.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")).alias("least")
    classes = prints.groupBy("fp").agg(first).checkpoint()
    roots = connected_components(near_links(classes, radius))
    return classes.join(roots, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("f"), F.coalesce("root", "fp").alias("root"), "least")


def simhash_components(documents: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id reachable by links) of each document.

    Null, empty and blank texts share fingerprint 0 and link like any other. Documents of equal text are one class;
    repeated rows give a row each. A document without a doc_id links like any other; it names its component only if
    that has no id at all, and then component_id is null. Documents that share a doc_id are linked by their fingerprints
    only, so their components may have that id in common. An empty table gives no rows. Other columns are ignored.
    """
    use_shared_folder(documents.sparkSession)
    prints = fingerprints(documents, key, text, words).checkpoint()
    placed = _components(prints, radius)
    names = placed.groupBy(F.col("root").alias("r")).agg(F.min("least.doc_id").alias("component_id"))
    named = placed.join(names, F.col("root") == F.col("r")).select("f", "component_id")
    return prints.join(named, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def _row_name(key: Column, digest: Column, *names: str) -> tuple[Column, Column]:
    """Key and digest as two columns without nulls, which joins and aggregates can share an exchange on."""
    return F.coalesce(key, F.lit(0)).alias(names[0]), F.concat(F.when(key.isNull(), "-").otherwise("+"), digest).alias(names[1])


def one_of_each(documents: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """The rows of `documents` less near-duplicates: of each component, one row stays.

    It is the row of the least key; rows with a key are preferred, and of rows that share the key the text of the least
    digest. Of rows equal in key and text one stays, that of the least hash of the row. A row goes only if a row of its
    own component stays, whatever keys they have. Null, empty and blank texts are one component. An empty table gives no
    rows.

    Components and their winners are found on keys and digests. Texts are moved once, to the winners; rows that are equal
    in key and text are merged before they are moved.
    """
    use_shared_folder(documents.sparkSession)
    prints = fingerprints(documents, key, text, words).checkpoint()
    winners = _components(prints, radius).groupBy("root").agg(F.min("least").alias("w")).select(*_row_name(F.col("w.doc_id"), F.col("w.digest"), "k", "d"))
    hashable = [F.col(f"`{f.name}`") for f in documents.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    rows = documents.select(*_row_name(F.col(f"`{key}`").cast("long"), digest_of(F.col(f"`{text}`")), "k0", "d0"), F.xxhash64(*hashable).alias("h0"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    rows = rows.groupBy("k0", "d0").agg(F.min_by("row", "h0").alias("row"))
    return rows.join(winners, (F.col("k0") == F.col("k")) & (F.col("d0") == F.col("d")), "left_semi").select("row.*")
