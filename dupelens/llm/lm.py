"""Language-model scoring by a weighted backoff automaton.

The model is a smoothed trigram model: p(w | h) = (c(hw) + strength * p(w | h')) / (c(h) + strength), where h' is h less
its first word, down to add-one unigrams. As an automaton, the contexts that were seen are states: pairs of words, words
and the root. The arcs of a state carry log10 p(w | h) for the successors that were seen, and lead to the state of the
longest context that goes on from there; for any other word a failure arc of weight log10(strength / (c(h) + strength))
leads from a pair to its last word and from a word to the root, whose arcs carry log10 p(w). One traversal from left to
right carries the state, follows failure arcs as far as needed, and adds up the weights.

The corpus counts cover all training documents and are never gathered in one place: blocks of documents tally their own
n-grams, the tallies travel to the bucket of their hash, are added up there, and the totals go back to the blocks that
hold the n-gram. Each block then has the part of the automaton that its documents can reach. A block sends one entry for
an n-gram however often it occurs, and the number of buckets follows the input, so a bucket doesn't grow with it. Words
travel as 96-bit hashes: two of ten billion distinct words are taken for one in one corpus out of a billion, so word counts
are exact. Longer n-grams travel as hashes of 22 bits more than the bytes of the input need (64 at most), sorted, as
differences: about one in ten million of their counts is of two n-grams taken for one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import _Numbers
from .common import blocks, bounded_batches, bucket_number, estimated_bytes, lean, pack, pack_parts, rows_of, runs, unpack

#: Bytes of text in a block; its n-grams are held at once.
LM_BLOCK = 8 << 20
#: Pseudo-count that the shorter context's distribution has in each context.
STRENGTH = 100.0
#: Tokens that are scored in one go; what is longer is cut, for a state depends on no more than the two tokens before.
LANE = 512
#: Bits of an n-gram's hash beyond those that number the bytes of the input.
SPARE_BITS = 22
#: Bytes of a word's hash.
HASH_BYTES = 12
_END, _BEGIN = 0, 1


def _squeezer():
    return zstandard.ZstdCompressor(level=1).compress


def _unsqueezed(parts: list[bytes]) -> np.ndarray:
    """The packed integers of all parts."""
    expand = zstandard.ZstdDecompressor().decompress
    return unpack(b"".join(map(expand, parts)))


def _hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words as their first eight bytes and the other four."""
    raw = np.frombuffer(data, np.uint8).reshape(-1, HASH_BYTES)
    return raw[:, :8].copy().view(np.uint64).ravel(), raw[:, 8:].copy().view(np.uint32).ravel()


def words_of(text: str) -> list[bytes]:
    """The words of a text, A-Z in lower case; words are runs without space, tab, line feed, vertical tab, form feed, return."""
    return text.encode().lower().split()


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the pair (a, b) of hashes."""
    with np.errstate(over="ignore"):
        h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x7F4A7C15F39CC060))
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks: hashes of the distinct words, and each document as the sequence of their numbers."""
    from pyspark import TaskContext

    task, squeeze = TaskContext.get().partitionId(), _squeezer()
    for n, block in enumerate(blocks(batches, "text", LM_BLOCK)):
        numbers = _Numbers({b"": _END, b" ": _BEGIN})  # no word is empty or a space
        sequences, lengths = [], []
        for text in block.column("text"):
            words = words_of(text.as_py() or "")
            sequences.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
            lengths.append(len(words))
        counts = np.bincount(np.concatenate(sequences), minlength=len(numbers))
        # frequent words get small numbers, which pack into a byte or two
        order = np.r_[[_END, _BEGIN], 2 + np.argsort(-counts[2:], kind="stable")]
        renumbered = np.empty(len(order), np.int64)
        renumbered[order] = np.arange(len(order))
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, numbers)), np.uint8).reshape(-1, 16)
        hashes = digests[order, :HASH_BYTES].tobytes()
        words = squeeze(b"".join(pack(renumbered[s]) for s in sequences))
        yield pa.record_batch(
            {
                "block": pa.array([task << 32 | n], pa.int64()),
                "digest": pa.array([xxhash.xxh3_64_intdigest(hashes + words) >> 1], pa.int64()),
                "ids": pa.array([block.column("doc_id").to_pylist()], pa.list_(block.column("doc_id").type)),
                "held_out": pa.array([block.column("held_out").to_pylist()], pa.list_(pa.bool_())),
                "lengths": pa.array([pack(np.array(lengths))], pa.binary()),
                "words": pa.array([words], pa.binary()),
                "hashes": pa.array([hashes], pa.binary()),
            }
        )


class _Block:
    """A block's n-grams, in an order that both passes over it share."""

    def __init__(self, row: dict, bits: int, buckets: int):
        self.ids, self.held_out = row["ids"], np.array(row["held_out"], bool)
        lengths = unpack(row["lengths"])
        self.raw_hashes = np.frombuffer(row["hashes"], f"V{HASH_BYTES}")
        short = _hashes(row["hashes"])[0]
        words = _unsqueezed([row["words"]]).astype(np.int32)
        self.sizes = lengths + 1
        ends = np.cumsum(self.sizes) - 1
        self.tokens = np.full(len(words) + len(lengths), _END, np.int32)
        body = np.ones(len(self.tokens), bool)
        body[ends] = False
        self.tokens[body] = words
        del words, body
        self.starts = ends - self.sizes + 1
        contexts = np.empty_like(self.tokens)
        contexts[1:] = self.tokens[:-1]
        contexts[self.starts] = _BEGIN
        learned = ~np.repeat(self.held_out, self.sizes)
        size = np.int64(len(short))
        pairs, self.pair = _numbered(contexts * size + self.tokens)
        self.before, self.after = (pairs // size).astype(np.int32), (pairs % size).astype(np.int32)
        # a document's first token has no pair before it
        inner = np.flatnonzero(contexts != _BEGIN)
        del contexts
        triples, triple = _numbered(self.pair[inner - 1] * size + self.tokens[inner])
        self.triple = np.full(len(self.tokens), -1, np.int32)
        self.triple[inner] = triple
        self.history, self.last = (triples // size).astype(np.int32), (triples % size).astype(np.int32)
        unigrams = np.bincount(self.tokens[learned], minlength=len(short))
        unigrams[_BEGIN] = (~self.held_out).sum()  # a context, never a token
        self.tallies = unigrams, np.concatenate((np.bincount(self.pair[learned], minlength=len(pairs)), np.bincount(triple[learned[inner]], minlength=len(triples))))
        del pairs, triples, triple, inner
        two = _mix(short[self.before], short[self.after])
        grams = np.concatenate((two, _mix(two[self.history] + np.uint64(3), short[self.last]))) >> np.uint64(64 - bits)
        # both kinds sorted by hash, which is by bucket too
        self.order = np.argsort(short, kind="stable"), np.argsort(grams, kind="stable")
        self.grams = grams[self.order[1]]
        scale = np.uint64(buckets)
        dealt = [(x * scale >> np.uint64(32)).astype(np.int32) for x in (short[self.order[0]] >> np.uint64(32), self.grams >> np.uint64(bits - 32))]
        #: The buckets that have something, and where they begin in either order, and the ends.
        self.buckets = np.unique(np.concatenate([np.unique(x) for x in dealt]))
        self.cuts = [np.append(np.searchsorted(x, self.buckets), len(x)) for x in dealt]


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the number of each key."""
    every, at = np.unique(keys, return_inverse=True)
    return every, at.astype(np.int32)


def _slices(data: bytes, cuts: np.ndarray, width: int) -> list[bytes]:
    at = (cuts * width).tolist()
    return [data[a:z] for a, z in zip(at, at[1:], strict=False)]


def _tally(bits: int, buckets: int):
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = _squeezer()
        for row in rows_of(batches):
            block = _Block(row, bits, buckets)
            one, more = block.cuts
            counts = [c[o] for c, o in zip(block.tallies, block.order, strict=True)]
            steps = np.diff(block.grams, prepend=np.uint64(0))
            heads = more[:-1][np.diff(more) > 0]
            steps[heads] = block.grams[heads]
            begin = np.full(len(block.buckets), -1)
            place = int(np.flatnonzero(block.order[0] == _BEGIN)[0])
            at = int(np.searchsorted(one, place, "right")) - 1
            begin[at] = place - one[at]
            n = len(block.buckets)
            columns = {
                "block": pa.array([row["block"]] * n, pa.int64()),
                "digest": pa.array([row["digest"]] * n, pa.int64()),
                "bucket": pa.array(block.buckets, pa.int32()),
                "words": pa.array(_slices(block.raw_hashes[block.order[0]].tobytes(), one, HASH_BYTES), pa.binary()),
                "word_counts": pa.array([squeeze(x) for x in pack_parts(counts[0], one)], pa.binary()),
                "begin": pa.array(begin, pa.int32()),
                "low": pa.array(_slices(steps.astype(np.uint32).tobytes(), more, 4), pa.binary()),
                "high": pa.array([squeeze(x) for x in pack_parts(steps >> np.uint64(32), more)], pa.binary()),
                "counts": pa.array([squeeze(x) for x in pack_parts(counts[1], more)], pa.binary()),
            }
            del block, counts, steps
            whole = pa.record_batch(columns)
            for k in range(0, n, 500):
                yield whole.slice(k, 500)

    return tally


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of the n-grams of each bucket, for each of its blocks; the first row of a bucket has its tokens and distinct words.

    The rows of a partition come sorted by bucket, so one bucket is held at a time.
    """
    squeeze = _squeezer()
    for rows in runs((r for batch in batches for r in batch.to_pylist()), "bucket"):
        column = lambda c: [r[c] for r in rows]  # noqa: B023, E731
        high, low = _hashes(b"".join(column("words")))
        order = np.lexsort((low, high))
        new = np.r_[True, (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])] if len(order) else np.empty(0, bool)
        name = np.empty(len(order), np.int64)
        name[order] = np.cumsum(new) - 1
        ends = np.concatenate(([0], np.cumsum([len(w) // HASH_BYTES for w in column("words")])))
        total = np.bincount(name, _unsqueezed(column("word_counts")), int(new.sum())).astype(np.int64)
        token = np.ones(len(total), bool)
        token[[name[e + b] for e, b in zip(ends.tolist(), column("begin"), strict=False) if b >= 0]] = False
        stops = np.concatenate(([0], np.cumsum([len(x) // 4 for x in column("low")])))
        steps = np.frombuffer(b"".join(column("low")), np.uint32).astype(np.uint64) + (_unsqueezed(column("high")).astype(np.uint64) << np.uint64(32))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(steps, dtype=np.uint64)))
        grams = sums[1:] - np.repeat(sums[stops[:-1]], np.diff(stops))
        every, at = np.unique(grams, return_inverse=True)
        more = np.bincount(at, _unsqueezed(column("counts")), len(every)).astype(np.int64)
        if max(total.max(initial=0), more.max(initial=0)) >= 1 << 32:
            raise OverflowError("an n-gram occurs over 2**32 times")
        first = np.arange(len(rows)) == 0
        whole = pa.record_batch(
            {
                "block": pa.array(column("block"), pa.int64()),
                "digest": pa.array(column("digest"), pa.int64()),
                "bucket": pa.array(column("bucket"), pa.int32()),
                "word_totals": pa.array([squeeze(x) for x in pack_parts(total[name], ends)], pa.binary()),
                "totals": pa.array([squeeze(x) for x in pack_parts(more[at], stops)], pa.binary()),
                "tokens": pa.array(np.where(first, total[token].sum(), 0), pa.int64()),
                "distinct": pa.array(np.where(first, (total[token] > 0).sum(), 0), pa.int64()),
            }
        )
        for k in range(0, len(rows), 500):
            yield whole.slice(k, 500)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens and distinct words of a partition. It takes whole rows, so that the exchange below is the one that the blocks read."""
    tokens = distinct = 0
    for batch in batches:
        tokens += pc.sum(batch.column("tokens")).as_py() or 0
        distinct += pc.sum(batch.column("distinct")).as_py() or 0
    yield pa.record_batch({"n": pa.array([tokens], pa.int64()), "v": pa.array([distinct], pa.int64())})


class Automaton:
    """The states and arcs that a block can reach.

    State 0 is the root, state 1 + w the context of word w, state 1 + V + p that of pair p. Arcs are named by what they
    complete: a pair's arc by the triple, a word's by the pair, the root's by the word.
    """

    def __init__(self, counts: tuple[np.ndarray, np.ndarray, np.ndarray], before: np.ndarray, after: np.ndarray, history: np.ndarray, last: np.ndarray, tokens: int, distinct: int, strength: float):
        words, pairs, triples = counts
        unigram = (words + 1.0) / (tokens + distinct + 1.0)
        bigram = (pairs + strength * unigram[after]) / (words[before] + strength)
        # the pair of a triple's last two words
        self.root, self.arc = np.log10(unigram), np.log10(bigram)
        self.seen, self.seen_long = pairs > 0, triples > 0
        size = np.int64(len(words))
        place = np.searchsorted(before * size + after, after[history] * size + last)
        self.arc_long = np.log10((triples + strength * bigram[place]) / (pairs[history] + strength))
        self.first = 1 + len(words)
        #: Where failure arcs lead, and what they weigh.
        self.shorter = np.concatenate(([0], np.zeros(len(words), np.int64), 1 + after))
        self.failure = np.log10(strength / (np.concatenate(([0], words, pairs)) + strength))
        #: The state after each arc: that of the pair if it was seen, of the word if it was, or the root.
        self.by_word = np.where(words > 0, 1 + np.arange(len(words)), 0)
        self.begin = int(self.by_word[_BEGIN])

    def step(self, state: np.ndarray, token: np.ndarray, pair: np.ndarray, triple: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a token each, and the weights of the arcs that led there."""
        weight = np.zeros(len(state))
        to = 1 + len(self.by_word) + pair
        open_ = state >= self.first
        hit = open_ & self.seen_long[triple] if len(self.seen_long) else np.zeros(len(state), bool)
        weight[hit] = self.arc_long[triple[hit]]
        fails = open_ & ~hit
        weight[fails] += self.failure[state[fails]]
        state = np.where(fails, self.shorter[state], state)
        open_ = ~hit & (state > 0)
        short = open_ & self.seen[pair]
        weight[short] += self.arc[pair[short]]
        fails = open_ & ~short
        weight[fails] += self.failure[state[fails]]
        root = ~hit & ~short
        weight[root] += self.root[token[root]]
        return np.where(root, self.by_word[token], to), weight

    def traverse(self, tokens: np.ndarray, pair: np.ndarray, triple: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The weight of each token's step, documents being read from left to right.

        Documents are read side by side, in lanes of LANE tokens. A lane that goes on within a document first reads the two
        tokens before it from the root, which leads to the state that the document is in there.
        """
        parts = -(-sizes // LANE)
        document = np.repeat(np.arange(len(sizes)), parts)
        number = np.arange(len(document)) - np.repeat(np.cumsum(parts) - parts, parts)
        at = starts[document] + number * LANE
        left = np.minimum(sizes[document] - number * LANE, LANE)
        state = np.where(number == 0, self.begin, 0)
        out = np.empty(len(tokens))
        on = np.flatnonzero(number > 0)
        for back in (2, 1):
            k = at[on] - back
            state[on] = self.step(state[on], tokens[k], pair[k], triple[k])[0]
        # lanes by falling length, so those that go on are the first
        lanes = np.argsort(-left, kind="stable")
        at, left, state = at[lanes], left[lanes], state[lanes]
        going = np.searchsorted(-left, -np.arange(1, LANE + 1), "right")
        for k in range(LANE):
            n = int(going[k])
            if not n:
                break
            here = at[:n] + k
            state[:n], out[here] = self.step(state[:n], tokens[here], pair[here], triple[here])
        return out


def _score(strength: float, bits: int, buckets: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for row in rows_of([batch]):
                block = _Block(row, bits, buckets)
                parts = sorted(row["found"] or (), key=lambda p: p["bucket"])
                if [p["bucket"] for p in parts] != block.buckets.tolist() or any(p["digest"] != row["digest"] for p in parts):
                    raise RuntimeError("a block and its counts are of different runs; the stage has to run again")
                counts = []
                for order, column in zip(block.order, ("word_totals", "totals"), strict=True):
                    c = np.empty(len(order), np.int64)
                    c[order] = _unsqueezed([p[column] for p in parts])
                    counts.append(c)
                del parts
                row["found"] = None
                words, longer = counts
                n, v = int(row["sums"]["n"]), int(row["sums"]["v"])
                machine = Automaton((words, longer[: len(block.before)], longer[len(block.before) :]), block.before, block.after, block.history, block.last, n, v, strength)
                add = lambda x: np.add.reduceat(x, block.starts)  # noqa: B023, E731
                yield pa.record_batch(
                    {
                        "doc_id": pa.array(block.ids, kind),
                        "held_out": pa.array(block.held_out),
                        "n_tokens": pa.array(block.sizes, pa.int64()),
                        "n_known": pa.array(add((words[block.tokens] > 0).astype(np.int64)), pa.int64()),
                        "train_tokens": pa.array(np.full(len(block.sizes), n), pa.int64()),
                        "base_score": pa.array(add(machine.root[block.tokens]), pa.float64()),
                        "score": pa.array(add(machine.traverse(block.tokens, block.pair, block.triple, block.starts, block.sizes)), pa.float64()),
                    }
                )

    return score


def score_texts(documents: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", strength: float = STRENGTH, buckets: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document, learned from those not held out.

    A null, empty or blank text is one token, the end. Scores are log10 probabilities; base_score is that of the root
    alone. Repeated rows give a row each and count each time; null keys are kept; without any training document all
    counts are 0. An empty table gives no rows. Other columns are ignored.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    source = documents.select(documents[key].alias("doc_id"), documents[text].alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    buckets = buckets or bucket_number(documents)
    size = estimated_bytes(documents)
    bits = 64 if size is None else min(64, max(40, size.bit_length() + SPARE_BITS))
    kind = source.schema["doc_id"].dataType.simpleString()
    # one exchange by block serves both passes over the blocks, so texts are split into words once
    read = source.mapInArrow(lean(_read), f"block long not null, digest long, ids array<{kind}>, held_out array<boolean>, lengths binary, words binary, hashes binary").repartition("block")
    tallies = read.mapInArrow(lean(_tally(bits, buckets)), "block long not null, digest long, bucket int, words binary, word_counts binary, begin int, low binary, high binary, counts binary")
    totals = tallies.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(_add_up), "block long not null, digest long, bucket int, word_totals binary, totals binary, tokens long, distinct long").repartition("block")
    sums = totals.mapInArrow(lean(_sums), "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v"))
    found = totals.groupBy(F.col("block").alias("b")).agg(F.collect_list(F.struct("digest", "bucket", "word_totals", "totals", "tokens", "distinct")).alias("found"))
    whole = read.join(found.hint("merge"), F.col("block") == F.col("b"), "left").withColumn("sums", sums.select(F.struct("n", "v")).scalar())
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return whole.drop("b").mapInArrow(lean(_score(strength, bits, buckets)), schema)
