"""Removal of repeated 200-byte strings by a hash-compared suffix sort.

A byte goes if it lies in a string of `length` bytes (a window) that also starts elsewhere in the corpus. Sorting every
suffix of the corpus would move far more than the corpus, so suffixes are first confined to where a repeat can be:

1.  Every window has an anchor, the lowest-hashed `gram` of bytes in it. Successive windows with one anchor are a
    segment. Equal windows have equal anchors at equal places, so only segments of one anchor can share a window.
2.  Blocks of documents send digests of their distinct segments to the bucket of the segment's hash, and each of their
    anchors, with what its only segment is or how many it has, to the bucket of the anchor. A segment that occurs twice
    is a repeat as a whole. A segment that occurs once is undecided only if its anchor has other segments; that is where
    repeats begin and end. Within a block, equal hashes are verified by the bytes; between blocks, segments are equal
    only if independent 128-bit digests of their bytes are. A collision of hashes makes segments rivals, no repeats.
3.  Undecided segments and one copy of their rivals meet as text. Their windows are the suffixes that are sorted, those
    of one anchor and place by themselves: a merge sort whose comparisons find the common extension of two suffixes by
    binary search over prefix polynomial hashes and then look at one byte. Neighbours that extend over a whole window
    are repeats, once their bytes are verified.

No key gathers what grows: an anchor or segment sends one entry a block, however often it occurs in it. An anchor of many
segments isn't kept together in step 3: its windows are dealt out one by one by their content, after each block has merged
those it holds twice. The number of buckets follows the input, and a worker holds one bucket at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded_batches, bucket_number, lean, pack, rows_of, runs, texts_of, unpack

LENGTH = 200
#: Bytes of text in a block, and windows that are looked at together.
REPEAT_BLOCK = 6 << 20
PIECE = 1 << 19
#: Segments of one anchor beyond which its windows are dealt out by content.
MANY = 1000
#: Suffixes that are sorted together, groups being kept whole.
SORT = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_UNIQUE, _REPEAT, _OPEN, _RIVAL, _OPEN_MANY, _RIVAL_MANY = range(6)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    found = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        found.append(np.multiply.accumulate(p))
    return found[0], found[1]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << 20
    while size < n:
        size *= 2
    return _powers(size)


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """S with S[i] = sum of (byte + 1) * base**k over k < i; (S[j] - S[i]) / base**i is the polynomial hash of i..j."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _tables(len(raw) + 1)[0][: len(raw)], out=out[1:])
    return out


def _stir(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Segments:
    """start, width (windows), place (of the anchor in the first window), anchor hash and segment hash of all segments."""

    def __init__(self, raw: np.ndarray, sizes: np.ndarray, length: int):
        gram = length // 2
        ends = np.cumsum(sizes)
        starts = ends - sizes
        long = sizes >= length
        begins = np.zeros(len(raw) + 1, np.int8)
        begins[starts[long]] += 1
        stops = np.zeros(len(raw) + 2, np.int8)
        stops[ends[long] - length + 1] += 1
        inside = np.cumsum(begins[: len(raw)], dtype=np.int32) - np.cumsum(stops[: len(raw)], dtype=np.int32) > 0
        parts = [self._piece(raw[k : k + PIECE + length - 1], inside[k : k + PIECE], length, gram, k) for k in range(0, max(len(raw) - length + 1, 0), PIECE)]
        empty = [np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64)]
        self.start, self.width, self.place, self.anchor, self.segment = (np.concatenate(x) for x in zip(empty, *parts, strict=True))

    @staticmethod
    def _piece(raw, inside, length, gram, offset):
        s = prefix_hashes(raw)
        inverse = _tables(len(s))[1]
        grams = _stir((s[gram:] - s[:-gram]) * inverse[: len(s) - gram])
        low = np.uint64((1 << 20) - 1)
        least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        span, over = 1, length - gram + 1
        while span * 2 <= over:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if over > span:
            least = np.minimum(least[: span - over], least[over - span :])
        at = (least & low).astype(np.int64)
        at[~inside[: len(at)]] = -1
        # a document ends between windows of it and of the next, so no segment runs over it
        first = np.flatnonzero(np.r_[len(at) > 0, at[1:] != at[:-1]])
        last = np.r_[first[1:], len(at)] - 1
        real = at[first] >= 0
        first, last = first[real], last[real]
        anchor = at[first]
        whole = (s[last + length] - s[first]) * inverse[first]
        whole = _stir(whole ^ ((last - first).astype(np.uint64) << np.uint64(48)) ^ ((anchor - first).astype(np.uint64) << np.uint64(56)))
        return first + offset, last - first + 1, anchor - first, grams[anchor], whole


class _Block:
    """A block's text and segments, in an order that all passes over it share."""

    def __init__(self, row: dict, length: int, buckets: int):
        self.length, self.buckets = length, buckets
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.raw = np.frombuffer(zstandard.decompress(row["text"], max_output_size=int(self.sizes.sum())) if self.sizes.sum() else b"", np.uint8)
        self.found = Segments(self.raw, self.sizes, length)
        self.text = self.raw.tobytes()
        self.end = self.found.start + self.found.width + length - 1
        #: Distinct segments as the first of each, what each segment is of them, and how often it occurs.
        order = np.lexsort((self.found.segment, self.found.anchor))
        a, g = self.found.anchor[order], self.found.segment[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (g[1:] != g[:-1])] if len(order) else np.empty(0, bool)
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.first = order[new]
        self._verify()
        self.times = np.bincount(self.of, minlength=len(self.first))
        #: Distinct anchors, and the anchor of each distinct segment.
        self.anchors, self.anchor_of = np.unique(self.found.anchor[self.first], return_inverse=True)
        self.places = [self._dealt(self.anchors, 0), self._dealt(self.found.segment[self.first], buckets)]

    def _verify(self) -> None:
        """Segments of equal hashes are parted where their bytes differ."""
        start, end, text = self.found.start.tolist(), self.end.tolist(), self.text
        again = np.flatnonzero(self.first[self.of] != np.arange(len(self.of)))
        bad = {g for k, g, f in zip(again.tolist(), self.of[again].tolist(), self.first[self.of[again]].tolist(), strict=True) if text[start[k] : end[k]] != text[start[f] : end[f]]}
        for g in sorted(bad):
            names: dict[bytes, int] = {}
            for k in np.flatnonzero(self.of == g).tolist():
                self.of[k] = names.setdefault(text[start[k] : end[k]], g if not names else len(self.first) + len(names) - 1)
            members = [int(np.flatnonzero(self.of == n)[0]) for n in names.values()]
            self.first[g] = members[0]
            self.first = np.concatenate((self.first, np.array(members[1:], self.first.dtype)))

    def _dealt(self, keys: np.ndarray, offset: int) -> list[tuple[int, np.ndarray]]:
        """The buckets that have a key, and the keys of each."""
        return _by_bucket((keys % np.uint64(self.buckets)).astype(np.int64) + offset)

    def names(self) -> np.ndarray:
        """Digests of the distinct segments."""
        return np.frombuffer(b"".join([xxhash.xxh3_128_digest(self.text[s:e]) for s, e in zip(self.found.start[self.first].tolist(), self.end[self.first].tolist(), strict=True)]), np.uint64).reshape(-1, 2)

    def verdicts(self, row: dict) -> np.ndarray:
        """The verdict on each distinct segment."""
        replies = _replies(row, "judged")
        found = []
        for places, size in zip(self.places, (len(self.anchors), len(self.first)), strict=True):
            out = np.zeros(size, np.uint8)
            for b, mine in places:
                out[mine] = _of_length(np.frombuffer(replies.pop(b, b""), np.uint8), len(mine))
            found.append(out)
        rivals, times = found[0][self.anchor_of], found[1]
        once = np.choose(rivals, (_UNIQUE, _OPEN, _OPEN_MANY))
        return np.where(times == 0, once, np.where((times == 1) | (rivals == 0), _REPEAT, np.where(rivals == 1, _RIVAL, _RIVAL_MANY))).astype(np.uint8)

    def details(self, verdicts: np.ndarray) -> dict[str, np.ndarray]:
        """What is sent to be sorted: bucket, start, width, place and anchor of texts of width + length - 1 bytes.

        `segment` is the distinct segment, `window` the window of it (-1: all), `needs` whether an answer is awaited; `twice`
        lists (segment, window) that are repeats by what the block holds alone.
        """
        f = self.found
        few = np.flatnonzero((verdicts == _OPEN) | (verdicts == _RIVAL))
        at = self.first[few]
        parts = {
            "bucket": (f.anchor[at] % np.uint64(self.buckets)).astype(np.int64), "start": f.start[at], "width": f.width[at], "place": f.place[at], "anchor": f.anchor[at],
            "segment": few, "window": np.full(len(few), -1), "needs": verdicts[few] == _OPEN,
        }
        many = np.flatnonzero((verdicts == _OPEN_MANY) | (verdicts == _RIVAL_MANY))
        twice = (np.empty(0, np.int64), np.empty(0, np.int64))
        if len(many):
            at = self.first[many]
            width = f.width[at]
            which = np.repeat(np.arange(len(many)), width)
            window = np.arange(len(which)) - np.repeat(np.cumsum(width) - width, width)
            start = f.start[at][which] + window
            names: dict[bytes, list[int]] = {}
            for k, s in enumerate(start.tolist()):
                names.setdefault(self.text[s : s + self.length], []).append(k)
            shown = np.array([x[0] for x in names.values()])
            more = [k for x in names.values() if len(x) > 1 for k in x]
            twice = (many[which[more]], window[more])
            digest = np.array([xxhash.xxh64_intdigest(t) for t in names], np.uint64)
            alone = np.array([len(x) == 1 for x in names.values()])
            extra = {
                "bucket": (digest % np.uint64(self.buckets)).astype(np.int64), "start": start[shown], "width": np.ones(len(shown), np.int64), "place": f.place[at][which[shown]] - window[shown], "anchor": f.anchor[at][which[shown]],
                "segment": many[which[shown]], "window": window[shown], "needs": alone & (verdicts[many[which[shown]]] == _OPEN_MANY),
            }
            parts = {k: np.concatenate((v, extra[k])) for k, v in parts.items()}
        return parts | {"twice": twice, "places": _by_bucket(parts["bucket"])}


def _by_bucket(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The buckets in order, and where each occurs."""
    order = np.argsort(bucket, kind="stable")
    there, heads = np.unique(bucket[order], return_index=True)
    return list(zip(there.tolist(), np.split(order, heads[1:]), strict=False))


def _replies(row: dict, column: str) -> dict[int, bytes]:
    """A block's replies by bucket, all of them of this very block."""
    parts = row[column] or ()
    if any(p["digest"] != row["digest"] for p in parts):
        raise RuntimeError("a block and its replies are of different runs; the stage has to run again")
    return {p["bucket"]: p["reply"] for p in parts}


def _of_length(reply: np.ndarray, n: int) -> np.ndarray:
    if len(reply) != n:
        raise RuntimeError("a block misses replies; the stage has to run again")
    return reply


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for n, block in enumerate(blocks(batches, "text", REPEAT_BLOCK)):
        texts = [t.encode() for t in texts_of(block, "text")]
        whole = b"".join(texts)
        yield pa.record_batch(
            {
                "block": pa.array([task << 32 | n], pa.int64()),
                "digest": pa.array([xxhash.xxh3_64_intdigest(whole, seed=len(texts)) >> 1], pa.int64()),
                "ids": pa.array([block.column("doc_id").to_pylist()], pa.list_(block.column("doc_id").type)),
                "sizes": pa.array([np.array([len(t) for t in texts], np.int64).tobytes()], pa.binary()),
                "text": pa.array([squeeze(whole)], pa.binary()),
            }
        )


def _tally(length: int, buckets: int):
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            block = _Block(row, length, buckets)
            names = block.names()
            counts = np.bincount(block.anchor_of, minlength=len(block.anchors))
            only = np.zeros((len(block.anchors), 2), np.uint64)
            only[block.anchor_of] = names
            only[counts > 1] = 0
            for side, places in enumerate(block.places):
                for b, mine in places:
                    yield pa.record_batch(
                        {
                            "block": pa.array([row["block"]], pa.int64()),
                            "digest": pa.array([row["digest"]], pa.int64()),
                            "bucket": pa.array([b], pa.int64()),
                            "anchors": pa.array([b"" if side else block.anchors[mine].tobytes()], pa.binary()),
                            "names": pa.array([(names if side else only)[mine].tobytes()], pa.binary()),
                            "counts": pa.array([pack(np.minimum(block.times[mine], 2) if side else counts[mine])], pa.binary()),
                        }
                    )

    return tally


def _group(keys: np.ndarray) -> np.ndarray:
    """The number of each row's group of equal rows."""
    order = np.lexsort(keys.T)
    new = np.r_[True, (keys[order][1:] != keys[order][:-1]).any(axis=1)] if len(order) else np.empty(0, bool)
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return of


def _of_anchors(anchors: np.ndarray, names: np.ndarray, counts: np.ndarray, many: int) -> np.ndarray:
    """Whether each anchor has one segment (0), several (1) or over `many` (2). A segment of several blocks may count repeatedly where it isn't its anchor's only one."""
    of = _group(anchors[:, None])
    single = counts == 1
    pair = _group(np.column_stack((anchors, names)))
    first = np.zeros(len(pair), bool)
    first[np.unique(pair, return_index=True)[1]] = True
    total = np.bincount(of, np.where(single, first, counts))[of]
    return ((total > 1).astype(np.uint8) + (total > many)).astype(np.uint8)


def _of_segments(names: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether each segment occurs once (0), or repeatedly (1); of the latter one in all is 2."""
    of = _group(names)
    total = np.bincount(of, counts)[of]
    out = (total > 1).astype(np.uint8)
    heads = np.unique(of, return_index=True)[1]
    out[heads] *= 2
    return out


def _judge(many: int, buckets: int):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Replies to each block on its anchors and segments, from those of all blocks. The rows of a partition come sorted by bucket."""
        for rows in runs(rows_of(batches), "bucket"):
            names = np.concatenate([np.frombuffer(r["names"], np.uint64) for r in rows]).reshape(-1, 2)
            counts = np.concatenate([unpack(r["counts"]) for r in rows])
            if rows[0]["bucket"] < buckets:
                out = _of_anchors(np.concatenate([np.frombuffer(r["anchors"], np.uint64) for r in rows]), names, counts, many)
            else:
                out = _of_segments(names, counts)
            end = 0
            for r in rows:
                n = len(r["names"]) // 16
                yield pa.record_batch({"block": pa.array([r["block"]], pa.int64()), "digest": pa.array([r["digest"]], pa.int64()), "bucket": pa.array([r["bucket"]], pa.int64()), "reply": pa.array([out[end : end + n].tobytes()], pa.binary())})
                end += n

    return judge


def _send(length: int, buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            block = _Block(row, length, buckets)
            d = block.details(block.verdicts(row))
            for b, mine in d["places"]:
                yield pa.record_batch(
                    {
                        "block": pa.array([row["block"]], pa.int64()),
                        "digest": pa.array([row["digest"]], pa.int64()),
                        "bucket": pa.array([b], pa.int64()),
                        "widths": pa.array([d["width"][mine].astype(np.int32).tobytes()], pa.binary()),
                        "places": pa.array([d["place"][mine].astype(np.int32).tobytes()], pa.binary()),
                        "anchors": pa.array([d["anchor"][mine].tobytes()], pa.binary()),
                        "data": pa.array([b"".join([block.text[s : s + w + length - 1] for s, w in zip(d["start"][mine].tolist(), d["width"][mine].tolist(), strict=True)])], pa.binary()),
                    }
                )

    return send


class SuffixSort:
    """Sorts suffixes of a text, each group by itself, by their first `length` bytes."""

    def __init__(self, raw: np.ndarray, length: int):
        self.raw, self.length = raw, length
        self.sums = prefix_hashes(raw)
        self.inverse = _tables(len(self.sums))[1]

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The common extension of the suffixes, at most `length`, by binary search over prefix hashes."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.length, np.int64)
        sx, sy, ix, iy = self.sums[x], self.sums[y], self.inverse[x], self.inverse[y]
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = (self.sums[x + middle] - sx) * ix == (self.sums[y + middle] - sy) * iy
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = self.extension(x, y)
        whole = n == self.length
        step = np.where(whole, 0, n)
        return np.where(whole, or_equal, self.raw[x + step] < self.raw[y + step])

    def sort(self, suffixes: np.ndarray, group: np.ndarray) -> np.ndarray:
        """The order of the suffixes, `group` being sorted: a bottom-up merge sort of all groups at a time.

        In each round, the place of a suffix is its place in its own run and the number of those in the run beside it that
        come before it, found by binary search.
        """
        heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        begin = np.repeat(heads, np.diff(np.r_[heads, len(group)]))
        end = begin + np.repeat(np.diff(np.r_[heads, len(group)]), np.diff(np.r_[heads, len(group)]))
        order = np.arange(len(suffixes))
        run = 1
        active = np.flatnonzero(end - begin > 1)
        while len(active):
            number = (active - begin[active]) // run
            right = number % 2 == 1
            own = begin[active] + number * run
            beside = np.where(right, own - run, own + run)
            stop = np.minimum(beside + run, end[active])
            low, high = np.minimum(beside, stop), stop.copy()
            mine = suffixes[order[active]]
            open_ = np.flatnonzero(low < high)
            while len(open_):
                middle = (low[open_] + high[open_]) // 2
                theirs = suffixes[order[middle]]
                # those of the left run come first among equals
                before = self.less(theirs, mine[open_], right[open_])
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
                open_ = open_[low[open_] < high[open_]]
            rank = low - np.minimum(beside, stop)
            target = np.where(right, own - run, own) + (active - own) + rank
            moved = order[active]
            order[target] = moved
            run *= 2
            active = active[(end - begin)[active] > run]
        return order


def repeated(raw: np.ndarray, suffixes: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Whether another suffix of the group begins with the same `length` bytes; `group` is sorted."""
    out = np.zeros(len(suffixes), bool)
    if len(suffixes) < 2:
        return out
    sorter = SuffixSort(raw, length)
    order = sorter.sort(suffixes, group)
    x, y = suffixes[order[:-1]], suffixes[order[1:]]
    beside = np.flatnonzero((group[:-1] == group[1:]))
    equal = beside[sorter.extension(x[beside], y[beside]) == length]
    windows = np.lib.stride_tricks.sliding_window_view(raw, length)
    real = np.concatenate([(windows[x[equal[k : k + 20_000]]] == windows[y[equal[k : k + 20_000]]]).all(axis=1) for k in range(0, len(equal), 20_000)] or [np.empty(0, bool)])
    out[order[equal[real]]] = True
    out[order[equal[real] + 1]] = True
    for g in np.unique(group[equal[~real]]).tolist():  # a collision of hashes: the group is done by its bytes
        members = np.flatnonzero(group == g)
        texts = [windows[s].tobytes() for s in suffixes[members].tolist()]
        seen: dict[bytes, int] = {}
        for t in texts:
            seen[t] = seen.get(t, 0) + 1
        out[members] = [seen[t] > 1 for t in texts]
    return out


def _resolve(length: int):
    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(rows_of(batches), "bucket"):
            widths = np.concatenate([np.frombuffer(r["widths"], np.int32) for r in rows]).astype(np.int64)
            places = np.concatenate([np.frombuffer(r["places"], np.int32) for r in rows]).astype(np.int64)
            anchors = np.concatenate([np.frombuffer(r["anchors"], np.uint64) for r in rows])
            texts = b"".join([r["data"] for r in rows])
            begins = np.cumsum(widths + length - 1) - (widths + length - 1)
            of = np.repeat(np.arange(len(widths)), widths)
            window = np.arange(len(of)) - np.repeat(np.cumsum(widths) - widths, widths)
            out = np.zeros(len(of), bool)
            # windows of one anchor and one place of it; anchors in turns, to bound what is held
            turn = np.argsort(anchors[of], kind="stable")
            sorted_anchors = anchors[of][turn]
            heads = np.flatnonzero(np.r_[True, sorted_anchors[1:] != sorted_anchors[:-1]])
            bounds = np.r_[heads, len(turn)]
            k = 0
            while k < len(heads):
                last = max(k + 1, int(np.searchsorted(bounds, bounds[k] + SORT, "right")) - 1)
                some = turn[bounds[k] : bounds[last]]
                k = last
                held, inverse = np.unique(of[some], return_inverse=True)
                sizes = widths[held] + length - 1
                raw = np.frombuffer(b"".join([texts[b : b + n] for b, n in zip(begins[held].tolist(), sizes.tolist(), strict=True)]), np.uint8)
                starts = (np.cumsum(sizes) - sizes)[inverse] + window[some]
                order = np.lexsort((places[of[some]] - window[some], anchors[of[some]]))
                a, p = anchors[of[some]][order], (places[of[some]] - window[some])[order]
                group = np.cumsum(np.r_[False, (a[1:] != a[:-1]) | (p[1:] != p[:-1])])
                out[some[order]] = repeated(raw, starts[order], group, length)
            end = 0
            for r in rows:
                n = int(np.frombuffer(r["widths"], np.int32).sum())
                yield pa.record_batch({"block": pa.array([r["block"]], pa.int64()), "digest": pa.array([r["digest"]], pa.int64()), "bucket": pa.array([r["bucket"]], pa.int64()), "reply": pa.array([np.packbits(out[end : end + n]).tobytes()], pa.binary())})
                end += n

    return resolve


def _remove(length: int, buckets: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for row in rows_of([batch]):
                block = _Block(row, length, buckets)
                verdicts = block.verdicts(row)
                d = block.details(verdicts)
                marks = np.zeros(int(d["width"].sum()), bool)
                ends = np.r_[0, np.cumsum(d["width"])]
                replies = _replies(row, "resolved")
                for b, mine in d["places"]:
                    n = d["width"][mine]
                    reply = _of_length(np.frombuffer(replies.pop(b, b""), np.uint8), -(-int(n.sum()) // 8))
                    at = np.repeat(ends[mine] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    marks[at] = np.unpackbits(reply, count=len(at))
                # coverage as the sum of steps up and down
                steps = np.zeros(len(block.raw) + 1, np.int32)
                f = block.found
                whole = np.isin(verdicts, (_REPEAT, _RIVAL, _RIVAL_MANY))[block.of]
                np.add.at(steps, f.start[whole], 1)
                np.add.at(steps, f.start[whole] + f.width[whole] + length - 1, -1)
                entry = np.repeat(np.arange(len(d["width"])), d["width"])
                hit = np.flatnonzero(marks & d["needs"][entry])
                start = d["start"][entry[hit]] + hit - ends[entry[hit]]
                start = np.r_[start, f.start[block.first[d["twice"][0]]] + d["twice"][1]].astype(np.int64)
                np.add.at(steps, start, 1)
                np.add.at(steps, start + length, -1)
                gone = np.cumsum(steps[:-1]) > 0
                sizes = block.sizes
                stops = np.cumsum(sizes)
                heads = stops - sizes
                begin = gone.copy()
                begin[1:] &= ~gone[:-1]
                inner = heads[(sizes > 0)]
                begin[inner] = gone[inner]
                total, runs = (np.r_[0, np.cumsum(x, dtype=np.int64)] for x in (gone, begin))
                raw, keep = block.raw, ~gone
                kept = [raw[a:z][keep[a:z]].tobytes() for a, z in zip(heads.tolist(), stops.tolist(), strict=True)]
                for k in range(0, len(sizes), 500):
                    part = slice(k, k + 500)
                    yield pa.record_batch(
                        {
                            "doc_id": pa.array(row["ids"][part], kind),
                            "n_bytes": pa.array(sizes[part], pa.int64()),
                            "n_removed": pa.array((total[stops] - total[heads])[part], pa.int64()),
                            "n_spans": pa.array((runs[stops] - runs[heads])[part], pa.int64()),
                            "kept": pa.array(kept[part], pa.binary()),
                        }
                    )

    return remove


def remove_repeats(documents: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", buckets: int | None = None, many: int = MANY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the bytes that are left) of each document.

    Null and empty texts have no bytes; texts shorter than `length` keep all. Rows that repeat are repeats of each other,
    and null keys are kept. Characters may be cut, for bytes are what is compared. An empty table gives no rows. Other
    columns are ignored.
    """
    if not 16 <= length <= 255:
        raise ValueError("length must be from 16 to 255")
    spark = documents.sparkSession
    bounded_batches(spark)
    buckets = buckets or bucket_number(documents)
    source = documents.select(documents[key].alias("doc_id"), documents[text].alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    reply = "block long not null, digest long, bucket long, reply binary"
    gathered = lambda df, of, name: df.groupBy(F.col("block").alias(of)).agg(F.collect_list(F.struct("digest", "bucket", "reply")).alias(name))
    # one exchange by block serves all passes over the blocks
    read = source.mapInArrow(lean(_read), f"block long not null, digest long, ids array<{kind}>, sizes binary, text binary").repartition("block")
    tallies = read.mapInArrow(lean(_tally(length, buckets)), "block long not null, digest long, bucket long, anchors binary, names binary, counts binary")
    judged = gathered(tallies.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(_judge(many, buckets)), reply), "b", "judged")
    known = read.join(judged.hint("merge"), F.col("block") == F.col("b"), "left")
    sent = known.mapInArrow(lean(_send(length, buckets)), "block long not null, digest long, bucket long, widths binary, places binary, anchors binary, data binary")
    resolved = gathered(sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(_resolve(length)), reply), "c", "resolved")
    whole = known.join(resolved.hint("merge"), F.col("block") == F.col("c"), "left")
    return whole.mapInArrow(lean(_remove(length, buckets)), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
