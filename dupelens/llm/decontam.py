"""Benchmark decontamination: size-partitioned MinHash containment search, with DataFrame functions only.

A test item counts as found in a document if the document has at least `threshold` of the item's distinct word shingles.
Items are partitioned by the logarithm of their number of shingles. The bottom sketch of an item is the `r` shingles of
the lowest hashes, where r is one more than the shingles that may be missing; a document that contains enough of the item
must hold one of them, so no contained item is lost however long the document is. Each partition has a highest hash and a
least number of shingles: a hash of a document is looked up in a partition only below the one, and only if the document
is long enough for its items. A table of slots tells by a hash which partitions may have it in a sketch, and documents
without a hit are done.

What is left is verified where it stands: the shingles that may be an item's are joined, as text, with the items, and
counted. Texts are not moved.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import use_shared_folder

#: Shingles of all items, and bytes of item texts, up to which the items' side is broadcast; beyond them joins are shuffled.
BROADCAST_ENTRIES = 500_000
BROADCAST_BYTES = 16 << 20
#: Contaminated rows up to which their hashes are broadcast to take them out.
BROADCAST_ROWS = 1_000_000
#: Slots for each shingle of the items, and the most slots: the table is part of the plan. A shingle has two slots, so few
#: documents without an item pass.
SLOTS, MOST_SLOTS = 16, 1 << 19


def words_of(text: Column) -> Column:
    """Lower-case words, runs of letters and digits; a null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _windows(words: Column, n: int, each) -> Column:
    """An array of each(window) for the windows of n words, or the whole sequence where it is shorter.

    The words are bound once as a lambda's variable; inside the inner lambda their expression would run for each window.
    """
    one = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: each(F.slice(w, i, n)))
    return F.flatten(F.transform(F.filter(F.array(words), lambda w: F.size(w) > 0), one))


def shingle_hashes(words: Column, n: int) -> Column:
    """A hash of each shingle."""
    return _windows(words, n, F.xxhash64)


def shingles(words: Column, n: int) -> Column:
    """The distinct shingles as text, space-joined."""
    return F.array_distinct(_windows(words, n, lambda w: F.array_join(w, " ")))


def row_hash(key: str, text: str) -> Column:
    """Tells documents apart whose keys repeat or are null."""
    return F.xxhash64(F.col(key), F.col(text))


def clean(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `documents` in which no item is found."""
    name = "_row_hash"
    while any(c.lower() == name for c in documents.columns):
        name += "_"
    use_shared_folder(documents.sparkSession)
    found = contaminated(documents, benchmark, key, text, **options).select(F.col("row").alias(f"{name}found")).distinct().checkpoint()
    side = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found.hint("merge")
    return documents.withColumn(name, row_hash(key, text)).join(side, F.col(name) == F.col(f"{name}found"), "left_anti").drop(name)


def item_shingles(benchmark: DataFrame, item: str, item_text: str, words: int, threshold: float) -> DataFrame:
    """A row for each shingle of an item: item (a hash of id and text), item_id, n (shingles of the item), need (how many make it found), partition, h, s, and low, whether it is in the bottom sketch."""
    every = _windows(words_of(F.col("t")), words, lambda w: F.struct(F.xxhash64(w).alias("h"), F.array_join(w, " ").alias("s")))
    items = benchmark.select(F.col(item).alias("item_id"), F.col(item_text).alias("t")).distinct()
    items = items.select("item_id", F.xxhash64("item_id", "t").alias("item"), F.array_distinct(every).alias("own")).where(F.size("own") > 0)
    items = items.withColumn("n", F.size("own")).withColumn("need", F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)).cast("int"))
    # with n shingles of which `need` must be present, any n - need + 1 of them include one that is
    highest = F.element_at(F.slice(F.array_sort(F.array_distinct("own.h")), F.lit(1), F.col("n") - F.col("need") + 1), -1)
    items = items.select("item", "item_id", "n", "need", F.floor(F.log2(F.col("n").cast("double"))).cast("int").alias("partition"), highest.alias("highest"), F.explode("own").alias("x"))
    return items.select("item", "item_id", "n", "need", "partition", "x.h", "x.s", (F.col("x.h") <= F.col("highest")).alias("low"))


def _slots(h: Column, slots: int) -> tuple[Column, Column]:
    return F.pmod(h, F.lit(slots)).cast("int"), F.pmod(F.shiftright(h, 32), F.lit(slots)).cast("int")


def _tables(items: DataFrame, slots: int) -> tuple[bytes, list]:
    """A byte for each slot, and partition, highest sketched hash and least `need` of each partition.

    The byte is 0 if no shingle is in the slot and 1 if none of a sketch is, p + 2 if one of partition p is, and 255 if
    several partitions have one. Both are of bounded size.
    """
    code = F.when(F.count_distinct(F.when(F.col("low"), F.col("partition"))) > 1, 255).otherwise(F.coalesce(F.max(F.when(F.col("low"), F.col("partition"))) + 2, F.lit(1)))
    marks = items.select("low", "partition", F.explode(F.array(*_slots(F.col("h"), slots))).alias("slot")).groupBy("slot").agg(code.cast("int").alias("code"))
    filled = items.sparkSession.range(slots).join(F.broadcast(marks), F.col("id") == F.col("slot"), "left").select("id", F.lpad(F.hex(F.coalesce("code", F.lit(0))), 2, "0").alias("code"))
    listed = filled.agg(F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "code"))), lambda x: x["code"]), "")).alias("b")).first()["b"]
    parts = items.groupBy("partition").agg(F.max(F.when(F.col("low"), F.col("h"))).alias("high"), F.min("need").alias("need")).collect()
    return bytes(listed), parts


def contaminated(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", words: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found, containment of each document and item found in it, and row, the document's row_hash().

    Null and empty texts are found in nothing and hold nothing. An item or document of fewer words than a shingle is one
    shingle, its whole sequence. Items that repeat id and text count once; documents that repeat give their rows
    repeatedly. Null ids are kept. Either table may be empty; other columns are ignored.
    """
    use_shared_folder(documents.sparkSession)
    items = item_shingles(benchmark, item, item_text, words, threshold).checkpoint()
    total = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("s")), F.lit(0)).alias("b")).first()
    small = total["n"] <= BROADCAST_ENTRIES and total["b"] <= BROADCAST_BYTES * words
    rows = documents.select(F.col(key).alias("doc_id"), row_hash(key, text).alias("row"), words_of(F.col(text)).alias("w"))
    own = lambda w: F.struct(F.xxhash64(w).alias("h"), F.array_join(w, " ").alias("s"))
    if small:
        slots = 1 << min(MOST_SLOTS.bit_length() - 1, max(10, (SLOTS * total["n"]).bit_length()))
        listed, parts = _tables(items, slots)
        byte = lambda n: F.lit(bytearray([n]))
        reach = lambda size: [(byte(p["partition"] + 2), F.lit(p["high"]), size >= p["need"]) for p in parts]

        def looked_up(use) -> Column:
            """use(marks), where marks(h) are the bytes of a hash's two slots. The table stands in the plan once."""
            return F.transform(F.array(F.lit(bytearray(listed))), lambda table: use(lambda h: [F.substring(table, slot + 1, F.lit(1)) for slot in _slots(h, slots)]))[0]

        def beyond(marks, h: Column, n: int, then: Column) -> Column:
            """`then` where both bytes are above n, looked up one after the other."""
            one, two = marks(h)
            return F.when(one > byte(n), F.when(two > byte(n), then).otherwise(F.lit(False))).otherwise(F.lit(False))

        def sketched(marks, hashes: Column) -> Column:
            """Whether a hash is one of a sketch in a partition that the document is long enough for."""
            within = lambda h, m: reduce(or_, [((m == code) | (m == byte(255))) & (h <= high) & long for code, high, long in reach(F.size(hashes))], F.lit(False))
            return F.exists(hashes, lambda h: beyond(marks, h, 1, reduce(and_, [within(h, m) for m in marks(h)])))

        found = looked_up(lambda marks: F.transform(F.array(shingle_hashes(F.col("w"), words)), lambda hashes: sketched(marks, hashes))[0])
        rows = rows.where(found)
        mine = looked_up(lambda marks: F.filter(_windows(F.col("w"), words, lambda w: F.when(beyond(marks, F.xxhash64(w), 0, F.lit(True)), own(w))), lambda x: x.isNotNull()))
    else:
        # hashes alone find the documents that hold a sketched one; only these are moved
        low = items.where("low").select(F.col("h").alias("lh")).distinct()
        highest = low.agg(F.coalesce(F.max("lh"), F.lit(-(1 << 63)))).first()[0]
        probes = rows.select("row", F.explode(F.filter(shingle_hashes(F.col("w"), words), lambda h: h <= F.lit(highest))).alias("ph"))
        near = probes.join(low.hint("merge"), F.col("ph") == F.col("lh"), "left_semi").select(F.col("row").alias("r")).distinct()
        rows = rows.join(near, F.col("row") == F.col("r"), "left_semi")
        mine = _windows(F.col("w"), words, own)
    side = F.broadcast(items) if small else items.hint("merge")
    shown = rows.select("doc_id", "row", F.explode(F.array_distinct(mine)).alias("x")).select("doc_id", "row", F.col("x.h").alias("dh"), F.col("x.s").alias("ds"))
    hits = shown.join(side, (F.col("dh") == F.col("h")) & (F.col("ds") == F.col("s")))
    # rows that repeat come as often as they occur: so many times does each shingle of theirs
    counted = hits.groupBy("row", "doc_id", "item", "item_id", "n", "need", "s").agg(F.count("*").alias("copies"), F.max("low").alias("low"))
    counted = counted.groupBy("row", "doc_id", "item", "item_id", "n", "need").agg(F.count("*").cast("int").alias("n_found"), F.max("copies").cast("int").alias("copies"), F.max("low").alias("low"))
    found = counted.where("low and n_found >= need").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return found.select("doc_id", "item_id", F.col("n").alias("n_shingles"), "n_found", (F.col("n_found") / F.col("n")).alias("containment"), "row")
