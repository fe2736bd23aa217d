"""Exact deduplication with counting quotient filters.

A counting quotient filter keeps a fingerprint as a quotient (which run it is
in) and a remainder (a slot of that run); a slot has a counter, so a thousand
copies of a text take one slot. Every partition builds its own filters, one for
each block of quotients. Two filters of one block merge without loss, because
the runs are sorted: equal remainders of equal quotients add their counters.
Only fingerprints counted more than once go on to the comparison of bytes.

A block that is thin in a partition lists its quotients instead of marking them
in a bitmap, and counters of one take no room, so a filter costs 8 to 13 bytes
for each fingerprint, however many blocks there are. Where there are many, a
partition's filters are of few coarse blocks, which salted groups merge and
split into fine ones; so no merge gets more than about ``BLOCK_SLOTS`` rows.

Cost: one scan for fingerprints, an exchange of compact filters, and one more
scan that passes on only texts whose fingerprint repeats.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospark.llm.sampling import packed
from phylospark.shared import cut

#: Deleted before comparison: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
#: Quotient blocks are sized for about this many fingerprints.
BLOCK_SLOTS = 1 << 20
#: A partition's own filters are of at most so many bits' worth of blocks.
COARSE_BITS = 8
#: Repeated fingerprints are broadcast up to this number (8 bytes each), and joined by a shuffle beyond it.
BROADCAST_KEYS = 1_000_000


def build_filter(values: np.ndarray, counts: np.ndarray, block_bits: int, quotient_bits: int) -> list[tuple[int, bytes, bytes, bytes, bytes]]:
    """One filter for each block of quotients that occurs; ``values`` are sorted fingerprints.

    Returns (block, occupied, run_ends, remainders, counters). ``occupied`` has
    a bit for each quotient of the block that has a run or, where that is
    shorter, lists these quotients; its first byte tells which. ``run_ends`` has
    a bit for each slot that ends a run; the slots are sorted by quotient and
    remainder. ``counters`` is empty if all are one.
    """
    low_bits = 64 - block_bits - quotient_bits
    blocks = values >> np.uint64(64 - block_bits) if block_bits else np.zeros(len(values), np.uint64)
    quotients = (values >> np.uint64(low_bits)) & np.uint64((1 << quotient_bits) - 1)
    remainders = values & np.uint64((1 << low_bits) - 1)
    out = []
    bounds = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]) if len(values) else np.array([], int)
    for lo, hi in zip(bounds, np.r_[bounds[1:], len(values)] if len(values) else []):
        q = quotients[lo:hi]
        ends = np.r_[q[1:] != q[:-1], True]
        runs = q[ends]
        if 32 * len(runs) < 1 << quotient_bits:
            occupied = b"\x00" + runs.astype("<u4").tobytes()
        else:
            marks = np.zeros(1 << quotient_bits, bool)
            marks[runs.astype(np.int64)] = True
            occupied = b"\x01" + np.packbits(marks).tobytes()
        counters = b"" if (counts[lo:hi] == 1).all() else counts[lo:hi].astype("<i8").tobytes()
        out.append((int(blocks[lo]), occupied, np.packbits(ends).tobytes(), remainders[lo:hi].tobytes(), counters))
    return out


def read_filter(occupied: bytes, run_ends: bytes, remainders: bytes, counters: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quotients, remainders and counters of a filter's slots, in order."""
    slots = np.frombuffer(remainders, np.uint64)
    ends = np.unpackbits(np.frombuffer(run_ends, np.uint8), count=len(slots))
    run = np.cumsum(ends) - ends
    marked = np.flatnonzero(np.unpackbits(np.frombuffer(occupied, np.uint8, offset=1))) if occupied[0] else np.frombuffer(occupied, "<u4", offset=1)
    return marked[run].astype(np.uint64), slots, np.frombuffer(counters, "<i8") if counters else np.ones(len(slots), np.int64)


def merge_filters(filters: list[tuple[bytes, bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All slots of one block's filters; equal ones become one with the sum of their counters."""
    parts = [read_filter(*f) for f in filters]
    q, r, c = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((r, q))
    q, r, c = q[order], r[order], c[order]
    first = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (r[1:] != r[:-1])])
    return q[first], r[first], np.add.reduceat(c, first)


FILTER = "block long, occupied binary, run_ends binary, remainders binary, counters binary"


def repeated_fingerprints(fingerprints: DataFrame, rows: int, block_slots: int = BLOCK_SLOTS) -> DataFrame:
    """``fp, n`` of the fingerprints (column ``fp``, long) counted more than once among ``rows`` rows."""
    fine = max(6, int(np.ceil(np.log2(max(1, rows / block_slots)))))
    coarse = min(fine, COARSE_BITS)
    quotient_bits = int(min(20, max(3, np.ceil(np.log2(max(8, rows / (1 << fine)))) - 3)))

    def frame(made: list[tuple]):
        for at in range(0, len(made), 256):
            yield pd.DataFrame(made[at : at + 256], columns=["block", "occupied", "run_ends", "remainders", "counters"])

    def build(batches):
        parts = [b["fp"].to_numpy(np.int64).view(np.uint64) for b in batches]
        if parts:
            yield from frame(build_filter(*np.unique(np.concatenate(parts), return_counts=True), coarse, quotient_bits))

    def merged(pdf: pd.DataFrame, block_bits: int) -> tuple[np.ndarray, np.ndarray]:
        q, r, c = merge_filters(list(pdf[["occupied", "run_ends", "remainders", "counters"]].itertuples(index=False, name=None)))
        block = np.uint64(pdf["block"].iloc[0]) << np.uint64(64 - block_bits)
        return block | (q << np.uint64(64 - block_bits - quotient_bits)) | r, c

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(frame(build_filter(*merged(pdf, coarse), fine, quotient_bits)))

    def repeated(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, c = merged(pdf, fine)
        return pd.DataFrame({"fp": fp[c > 1].view(np.int64), "n": c[c > 1]})

    filters = fingerprints.select("fp").mapInPandas(build, FILTER)
    if fine > coarse:
        salt = F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(1 << (fine - coarse)))
        filters = filters.withColumn("salt", salt).groupBy("block", "salt").applyInPandas(split, FILTER)
    return filters.groupBy("block").applyInPandas(repeated, "fp long, n long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of texts that are equal without white space, one row per input row.

    Null texts count as empty. Of a class the row with the most code points in
    its original text stays, then the least id (of any type that has an order; a
    null id last); of rows that
    repeat an id with the same text exactly one stays. Returns ``doc_id, keep_id,
    group_size, kept, text_sha256, fp``. Other columns of the input, clashing
    names included, play no part. An empty input gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bare = docs.select(F.col(id_col).alias("doc_id"), F.char_length(text).alias("chars"), F.translate(text, SPACES, "").alias("bare"))
    marked = bare.withColumns({"fp": F.xxhash64("bare"), "text_sha256": F.sha2("bare", 256)})
    thin = cut(marked.select("doc_id", "chars", "fp", "text_sha256").withColumn("row_id", F.monotonically_increasing_id()))
    many = cut(repeated_fingerprints(thin, thin.count()))
    keys = many.select("fp")
    if many.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)

    # The bytes of every candidate are compared by grouping on them; copies combine before the exchange.
    texts = marked.join(keys, "fp", "left_semi").groupBy("fp", "text_sha256", "bare").agg(F.count(F.lit(1)).alias("n"))
    checked = texts.groupBy("fp", "text_sha256").agg(F.sum("n").alias("verified"), F.count(F.lit(1)).alias("forms"))
    best = F.struct((-F.col("chars")).alias("a"), F.col("doc_id").isNull().alias("b"), "doc_id", "row_id")
    classes = thin.join(keys, "fp", "left_semi").groupBy("fp", "text_sha256").agg(F.min(best).alias("top"), F.count(F.lit(1)).alias("group_size"))
    classes = classes.join(checked, ["fp", "text_sha256"]).select(
        "fp", "text_sha256", F.col("top.doc_id").alias("keep_id"), F.col("top.row_id").alias("keep_row"),
        F.when((F.col("forms") == 1) & (F.col("verified") == F.col("group_size")), F.col("group_size")).otherwise(F.raise_error(F.lit("equal SHA-256 digests of different bytes"))).cast("long").alias("group_size"),
    )
    # Written first, so that both sides of the last join are plain exchanges, whose hot keys Spark can split.
    classes = cut(classes)
    alone = F.col("group_size").isNull()
    return thin.join(classes, ["fp", "text_sha256"], "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row_id") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
        "fp",
    )


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops; columns as they came."""
    made = cut(exact_dedup(docs, id_col, text_col))
    mark = F.xxhash64(F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), SPACES, ""))
    # Rows are told apart by id and text. Where such a pair repeats, one row of it stays if any does.
    pairs = made.groupBy("doc_id", "fp").agg(F.max("kept").alias("any"), F.count(F.lit(1)).alias("n"))
    drop = cut(pairs.where("not any").select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp")))
    again = cut(pairs.where("any and n > 1").select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp")))
    marked = packed(docs, key=F.col(id_col), mark=mark)
    on = [F.col("key").eqNullSafe(F.col("_id")), F.col("mark") == F.col("_fp")]
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_KEYS else df
    kept = marked.join(small(drop), on, "left_anti")
    if again.count():
        twice = kept.join(small(again), on, "left_semi").dropDuplicates(["key", "mark"])
        kept = kept.join(small(again), on, "left_anti").unionByName(twice)
    return kept.select("row.*")
