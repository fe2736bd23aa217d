"""Set algebra on bitmaps, for folds and regions over thousands of lists.

Elements get numbers, and every list is a bitmap over stretches of 32,768
numbers: 4 kB for each stretch in which it has an element, however many. Folds
run over the lists of a stretch, so no element carries an array of list names.
The groupings of ``sets`` give the same and are faster while elements are in few lists.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phylospark.operators.sets import MOST_LISTS
from phylospark.shared import cut

#: Numbers of a bitmap; fixed by Spark's bitmap functions.
STRETCH = 32_768
#: Bytes of each list's bitmap that are turned at once when combinations are read off.
SLICE = 256


def numbered(items: DataFrame) -> DataFrame:
    """``value, n``: a number from 1 for every different value, null too; each task numbers its own, so there are gaps."""
    return cut(items.select("value").distinct().withColumn("n", F.monotonically_increasing_id() + 1))


def ranked_lists(lists: DataFrame, *order: str) -> DataFrame:
    """``list_id, p``: places of the lists from 0, at most ``MOST_LISTS``."""
    some = lists.where("list_id is not null").groupBy("list_id").agg(F.min(F.struct(*order)).alias("_first"))
    if some.limit(MOST_LISTS + 1).count() > MOST_LISTS:
        raise ValueError(f"bitmaps take at most {MOST_LISTS} lists")
    return some.select("list_id", (F.row_number().over(Window.orderBy("_first")) - 1).alias("p"))


def list_bitmaps(items: DataFrame, numbers: DataFrame, ranks: DataFrame) -> DataFrame:
    """``stretch, p, bits``: the elements of each list as bitmaps. Repeats set a bit again; lists that ``ranks`` lacks are left out."""
    held = items.select("list_id", "value").distinct().join(F.broadcast(ranks), "list_id")
    placed = held.join(numbers.withColumnRenamed("value", "_v"), F.col("value").eqNullSafe(F.col("_v")))
    return placed.groupBy(F.bitmap_bucket_number("n").alias("stretch"), "p").agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits"))


def elements(folded: DataFrame, numbers: DataFrame) -> DataFrame:
    """``value`` of every bit that is set in ``stretch, bits``; stretches occur once."""

    def read(batches):
        for b in batches:
            for stretch, bits in zip(b["stretch"], b["bits"]):
                at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
                yield pd.DataFrame({"n": (int(stretch) - 1) * STRETCH + 1 + at})

    return folded.select("stretch", "bits").mapInPandas(read, "n long").join(numbers, "n").select("value")


def any_of(items: DataFrame, lists: DataFrame) -> DataFrame:
    """Elements of at least one of ``lists``."""
    numbers = numbered(items)
    made = list_bitmaps(items, numbers, ranked_lists(lists, "list_id"))
    return elements(made.groupBy("stretch").agg(F.bitmap_or_agg("bits").alias("bits")), numbers)


def all_of(items: DataFrame, lists: DataFrame) -> DataFrame:
    """Elements of every one of ``lists``; an empty list leaves none."""
    return _fold(items, lists, ["list_id"], _in_all)


def some_of(items: DataFrame, lists: DataFrame) -> DataFrame:
    """Elements of at least one of ``lists``, but not of all."""
    return _fold(items, lists, ["list_id"], lambda p, rows, total: np.bitwise_or.reduce(rows) & ~_in_all(p, rows, total))


def diff_of(items: DataFrame, lists: DataFrame) -> DataFrame:
    """The first list (by ``pos``, then id) without (the second without (the third ...))."""
    return _fold(items, lists, ["pos", "list_id"], _in_difference)


def _in_all(p: np.ndarray, rows: np.ndarray, total: int) -> np.ndarray:
    return np.bitwise_and.reduce(rows) if len(p) == total else np.zeros_like(rows[0])


def _in_difference(p: np.ndarray, rows: np.ndarray, total: int) -> np.ndarray:
    """From the last list on; a list without a bit in the stretch empties what comes after it."""
    kept, before = np.zeros_like(rows[0]), total
    for at, row in zip(p[::-1], rows[::-1]):
        kept = row & ~kept if at == before - 1 else row
        before = at
    return kept if before == 0 else np.zeros_like(kept)


def _fold(items: DataFrame, lists: DataFrame, order: list[str], fold) -> DataFrame:
    """Elements in ``fold`` of the bitmaps of each stretch: at most ``MOST_LISTS`` of 4 kB at once."""
    numbers, ranks = numbered(items), ranked_lists(lists, *order)
    total = ranks.count()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p, rows = _matrix(pdf)
        return pd.DataFrame({"stretch": [int(pdf["stretch"].iloc[0])], "bits": [fold(p, rows, total).tobytes()]})

    return elements(list_bitmaps(items, numbers, ranks).groupBy("stretch").applyInPandas(one, "stretch long, bits binary"), numbers)


def _matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places of the lists of a stretch, ascending, and their bitmaps as rows."""
    pdf = pdf.sort_values("p")
    return pdf["p"].to_numpy(), np.frombuffer(b"".join(pdf["bits"]), np.uint8).reshape(len(pdf), -1)


def set_regions(items: DataFrame) -> DataFrame:
    """``lists, n``: how many elements are in exactly this combination of lists (their names in order, joined by commas).

    A combination is one bit a list until the counts are summed; names are
    written once for each combination. Rows without a list are left out.
    """
    named = items.select(F.col("list_id").cast("string").alias("list_id"), "value").where("list_id is not null")
    ranks = cut(ranked_lists(named, "list_id"))
    names = [r["list_id"] for r in ranks.orderBy("p").collect()]  # at most MOST_LISTS
    width = max(1, -(-len(names) // 8))

    def combinations(pdf: pd.DataFrame) -> pd.DataFrame:
        p, rows = _matrix(pdf)
        found: dict[bytes, int] = {}
        for at in range(0, rows.shape[1], SLICE):
            part = np.unpackbits(rows[:, at : at + SLICE], axis=1, bitorder="little")
            used = np.flatnonzero(part.any(axis=0))
            whole = np.zeros((len(used), width * 8), np.uint8)
            whole[:, p] = part[:, used].T
            for key in np.packbits(whole, axis=1, bitorder="little"):
                found[key.tobytes()] = found.get(key.tobytes(), 0) + 1
        return pd.DataFrame({"key": list(found), "n": list(found.values())}).astype({"n": "int64"})

    @F.pandas_udf("string")
    def spelt(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: ",".join(names[i] for i in np.flatnonzero(np.unpackbits(np.frombuffer(k, np.uint8), bitorder="little"))))

    made = list_bitmaps(named, numbered(named), ranks).groupBy("stretch").applyInPandas(combinations, "key binary, n long")
    return made.groupBy("key").agg(F.sum("n").alias("n")).select(spelt("key").alias("lists"), "n")
