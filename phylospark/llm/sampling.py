"""Bounded samples for the driver, and rows kept apart from the columns that operators add."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def least_hashes(rows: DataFrame, key: str, n: int, of: int) -> DataFrame:
    """About ``n`` rows, at most 2n, of least hash of column ``key``; ``of`` is the number of rows, or somewhat more.

    Rows above a hash threshold fall away in their own task, so what reaches the
    driver is bounded by n whatever the number of partitions.
    """
    share = min(1.0, 1.25 * n / max(1, of))
    limit = int(share * 2**62)
    drawn = F.shiftrightunsigned(F.xxhash64(key, F.lit("sample")), 2)
    return (rows if share == 1.0 else rows.where(drawn < limit)).limit(2 * n)


def packed(docs: DataFrame, **added) -> DataFrame:
    """``docs`` as one column ``row``, beside the ``added`` columns; so no name of its own can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[value.alias(name) for name, value in added.items()])
