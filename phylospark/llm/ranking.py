"""Places of rows in the order of their group, however large a group is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phylospark.shared import cut

#: Tables are broadcast up to this number of rows, and joined by a shuffle beyond it.
BROADCAST_ROWS = 200_000


def group_key(column: Column) -> Column:
    """A string that is never null: ``0`` for null, else ``1`` and the value; it sorts as the values' bytes, null first."""
    return F.when(column.isNull(), "0").otherwise(F.concat(F.lit("1"), column.cast("string")))


def small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its counted size allows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the place (from 0) within its ``tree`` by ``order`` (nulls first), and ``n``, the tree's size.

    Rows are dealt by ranges of (tree, order), so a tree of any size spans as
    many tasks as it needs; a row's place is its place in its partition and the
    number of the tree's rows in earlier ones, which is one row for each tree
    and partition. Rows that agree in all of ``order`` may span partitions too.
    ``tree`` must not be null. The result is read from a written table.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    placed = tied.repartitionByRange(tree, *order, "_tie").sortWithinPartitions(tree, *order, "_tie").drop("_tie")
    placed = cut(placed.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    parts = cut(placed.groupBy(tree, "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")))
    before = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(tree, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_off"), F.sum("_n").over(Window.partitionBy(tree)).alias("n"))
    joined = placed.join(small(cut(offsets)), [tree, "_part"])
    return joined.withColumn("pos", F.col("_row") + F.col("_off")).drop("_part", "_row", "_off")
