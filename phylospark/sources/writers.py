"""Writers for the text forms of tables; Parquet is the default elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_fasta(seqs: DataFrame, path: str, width: int = 60) -> None:
    wrapped = F.regexp_replace("seq", rf"(.{{{width}}})(?=.)", "$1\n")
    seqs.select(F.concat(F.lit(">"), "header", F.lit("\n"), wrapped)).write.text(path)


def write_hits(hits: DataFrame, path: str) -> None:
    hits.drop("list_id").write.csv(path, sep="\t", header=False, quote="")


def write_list(items: DataFrame, path: str) -> None:
    items.select(F.col("value").cast("string")).write.text(path)


def write_table(table: DataFrame, path: str) -> None:
    """Tab-separated values, each file with a header; as many files as the table has partitions, in its order."""
    table.write.csv(path, sep="\t", header=True)
