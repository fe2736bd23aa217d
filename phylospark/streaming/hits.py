"""Hit tables as they arrive: stateless filters, and best hits kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylospark.operators.hits import filter_bitscore, filter_evalue, filter_pident
from phylospark.sources.schemas import HITS


def stream_hits(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """New hit tables of a folder."""
    reader = spark.readStream.schema(HITS).option("sep", "\t").option("mode", "FAILFAST")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.csv(folder)


def filtered(hits: DataFrame, evalue: float | None = None, bitscore: float | None = None, pident: float | None = None) -> DataFrame:
    for function, cutoff in ((filter_evalue, evalue), (filter_bitscore, bitscore), (filter_pident, pident)):
        hits = hits if cutoff is None else function(hits, cutoff)
    return hits


def running_best_hits(hits: DataFrame) -> DataFrame:
    """Best hit per query so far; state is one row per query (write in update or complete mode)."""
    rest = [c for c in hits.columns if c not in ("queryid", "evalue", "bitscore", "subjectid")]
    best = F.min(F.struct("evalue", (-F.col("bitscore")).alias("_b"), "subjectid", "bitscore", *rest)).alias("_h")
    return hits.groupBy("queryid").agg(best).select("queryid", *[f"_h.{c}" for c in hits.columns if c != "queryid"])
