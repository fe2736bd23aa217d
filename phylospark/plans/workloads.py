"""The three main workloads, from tables to answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospark.operators import groups, hits, sets, sweeps
from phylospark.shared import cut


def shared_genes(forward: DataFrame, backward: DataFrame, evalue: float) -> DataFrame:
    """W1: queries that have a reciprocal best hit in every list (``value``)."""
    found = hits.reciprocal_best(hits.filter_evalue(forward, evalue), hits.filter_evalue(backward, evalue))
    names = hits.extract_queries(found).withColumnRenamed("queryid", "value")
    return sets.all_of(names, forward.select("list_id").distinct())


def reciprocal_genes(forward: DataFrame, backward: DataFrame, evalue: float) -> DataFrame:
    """W1 before lists are combined: ``value, lists``, in how many lists a query has a reciprocal best hit."""
    found = hits.reciprocal_best(hits.filter_evalue(forward, evalue), hits.filter_evalue(backward, evalue))
    return hits.extract_queries(found).groupBy(F.col("queryid").alias("value")).agg(F.count(F.lit(1)).alias("lists"))


def spanning_families(rb_hits: DataFrame, more_hits: DataFrame, proteomes: DataFrame, least: float) -> DataFrame:
    """W2: families built from hits, kept if they span enough proteomes."""
    families = cut(groups.greencut2_families(rb_hits, more_hits).select(F.col("family").alias("group_id"), "member"))
    return groups.ortholog_in_min(least, families, proteomes)


def cutoff_stability(forward: DataFrame, cutoffs: list[float]) -> DataFrame:
    """W3: hits and distinct queries at each cutoff, from one scan."""
    return sweeps.sweep_both(forward, "evalue", cutoffs)
