"""Filters, best hits and reciprocal best hits of similarity-hit tables.

Every function works on one list or on many: ``by`` names the columns that
tell lists apart, by default ``list_id`` where the table has it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phylospark.shared import require

ORDER = ("evalue", "bitscore", "subjectid")


def keys(df: DataFrame, by: list[str] | None) -> list[str]:
    return (["list_id"] if "list_id" in df.columns else []) if by is None else list(by)


def _checked(hits: DataFrame, column: str, condition) -> DataFrame:
    """Rows that meet ``condition`` (pushed to the scan, which keeps nulls too); a null is an error, not a missing row.

    The check is a filter, so it holds whatever columns are read afterwards.
    """
    return require(hits.where(condition | F.col(column).isNull()), F.col(column).isNotNull(), F.lit(f"{column} is null"))


def filter_evalue(hits: DataFrame, cutoff: float) -> DataFrame:
    return _checked(hits, "evalue", F.col("evalue") <= cutoff)


def filter_bitscore(hits: DataFrame, cutoff: float) -> DataFrame:
    return _checked(hits, "bitscore", F.col("bitscore") >= cutoff)


def filter_pident(hits: DataFrame, cutoff: float) -> DataFrame:
    return _checked(hits, "pident", F.col("pident") >= cutoff)


def extract_queries(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    return hits.select(*keys(hits, by), "queryid").distinct()


def extract_targets(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    return hits.select(*keys(hits, by), "subjectid").distinct()


def best_hits(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per query: least e-value, then greatest bit score, then least subject, then the other columns.

    An aggregate rather than a window: every task reduces its rows to one per
    query before the exchange, so a query with very many hits costs one row a task.
    """
    at = [*keys(hits, by), "queryid"]
    rest = [c for c in hits.columns if c not in at and c not in ORDER]
    best = F.min(F.struct("evalue", (-F.col("bitscore")).alias("_b"), "subjectid", "bitscore", *rest)).alias("_h")
    return hits.groupBy(*at).agg(best).select(*[F.col(c) if c in at else F.col(f"_h.{c}") for c in hits.columns])


def best_hits_by_window(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The same rows through a window; ``bench.py`` compares the two."""
    at = [*keys(hits, by), "queryid"]
    rest = [c for c in hits.columns if c not in at and c not in ORDER]
    order = Window.partitionBy(*at).orderBy("evalue", F.desc("bitscore"), "subjectid", *rest)
    return hits.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def unique_hits(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Hits of queries that have exactly one."""
    at = [*keys(hits, by), "queryid"]
    rest = [c for c in hits.columns if c not in at]
    one = hits.groupBy(*at).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*rest)).alias("_h")).where("_n = 1")
    return one.select(*[F.col(c) if c in at else F.col(f"_h.{c}") for c in hits.columns])


def best_hsps(hits: DataFrame, except_self: bool = False, by: list[str] | None = None) -> DataFrame:
    """All rows of a query that share its greatest bit score."""
    some = hits.where("queryid <> subjectid") if except_self else hits
    at = [*keys(hits, by), "queryid"]
    top = some.groupBy(*at).agg(F.max("bitscore").alias("_top"))
    return some.join(top, at).where(F.col("bitscore") == F.col("_top")).select(*hits.columns)


def reciprocal_best(left: DataFrame, right: DataFrame, mode: str = "best", by: list[str] | None = None) -> DataFrame:
    """Best hits of ``left`` whose pair is, turned around, among those of ``right``.

    ``mode='best'`` means each is the other's best hit; ``mode='unique'`` takes
    queries with exactly one hit instead. Both sides have one row per query
    before they meet.
    """
    one = {"best": best_hits, "unique": unique_hits}[mode]
    at = keys(left, by)
    turned = one(right, by).select(*at, F.col("subjectid").alias("queryid"), F.col("queryid").alias("subjectid"))
    return one(left, by).join(turned, [*at, "queryid", "subjectid"], "left_semi").select(*left.columns)


def reciprocal_best_each(lefts: DataFrame, rights: DataFrame, mode: str = "best") -> DataFrame:
    """Reciprocal best hits of each pair of lists; both must have the same lists."""
    a, b = lefts.select("list_id").distinct(), rights.select("list_id").distinct()
    uneven = a.join(b.withColumn("_b", F.lit(1)), "list_id", "full").where("_b is null").limit(1).count() + b.join(a, "list_id", "left_anti").limit(1).count()
    if uneven:
        raise ValueError("both sides must have the same lists")
    return reciprocal_best(lefts, rights, mode, ["list_id"])


def reciprocal_best_all(lefts: DataFrame, rights: DataFrame, mode: str = "best") -> DataFrame:
    """As ``reciprocal_best_each``, in one table without list ids."""
    return reciprocal_best_each(lefts, rights, mode).drop("list_id")


def conditional_reciprocal_best(forward: DataFrame, backward: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Reciprocal best hits, and best hits that beat the e-value these reach at their length.

    For each alignment length c among the reciprocal pairs, -log10(e) is averaged
    over lengths within max(5, c // 10); the running maximum over c is the cutoff.
    An e-value of zero counts as 200. Returns the hits with ``reciprocal``.
    """
    at = keys(forward, by)
    best = best_hits(forward, by)
    back = best_hits(backward.select(*at, "queryid", *ORDER), by).select(*at, F.col("subjectid").alias("queryid"), F.col("queryid").alias("subjectid"))
    # Pairs alone are exchanged to meet; hits have one row per query and stay where they are.
    mutual = best.select(*at, "queryid", "subjectid").join(back, [*at, "queryid", "subjectid"], "left_semi").select(*at, "queryid", F.lit(True).alias("reciprocal"))
    marked = best.join(mutual, [*at, "queryid"], "left").withColumn("reciprocal", F.coalesce("reciprocal", F.lit(False)))
    marked = marked.withColumn("_v", F.when(F.col("evalue") == 0, F.lit(200.0)).otherwise(F.round(-F.log10("evalue"), 9)))
    # One row per length from here on: at most some ten thousand.
    sums = marked.where("reciprocal").groupBy(*at, "alignmentlength").agg(F.sum("_v").alias("s"), F.count(F.lit(1)).alias("n"))
    reach = F.greatest(F.lit(5), F.floor(F.col("alignmentlength") / 10).cast("int"))
    near = sums.select(*at, F.col("alignmentlength").alias("c"), F.explode(F.sequence(F.col("alignmentlength") - reach, F.col("alignmentlength") + reach)).alias("alignmentlength"))
    means = near.join(sums, [*at, "alignmentlength"]).groupBy(*at, "c").agg(F.round(F.sum("s") / F.sum("n"), 6).alias("mean"))
    order = Window.partitionBy(*at).orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    fit = means.select(*at, F.col("c").alias("alignmentlength"), F.max("mean").over(order).alias("_cut"))
    joined = marked.join(fit, [*at, "alignmentlength"], "left")
    return joined.where(F.col("reciprocal") | (F.col("_v") >= F.col("_cut"))).select(*forward.columns, "reciprocal")
