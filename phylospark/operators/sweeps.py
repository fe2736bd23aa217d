"""Reruns over other inputs: replaced values, cutoffs, repeats, and their scores."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phylospark.operators.sets import all_of


#: Cutoffs that are searched in compiled code.
MOST_BRANCHES = 64


def replace_each(function: Callable, values: DataFrame | list) -> DataFrame:
    """``function`` for each alternative value, in one plan.

    With a table of values (``pos, variant``) the function gets them as rows and
    returns rows that still have ``pos, variant``, so a thousand values are one
    job. With a list of values it is called for each, for functions that can't
    take the value as a column, and ``pos, variant`` are added to what it returns.
    """
    if isinstance(values, DataFrame):
        return function(values)
    if not values:
        raise ValueError("no values to replace with")
    made = [function(v).withColumns({"pos": F.lit(i).cast("long"), "variant": F.lit(v)}) for i, v in enumerate(values)]
    return reduce(DataFrame.unionByName, made)


def replace(function: Callable[[DataFrame], DataFrame], values: DataFrame, variant) -> DataFrame:
    return function(values.where(F.col("variant") == variant))


def tightest(value: Column, cutoffs: list[float], at_most: bool = True) -> tuple[Column, list[float]]:
    """The number of the tightest cutoff that a value passes (that of cutoffs if none; null for null), and the cutoffs, tightest first.

    Up to ``MOST_BRANCHES`` cutoffs are a binary search in compiled code. More of
    them are looked up in two steps, among every 32nd of the sorted cutoffs and
    then between two of these, as one expression of thousands can't be compiled.
    """
    order = sorted(set(map(float, cutoffs)), reverse=not at_most)
    fails = (lambda c: value > c) if at_most else (lambda c: value < c)

    def searched(lo: int, hi: int) -> Column:
        if hi == lo:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(fails(order[mid]), searched(mid + 1, hi)).otherwise(searched(lo, mid))

    if len(order) <= MOST_BRANCHES:
        return F.when(value.isNotNull(), searched(0, len(order))), order
    width = 32
    coarse = F.size(F.filter(F.lit(order[width - 1 :: width]) if len(order) >= width else F.array().cast("array<double>"), fails))
    fine = F.size(F.filter(F.slice(F.lit(order), coarse * width + 1, F.lit(width)), fails))
    return F.when(value.isNotNull(), coarse * width + fine), order


def _added_up(grid: DataFrame, counts: DataFrame, names: list[str]) -> DataFrame:
    """Running sums over ``i`` of one row per cutoff."""
    upto = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(counts, "i", "left").select("cutoff", *[F.sum(F.coalesce(n, F.lit(0))).over(upto).alias(n) for n in names])


def sweep_cutoff(hits: DataFrame, column: str, cutoffs: list[float], metric: str = "hits", at_most: bool = True) -> DataFrame:
    """``cutoff, n``: hits, or distinct queries, that pass each cutoff, in one pass.

    A row goes to the tightest cutoff it passes, counts per cutoff are added up
    from the tightest on. For queries the best value of each query is taken
    first. Rows are never multiplied.
    """
    if metric not in ("hits", "queries"):
        raise ValueError("metric is 'hits' or 'queries'")
    rows = hits.groupBy("queryid").agg((F.min if at_most else F.max)(column).alias(column)) if metric == "queries" else hits
    at, order = tightest(F.col(column), cutoffs, at_most)
    counts = rows.where(F.col(column).isNotNull()).groupBy(at.alias("i")).agg(F.count(F.lit(1)).alias("n"))
    return _added_up(hits.sparkSession.createDataFrame(list(enumerate(order)), "i int, cutoff double"), counts, ["n"])


def sweep_both(hits: DataFrame, column: str, cutoffs: list[float], at_most: bool = True) -> DataFrame:
    """``cutoff, hits, queries``: both of ``sweep_cutoff`` from one scan.

    Rows are grouped by cutoff and by query at once (grouping sets), so a task
    sends one row per cutoff and one per query: hits are counted where they are,
    a query at its tightest cutoff.
    """
    at, order = tightest(F.col(column), cutoffs, at_most)
    rows = hits.select("queryid", at.alias("i")).where("i is not null").withColumn("own", F.col("i"))
    both = rows.groupingSets([["queryid"], ["i"]], "queryid", "i").agg(F.count(F.lit(1)).alias("n"), F.min("own").alias("first"))
    # Of the two groupings the one by query has no ``i``.
    counts = both.groupBy(F.col("first").alias("i")).agg(F.sum(F.when(F.col("i").isNotNull(), F.col("n"))).alias("hits"), F.count(F.when(F.col("i").isNull(), 1)).alias("queries"))
    return _added_up(hits.sparkSession.createDataFrame(list(enumerate(order)), "i int, cutoff double"), counts, ["hits", "queries"])


def sweep_grid(hits: DataFrame, columns: tuple[str, str], cutoffs: tuple[list[float], list[float]], at_most: tuple[bool, bool] = (True, False)) -> DataFrame:
    """Two cutoffs at once: ``first_cutoff, second_cutoff, hits, queries`` for every pair of them, in one pass.

    A row is one point of the grid, and hits are sums of points over both axes.
    The cutoff pairs that a query passes are a staircase: one corner for each of
    its best points, less one where two neighbouring steps overlap, so queries
    are sums over both axes too. Neither axis multiplies rows.
    """
    a, firsts = tightest(F.col(columns[0]), cutoffs[0], at_most[0])
    b, seconds = tightest(F.col(columns[1]), cutoffs[1], at_most[1])
    points = hits.select("queryid", a.alias("i"), b.alias("j")).where((F.col("i") < len(firsts)) & (F.col("j") < len(seconds)))
    cells = points.groupBy("queryid", "i").agg(F.min("j").alias("j"))
    # At most one point for each first cutoff: those that a better one does not cover are the corners.
    steps = cells.groupBy("queryid").agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("p"))
    corner = "aggregate(p, cast(array() as array<struct<i:int,j:int>>), (s, x) -> if(size(s) = 0 or x.j < try_element_at(s, -1).j, array_append(s, x), s))"
    both = steps.select(F.expr(corner).alias("s")).select(F.explode(F.concat(F.expr("transform(s, x -> struct(x.i as i, x.j as j, 1L as q))"), F.expr("transform(slice(s, 2, size(s)), (x, k) -> struct(x.i as i, s[k].j as j, -1L as q))"))).alias("c"))
    queries = both.groupBy("c.i", "c.j").agg(F.sum("c.q").alias("queries"))
    counts = points.groupBy("i", "j").agg(F.count(F.lit(1)).alias("hits"))
    grid = [(i, j, x, y) for i, x in enumerate(firsts) for j, y in enumerate(seconds)]
    whole = hits.sparkSession.createDataFrame(grid, "i int, j int, first_cutoff double, second_cutoff double").join(counts, ["i", "j"], "left").join(queries, ["i", "j"], "left")
    # One row per pair of cutoffs from here on.
    along = lambda by, to: Window.partitionBy(by).orderBy(to).rowsBetween(Window.unboundedPreceding, 0)
    for names in ("hits", "queries"):
        whole = whole.withColumn(names, F.sum(F.coalesce(names, F.lit(0))).over(along("i", "j"))).withColumn(names, F.sum(names).over(along("j", "i")))
    return whole.select("first_cutoff", "second_cutoff", "hits", "queries")


def score_repeats(function: Callable[[DataFrame], DataFrame], values: DataFrame) -> DataFrame:
    """``score, value``: the scalar that ``function`` gives each variant (rows ``pos, variant, score``)."""
    return function(values).select("score", F.col("variant").alias("value"))


def repeat(function: Callable[[DataFrame], DataFrame], items: DataFrame, n: int) -> DataFrame:
    """``function`` on ``items`` under each salt 0..n-1, given as a column; one job for all."""
    return function(items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))))


def stable_elements(repeated: DataFrame, n: int) -> DataFrame:
    """Elements found under every one of ``n`` salts."""
    salts = repeated.sparkSession.range(n).select(F.col("id").alias("list_id"))
    return all_of(repeated.select(F.col("salt").alias("list_id"), "value"), salts)


def extract_scores(scores: DataFrame, distinct: bool = True) -> DataFrame:
    found = scores.select("score")
    return found.distinct() if distinct else found


def extract_scored(scores: DataFrame, distinct: bool = True) -> DataFrame:
    found = scores.select("value")
    return found.distinct() if distinct else found


def plot_series(scores: DataFrame) -> DataFrame:
    """``value, log_value, score`` in the order of the values; the logarithm is null for values of zero or less."""
    log = F.when(F.col("value") > 0, F.round(F.log10("value"), 9))
    return scores.select("value", log.alias("log_value"), "score").orderBy("value", "score")


def histogram(numbers: DataFrame, bins: int = 30, column: str = "value") -> DataFrame:
    """``bin, low, high, n``: equal bins from the least to the greatest number, empty ones included."""
    x = numbers.select(F.col(column).cast("double").alias("x")).where("x is not null")
    lo, hi = x.agg(F.min("x"), F.max("x")).first()
    if lo is None:
        return numbers.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    width = (hi - lo) / bins or 1.0
    at = F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1)).cast("int")
    counts = x.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = numbers.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select(
        "bin", (F.lit(lo) + F.col("bin") * width).alias("low"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0).cast("long")).alias("n")
    )
