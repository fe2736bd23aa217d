"""Set operations, counts and rearrangements of lists.

Lists are rows ``list_id, pos, value``; ``lists`` holds one row per list
(``list_id`` and, where order matters, ``pos``), so that empty lists count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phylospark.shared import require

#: Lists that a membership table or a difference may have: each becomes a column or a flag of every element.
MOST_LISTS = 10_000


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("value").unionByName(b.select("value")).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("value").intersect(b.select("value"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("value").subtract(b.select("value"))


def _presence(items: DataFrame) -> DataFrame:
    """``value, n``: in how many lists an element is. Repeats fall away before the exchange, so none is hot."""
    return items.select("list_id", "value").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def any_of(items: DataFrame) -> DataFrame:
    """Elements of at least one list."""
    return items.select("value").distinct()


def all_of(items: DataFrame, lists: DataFrame) -> DataFrame:
    """Elements of every list; an empty list leaves none."""
    total = lists.select("list_id").distinct().count()
    return _presence(items).where(F.col("n") == total).select("value")


def some_of(items: DataFrame, lists: DataFrame) -> DataFrame:
    """Elements of at least one list, but not of all."""
    total = lists.select("list_id").distinct().count()
    return _presence(items).where(F.col("n") < total).select("value")


def diff_of(items: DataFrame, lists: DataFrame) -> DataFrame:
    """The first list without (the second without (the third ...)).

    An element stays if the run of lists that hold it, from the first on, has
    odd length. So one grouping replaces the chain of joins. ``lists`` has ``pos``.
    """
    order = lists.select("list_id", "pos").distinct()
    if order.limit(MOST_LISTS + 1).count() > MOST_LISTS:
        raise ValueError(f"a difference takes at most {MOST_LISTS} lists")
    ranked = order.select("list_id", F.row_number().over(Window.orderBy("pos", "list_id")).alias("_p"))
    placed = items.select("list_id", "value").distinct().join(F.broadcast(ranked), "list_id")
    at = placed.groupBy("value").agg(F.array_sort(F.collect_set("_p")).alias("at"))
    run = F.size(F.filter(F.transform("at", lambda p, i: p == i + 1), lambda same: same))
    return at.where(run % 2 == 1).select("value")


def length(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def length_each(items: DataFrame, lists: DataFrame) -> DataFrame:
    """``list_id, n``, zero for empty lists."""
    sums = items.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"))
    return lists.join(sums, "list_id", "left").select(*lists.columns, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def sets_table(items: DataFrame, names: list[str]) -> DataFrame:
    """One row per element, one column per list: x where the list has it, else empty; numbers in the order of their values, before other texts."""
    if len(names) > MOST_LISTS:
        raise ValueError(f"a membership table takes at most {MOST_LISTS} lists")
    made = items.groupBy("value").pivot("list_id", names).agg(F.first(F.lit("x")))
    number = F.expr("try_cast(value as double)")
    return made.fillna("", subset=[c for c in made.columns if c != "value"]).orderBy(number.isNull(), number, "value")


def set_regions(items: DataFrame) -> DataFrame:
    """``lists, n``: how many elements are in exactly this combination of lists (joined by commas)."""
    named = items.select("value", F.col("list_id").cast("string").alias("l")).distinct()
    combos = named.groupBy("value").agg(F.array_join(F.array_sort(F.collect_set("l")), ",").alias("lists"))
    return combos.groupBy("lists").agg(F.count(F.lit(1)).alias("n"))


def leave_each_out(items: DataFrame, most_rows: int = 10**9) -> DataFrame:
    """For every element of a list, the list without it: ``list_id, out_pos, pos, value``.

    A list of n elements gives n * (n - 1) rows by definition; beyond
    ``most_rows`` in all that is an error. Lists of one element give none.
    """
    total = items.groupBy("list_id").count().agg(F.sum(F.col("count") * (F.col("count") - 1))).first()[0] or 0
    if total > most_rows:
        raise ValueError(f"leaving each element out would make {total} rows")
    out = items.select("list_id", F.col("pos").alias("out_pos"))
    return items.join(out, "list_id").where(F.col("pos") != F.col("out_pos")).select("list_id", "out_pos", "pos", "value")


def singletons(items: DataFrame) -> DataFrame:
    """Every element as a list of its own."""
    return items.select(F.col("pos").alias("list_id"), F.lit(1).cast("long").alias("pos"), "value")


def zip_lists(a: DataFrame, b: DataFrame) -> DataFrame:
    """``list_id, pos, a, b``: two lists side by side; unequal lengths are an error."""
    left, right = a.select("list_id", "pos", F.col("value").alias("a"), F.lit(1).alias("_a")), b.select("list_id", "pos", F.col("value").alias("b"), F.lit(1).alias("_b"))
    joined = left.join(right, ["list_id", "pos"], "full")
    return require(joined, F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.lit("lists of unequal length")).select("list_id", "pos", "a", "b")


def _draw(salt, *columns: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(salt)) if not isinstance(salt, Column) else salt.cast("string"), *[c.cast("string") for c in columns]))


def sample(items: DataFrame, n: float, salt=0, by: list[str] | None = None, parts: int = 64) -> DataFrame:
    """``n`` elements of each list without replacement; all, if it has fewer.

    The draw orders elements by a hash of salt, place and value, so it does not
    depend on partitioning; another salt (a number or a column) draws another
    sample. Each of ``parts`` parts of a list first yields its own n, so a long
    list is not sorted in one task.
    """
    at = ["list_id"] if by is None else list(by)
    keyed = items.withColumn("_k", _draw(salt, F.col("pos"), F.col("value"))).withColumn("_p", F.pmod(F.xxhash64("_k"), F.lit(parts)))
    first = keyed.withColumn("_n", F.row_number().over(Window.partitionBy(*at, "_p").orderBy("_k", "pos"))).where(F.col("_n") <= round(n))
    last = first.withColumn("_n", F.row_number().over(Window.partitionBy(*at).orderBy("_k", "pos"))).where(F.col("_n") <= round(n))
    return last.select(*items.columns)


def dedup_by_content(df: DataFrame, column: str, order: str) -> DataFrame:
    """The first row, by ``order``, of each content hash; adds ``content_hash``."""
    hashed = df.withColumn("content_hash", F.md5(F.col(column)))
    rest = [c for c in hashed.columns if c not in ("content_hash", order)]
    first = hashed.groupBy("content_hash").agg(F.min(F.struct(order, *rest)).alias("_r"))
    return first.select(*[F.col(c) if c == "content_hash" else F.col(f"_r.{c}") for c in hashed.columns])


def content_of(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """One row for each group with ``content``, equal for groups that hold the same rows equally often, in whatever order.

    The number of rows, and the sums and exclusive ors of two 64-bit hashes of
    each: they add up in every task before the exchange, so a list of any length
    costs a row a task. Nulls are values.
    """
    cells = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    hashes = [F.xxhash64(cells), F.xxhash64(F.md5(cells), F.lit("again"))]
    sums = [part for h in hashes for part in (F.sum(h.cast("decimal(38,0)")), F.bit_xor(h))]
    return rows.groupBy(*by).agg(F.struct(F.count(F.lit(1)), *sums).alias("_c")).select(*by, F.sha2(F.to_json("_c"), 256).alias("content"))


def dedup_lists_by_content(items: DataFrame, lists: DataFrame) -> DataFrame:
    """The first (by ``pos``, then id) of ``lists`` that have the same elements equally often; empty lists are equal."""
    held = lists.join(content_of(items, ["list_id"], ["value"]), "list_id", "left")
    first = held.groupBy("content").agg(F.min(F.struct("pos", "list_id", *[c for c in lists.columns if c not in ("pos", "list_id")])).alias("_l"))
    return first.select(*[F.col(f"_l.{c}") for c in lists.columns])


def concat(*tables: DataFrame) -> DataFrame:
    """One table of all rows, repeats included; tables of a list lose their ``list_id``."""
    out = None
    for t in tables:
        t = t.drop("list_id") if "list_id" in t.columns else t
        out = t if out is None else out.unionByName(t)
    return out
