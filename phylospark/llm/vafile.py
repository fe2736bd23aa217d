"""Exact top-k inner products with a vector-approximation file.

Vectors are scaled to integers. The approximation file holds one byte per
component, the number of the cell its value lies in; cells are quantiles of a
bounded sample, and their outer ends are the least and greatest value of all
vectors, so a cell number bounds the value and a row of cells bounds the inner
product with a query from below and above.

1. Equal vectors become one class that keeps its k + 1 smallest ids (ties go to
   smaller ids, and a query skips itself, so no other id can be needed).
2. Blocks of queries meet blocks of cells: every block of cells is dealt to one
   of G groups, query blocks go to all groups, so a task holds a few blocks of
   cells and streams queries past them. The first pass keeps the k + 1 greatest
   lower bounds of each query; the (k + 1)th bounds the result from below.
3. The second pass keeps the classes whose upper bound reaches it.
4. Exact vectors are read in the order of their bounds: first the k + 1 best,
   then those whose bound still reaches the (k + 1)th exact score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phylospark.llm.sampling import least_hashes
from phylospark.shared import cut

#: A component's cell is one byte, a quarter of the exact value; finer cells give tighter bounds.
CELLS = 200
#: About how many vectors are in the sample from which cells are fitted; bounds hold for any cells.
SAMPLE = 4096
VECTORS_PER_BLOCK, QUERIES_PER_BLOCK = 4096, 512
#: Queries with one vector from which on they are salted; at most ``MOST_COMMON`` vectors can be that common.
COMMON_QUERY, MOST_COMMON, SALTS = 256, 4096, 32
#: Parts in which the candidates of a query class are ranked first.
PARTS = 32
BOUNDS = "block long, part int, n int, low binary"


def scaled_vectors(vectors: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, dim, packed`` (little-endian 32-bit integers) of the vectors that take part."""
    x = F.col(vector_col)
    usable = x.isNotNull() & F.col(id_col).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))

    @F.pandas_udf("binary")
    def pack(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            ints = np.floor(np.asarray(v, np.float64) * scale)
            if np.abs(ints).max() >= 2**31:
                raise ValueError("a scaled component needs more than 32 bits")
            out.append(ints.astype("<i4").tobytes())
        return pd.Series(out, dtype=object)

    return vectors.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), F.size(x).alias("dim"), pack(x.cast("array<double>")).alias("packed"))


def vector_classes(scaled: DataFrame, keep: int, salts: int = 1024) -> DataFrame:
    """Distinct vectors with their ``keep`` smallest ids.

    A batch passes on ``keep`` rows of a vector at most, and the rest is reduced
    in two salted steps, so that a very common vector stays small everywhere.
    """

    def fewest(batches):
        for b in batches:
            b = b.drop_duplicates().sort_values("vec_id", kind="stable")
            yield b[b.groupby(["dim", "packed"]).cumcount() < keep]

    least = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, keep)
    first = scaled.mapInPandas(fewest, "vec_id long, dim int, packed binary").groupBy("dim", "packed", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).alias("salt"))
    first = first.agg(least(F.collect_set("vec_id")).alias("ids"))
    return first.groupBy("dim", "packed").agg(least(F.flatten(F.collect_list("ids"))).alias("ids")).withColumn("class_id", F.monotonically_increasing_id())


def _blocks(rows: DataFrame, id_col: str, size: int, code=None) -> DataFrame:
    """Rows packed into blocks ``dim, ids, body``; ``code`` maps integers to what the body holds."""

    def pack(batches):
        for b in batches:
            for dim, g in b.groupby("dim"):
                for at in range(0, len(g), size):
                    part = g.iloc[at : at + size]
                    body = np.frombuffer(b"".join(part["packed"]), "<i4")
                    yield pd.DataFrame({"dim": [dim], "ids": [part[id_col].to_numpy("<i8").tobytes()], "body": [(code(body) if code else body).tobytes()]})

    return rows.select("dim", id_col, "packed").mapInPandas(pack, "dim int, ids binary, body binary").withColumn("block", F.monotonically_increasing_id())


class Cells:
    """Cell numbers of integers, and the least and greatest value of every cell."""

    def __init__(self, sample: np.ndarray, least: int, most: int, cells: int):
        inner = np.unique(np.quantile(sample, np.arange(1, cells) / cells, method="nearest")) if len(sample) else np.array([], int)
        self.edges = inner[(inner > least) & (inner <= most)].astype(np.int64)
        self.lo = np.r_[least, self.edges].astype(np.float64)
        self.hi = np.r_[self.edges - 1, most].astype(np.float64)

    def code(self, values: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, values, "right").astype(np.uint8)

    def bounds(self, queries: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of inner products, with room for rounding."""
        up, down = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
        lo, hi = self.lo[codes].T, self.hi[codes].T
        a, b = up @ lo + down @ hi, up @ hi + down @ lo
        return a - np.abs(a) * 1e-9, b + np.abs(b) * 1e-9


def dealt_to(groups: int):
    """The group of a block. Blocks are numbered within partitions, so the number itself would deal each partition's first to one group."""
    return F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")


def _pairs(cells: DataFrame, queries: DataFrame, groups: int) -> DataFrame:
    """Every query block beside every block of cells of its dimension."""
    dealt = cells.select("dim", dealt_to(groups).alias("g"), F.col("ids").alias("c_ids"), F.col("body").alias("c_body"))
    sent = queries.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return sent.join(dealt.hint("shuffle_hash"), ["dim", "g"])


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, cells: int = CELLS, id_col: str = "vec_id", vector_col: str = "embedding", groups: int | None = None) -> DataFrame:
    """For each query row its ``k`` greatest inner products with other rows, exactly.

    ``is_query`` is a condition on the id column. Components become
    ``floor(scale * x)``; scores are integer inner products, ties go to the
    smaller id. Null vectors, vectors with null or non-finite components, empty
    vectors and null ids take no part; vectors of different dimension are not
    compared; rows that repeat an id with the same vector count once, and an id
    with several vectors takes part with each of them, as a query too. A query
    with fewer candidates gets all of them. Vectors may be long; other columns
    play no part. Returns ``query_id, rank, vec_id, score``; an empty table
    gives no rows.
    """
    spark = vectors.sparkSession
    keep = k + 1
    scaled = cut(scaled_vectors(vectors, scale, id_col, vector_col))
    asked = scaled.where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "dim", "packed").distinct()
    classes = cut(vector_classes(scaled, keep))
    q_classes = cut(asked.groupBy("dim", "packed").agg(F.count(F.lit(1)).alias("n")).withColumn("q", F.monotonically_increasing_id()))

    drawn = least_hashes(classes.select("packed"), "packed", SAMPLE, classes.count()).collect()
    sample = np.frombuffer(b"".join(r["packed"] for r in drawn), "<i4")

    @F.pandas_udf("struct<lo: int, hi: int>")
    def ends(packed: pd.Series) -> pd.DataFrame:
        found = [(x.min(), x.max()) for x in (np.frombuffer(p, "<i4") for p in packed)]
        return pd.DataFrame(found, columns=["lo", "hi"])

    least, most = classes.select(ends("packed").alias("e")).agg(F.min("e.lo"), F.max("e.hi")).first()
    grid = Cells(sample, least or 0, most or 0, cells)

    approximations = cut(_blocks(classes, "class_id", VECTORS_PER_BLOCK, grid.code))
    q_blocks = cut(_blocks(q_classes, "q", QUERIES_PER_BLOCK))
    groups = groups or max(1, min(approximations.count(), 4 * spark.sparkContext.defaultParallelism))
    parts = max(1, int(groups**0.5))

    def greatest(low: np.ndarray) -> np.ndarray:
        return np.partition(low, low.shape[1] - keep, axis=1)[:, -keep:] if low.shape[1] > keep else low

    def greatest_lower_bounds(batches):
        best: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for dim, block, part, body, codes in zip(b["dim"], b["block"], b["part"], b["body"], b["c_body"]):
                low, _ = grid.bounds(np.frombuffer(body, "<i4").reshape(-1, dim), np.frombuffer(codes, np.uint8).reshape(-1, dim))
                at = block, part
                best[at] = greatest(np.concatenate([best[at], low], axis=1) if at in best else low)
                if len(best) * QUERIES_PER_BLOCK * keep * 8 > 64 << 20:  # hand over early; the merge takes several rows of a block
                    yield _bound_rows(best)
                    best = {}
        yield _bound_rows(best)

    def merged(pdf: pd.DataFrame) -> np.ndarray:
        n = int(pdf["n"].iloc[0])
        return greatest(np.concatenate([np.frombuffer(x, np.float64).reshape(n, -1) for x in pdf["low"]], axis=1))

    def merge_part(pdf: pd.DataFrame) -> pd.DataFrame:
        return _bound_rows({(pdf["block"].iloc[0], pdf["part"].iloc[0]): merged(pdf)})

    def merge_block(pdf: pd.DataFrame) -> pd.DataFrame:
        low = merged(pdf)
        floor = low.min(axis=1) if low.shape[1] >= keep else np.full(len(low), -np.inf)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "floor": [floor.tobytes()]})

    # Bounds of a block of queries come from every group; they merge in two steps.
    pairs = _pairs(approximations, q_blocks, groups).select("dim", "block", F.pmod("g", F.lit(parts)).alias("part"), "body", "c_body")
    low = pairs.mapInPandas(greatest_lower_bounds, BOUNDS).groupBy("block", "part").applyInPandas(merge_part, BOUNDS)
    floors = low.groupBy("block").applyInPandas(merge_block, "block long, floor binary")

    def candidates(batches):
        for b in batches:
            for dim, ids, body, floor, c_ids, codes in zip(b["dim"], b["ids"], b["body"], b["floor"], b["c_ids"], b["c_body"]):
                _, high = grid.bounds(np.frombuffer(body, "<i4").reshape(-1, dim), np.frombuffer(codes, np.uint8).reshape(-1, dim))
                at, of = np.nonzero(high >= np.frombuffer(floor, np.float64)[:, None])
                yield pd.DataFrame({"q": np.frombuffer(ids, "<i8")[at], "class_id": np.frombuffer(c_ids, "<i8")[of], "bound": high[at, of]})

    found = _pairs(approximations, q_blocks.join(floors, "block"), groups).select("dim", "ids", "body", "floor", "c_ids", "c_body").mapInPandas(candidates, "q long, class_id long, bound double")
    found = cut(found)
    # The greatest bounds of a query class are found part by part, so a class that prunes badly is not ranked in one task.
    best_of = lambda rows, *by: rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("bound"), "class_id"))).where(F.col("place") <= keep)
    heads = cut(best_of(best_of(found.withColumn("part", F.pmod(F.xxhash64("class_id"), F.lit(PARTS))), "q", "part"), "q").select("q", "class_id", "bound"))

    @F.pandas_udf("long")
    def product(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([int(np.frombuffer(x, "<i4").astype(np.int64) @ np.frombuffer(y, "<i4").astype(np.int64)) for x, y in zip(a, b)], dtype="int64")

    def exact(some: DataFrame) -> DataFrame:
        read = some.join(classes.select("class_id", "packed", "ids"), "class_id").join(q_classes.select("q", F.col("packed").alias("q_packed")), "q")
        return read.select("q", "ids", product("packed", "q_packed").alias("score"))

    first = cut(exact(heads))
    # Each query class has one row here, so the rest is told from the heads by the last of them, without ranks.
    last = heads.groupBy("q").agg(F.min(F.struct(F.col("bound"), (-F.col("class_id")).alias("back"))).alias("last"))
    certain = first.groupBy("q").agg(F.min("score").alias("kth")).join(last, "q")
    rest = found.join(certain, "q").where((F.col("bound") >= F.col("kth")) & (F.struct(F.col("bound"), (-F.col("class_id")).alias("back")) < F.col("last")))
    scored = first.unionByName(exact(rest)).select("q", "score", F.explode("ids").alias("vec_id"))
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= keep)
    # Queries of a very common vector are dealt by a salt to copies of their class; such classes are few and broadcast as marks.
    at_least = max(COMMON_QUERY, (q_classes.agg(F.sum("n")).first()[0] or 0) // MOST_COMMON)
    salt = F.pmod(F.xxhash64("query_id"), F.lit(SALTS))
    marks = F.broadcast(q_classes.where(F.col("n") > at_least).select("dim", "packed", F.lit(True).alias("common")))
    salted = asked.join(marks, ["dim", "packed"], "left").withColumn("salt", F.when(F.col("common"), salt).otherwise(0))
    every_salt = F.explode(F.sequence(F.lit(0), F.when(F.col("n") > at_least, SALTS - 1).otherwise(0)))
    copies = q_classes.withColumn("salt", every_salt)
    answers = salted.join(copies.select("dim", "packed", "salt", "q"), ["dim", "packed", "salt"]).select("query_id", "q", "salt")
    best = best.join(q_classes.select("q", "n"), "q").withColumn("salt", every_salt)
    answers = answers.join(best.select("q", "salt", "score", "vec_id"), ["q", "salt"]).where(F.col("query_id") != F.col("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _bound_rows(best: dict[tuple[int, int], np.ndarray]) -> pd.DataFrame:
    blocks, parts = (np.array([at[i] for at in best], t) for i, t in ((0, np.int64), (1, np.int32)))
    return pd.DataFrame({"block": blocks, "part": parts, "n": np.array([len(x) for x in best.values()], np.int32), "low": [np.ascontiguousarray(x).tobytes() for x in best.values()]})
