"""Mixing sources to target weights by hash-threshold histograms.

A document's hash is a fixed point in [0, 2**60). A source takes the documents
below a threshold, so thresholds of growing budgets select nested sets and no
sort is needed: sizes are summed by source and hash bucket, a cumulative sum
over at most 1024 buckets finds the bucket in which the budget ends, and only
that bucket is split again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phylospark.llm.sampling import packed
from phylospark.shared import cut

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
HASH_BITS, STEP_BITS = 60, 10
#: Tables with one row per source, made on the driver, are broadcast up to this many rows.
BROADCAST_SOURCES = 100_000
#: Sources that a mix may have: names of collections, so thousands are many.
MOST_SOURCES = 1_000_000


def share_out(sizes: list[float], weights: list[float], budget: float, most: float) -> list[float]:
    """Split ``budget`` by weight; no share exceeds ``most`` times its size, and the excess is shared again."""
    shares, left, open_ = [0.0] * len(sizes), budget, set(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if weights[i] * unit > most * sizes[i]}
        for i in over or open_:
            shares[i] = most * sizes[i] if over else weights[i] * unit
        if not over:
            break
        left -= sum(shares[i] for i in over)
        open_ -= over
    return shares


def source_targets(sized: DataFrame, weights=WEIGHTS, budget: float = 1.5, most: float = 2.0) -> dict:
    """For each source: its size and target. The driver holds two numbers per source, and no document; over a million sources are an error."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(sums) > MOST_SOURCES:
        raise ValueError(f"a mix has at most {MOST_SOURCES} sources")
    rows = sorted(sums, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in rows]
    shares = share_out(sizes, [weights[i % len(weights)] for i in range(len(rows))], budget * sum(sizes), most)
    return {r["source"]: (r["size"], share) for r, share in zip(rows, shares)}


def hash_thresholds(sized: DataFrame, need: dict) -> dict:
    """For each source the hash below which its documents hold nearest to ``need`` words.

    ``sized`` has ``source, size, h``. Each round reads only the documents of
    the bucket in which a budget ends, and returns one row per source; it stops
    when those buckets hold one hash value each, at the latest after six rounds.
    """
    spark = sized.sparkSession
    state = {s: (0, 0) for s, n in need.items() if n > 0}  # the bucket's first hash, words below it
    done = {s: 0 for s in need if s not in state}
    schema = "_s string, need double, base long, below long"
    for bits in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        if not state:
            break
        open_ = per_source(spark, [(s, float(need[s]), b, w) for s, (b, w) in state.items()], schema)
        inside = sized.join(open_, F.col("source").eqNullSafe(F.col("_s"))).where((F.col("h") >= F.col("base")) & (F.shiftright(F.col("h") - F.col("base"), bits) < (1 << STEP_BITS)))
        bucket = F.shiftright(F.col("h") - F.col("base"), bits)
        sums = inside.groupBy("_s", "need", "base", "below", bucket.alias("bucket")).agg(F.sum("size").alias("size"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        upto = F.col("below") + F.sum("size").over(Window.partitionBy("_s").orderBy("bucket"))
        ends = sums.withColumn("upto", upto).where("upto >= need").groupBy("_s").agg(F.min(F.struct("bucket", "upto", "size", "lo", "hi", "base", "need")).alias("e")).select("_s", "e.*").collect()
        found = {r["_s"] for r in ends}
        for s in [s for s in state if s not in found]:  # rounding: the whole source is wanted
            done[s] = 1 << HASH_BITS
            del state[s]
        for r in ends:
            s, below = r["_s"], r["upto"] - r["size"]
            if r["lo"] == r["hi"] or bits == 0:
                near = r["upto"] - r["need"] < r["need"] - below
                done[s] = r["hi"] + 1 if near else r["lo"]
                del state[s]
            else:
                state[s] = (r["base"] + (r["bucket"] << bits), below)
    return done


def per_source(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of one row per source; broadcast while small, so that documents don't move to meet it."""
    made = spark.createDataFrame(rows, schema)
    return F.broadcast(made) if len(rows) <= BROADCAST_SOURCES else made


def id_hash(id_col: str, seed: int):
    return F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), 64 - HASH_BITS)


def mix_plan(docs: DataFrame, weights=WEIGHTS, budget: float = 1.5, most: int = 2, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The documents' sizes and hashes, and for each source the copies to take.

    The second table has ``source, source_size, target, whole, limit``: every
    document of the source is taken ``whole`` times, and once more if its hash
    is below ``limit``.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), id_hash(id_col, seed).alias("h")))
    targets = source_targets(sized, weights, budget, float(most))
    whole = {s: min(int(t // n), most) if n else 0 for s, (n, t) in targets.items()}
    limits = hash_thresholds(sized, {s: t - whole[s] * n for s, (n, t) in targets.items()})
    rows = [(s, n, float(t), whole[s], limits[s]) for s, (n, t) in targets.items()]
    return sized, per_source(sized.sparkSession, rows, "_source string, source_size long, target double, whole int, limit long")


def _copies(most: int):
    return F.least(F.col("whole") + (F.col("h") < F.col("limit")).cast("int"), F.lit(most))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """How many words a mix takes of every document; ``options`` as in ``mix_plan``.

    Returns one row per input row: ``doc_id, source, size, source_size, target,
    taken, copies``. Null texts have size zero, a null source is a source of its
    own that sorts last, and rows that repeat an id are taken together. An empty
    input gives no rows; sources without words have target zero. The choice
    depends on the id alone, so reruns and other partitionings agree.
    """
    sized, plan = mix_plan(docs, **options)
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("_source"))).withColumn("copies", _copies(options.get("most", 2)))
    return joined.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: rows left out, kept or repeated; columns as they came.

    The decision is made again from each row's id, so texts are not moved.
    """
    _, plan = mix_plan(docs, **options)
    rows = packed(docs, source=F.col(options.get("source_col", "source")).cast("string"), h=id_hash(options.get("id_col", "doc_id"), options.get("seed", 0)))
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    return joined.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), _copies(options.get("most", 2))))).select("row.*")
