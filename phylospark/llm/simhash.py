"""SimHash near-duplicates by deletion-variant signatures.

Two fingerprints of 64 bits that differ in at most three bits are cut into two
halves; of three differing bits one half holds at most one. So the index keeps,
for each half, its value and its 32 values with one bit masked out, and an
equality join of the index with itself meets every pair. A pair that agrees in
a half meets at the whole value; a pair that differs in bit i of it meets at
the variant that masks bit i. Candidates are verified by counting bits.

Components need links that span them, not all pairs. So every fingerprint is
first linked to the least one of each of its signatures, if that is near. Then
only signatures whose fingerprints are still in different components are joined
with themselves, and of the pairs found only those of components are kept: the
fingerprints of a dense ball make links in proportion to their number.
Signatures that are too common get a second signature from the other half.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospark.llm.sampling import packed
from phylospark.operators.components import connected_components
from phylospark.shared import cut

SEED = 42
#: Fingerprints that share a signature before it is refined by the other half.
COMMON = 256


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of the text's shingles: words are split at ASCII white space, A-Z in lower case."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    hash64 = xxhash.xxh64_intdigest
    ones, block = np.zeros(64, np.int64), 1 << 15
    stops = ends[-n:].tolist()
    for at in range(0, n, block):
        h = np.array([hash64(joined[i:j], SEED) for i, j in zip(starts[at : at + block], stops[at : at + block])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """``doc_id, fp`` (a long) of every row; null and blank texts have fingerprint zero."""

    @F.pandas_udf("long")
    def marks(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), marks(F.col(text_col).cast("string")).alias("fp"), *keep)


def _variants(value, segment: int, bits: int):
    """Signatures of a segment, one long each: segment, masked bit (from 1; 0 for none), and the value without it."""
    at = lambda bit: F.lit(segment << (bits + 6) | bit << bits)
    masked = [value.bitwiseAND(F.lit(~(1 << i))).bitwiseOR(at(i + 1)) for i in range(bits)]
    return F.array(value.bitwiseOR(at(0)), *masked)


def _half(fp, half: int):
    return F.shiftrightunsigned(fp, 32) if half else fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _index(distinct: DataFrame) -> DataFrame:
    """``fp, sig`` for every signature of every fingerprint, made anew where it is read; fingerprints are dealt first, so no task counts too many."""
    dealt = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    return dealt.select("fp", F.explode(F.concat(*[_variants(_half(F.col("fp"), half), half, 32) for half in (0, 1)])).alias("sig"))


def _refined(index: DataFrame) -> DataFrame:
    """Rows with signatures ``finer`` of the other half: one 16-bit quarter of it differs by at most one bit too.

    One list holds those of both quarters: joins of a union's rows may fail in
    Spark 4.1, which counts its partitions as those of one side.
    """
    other = F.when(F.shiftright("sig", 38) == 0, _half(F.col("fp"), 1)).otherwise(_half(F.col("fp"), 0))
    quarters = [_variants(F.shiftrightunsigned(other, 16 * quarter).bitwiseAND(F.lit(0xFFFF)), quarter, 16) for quarter in (0, 1)]
    return index.withColumn("finer", F.explode(F.concat(*quarters)))


def _meet(index: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Pairs ``src, dst`` of components, ends of verified pairs of fingerprints that share a signature."""
    a = index.select(*keys, F.col("fp").alias("a_fp"), F.col("component").alias("src"))
    b = index.select(*keys, F.col("fp").alias("b_fp"), F.col("component").alias("dst"))
    return a.join(b, keys).where((F.col("src") < F.col("dst")) & _near("a_fp", "b_fp", most)).select("src", "dst").distinct()


def _near(a: str, b: str, most: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= most


def _unsettled(index: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of signatures whose fingerprints are in different components."""
    ends = index.groupBy(*keys).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    return index.join(ends.select(*keys), keys, "left_semi")


def near_components(distinct: DataFrame, most: int = 3, common: int = COMMON) -> DataFrame:
    """``node, component`` of the distinct fingerprints (``fp``) that another one is near, by at most ``most`` <= 3 bits, over any number of links."""
    index, keys = _index(distinct), ["sig"]
    sums = cut(index.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("first")).where("n > 1"))
    shared = cut(index.join(_sized(sums), keys))
    links = shared.where((F.col("fp") != F.col("first")) & _near("fp", "first", most)).select(F.col("fp").alias("src"), F.col("first").alias("dst"))
    settled = cut(connected_components(links))
    labelled = shared.join(settled.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    open_ = cut(_unsettled(labelled, keys))
    pairs = cut(_meet(open_.where(F.col("n") <= common), keys, most))
    many = open_.where(F.col("n") > common)
    if many.limit(1).count():
        finer = [*keys, "finer"]
        pairs = pairs.unionByName(cut(_meet(_unsettled(_refined(many), finer), finer, most)))
    if not pairs.limit(1).count():
        return settled
    joined = cut(connected_components(pairs).select(F.col("node").alias("component"), F.col("component").alias("whole")))
    inside = settled.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    # Fingerprints that no first link holds are components of their own; those joined now get a label too.
    return inside.unionByName(joined.select(F.col("component").alias("node"), F.col("whole").alias("component")).join(inside, "node", "left_anti"))


def simhash_components(docs: DataFrame, words: int = 3, most: int = 3, common: int = COMMON, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate groups: ``doc_id, fingerprint, component_id, component``, one row per input row.

    ``component_id`` is the smallest id reachable over links of fingerprints
    that differ in at most ``most`` bits. Copies share a fingerprint, so links
    are sought between distinct fingerprints only. Null and blank texts have
    fingerprint zero and link like any other; a null id counts for no component
    unless no other row is there; an empty input gives no rows. ``component`` is
    the group's least fingerprint, which tells groups apart even where different
    texts share an id.
    """
    marked = cut(fingerprints(docs, words, id_col, text_col), batch_rows=1000)
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = near_components(distinct.select("fp"), most, common)
    labelled = distinct.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = cut(labelled.join(smallest, "component").select("fp", "component_id", "component"))
    return marked.join(labels, "fp").select("doc_id", _hex("fp").alias("fingerprint"), "component_id", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one with the smallest id; columns as they came.

    Rows that share an id are told apart by their fingerprints; of those that
    share the smallest id of their group one stays.
    """
    made = cut(simhash_components(docs, id_col=id_col, text_col=text_col, **options))
    counts = made.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("component_id").alias("least"))
    counts = cut(counts.select(F.col("doc_id").alias("_id"), "n", F.col("least").eqNullSafe(F.col("doc_id")).alias("stays")))
    drop, again = counts.where("n = 1 and not stays").select("_id"), counts.where("n > 1").select("_id")
    rows = packed(docs, key=F.col(id_col), text=F.col(text_col))
    same = F.col("key").eqNullSafe(F.col("_id"))
    kept = rows.join(_sized(drop), same, "left_anti")
    if again.limit(1).count():
        marked = cut(fingerprints(kept.join(_sized(again), same, "left_semi"), options.get("words", 3), "key", "text", keep=["row"]))
        first = made.where(F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("_id"), "fingerprint", "component").distinct()
        on = F.col("doc_id").eqNullSafe(F.col("_id")) & (_hex("fp") == F.col("fingerprint"))
        twice = marked.join(first, on).dropDuplicates(["doc_id", "component"]).select("row")
        return kept.join(_sized(again), same, "left_anti").select("row").unionByName(twice).select("row.*")
    return kept.select("row.*")


def _hex(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def _sized(ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Broadcast up to ``most`` rows of some ids; a shuffled join otherwise."""
    return F.broadcast(ids) if ids.count() <= most else ids
