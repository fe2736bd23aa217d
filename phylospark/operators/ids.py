"""Short ids for long headers, and lookups by id or by the start of a header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phylospark.shared import cut

#: Hexadecimal digits of a hashed id.
DIGITS = 32


def hash_of(header: Column, digits: int = DIGITS) -> Column:
    """``seqid_`` and the first digits of the MD5 of the quoted header."""
    return F.concat(F.lit("seqid_"), F.substring(F.md5(F.concat(F.lit('"'), header, F.lit('"'))), 1, digits))


def hash_ids(seqs: DataFrame, digits: int = DIGITS) -> tuple[DataFrame, DataFrame]:
    """Sequences under hashed ids, and the table ``hash, header`` that leads back.

    Ten digits (40 bits) collide from about a million headers on; the default
    of 32 does not.
    """
    hashed = seqs.withColumn("seq_id", hash_of(F.col("header"), digits))
    return hashed, hashed.select(F.col("seq_id").alias("hash"), "header").distinct()


def unhash_ids(df: DataFrame, idmap: DataFrame, columns: list[str], long: bool = False) -> DataFrame:
    """Headers (or their first words) in place of hashes; unknown ids stay."""
    name = F.col("header") if long else F.regexp_extract("header", r"^\S*", 0)
    back = idmap.select(F.col("hash").alias("_h"), name.alias("_n")).dropDuplicates(["_h"])
    for c in columns:
        df = df.join(back, F.col(c) == F.col("_h"), "left").withColumn(c, F.coalesce("_n", F.col(c))).drop("_h", "_n")
    return df


def unhash_text(df: DataFrame, idmap: DataFrame, column: str, key: str, long: bool = False) -> DataFrame:
    """Headers in place of ``seqid_`` tokens anywhere in a text, of as many digits as the map's ids have; ``key`` tells rows apart."""
    name = F.col("header") if long else F.regexp_extract("header", r"^\S*", 0)
    back = idmap.select(F.col("hash").alias("_h"), name.alias("_n")).dropDuplicates(["_h"])
    pattern = r"seqid_[0-9a-f]+"
    marked = F.split(F.regexp_replace(F.col(column), f"({pattern})", "\u0001$1\u0001"), "\u0001")
    parts = df.select(key, F.posexplode(marked).alias("_i", "_t")).join(back, F.col("_t") == F.col("_h"), "left")
    texts = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", F.coalesce("_n", "_t").alias("t")))).alias("_p"))
    joined = df.join(texts, key, "left")
    return joined.withColumn(column, F.when(F.col(column).isNotNull(), F.array_join(F.transform("_p", lambda p: p["t"]), ""))).select(*df.columns)


#: Prefixes of up to so many lengths give each row a start for each; beyond it rows go by the order of strings.
MOST_LENGTHS = 8
#: Prefixes whose chains are broadcast at most.
BROADCAST_CHAINS = 100_000


def _by_length(longer: DataFrame, column: str, prefixes: DataFrame, lengths: list[int]) -> DataFrame:
    starts = F.array_distinct(F.array(*[F.when(F.length(column) >= n, F.substring(F.col(column), 1, n)) for n in lengths]))
    return longer.withColumn("prefix", F.explode(starts)).join(prefixes, "prefix")


def _by_order(values: DataFrame, prefixes: DataFrame, lengths: list[int]) -> DataFrame:
    """``_v, prefix``: which distinct strings begin with which prefixes, through the order of strings.

    The last prefix that is not greater than a string is a prefix of it, or
    else every prefix of it is one of that one too. So each string meets one
    chain of nested prefixes, whatever the number of their lengths, and only
    what it really begins with makes rows. Strings are dealt by ranges; the last
    prefix before a range is carried on, one row for each range.
    """
    marks = prefixes.select("prefix").where("prefix is not null").distinct()
    chains = _by_length(marks.select(F.col("prefix").alias("_p")), "_p", marks, lengths).groupBy("_p").agg(F.collect_list("prefix").alias("chain"))
    both = values.select(F.col("_v").alias("s"), F.lit(1).alias("kind")).unionByName(marks.select(F.col("prefix").alias("s"), F.lit(0).alias("kind")))
    dealt = cut(both.repartitionByRange("s", "kind").withColumn("_part", F.spark_partition_id()))
    mark = F.when(F.col("kind") == 0, F.col("s"))
    before = dealt.groupBy("_part").agg(F.max(mark).alias("m")).select("_part", F.max("m").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    upto = Window.partitionBy("_part").orderBy("s", "kind").rowsBetween(Window.unboundedPreceding, 0)
    last = dealt.withColumn("_m", F.max(mark).over(upto)).where("kind = 1").join(F.broadcast(before), "_part").select(F.col("s").alias("_v"), F.coalesce("_m", "_before").alias("_p"))
    chains = cut(chains)
    met = last.join(F.broadcast(chains) if chains.count() <= BROADCAST_CHAINS else chains, "_p")
    return met.select("_v", F.explode(F.filter("chain", lambda c: F.startswith("_v", c))).alias("prefix"))


def _starts(longer: DataFrame, column: str, prefixes: DataFrame) -> DataFrame:
    """Pairs in which ``column`` begins with ``prefix``, by equality joins."""
    lengths = sorted(r["n"] for r in prefixes.select(F.length("prefix").alias("n")).distinct().collect() if r["n"] is not None)
    if not lengths:
        return longer.join(prefixes.limit(0), F.col(column) == F.col("prefix"))
    if len(lengths) <= MOST_LENGTHS:
        return _by_length(longer, column, prefixes, lengths)
    pairs = _by_order(longer.select(F.col(column).alias("_v")).where("_v is not null").distinct(), prefixes, lengths)
    return longer.join(pairs, F.col(column) == F.col("_v")).drop("_v").join(prefixes, "prefix")


def lookup_ids(idmap: DataFrame, partial: DataFrame) -> DataFrame:
    """``value, hash, header``: entries whose hash is the value or whose header begins with it; unmatched values keep nulls."""
    asked = partial.select(F.col("value").alias("prefix")).distinct()
    found = idmap.select("hash", "header").join(asked, F.col("hash") == F.col("prefix")).unionByName(_starts(idmap.select("hash", "header"), "header", asked)).distinct()
    return asked.join(found, "prefix", "left").select(F.col("prefix").alias("value"), "hash", "header")


def extract_seqs(seqs: DataFrame, ids: DataFrame) -> DataFrame:
    """Sequences whose id begins with one of ``ids`` (column ``value``)."""
    asked = ids.select(F.col("value").alias("prefix")).distinct()
    found = _starts(seqs.select("seq_id").distinct(), "seq_id", asked).select("seq_id").distinct()
    return seqs.join(found, "seq_id", "left_semi").select(*seqs.columns)


def extract_ids(seqs: DataFrame) -> DataFrame:
    at = ["list_id"] if "list_id" in seqs.columns else []
    return seqs.select(*at, F.col("seq_id").alias("value")).distinct()


def split_fasta(seqs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every record as a list of its own, named by its content, and the store of distinct records."""
    named = seqs.withColumn("list_id", F.substring(F.md5(F.concat(F.lit(">"), "header", F.lit("\n"), "seq")), 1, 11))
    return named, named.dropDuplicates(["list_id"])
