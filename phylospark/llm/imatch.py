"""Document fingerprints by I-Match over several randomised lexicons.

A term counts if its inverse document frequency lies in a band: terms of very
many documents say nothing, those of very few are slips. The distinct terms of
a document that are in the band are sorted and hashed, once with the whole
lexicon and once with each of several random parts of it. A change of a few
words spares the parts that none of these words is in, so the share of equal
hashes is a likeness.

All of it is DataFrame functions. The lexicon is the only thing that is sent to
every task, and the band bounds it: a term of at least a share s of the
documents, and t distinct terms a document, leave at most t / s terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phylospark.llm.ranking import group_key, ranked
from phylospark.shared import cut

#: Documents of a hundred thousand that a term of the band is in: at least and at most (idf 9.0 to 2.3).
LEAST, MOST, OF = 12, 10_000, 100_000
#: 65536ths of the lexicon that each part keeps; the first is the whole. Thin parts tell long texts apart by degrees, dense ones short texts.
PARTS = (65536, 16384, 4096, 4096, 1024, 1024, 1024, 1024, 256, 256, 256, 256, 64, 64, 64, 64)
#: For each part: where its four digits of a term's digest begin, and what they are below of; ``g`` is above all digits.
LIMITS = [(4 * k + 1, "g" if kept == 65536 else f"{kept:04x}") for k, kept in enumerate(PARTS)]
#: The lexicon is broadcast up to this number of terms, and joined by a shuffle beyond it.
BROADCAST_TERMS = 500_000
DIGITS, NONE = 8, "--------"
#: Stands before the digest that replaces the terms of a text without any in the band.
MARK = " "


def terms(text: Column) -> Column:
    """Distinct runs of letters and digits, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))


def lexicon(docs: DataFrame, text_col: str = "text", least: int = LEAST, most: int = MOST) -> DataFrame:
    """``term`` of the band, from all documents; written."""
    rows = docs.agg(F.count(F.lit(1))).first()[0]
    found = docs.select(F.explode(terms(F.col(f"`{text_col}`"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return cut(found.where((F.col("n") * OF >= rows * least) & (F.col("n") * OF <= rows * most)).select("term"))


def membership() -> Column:
    """A bit for each part of the lexicon that a ``term`` is in, by four digits of the term's own digest for each."""
    bits = [F.when(F.substring("_digest", at, 4) < limit, 1 << k).otherwise(0) for k, (at, limit) in enumerate(LIMITS)]
    return sum(bits[1:], bits[0])


def _hashes(found: Column) -> Column:
    """Of sorted terms (structs of ``term, bits``) the hash of those in each part of the lexicon, joined."""
    kept = F.transform(F.sequence(F.lit(0), F.lit(len(PARTS) - 1)), lambda k: F.array_join(F.transform(F.filter(found, lambda t: F.getbit(t["bits"], k) == 1), lambda t: t["term"]), " "))
    return F.array_join(F.transform(kept, lambda x: F.when(x == "", NONE).otherwise(F.substring(F.md5(x), 1, DIGITS))), "")


def fingerprints(texts: DataFrame, keys: list[str], words: DataFrame, text_col: str = "text") -> DataFrame:
    """``fingerprint`` and ``sha``, the text's SHA-256, of each row of ``texts``, which ``keys`` tell apart.

    Where ``texts`` is dealt by the first of ``keys``, nothing is exchanged.
    A text without a term of the band is represented by the digest of all its
    distinct terms, and one without any term by that of itself.
    """
    single = texts.select(*keys, F.col(text_col).alias("_text"), terms(F.col(text_col)).alias("_terms"))
    # One more element for each text: it keeps texts without terms and takes the digest along, so that rows stay short.
    instead = F.concat(F.lit(MARK), F.md5(F.when(F.size("_terms") > 0, F.array_join(F.array_sort("_terms"), " ")).otherwise(F.concat(F.lit(MARK), F.col("_text")))), F.sha2("_text", 256))
    single = single.select(*keys, F.explode(F.array_append("_terms", instead)).alias("term"))
    marked = words.select("term", F.sha2("term", 256).alias("_digest")).select("term", membership().alias("bits"))
    known = single.join(F.broadcast(marked) if words.count() <= BROADCAST_TERMS else marked, "term", "left")
    known = known.withColumn("bits", F.when(F.col("term").startswith(MARK), 0).otherwise(F.col("bits"))).where("bits is not null")
    found = known.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("term", "bits"))).alias("_all"))
    # The mark sorts before all terms.
    mark, whole = F.col("_all")[0]["term"], (1 << len(PARTS)) - 1
    real = F.filter("_all", lambda t: t["bits"] > 0)
    used = found.select(*keys, F.substring(mark, 34, 64).alias("sha"), F.when(F.size(real) > 0, real).otherwise(F.array(F.struct(F.substring(mark, 1, 33).alias("term"), F.lit(whole).alias("bits")))).alias("_used"))
    return used.select(*keys, "sha", _hashes(F.col("_used")).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes, among those of parts of which either text has a term."""
    part = lambda x, k: F.substring(x, k * DIGITS + 1, F.lit(DIGITS))
    pairs = F.transform(F.sequence(F.lit(0), F.lit(len(PARTS) - 1)), lambda k: F.struct(part(a, k).alias("a"), part(b, k).alias("b")))
    some = F.filter(pairs, lambda p: (p["a"] != NONE) | (p["b"] != NONE))
    return F.size(F.filter(some, lambda p: p["a"] == p["b"])) / F.size(some)


def _copies(most: int) -> Column:
    """One element for each of ``n`` rows, in two steps, so that no array is long."""
    return F.sequence(F.lit(1), F.least(F.lit(most).cast("long"), F.col("c") - (F.col("_k") - 1) * most))


def fingerprints_and_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with its fingerprint and that of an edited text, whose last half of code points is the next document's first.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``. The next document is that of the next id, after the
    last one the first; a null id is the first, and of rows that share an id the
    order is that of their texts' MD5. Rows that repeat id and text each count,
    and the next one of all but the last is the same text. Null texts are empty;
    long texts count whole; other columns, clashing names included, play no
    part. An empty table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.unhex(F.md5(text)).alias("mark"), text.alias("text"))
    words = lexicon(rows)
    key = F.unhex(F.md5(F.concat(group_key(F.col("doc_id")), F.lit(":"), F.hex("mark"))))
    rows = rows.select(key.alias("key"), "doc_id", "mark", "text")
    # One thin row for each different id and text: who follows whom.
    thin = cut(rows.select("key", "doc_id", "mark", F.char_length("text").alias("n_chars")).groupBy("key", "doc_id", "mark", "n_chars").agg(F.count(F.lit(1)).alias("c")))
    placed = ranked(thin.withColumn("tree", F.lit("")), "tree", ["doc_id", "mark"])
    after = placed.select(F.col("key").alias("next"), F.pmod(F.col("pos") - 1, F.col("n")).alias("pos"), "n")
    links = cut(placed.join(after.drop("n"), "pos").select("key", "next", "doc_id", "n_chars", "c"))
    # A text meets what it must give to the one before it, so only the halves that are needed move a second time.
    gives = links.select(F.col("next").alias("key"), F.col("key").alias("to"), F.expr("n_chars div 2").alias("half"))
    texts = rows.groupBy("key").agg(F.first("text").alias("text"))
    given = texts.join(gives, "key").select(F.col("to").alias("key"), F.expr("left(text, half)").alias("tail"))
    whole = texts.join(links, "key").join(given, "key")
    head = F.expr("left(text, n_chars - n_chars div 2)")
    own = F.struct(F.lit(0).cast("byte").alias("which"), F.col("text").alias("text"))
    edited = F.struct(F.lit(1).cast("byte").alias("which"), F.concat(head, F.col("tail")).alias("text"))
    again = F.struct(F.lit(2).cast("byte").alias("which"), F.concat(head, F.expr("left(text, n_chars div 2)")).alias("text"))
    forms = whole.select("key", F.explode(F.when(F.col("c") > 1, F.array(own, edited, again)).otherwise(F.array(own, edited))).alias("f")).select("key", "f.which", "f.text")
    made = cut(fingerprints(forms, ["key", "which"], words))
    one = made.groupBy("key").agg(*[F.max(F.when(F.col("which") == w, F.col(c))).alias(f"{c}{w}") for w in (0, 1, 2) for c in ("fingerprint", "sha")])
    full = links.join(one, "key")
    nexts = made.where("which = 0").select(F.col("key").alias("next"), F.col("fingerprint").alias("_next"))
    full = full.join(nexts, "next")
    # All but the last of rows that repeat are followed by their own text.
    batch = 4096
    last = full.select("doc_id", "n_chars", F.col("sha1").alias("edited_sha256"), F.col("fingerprint0").alias("fingerprint"), F.col("fingerprint1").alias("edited_fingerprint"), "_next")
    rest = full.where("c > 1").withColumn("c", F.col("c") - 1).withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.expr(f"(c + {batch - 1}) div {batch}")))).withColumn("_i", F.explode(_copies(batch)))
    rest = rest.select("doc_id", "n_chars", F.col("sha2").alias("edited_sha256"), F.col("fingerprint0").alias("fingerprint"), F.col("fingerprint2").alias("edited_fingerprint"), F.col("fingerprint0").alias("_next"))
    every = last.unionByName(rest)
    near = lambda other: likeness(F.col("fingerprint"), F.col(other))
    return every.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("_next").alias("near_next"))
