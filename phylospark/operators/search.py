"""Similarity search of sequences against sequences: a seed join, then ungapped extension with a drop-off.

Sequences that share k-mers meet on them. On every diagonal of a pair with
enough shared k-mers each seed is extended both ways until the score falls too
far below its best, so two good stretches with a bad one between are two hits.
Nucleotides score by match and mismatch, proteins by BLOSUM62, and e-values
follow from Karlin-Altschul statistics. Letters have no case; a letter that is
no nucleotide (no amino acid) is never a match and in no seed. Segments are the
same in both directions, so a reciprocal search makes them once.

K-mers come from tiles of bounded length. Those that stand at very many places
are found by a frequency sketch, and their rows are dealt over as many parts as
that takes on either side, so none is one task's.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phylospark.functions.sequences import TILE, kmer_rows, six_frames, spread, tiles
from phylospark.operators.hits import reciprocal_best
from phylospark.shared import cut

#: Nucleotide presets: match, mismatch, the constant K of these scores, and k.
NUCLEOTIDES = {"dna": (1.0, -3.0, 0.711, 11), "similar_dna": (1.0, -2.0, 0.621, 28)}
#: BLOSUM62's order of amino acids and lower triangle, its constants lambda and K without gaps; and k.
AMINO_ACIDS = "ARNDCQEGHILKMFPSTWYV"
BLOSUM62 = """
4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
"""
PROTEIN_LAMBDA, PROTEIN_K, PROTEIN_WORD = 0.3176, 0.134, 5
#: Scores of a stop with another letter, and of other letters.
STOP, UNKNOWN = -4.0, -1.0
#: How far, in bits, the score may fall below its best before an extension ends.
DROP_BITS = {"dna": 20.0, "similar_dna": 20.0, "protein": 7.0}
#: Letters around the seeds of a diagonal that are read at first; extensions that need more read the whole diagonal.
MARGIN = 2000
#: A k-mer with more than this share of a side's rows, and at least so many, is split; the sketch finds up to so many of them.
SHARE, HOT_ROWS, SKETCHED = 1000, 1000, 2000
#: Up to so many k-mers of the queries (some 100 bytes each) are sent to every executor.
SENT_KMERS = 500_000
#: Up to so many ids of subjects with seeds (some 100 bytes each) are sent to every executor.
SENT_IDS = 500_000
#: Of an index: letters that rows begin alike in, by letters of the alphabet; letters and gaps of a block, whose places are three bytes.
HEAD, BLOCK = {4: 8, 20: 3}, 1 << 22
#: Of an index: of so many places at most one is in it; a factor for how many letters (fewer than 8) are on its two sides; lookups of a row that go there at once; up to so many pairs of these and its places are all compared.
STEP, COUNTS, LOOKED_UP, COMPARED = 7, 64, 1000, 1 << 13
#: Different k-mers that a task counts before it sends its sums.
COUNTED_AT_ONCE = 500_000


def score_scale(letters: int, match: float, mismatch: float) -> float:
    """The lambda at which scores of random letters have mean exponential one."""
    p, lo, hi = 1 / letters, 1e-6, 50.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if p * math.exp(mid * match) + (1 - p) * math.exp(mid * mismatch) > 1:
            hi = mid
        else:
            lo = mid
    return lo


def letters_of(alphabet: str) -> str:
    return "ACGT" if alphabet in NUCLEOTIDES else AMINO_ACIDS


def score_table(alphabet: str) -> tuple[np.ndarray, float, float, int]:
    """Scores of each pair of bytes, lambda, K and the default k; only letters of the alphabet match."""
    if alphabet in NUCLEOTIDES:
        match, mismatch, big_k, k = NUCLEOTIDES[alphabet]
        table = np.full((256, 256), mismatch)
        for c in letters_of(alphabet):
            table[ord(c), ord(c)] = match
        return table, score_scale(4, match, mismatch), big_k, k
    if alphabet != "protein":
        raise ValueError(f"unknown alphabet: {alphabet}")
    table = np.full((256, 256), UNKNOWN)
    table[ord("*")], table[:, ord("*")] = STOP, STOP
    table[ord("*"), ord("*")] = 1.0
    for i, line in enumerate(BLOSUM62.split("\n")[1:-1]):
        for j, value in enumerate(line.split()):
            for a, b in ((i, j), (j, i)):
                table[ord(AMINO_ACIDS[a]), ord(AMINO_ACIDS[b])] = float(value)
    return table, PROTEIN_LAMBDA, PROTEIN_K, PROTEIN_WORD


def plain_letters(seqs: DataFrame, alphabet: str) -> DataFrame:
    """Sequences in capitals; for nucleotides U is T."""
    upper = F.upper("seq")
    return seqs.withColumn("seq", F.translate(upper, "U", "T") if alphabet in NUCLEOTIDES else upper)


def kmer_index(seqs: DataFrame, k: int, max_df: int | None = None, keep: list[str] = (), letters: str | None = None) -> DataFrame:
    """``seq_id, kmer, kpos`` (from 0); k-mers in more than ``max_df`` sequences are left out.

    ``letters`` leaves out k-mers that hold others. ``max_df`` is a sensitivity
    setting, as in other seed searches; None keeps all. Sequences are read tile
    by tile, so one of any length makes no long array, and tiles are dealt over
    all tasks: they are a fraction of what their k-mers are.
    """
    tiled = spread(tiles(seqs.select("seq_id", *keep, "seq"), k - 1))
    index = kmer_rows(tiled, k, letters).select("seq_id", *keep, "kmer", (F.col("offset") + F.col("at")).alias("kpos"))
    if max_df is None:
        return index
    frequent = index.select("seq_id", "kmer").distinct().groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_df)
    return index.join(frequent, "kmer", "left_anti").select("seq_id", *keep, "kmer", "kpos")


def kmer_frequency(seqs: DataFrame, k: int) -> DataFrame:
    """``kmer, sequences, places``: in how many sequences a k-mer is, and how often.

    Tasks count their sequences' k-mers and send sums; only where many tasks
    share an id, of several tiles or rows, does each k-mer go out by sequence.
    Rows without an id are places, but no sequence.
    """

    def counted(batches):
        whole: dict[str, list[int]] = {}
        for b in batches:
            for seq_id, seq, alone in zip(b["seq_id"], b["seq"], b["_alone"]):
                found = Counter(seq[i : i + k] for i in range(len(seq) - k + 1))
                if not alone:
                    yield rows_of(list(found), seq_id, 1, list(found.values()))
                    continue
                for kmer, n in found.items():
                    sums = whole.setdefault(kmer, [0, 0])
                    sums[0] += seq_id is not None
                    sums[1] += n
                if len(whole) >= COUNTED_AT_ONCE:
                    yield sums_of(whole)
                    whole = {}
        yield sums_of(whole)

    def sums_of(whole):
        return rows_of(list(whole), None, [x for x, _ in whole.values()], [x for _, x in whole.values()])

    def rows_of(kmers, seq_id, sequences, places):
        made = pd.DataFrame({"kmer": kmers, "seq_id": seq_id, "sequences": sequences, "places": places}, dtype=object)
        return made.astype({"sequences": "int64", "places": "int64"})

    seqs = cut(seqs.select("seq_id", "seq"))
    shared = seqs.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("seq")).alias("most")).where((F.col("n") > 1) | (F.col("most") > TILE))
    marked = seqs.join(shared.select("seq_id", F.lit(False).alias("_alone")), "seq_id", "left").withColumn("_alone", F.coalesce("_alone", F.lit(True)))
    made = spread(tiles(marked, k - 1)).select("seq_id", "seq", "_alone").mapInPandas(counted, f"kmer string, seq_id {seqs.schema['seq_id'].dataType.simpleString()}, sequences long, places long")
    sequences = F.when(F.col("seq_id").isNull(), F.sum("sequences")).otherwise(F.lit(1).cast("long"))
    by_sequence = made.groupBy("kmer", "seq_id").agg(sequences.alias("sequences"), F.sum("places").alias("places"))
    return by_sequence.groupBy("kmer").agg(F.sum("sequences").alias("sequences"), F.sum("places").alias("places"))


def common_kmers(index: DataFrame, share: int = SHARE, least: int = HOT_ROWS) -> dict[str, int]:
    """K-mers with more than one of ``share`` rows, and into how many parts each is to be split.

    A frequency sketch in each task, merged: no exchange of k-mers. What it
    misses has a smaller share than it is asked for.
    """
    row = index.agg(F.expr(f"approx_top_k(kmer, {SKETCHED}, {8 * SKETCHED})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    return {x["item"]: -(-x["count"] * share // row["n"]) for x in row["top"] or [] if x["count"] >= least and x["count"] * share > row["n"]}


def seed_join(q: DataFrame, s: DataFrame, share: int = SHARE, least: int = HOT_ROWS) -> DataFrame:
    """Rows of both sides that share a k-mer; a common k-mer's rows are dealt over parts, each met by the other side's copies."""
    left, right = common_kmers(q, share, least), common_kmers(s, share, least)
    if not left and not right:
        return q.join(s, "kmer")
    rows = [(kmer, left.get(kmer, 1), right.get(kmer, 1)) for kmer in sorted({*left, *right})]
    # At most 2 * SKETCHED rows.
    hot = F.broadcast(q.sparkSession.createDataFrame(rows, "kmer string, _l int, _r int"))

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        part = F.pmod(F.xxhash64(*[c for c in side.columns if c != "kmer"]), F.coalesce(own, F.lit(1))).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        return side.join(hot, "kmer", "left").withColumns({f"{own}_": part}).withColumn(f"{other}_", copies).drop("_l", "_r")

    return dealt(q, "_l", "_r").join(dealt(s, "_r", "_l"), ["kmer", "_l_", "_r_"]).drop("_l_", "_r_")


def few(queries: DataFrame) -> bool:
    """Whether the k-mers of sequences, no more than their letters, may go to every executor."""
    return (queries.agg(F.sum(F.length("seq"))).first()[0] or 0) <= SENT_KMERS


def met_seeds(q: DataFrame, s: DataFrame, send: bool) -> DataFrame:
    """Rows of both sides that share a k-mer: with the queries' sent to every task, so the subjects' k-mers meet them where they are made, or by ``seed_join``."""
    return s.join(F.broadcast(q), "kmer") if send else seed_join(q, s)


def seed_pairs(queries: DataFrame, subjects: DataFrame, k: int, min_seeds: int = 1, max_df: int | None = None) -> DataFrame:
    """``queryid, subjectid, seeds, diag, diag_seeds`` of pairs with at least ``min_seeds`` distinct shared k-mers.

    ``diag`` (subject place minus query place) is the diagonal with most shared
    k-mers, the least of those that tie. One join is grouped both by diagonal
    and by k-mer.
    """
    queries, subjects = cut(queries.select("seq_id", "seq")), cut(subjects.select("seq_id", "seq"))
    q = kmer_index(queries, k).select(F.col("seq_id").alias("queryid"), "kmer", F.col("kpos").alias("qpos"))
    s = kmer_index(subjects, k, max_df).select(F.col("seq_id").alias("subjectid"), "kmer", F.col("kpos").alias("spos"))
    return pairs_of_seeds(met_seeds(q, s, few(queries)), min_seeds)


def pairs_of_seeds(met: DataFrame, min_seeds: int) -> DataFrame:
    rows = met.select("queryid", "subjectid", "kmer", (F.col("spos") - F.col("qpos")).alias("diag"))
    both = rows.groupingSets([["queryid", "subjectid", "diag"], ["queryid", "subjectid", "kmer"]], "queryid", "subjectid", "diag", "kmer").agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.when(F.col("diag").isNotNull(), F.struct("n", (-F.col("diag")).alias("d"))))
    joined = both.groupBy("queryid", "subjectid").agg(best.alias("b"), F.count("kmer").alias("seeds")).where(F.col("seeds") >= min_seeds)
    return joined.select("queryid", "subjectid", "seeds", (-F.col("b.d")).cast("int").alias("diag"), F.col("b.n").alias("diag_seeds"))


def _walk(scores: np.ndarray, drop: float) -> tuple[float, int, int]:
    """Best sum of a beginning of ``scores``, its length (the least of those that tie), and how many are looked at until the sum is more than ``drop`` below its best."""
    total, taken, best, length = 0.0, 0, 0.0, 0
    while taken < len(scores):
        sums = total + np.cumsum(scores[taken : taken + max(64, taken)])
        tops = np.maximum(np.maximum.accumulate(sums), best)
        fallen = np.flatnonzero(tops - sums > drop)
        seen = int(fallen[0]) + 1 if len(fallen) else len(sums)
        at = int(sums[:seen].argmax())
        if sums[at] > best:
            best, length = float(sums[at]), taken + at + 1
        taken += seen
        if len(fallen):
            break
        total = float(sums[-1])
    return best, length, taken


def extend_seeds(query: str, subject: str, table: np.ndarray, letters: str, k: int, drop: float, more_left: bool = False, more_right: bool = False) -> tuple[list[tuple[float, int, int, int]], bool]:
    """Segments (score, start, end, equal letters) of two stretches side by side, and whether an extension came to an end beyond which there is more.

    Seeds are k equal letters in a row. They are taken from left to right; one
    that the extension before it has looked at is passed over. An extension to
    the left ends before the segment before it, as what ended that one is a
    fall of more than ``drop`` from there.
    """
    q = np.frombuffer(query.encode("ascii", "replace"), np.uint8)
    s = np.frombuffer(subject.encode("ascii", "replace"), np.uint8)
    same = (q == s) & np.isin(q, np.frombuffer(letters.encode(), np.uint8))
    equal = np.r_[0, np.cumsum(same)]
    seeds = np.flatnonzero(equal[k:] - equal[:-k] == k) if len(q) >= k else np.array([], int)
    scores, found, reach, beyond = table[q, s], [], -1, False
    while True:
        rest = int(np.searchsorted(seeds, reach, side="right"))
        if rest == len(seeds):
            return found, beyond
        p = int(seeds[rest])
        right, ahead, seen = _walk(scores[p:], drop)
        left, back, behind = _walk(scores[:p][::-1], drop)
        beyond |= (more_right and p + seen == len(q)) or (more_left and behind == p)
        found.append((right + left, p - back, p + ahead, int(equal[p + ahead] - equal[p - back])))
        reach = p + seen - 1


def segments(queries: DataFrame, subjects: DataFrame, alphabet: str, k: int | None, min_seeds: int, max_df: int | None, at: list[str], index: DataFrame | None = None) -> DataFrame:
    """Extended seeds of every diagonal on which a query and a subject share at least ``min_seeds`` k-mers; written.

    ``at`` are the subjects' columns that tell lists apart; ids must be unique
    within a list. Only the stretches around the seeds go to Python, cut out of
    the sequences where these are joined; ``index`` is a lasting index of the
    subjects, if there is one.
    """
    _, _, _, default_k = score_table(alphabet)
    word = k or default_k
    letters = letters_of(alphabet)
    queries, subjects = plain_letters(queries, alphabet), plain_letters(subjects, alphabet)
    q = kmer_index(queries, word, letters=letters).select(F.col("seq_id").alias("queryid"), "kmer", F.col("kpos").alias("qpos"))
    if index is None:
        s = kmer_index(subjects, word, max_df, at, letters).select(*at, F.col("seq_id").alias("subjectid"), "kmer", F.col("kpos").alias("spos"))
        met = met_seeds(q, s, few(queries))
    else:
        met = indexed_seeds(q, index)
    diagonals = met.groupBy(*at, "queryid", "subjectid", (F.col("spos") - F.col("qpos")).alias("diag")).agg(F.count(F.lit(1)).alias("n"), F.min("qpos").alias("lo"), F.max("qpos").alias("hi")).where(F.col("n") >= min_seeds).drop("n")
    diagonals = cut(diagonals)
    near = cut(_extended(diagonals, queries, subjects, alphabet, word, at, MARGIN))
    names = [*at, "queryid", "subjectid", "diag"]
    open_ended = near.where("beyond").select(*names).distinct()
    if open_ended.limit(1).count():
        far = _extended(diagonals.join(open_ended, names, "left_semi"), queries, subjects, alphabet, word, at, 1 << 30)
        near = cut(near.join(open_ended, names, "left_anti").unionByName(far))
    return near.drop("beyond")


def _extended(diagonals: DataFrame, queries: DataFrame, subjects: DataFrame, alphabet: str, k: int, at: list[str], margin: int) -> DataFrame:
    table, scale, _, _ = score_table(alphabet)
    letters, drop = letters_of(alphabet), DROP_BITS[alphabet] * math.log(2) / scale

    @F.pandas_udf("struct<beyond: boolean, found: array<struct<score: double, start: int, end: int, matches: int>>>")
    def extend(q: pd.Series, s: pd.Series, more_left: pd.Series, more_right: pd.Series) -> pd.DataFrame:
        made = [extend_seeds(*x[:2], table, letters, k, drop, *x[2:]) for x in zip(q, s, more_left, more_right)]
        return pd.DataFrame({"beyond": [b for _, b in made], "found": [[dict(zip(("score", "start", "end", "matches"), x)) for x in f] for f, _ in made]})

    ids = diagonals.select(*at, F.col("subjectid").alias("seq_id")).distinct()
    if ids.count() <= SENT_IDS:
        # Only sequences that have seeds are exchanged.
        subjects = subjects.join(F.broadcast(ids), [*at, "seq_id"], "left_semi")
    bounded = diagonals.join(queries.select(F.col("seq_id").alias("queryid"), F.col("seq").alias("_q")), "queryid")
    least = F.greatest(F.lit(0), -F.col("diag"))
    bounded = bounded.select(*at, "queryid", "subjectid", "diag", least.alias("least"), F.length("_q").alias("qlen"), F.greatest(least, F.col("lo") - margin).alias("first"), "_q", "hi")
    clipped = bounded.withColumn("_q", F.substring(F.col("_q"), F.col("first") + 1, F.least(F.col("qlen").cast("long"), F.col("hi") + k + margin).cast("int") - F.col("first"))).drop("hi")
    met = clipped.join(subjects.select(*at, F.col("seq_id").alias("subjectid"), F.col("seq").alias("_s")), [*at, "subjectid"]).withColumn("slen", F.length("_s"))
    met = met.withColumn("_s", F.substring(F.col("_s"), F.col("first") + F.col("diag") + 1, F.length("_q")))
    met = met.withColumn("_q", F.substring(F.col("_q"), F.lit(1), F.length("_s")))
    ends = F.col("first") + F.length("_s") < F.least(F.col("qlen"), F.col("slen") - F.col("diag"))
    made = met.withColumn("e", extend("_q", "_s", F.col("first") > F.col("least"), ends)).drop("_q", "_s", "least")
    made = made.select(*at, "queryid", "subjectid", "diag", "first", "qlen", "slen", F.col("e.beyond").alias("beyond"), F.explode("e.found").alias("e"))
    return made.select(
        *at, "queryid", "subjectid", "diag", "qlen", "slen", "beyond", F.col("e.score").alias("score"), (F.col("e.end") - F.col("e.start")).alias("alignmentlength"), F.col("e.matches").alias("matches"),
        (F.col("first") + F.col("e.start") + 1).alias("qstart"), (F.col("first") + F.col("e.end")).alias("qend"),
        (F.col("first") + F.col("diag") + F.col("e.start") + 1).alias("sstart"), (F.col("first") + F.col("diag") + F.col("e.end")).alias("send"),
    )


def _cells(whole: bytes, letters: str) -> np.ndarray:
    """The number of each letter, -1 for others."""
    index = np.full(256, -1, np.int64)
    index[np.frombuffer(letters.encode(), np.uint8)] = np.arange(len(letters))
    return index[np.frombuffer(whole, np.uint8)]


def _number(columns: list[np.ndarray], base: int, rows: int) -> np.ndarray:
    made = np.zeros(rows, np.int64)
    for x in columns:
        made = made * base + x
    return made


def _layout(k: int, letters: str) -> tuple[int, int, np.dtype]:
    """Letters of the head, every which place is in the index, and the type of an entry's number."""
    base, head = len(letters), min(k, HEAD[len(letters)])
    for step in range(min(STEP, k - head + 1), 0, -1):
        most = base ** (k + step - 1 - head) * (COUNTS if step > 1 else 1)
        if most < 1 << 63:
            return head, step, np.dtype("<u1" if most <= 1 << 8 else "<u2" if most <= 1 << 16 else "<u4" if most <= 1 << 32 else "<u8")
    raise ValueError(f"an index has no k-mers of {k} letters")


def _entries(whole: bytes, k: int, letters: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of an index, each by its number among the steps, and their heads and numbers.

    A k-mer holds just one place of a step, and the word of ``k - step + 1``
    letters that begins there. An entry's number has the word's letters after
    its head and those that a k-mer may have on either side, and how many of
    these there are before another letter or an end.
    """
    head, step, _ = _layout(k, letters)
    word, side = k - step + 1, step - 1
    cells = np.r_[np.full(side, -1), _cells(whole, letters), np.full(side, -1)]
    bad = np.r_[0, np.cumsum(cells < 0)]
    at = np.arange(side, len(cells) - side - word + 1, step)
    at = at[bad[at + word] == bad[at]]
    first = _number([cells[at + i] for i in range(head)], len(letters), len(at))
    left = [cells[at - i] for i in range(1, step)]
    right = [cells[at + word + i] for i in range(side)]
    rest = _number([*[np.maximum(x, 0) for x in left[::-1]], *[cells[at + i] for i in range(head, word)], *[np.maximum(x, 0) for x in right]], len(letters), len(at))
    if step > 1:
        for x in (left, right):
            rest = rest * 8 + np.cumprod(np.array(x) >= 0, axis=0).sum(axis=0)
    return (at - side) // step, first, rest


def _lookups(kmers: list[str], letters: str) -> tuple[np.ndarray, np.ndarray]:
    """For k-mers of one length, by how far before a place they begin: the head there, -1 if a letter is another one, and the other letters as a number."""
    k = len(kmers[0])
    head, step, _ = _layout(k, letters)
    cells = _cells("".join(kmers).encode("ascii", "replace"), letters).reshape(-1, k)
    heads, rests = np.zeros((2, len(cells), step), np.int64)
    for o in range(step):
        heads[:, o] = np.where((cells >= 0).all(axis=1), _number([cells[:, i] for i in range(o, o + head)], len(letters), len(cells)), -1)
        rests[:, o] = _number([cells[:, i] for i in range(k) if not o <= i < o + head], len(letters), len(cells))
    return heads, rests


def _found(k: int, letters: str, rests: np.ndarray, shifts: np.ndarray, held: bytes) -> np.ndarray:
    """Which lookup meets which place of an index row: the lookup's number times 2**32 and where its k-mer begins in the block."""
    head, step, kind = _layout(k, letters)
    base, side, n = len(letters), step - 1, len(held) // (kind.itemsize + 3)
    numbers = np.frombuffer(held, kind, n).astype(np.int64)
    cells = np.frombuffer(held, np.uint8, offset=n * kind.itemsize).reshape(-1, 3).astype(np.int64)
    places = (cells @ np.array([1, 1 << 8, 1 << 16])) * step
    left = right = np.zeros(n, np.int64)
    if step > 1:
        numbers, left, right = numbers // COUNTS, numbers // 8 % 8, numbers % 8
    if len(rests) * n <= COMPARED:
        seen = numbers % np.int64(base) ** (k - head + shifts)[:, None] // np.int64(base) ** shifts[:, None]
        i, j = np.nonzero((seen == rests[:, None]) & (left >= shifts[:, None]) & (right >= side - shifts[:, None]))
        return (i << 32) + places[j] - shifts[i]
    made = []
    for o in np.unique(shifts).tolist():
        own = np.flatnonzero(shifts == o)
        there = np.flatnonzero((left >= o) & (right >= side - o))
        seen = numbers[there] % base ** (k - head + o) // base**o
        order = np.argsort(seen, kind="stable")
        lo, hi = (np.searchsorted(seen[order], rests[own], side=x) for x in ("left", "right"))
        sizes = hi - lo
        if sizes.any():
            met = np.arange(sizes.sum()) + np.repeat(lo - np.cumsum(sizes) + sizes, sizes)
            made.append((np.repeat(own, sizes) << 32) + places[there[order[met]]] - o)
    return np.concatenate(made) if made else np.zeros(0, np.int64)


def build_index(subjects: DataFrame, table: str, k: int, alphabet: str = "dna", max_df: int | None = None, keep: list[str] = (), buckets: int = 64) -> DataFrame:
    """A lasting index of the subjects' k-mers: a table of the session's catalog, bucketed and sorted by their first letters.

    Tiles are laid out in blocks, and exchanged for that only if a sequence is
    longer than a block. Of every ``STEP`` places one is in the index,
    with the letters around it that tell all k-mers which hold it (see
    ``_entries``). A row holds all places of a block whose words begin alike
    (``head``): the other letters of each as a number, and the place in three
    bytes, so with k = 14 a k-mer takes one byte where it is exchanged and where
    it is written. Rows without ``head`` say which tile begins where in its block,
    and which k-mers ``max_df`` leaves out. Searches join the table bucket by
    bucket, so it is neither exchanged nor sorted again.
    """
    letters = letters_of(alphabet)
    _, _, kind = _layout(k, letters)
    # Read from files, so that a task that runs again makes the same blocks.
    plain = _written(plain_letters(subjects, alphabet), keep)
    tiled = tiles(plain, k - 1)
    if (plain.agg(F.max(F.length("seq"))).first()[0] or 0) > BLOCK:
        tiled = cut(spread(tiled), compression="zstd")

    def blocks(batches):
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            for row in b.itertuples(index=False, name=None):
                if held and size + len(row[-1]) + 1 > BLOCK:
                    yield block(f"{task}-{number}", held)
                    number, held, size = number + 1, [], 0
                held.append(row)
                size += len(row[-1]) + 1
        if held:
            yield block(f"{task}-{number}", held)

    def block(name, held):
        texts = [x[-1].encode("ascii", "replace") for x in held]
        starts = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
        # What stands between tiles is no letter.
        places, first, rest = _entries(b"?".join(texts), k, letters)
        order = np.argsort(first, kind="stable")
        first, rest, places = first[order], rest[order].astype(kind), places[order].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
        heads, at = np.unique(first, return_index=True)
        seeds = [rest[i:j].tobytes() + places[i:j].tobytes() for i, j in zip(at.tolist(), [*at[1:].tolist(), len(first)])]
        own = len(held)
        made = {"head": [None] * own + heads.tolist(), "block": name, "seeds": [None] * own + seeds, "start": starts.tolist() + [None] * len(seeds), "first": [x[-2] for x in held] + [None] * len(seeds)}
        made |= {c: [x[i] for x in held] + [None] * len(seeds) for i, c in enumerate(["subjectid", *keep])}
        out = pd.DataFrame({c: pd.Series(v, dtype=object) if isinstance(v, list) else v for c, v in made.items()})
        return out.astype({"head": "Int64", "start": "Int64", "first": "Int64", "block": object})

    kinds = ", ".join(f"`{c}` {tiled.schema[n].dataType.simpleString()}" for c, n in (("subjectid", "seq_id"), *[(c, c) for c in keep]))
    rows = tiled.select("seq_id", *keep, "offset", "seq").mapInPandas(blocks, f"head long, block string, seeds binary, start long, first long, {kinds}")
    rows = rows.withColumns({"letters": F.when(F.col("head").isNull(), F.lit(letters)), "kmer": F.lit(None).cast("string")})
    if max_df is not None:
        index = kmer_rows(tiled, k, letters)
        frequent = index.select("seq_id", "kmer").distinct().groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_df)
        rows = rows.unionByName(frequent.select("kmer", F.lit(letters).alias("letters")), allowMissingColumns=True)
    rows.repartition(buckets, "head").write.bucketBy(buckets, "head").sortBy("head").option("compression", "zstd").mode("overwrite").saveAsTable(table)
    return subjects.sparkSession.table(table)


def indexed_seeds(q: DataFrame, index: DataFrame) -> DataFrame:
    """The seed join against a lasting index; the different k-mers of the queries (``queryid, kmer, qpos``) go to its buckets."""
    told = index.where("head is null")
    known = told.select("letters").first()
    letters = known[0] if known else letters_of("dna")
    at = [c for c in index.columns if c not in ("head", "block", "seeds", "start", "first", "subjectid", "letters", "kmer")]

    @F.pandas_udf("array<struct<head: long, rest: long>>")
    def numbers(kmers: pd.Series) -> pd.Series:
        heads, rests = _lookups(kmers.tolist(), letters) if len(kmers) else ([], [])
        return pd.Series([[{"head": h, "rest": r} for h, r in zip(*x)] for x in zip(np.asarray(heads).tolist(), np.asarray(rests).tolist())], dtype=object)

    @F.pandas_udf("array<long>")
    def places(k: pd.Series, rests: pd.Series, shifts: pd.Series, seeds: pd.Series) -> pd.Series:
        return pd.Series([_found(int(size), letters, np.asarray(r), np.asarray(o, np.int64), held) for size, r, o, held in zip(k, rests, shifts, seeds)], dtype=object)

    wanted = q.join(told.where("kmer is not null").select("kmer"), "kmer", "left_anti")
    kmers = wanted.select("kmer").distinct().withColumn("_n", numbers("kmer")).select("kmer", F.posexplode("_n").alias("shift", "_n")).select("kmer", "shift", "_n.head", "_n.rest").where("head >= 0")
    # What is looked up in one row of the index goes there together, some at a time.
    part = F.floor((F.row_number().over(Window.partitionBy("head").orderBy("kmer", "shift")) - 1) / LOOKED_UP)
    asked = kmers.withColumn("_part", part).groupBy("head", "_part").agg(F.collect_list(F.struct("kmer", "rest", "shift")).alias("_q"))
    met = asked.join(index.where("head is not null").select("head", "block", "seeds").hint("merge"), "head")
    met = met.withColumn("_at", F.explode(places(F.length(F.col("_q.kmer")[0]), "_q.rest", "_q.shift", "seeds")))
    met = met.select(F.col("_q.kmer")[F.shiftright("_at", 32).cast("int")].alias("kmer"), "block", F.col("_at").bitwiseAND(F.lit(0xFFFFFFFF)).alias("start"))
    # A place belongs to the last tile that begins before it.
    tile = F.struct("start", "first", "subjectid", *at)
    both = told.where("block is not null").select("block", "start", tile.alias("_t")).unionByName(met, allowMissingColumns=True)
    order = Window.partitionBy("block").orderBy("start", F.col("_t").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("_t", F.last("_t", True).over(order)).where("kmer is not null")
    placed = placed.select("kmer", *[F.col(f"_t.{c}").alias(c) for c in at], F.col("_t.subjectid").alias("subjectid"), (F.col("_t.first") + F.col("start") - F.col("_t.start")).cast("int").alias("spos"))
    return wanted.join(placed, "kmer")


def _written(seqs: DataFrame, at: list[str] = ()) -> DataFrame:
    """Sequences written once, as a search reads them several times: what they are derived by is done once."""
    return cut(seqs.select(*at, "seq_id", "seq"), compression="zstd")


def _hits(found: DataFrame, evalue: float, alphabet: str, database: DataFrame, at: list[str], by: list[str]) -> DataFrame:
    """Segments as hits against the sequences of ``database``, one for each of ``by``."""
    _, scale, big_k, _ = score_table(alphabet)
    sizes = database.groupBy(*by).agg(F.sum(F.length("seq")).alias("_n"))
    full = found.join(sizes, by) if by else found.withColumn("_n", F.lit(sizes.first()[0] or 0))
    bits = (F.col("score") * scale - math.log(big_k)) / math.log(2)
    length = F.col("alignmentlength")
    return full.select(
        *at, "queryid", "subjectid", (100.0 * F.col("matches") / length).alias("pident"), length, (length - F.col("matches")).alias("mismatches"), F.lit(0).alias("gapopens"), "qstart", "qend", "sstart", "send",
        (F.col("qlen").cast("double") * F.col("_n") * F.pow(F.lit(2.0), -bits)).alias("evalue"), bits.alias("bitscore"),
    ).where(F.col("evalue") <= evalue)


def _turned(found: DataFrame) -> DataFrame:
    names = {"queryid": "subjectid", "qlen": "slen", "qstart": "sstart", "qend": "send"}
    other = names | {b: a for a, b in names.items()}
    return found.select(*[F.col(other.get(c, c)).alias(c) for c in found.columns])


def search(
    evalue: float, queries: DataFrame, subjects: DataFrame, alphabet: str = "dna", k: int | None = None, min_seeds: int = 1, max_df: int | None = None, by: list[str] | None = None,
) -> DataFrame:
    """Hits with ``evalue`` at most the cutoff, in the columns of a hit table: all diagonals of all pairs that pass.

    With ``by=['list_id']`` the subjects' lists are databases of their own, and
    ids need be unique in each only; otherwise all subjects are one database.
    """
    at = list(by or [])
    queries, subjects = _written(queries), _written(subjects, at)
    return _hits(segments(queries, subjects, alphabet, k, min_seeds, max_df, at), evalue, alphabet, subjects, at, at)


def search_rev(
    evalue: float, queries: DataFrame, subjects: DataFrame, alphabet: str = "dna", k: int | None = None, min_seeds: int = 1, max_df: int | None = None, by: list[str] | None = None,
) -> DataFrame:
    """The search with the roles of queries and subjects exchanged; with ``by`` one result for each of the subjects' lists."""
    at = list(by or [])
    queries, subjects = _written(queries), _written(subjects, at)
    return _hits(_turned(segments(queries, subjects, alphabet, k, min_seeds, max_df, at)), evalue, alphabet, queries, at, [])


def search_rbh(
    evalue: float, queries: DataFrame, subjects: DataFrame, mode: str = "best", alphabet: str = "dna", k: int | None = None, min_seeds: int = 1, max_df: int | None = None, by: list[str] | None = None,
) -> DataFrame:
    """Reciprocal best hits of the search both ways, for each of the subjects' lists if ``by`` names them; one seed join serves both."""
    at = list(by or [])
    queries, subjects = _written(queries), _written(subjects, at)
    found = segments(queries, subjects, alphabet, k, min_seeds, max_df, at)
    return reciprocal_best(_hits(found, evalue, alphabet, subjects, at, at), _hits(_turned(found), evalue, alphabet, queries, at, []), mode, by=at)


def search_index(evalue: float, queries: DataFrame, subjects: DataFrame, index: DataFrame, k: int, alphabet: str = "dna", min_seeds: int = 1, by: list[str] | None = None) -> DataFrame:
    """As ``search``, with the seeds of a lasting index (``build_index``) of these subjects, made with the same ``k``."""
    at = list(by or [])
    queries, subjects = _written(queries), _written(subjects, at)
    return _hits(segments(queries, subjects, alphabet, k, min_seeds, None, at, index), evalue, alphabet, subjects, at, at)


def translated_search(evalue: float, queries: DataFrame, subjects: DataFrame, mode: str, k: int | None = None, **options) -> DataFrame:
    """``blastx`` translates queries, ``tblastn`` subjects, ``tblastx`` both, in six frames.

    Coordinates are of the nucleotide sequences; on the other strand start is
    greater than end. All segments of all pairs of frames are hits.
    """
    sides = {"blastx": (True, False), "tblastn": (False, True), "tblastx": (True, True)}[mode]
    # Frame and length stand behind the id, whatever letters that has.
    pattern = "(?s)^(.*)\u0001(-?[0-9]+)\u0001([0-9]+)$"

    def frames(seqs: DataFrame, on: bool) -> DataFrame:
        sized = seqs.withColumn("_len", F.length("seq"))
        made = six_frames(sized) if on else sized.withColumn("frame", F.lit(0))
        return made.withColumn("seq_id", F.concat_ws("\u0001", "seq_id", "frame", "_len"))

    hits = search(evalue, frames(queries, sides[0]), frames(subjects, sides[1]), "protein", k, **options)
    for name, start, end in (("queryid", "qstart", "qend"), ("subjectid", "sstart", "send")):
        part = lambda i, name=name: F.regexp_extract(name, pattern, i)
        frame, size = part(2).cast("int"), part(3).cast("int")
        a, b = 3 * (F.col(start) - 1) + F.abs(frame), 3 * F.col(end) + F.abs(frame) - 1
        first = F.when(frame == 0, F.col(start)).when(frame > 0, a).otherwise(size - a + 1)
        last = F.when(frame == 0, F.col(end)).when(frame > 0, b).otherwise(size - b + 1)
        hits = hits.withColumns({start: first, end: last, name: part(1)})
    return hits
