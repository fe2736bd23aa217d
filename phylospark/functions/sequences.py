"""Row functions over nucleotide and protein sequences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Standard genetic code. Amino acids of the codons in the order of BASES, first base slowest.
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: Nucleotide codes and their complements.
CODES, COMPLEMENTS = "ACGTUNRYSWKMBVDHacgtunryswkmbvdh", "TGCAANYRSWMKVBHDtgcaanyrswmkvbhd"


def _codon_index() -> np.ndarray:
    index = np.full(256, 64, np.int64)
    for i, base in enumerate(BASES):
        index[[ord(base), ord(base.lower())]] = i
    index[[ord("U"), ord("u")]] = 0
    return index


def translate_sequence(seq: str) -> str:
    """First-frame translation; a trailing part of a codon is ignored, codons with other letters give X."""
    index = _codon_index()[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
    codons = index[: len(index) // 3 * 3].reshape(-1, 3)
    number = np.where((codons < 64).all(axis=1), codons @ np.array([16, 4, 1]), 64)
    return np.frombuffer((AMINO_ACIDS + "X").encode(), np.uint8)[number].tobytes().decode()


def translate_all(seqs: list[str]) -> list[str]:
    """``translate_sequence`` of each, all codons looked up at once: short sequences cost little more than their letters."""
    whole = [x[: len(x) // 3 * 3] for x in seqs]
    proteins = translate_sequence("".join(whole))
    ends = np.cumsum([len(x) // 3 for x in whole]).tolist()
    return [proteins[i:j] for i, j in zip([0, *ends], ends)]


@F.pandas_udf(StringType())
def translate(seqs: pd.Series) -> pd.Series:
    """Protein of each nucleotide sequence; null stays null."""
    made = pd.Series([None] * len(seqs), dtype=object)
    there = seqs.notna().to_numpy()
    made[there] = translate_all(seqs[there].tolist())
    return made


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), CODES, COMPLEMENTS)


#: Letters that a tile begins with, and tiles of a piece.
TILE, PIECE = 1 << 16, 64


def spread(tiled: DataFrame) -> DataFrame:
    """Tiles dealt evenly, so that what is made of one long sequence is made by many tasks."""
    return tiled.repartition(int(tiled.sparkSession.conf.get("spark.sql.shuffle.partitions")), "seq_id", "offset")


def tiles(seqs: DataFrame, overlap: int, size: int = TILE) -> DataFrame:
    """Sequences as rows of bounded length: ``offset`` (from 0) and ``seq``, ``size`` letters and ``overlap`` more that begin the next tile.

    Every stretch of ``overlap + 1`` letters begins in one tile alone. Long
    sequences are first cut into pieces of ``PIECE`` tiles, as every cut reads
    its text from the start. Empty sequences have one tile, null ones none.
    """
    whole = seqs.where("seq is not null").withColumn("_n", F.length("seq"))
    pieces = whole.withColumn("_from", F.explode(F.sequence(F.lit(0), F.greatest(F.col("_n") - 1, F.lit(0)), F.lit(size * PIECE)))).withColumn("seq", F.substring(F.col("seq"), F.col("_from") + 1, F.lit(size * PIECE + overlap)))
    own = F.least(F.lit(size * PIECE), F.greatest(F.col("_n") - F.col("_from"), F.lit(1)))
    made = pieces.withColumn("_at", F.explode(F.sequence(F.lit(0), own - 1, F.lit(size))))
    return made.withColumns({"offset": F.col("_from") + F.col("_at"), "seq": F.substring(F.col("seq"), F.col("_at") + 1, F.lit(size + overlap))}).drop("_n", "_from", "_at")


def six_frame_tiles(seqs: DataFrame, size: int = TILE) -> DataFrame:
    """The six frames of long sequences as rows of bounded length: ``frame``, ``offset`` (from 0, in amino acids of the frame) and ``seq``.

    A frame's tiles, in the order of their offsets, are the protein that
    ``six_frames`` gives; empty tiles are left out.
    """
    step = max(1, size // 3) * 3
    made = spread(tiles(seqs.withColumn("_len", F.length("seq")), 2, step))
    frames = [F.struct(F.lit(f).alias("frame"), F.floor(F.col("offset") / 3).alias("offset"), F.substring(F.col("seq"), F.lit(f), F.lit(step)).alias("s")) for f in (1, 2, 3)]
    for f in (1, 2, 3):
        # Read backwards, a frame's codons end f - 1 letters before the end, so forwards they begin at what is left of that by threes.
        last = F.col("_len") - (f - 1)
        first = F.pmod(last, F.lit(3))
        letters = F.greatest(F.lit(0), F.least(F.lit(step), last - F.col("offset") - first))
        frames.append(F.struct(F.lit(-f).alias("frame"), F.floor((last - F.col("offset") - first - letters) / 3).alias("offset"), reverse_complement(F.substring(F.col("seq"), first + 1, letters)).alias("s")))
    out = made.withColumn("_f", F.explode(F.array(*frames)))
    return out.withColumns({"frame": F.col("_f.frame"), "offset": F.col("_f.offset"), "seq": translate("_f.s")}).where("seq <> ''").drop("_f", "_len")


def translated_tiles(seqs: DataFrame, size: int = TILE) -> DataFrame:
    """First-frame translation of long sequences as rows of bounded length: ``offset`` (from 0, in amino acids) and ``seq``."""
    step = max(1, size // 3) * 3
    made = spread(tiles(seqs, 0, step))
    return made.withColumns({"offset": F.floor(F.col("offset") / 3), "seq": translate("seq")}).where("seq <> ''")


def translate_seqs(seqs: DataFrame) -> DataFrame:
    """SEQS of nucleotides to SEQS of proteins."""
    return seqs.withColumn("seq", translate("seq"))


def six_frames(seqs: DataFrame) -> DataFrame:
    """Six translations of each sequence, with ``frame`` 1, 2, 3 forwards and -1, -2, -3 on the other strand."""
    both = F.array(
        *[F.struct(F.lit(f).alias("frame"), F.expr(f"substr(seq, {f})").alias("s")) for f in (1, 2, 3)],
        *[F.struct(F.lit(-f).alias("frame"), F.substring(reverse_complement(F.col("seq")), f, 2**31 - 1).alias("s")) for f in (1, 2, 3)],
    )
    made = seqs.withColumn("_f", F.explode(both))
    return made.withColumns({"frame": F.col("_f.frame"), "seq": translate("_f.s")}).drop("_f")


def kmer_rows(seqs: DataFrame, k: int, letters: str | None = None) -> DataFrame:
    """A row for each k-mer of each sequence, with ``at`` (from 0) and ``kmer`` in place of ``seq``; with ``letters``, of these letters alone.

    Places are exploded and k-mers cut from bytes, which takes no scan of the
    sequence and stays in compiled code; only where a letter has several bytes
    are they cut from the string. K-mers of a sequence that has no other letters
    are not looked at again.
    """

    def plain(text: str) -> Column:
        return F.translate(text, letters, "") == "" if letters else F.lit(True)

    kept = [c for c in seqs.columns if c != "seq"]
    one_byte = F.octet_length("seq") == F.length("seq")
    long_enough = seqs.where(F.length("seq") >= k)
    ready = long_enough.select(*kept, F.col("seq").cast("binary").alias("_bytes"), F.when(~one_byte, F.col("seq")).alias("_wide"), plain("seq").alias("_plain"), (F.length("seq") - k).alias("_last"))
    places = ready.select(*kept, "_bytes", "_wide", "_plain", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("at"))
    cut_out = lambda c: F.substring(F.col(c), F.col("at") + 1, F.lit(k))
    made = places.select(*kept, "at", F.when(F.col("_wide").isNull(), cut_out("_bytes").cast("string")).otherwise(cut_out("_wide")).alias("kmer"), "_plain")
    return (made.where(F.col("_plain") | plain("kmer")) if letters else made).drop("_plain")
