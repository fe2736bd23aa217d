"""Readers: files to DataFrames with fixed schemas. A file is a list; its path is ``list_id``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylospark.sources.genbank import parse_records
from phylospark.shared import require
from phylospark.sources.schemas import CRB, FEATURES, HITS, RECORDS

#: Lines that begin so stand for an empty value.
EMPTY = "<<empty"


def _path():
    return F.col("_metadata.file_path")


def read_fasta(spark: SparkSession, paths) -> DataFrame:
    """``list_id, pos, seq_id, header, seq``; the separator is the record's own, so files split at records."""
    raw = spark.read.option("lineSep", "\n>").text(paths).select(_path().alias("list_id"), F.regexp_replace("value", r"^>", "").alias("v"), F.monotonically_increasing_id().alias("pos"))
    body = raw.where(~F.col("v").startswith(EMPTY) & (F.trim("v") != ""))
    header = F.regexp_extract("v", r"^([^\r\n]*)", 1)
    return body.select("list_id", "pos", F.regexp_extract("v", r"^\s*(\S*)", 1).alias("seq_id"), header.alias("header"), F.regexp_replace(F.regexp_replace("v", r"^[^\r\n]*", ""), r"\s", "").alias("seq"))


def _lines(spark: SparkSession, paths) -> DataFrame:
    return spark.read.text(paths).select(_path().alias("list_id"), F.monotonically_increasing_id().alias("pos"), F.regexp_replace("value", "\r$", "").alias("value"))


def read_hits(spark: SparkSession, paths) -> DataFrame:
    """Tables of twelve columns without header; a line with another number of columns is an error."""
    lines = _lines(spark, paths).where(~F.col("value").startswith(EMPTY) & (F.col("value") != ""))
    cells = F.split("value", "\t")
    lines = require(lines, F.size(cells) == 12, F.concat(F.lit("not a hit table: "), "value"))
    names = [c.strip().split(" ") for c in HITS.split(",")]
    return lines.withColumn("_c", cells).select("list_id", *[F.trim(F.col("_c")[i]).cast(kind).alias(name) for i, (name, kind) in enumerate(names)])


def read_crb(spark: SparkSession, paths) -> DataFrame:
    """Conditional reciprocal hits by name; spans ``a..b`` become start and end."""
    made = spark.read.csv(paths, sep="\t", schema=CRB, mode="FAILFAST")
    for side in "qs":
        ends = F.split(F.col(f"{side}span"), r"\.\.")
        made = made.withColumns({f"{side}start": ends[0].cast("int"), f"{side}end": ends[1].cast("int")})
    return made.drop("qspan", "sspan")


def read_hmm_hits(spark: SparkSession, paths) -> DataFrame:
    """Per-target tables of a profile search; comment lines are left out."""
    cells = F.split(F.trim("value"), r"\s+", 8)
    lines = _lines(spark, paths).where(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("_c", cells)
    text, number = ("target", "target_acc", "query", "query_acc"), ("evalue", "score", "bias")
    return lines.select("list_id", *[F.col("_c")[i].alias(n) for i, n in enumerate(text)], *[F.col("_c")[4 + i].cast("double").alias(n) for i, n in enumerate(number)], F.col("_c")[7].alias("rest"))


def extract_hmm_targets(hits: DataFrame) -> DataFrame:
    return hits.select("target").distinct()


def parse_genbank(spark: SparkSession, paths) -> DataFrame:
    """``record, features``: one row per record with the array of its features. Files split at the line ``//``; each task parses whole records one by one."""
    raw = spark.read.option("lineSep", "\n//").text(paths).select("value").where(F.trim("value") != "")
    return raw.mapInPandas(parse_records, f"record struct<{RECORDS}>, features array<struct<{FEATURES}>>")


def read_genbank(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """Features and records, as tables of their own."""
    parsed = parse_genbank(spark, paths)
    return parsed.select(F.explode("features").alias("f")).select("f.*"), parsed.select("record.*")


def read_list(spark: SparkSession, path) -> DataFrame:
    """``list_id, pos, value``: one element a line."""
    return _lines(spark, path).where(~F.col("value").startswith(EMPTY))


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Paths that match, in order; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(F.col("path").alias("value")).orderBy("value")


def read_orthogroups(spark: SparkSession, path, kind: str) -> DataFrame:
    """``group_id, member`` from the output of an orthogroup finder."""
    lines = _lines(spark, path).where(F.trim("value") != "")
    if kind == "orthofinder":  # OG0000000: a b c
        ids, members = F.substring("value", 1, 9), F.split(F.expr("substr(value, 12)"), " ")
    elif kind == "sonicparanoid":
        lines = lines.where(~F.col("value").startswith("group_id"))
        ids, members = F.regexp_extract("value", r"^(\S+)", 1), F.regexp_extract_all("value", F.lit(r"(seqid_[0-9a-f]+)"), F.lit(1))
    elif kind == "greencut":
        ids, members = F.xxhash64("value").cast("string"), F.split(F.regexp_replace("value", ":", ""), r"\t")
    else:
        raise ValueError(f"unknown kind of orthogroups: {kind}")
    made = lines.select(ids.alias("group_id"), F.explode(members).alias("member"))
    return made.where(F.trim("member") != "").select("group_id", F.trim("member").alias("member"))


def read_busco_summaries(spark: SparkSession, paths, separator: str | None = None) -> DataFrame:
    """``path, text``: whole summary files, or, with a ``separator``, the summaries that files of many hold, which split at it."""
    if separator is None:
        return spark.read.text(paths, wholetext=True).select(_path().alias("path"), F.col("value").alias("text"))
    raw = spark.read.option("lineSep", separator).text(paths)
    return raw.where(F.trim("value") != "").select(_path().alias("path"), F.col("value").alias("text"))


def busco_scores_table(summaries: DataFrame) -> DataFrame:
    """``fasta, complete, single, duplicated, fragmented, missing, n``."""
    scores = F.regexp_extract_all("text", F.lit(r":([0-9.]{1,5})"), F.lit(1))
    named = summaries.select(F.regexp_extract("text", r"for file (.*)", 1).alias("fasta"), scores.alias("_s"))
    kinds = ("complete", "single", "duplicated", "fragmented", "missing")
    return named.select("fasta", *[F.get("_s", F.lit(i)).cast("double").alias(k) for i, k in enumerate(kinds)], F.get("_s", F.lit(5)).cast("int").alias("n"))


def busco_percent_complete(summaries: DataFrame) -> DataFrame:
    return summaries.select(F.regexp_extract("text", r"C:([0-9.]*)%", 1).cast("double").alias("complete"))


def busco_filter_completeness(minimum: float, scores: DataFrame, fastas: DataFrame) -> DataFrame:
    """Listed FASTAs (``value``) that are complete enough; one that has no score is an error."""
    found = fastas.join(scores.select(F.col("fasta").alias("value"), "complete").withColumn("_in", F.lit(1)), "value", "left")
    checked = F.when(F.col("_in").isNull(), F.raise_error(F.concat(F.lit("no score for "), "value")).cast("double")).otherwise(F.col("complete"))
    return found.where(checked >= minimum).select("value")


def filter_names(names: DataFrame, needle: str, column: str = "value") -> DataFrame:
    """Names that contain ``needle`` in any case; an empty one keeps all."""
    return names.where(F.lower(F.col(column)).contains(needle.lower()))


def parse_searches(strings: DataFrame, column: str = "value") -> DataFrame:
    """``Species name (database identifier)`` to ``organism, database, identifier``; what is missing is NA."""
    pattern = r"^([A-Za-z0-9. ]+?) *(?:\((?:(genbank|refseq|ensemblgenomes|ensembl)(?: +|(?=\))))?([A-Za-z0-9._]+)?\))?$"
    text = F.trim(F.col(column))
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(text, pattern, i), F.lit("")), F.lit("NA"))
    good = require(strings, F.coalesce(text.rlike(pattern), F.lit(False)), F.concat(F.lit("not a search: "), F.coalesce(text, F.lit("null"))))
    return good.select(part(1).alias("organism"), part(2).alias("database"), part(3).alias("identifier"))
