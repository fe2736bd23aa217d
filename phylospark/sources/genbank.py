"""GenBank flat files: a parser of single records for ``mapInPandas``, and features as sequences."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phylospark.functions.sequences import reverse_complement, translate

PART = re.compile(r"(complement\()?<?(\d+)(?:\.\.>?(\d+))?")


def parse_location(text: str) -> list[tuple[int, int, int]]:
    """Parts (start from 0, end, strand) in the order in which they are read."""
    whole = text.startswith("complement(")
    parts = [(int(m[2]) - 1, int(m[3] or m[2]), -1 if whole or m[1] else 1) for m in PART.finditer(text)]
    return parts[::-1] if whole and "join" in text else parts


def parse_record(text: str) -> tuple[dict, list[dict]] | None:
    """One record and its features."""
    lines = [x.rstrip() for x in text.strip("\n").split("\n")]
    start = next((i for i, x in enumerate(lines) if x.startswith("LOCUS")), None)
    if start is None:
        return None
    annotations: dict[str, list[str]] = {}
    features, seq, section, name = [], [], "head", ""
    for line in lines[start:]:
        if line.startswith("FEATURES"):
            section = "features"
        elif line.startswith("ORIGIN"):
            section = "origin"
        elif section == "origin":
            seq.append(re.sub(r"[\d\s]", "", line))
        elif section == "head":
            if line[:12].strip():
                name = line[:12].strip().lower()
                annotations.setdefault(name, []).append(line[12:].strip())
            elif name:
                annotations[name][-1] += " " + line.strip()
        elif line[5:21].strip():
            features.append({"type": line[5:21].strip(), "location": line[21:].strip(), "lines": []})
        elif features:
            value = line[21:].strip()
            if value.startswith("/"):
                features[-1]["lines"].append(value)
            elif features[-1]["lines"]:
                features[-1]["lines"][-1] += "\n" + value
            else:
                features[-1]["location"] += value
    record_id = (annotations.get("version") or annotations.get("accession") or annotations["locus"])[0].split()[0]
    made = []
    for i, f in enumerate(features):
        qualifiers: dict[str, list[str]] = {}
        for q in f["lines"]:
            key, _, value = q[1:].partition("=")
            value = value.replace("\n", "" if key == "translation" else " ").strip('"').replace('""', '"')
            qualifiers.setdefault(key, []).append(value)
        parts = parse_location(f["location"])
        made.append({
            "record_id": record_id, "feature_no": i, "type": f["type"], "parts": [dict(zip(("start", "end", "strand"), p)) for p in parts],
            "start": min((p[0] for p in parts), default=None), "end": max((p[1] for p in parts), default=None), "strand": parts[0][2] if parts else None, "qualifiers": qualifiers,
        })
    return {"record_id": record_id, "annotations": annotations, "seq": "".join(seq).upper()}, made


def parse_records(batches):
    for b in batches:
        found = [r for r in map(parse_record, b["value"]) if r]
        yield pd.DataFrame({"record": [r for r, _ in found], "features": [f for _, f in found]})


def _first(qualifiers: Column, *names: str) -> Column:
    """The first value of the first of these qualifiers that is there."""
    return F.coalesce(*[F.get(F.try_element_at(qualifiers, F.lit(n)), F.lit(0)) for n in names], F.lit(f"missing_{names[0]}_qualifer"))


def _cut_out(f: Column, whole: Column) -> Column:
    """A feature as ``seq_id, header, dna, aa``."""
    piece = lambda p: F.substring(whole, p["start"] + 1, p["end"] - p["start"])
    dna = F.array_join(F.transform(f["parts"], lambda p: F.when(p["strand"] < 0, reverse_complement(piece(p))).otherwise(piece(p))), "")
    place = F.concat(f["start"], F.lit(":"), f["end"], F.when(f["strand"] < 0, F.lit(" Reverse")).otherwise(F.lit(" Forward")))
    tag = _first(f["qualifiers"], "locus_tag", "gene", "db_xref")
    header = F.concat_ws(" | ", tag, _first(f["qualifiers"], "gene", "locus_tag", "db_xref"), _first(f["qualifiers"], "product"), place)
    return F.struct(tag.alias("seq_id"), header.alias("header"), dna.alias("dna"), F.get(F.try_element_at(f["qualifiers"], F.lit("translation")), F.lit(0)).alias("aa"))


def _as_fasta(cut_out: DataFrame, protein: bool) -> DataFrame:
    seq = F.coalesce("c.aa", F.regexp_replace(translate("c.dna"), r"\*$", "")) if protein else F.col("c.dna")
    return cut_out.select("c.seq_id", "c.header", seq.alias("seq"))


def _type(feature_type: str) -> str:
    return "CDS" if feature_type == "cds" else feature_type


def parsed_to_fasta(parsed: DataFrame, feature_type: str, protein: bool) -> DataFrame:
    """As ``features_to_fasta``, from records as they were parsed (``record, features``): features are cut inside their record, which goes nowhere."""
    if feature_type == "whole":
        return features_to_fasta(None, parsed.select("record.*"), feature_type, protein)
    chosen = F.filter("features", lambda f: f["type"] == _type(feature_type))
    return _as_fasta(parsed.select(F.explode(F.transform(chosen, lambda f: _cut_out(f, F.col("record.seq")))).alias("c")), protein)


def features_to_fasta(features: DataFrame, records: DataFrame, feature_type: str, protein: bool) -> DataFrame:
    """Features of one type as sequences with the header ``locus_tag | gene | product | start:end strand``.

    ``cds`` means ``CDS``; ``whole`` gives the records themselves. A protein is
    the feature's own translation or else that of its extracted nucleotides.
    A record meets the array of its features, not each of them.
    """
    if feature_type == "whole":
        notes = F.array_join(F.transform(F.array_sort(F.map_entries("annotations")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ";"))), " | ")
        return records.select(F.col("record_id").alias("seq_id"), F.concat_ws(" | ", "record_id", notes).alias("header"), (translate("seq") if protein else F.col("seq")).alias("seq"))
    chosen = features.where(F.col("type") == _type(feature_type)).groupBy("record_id").agg(F.collect_list(F.struct("parts", "start", "end", "strand", "qualifiers")).alias("_f"))
    joined = records.select("record_id", "seq").join(chosen, "record_id")
    return _as_fasta(joined.select(F.explode(F.transform("_f", lambda f: _cut_out(f, F.col("seq")))).alias("c")), protein)


def gbk_to_faa(feature_type: str, features: DataFrame, records: DataFrame) -> DataFrame:
    return features_to_fasta(features, records, feature_type, True)


def gbk_to_fna(feature_type: str, features: DataFrame, records: DataFrame) -> DataFrame:
    return features_to_fasta(features, records, feature_type, False)
