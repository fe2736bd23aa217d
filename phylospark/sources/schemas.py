"""Columns of the file types."""

HITS = (
    "queryid string, subjectid string, pident double, alignmentlength int, mismatches int, gapopens int, "
    "qstart int, qend int, sstart int, send int, evalue double, bitscore double"
)
#: Order of columns in a table of conditional reciprocal hits.
CRB = (
    "queryid string, subjectid string, pident double, alignmentlength int, evalue double, bitscore double, "
    "qspan string, sspan string, qlen int, tlen int"
)
RECORDS = "record_id string, annotations map<string,array<string>>, seq string"
FEATURES = (
    "record_id string, feature_no int, type string, parts array<struct<start:int,end:int,strand:int>>, "
    "start int, end int, strand int, qualifiers map<string,array<string>>"
)
