"""Operator inputs derived from the star-schema and document tables, as SQL for both engines.

Table names stand in braces: Spark gets DataFrames for them, DuckDB the names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

HITS_FWD = """SELECT l_returnflag AS list_id, concat('o', l_orderkey) AS queryid, concat('p', l_partkey) AS subjectid,
  CAST(100 - 5 * CAST(round(l_discount * 100) AS INT) AS DOUBLE) AS pident, CAST(l_quantity AS INT) * 10 AS alignmentlength,
  l_linenumber AS mismatches, CAST(round(l_tax * 100) AS INT) AS gapopens, 1 AS qstart, CAST(l_quantity AS INT) * 10 AS qend,
  1 AS sstart, CAST(l_quantity AS INT) * 10 AS send, l_discount / l_quantity AS evalue, l_extendedprice AS bitscore
  FROM {lineitem}"""
HITS_REV = """SELECT list_id, subjectid AS queryid, queryid AS subjectid, pident, alignmentlength, mismatches, gapopens,
  sstart AS qstart, send AS qend, qstart AS sstart, qend AS send, evalue, bitscore FROM {hits_fwd}"""
LETTERS = "abcdefghijklmnopqrstuvwxyz"
DNA = "ACGTACGTACGTACGTACGTACGTAC"

#: Name -> (SQL, names it reads).
VIEWS = {
    "hits_fwd": HITS_FWD,
    "hits_rev": HITS_REV,
    "items": "SELECT event_type AS list_id, event_id AS pos, user_id * 100 + hour(ts) AS value FROM {events}",
    "lists": "SELECT list_id, CAST(row_number() OVER (ORDER BY list_id) AS BIGINT) AS pos FROM (SELECT DISTINCT event_type AS list_id FROM {events} UNION ALL SELECT 'none' AS list_id) x",
    "full_lists": "SELECT list_id, CAST(row_number() OVER (ORDER BY list_id) AS BIGINT) AS pos FROM (SELECT DISTINCT event_type AS list_id FROM {events}) x",
    "og": "SELECT l_orderkey AS group_id, concat('p', l_partkey) AS member FROM {lineitem}",
    "proteomes": "SELECT p_brand AS list_id, concat('p', p_partkey) AS value FROM {part}",
    "makers": "SELECT CASE WHEN p_size < 25 THEN 'small' ELSE 'large' END AS list_id, concat('p', p_partkey) AS value FROM {part}",
    "rb_hits": "SELECT concat('c', c_custkey) AS queryid, concat('c', c_custkey + c_nationkey - 12) AS subjectid FROM {customer} WHERE c_mktsegment <> 'MACHINERY'",
    "more_hits": "SELECT concat('c', c_custkey) AS queryid, concat('x', c_custkey % 50) AS subjectid FROM {customer}",
    "headers": "SELECT concat(s_name, ' nation ', s_nationkey) AS header, s_name AS seq_id FROM {supplier}",
    "idmap": """SELECT concat('seqid_', substr(md5(concat('"', s_name, ' nation ', s_nationkey, '"')), 1, 10)) AS hash, concat(s_name, ' nation ', s_nationkey) AS header FROM {supplier}""",
    "summaries": """SELECT concat('s', p_partkey) AS path, concat('# for file f', p_partkey, chr(10), 'C:', CAST(p_size AS VARCHAR(9)), '.5%[S:', CAST(p_size AS VARCHAR(9)), '.1%,D:0.4%],F:1.5%,M:', CAST(60 - p_size AS VARCHAR(9)), '.0%,n:', CAST(p_partkey % 900 AS VARCHAR(9))) AS text FROM {part}""",
    "searches": """SELECT concat(s_name, ' sp. ', CASE s_suppkey % 4 WHEN 0 THEN '(refseq)' WHEN 1 THEN concat('(ensemblgenomes id.', s_suppkey, ')') WHEN 2 THEN concat('(genbank G_', s_suppkey, ')') ELSE '' END) AS value FROM {supplier}""",
}
SEQS = f"substr(translate(regexp_replace(lower(text), '[^a-z]', ''{{g}}), '{LETTERS}', '{DNA}'), 1)"
for _name, _id, _table in (("doc_seqs", "concat('d', doc_id)", "documents"), ("item_seqs", "concat('b', item_id)", "benchmark")):
    VIEWS[_name] = f"SELECT {_id} AS seq_id, {_id} AS header, {SEQS} AS seq FROM {{{_table}}}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the tables of a folder; names that aren't views are tables."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name].replace("{g}", "")
    used = {n: view(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **used)


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names in front."""
    order: list[str] = []

    def need(text: str) -> None:
        for n in VIEWS:
            if re.search(rf"\b{n}\b", text) and n not in order:
                need(VIEWS[n].replace("{g}", ""))
                order.append(n)

    need(sql)
    views = ", ".join(f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n].replace('{g}', chr(44) + ' ' + chr(39) + 'g' + chr(39)))})" for n in order)
    if not views:
        return sql
    body = sql.strip()
    recursive = "RECURSIVE " if body.upper().startswith("WITH RECURSIVE") else ""
    if body.upper().startswith("WITH"):
        return f"WITH {recursive}{views}, {re.sub(r'(?i)^WITH (RECURSIVE )?', '', body)}"
    return f"WITH {views} {body}"
