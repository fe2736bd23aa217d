"""Queries over the driver's tables, one per operator, and the SQL that DuckDB answers alike."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylospark.functions import numbers, sequences
from phylospark.operators import bitmaps, groups, hits, ids, mapping, search, sets, sweeps
from phylospark.plans import workloads
from phylospark.plans.views import view, with_views
from phylospark.shared import cut
from phylospark.sources import readers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
CUTOFFS = [0.0, 0.0005, 0.001, 0.002, 0.005, 0.01, 0.05]
HIT_COLUMNS = "list_id, queryid, subjectid, pident, alignmentlength, mismatches, gapopens, qstart, qend, sstart, send, evalue, bitscore"
BEST = f"(SELECT {HIT_COLUMNS} FROM {{t}} QUALIFY row_number() OVER (PARTITION BY list_id, queryid ORDER BY evalue, bitscore DESC, subjectid, pident, alignmentlength, mismatches, gapopens) = 1)"
ONE = f"(SELECT {HIT_COLUMNS} FROM {{t}} QUALIFY count(*) OVER (PARTITION BY list_id, queryid) = 1)"


def query(name: str, sql: str | None = None):
    """Register a function of a view getter."""

    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(lambda v: view(spark, sf_dir, v))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = with_views(sql)
        return function

    return register


def reciprocal(one: str, columns: str = HIT_COLUMNS) -> str:
    return f"WITH l AS {one.format(t='hits_fwd')}, r AS {one.format(t='hits_rev')} SELECT {columns} FROM l WHERE EXISTS (SELECT 1 FROM r WHERE r.list_id = l.list_id AND r.queryid = l.subjectid AND r.subjectid = l.queryid)"


# Hit tables
query("filter_evalue", "SELECT * FROM hits_fwd WHERE evalue <= 0.001")(lambda v: hits.filter_evalue(v("hits_fwd"), 0.001))
query("filter_bitscore", "SELECT * FROM hits_fwd WHERE bitscore >= 50000")(lambda v: hits.filter_bitscore(v("hits_fwd"), 50000))
query("filter_pident", "SELECT * FROM hits_fwd WHERE pident >= 80")(lambda v: hits.filter_pident(v("hits_fwd"), 80))
query("extract_queries", "SELECT DISTINCT list_id, queryid FROM hits_fwd")(lambda v: hits.extract_queries(v("hits_fwd")))
query("extract_targets", "SELECT DISTINCT list_id, subjectid FROM hits_fwd")(lambda v: hits.extract_targets(v("hits_fwd")))
query("best_hits", f"SELECT * FROM {BEST.format(t='hits_fwd')}")(lambda v: hits.best_hits(v("hits_fwd")))
query("unique_hits", f"SELECT * FROM {ONE.format(t='hits_fwd')}")(lambda v: hits.unique_hits(v("hits_fwd")))
query("best_hsps", f"SELECT {HIT_COLUMNS} FROM hits_rev QUALIFY rank() OVER (PARTITION BY list_id, queryid ORDER BY bitscore DESC) = 1")(lambda v: hits.best_hsps(v("hits_rev")))
query("reciprocal_best", reciprocal(BEST))(lambda v: hits.reciprocal_best(v("hits_fwd"), v("hits_rev")))
query("reciprocal_best_unique", reciprocal(ONE))(lambda v: hits.reciprocal_best(v("hits_fwd"), v("hits_rev"), "unique"))
query("reciprocal_best_each", reciprocal(BEST))(lambda v: hits.reciprocal_best_each(v("hits_fwd"), v("hits_rev")))
query("reciprocal_best_all", reciprocal(BEST, HIT_COLUMNS.removeprefix("list_id, ")))(lambda v: hits.reciprocal_best_all(v("hits_fwd"), v("hits_rev")))
query(
    "conditional_reciprocal_best",
    f"""WITH l AS {BEST.format(t="hits_fwd")}, r AS {BEST.format(t="hits_rev")},
    m AS (SELECT l.*, EXISTS (SELECT 1 FROM r WHERE r.list_id = l.list_id AND r.queryid = l.subjectid AND r.subjectid = l.queryid) AS reciprocal,
        CASE WHEN evalue = 0 THEN 200.0::DOUBLE ELSE round(-log10(evalue), 9) END AS v FROM l),
    s AS (SELECT list_id, alignmentlength AS c, sum(v) AS s, count(*) AS n FROM m WHERE reciprocal GROUP BY ALL),
    a AS (SELECT x.list_id, x.c, round(sum(y.s) / sum(y.n), 6) AS mean FROM s x JOIN s y ON x.list_id = y.list_id
        AND y.c BETWEEN x.c - greatest(5, x.c // 10) AND x.c + greatest(5, x.c // 10) GROUP BY ALL),
    f AS (SELECT list_id, c, max(mean) OVER (PARTITION BY list_id ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cut FROM a)
    SELECT {", ".join("m." + c.strip() for c in HIT_COLUMNS.split(","))}, reciprocal FROM m LEFT JOIN f ON m.list_id = f.list_id AND m.alignmentlength = f.c WHERE reciprocal OR v >= cut""",
)(lambda v: hits.conditional_reciprocal_best(v("hits_fwd"), v("hits_rev")))
query("w1_shared_genes", f"WITH b AS ({reciprocal(BEST, 'list_id, queryid').replace('hits_fwd', '(SELECT * FROM hits_fwd WHERE evalue <= 0.005)').replace('hits_rev', '(SELECT * FROM hits_rev WHERE evalue <= 0.005)')}) SELECT queryid AS value, count(*) AS lists FROM b GROUP BY queryid")(
    lambda v: workloads.reciprocal_genes(v("hits_fwd"), v("hits_rev"), 0.005)
)
query("concat_hits", f"SELECT {HIT_COLUMNS.removeprefix('list_id, ')} FROM hits_fwd UNION ALL SELECT {HIT_COLUMNS.removeprefix('list_id, ')} FROM hits_rev")(lambda v: sets.concat(v("hits_fwd"), v("hits_rev")))

# Sets and counts
A, B = "SELECT value FROM items WHERE list_id = 'click'", "SELECT value FROM items WHERE list_id = 'view'"


def _two(v):
    items = v("items")
    return items.where("list_id = 'click'"), items.where("list_id = 'view'")


query("union", f"{A} UNION {B}")(lambda v: sets.union(*_two(v)))
query("intersection", f"{A} INTERSECT {B}")(lambda v: sets.intersection(*_two(v)))
query("difference", f"{A} EXCEPT {B}")(lambda v: sets.difference(*_two(v)))


def _difference_of_hours(events: DataFrame) -> DataFrame:
    """The users and tens of hour 0 without (those of hour 1 without (those of hour 2 ...))."""
    hour = F.hour("ts").cast("long")
    data = events.select(hour.alias("list_id"), (F.col("user_id") * 10 + F.col("event_id") % 10).alias("value"))
    return bitmaps.diff_of(data, data.select("list_id", F.col("list_id").alias("pos")).distinct())


COUNTS = "SELECT value FROM items GROUP BY value HAVING count(DISTINCT list_id)"
query("any", "SELECT DISTINCT value FROM items")(lambda v: sets.any_of(v("items")))
query("all", f"{COUNTS} = (SELECT count(*) FROM full_lists)")(lambda v: sets.all_of(v("items"), v("full_lists")))
query("all_with_an_empty_list", f"{COUNTS} = (SELECT count(*) FROM lists)")(lambda v: sets.all_of(v("items"), v("lists")))
query("some", f"{COUNTS} < (SELECT count(*) FROM full_lists)")(lambda v: sets.some_of(v("items"), v("full_lists")))
query(
    "diff",
    """WITH RECURSIVE f AS (SELECT value, (SELECT max(pos) FROM full_lists) + 1 AS p, false AS holds FROM (SELECT DISTINCT value FROM items)
    UNION ALL SELECT f.value, p - 1, NOT holds AND EXISTS (SELECT 1 FROM items i, full_lists l WHERE i.list_id = l.list_id AND l.pos = p - 1 AND i.value = f.value) FROM f WHERE p > 1)
    SELECT value FROM f WHERE p = 1 AND holds""",
)(lambda v: sets.diff_of(v("items"), v("full_lists")))
query("length", "SELECT count(*) AS n FROM hits_fwd")(lambda v: sets.length(v("hits_fwd")))
query("length_each", "SELECT l.list_id, l.pos, count(i.value) AS n FROM lists l LEFT JOIN items i ON l.list_id = i.list_id GROUP BY ALL")(lambda v: sets.length_each(v("items"), v("lists")))
NAMES = ["click", "purchase", "scroll", "signup", "view"]
query("sets_table", "SELECT value, " + ", ".join(f"coalesce(max(CASE WHEN list_id = '{n}' THEN 'x' END), '') AS \"{n}\"" for n in NAMES) + " FROM items GROUP BY value")(lambda v: sets.sets_table(v("items"), NAMES))
query("set_regions", "WITH c AS (SELECT value, string_agg(DISTINCT list_id, ',' ORDER BY list_id) AS lists FROM items GROUP BY value) SELECT lists, count(*) AS n FROM c GROUP BY lists")(lambda v: sets.set_regions(v("items")))
query("all_bitmaps", f"{COUNTS} = (SELECT count(*) FROM full_lists)")(lambda v: bitmaps.all_of(v("items"), v("full_lists")))
query("some_bitmaps", f"{COUNTS} < (SELECT count(*) FROM full_lists)")(lambda v: bitmaps.some_of(v("items"), v("full_lists")))
# Lists of users by day and kind of event, some hundreds to thousands.
DAY_LISTS = "SELECT concat(event_type, ' ', CAST(CAST(ts AS DATE) AS VARCHAR(10))) AS list_id, user_id AS value FROM events"
query("set_regions_bitmaps", f"WITH d AS ({DAY_LISTS}), c AS (SELECT value, string_agg(DISTINCT list_id, ',' ORDER BY list_id) AS lists FROM d GROUP BY value) SELECT lists, count(*) AS n FROM c GROUP BY lists")(
    lambda v: bitmaps.set_regions(v("events").select(F.concat_ws(" ", "event_type", F.to_date("ts").cast("string")).alias("list_id"), F.col("user_id").alias("value")))
)
query(
    "diff_bitmaps",
    """WITH RECURSIVE d AS (SELECT DISTINCT CAST(hour(ts) AS BIGINT) AS pos, user_id * 10 + event_id % 10 AS value FROM events), m AS (SELECT max(pos) AS p FROM d),
    f AS (SELECT value, (SELECT p FROM m) + 1 AS p, false AS holds FROM (SELECT DISTINCT value FROM d)
    UNION ALL SELECT f.value, p - 1, NOT holds AND EXISTS (SELECT 1 FROM d WHERE d.pos = p - 1 AND d.value = f.value) FROM f WHERE p > 0)
    SELECT value FROM f WHERE p = 0 AND holds""",
)(lambda v: _difference_of_hours(v("events")))
query("leave_each_out", "WITH n AS (SELECT DISTINCT l_orderkey AS list_id, l_partkey AS pos, concat('p', l_partkey) AS value FROM lineitem) SELECT a.list_id, b.pos AS out_pos, a.pos, a.value FROM n a JOIN n b ON a.list_id = b.list_id AND a.pos <> b.pos")(
    lambda v: sets.leave_each_out(v("lineitem").select(F.col("l_orderkey").alias("list_id"), F.col("l_partkey").alias("pos"), F.concat(F.lit("p"), "l_partkey").alias("value")).distinct())
)
query("singletons", "SELECT pos AS list_id, CAST(1 AS BIGINT) AS pos, value FROM items")(lambda v: sets.singletons(v("items")))
query("zip_lists", "SELECT l_orderkey AS list_id, l_linenumber AS pos, l_partkey AS a, l_suppkey AS b FROM (SELECT * FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1)")(
    lambda v: sets.zip_lists(*[_single_lines(v).select(F.col("l_orderkey").alias("list_id"), F.col("l_linenumber").alias("pos"), F.col(c).alias("value")) for c in ("l_partkey", "l_suppkey")])
)
SAMPLE = "QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY md5(concat_ws(':', {salt}, pos, value)), pos) <= 20"
query("sample", f"SELECT * FROM items {SAMPLE.format(by='list_id', salt=7)}")(lambda v: sets.sample(v("items"), 20, 7))
query("dedup_by_content", "SELECT md5(text) AS content_hash, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1")(
    lambda v: sets.dedup_by_content(v("documents").where("text is not null").select("doc_id", "text"), "text", "doc_id").select("content_hash", "doc_id")
)
FLAGS = "SELECT l_orderkey AS list_id, l_orderkey AS pos, concat(l_returnflag, l_linestatus, l_linenumber) AS value FROM lineitem"
query("dedup_lists_by_content", f"WITH n AS ({FLAGS}), c AS (SELECT list_id, list_sort(list(value)) AS held FROM n GROUP BY list_id) SELECT min(list_id) AS list_id, min(list_id) AS pos FROM c GROUP BY held")(
    lambda v: sets.dedup_lists_by_content(_flags(v), v("lineitem").select(F.col("l_orderkey").alias("list_id"), F.col("l_orderkey").alias("pos")).distinct())
)


def _flags(v):
    """Orders as lists of what became of their lines: many orders agree."""
    return v("lineitem").select(F.col("l_orderkey").alias("list_id"), F.col("l_orderkey").alias("pos"), F.concat("l_returnflag", "l_linestatus", "l_linenumber").alias("value"))


def _single_lines(v):
    lines = v("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    one = lines.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    return one.where("n = 1").drop("n")


# Groups and families
query("orthogroup_containing", "SELECT group_id, member FROM og WHERE group_id IN (SELECT group_id FROM og WHERE member = 'p7')")(lambda v: groups.orthogroup_containing(v("og"), "p7"))
SMALL_PARTS = "SELECT concat('p', p_partkey) AS value FROM part WHERE p_size = 3"
query("orthogroups_containing", f"SELECT group_id, member FROM og WHERE group_id IN (SELECT group_id FROM og WHERE member IN ({SMALL_PARTS}))")(
    lambda v: groups.orthogroups_containing(v("og"), v("part").where("p_size = 3").select(F.concat(F.lit("p"), "p_partkey").alias("value")))
)
SPAN = "WITH s AS (SELECT og.group_id, count(DISTINCT p.list_id) AS span FROM og LEFT JOIN proteomes p ON og.member = p.value GROUP BY og.group_id), t AS (SELECT count(DISTINCT list_id) AS n FROM proteomes) SELECT group_id, member FROM og WHERE group_id IN (SELECT group_id FROM s, t WHERE span {c})"
for _name, _function, _n, _c in (
    ("ortholog_in_min", groups.ortholog_in_min, 5, ">= 5"), ("ortholog_in_min_share", groups.ortholog_in_min, 0.1, ">= ceil(0.1 * n)"), ("ortholog_in_min_negative", groups.ortholog_in_min, -20, ">= n - 20"),
    ("ortholog_in_max", groups.ortholog_in_max, 2, "<= 2"), ("ortholog_in_max_share", groups.ortholog_in_max, 0.1, "<= floor(0.1 * n)"), ("ortholog_in_max_negative", groups.ortholog_in_max, -21, "<= n - 21"),
):
    query(_name, SPAN.format(c=_c))(lambda v, f=_function, n=_n: f(n, v("og"), v("proteomes")))
query("ortholog_in_any", SPAN.format(c=">= 1"))(lambda v: groups.ortholog_in_any(v("og"), v("proteomes")))
query("ortholog_in_all", SPAN.format(c=">= n").replace("proteomes", "makers"))(lambda v: groups.ortholog_in_all(v("og"), v("makers")))
query("group_spans", "SELECT og.group_id, count(DISTINCT p.list_id) AS span FROM og LEFT JOIN proteomes p ON og.member = p.value GROUP BY og.group_id")(lambda v: groups.group_spans(v("og"), v("proteomes")))
FAMILIES = """WITH RECURSIVE refs AS (SELECT DISTINCT queryid AS ref FROM rb_hits),
    e AS (SELECT DISTINCT queryid, subjectid FROM (SELECT * FROM rb_hits UNION ALL SELECT * FROM more_hits) WHERE queryid IN (SELECT ref FROM refs)),
    g AS (SELECT queryid AS a, subjectid AS b FROM e WHERE subjectid IN (SELECT ref FROM refs) UNION SELECT subjectid, queryid FROM e WHERE subjectid IN (SELECT ref FROM refs)),
    reach AS (SELECT ref AS a, ref AS b FROM refs UNION SELECT reach.a, g.b FROM reach JOIN g ON reach.b = g.a),
    fam AS (SELECT a AS ref, min(b) AS family FROM reach GROUP BY a),
    m AS (SELECT family, ref AS member, true AS is_ref FROM fam UNION SELECT family, subjectid, false FROM e JOIN fam ON e.queryid = fam.ref WHERE subjectid NOT IN (SELECT ref FROM refs))
    SELECT family, member, is_ref FROM m WHERE family IN (SELECT family FROM m GROUP BY family HAVING count(*) > 1)"""
query("greencut2_families", FAMILIES)(lambda v: groups.greencut2_families(v("rb_hits"), v("more_hits")))
FAMILY_ROWS = FAMILIES.replace("SELECT family, member, is_ref FROM m WHERE", "f AS (SELECT family, member FROM m WHERE", 1) + ")"
query(
    "w2_spanning_families",
    FAMILY_ROWS.replace("WHERE subjectid NOT IN (SELECT ref FROM refs))\n    f AS", "WHERE subjectid NOT IN (SELECT ref FROM refs)),\n    f AS")
    + " SELECT family AS group_id, member FROM f WHERE family IN (SELECT family FROM f JOIN customer ON member = concat('c', c_custkey) GROUP BY family HAVING count(DISTINCT c_mktsegment) >= 2)",
)(
    lambda v: workloads.spanning_families(v("rb_hits"), v("more_hits"), v("customer").select(F.col("c_mktsegment").alias("list_id"), F.concat(F.lit("c"), "c_custkey").alias("value")), 2)
)

# Sweeps, repeats, scores
GRID = "(VALUES " + ", ".join(f"({c}::DOUBLE)" for c in CUTOFFS) + ") c(cutoff)"
query("sweep_cutoff", f"SELECT cutoff, count(evalue) AS n FROM {GRID} LEFT JOIN hits_fwd ON evalue <= cutoff GROUP BY cutoff")(lambda v: sweeps.sweep_cutoff(v("hits_fwd"), "evalue", CUTOFFS))
query("sweep_cutoff_queries", f"SELECT cutoff, count(DISTINCT queryid) AS n FROM {GRID} LEFT JOIN hits_fwd ON evalue <= cutoff GROUP BY cutoff")(lambda v: sweeps.sweep_cutoff(v("hits_fwd"), "evalue", CUTOFFS, "queries"))
query("w3_cutoff_stability", f"SELECT cutoff, count(evalue) AS hits, count(DISTINCT queryid) AS queries FROM {GRID} LEFT JOIN hits_fwd ON evalue <= cutoff GROUP BY cutoff")(lambda v: workloads.cutoff_stability(v("hits_fwd"), CUTOFFS))
query(
    "sweep_grid",
    """WITH e AS (SELECT unnest([0.0, 0.0005, 0.001, 0.002, 0.005, 0.01, 0.05]::DOUBLE[]) AS x), b AS (SELECT unnest([0, 10000, 20000, 40000, 60000, 80000]::DOUBLE[]) AS y)
    SELECT x AS first_cutoff, y AS second_cutoff, count(queryid) AS hits, count(DISTINCT queryid) AS queries FROM e CROSS JOIN b LEFT JOIN hits_fwd ON evalue <= x AND bitscore >= y GROUP BY x, y""",
)(lambda v: sweeps.sweep_grid(v("hits_fwd"), ("evalue", "bitscore"), (CUTOFFS, [0, 10000, 20000, 40000, 60000, 80000])))


def _brand_values(v):
    return v("part").select("p_size").distinct().select(F.col("p_size").cast("long").alias("pos"), F.col("p_size").alias("variant"))


def _parts_of_size(v):
    sizes = v("part").groupBy(F.col("p_size").alias("variant")).agg(F.count(F.lit(1)).alias("score"))
    return lambda values: values.join(sizes, "variant").select("pos", "variant", "score")


query("replace_each", "SELECT CAST(p_size AS BIGINT) AS pos, p_size AS variant, count(*) AS score FROM part GROUP BY p_size")(lambda v: sweeps.replace_each(_parts_of_size(v), _brand_values(v)))
query("replace", "SELECT CAST(p_size AS BIGINT) AS pos, p_size AS variant, count(*) AS score FROM part WHERE p_size = 4 GROUP BY p_size")(lambda v: sweeps.replace(_parts_of_size(v), _brand_values(v), 4))
query("score_repeats", "SELECT count(*) AS score, p_size AS value FROM part GROUP BY p_size")(lambda v: sweeps.score_repeats(_parts_of_size(v), _brand_values(v)))
SCORES = "WITH s AS (SELECT count(*) AS score, p_size AS value FROM part GROUP BY p_size)"
query("extract_scores", f"{SCORES} SELECT DISTINCT score FROM s")(lambda v: sweeps.extract_scores(sweeps.score_repeats(_parts_of_size(v), _brand_values(v))))
query("extract_scored", f"{SCORES} SELECT DISTINCT value FROM s")(lambda v: sweeps.extract_scored(sweeps.score_repeats(_parts_of_size(v), _brand_values(v))))
query("plot_series", f"{SCORES} SELECT value, round(log10(value), 9) AS log_value, score FROM s")(lambda v: sweeps.plot_series(sweeps.score_repeats(_parts_of_size(v), _brand_values(v))))
SALTED = f"WITH r AS (SELECT s.salt, list_id, pos, value FROM items, (SELECT unnest(range(3)) AS salt) s {SAMPLE.format(by='salt, list_id', salt='salt')})"
_sampled = lambda v: sweeps.repeat(lambda d: sets.sample(d, 20, F.col("salt"), by=["salt", "list_id"]), v("items"), 3)
query("repeat", f"{SALTED} SELECT CAST(salt AS INT) AS salt, list_id, pos, value FROM r")(lambda v: _sampled(v).select("salt", "list_id", "pos", "value"))
query("stable_elements", f"{SALTED} SELECT value FROM r GROUP BY value HAVING count(DISTINCT salt) = 3")(lambda v: sweeps.stable_elements(_sampled(v), 3))
query(
    "histogram",
    """WITH e AS (SELECT min(value) AS lo, (max(value) - min(value)) / 30 AS w FROM events), b AS (SELECT CAST(least(floor((value - lo) / w), 29) AS INT) AS bin, count(*) AS n FROM events, e WHERE value IS NOT NULL GROUP BY 1)
    SELECT CAST(g.i AS INT) AS bin, lo + g.i * w AS low, lo + (g.i + 1) * w AS high, coalesce(n, 0) AS n FROM (SELECT unnest(range(30)) AS i) g CROSS JOIN e LEFT JOIN b ON b.bin = g.i""",
)(lambda v: sweeps.histogram(v("events")))

# Ids
query("hash_ids", "SELECT concat('seqid_', md5(concat('\"', header, '\"'))) AS seq_id, header FROM headers")(lambda v: ids.hash_ids(v("headers"))[0].select("seq_id", "header"))
query("unhash_ids", "SELECT split_part(header, ' ', 1) AS hash, 1 AS n FROM idmap")(lambda v: ids.unhash_ids(v("idmap").select("hash", F.lit(1).alias("n")), v("idmap"), ["hash"]))
query("unhash_text", "SELECT hash, concat('see ', split_part(header, ' ', 1), ', ', split_part(header, ' ', 1), '.') AS note FROM idmap")(
    lambda v: ids.unhash_text(v("idmap").select("hash", F.concat(F.lit("see "), "hash", F.lit(", "), "hash", F.lit(".")).alias("note")), v("idmap"), "note", "hash")
)
ASKED = "SELECT DISTINCT substr(s_name, 1, 17) AS value FROM supplier"
query("lookup_ids", f"SELECT value, hash, header FROM ({ASKED}) a LEFT JOIN idmap ON hash = value OR starts_with(header, value)")(lambda v: ids.lookup_ids(v("idmap"), v("supplier").select(F.substring("s_name", 1, 17).alias("value"))))
query("extract_seqs", "SELECT seq_id, header FROM headers WHERE seq_id LIKE 'Supplier#00000001%' OR seq_id LIKE 'Supplier#00000002%'")(
    lambda v: ids.extract_seqs(v("headers"), v("region").sparkSession.createDataFrame([("Supplier#00000001",), ("Supplier#00000002",)], "value string"))
)
query("extract_ids", "SELECT DISTINCT seq_id AS value FROM headers")(lambda v: ids.extract_ids(v("headers")))
query("split_fasta", "SELECT substr(md5(concat('>', header, chr(10), seq)), 1, 11) AS list_id, seq_id FROM item_seqs")(lambda v: ids.split_fasta(v("item_seqs"))[0].select("list_id", "seq_id"))

# Sequences
REVERSED = "translate(reverse(seq), 'ACGT', 'TGCA')"
query("reverse_complement", f"SELECT seq_id, md5({REVERSED}) AS digest FROM doc_seqs")(lambda v: v("doc_seqs").select("seq_id", F.md5(sequences.reverse_complement(F.col("seq"))).alias("digest")))
CODON = "'" + sequences.AMINO_ACIDS + "'"


def _translated(seq: str, shift: str = "0") -> str:
    base = f"(instr('TCAG', substr({seq}, 3 * i + {{k}} + {shift}, 1)) - 1)"
    number = f"16 * {base.format(k=1)} + 4 * {base.format(k=2)} + {base.format(k=3)}"
    return f"array_to_string(list_transform(range((length({seq}) - {shift}) // 3), lambda i: substr({CODON}, CAST({number} AS INT) + 1, 1)), '')"


query("translate", f"SELECT seq_id, md5({_translated('seq')}) AS digest FROM item_seqs")(lambda v: sequences.translate_seqs(v("item_seqs")).select("seq_id", F.md5("seq").alias("digest")))
query(
    "six_frames",
    f"WITH b AS (SELECT seq_id, seq, 1 AS sign FROM item_seqs UNION ALL SELECT seq_id, {REVERSED}, -1 FROM item_seqs) SELECT seq_id, CAST(sign * (f + 1) AS INT) AS frame, md5({_translated('seq', 'f')}) AS digest FROM b, (SELECT unnest(range(3)) AS f)",
)(lambda v: sequences.six_frames(v("item_seqs")).select("seq_id", "frame", F.md5("seq").alias("digest")))
#: Tiles of 60 letters, put together again: every stretch has its place.
query("translated_tiles", f"SELECT seq_id, md5({_translated('seq')}) AS digest FROM doc_seqs WHERE length(seq) >= 3")(lambda v: _rejoined(sequences.translated_tiles(v("doc_seqs"), 60), "seq_id"))
query(
    "six_frame_tiles",
    f"WITH b AS (SELECT seq_id, seq, 1 AS sign FROM doc_seqs UNION ALL SELECT seq_id, {REVERSED}, -1 FROM doc_seqs) SELECT seq_id, CAST(sign * (f + 1) AS INT) AS frame, md5({_translated('seq', 'f')}) AS digest FROM b, (SELECT unnest(range(3)) AS f) WHERE length(seq) - f >= 3",
)(lambda v: _rejoined(sequences.six_frame_tiles(v("doc_seqs"), 60), "seq_id", "frame"))


def _rejoined(tiled: DataFrame, *keys: str) -> DataFrame:
    parts = tiled.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("offset", "seq"))).alias("p"))
    return parts.select(*keys, F.md5(F.array_join(F.transform("p", lambda x: x["seq"]), "")).alias("digest"))


KMERS = "(SELECT seq_id, substr(seq, CAST(i + 1 AS INT), {k}) AS kmer, CAST(i AS INT) AS kpos FROM {t}, unnest(range(greatest(length(seq) - {k} + 1, 0))) AS u(i))"
query("kmer_index", f"SELECT * FROM {KMERS.format(k=11, t='item_seqs')}")(lambda v: search.kmer_index(v("item_seqs"), 11))
query("kmer_document_frequency", f"SELECT kmer, count(DISTINCT seq_id) AS sequences, count(*) AS places FROM {KMERS.format(k=6, t='doc_seqs')} GROUP BY kmer")(
    lambda v: search.kmer_frequency(v("doc_seqs"), 6)
)
query(
    "seed_pairs",
    f"""WITH q AS {KMERS.format(k=14, t="item_seqs")}, s AS {KMERS.format(k=14, t="doc_seqs")}, m AS (SELECT q.seq_id AS queryid, s.seq_id AS subjectid, q.kmer, s.kpos - q.kpos AS diag FROM q JOIN s ON q.kmer = s.kmer),
    d AS (SELECT queryid, subjectid, diag, count(*) AS n FROM m GROUP BY ALL), b AS (SELECT queryid, subjectid, first(diag ORDER BY n DESC, diag) AS diag, max(n) AS diag_seeds FROM d GROUP BY ALL),
    c AS (SELECT queryid, subjectid, count(DISTINCT kmer) AS seeds FROM m GROUP BY ALL)
    SELECT b.queryid, b.subjectid, seeds, diag, diag_seeds FROM b JOIN c ON b.queryid = c.queryid AND b.subjectid = c.subjectid WHERE seeds >= 10""",
)(lambda v: search.seed_pairs(v("item_seqs"), v("doc_seqs"), 14, 10))


def _reach(scores: str, drop: float) -> str:
    """A walk along scores: the best sum ``b``, its length ``e``, and how many are looked at, ``i``, until the sum is ``drop`` below it."""
    return f"""list_reduce(list_transform({scores}, lambda x: {{'c': x::DOUBLE, 'b': 0::DOUBLE, 'e': 0, 'i': 0, 'd': false}}), lambda z, x: CASE WHEN z.d THEN z ELSE {{'c': z.c + x.c, 'b': greatest(z.b, z.c + x.c),
        'e': CASE WHEN z.c + x.c > z.b THEN z.i + 1 ELSE z.e END, 'i': z.i + 1, 'd': greatest(z.b, z.c + x.c) - (z.c + x.c) > {drop!r}}} END, {{'c': 0::DOUBLE, 'b': 0::DOUBLE, 'e': 0, 'i': 0, 'd': false}})"""


def _segments(queries: str, subjects: str, k: int, alphabet: str) -> str:
    """Seeds taken from left to right, each extended both ways; those that an extension has looked at are passed over."""
    table, scale, big_k, _ = search.score_table(alphabet)
    letters, drop = search.letters_of(alphabet), search.DROP_BITS[alphabet] * math.log(2) / scale
    a, b = "substr(qs, CAST(first + i + 1 AS INT), 1)", "substr(ss, CAST(first + diag + i + 1 AS INT), 1)"
    if alphabet == "protein":
        known = "".join(f"{x}" for x in letters) + "*"
        flat = "[" + ", ".join(str(int(table[ord(x), ord(y)])) for x in known for y in known) + "]"
        score = f"CASE WHEN instr('{known}', {a}) > 0 AND instr('{known}', {b}) > 0 THEN {flat}[(instr('{known}', {a}) - 1) * {len(known)} + instr('{known}', {b})] WHEN '*' IN ({a}, {b}) THEN {int(search.STOP)} ELSE {int(search.UNKNOWN)} END"
    else:
        match, mismatch = int(search.NUCLEOTIDES[alphabet][0]), int(search.NUCLEOTIDES[alphabet][1])
        score = f"CASE WHEN {a} = {b} AND contains('{letters}', {a}) THEN {match} ELSE {mismatch} END"
    good = f"regexp_full_match(kmer, '[{letters}]*')"
    return f"""q AS (SELECT * FROM {KMERS.format(k=k, t=queries)} WHERE {good}), s AS (SELECT * FROM {KMERS.format(k=k, t=subjects)} WHERE {good}),
    d AS (SELECT q.seq_id AS queryid, s.seq_id AS subjectid, s.kpos - q.kpos AS diag, list(q.kpos ORDER BY q.kpos) AS places FROM q JOIN s ON q.kmer = s.kmer GROUP BY ALL HAVING count(*) >= 5),
    f AS (SELECT d.*, a.seq AS qs, b.seq AS ss, greatest(0, -diag) AS first, least(length(a.seq), length(b.seq) - diag) - greatest(0, -diag) AS beside FROM d JOIN {queries} a ON a.seq_id = queryid JOIN {subjects} b ON b.seq_id = subjectid),
    l AS (SELECT queryid, subjectid, diag, first, length(qs) AS qlen, length(ss) AS slen, list_transform(places, lambda x: x - first) AS seeds, list_transform(range(beside), lambda i: {score}) AS sc,
        list_transform(range(beside), lambda i: CASE WHEN {a} = {b} AND contains('{letters}', {a}) THEN 1 ELSE 0 END) AS eq FROM f),
    w AS (SELECT *, CAST(-1 AS BIGINT) AS reach, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS stop, 0::DOUBLE AS score FROM l
        UNION ALL
        SELECT queryid, subjectid, diag, first, qlen, slen, seeds, sc, eq, p + r.i - 1, p - t.e, p + r.e, r.b + t.b FROM
        (SELECT *, {_reach("sc[p + 1 :]", drop)} AS r, {_reach("list_reverse(sc[1 : p])", drop)} AS t FROM (SELECT *, list_min(list_filter(seeds, lambda x: x > reach)) AS p FROM w) WHERE p IS NOT NULL)),
    g AS (SELECT queryid, subjectid, diag, first, qlen, slen, score, start, stop, list_sum(eq[start + 1 : stop]) AS matches FROM w WHERE reach >= 0),
    h AS (SELECT queryid, subjectid, right(subjectid, 1) AS list_id, qlen, slen, score, matches, stop - start AS alignmentlength, first + start + 1 AS qstart, first + stop AS qend, first + diag + start + 1 AS sstart, first + diag + stop AS send,
        (score * {scale!r} - ln({big_k})) / ln(2) AS bits FROM g)"""


SEGMENTS = _segments("item_seqs", "doc_seqs", 14, "dna")
SHOWN = "CAST(alignmentlength AS INT) AS alignmentlength, CAST(matches AS INT) AS matches"
FORWARD = "(SELECT sum(length(seq)) FROM doc_seqs)"
FORWARD_EACH = "(SELECT sum(length(x.seq)) FROM doc_seqs x WHERE right(x.seq_id, 1) = list_id)"
BACKWARD = "(SELECT sum(length(seq)) FROM item_seqs)"


def _shown(df, *more):
    matches = (F.col("alignmentlength") - F.col("mismatches")).alias("matches")
    return df.select(*more, "queryid", "subjectid", "alignmentlength", matches, *[F.col(c).cast("int").alias(c) for c in ("qstart", "qend", "sstart", "send")], F.round("bitscore", 6).alias("bitscore"))


def _found(columns: str, evalue: str, turned: bool = False) -> str:
    ends = "CAST(sstart AS INT) AS qstart, CAST(send AS INT) AS qend, CAST(qstart AS INT) AS sstart, CAST(qend AS INT) AS send" if turned else "CAST(qstart AS INT) AS qstart, CAST(qend AS INT) AS qend, CAST(sstart AS INT) AS sstart, CAST(send AS INT) AS send"
    ids = "subjectid AS queryid, queryid AS subjectid" if turned else "queryid, subjectid"
    return f"WITH RECURSIVE {SEGMENTS} SELECT {columns}{ids}, {SHOWN}, {ends}, round(bits, 6) AS bitscore FROM h WHERE {'slen' if turned else 'qlen'} * {evalue} * pow(2.0, -bits) <= 1e-5"


def _mutual(each: bool) -> str:
    """Reciprocal best hits of the segments: least e-value, then greatest bits, then least partner, then the other columns."""
    at = "list_id, " if each else ""
    rank = "e, bits DESC, {o}, 100.0 * matches / alignmentlength, alignmentlength, alignmentlength - matches, {s}, {t}, {x}, {y}"
    return f"""WITH RECURSIVE {SEGMENTS}, fw AS (SELECT *, qlen * {FORWARD_EACH if each else FORWARD} * pow(2.0, -bits) AS e FROM h), bw AS (SELECT *, slen * {BACKWARD} * pow(2.0, -bits) AS e FROM h),
    a AS (SELECT * FROM fw WHERE e <= 1e-5 QUALIFY row_number() OVER (PARTITION BY {at}queryid ORDER BY {rank.format(o="subjectid", s="qstart", t="qend", x="sstart", y="send")}) = 1),
    b AS (SELECT * FROM bw WHERE e <= 1e-5 QUALIFY row_number() OVER (PARTITION BY {at}subjectid ORDER BY {rank.format(o="queryid", s="sstart", t="send", x="qstart", y="qend")}) = 1)
    SELECT {at}queryid, subjectid, {SHOWN}, CAST(qstart AS INT) AS qstart, CAST(qend AS INT) AS qend, CAST(sstart AS INT) AS sstart, CAST(send AS INT) AS send, round(bits, 6) AS bitscore
    FROM a WHERE EXISTS (SELECT 1 FROM b WHERE a.queryid = b.queryid AND a.subjectid = b.subjectid)"""


def _listed(v):
    return v("doc_seqs").withColumn("list_id", F.substring("seq_id", -1, 1))


SEEDS = {"k": 14, "min_seeds": 5}
query("search", _found("", FORWARD))(lambda v: _shown(search.search(1e-5, v("item_seqs"), v("doc_seqs"), **SEEDS)))
query("search_each", _found("list_id, ", FORWARD_EACH))(lambda v: _shown(search.search(1e-5, v("item_seqs"), _listed(v), by=["list_id"], **SEEDS), "list_id"))
query("search_rev", _found("", BACKWARD, True))(lambda v: _shown(search.search_rev(1e-5, v("item_seqs"), v("doc_seqs"), **SEEDS)))
query("search_rev_each", _found("list_id, ", BACKWARD, True))(lambda v: _shown(search.search_rev(1e-5, v("item_seqs"), _listed(v), by=["list_id"], **SEEDS), "list_id"))
query("search_rbh", _mutual(False))(lambda v: _shown(search.search_rbh(1e-5, v("item_seqs"), v("doc_seqs"), **SEEDS)))
query("search_rbh_each", _mutual(True))(lambda v: _shown(search.search_rbh(1e-5, v("item_seqs"), _listed(v), by=["list_id"], **SEEDS), "list_id"))


def _search_index(v):
    """The index is written, and the search reads it as a later one would."""
    table = f"seeds_{uuid.uuid4().hex}"
    index = search.build_index(v("doc_seqs"), table, SEEDS["k"])
    found = cut(_shown(search.search_index(1e-5, v("item_seqs"), v("doc_seqs"), index, **SEEDS)))
    index.sparkSession.sql(f"DROP TABLE {table}")
    return found


query("search_index", _found("", FORWARD))(_search_index)


def _proteins(name: str, table: str) -> str:
    return f"{name} AS (SELECT seq_id, {_translated('seq')} AS seq FROM {table})"


def _frames(name: str, table: str) -> str:
    both = f"SELECT seq_id, seq, 1 AS sign FROM {table} UNION ALL SELECT seq_id, {REVERSED}, -1 FROM {table}"
    return f"{name} AS (SELECT concat(seq_id, chr(1), CAST(sign * (f + 1) AS INT), chr(1), length(seq)) AS seq_id, {_translated('seq', 'f')} AS seq FROM ({both}), (SELECT unnest(range(3)) AS f))"


ENDS = "CAST(qstart AS INT) AS qstart, CAST(qend AS INT) AS qend, CAST(sstart AS INT) AS sstart, CAST(send AS INT) AS send"
query(
    "search_protein",
    f"""WITH RECURSIVE {_proteins("item_prots", "item_seqs")}, {_proteins("doc_prots", "doc_seqs")}, {_segments("item_prots", "doc_prots", 5, "protein")}
    SELECT queryid, subjectid, {SHOWN}, {ENDS}, round(bits, 6) AS bitscore FROM h WHERE qlen * (SELECT sum(length(seq)) FROM doc_prots) * pow(2.0, -bits) <= 1e-5""",
)(lambda v: _shown(search.search(1e-5, sequences.translate_seqs(v("item_seqs")), sequences.translate_seqs(v("doc_seqs")), "protein", k=5, min_seeds=5)))


def _nucleotides(x: str, start: str, end: str) -> str:
    frame, size = f"CAST(string_split({x}, chr(1))[2] AS INT)", f"CAST(string_split({x}, chr(1))[3] AS INT)"
    a, b = f"(3 * ({start} - 1) + abs({frame}))", f"(3 * {end} + abs({frame}) - 1)"
    return f"CAST(CASE WHEN {frame} > 0 THEN {a} ELSE {size} - {a} + 1 END AS INT) AS {start}, CAST(CASE WHEN {frame} > 0 THEN {b} ELSE {size} - {b} + 1 END AS INT) AS {end}"


query(
    "translated_search",
    f"""WITH RECURSIVE {_frames("item_frames", "item_seqs")}, {_frames("doc_frames", "doc_seqs")}, {_segments("item_frames", "doc_frames", 6, "protein")}
    SELECT string_split(queryid, chr(1))[1] AS queryid, string_split(subjectid, chr(1))[1] AS subjectid, {SHOWN}, {_nucleotides("queryid", "qstart", "qend")}, {_nucleotides("subjectid", "sstart", "send")}, round(bits, 6) AS bitscore
    FROM h WHERE qlen * (SELECT sum(length(seq)) FROM doc_frames) * pow(2.0, -bits) <= 1e-5""",
)(lambda v: _shown(search.translated_search(1e-5, v("item_seqs"), v("doc_seqs"), "tblastx", k=6, min_seeds=5)))

# Names and tables
query("filter_names", "SELECT p_name AS value FROM part WHERE contains(lower(p_name), 'bl')")(lambda v: readers.filter_names(v("part").select(F.col("p_name").alias("value")), "BL"))
query(
    "busco_scores_table",
    "WITH s AS (SELECT regexp_extract(text, 'for file (.*)', 1) AS fasta, regexp_extract_all(text, ':([0-9.]{1,5})', 1) AS a FROM summaries) SELECT fasta, a[1]::DOUBLE AS complete, a[2]::DOUBLE AS single, a[3]::DOUBLE AS duplicated, a[4]::DOUBLE AS fragmented, a[5]::DOUBLE AS missing, a[6]::INT AS n FROM s",
)(lambda v: readers.busco_scores_table(v("summaries")))
query("busco_percent_complete", "SELECT regexp_extract(text, 'C:([0-9.]*)%', 1)::DOUBLE AS complete FROM summaries")(lambda v: readers.busco_percent_complete(v("summaries")))
query("busco_filter_completeness", "SELECT concat('f', p_partkey) AS value FROM part WHERE p_size + 0.5 >= 30")(
    lambda v: readers.busco_filter_completeness(30, readers.busco_scores_table(v("summaries")), v("part").select(F.concat(F.lit("f"), "p_partkey").alias("value")))
)
query(
    "parse_searches",
    "SELECT concat(replace(s_name, '#', ' '), ' sp.') AS organism, CASE s_suppkey % 4 WHEN 0 THEN 'refseq' WHEN 1 THEN 'ensemblgenomes' WHEN 2 THEN 'genbank' ELSE 'NA' END AS database, CASE s_suppkey % 4 WHEN 1 THEN concat('id.', s_suppkey) WHEN 2 THEN concat('G_', s_suppkey) ELSE 'NA' END AS identifier FROM supplier",
)(lambda v: readers.parse_searches(v("searches").select(F.regexp_replace("value", "#", " ").alias("value"))))

# Numbers
query(
    "math",
    "SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS plus, l_quantity - l_tax AS minus, l_quantity * l_tax AS times, CASE WHEN l_tax = 0 THEN NULL ELSE l_quantity / l_tax END AS divide FROM lineitem",
)(
    lambda v: v("lineitem").select(
        "l_orderkey", "l_linenumber", *[f(F.col("l_quantity"), F.col("l_tax")).alias(n) for n, f in (("plus", numbers.plus), ("minus", numbers.minus), ("times", numbers.times), ("divide", numbers.divide))]
    )
)


def _per_part(v, values: DataFrame) -> DataFrame:
    """How many parts cost more than each number of a range: a range as the grid of a sweep."""
    grid = [r["value"] for r in values.collect()]
    return sweeps.sweep_cutoff(v("part"), "p_retailprice", grid, at_most=False)


RANGES = {
    "range_add": (lambda s: numbers.range_add(s, 900, 1900, 125), "SELECT 900 + 125.0 * i AS x FROM (SELECT unnest(range(9)) AS i)"),
    "range_exponent": (lambda s: numbers.range_exponent(s, 2, 8, 11, 1), "SELECT pow(2.0, 8 + i) AS x FROM (SELECT unnest(range(4)) AS i)"),
    "range_integers": (lambda s: numbers.range_integers(s, 1200, 1180), "SELECT 1200 - i AS x FROM (SELECT unnest(range(21)) AS i)"),
    "range_length": (lambda s: numbers.range_length(s, 1000, 1800, 9), "SELECT 1000 + 100.0 * i AS x FROM (SELECT unnest(range(9)) AS i)"),
    "range_multiply": (lambda s: numbers.range_multiply(s, 1, 3000, 2), "SELECT pow(2.0, i) AS x FROM (SELECT unnest(range(12)) AS i)"),
}
for _name, (_make, _sql) in RANGES.items():
    query(_name, f"WITH g AS ({_sql}) SELECT x::DOUBLE AS cutoff, count(p_partkey) AS n FROM g LEFT JOIN part ON p_retailprice >= x GROUP BY x")(lambda v, make=_make: _per_part(v, make(v("part").sparkSession)))

# User functions
query("map_each", "SELECT l_suppkey % 100 AS list_id, count(*) AS n, max(l_partkey) AS most FROM lineitem GROUP BY 1")(
    lambda v: mapping.map_each(v("lineitem").select((F.col("l_suppkey") % 100).alias("list_id"), "l_partkey"), ["list_id"], _summary, "list_id long, n long, most long")
)
query("map_each_in_parts", "SELECT l_returnflag, count(*) AS n, max(l_partkey) AS most, count(DISTINCT l_linenumber) AS lines FROM lineitem GROUP BY 1")(
    lambda v: mapping.map_each_in_parts(v("lineitem").select("l_returnflag", "l_partkey", "l_linenumber"), ["l_returnflag"], _some_lines, _merged_lines, _all_lines, "n long, most long, seen array<long>", "n long, most long, lines long")
)
query("compose", "SELECT DISTINCT list_id, queryid FROM hits_fwd WHERE evalue <= 0.001")(lambda v: mapping.compose(lambda d: hits.filter_evalue(d, 0.001), hits.extract_queries)(v("hits_fwd")))


def _summary(pdf):
    import pandas as pd

    return pd.DataFrame({"list_id": [pdf["list_id"].iloc[0]], "n": [len(pdf)], "most": [pdf["l_partkey"].max()]})


def _some_lines(pdf):
    import pandas as pd

    return pd.DataFrame({"n": [len(pdf)], "most": [pdf["l_partkey"].max()], "seen": [sorted(set(pdf["l_linenumber"]))]})


def _merged_lines(pdf):
    import pandas as pd

    return pd.DataFrame({"n": [pdf["n"].sum()], "most": [pdf["most"].max()], "seen": [sorted({x for s in pdf["seen"] for x in s})]})


def _all_lines(pdf):
    import pandas as pd

    return pd.DataFrame({"n": pdf["n"], "most": pdf["most"], "lines": [len(s) for s in pdf["seen"]]})
