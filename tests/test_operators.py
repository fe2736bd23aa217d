"""Literal goldens and identities."""

import random

import pytest
from pyspark.sql import functions as F

from phylospark.functions import numbers, sequences
from phylospark.operators import components, groups, hits, ids, search, sets, sweeps
from phylospark.plans import workloads
from phylospark.sources import readers, writers


def items(spark, *lists, kind="string"):
    rows = [(i, k, v if kind == "long" else str(v)) for i, values in enumerate(lists) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"list_id long, pos long, value {kind}")
    return df, spark.createDataFrame([(i, i) for i in range(len(lists))], "list_id long, pos long")


def values(df, column="value"):
    return sorted(r[column] for r in df.collect())


def test_set_operations(spark):
    data, lists = items(spark, range(1, 11), range(5, 16), kind="long")
    assert values(sets.any_of(data)) == list(range(1, 16))
    assert values(sets.all_of(data, lists)) == list(range(5, 11))
    assert values(sets.diff_of(data, lists)) == [1, 2, 3, 4]
    data, lists = items(spark, range(1, 11), range(5, 16), range(5, 11), kind="long")
    assert values(sets.some_of(data, lists)) == [1, 2, 3, 4, 11, 12, 13, 14, 15]


def test_difference_is_a_right_fold(spark):
    data, lists = items(spark, [1, 2, 3], [2, 3], [3], kind="long")
    assert values(sets.diff_of(data, lists)) == [1, 3]
    rng = random.Random(1)
    for _ in range(3):
        made = [set(rng.sample(range(8), rng.randint(0, 6))) for _ in range(rng.randint(1, 5))]
        want = made[-1]
        for s in reversed(made[:-1]):
            want = s - want
        data, lists = items(spark, *made, kind="long")
        assert values(sets.diff_of(data, lists)) == sorted(want)


def test_empty_lists_count(spark):
    data, lists = items(spark, [], [], kind="long")
    assert [r["n"] for r in sets.length_each(data, lists).collect()] == [0, 0]
    data, lists = items(spark, [1], [], kind="long")
    assert values(sets.all_of(data, lists)) == []


def test_leave_each_out(spark):
    data, _ = items(spark, [1, 2, 3], kind="long")
    rows = sets.leave_each_out(data).groupBy("out_pos").agg(F.array_sort(F.collect_list("value")).alias("v")).orderBy("out_pos").collect()
    assert [r["v"] for r in rows] == [[2, 3], [1, 3], [1, 2]]
    assert sets.leave_each_out(items(spark, [1], kind="long")[0]).count() == 0
    with pytest.raises(ValueError):
        sets.leave_each_out(data, most_rows=5)


def test_sample_depends_on_salt_only(spark):
    data, _ = items(spark, range(100), kind="long")
    a, b = values(sets.sample(data, 10, 1)), values(sets.sample(data.repartition(7), 10, 1))
    assert a == b and len(a) == 10 and a != values(sets.sample(data, 10, 2))
    assert len(values(sets.sample(data, 1000))) == 100


def test_zip_lists_rejects_unequal_lengths(spark):
    a, _ = items(spark, [1, 2])
    b, _ = items(spark, [1])
    with pytest.raises(Exception, match="unequal"):
        sets.zip_lists(a, b).collect()


def test_pick_rules():
    asked = [0, 1, 2, 3, 4, 5, 10, 0.1, 0.2, 0.3, 0.4, 0.5, -0.1, -1, -10]
    assert [numbers.pick_min(x, 4) for x in asked] == [0, 1, 2, 3, 4, 5, 10, 1, 1, 2, 2, 2, 0, 3, 0]
    assert [numbers.pick_max(x, 4) for x in asked] == [0, 1, 2, 3, 4, 4, 4, 0, 0, 1, 1, 2, -1, 3, 2]


def test_group_spans(spark):
    og = spark.createDataFrame([(g, str(m)) for g, ms in {"g1": [1, 2, 3], "g2": [2, 3, 4], "g3": [4, 5], "g4": [6]}.items() for m in ms], "group_id string, member string")
    proteomes, _ = items(spark, [1, 2, 3], [4, 5, 6], ["one", "two", "three"])
    kept = lambda df: values(df.select("group_id").distinct(), "group_id")
    every = ["g1", "g2", "g3", "g4"]
    for n, want in ((0, every), (1, every), (-2, every), (0.2, every), (2, ["g2"]), (-1, ["g2"]), (0.5, ["g2"]), (3, []), (0.8, [])):
        assert kept(groups.ortholog_in_min(n, og, proteomes)) == want, n
    for n, want in ((2, every), (3, every), (0.8, every), (0, []), (0.2, []), (1, ["g1", "g3", "g4"]), (0.5, ["g1", "g3", "g4"])):
        assert kept(groups.ortholog_in_max(n, og, proteomes)) == want, n
    assert kept(groups.ortholog_in_min(1, og, proteomes.limit(0))) == [] and kept(groups.ortholog_in_max(1, og, proteomes.limit(0))) == every


def test_families(spark):
    rb = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "a"), ("d", "d")], "queryid string, subjectid string")
    more = spark.createDataFrame([("b", "z"), ("q", "w")], "queryid string, subjectid string")
    rows = {(r["family"], r["member"], r["is_ref"]) for r in groups.greencut2_families(rb, more).collect()}
    assert rows == {("a", "a", True), ("a", "c", True), ("a", "x", False), ("b", "b", True), ("b", "y", False), ("b", "z", False)}


def test_steps_of_spanning_families_read_what_earlier_ones_wrote(spark):
    """No step joins again what the ones before have joined, so a task's sorts are those of one step."""
    rb = spark.createDataFrame([("a", "b"), ("b", "x"), ("c", "y"), ("d", "d"), ("e", "f"), ("f", "c")], "queryid string, subjectid string")
    more = spark.createDataFrame([("b", "z"), ("c", "z"), ("q", "w")], "queryid string, subjectid string")
    proteomes = spark.createDataFrame([("one", "a"), ("two", "z"), ("one", "c"), ("one", "e"), ("two", "d")], "list_id string, value string")
    found = workloads.spanning_families(rb, more, proteomes, 2)
    assert sorted(map(tuple, found.collect())) == [("a", "a"), ("a", "b"), ("a", "x"), ("a", "z")] + [("c", m) for m in "cefyz"]
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(found) <= 3 and joins(groups.greencut2_families(rb, more)) == 1


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == {n: find(n) for e in edges if e[0] != e[1] for n in e}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def hit_table(spark, rows):
    full = [(q, s, 90.0, 10, 0, 0, 1, 10, 1, 10, e, b) for q, s, e, b in rows]
    from phylospark.sources.schemas import HITS

    return spark.createDataFrame(full, HITS)


def test_best_hits_agree_and_ties_are_ordered(spark):
    table = hit_table(spark, [("a", "y", 1e-100, 5.0), ("a", "x", 1e-100, 5.0), ("a", "z", 2e-5, 90.0), ("b", "x", 0.0, 1.0), ("b", "y", 0.0, 2.0)])
    best = {r["queryid"]: r["subjectid"] for r in hits.best_hits(table).collect()}
    assert best == {"a": "x", "b": "y"}
    assert sorted(map(tuple, hits.best_hits(table).collect())) == sorted(map(tuple, hits.best_hits_by_window(table).collect()))


def test_null_cutoff_column_is_an_error(spark):
    with pytest.raises(Exception, match="evalue is null"):
        hits.filter_evalue(hit_table(spark, [("a", "x", None, 1.0)]), 1.0).collect()


def test_lists_together_equal_lists_alone(spark, sf_dir):
    from phylospark.plans.views import view

    table, back = view(spark, sf_dir, "hits_fwd"), view(spark, sf_dir, "hits_rev")
    whole = hits.reciprocal_best(table, back)
    for name in ("A", "N", "R"):
        alone = hits.reciprocal_best(table.where(F.col("list_id") == name), back.where(F.col("list_id") == name))
        assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, whole.where(F.col("list_id") == name).collect()))


@pytest.mark.parametrize("function", [hits.best_hits, hits.unique_hits, hits.best_hsps, hits.extract_queries, hits.extract_targets, lambda t: hits.filter_pident(t, 80), lambda t: hits.filter_bitscore(t, 30000)])
def test_one_list_is_the_case_of_one_key(spark, sf_dir, function):
    from phylospark.plans.views import view

    table = view(spark, sf_dir, "hits_rev")
    whole = function(table)
    for name in ("A", "N"):
        alone = function(table.where(F.col("list_id") == name).drop("list_id"))
        assert sorted(map(repr, alone.collect())) == sorted(map(repr, whole.where(F.col("list_id") == name).drop("list_id").collect()))


def test_translated_search_maps_coordinates(spark):
    rng = random.Random(11)
    codons = [a + b + c for a in "ACGT" for b in "ACGT" for c in "ACGT" if sequences.translate_sequence(a + b + c) != "*"]
    gene = "".join(rng.choice(codons) for _ in range(40))
    protein = sequences.translate_sequence(gene)
    turned = gene[::-1].translate(str.maketrans("ACGT", "TGCA"))
    q = spark.createDataFrame([("p", protein)], "seq_id string, seq string")
    s = spark.createDataFrame([("fwd", "CC" + gene + "A" * 7), ("rev", "ACCA" + turned + "GG")], "seq_id string, seq string")
    found = {r["subjectid"]: (r["qstart"], r["qend"], r["sstart"], r["send"]) for r in search.translated_search(1e-6, q, s, "tblastn").collect() if r["alignmentlength"] >= 40}
    assert found == {"fwd": (1, 40, 3, 122), "rev": (1, 40, 124, 5)}


def test_ranges(spark):
    got = lambda df: [r["value"] for r in df.orderBy("pos").collect()]
    assert got(numbers.range_add(spark, 1, 10, 2)) == [1, 3, 5, 7, 9]
    assert got(numbers.range_exponent(spark, 1.5, 1, 10, 4)) == pytest.approx([1.5, 7.59375, 38.443359375])
    assert got(numbers.range_integers(spark, 3, 1)) == [3, 2, 1]
    assert got(numbers.range_length(spark, 0, 1, 5)) == [0, 0.25, 0.5, 0.75, 1]
    assert got(numbers.range_multiply(spark, 1, 100, 3)) == [1, 3, 9, 27, 81]
    with pytest.raises(ValueError):
        numbers.range_multiply(spark, 1, 100, 0.5)


def test_sweep_equals_filtering(spark, sf_dir):
    from phylospark.plans.views import view

    table = view(spark, sf_dir, "hits_fwd")
    cutoffs = [0.0, 0.001, 0.002, 0.05]
    swept = {r["cutoff"]: r["n"] for r in sweeps.sweep_cutoff(table, "evalue", cutoffs).collect()}
    assert swept == {c: hits.filter_evalue(table, c).count() for c in cutoffs}


def test_parse_searches(spark):
    texts = ["Synechococcus elongatus PCC maga (refseq)", "Homo sapiens", "E. coli (ensemblgenomes GCA_1.1)", "Mus musculus (GRCm38.p6)"]
    rows = [tuple(r) for r in readers.parse_searches(spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1)).collect()]
    assert rows == [("Synechococcus elongatus PCC maga", "refseq", "NA"), ("Homo sapiens", "NA", "NA"), ("E. coli", "ensemblgenomes", "GCA_1.1"), ("Mus musculus", "NA", "GRCm38.p6")]
    with pytest.raises(Exception, match="not a search"):
        readers.parse_searches(spark.createDataFrame([("a (b) c",)], "value string")).collect()


def test_fasta_round_trip(spark, tmp_path):
    text = ">id1 first > one\nACGT\nAC\n>id2\nTTT\n"
    (tmp_path / "a.fa").write_text(text)
    rows = [tuple(r) for r in readers.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("pos").select("seq_id", "header", "seq").collect()]
    assert rows == [("id1", "id1 first > one", "ACGTAC"), ("id2", "id2", "TTT")]
    writers.write_fasta(readers.read_fasta(spark, str(tmp_path / "a.fa")).withColumn("seq", F.repeat("seq", 30)), str(tmp_path / "out"))
    again = readers.read_fasta(spark, str(tmp_path / "out"))
    assert sorted(r["seq"] for r in again.collect()) == sorted(["ACGTAC" * 30, "TTT" * 30])


def test_hit_files(spark, tmp_path):
    good = "q\ts\t23.6\t394\t261\t14\t1\t380\t1\t368\t1.05e-10\t55.5\n"
    (tmp_path / "a.bht").write_text(good + "<<emptybht>>\n")
    assert [r["evalue"] for r in readers.read_hits(spark, str(tmp_path / "a.bht")).collect()] == [1.05e-10]
    (tmp_path / "b.bht").write_text("q\ts\t1\n")
    with pytest.raises(Exception, match="not a hit table"):
        readers.read_hits(spark, str(tmp_path / "b.bht")).collect()
    writers.write_hits(readers.read_hits(spark, str(tmp_path / "a.bht")), str(tmp_path / "out"))
    assert readers.read_hits(spark, str(tmp_path / "out")).count() == 1


def test_other_text_sources(spark, tmp_path):
    (tmp_path / "h.txt").write_text("# c\nt1 - q1 - 1e-9 30.1 0.0 1 2 some words\n")
    row = readers.read_hmm_hits(spark, str(tmp_path / "h.txt")).first()
    assert (row["target"], row["query"], row["evalue"], row["rest"]) == ("t1", "q1", 1e-9, "1 2 some words")
    (tmp_path / "og.txt").write_text("OG0000000: a b\nOG0000001: c\n")
    assert sorted(map(tuple, readers.read_orthogroups(spark, str(tmp_path / "og.txt"), "orthofinder").collect())) == [("OG0000000", "a"), ("OG0000000", "b"), ("OG0000001", "c")]
    (tmp_path / "crb.tsv").write_text("q\ts\t90\t10\t1e-5\t50\t1..10\t2..11\t100\t200\n")
    row = readers.read_crb(spark, str(tmp_path / "crb.tsv")).first()
    assert (row["qstart"], row["qend"], row["sstart"], row["send"]) == (1, 10, 2, 11)
    (tmp_path / "l.txt").write_text("x\ny\n")
    assert values(readers.read_list(spark, str(tmp_path / "l.txt"))) == ["x", "y"]
    assert readers.list_files(spark, str(tmp_path), "*.txt").count() == 3


def test_genbank(spark, tmp_path):
    from phylospark.sources.genbank import gbk_to_faa, gbk_to_fna

    text = """LOCUS       TEST 24 bp DNA
DEFINITION  a test
            record.
VERSION     T1.1
FEATURES             Location/Qualifiers
     source          1..24
     CDS             complement(join(1..3,7..9))
                     /locus_tag="L1"
                     /product="a
                     protein"
     CDS             10..18
                     /gene="g"
                     /translation="M
                     K"
ORIGIN
        1 catgggtttc atgaaataac cccc
//
"""
    (tmp_path / "a.gbk").write_text(text)
    features, records = readers.read_genbank(spark, str(tmp_path / "a.gbk"))
    assert records.first()["seq"] == "CATGGGTTTCATGAAATAACCCCC" and features.count() == 3
    dna = {r["seq_id"]: (r["header"], r["seq"]) for r in gbk_to_fna("cds", features, records).collect()}
    assert dna == {"L1": ("L1 | L1 | a protein | 0:9 Reverse", "AAAATG"), "g": ("g | g | missing_product_qualifer | 9:18 Forward", "CATGAAATA")}
    assert {r["seq_id"]: r["seq"] for r in gbk_to_faa("cds", features, records).collect()} == {"L1": "KM", "g": "MK"}
    assert gbk_to_fna("whole", features, records).count() == 1


def test_translation():
    assert sequences.translate_sequence("ATGTAAGCNAAACC") == "M*XK"
    assert sequences.translate_sequence("augtaa") == "M*"


def test_search_finds_planted_hits(spark):
    rng = random.Random(5)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    core = dna(80)
    q = spark.createDataFrame([("q1", core), ("q2", dna(60))], "seq_id string, seq string")
    s = spark.createDataFrame([("s1", dna(50) + core[:40] + "A" + core[41:] + dna(20)), ("s2", dna(200))], "seq_id string, seq string")
    found = search.search(1e-6, q, s).collect()
    assert [(r["queryid"], r["subjectid"], r["qstart"], r["sstart"]) for r in found] == [("q1", "s1", 1, 51)] and found[0]["mismatches"] <= 1
    assert search.search_rbh(1e-6, q, s).count() == 1
    scale = search.score_scale(4, 1.0, -3.0)
    import math

    assert 0.25 * math.exp(scale) + 0.75 * math.exp(-3 * scale) == pytest.approx(1)


def test_hashed_ids_come_back(spark):
    seqs = spark.createDataFrame([("a", "a long header"), ("b", "b")], "seq_id string, header string")
    hashed, idmap = ids.hash_ids(seqs, 10)
    assert values(ids.unhash_ids(hashed, idmap, ["seq_id"]), "seq_id") == ["a", "b"]
    assert values(ids.unhash_ids(hashed, idmap, ["seq_id"], long=True), "seq_id") == ["a long header", "b"]
    texts = hashed.select(F.concat(F.lit("<"), "seq_id", F.lit("> seqid_zz")).alias("t"), F.col("header").alias("k"))
    assert values(ids.unhash_text(texts, idmap, "t", "k"), "t") == ["<a> seqid_zz", "<b> seqid_zz"]


def test_streamed_best_hits(spark, tmp_path):
    from phylospark.streaming.hits import filtered, running_best_hits, stream_hits

    (tmp_path / "in").mkdir()
    for i, e in enumerate(("1e-5", "1e-9", "1e-2")):
        (tmp_path / "in" / f"{i}.tsv").write_text(f"q\ts{i}\t90\t10\t0\t0\t1\t10\t1\t10\t{e}\t50\n")
    stream = running_best_hits(filtered(stream_hits(spark, str(tmp_path / "in"), 1), evalue=1e-3))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("best").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert [(r["queryid"], r["subjectid"]) for r in spark.sql("SELECT * FROM best").collect()] == [("q", "s1")]


def test_protein_scores():
    table, scale, big_k, k = search.score_table("protein")
    letters = [ord(c) for c in search.AMINO_ACIDS]
    assert (table == table.T).all() and (table[letters, letters] >= 4).all() and table[ord("W"), ord("W")] == 11 and table[ord("E"), ord("D")] == 2 and table[ord("I"), ord("V")] == 3
    # Background shares of amino acids in proteins: with them the mean of exp(lambda * score) is one.
    shares = dict(zip("ARNDCQEGHILKMFPSTWYV", (0.078, 0.051, 0.045, 0.054, 0.019, 0.043, 0.063, 0.074, 0.022, 0.051, 0.091, 0.057, 0.022, 0.039, 0.052, 0.071, 0.058, 0.013, 0.032, 0.064)))
    assert abs(sum(a * b * 2.718281828 ** (scale * table[ord(x), ord(y)]) for x, a in shares.items() for y, b in shares.items()) - 1) < 0.02


def test_search_finds_every_diagonal_and_lists_apart(spark):
    rng = random.Random(3)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    gene, other = dna(120), dna(90)
    q = spark.createDataFrame([("q", gene)], "seq_id string, seq string")
    s = spark.createDataFrame([("l1", "g", dna(30) + gene[:60] + dna(50) + gene[60:]), ("l2", "g", gene), ("l2", "h", other)], "list_id string, seq_id string, seq string")
    both = search.search(1e-6, q, s.where("list_id = 'l1'").drop("list_id")).collect()
    assert min(r["qstart"] for r in both) == 1 and max(r["qend"] for r in both) == 120
    assert len([r for r in both if r["alignmentlength"] >= 50]) == 2
    found = {(r["list_id"], r["subjectid"]) for r in search.search_rbh(1e-6, q, s, by=["list_id"]).collect()}
    assert found == {("l1", "g"), ("l2", "g")}
    assert {r["list_id"] for r in search.search_rev(1e-6, q, s, by=["list_id"]).collect()} == {"l1", "l2"}


def test_prefix_lookups_by_length(spark):
    seqs = spark.createDataFrame([(f"seqid_{i:04d}",) for i in range(300)] + [("x",)], "seq_id string")
    asked = spark.createDataFrame([("seqid_00",), ("seqid_0299",), ("seqid_02990",), ("x",), (None,)], "value string")
    assert values(ids.extract_seqs(seqs, asked), "seq_id") == sorted([f"seqid_{i:04d}" for i in range(100)] + ["seqid_0299", "x"])
    assert ids.extract_seqs(seqs, asked.limit(0)).count() == 0


def test_hashed_ids_lead_back_at_their_defaults(spark):
    _, idmap = ids.hash_ids(spark.createDataFrame([("alpha one", "ACGT")], "header string, seq string"))
    texts = spark.createDataFrame([(1, "see " + idmap.first()["hash"] + "!")], "k long, t string")
    assert values(ids.unhash_text(texts, idmap, "t", "k"), "t") == ["see alpha!"]


def test_group_lookups_by_prefix(spark):
    og = spark.createDataFrame([(1, "gene1"), (1, "gene10"), (2, "other")], "group_id long, member string")
    assert values(groups.orthogroup_containing(og, "gene1"), "member") == ["gene1", "gene10"]
    assert values(groups.orthogroup_containing(og, "oth"), "member") == ["other"]
    for wrong in ("none", "gene"):
        with pytest.raises(ValueError):
            groups.orthogroup_containing(og, wrong)


def test_replace_each_calls_functions_of_plain_values(spark):
    made = sweeps.replace_each(lambda v: spark.range(v), [1, 3])
    assert sorted(map(tuple, made.select("pos", "variant", "id").collect())) == [(0, 1, 0), (1, 3, 0), (1, 3, 1), (1, 3, 2)]


@pytest.mark.parametrize("wrong", [(1, 20, -2), (0, 5, 2), (-1, 5, 2), (1, 20, 0), (1, 20, 0.5), (1, 20, 1)])
def test_multiplied_ranges_refuse(spark, wrong):
    with pytest.raises(ValueError):
        numbers.range_multiply(spark, *wrong)


def test_membership_tables_are_in_numeric_order(spark):
    data, _ = items(spark, [10, 9, 100], [9, "b", "a"])
    assert [r["value"] for r in sets.sets_table(data, ["0", "1"]).collect()] == ["9", "10", "100", "a", "b"]


def test_missing_scores_are_an_error(spark):
    scores = spark.createDataFrame([("a", 50.0)], "fasta string, complete double")
    asked = spark.createDataFrame([("a",), ("b",)], "value string")
    with pytest.raises(Exception, match="no score for b"):
        readers.busco_filter_completeness(10, scores, asked).collect()


def test_errors_survive_column_pruning(spark, tmp_path):
    """Whatever is read of the result, a row that must not be there is an error."""
    table = hit_table(spark, [("a", "x", None, None), ("b", "y", 1e-9, 2.0)]).withColumn("pident", F.when(F.col("queryid") == "b", 90.0))
    a, b = items(spark, ["p", "q"])[0], items(spark, ["p"])[0]
    strings = spark.createDataFrame([("a (b) c",)], "value string")
    (tmp_path / "bad.bht").write_text("q\ts\t1\n")
    scores, asked = spark.createDataFrame([("a", 50.0)], "fasta string, complete double"), spark.createDataFrame([("b",)], "value string")
    made = {
        "evalue is null": hits.filter_evalue(table, 1e-5), "bitscore is null": hits.filter_bitscore(table, 1), "pident is null": hits.filter_pident(table, 80), "unequal length": sets.zip_lists(a, b),
        "not a search": readers.parse_searches(strings), "not a hit table": readers.read_hits(spark, str(tmp_path / "bad.bht")), "no score for b": readers.busco_filter_completeness(10, scores, asked),
    }
    for message, df in made.items():
        for some in [df, *[df.select(c) for c in df.columns]]:
            with pytest.raises(Exception, match=message):
                some.count()
            with pytest.raises(Exception, match=message):
                some.collect()
    with pytest.raises(Exception, match="evalue is null"):
        hits.extract_queries(hits.filter_evalue(table, 1e-5)).collect()


def test_set_goldens(spark):
    """Two lists and three, each operation with its own answer."""
    a, b = spark.createDataFrame([("a", i, v) for i, v in enumerate("wxyz")], "list_id string, pos long, value string"), spark.createDataFrame([("b", i, v) for i, v in enumerate("yzv")], "list_id string, pos long, value string")
    assert values(sets.union(a, b)) == ["v", "w", "x", "y", "z"]
    assert values(sets.intersection(a, b)) == ["y", "z"]
    assert values(sets.difference(a, b)) == ["w", "x"] and values(sets.difference(b, a)) == ["v"]
    c = spark.createDataFrame([("c", 0, "z"), ("c", 1, "w"), ("c", 2, "w")], "list_id string, pos long, value string")
    regions = {r["lists"]: r["n"] for r in sets.set_regions(a.unionByName(b).unionByName(c)).collect()}
    assert regions == {"a": 1, "b": 1, "a,b": 1, "a,c": 1, "a,b,c": 1}


def test_grid_sweep_equals_filtering(spark):
    """Over more cutoffs than one step of the lookup holds, with ties, nulls and cutoffs that nothing passes."""
    rng = random.Random(7)
    rows = [(f"q{rng.randrange(30)}", rng.choice([None, *[i / 4 for i in range(60)]]), rng.choice([None, *range(0, 400, 5)])) for _ in range(500)]
    table = spark.createDataFrame([(q, e, None if b is None else float(b)) for q, e, b in rows], "queryid string, evalue double, bitscore double")
    first, second = [i / 5 - 1 for i in range(70)], [0.0, 50.0, 50.5, 200.0, 395.0, 1000.0]
    found = {(r["first_cutoff"], r["second_cutoff"]): (r["hits"], r["queries"]) for r in sweeps.sweep_grid(table, ("evalue", "bitscore"), (first, second)).collect()}
    kept = {(x, y): [q for q, e, b in rows if e is not None and b is not None and e <= x and b >= y] for x in first for y in second}
    assert found == {k: (len(v), len(set(v))) for k, v in kept.items()}
    both = {r["cutoff"]: (r["hits"], r["queries"]) for r in sweeps.sweep_both(table, "evalue", first).collect()}
    assert both == {x: (len(v), len(set(v))) for x in first for v in [[q for q, e, _ in rows if e is not None and e <= x]]}
    nameless = spark.createDataFrame([(None, 0.5), (None, 0.1), ("q", 0.5), ("q", None)], "queryid string, evalue double")
    assert [tuple(r) for r in sweeps.sweep_both(nameless, "evalue", [0.0, 0.1, 0.5]).orderBy("cutoff").collect()] == [(0.0, 0, 0), (0.1, 1, 1), (0.5, 3, 2)]
    assert [tuple(r) for r in sweeps.sweep_both(nameless.limit(0), "evalue", [0.1]).collect()] == [(0.1, 0, 0)]
    assert {r["cutoff"]: r["n"] for r in sweeps.sweep_cutoff(table, "bitscore", second, "queries", False).collect()} == {y: len({q for q, _, b in rows if b is not None and b >= y}) for y in second}


def test_long_multiplied_ranges(spark):
    steps = numbers.range_multiply(spark, 1, 10, 1.00001)
    assert steps.count() == 230_260 and abs(steps.agg(F.max("value")).first()[0] - 10) < 1e-4
    assert 693_147_000 < numbers.range_multiply(spark, 1, 2, 1 + 1e-9).count() < 693_147_300
    assert [r["value"] for r in numbers.range_multiply(spark, 1000, 1, 0.1).orderBy("pos").collect()] == pytest.approx([1000, 100, 10, 1])
    assert [r["value"] for r in numbers.range_multiply(spark, -1, -9, 3).orderBy("pos").collect()] == [-1, -3, -9]


def test_lists_of_equal_content(spark):
    made = {"a": "xyz", "b": "zyx", "c": "xxyz", "d": "xyzz", "e": [None, "x"], "f": ["x", None], "g": "x", "h": [], "i": []}
    rows = [(n, i, v) for n, vs in made.items() for i, v in enumerate(vs)]
    lists = spark.createDataFrame([(n, i) for i, n in enumerate(made)], "list_id string, pos long")
    kept = sets.dedup_lists_by_content(spark.createDataFrame(rows, "list_id string, pos long, value string"), lists)
    assert values(kept, "list_id") == ["a", "c", "d", "e", "g", "h"]


def test_features_are_cut_inside_their_record(spark, tmp_path):
    from phylospark.sources.genbank import gbk_to_faa, gbk_to_fna, parsed_to_fasta

    body = "LOCUS       {n} DNA\nVERSION     {n}\nFEATURES             Location/Qualifiers\n     CDS             complement(1..9)\n                     /gene=\"{n}a\"\n     CDS             join(1..3,7..12)\n                     /gene=\"{n}b\"\nORIGIN\n        1 atgaaacccg ggttt\n//\n"
    (tmp_path / "a.gbk").write_text("".join(body.format(n=f"R{i}") for i in range(20)))
    parsed = readers.parse_genbank(spark, str(tmp_path / "a.gbk"))
    features, records = readers.read_genbank(spark, str(tmp_path / "a.gbk"))
    for protein, pair in ((True, gbk_to_faa), (False, gbk_to_fna)):
        for kind in ("cds", "whole"):
            got = parsed_to_fasta(parsed, kind, protein)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pair(kind, features, records).collect())) and got.count() == (40 if kind == "cds" else 20)
        plan = parsed_to_fasta(parsed, "cds", protein)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInPandas") == 1 and "Join" not in plan and "Exchange" not in plan


def test_map_each_in_parts(spark):
    """One list with most rows: every call sees a bounded number of them."""
    import pandas as pd

    from phylospark.operators import mapping

    rows = spark.range(0, 50_000, 1, 8).select(F.when(F.col("id") % 10 == 0, F.concat(F.lit("l"), F.col("id") % 7)).when(F.col("id") % 10 < 9, "big").alias("k"), "id")
    some = lambda p: pd.DataFrame({"n": [len(p)], "s": [p["id"].sum()], "widest": [len(p)]})
    merge = lambda p: pd.DataFrame({"n": [p["n"].sum()], "s": [p["s"].sum()], "widest": [max(p["widest"].max(), len(p))]})
    made = mapping.map_each_in_parts(rows, ["k"], some, merge, lambda p: p, "n long, s long, widest long", "n long, s long, widest long")
    got = {r["k"]: (r["n"], r["s"]) for r in made.collect()}
    assert got == {r["k"]: (r["n"], r["s"]) for r in rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("s")).collect()} and None in got
    assert made.agg(F.max("widest")).first()[0] <= 10_000


def test_prefixes_of_a_thousand_lengths(spark):
    """Nested prefixes of every length among unrelated ones: the same pairs as a plain search, rows not multiplied by lengths."""
    rng = random.Random(10)
    stem = "".join(rng.choice("ab") for _ in range(1200))
    asked = [stem[:n] for n in range(3, 1003)] + ["", "x", "xyz", "ab" * 30, "zz", "é", "éa"]
    rows = [stem[: rng.randrange(1200)] + rng.choice(["", "c", "zz"]) for _ in range(60)] + ["x", "xy", "xyzw", "zz", "", "w", "ab" * 40, "éab", "~", None]
    seqs = spark.createDataFrame([(r,) for r in rows], "seq_id string").repartition(5)
    table = spark.createDataFrame([(a,) for a in [*asked, None]], "value string")
    wanted = sorted(r for r in rows if r is not None and any(r.startswith(a) for a in asked))
    assert values(ids.extract_seqs(seqs, table), "seq_id") == wanted
    idmap = seqs.where("seq_id is not null").select(F.md5("seq_id").alias("hash"), F.col("seq_id").alias("header"))
    found = sorted({(r["value"], r["header"]) for r in ids.lookup_ids(idmap, table).collect() if r["header"] is not None})
    assert found == sorted({(a, r) for a in asked for r in rows if r is not None and r.startswith(a)})


def test_cut_tables_can_be_removed(spark):
    import os

    from phylospark import shared

    path = shared.cut(spark.range(5)).inputFiles()[0].removeprefix("file:").replace("//", "")
    assert os.path.exists(path)
    assert shared.clear(spark) > 0 and not os.path.exists(path)


def test_summaries_of_many_a_file(spark, sf_dir, tmp_path, monkeypatch):
    """The query writes no file for each summary; summaries of several lines stay whole, and a file of one is read as before."""
    from phylospark.plans import files, queries

    texts = [f"# for file f{i}\nC:{i}.5%[S:{i}.1%,D:0.4%],F:1.5%,M:3.0%,n:9\n\nend" for i in range(50)]
    spark.createDataFrame([(t,) for t in texts], "text string").coalesce(2).write.option("lineSep", "\n//\n").text(str(tmp_path / "many"))
    assert sorted(r["text"] for r in readers.read_busco_summaries(spark, str(tmp_path / "many"), "\n//\n").collect()) == sorted(texts)
    (tmp_path / "one").write_text(texts[3])
    assert [r["text"] for r in readers.read_busco_summaries(spark, str(tmp_path / "one")).collect()] == [texts[3]]
    made = []
    monkeypatch.setattr(files, "_new", lambda df: made.append(str(tmp_path / f"q{len(made)}")) or made[-1])
    found = queries.QUERIES["read_busco_summaries"](spark, sf_dir)
    assert found.agg({"n": "sum"}).first()[0] == spark.read.parquet(f"{sf_dir}/part.parquet").count()
    assert len([p for folder in made for p in __import__("pathlib").Path(folder).rglob("*.txt")]) <= 16
