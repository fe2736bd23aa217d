"""Search: extension with a drop-off, real letters, common k-mers, tiles, lasting index."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from phylospark.functions import sequences
from phylospark.operators import search

SEQS = "seq_id string, seq string"


def dna(rng, n, letters="ACGT"):
    return "".join(rng.choice(letters) for _ in range(n))


def plain_segments(cells, seeds, drop):
    """Letter by letter: seeds from left to right, each walked both ways until the sum is more than ``drop`` below its best."""
    found, reach = [], -1

    def walk(places):
        total = best = 0.0
        length = seen = 0
        for i in places:
            total, seen = total + cells[i], seen + 1
            if total > best:
                best, length = total, seen
            if best - total > drop:
                break
        return best, length, seen

    for p in seeds:
        if p > reach:
            right, ahead, seen = walk(range(p, len(cells)))
            left, back, _ = walk(range(p - 1, -1, -1))
            found.append((right + left, p - back, p + ahead))
            reach = p + seen - 1
    return found


def test_extension_equals_plain_walks():
    rng = random.Random(8)
    table = search.score_table("dna")[0]
    many = 0
    for _ in range(400):
        n, k = rng.randint(0, 400), rng.choice([3, 5, 8])
        q, rate = dna(rng, n, "ACGTN"), [rng.choice([0.02, 0.1, 0.6]) for _ in range(1 + n // 40)]
        s = "".join(rng.choice("ACGT") if rng.random() < rate[i // 40] else c for i, c in enumerate(q))
        same = [a == b != "N" for a, b in zip(q, s)]
        cells = [1.0 if x else -3.0 for x in same]
        seeds = [i for i in range(n - k + 1) if all(same[i : i + k])]
        drop = rng.choice([3.0, 10.0, 20.0])
        found, beyond = search.extend_seeds(q, s, table, "ACGT", k, drop)
        assert [x[:3] for x in found] == plain_segments(cells, seeds, drop) and not beyond
        assert all(m == sum(same[a:b]) for _, a, b, m in found)
        assert all(a[2] <= b[1] for a, b in zip(found, found[1:])), "segments overlap"
        many += len(found) > 1
    assert many > 40


def test_two_stretches_on_one_diagonal_are_two_hits(spark):
    rng = random.Random(1)
    gene = dna(rng, 300)
    broken = gene[:100] + "".join({"A": "C", "C": "A", "G": "T", "T": "G"}[c] for c in gene[100:200]) + gene[200:]
    found = search.search(1e-6, spark.createDataFrame([("q", gene)], SEQS), spark.createDataFrame([("s", broken)], SEQS)).collect()
    assert sorted((r["qstart"], r["qend"], r["sstart"], r["send"]) for r in found) == [(1, 100, 1, 100), (201, 300, 201, 300)]
    assert {r["pident"] for r in found} == {100.0}


def test_long_extensions_leave_the_margin(spark, monkeypatch):
    rng = random.Random(6)
    core = dna(rng, 900)
    sparse = "".join(c if i % 9 else {"A": "C", "C": "G", "G": "T", "T": "A"}[c] for i, c in enumerate(core))
    seqs = [("q", core[:300] + dna(rng, 40) + core[300:])], [("s", sparse[:300] + dna(rng, 40) + sparse[300:600] + core[600:])]
    made = [spark.createDataFrame(rows, SEQS) for rows in seqs]
    whole = sorted(map(tuple, search.search(1e-3, *made).collect()))
    monkeypatch.setattr(search, "MARGIN", 5)
    assert sorted(map(tuple, search.search(1e-3, *made).collect())) == whole
    assert max(r[3] for r in whole) > 300


def test_case_and_unknown_letters(spark):
    rng = random.Random(2)
    gene = dna(rng, 300)
    one = lambda name, s: spark.createDataFrame([(name, s)], SEQS)
    for a, b in ((gene, gene.lower()), (gene.lower(), gene), (gene.replace("T", "u"), gene)):
        row = search.search(1e-6, one("q", a), one("s", b)).collect()
        assert [(r["qstart"], r["qend"], r["pident"]) for r in row] == [(1, 300, 100.0)]
    assert search.search(10, one("q", dna(rng, 200) + "N" * 100), one("s", "N" * 100 + dna(rng, 200))).count() == 0
    row = search.search(1e-6, one("q", gene[:150] + "N" + gene[151:]), one("s", gene[:150] + "N" + gene[151:])).first()
    assert (row["alignmentlength"], row["mismatches"]) == (300, 1)
    protein = dna(rng, 120, search.AMINO_ACIDS)
    row = search.search(1e-6, one("q", protein), one("s", protein.lower()), "protein").first()
    assert (row["qstart"], row["qend"], row["mismatches"]) == (1, 120, 0)
    assert search.search(10, one("q", "X" * 80), one("s", "X" * 80), "protein").count() == 0


def test_common_kmers_are_split_without_loss(spark):
    """One k-mer at thousands of places of both sides: the same pairs, and no part with more than its share."""
    rng = random.Random(4)
    word = "ACGTACGTTGCATG"
    rows = lambda name, n: spark.createDataFrame([(f"{name}{i}", dna(rng, 20) + word + dna(rng, 20)) for i in range(n)], SEQS)
    q = search.kmer_index(rows("q", 1500), 14).select(F.col("seq_id").alias("queryid"), "kmer", F.col("kpos").alias("qpos"))
    s = search.kmer_index(rows("s", 2000), 14).select(F.col("seq_id").alias("subjectid"), "kmer", F.col("kpos").alias("spos"))
    common = search.common_kmers(s, share=1000, least=1400)
    assert set(common) == {word} and common[word] >= 20
    split = search.seed_join(q, s, share=1000, least=1400)
    plain = search.seed_join(q, s, share=1, least=10**9)
    totals = [df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("queryid", "subjectid", "kmer", "qpos", "spos").cast("decimal(38,0)"))).first() for df in (split, plain)]
    assert totals[0] == totals[1] and totals[0][0] >= 1500 * 2000
    assert "_l_" in split._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size", [3, 7, 64])
def test_tiles_give_what_whole_sequences_give(spark, monkeypatch, size):
    rng = random.Random(size)
    monkeypatch.setattr(sequences, "PIECE", 3)
    rows = [(f"s{n}", dna(rng, n, "ACGTN")) for n in [0, 1, 2, 3, 4, 5, 6, 7, 20, 63, 64, 65, 200, 401]]
    seqs = spark.createDataFrame([*rows, ("null", None)], SEQS)
    for k in (1, 4, 11):
        got = sequences.kmer_rows(sequences.tiles(seqs, k - 1, size), k)
        assert sorted((r["seq_id"], r["offset"] + r["at"], r["kmer"]) for r in got.collect()) == sorted((n, i, s[i : i + k]) for n, s in rows for i in range(len(s) - k + 1))

    def joined(tiled, *keys):
        made = {}
        for r in sorted(tiled.collect(), key=lambda r: r["offset"]):
            at = tuple(r[k] for k in keys)
            assert r["offset"] == len(made.get(at, ""))
            made[at] = made.get(at, "") + r["seq"]
        return made

    frames = {(r["seq_id"], r["frame"]): r["seq"] for r in sequences.six_frames(seqs.where("seq is not null")).collect() if r["seq"]}
    assert joined(sequences.six_frame_tiles(seqs, size), "seq_id", "frame") == frames
    first = {(r["seq_id"],): r["seq"] for r in sequences.translate_seqs(seqs.where("seq is not null")).collect() if r["seq"]}
    assert joined(sequences.translated_tiles(seqs, size), "seq_id") == first


def test_kmers_cut_from_bytes_are_those_of_the_string(spark):
    """Letters of several bytes, line ends, other letters, short, empty and null sequences; a column named like the inner ones."""
    texts = ["", "AC", "ACGT", "ACGTNACGTACG", "acgtACGT", "ÄCGTACGTÄ", "AC\nGTACGT", "日本語ACGTA", "ACGT😀ACGT", None]
    seqs = spark.createDataFrame([(f"s{i}", t, i) for i, t in enumerate(texts)], "seq_id string, seq string, _at int")
    for k in (1, 3, 4):
        plain = [(f"s{i}", i, at, t[at : at + k]) for i, t in enumerate(texts) if t is not None for at in range(len(t) - k + 1)]
        for letters, wanted in ((None, plain), ("ACGT", [x for x in plain if set(x[3]) <= set("ACGT")])):
            got = sequences.kmer_rows(seqs, k, letters)
            assert got.columns == ["seq_id", "_at", "at", "kmer"]
            assert sorted(map(tuple, got.collect())) == sorted(wanted)


def test_a_chromosome_is_read_in_tiles(spark):
    """Five million letters in one record: tiles of bounded length, and a search that finds what is planted at its end."""
    rng = random.Random(12)
    gene, piece = dna(rng, 400), dna(rng, 50_000)
    chromosome = spark.createDataFrame([("c", piece)], SEQS).select("seq_id", F.concat(F.repeat("seq", 100), F.lit(gene)).alias("seq"))
    longest = sequences.tiles(chromosome, 10).agg(F.max(F.length("seq")), F.count(F.lit(1))).first()
    assert tuple(longest) == (sequences.TILE + 10, -(-5_000_400 // sequences.TILE))
    found = search.search(1e-6, spark.createDataFrame([("q", gene)], SEQS), chromosome, k=14).collect()
    assert (found[0]["sstart"], found[0]["send"]) == (5_000_001, 5_000_400) and len(found) == 1


def test_lasting_index(spark):
    rng = random.Random(9)
    genes = [dna(rng, 200) for _ in range(12)]
    q = spark.createDataFrame([(f"q{i}", g) for i, g in enumerate(genes)], SEQS)
    s = spark.createDataFrame([(f"s{i}", dna(rng, 50) + g[:90] + dna(rng, 3) + g[90:] + "ACACACACACACACACACACACAC") for i, g in enumerate(genes)], SEQS)
    name = f"lasting_seeds_{uuid.uuid4().hex}"
    index = search.build_index(s, name, 11, buckets=8)
    assert sorted(map(tuple, search.search_index(1e-6, q, s, index, 11).collect())) == sorted(map(tuple, search.search(1e-6, q, s, k=11).collect()))
    seeds = search.kmer_index(q, 11).select(F.col("seq_id").alias("queryid"), "kmer", F.col("kpos").alias("qpos"))
    plan = search.indexed_seeds(seeds, spark.table(name))._jdf.queryExecution().executedPlan().toString()
    subjects = plan[plan.rindex("Sort [") :]
    assert "SortMergeJoin" in plan and "Bucketed: true" in subjects and "Exchange" not in subjects, plan
    spark.sql(f"DROP TABLE {name}")


def test_few_queries_go_to_the_subjects(spark, monkeypatch):
    """The subjects' k-mers are neither sketched nor exchanged if the queries are few; many queries give the same hits."""
    rng = random.Random(21)
    genes = [dna(rng, 150) for _ in range(6)]
    q = spark.createDataFrame([(f"q{i}", g) for i, g in enumerate(genes)], SEQS)
    s = spark.createDataFrame([(f"s{i}", dna(rng, 40) + g + dna(rng, 30)) for i, g in enumerate(genes * 2)], SEQS)
    sketches = []
    common = search.common_kmers
    monkeypatch.setattr(search, "common_kmers", lambda *a: sketches.append(1) or common(*a))
    runs = (lambda: search.search(1e-6, q, s, k=11), lambda: search.search_rev(1e-6, q, s, k=11), lambda: search.search_rbh(1e-6, q, s, k=11), lambda: search.seed_pairs(q, s, 11))
    sent = [sorted(map(tuple, run().collect())) for run in runs]
    assert not sketches and len(sent[0]) >= 12
    monkeypatch.setattr(search, "SENT_KMERS", 0)
    assert [sorted(map(tuple, run().collect())) for run in runs] == sent and len(sketches) == 8


def test_kmer_frequency_counts_in_tasks(spark):
    """Long sequences, ids that repeat, ids that are null, letters of several bytes; no row for each k-mer and sequence leaves a task."""
    rng = random.Random(22)
    rows = [(f"s{i}", dna(rng, rng.choice([0, 3, 4, 50]))) for i in range(40)] + [("long", dna(rng, 500) * 150), ("s1", "ACGTACGT"), ("s1", "ACGTTT"), (None, "ACGTACGTA"), (None, "ACGT"), ("w", "ÄÖ日本ACGT"), ("n", None)]
    seqs = spark.createDataFrame(rows, SEQS)
    ids, places = {}, {}
    for name, seq in rows:
        for i in range(len(seq or "") - 3):
            kmer = seq[i : i + 4]
            places[kmer] = places.get(kmer, 0) + 1
            ids.setdefault(kmer, set()).update({name} - {None})
    found = search.kmer_frequency(seqs, 4)
    assert sorted(map(tuple, found.collect())) == sorted((x, len(ids[x]), n) for x, n in places.items())
    assert "Generate" in found._jdf.queryExecution().executedPlan().toString() and "MapInPandas" in found._jdf.queryExecution().executedPlan().toString()


def test_translation_of_a_batch_is_that_of_each():
    rng = random.Random(23)
    seqs = [dna(rng, n, "ACGTUNacgtÄ日") for n in [0, 1, 2, 3, 4, 5, 6, 61, 0, 200]]
    assert sequences.translate_all(seqs) == [sequences.translate_sequence(x) for x in seqs] and sequences.translate_all([]) == []


@pytest.mark.parametrize("alphabet, k, block", [("dna", 11, 1 << 22), ("dna", 6, 300), ("dna", 20, 300), ("protein", 5, 300)])
def test_index_rows_hold_many_kmers(spark, monkeypatch, alphabet, k, block):
    """All places of all k-mers, over blocks and odd letters, in far fewer rows than k-mers; frequent ones are left out."""
    monkeypatch.setattr(search, "BLOCK", block)
    rng = random.Random(31)
    letters = search.letters_of(alphabet)
    rows = [(f"s{i}", dna(rng, rng.choice([0, k - 1, k, 200]), letters + "x")) for i in range(20)] + [("r", letters[:2] * 40), ("t", letters[:2] * 30), ("u", "é" + letters * 3)]
    s = spark.createDataFrame(rows, SEQS)
    q = search.kmer_index(search.plain_letters(s, alphabet), k, letters=letters).select(F.col("seq_id").alias("queryid"), "kmer", F.col("kpos").alias("qpos"))
    for most in (None, 1):
        name = f"lasting_seeds_{uuid.uuid4().hex}"
        index = search.build_index(s, name, k, alphabet, max_df=most, buckets=4)
        found = search.indexed_seeds(q, index).select("queryid", "subjectid", "kmer", "qpos", "spos").collect()
        other = search.kmer_index(search.plain_letters(s, alphabet), k, most, letters=letters).select(F.col("seq_id").alias("subjectid"), "kmer", F.col("kpos").alias("spos"))
        assert sorted(map(tuple, found)) == sorted(map(tuple, q.join(other, "kmer").select("queryid", "subjectid", "kmer", "qpos", "spos").collect())) and found
        assert "steps" not in index.columns
        spark.sql(f"DROP TABLE {name}")


@pytest.mark.parametrize("alphabet, k, size", [("dna", 14, 1.3), ("dna", 9, None), ("dna", 5, None), ("dna", 35, None), ("dna", 39, None), ("protein", 5, None), ("protein", 17, None)])
@pytest.mark.parametrize("compared", [0, 10**9])
def test_index_entries_tell_all_kmers(monkeypatch, alphabet, k, size, compared):
    monkeypatch.setattr(search, "COMPARED", compared)
    rng, letters = random.Random(k), search.letters_of(alphabet)
    some = "".join(rng.choice(letters[:2]) for _ in range(300))
    whole = "?".join([some, "".join(rng.choice(letters) for _ in range(3000)), some[40:90], "N" + some[:60] + "N" + some[10:80], letters[0] * 70, "", letters[:2]])
    at, first, rest = search._entries(whole.encode(), k, letters)
    _, step, kind = search._layout(k, letters)
    assert size is None or len(at) * (kind.itemsize + 3) < size * len(whole)
    rows = {h: rest[first == h].astype(kind).tobytes() + at[first == h].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes() for h in set(first.tolist())}
    kmers = sorted({whole[i : i + k] for i in range(len(whole) - k + 1)})
    heads, rests = search._lookups(kmers, letters)
    found = []
    for i, kmer in enumerate(kmers):
        for o in range(step):
            if heads[i, o] in rows:
                got = search._found(k, letters, rests[i, o : o + 1], np.array([o]), rows[heads[i, o]])
                found += [(kmer, int(x)) for x in got]
    assert sorted(found) == sorted((whole[i : i + k], i) for i in range(len(whole) - k + 1) if set(whole[i : i + k]) <= set(letters))
