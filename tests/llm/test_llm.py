"""Operators for training corpora against brute force, on small tables with odd rows."""

import json
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import phylospark.llm.queries as queries
from phylospark.llm import exact_dedup, html_wrappers, langid, license_texts, licenses, mixing, packing, quality, revisits, simhash, vafile

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, row string, _id long, h string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, copies, rows that repeat, and columns with clashing names."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    texts = [" ".join(word() for _ in range(rng.randint(1, 200))) for _ in range(40)]
    texts += [texts[0], texts[0] + " \n", texts[1].replace(" ", "\t"), None, None, "", "   ", "a", "12 34", "word " * 9000, "X Y <|endoftext|> 日本 ½", "ab" * 3000, texts[2] + " tail"]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", "Ä", None]), None, 1, "r", 2, "h") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], rows[45], (None, "no id", None, None, None, None, None, None, None), (7, "another text of id 7", "en", "s1", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def collect(df):
    return [r.asDict() for r in df.collect()]


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_dedup(odd, none):
    rows, found = collect(odd), collect(exact_dedup.exact_dedup(odd))
    assert len(found) == len(rows)
    classes = defaultdict(list)
    for r in rows:
        classes[bare(r["text"])].append(r)
    by_sha = defaultdict(list)
    for f in found:
        by_sha[f["text_sha256"]].append(f)
    import hashlib

    for b, members in classes.items():
        made = by_sha[hashlib.sha256(b.encode()).hexdigest()]
        best = min(members, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
        assert {f["keep_id"] for f in made} == {best["doc_id"]} and {f["group_size"] for f in made} == {len(members)}
        assert sum(f["kept"] for f in made) == 1 and len(made) == len(members)
    assert collect(exact_dedup.exact_dedup(none)) == []
    kept = exact_dedup.keep_first_copies(odd)
    assert kept.columns == odd.columns and sorted(bare(r["text"]) for r in kept.collect()) == sorted(classes)
    assert exact_dedup.keep_first_copies(none).count() == 0


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(0)
    parts = [rng.integers(0, 500, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(5)]
    blocks = defaultdict(list)
    for p in parts:
        for block, *rest in exact_dedup.build_filter(*np.unique(p, return_counts=True), 6, 4):
            blocks[block].append(tuple(rest))
    got = {}
    for block, filters in blocks.items():
        for q, r, c in zip(*exact_dedup.merge_filters(filters)):
            got[(block << 58) | (int(q) << 54) | int(r)] = int(c)
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    assert got == dict(zip(values.tolist(), counts.tolist()))


@pytest.mark.parametrize("slots", [1 << 20, 4])
def test_repeated_fingerprints(spark, slots):
    """In one step and, with small blocks, in two salted ones."""
    rng = random.Random(5)
    values = [rng.randrange(-(2**63), 2**63) for _ in range(3000)]
    rows = values + values[:500] + [values[7]] * 4000
    found = exact_dedup.repeated_fingerprints(spark.createDataFrame([(v,) for v in rows], "fp long").repartition(9), len(rows), slots)
    assert {tuple(r) for r in found.collect()} == {(v, 4002 if v == values[7] else 2) for v in values[:500]}


def test_thin_filters_are_short():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 2**63, 65_000).astype(np.uint64) * np.uint64(2))
    made = exact_dedup.build_filter(values, np.ones(len(values), np.int64), 8, 17)
    assert sum(len(part) for f in made for part in f[1:]) / len(values) < 13
    alone = exact_dedup.build_filter(values, np.ones(len(values), np.int64), 16, 17)
    assert sum(len(part) for f in alone for part in f[1:]) / len(values) < 15
    assert [int(b) for b, *_ in alone] == sorted({int(v) >> 48 for v in values})


def test_exact_dedup_of_other_ids(spark):
    rows = [("b", "x  y"), ("a", "x y "), ("c", "xy"), (None, " x y"), ("d", None), ("e", "")]
    found = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert found == {"a": ("a", True), "b": ("a", False), "c": ("a", False), None: ("a", False), "d": ("d", True), "e": ("d", False)}


def water_filled(sizes):
    """The targets by bisection of the amount per unit of weight at which the capped shares add up to 150 %."""
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    lo, hi = 0.0, 2.0 * sum(sizes) + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(2 * s, w * mid) for s, w in zip(sizes, weights)) < 1.5 * sum(sizes) else (lo, mid)
    return [min(2 * s, w * hi) for s, w in zip(sizes, weights)]


def test_shares_are_those_of_water_filling():
    rng = random.Random(7)
    for _ in range(300):
        sizes = [rng.choice([0, 1, rng.randrange(10**6)]) for _ in range(rng.randint(1, 9))]
        got = mixing.share_out(sizes, [(3.0, 1.0, 2.0)[i % 3] for i in range(len(sizes))], 1.5 * sum(sizes), 2.0)
        assert got == pytest.approx(water_filled(sizes), rel=1e-9, abs=1e-6)


def test_mixing(odd, none):
    found = collect(mixing.mix_sources(odd))
    sizes = defaultdict(int)
    for r in odd.collect():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    shares = water_filled([sizes[n] for n in names])
    assert sum(shares) == pytest.approx(1.5 * sum(sizes.values()))
    taken, most = defaultdict(int), defaultdict(int)
    for r in found:
        taken[r["source"]] += r["taken"]
        most[r["source"]] = max(most[r["source"]], r["size"])
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(shares[names.index(r["source"])], rel=1e-6)
    for n, share in zip(names, shares):
        assert abs(taken[n] - share) <= most[n] * 3 and share <= 2 * sizes[n] + 1e-6
    again = collect(mixing.mix_sources(odd.repartition(7)))
    assert sorted(map(repr, again)) == sorted(map(repr, found))
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    assert sum(len(WORD.findall(r["text"] or "")) for r in mixed.collect()) == sum(r["taken"] for r in found)
    assert collect(mixing.mix_sources(none)) == [] and mixing.mixed_documents(none).count() == 0


def test_thresholds_come_near_on_many_documents(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 3 == 1, "y").otherwise("z").alias("source"))
    for r in mixing.mix_sources(docs).groupBy("source", "target").agg(F.sum("taken").alias("t")).collect():
        assert abs(r["t"] - r["target"]) <= 3


def brute_fingerprint(text):
    import xxhash

    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    marks = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(m >> b & 1 for m in marks) > len(marks))


def test_simhash(odd, none):
    found, want = collect(simhash.simhash_components(odd)), [(r["doc_id"], brute_fingerprint(r["text"])) for r in odd.collect()]
    assert sorted((str(f["doc_id"]), f["fingerprint"]) for f in found) == sorted((str(i), f"{m:016x}") for i, m in want)
    marks = {m for _, m in want}
    group = {m: m for m in marks}
    for _ in marks:
        for a in marks:
            group[a] = min(group[b] for b in marks if bin(a ^ b).count("1") <= 3)
    least = {g: min((i for i, m in want if group[m] == g and i is not None), default=None) for g in set(group.values())}
    assert all(f["component_id"] == least[group[int(f["fingerprint"], 16)]] for f in found)
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i in least.values())
    assert sorted(group[brute_fingerprint(r["text"])] for r in kept.collect()) == sorted(set(group.values()))
    assert collect(simhash.simhash_components(none)) == [] and simhash.one_of_each(none).count() == 0


def near_labels(marks):
    """Least fingerprint reachable, by brute force, of those that are near another one."""
    group = {m: m for m in marks}
    near = {a: [b for b in marks if bin((a ^ b) % 2**64).count("1") <= 3] for a in marks}
    while True:
        new = {a: min(group[b] for b in near[a]) for a in marks}
        if new == group:
            return {a: g for a, g in group.items() if len(near[a]) > 1}
        group = new


@pytest.mark.parametrize("common", [2, 10**6])
def test_near_components_are_those_of_all_pairs(spark, common):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(6)]
    marks = {b for b in base}
    for b in base:
        for _ in range(25):
            x = b
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << bit
            marks.add(x)
    chain = rng.getrandbits(64)
    for _ in range(30):  # each near the last one only
        for bit in rng.sample(range(64), 3):
            chain ^= 1 << bit
        marks.add(chain)
    signed = sorted(m - 2**64 if m >> 63 else m for m in marks)
    found = simhash.near_components(spark.createDataFrame([(m,) for m in signed], "fp long"), common=common).collect()
    assert dict(map(tuple, found)) == near_labels(signed) and len(found) == len({r["node"] for r in found})


def test_near_components_without_broadcasts(spark):
    """As in large tables: common signatures are refined and every join is a shuffled one."""
    rng = random.Random(7)
    base = rng.getrandbits(64)
    marks = {base}
    for _ in range(150):
        x = base
        for bit in rng.sample(range(64), rng.randint(1, 7)):
            x ^= 1 << bit
        marks.add(x)
    signed = sorted(m - 2**64 if m >> 63 else m for m in marks)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = simhash.near_components(spark.createDataFrame([(m,) for m in signed], "fp long"), common=2).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert dict(map(tuple, found)) == near_labels(signed) and len(found) == len({r["node"] for r in found})


def test_the_pipelines_near_copies_without_broadcasts(spark, monkeypatch):
    """Stage 3 where common signatures are refined by shuffled joins: one document of each group stays, the least id."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(150)]
    texts = {i: " ".join(w if rng.random() > i % 4 / 150 else "other" for w in words) for i in range(40)}
    marks = {i: brute_fingerprint(t) for i, t in texts.items()}
    near = near_labels(sorted(set(marks.values())))
    want = {}
    for i in sorted(texts):
        want.setdefault(near.get(marks[i], marks[i]), i)
    plain = simhash.near_components
    monkeypatch.setattr(simhash, "near_components", lambda distinct, most, common: plain(distinct, most, 2))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = [r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(kept) == sorted(want.values())


def test_a_dense_ball_makes_few_links(spark, monkeypatch):
    rng = random.Random(8)
    center, marks = rng.getrandbits(63), set()
    while len(marks) < 340:
        x = center
        for bit in rng.sample(range(12), rng.randint(0, 4)):
            x ^= 1 << bit
        marks.add(x)
    links, inner = [], simhash.connected_components
    monkeypatch.setattr(simhash, "connected_components", lambda edges: links.append(edges.count()) or inner(edges))
    found = dict(map(tuple, simhash.near_components(spark.createDataFrame([(m,) for m in marks], "fp long")).collect()))
    assert found == near_labels(sorted(marks)) and sum(links) < 40 * len(marks)


def test_top_k(spark):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(120)]
    rows += [(200 + i, rows[5][1]) for i in range(60)] + [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (304, []), (None, rows[0][1]), (400, [0.5, 0.5]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("dim", F.lit("x")).repartition(3)
    usable = {i: np.floor(np.array(v) * 64).astype(int) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in usable:
        if q % 20 == 0:
            scores = sorted((-int(usable[q] @ usable[v]), v) for v in usable if v != q and len(usable[v]) == len(usable[q]))[:20]
            want |= {(q, k + 1, v, -s) for k, (s, v) in enumerate(scores)}
    for cells in (2, 200):
        found = {tuple(r) for r in vafile.top_k(df, lambda c: c % 20 == 0, cells=cells).collect()}
        assert found == want
    assert vafile.top_k(df.limit(0), lambda c: c % 20 == 0).count() == 0


def test_top_k_of_common_queries_and_several_vectors(spark, monkeypatch):
    rows = [(20 * i, [1.0, 2.0]) for i in range(50)] + [(7, [3.0, 1.0]), (7, [4.0, 4.0]), (9, [0.0, 1.0]), (9, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    for common in (256, 3):
        monkeypatch.setattr(vafile, "COMMON_QUERY", common)
        found = vafile.top_k(df, lambda c: c % 20 == 0, k=4, scale=1.0).collect()
        assert len(found) == 50 * 4
        for r in found:
            fives = sorted([7, *(v for v in (0, 20, 40) if v != r["query_id"])])
            assert (r["vec_id"], r["score"]) == [(7, 12), *((v, 5) for v in fives)][r["rank"] - 1]


def test_blocks_are_dealt_evenly(spark):
    blocks = spark.range(64).select((F.col("id") * 2**33).alias("block"))
    assert len({r[0] for r in blocks.select(vafile.dealt_to(32)).collect()}) > 16


def test_network_gradients():
    rng = np.random.default_rng(1)
    net = langid.ByteNetwork(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    chunks, lengths, labels = rng.integers(0, 256, (4, 7)).astype(np.uint8), np.array([7, 7, 3, 5]), np.array([0, 1, 2, 0])
    _, grads = net.gradients(chunks, lengths, labels)
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        value = net.p[name][at]
        losses = []
        for step in (1e-4, -1e-4):
            net.p[name][at] = value + step
            losses.append(net.gradients(chunks, lengths, labels)[0])
        net.p[name][at] = value
        assert g[at] == pytest.approx((losses[0] - losses[1]) / 2e-4, rel=1e-3)


def test_network_reads_whole_texts():
    net = langid.ByteNetwork(["a", "b"])
    long = b"abc" * 1000
    parts = [long[i : i + langid.CHUNK] for i in range(0, len(long), langid.CHUNK)]
    alone = sum(net.read([p])[0] * len(p) for p in parts) / len(long)
    assert net.read([b"x", long, b""])[1] == pytest.approx(alone, rel=1e-4)


def read_by_byte(net, text):
    """The network one byte after another, without matrices of rows: the mean distribution of a text."""
    h, w = net.hidden, 2 * net.hidden
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    logistic = lambda v: 1 / (1 + np.exp(-v))

    def states(chunk, side):
        out, state = [], np.zeros(h)
        at = [slice(k * w + side * h, k * w + side * h + h) for k in range(3)]
        for byte in chunk:
            into = [p["x"][byte][c] + p["b"][c] for c in at]
            back = [state @ p["u"][side * h : side * h + h, c] for c in at]
            update, reset = logistic(into[0] + back[0]), logistic(into[1] + back[1])
            state = update * state + (1 - update) * np.tanh(into[2] + reset * back[2])
            out.append(state)
        return out

    total = np.zeros(len(net.languages))
    for at in range(0, len(text), langid.CHUNK):
        chunk = text[at : at + langid.CHUNK]
        for fore, aft in zip(states(chunk, 0), reversed(states(chunk[::-1], 1))):
            z = np.exp(fore @ p["o"][:h] + aft @ p["o"][h:] + p["c"])
            total += z / z.sum()
    return total / len(text)


def test_language_id_byte_by_byte(odd):
    """The query's operator against a network that reads one byte at a time."""
    net = langid.fit(odd)
    texts = {(r["doc_id"], r["text"]) for r in odd.collect()}
    want = {}
    for i, text in texts:
        if text and any(map(str.isalpha, text)):
            some = read_by_byte(net, text.encode())
            want[i, text] = net.languages[int(some.argmax())], some.max()
        else:
            want[i, text] = "und", 0.0
    found = langid.identify(odd.select("doc_id", "text"), net).collect()
    assert {(r["doc_id"], r["text"]) for r in found} == set(want)
    for r in found:
        lang, score = want[r["doc_id"], r["text"]]
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-4)
    kept = langid.known_language(odd).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in kept) == sorted(str((r["doc_id"], r["text"])) for r in found if want[r["doc_id"], r["text"]][1] > 0.5)


def test_rare_languages_are_learned(spark):
    text = lambda lang, i: " ".join({"aa": f"foo bar{i} baz", "bb": f"uuu ooo{i} iii"}[lang] for _ in range(3))
    docs = spark.createDataFrame([(i, text("bb" if i % 1000 == 1 else "aa", i), "bb" if i % 1000 == 1 else "aa") for i in range(5000)], "doc_id long, text string, lang string")
    assert langid.fit(docs, sample_docs=200).languages == ["aa", "bb"]


def test_language_id(spark, odd, none, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in found]) >= 0.95
    made = {repr(r["doc_id"]): r for r in langid.language_id(odd).collect()}
    for i in (43, 44, 45, 46, 48):
        assert (made[str(i)]["lang_pred"], made[str(i)]["score"]) == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in made.values())
    assert langid.language_id(none).count() == 0
    assert {r["lang_pred"] for r in langid.language_id(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.known_language(odd)
    assert kept.columns == odd.columns and not {43, 44, 45, 46, 48} & {r["doc_id"] for r in kept.collect()}


def test_license_scan_finds_what_brute_force_finds(spark, none):
    rng = random.Random(2)
    filler = lambda n: [rng.choice(["alpha", "beta", "license", "version", "the", "gnu"]) for _ in range(n)]
    texts, want = [], []
    for i in range(120):
        words, names = filler(rng.randint(0, 60)), []
        for name in rng.sample(list(license_texts.NOTICES), rng.randint(0, 2)):
            words += [licenses.LICENSES[name].upper() if rng.random() < 0.3 else licenses.LICENSES[name]] + filler(rng.randint(20, 40))
            names.append(name)
        texts.append(" ".join(words))
        want += [(i, n) for n in names]
    texts += [None, "", "one two three"]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, license string, start string").repartition(2)
    found = licenses.scan_licenses(docs).collect()
    assert sorted((r["doc_id"], r["license"]) for r in found) == sorted(want)
    for r in found:
        assert texts[r["doc_id"]][r["start"] : r["end"]].lower() == licenses.LICENSES[r["license"]].lower().rstrip(".")
    assert licenses.scan_licenses(none).count() == 0


def held_by_brute_force(text, template):
    """Whether some window of the template's size holds 80 % of its shingles."""
    words = [m[0] for m in re.finditer(r"[^\W_]+", text.lower())]
    wanted = re.findall(r"[^\W_]+", template.lower())
    wanted = {tuple(wanted[i : i + 5]) for i in range(len(wanted) - 4)}
    places = [(i, tuple(words[i : i + 5])) for i in range(len(words) - 4) if tuple(words[i : i + 5]) in wanted]
    size = licenses.window_size(len(wanted))
    return any(len({s for j, s in places if i <= j < i + size}) >= 0.8 * len(wanted) for i, _ in places)


def test_license_recall():
    """Altered license texts among stray stretches of other ones: all that brute force finds, and nothing else."""
    rng = random.Random(21)
    known, found, held = licenses.Templates(licenses.LICENSES), 0, 0
    for _ in range(120):
        words = []
        for _ in range(rng.randint(1, 4)):
            words += [rng.choice(["alpha", "beta", "the", "software"]) for _ in range(rng.randrange(40))]
            some = rng.choice(list(licenses.LICENSES.values())).split()
            if rng.random() < 0.3:  # a stray stretch
                at = rng.randrange(len(some))
                words += some[at : at + rng.randint(5, 30)]
            changes = rng.choice([0, 0.01, 0.03, 0.05])
            words += ["other" if rng.random() < changes else w for w in some]
        text = " ".join(words)
        got = {m[1] for m in known.scan([text])}
        want = {name for name, template in licenses.LICENSES.items() if held_by_brute_force(text, template)}
        assert got == want
        found, held = found + len(got & want), held + len(want)
    assert held > 100 and found == held


def test_stray_phrases_split_no_license():
    known = licenses.Templates(licenses.LICENSES)
    assert {m[1] for m in known.scan(["licensed under the apache license as is. Licensed under the Apache License, Version 2.0."])} == {"Apache-2.0"}
    long = licenses.LICENSES["MIT-text"]
    assert {m[1] for m in known.scan(["to deal in the software " + "x " * 60 + long])} == {"MIT-text"}


def test_license_bands_guarantee_collisions():
    for n in range(1, 200):
        assert licenses.collision_probability(licenses.lowest_similarity(n), 1, licenses.bands_needed(n)) >= 1 - licenses.MISS
    long = " ".join(f"w{i}" for i in range(300))
    known = licenses.Templates({"long": long})
    changed = [f"w{i}" if i % 60 else "x" for i in range(300)]  # five changed words touch 25 of 296 shingles
    found = known.scan(["pre " * 77 + " ".join(changed) + " post" * 50])
    assert len(found) == 1 and found[0][4] >= 0.8


def test_license_windows_slide():
    known, notice = licenses.Templates(license_texts.NOTICES), licenses.LICENSES["GPL-3.0"]
    stray = "This work is licensed under terms that the two authors once agreed upon."
    assert [(m[1], m[2]) for m in known.scan([f"{stray} {notice}"]) if m[1] == "GPL-3.0"] == [("GPL-3.0", len(stray) + 1)]
    for between in range(30):
        for text in (f"This work is licensed under{' x' * between} {notice}", f"{notice}{' x' * between} License version 3 this work is licensed under the GNU"):
            (found,) = known.scan([text])
            assert found[1] == "GPL-3.0" and text[found[2] : found[3]] == notice.rstrip(".") and found[4] == 1.0
    long = [f"w{i}" for i in range(100)]
    known = licenses.Templates({"long": " ".join(long)})
    altered = [w if i not in (40, 60) else "x" for i, w in enumerate(long)]
    assert [m[2:4] for m in known.scan([" ".join([*altered, *altered, *long])])] == [(0, 385), (386, 771), (772, 1161)]
    rng = random.Random(8)
    for _ in range(300):
        words = [rng.choice(long) for _ in range(rng.randrange(5))]
        for _ in range(rng.randint(1, 4)):
            i = rng.randrange(100)
            words += long[i : i + rng.randint(5, 100)] + ["y"] * rng.randrange(40)
        hits = [(i, tuple(words[i : i + 5])) for i in range(len(words) - 4) if tuple(words[i : i + 5]) in known.shingles["long"]]
        held = any(len({s for j, s in hits if i <= j < i + known.sizes["long"]}) >= 0.8 * 96 for i, _ in hits)
        assert held == bool(known.verify(" ".join(words), {"long": list(range(0, len(words), 32))}))


def test_packing(odd, none, spark):
    path = queries.tokenizer_path()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    rows = odd.where("doc_id is not null and doc_id not in (0, 7, 45)").collect()
    docs = spark.createDataFrame(rows, odd.schema).repartition(3)
    found = defaultdict(list)
    for r in packing.pack_documents(docs, path).collect():
        found[r["doc_id"]].append(r)
    for d in rows:
        ids = np.array([*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k, p in enumerate(sorted(found[d["doc_id"]], key=lambda r: r["piece"])):
            assert (p["piece"], p["start"]) == (k, at) and (k == 0 or p["length"] == 2048)
            at += p["length"]
            assert zlib.crc32(ids[p["start"] : at].tobytes()) == p["ids_crc32"]
        assert at == len(ids)
    whole = packing.pack_documents(odd, path).collect()
    sequences = defaultdict(list)
    for r in whole:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert packing.pack_documents(none, path).count() == 0


def test_words_have_the_ids_of_whole_texts():
    encode = packing.open_tokenizer(queries.tokenizer_path())
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    rng = random.Random(12)
    for _ in range(400):
        text = "".join(rng.choice(["a", "B", " ", "  ", "\n", "\t", "'s", "'", "12", "é", "ß", "—", "$$", "_", "don't", "word", ".", "½", "日", " ", "\x85", "<|endoftext|>"]) for _ in range(rng.randint(0, 30)))
        assert encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_plans_hold_every_piece_and_are_close_to_the_bound():
    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 500, 20000):
        lengths = np.minimum(2048, np.maximum(1, rng.lognormal(5.8, 1.1, n).astype(int)))
        counts = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))}
        plan = packing.pack_lengths(counts)
        placed, used = defaultdict(int), defaultdict(int)
        for length, lo, hi, first, copies, at in plan.rows():
            assert (hi - lo) % copies == 0
            placed[length] += hi - lo
            for s in range(first, first + (hi - lo) // copies):
                used[s] += length * copies
        assert placed == counts and all(v <= 2048 for v in used.values()) and len(used) == plan.next
        if n >= 500:
            assert plan.next <= 1.03 * lengths.sum() / 2048 + 3


def test_wrappers(spark):
    def page(i, extra=""):
        items = "".join(f"<li><a href='/{k}'>menu {k}</a></li>" for k in range(2 + i % 3))
        paragraphs = "".join(f"<p>Body {i} <i>part</i> {k} &amp; more<br>line</p>" for k in range(1 + i % 4))
        return f"""<html><head><title>t</title><style>p{{}}</style></head><body class="has-sidebar"><div id="cookie-notice">Accept</div><header>Site</header><nav><ul>{items}</ul></nav>
        <article><h1>Title&nbsp;{i}</h1>{paragraphs}{extra}<form>x<input></form><section class="comments"><p>nice {i}</p></section></article><aside>side {i}</aside><script>var a='</p>'</script><footer>&copy; {i}</footer></body></html>"""

    rows = [(i, f"http://a.example/{i}", page(i, "<ul><li>one<li>two</ul>" if i % 5 == 0 else "")) for i in range(30)]
    plain = "<html><body><div class='top menu'>Menu</div><div><p>First {0}.</p><p>Second {0}.</p></div><p>Same words</p></body></html>"
    rows += [(100 + i, f"https://b.example/{i}", plain.format(i)) for i in range(5)]
    rows += [(200, None, "loose text"), (201, "http://a.example/x", None), (202, "http://a.example/x", ""), (203, "nonsense", "a < b &lt; c"), (0, *rows[0][1:])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string").repartition(4)
    found = {r["page_id"]: r for r in html_wrappers.extract_main_text(df).collect()}
    for i in range(30):
        want = [f"Title {i}"] + [f"Body {i} part {k} & more line" for k in range(1 + i % 4)] + (["one", "two"] if i % 5 == 0 else [])
        assert found[i]["text"] == "\n\n".join(want) and found[i]["n_chars"] == len(found[i]["text"])
    assert found[102]["text"] == "First 2.\n\nSecond 2."
    assert [found[i]["text"] for i in (200, 201, 202, 203)] == ["loose text", "", "", "a < b < c"]
    assert df.count() == html_wrappers.extract_main_text(df).count() and html_wrappers.extract_main_text(df.limit(0)).count() == 0
    odd = '<div class="with-sidebar"><article class="post header-large"><p class="x>broken</p><p>kept</p><article class="comment">no</article></article></div>'
    assert html_wrappers.main_text(odd, None) == "broken\n\nkept"
    wrapper = {r["host"]: html_wrappers.loads(r["wrapper"]) for r in html_wrappers.infer_wrappers(df).collect()}["a.example"]
    assert len(json.dumps(wrapper)) < 3000 and all(html_wrappers.read_by(wrapper, html_wrappers.tokens(r[2])) is not None for r in rows[:30])


def test_articles_in_furniture():
    article = "<article><h1>Head line</h1><p>Body of it.</p></article>"
    for page in (
        f"<html><head><title>t</title><meta charset=utf-8><body>{article}</body></html>",
        f"<body><div>Site</div><nav><ul><li>Home</ul>{article}",
        f"<body><div>Site</div><header>Site <aside>links {article}<footer>foot</footer></body>",
        f"<body><div>Site</div><div class='layout sidebar-right'>{article}<div class=sidebar>more</div></div></body>",
        f"<body class=nav-open><div class=nav-open><nav>menu</nav>{article.replace('article', 'main')}</div>",
        f"<body><svg/><svg viewBox='0 0 1 1' />{article}<svg><text>no</text></svg>",
        f"<body><button>{article}<button>no</button>",
        f"<body><object data='x'>{article}<template><p>no</p><template>no</template></template>",
        f"<body><button-group></button-group><script src='x'/>{article}<script>no</script>",
        f"<body>{article}<aside class=related><article>Another, and a very long teaser text at that.</article></aside>",
        "<body><article><header><h1>Head line</h1><p>Body of it.</p></article></body>",
        "<body><div class='layout sidebar-right'><nav>menu</nav><h1>Head line</h1><p>Body of it.</p><div class=sidebar>more</div></div>",
    ):
        assert html_wrappers.main_text(page, None) == "Head line\n\nBody of it.", page
    assert html_wrappers.main_text("<body><nav>menu</nav><p>Long text of the page.</p><div class=related><article>no</article></div>", None) == "Long text of the page."
    assert html_wrappers.main_text("<body><nav>menu</nav></body>", None) == ""


def test_copies_are_no_template(spark):
    para = lambda i: f"The story numbered {i} is told here in one paragraph that is long enough, {i * 7919}."
    page = lambda i, day, more="": f"<div><h1>Head {i}</h1><div>Day {day}</div><p>{para(i)}</p>{more}</div><div>All rights are kept by us</div>"
    rows = [(d, "http://copies.example/", page(1, d)) for d in range(3)]
    rows += [(10 + i, "http://large.example/", page(i, i)) for i in range(40)]
    rows += [(60 + d, "http://large.example/", page(99, d, "<h2>Only here</h2>")) for d in range(50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    found = {r["page_id"]: r["text"] for r in html_wrappers.extract_main_text(df).collect()}
    for d in range(3):
        assert found[d] == f"Head 1\n\nDay {d}\n\n{para(1)}\n\nAll rights are kept by us"
    for i in range(40):
        assert found[10 + i] == f"Head {i}\n\nDay {i}\n\n{para(i)}"
    for d in range(50):
        assert found[60 + d] == f"Head 99\n\nDay {d}\n\n{para(99)}\n\nOnly here"


def plain_site(i):
    """A page without ``article`` or ``main``, without a class or tag of furniture; and its article."""
    body = [f"Paragraph {k} of page {i} says what only page {i} says, in {i * 31 + k} words or so." for k in range(1 + i % 5)]
    links = "".join(f"<p><a href='/{k}'>Story {(i * 7 + k) % 50} that readers liked</a></p>" for k in range(2 + i % 3))
    more = "<table><tr><td>cell</td></tr></table>" if i % 4 == 0 else ""
    page = f"""<body><div><p>The Daily Page</p><p>Printed since 1900 in this very town, and read by everybody.</p></div><div><h1>Headline {i}</h1>{"".join(f"<p>{b}</p>" for b in body)}{more}</div>
    <div>{links}</div><div><p>All rights are reserved by the printers of this page, who may be written to.</p></div></body>"""
    return page, [f"Headline {i}", *body, *(["cell"] if more else [])]


def test_wrappers_decide_without_marks(spark):
    """Pages without a mark: wrappers find the article, a page alone can't, and no partitioning changes a text."""
    made = {i: plain_site(i) for i in range(60)}
    rows = [(i, f"http://plain.example/{i}", made[i][0]) for i in made] + [(100 + i, f"http://plain.example/{i}", made[i][0]) for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = [{r["page_id"]: r["text"] for r in html_wrappers.extract_main_text(df.repartition(n)).collect()} for n in (1, 4, 13)]
    assert texts[0] == texts[1] == texts[2]
    assert all(texts[0][i] == texts[0][i % 100] == "\n\n".join(made[i % 100][1]) for i in texts[0])
    assert all(html_wrappers.main_text(page, None) != "\n\n".join(want) for page, want in made.values())
    levels = [{r["host"]: r["wrapper"] for r in html_wrappers.infer_wrappers(df.repartition(n), at_once=2).collect()} for n in (1, 7)]
    assert levels[0] == levels[1]


def test_slots_are_judged_by_all_pages_of_a_host(spark):
    """What the 16 pages of least hash say of a slot is not what all 80 say; copies count once."""
    page = lambda i, note: f"<body><div><h1>Head {i}</h1><p>The story numbered {i} is told here in one paragraph that is long enough, {i * 7919}.</p><div>{note}</div></div></body>"
    order = sorted(range(80), key=lambda i: html_wrappers.page_number(html_wrappers.tokens(page(i, ""))))
    first = set(order[:16])
    made = {}
    for i in range(80):
        made[i] = "mostly.example", i, f"Only here {i}" if i in first else "All rights are kept"
        made[100 + i] = "rarely.example", i, "All rights are kept" if i in first else f"Only here {i}"
    for k in range(200):
        made[1000 + k] = "rarely.example", order[0], "All rights are kept"
    df = spark.createDataFrame([(k, f"http://{host}/", page(i, note)) for k, (host, i, note) in made.items()], "page_id long, url string, html string")
    texts = [{r["page_id"]: r["text"].split("\n\n") for r in html_wrappers.extract_main_text(df.repartition(n), broadcast_bytes=b).collect()} for n, b in ((1, 0), (7, 1 << 20))]
    assert texts[0] == texts[1]
    for k, (host, i, note) in made.items():
        assert (note in texts[0][k]) == (host == "rarely.example") and texts[0][k][0] == f"Head {i}", k
    pages = spark.createDataFrame([("h", page(i, "same" if i % 4 else f"own {i}" if i else "")) for i in [*range(40), 1, 1]], "host string, html string")
    wrapper = html_wrappers.merge_shapes([html_wrappers.page_expression(html_wrappers.tokens(page(i, note)), False) for i, note in ((1, "x"), (2, ""))])
    wrappers = spark.createDataFrame([("h", json.dumps(html_wrappers.numbered(wrapper)))], "host string, wrapper string")
    assert sorted(map(tuple, html_wrappers.count_texts(pages, wrappers).collect())) == [("h", 0, 40, 40), ("h", 1, 1, 40), ("h", 2, 1, 40), ("h", 3, 30, 39)]


def test_wrappers_drop_template_text_in_articles():
    page = lambda i: f"<body><article><h1>Daily news</h1><p>Story {i} is told here in a paragraph.</p><div>Subscribe to read it to the end</div></article></body>"
    wrapper = html_wrappers.decide(html_wrappers.merge_shapes([html_wrappers.page_expression(html_wrappers.tokens(page(i))) for i in range(40)]))
    assert html_wrappers.main_text(page(39), wrapper) == "Daily news\n\nStory 39 is told here in a paragraph."
    assert html_wrappers.main_text(page(1), None) == "Daily news\n\nStory 1 is told here in a paragraph.\n\nSubscribe to read it to the end"


@pytest.mark.parametrize("pages", [4, 8, 16, 40])
def test_wrappers_keep_labels_that_repeat_in_articles(spark, pages):
    """One text on every page is the article's own in its middle; the boilerplate after it, and in links, is not."""
    recipe = lambda i: f"<body><nav>menu</nav><article><h1>Dish {i}</h1><blockquote>It is eaten {i} times a year in the village.</blockquote><p><b>Ingredients</b></p><ul><li>{i} eggs</li><li>salt</li></ul><div><a href=/all>All of our recipes by name</a></div><p><b>Method</b></p><ol><li>Stir it {i} times.</ol><div>Subscribe to read more</div></article></body>"
    city = lambda i: f"<body><article><h1>City {i}</h1><table><tr><th>Country</th><td>Land {i}</td></tr><tr><th>Population</th><td>{i * 977}</td></tr></table><p>A city of its own kind, number {i}.</p></article></body>"
    rows = [(i, f"http://food.example/{i}", recipe(i)) for i in range(pages)] + [(100 + i, f"http://city.example/{i}", city(i)) for i in range(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    found = {r["page_id"]: r["text"].split("\n\n") for r in html_wrappers.extract_main_text(df).collect()}
    for i in range(pages):
        dish = [t for t in found[i] if t not in ("All of our recipes by name", "Subscribe to read more")]
        assert dish == [f"Dish {i}", f"It is eaten {i} times a year in the village.", "Ingredients", f"{i} eggs", "salt", "Method", f"Stir it {i} times."]
        assert found[100 + i] == [f"City {i}", "Country", f"Land {i}", "Population", str(i * 977), f"A city of its own kind, number {i}."]
    if pages >= 16:
        assert "All of our recipes by name" not in found[1] and "Subscribe to read more" not in found[1]


def test_wrappers_match_every_page_they_were_made_of_as_a_naive_matcher_says():
    """The wrapper as a regular expression over tags and texts, matched with full backtracking, agrees with ``read_by``."""
    rng = random.Random(11)

    def pattern(nodes):
        return "".join(re.escape(f"<{n[1]}>") if n[0] == "t" else "#" if n[0] == "s" else f"(?:{pattern(n[1])}){n[0]}" for n in nodes)

    for _ in range(40):
        made = [f"<div>head</div><article><h1>t{i}</h1>" + "".join(rng.choice((f"<p>a{i}</p>", "<ul><li>x<li>y</ul>", f"<div>d{i}</div>")) for _ in range(rng.randint(1, 6))) + "</article>" for i in range(6)]
        streams = [html_wrappers.tokens(page) for page in made]
        wrapper = html_wrappers.decide(html_wrappers.merge_shapes([html_wrappers.page_expression(s) for s in streams[:5]]))
        for k, stream in enumerate(streams):
            naive = re.fullmatch(pattern(wrapper), "".join("#" if x[0] == "s" else f"<{x[1]}>" for x in stream))
            flags = html_wrappers.read_by(wrapper, stream)
            assert k == 5 or naive
            assert flags is None or (naive and len(flags) == sum(x[0] == "s" for x in stream))


def test_marks_on_the_region_are_layout():
    page = lambda i: f"<body><div class='sidebar-layout'><div class=notice-board><h1>Head {i}</h1><p>Told here in a paragraph of its own: {i * 17}, and then some more of it.</p><div class=comments><p>nice {i}</p></div></div></div><p>imprint</p></body>"
    wrapper = html_wrappers.decide(html_wrappers.merge_shapes([html_wrappers.page_expression(html_wrappers.tokens(page(i))) for i in range(9)]))
    assert html_wrappers.main_text(page(4), wrapper) == "Head 4\n\nTold here in a paragraph of its own: 68, and then some more of it."


def test_article_text_is_kept():
    same = "<body><article><h1>Title</h1>" + "<p>Again.</p>" * 3 + "</article></body>"
    assert html_wrappers.main_text(same, html_wrappers.decide(html_wrappers.page_expression(html_wrappers.tokens(same)))) == "Title\n\nAgain.\n\nAgain.\n\nAgain."
    for page, want in (
        ("<article><svg-icon></svg-icon><p>one</p><svg/><p>two</p></article>", "one\n\ntwo"),
        ("<article><p>one</p><button>x<p>two</p><p>three</p></article>", "one\n\nx\n\ntwo\n\nthree"),
        ("<article><p>As <math><msup><mi>x</mi><mn>2</mn></msup><annotation>x^2</annotation></math> grows</p></article>", "As x2 grows"),
        ("<article><p>one</p><section class='related-work'><p>two</p></section><div class=search-results-table>three</div><div class='comment-list'>no</div></article>", "one\n\ntwo\n\nthree"),
    ):
        assert html_wrappers.main_text(page, None) == want, page


def test_long_pages():
    words = [f"Paragraph {i} of a very long page." for i in range(20000)]
    page = "<body><nav>menu</nav><article>" + "".join(f"<p>{w}</p>" for w in words) + "</article></body>"
    assert len(page) > 800_000 and html_wrappers.main_text(page, None) == "\n\n".join(words)
    open_ = "<body><article>" + "<button>b<svg>" * 40000 + "<p>end</p></article></body>"
    assert html_wrappers.main_text(open_, None).endswith("end")


def test_revisits(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        url = rng.choice(["http://www.x.org/a/", "https://x.org/a#top", "http://X.org:80/a/index.html?utm_source=q", "http://y.org/b?b=2&a=1", "https://y.org/b?a=1&b=2", None])
        kind = "response" if rng.random() < 0.4 else "revisit"
        etag, modified = rng.choice(["e1", "e2", None]), rng.choice(["m1", None])
        etag = etag and rng.choice(["", "W/"]) + etag
        rows.append((i, url, rng.choice([rng.randrange(400), None] if rng.random() < 0.1 else [rng.randrange(400)]), kind, etag, modified, {"ETag": str(etag), "Content-Type": f"t{i}", "Age": str(i)} if i % 7 else None, f"body {i}" if kind == "response" else None))
    schema = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, payload string"
    df = spark.createDataFrame(rows, schema).withColumn("slot", F.lit("x")).repartition(4)
    group = lambda u: None if u is None else "x.org/a" if "/a" in u else "y.org/b?a=1&b=2"
    want = {}
    for r in rows:
        if r[3] == "revisit":
            full = max(((q[2], q[0], q) for q in rows if q[3] == "response" and group(q[1]) is not None and group(q[1]) == group(r[1]) and None not in (q[2], r[2]) and q[2] < r[2]), default=None, key=lambda x: x[:2])
            same = full and ((full[2][4] or "").removeprefix("W/") == r[4].removeprefix("W/") if r[4] is not None else full[2][5] == r[5] if r[5] is not None else True)
            want[r[0]] = (full and full[1], "missing" if not full else "resolved" if same else "changed", full[2][7] if full and same else None)
    for slots in (1, 16, 1024):
        found = {r["record_id"]: r for r in revisits.resolve_revisits(df, slots).collect()}
        assert {k: (r["response_id"], r["status"], r["payload"]) for k, r in found.items()} == want
    twice = revisits.resolve_revisits(df.unionByName(df)).collect()
    assert len(twice) == 2 * len(found) and {r["record_id"]: (r["response_id"], r["status"], r["payload"]) for r in twice} == want
    for k, r in found.items():
        if r["status"] == "resolved":
            stored, fresh = rows[r["response_id"]][6] or {}, rows[k][6] or {}
            assert r["headers"].get("content-type") == stored.get("Content-Type") and r["headers"].get("age") == fresh.get("Age", stored.get("Age"))
        else:
            assert r["headers"] is None
    assert revisits.resolve_revisits(df.limit(0)).count() == 0


def test_wanted_bodies_are_told_by_bits(spark):
    bodies = spark.range(5000).select(F.concat(F.lit("r"), "id").alias("_b"), F.lit("body").alias("payload"))
    wanted = bodies.where("_b like '%7'").select("_b").unionByName(spark.createDataFrame([("none",), (None,)], "_b string"))
    ids = {r[0] for r in wanted.collect()} - {"none", None}
    for bits, most in ((1 << 28, len(ids) + 3), (1 << 12, 2000), (8, 5000)):
        found = [r["_b"] for r in revisits.likely_wanted(bodies, wanted, bits).collect()]
        assert ids <= set(found) and len(found) == len(set(found)) <= most
    assert revisits.likely_wanted(bodies, wanted.limit(0), 1).count() == 0


def test_attention_gradients():
    rng = np.random.default_rng(3)
    model = quality.AttentionModel()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, counts, y = rng.random((7, quality.FEATURES)), np.array([4, 2, 1]), np.array([1.0, 0, 1])
    _, grads = model.gradients(x, counts, y)
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        value = model.p[name][at]
        losses = []
        for step in (1e-5, -1e-5):
            model.p[name][at] = value + step
            losses.append(model.gradients(x, counts, y)[0])
        model.p[name][at] = value
        assert g[at] == pytest.approx((losses[0] - losses[1]) / 2e-5, rel=1e-3)


def scored_by_passage(model, text):
    """The score one passage after another, features counted byte by byte."""
    p, kind = {k: v.astype(np.float64) for k, v in model.p.items()}, quality.KIND
    codes, logits = [], []
    for at in range(0, max(1, len(text)), quality.PASSAGE):
        part = text[at : at + quality.PASSAGE]
        n, x = max(1, len(part)), np.zeros(quality.FEATURES)
        padded = part + bytes(quality.PASSAGE - len(part))
        for byte in part:
            x[byte] += 1
        for a, b in zip(padded, padded[1:]):
            x[256 + kind[a] * quality.KINDS + kind[b]] += 1
        x[: 256 + quality.KINDS**2] = np.sqrt(x[: 256 + quality.KINDS**2] / n)
        x[256] = 0
        for k, lag in enumerate(quality.LAGS):
            x[256 + quality.KINDS**2 + k] = sum(a == b for a, b in zip(part, part[lag:])) / n
        x[-1] = n / quality.PASSAGE
        h = np.tanh(x @ p["w"] + p["b"])
        codes.append(h)
        logits.append(float((np.tanh(h @ p["v"]) / (1 + np.exp(-(h @ p["u"])))) @ p["a"][:, 0]))
    weights = np.exp(np.array(logits) - max(logits))
    z = (weights[:, None] * np.array(codes)).sum(axis=0) / weights.sum()
    return 1 / (1 + np.exp(-(z @ p["c"][:, 0] + p["d"][0])))


def test_quality_passage_by_passage(odd, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    want = {(r["doc_id"], scored_by_passage(model, (r["text"] or "").encode()).round(3)) for r in odd.collect()}
    found = quality.quality(odd, labels).collect()
    assert len(found) == odd.count()
    for r in found:
        assert any(i == r["doc_id"] and abs(s - r["score"]) < 2e-3 for i, s in want)


def test_quality_trains_on_whole_texts(spark, monkeypatch):
    """What tells good from bad stands at the end of long texts; the bound on characters leaves out documents, no parts."""
    filler = "the same words again and again " * 400
    docs = spark.createDataFrame([(i, filler + ("GOOD9 " if i % 2 else "bad# ") * 100) for i in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality.AttentionModel, "train", lambda self, texts, y: seen.append(texts))
    quality.fit(docs, labels)
    monkeypatch.setattr(quality, "SAMPLE_CHARS", 200_000)
    quality.fit(docs, labels)
    whole = {r["text"].encode() for r in docs.collect()}
    assert set(seen[0]) <= whole and set(seen[1]) <= whole and 10 <= len(seen[1]) <= 16 < len(seen[0])


def test_quality_skips_texts_beyond_the_bound_and_does_not_go_untrained(spark, monkeypatch):
    rows = [(i, ("GOOD9 " if i % 2 else "bad# ") * 100) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality.AttentionModel, "train", lambda self, texts, y: seen.append(texts))
    drawn = lambda texts: quality.fit(spark.createDataFrame(texts, "doc_id long, text string").repartition(5), labels)
    drawn(rows)
    first = seen[0][0]
    # The one of least hash is far too long: all others are still trained on.
    monkeypatch.setattr(quality, "SAMPLE_CHARS", 100_000)
    inside = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    least = spark.createDataFrame([(i,) for i in inside], "i long").orderBy(F.xxhash64(F.col("i").cast("string"))).first()[0]
    drawn([(i, "x" * 200_000 if i == least else t) for i, t in rows])
    assert first and len(seen[1]) == len(inside) - 1 and max(map(len, seen[1])) < 1000
    # Every row 20 times, and another text for one id: the same sample again and again.
    monkeypatch.setattr(quality, "SAMPLE_CHARS", 64_000_000)
    for _ in range(2):
        drawn([*rows, (inside[0], "another text")] * 20)
    assert len(seen[2]) == len(inside) and seen[2] == seen[3]
    monkeypatch.setattr(quality, "SAMPLE_CHARS", 100)
    with pytest.raises(ValueError, match="longer"):
        drawn(rows)


def test_quality(spark, odd, none, sf_dir):
    wide = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{wide}/documents.parquet"), spark.read.parquet(f"{wide}/labels.parquet")
    rows = quality.quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    assert np.mean([[a > b for b in bad] for a in good]) >= 0.9 and np.mean([s >= 0.7 for s in good]) >= 0.95
    few = spark.createDataFrame([(1, 1), (2, 0), (3, None), (999, 1), (1, 0), (None, 1)], "doc_id long, quality int")
    found = quality.quality(odd, few).collect()
    assert len(found) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found)
    assert quality.quality(none, few).count() == 0 and quality.quality(odd, few.limit(0)).count() == odd.count()


def test_pipeline_stages(spark, odd, none):
    """Each stage against brute force over what the one before it kept."""
    import corpus_pipeline

    before, after = {}, {}
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before[name] = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), odd.schema)
        after[name] = docs.collect()
        assert docs.columns == odd.columns, name
        empty = stage(spark, none, "")
        assert empty.columns == odd.columns and empty.count() == 0, name
    texts = lambda rows: sorted(str(r["text"]) for r in rows)
    net = langid.fit(odd)
    sure = lambda t: t and any(map(str.isalpha, t)) and read_by_byte(net, t.encode()).max() > 0.5
    assert texts(after["language_id"]) == texts([r for r in before["language_id"] if sure(r["text"])])
    assert len(after["language_id"]) < len(before["language_id"])
    kept = [bare(r["text"]) for r in after["exact_dedup"]]
    assert sorted(kept) == sorted({bare(r["text"]) for r in before["exact_dedup"]})
    marks = {brute_fingerprint(r["text"]) for r in before["simhash_near_dedup"]}
    group = {m: m for m in marks}
    for _ in marks:
        group = {a: min(group[b] for b in marks if bin(a ^ b).count("1") <= 3) for a in marks}
    assert len(after["simhash_near_dedup"]) == len(set(group.values()))
    assert sorted(group[brute_fingerprint(r["text"])] for r in after["simhash_near_dedup"]) == sorted(set(group.values()))
    # Copies by sorting all documents of a source by hash, which the operator never does.
    hashes = {r["doc_id"]: r["h"] for r in spark.createDataFrame(before["mix_sources"], odd.schema).select("doc_id", mixing.id_hash("doc_id", 0).alias("h")).collect()}
    words = lambda r: len(WORD.findall(r["text"] or ""))
    names = sorted({r["source"] for r in before["mix_sources"]}, key=lambda s: (s is None, s or ""))
    sizes = [sum(words(r) for r in before["mix_sources"] if r["source"] == n) for n in names]
    want = []
    for name, size, target in zip(names, sizes, water_filled(sizes)):
        whole = min(int(target / size + 1e-9), 2) if size else 0
        rows = sorted((r for r in before["mix_sources"] if r["source"] == name), key=lambda r: hashes[r["doc_id"]])
        sums = [sum(map(words, rows[:k])) for k in range(len(rows) + 1)]
        best = min(range(len(sums)), key=lambda k: abs(sums[k] - (target - whole * size)))
        want += [r for k, r in enumerate(rows) for _ in range(min(2, whole + (sums[k + 1] <= sums[best])))]
    assert texts(after["mix_sources"]) == texts(want)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    encode = packing.open_tokenizer(queries.tokenizer_path())
    assert sum(r["length"] for r in packed) == sum(len(encode(r["text"] or "")) // 4 + 1 for r in after["mix_sources"])
    assert corpus_pipeline.STAGES[-1][1](spark, none, "").count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sf_dir, duck, name):
    got = duck.execute(queries.ORACLES[name])
    names = [c[0] for c in got.description]
    df = queries.QUERIES[name](spark, sf_dir)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, got.fetchall())) == sorted(repr(tuple(r)) for r in df.select(*names).collect())
