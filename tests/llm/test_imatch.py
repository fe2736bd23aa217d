"""Fingerprints by randomised lexicons against a plain version."""

import hashlib
import re

from pyspark.sql import functions as F

from phylospark.llm import imatch, queries
from tests.test_queries import compare

md5, sha = (lambda x: hashlib.md5(x.encode()).hexdigest()), (lambda x: hashlib.sha256(x.encode()).hexdigest())


def words(text):
    return list(dict.fromkeys(re.findall(r"[^\W_]+", text.lower())))


def brute(rows):
    texts = sorted(((d is not None, d or 0, md5(t or ""), d, t or "") for d, t in rows))
    texts = [(d, t) for *_, d, t in texts]
    count = {}
    for _, t in texts:
        for w in words(t):
            count[w] = count.get(w, 0) + 1
    band = {w for w, n in count.items() if imatch.LEAST * len(texts) <= n * imatch.OF <= imatch.MOST * len(texts)}

    def fingerprint(t):
        used = sorted(set(words(t)) & band)
        parts = [" ".join(w for w in used if sha(w)[at - 1 : at + 3] < limit) for at, limit in imatch.LIMITS]
        if not used:
            parts = [" " + md5(" ".join(sorted(words(t))) if words(t) else " " + t)] * len(parts)
        return [md5(p)[: imatch.DIGITS] if p else imatch.NONE for p in parts]

    def likeness(a, b):
        some = [(x, y) for x, y in zip(a, b) if (x, y) != (imatch.NONE, imatch.NONE)]
        return sum(x == y for x, y in some) / len(some)

    made = []
    for i, (d, t) in enumerate(texts):
        after = texts[(i + 1) % len(texts)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = map(fingerprint, (t, edited, after))
        made.append((d, len(t), sha(edited), "".join(a), "".join(b), likeness(a, b), likeness(a, c)))
    return sorted(map(repr, made))


def found(spark, rows, parts=3):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, term string, key int").repartition(parts)
    return sorted(repr(tuple(r)) for r in imatch.fingerprints_and_edits(docs).collect())


def test_imatch_matches_brute_force(spark, sf_dir):
    """Real texts with null and blank ones, texts without a word, repeated rows, an id with two texts, a null id and a long text."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where(F.length("text") < 3000).limit(60).collect()]
    odd = [(1000, None), (1001, ""), (1002, "???"), (1003, " "), (1004, "Same Text here"), (1004, "Same Text here"), (1004, "Same Text here"), (1004, "other"), (None, "No id, 3 words"), (1005, "long tail " * 5000), (1006, "Straße ÉTÉ ñ"), (1007, rows[0][1])]
    assert found(spark, rows + odd) == brute(rows + odd)


def test_imatch_small_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(7, "only one of its kind")]) == brute([(7, "only one of its kind")])
    assert found(spark, [(7, "twice")] * 2) == brute([(7, "twice")] * 2)


def test_repeated_rows_in_batches(spark):
    rows = [(1, "again and again")] * 9000 + [(2, "another one")]
    assert found(spark, rows) == brute(rows)


def test_near_copies_are_nearer_than_others(spark, sf_dir):
    """A word changed in forty leaves most hashes as they were; equal texts have equal fingerprints."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 400").select("doc_id", "text").limit(80)
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    rows = [(2 * i + k, t if not k else re.sub(r"^(\S+ ){1}", "qqqq ", t)) for i, t in enumerate(texts) for k in (0, 1)]
    made = {r["doc_id"]: r for r in imatch.fingerprints_and_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = [made[2 * i]["near_next"] for i in range(len(texts))]
    far = [made[2 * i + 1]["near_next"] for i in range(len(texts) - 1)]
    assert sum(near) / len(near) > 0.7 > 0.1 > sum(far) / len(far)


def test_no_python_on_the_path(spark, sf_dir):
    plan = imatch.fingerprints_and_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_imatch_matches_sql(spark, sf_dir, duck):
    compare(queries.QUERIES["op13_document_fingerprints"](spark, sf_dir), duck, queries.ORACLES["op13_document_fingerprints"])
