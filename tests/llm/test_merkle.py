"""The Merkle manifest against trees made in Python, and its proofs one by one."""

import hashlib
import zlib

import pytest

from phylospark.llm import merkle, queries
from tests.test_queries import compare

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i - i % 16 : i - i % 16 + 16]
        out.append((run[: i % 16], run[i % 16 + 1 :]))
        i //= 16
    return out


def brute(rows):
    groups, made = {}, []
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: tree([x[2] for x in sorted(groups[k])]) for k in order}
    top = tree([trees[k][-1][0] for k in order])
    for n, k in enumerate(order):
        for i, (_, _, h, r) in enumerate(sorted(groups[k])):
            steps, now = path(trees[k], i) + path(top, n), h
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                now = leaf((*r[:4], None if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for left, right in steps:
                now = digest("".join(left) + now + "".join(right))
            made.append((r[0], h, trees[k][-1][0], top[-1][0], digest("".join("".join(a + b) for a, b in steps)), now, now == top[-1][0]))
    return sorted(map(repr, made))


@pytest.mark.parametrize("sizes", [(0,), (1,), (1, 1), (16, 17), (257, 1, 3), (273, 0, 5)])
def test_merkle_matches_brute_force(spark, sizes):
    """Lone leaves, last runs of one, a null source, null fields, repeated rows and ids, a text of 200,000 letters."""
    names = [None, "b", "é"]
    rows = [(i, names[g], None if i % 7 == 0 else "en", None if i % 5 == 0 else i, None if i % 11 == 0 else "" if i % 13 == 0 else f"Text {i} É") for g, n in enumerate(sizes) for i in range(n)]
    if len(rows) > 20:
        rows += [rows[3], rows[3], (None, "b", "en", 1, "No id"), (4, "b", "en", 1, "Id again"), (5, None, "en", 1, "Long" * 50_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", leaf string").repartition(3)
    assert sorted(repr(tuple(r)) for r in merkle.audit(docs).collect()) == brute(rows)


def test_paths_fold_to_the_root_and_changes_do_not(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = merkle.manifest(docs).collect()
    assert len({r["root"] for r in made}) == 1
    for r in made:
        now, wrong = r["leaf"], digest(r["leaf"])
        for step in r["path"]:
            now, wrong = digest(step["left"] + now + step["right"]), digest(step["left"] + wrong + step["right"])
        assert now == r["root"] != wrong
    again = merkle.manifest(docs.repartition(5)).select("root").first()[0]
    assert again == made[0]["root"]


def test_merkle_matches_sql(spark, sf_dir, duck):
    compare(queries.QUERIES["op11_merkle_manifest"](spark, sf_dir), duck, queries.ORACLES["op11_merkle_manifest"])
