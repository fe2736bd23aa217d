"""A Merkle manifest of a dataset: one tree for each source, one tree over the sources' roots, and a proof for every row.

Only every ``STRIDE``-th level of a tree is stored (the checkpoints). A proof
needs the siblings on all levels, so extraction goes top down over the stored
levels: each aligned subtree between two of them is regenerated from its stored
descendants, the siblings are handed to these, and the interior nodes are
forgotten. A subtree has at most ``FANOUT ** STRIDE`` descendants, so a source
that holds most rows is many small groups.

Texts are read once and never shuffled: a row becomes its leaf digest in the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phylospark.llm.ranking import group_key, ranked, small
from phylospark.shared import cut

FANOUT, STRIDE = 16, 2
NOTHING = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf and a path of siblings lead to."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def _blocks(nodes: DataFrame) -> DataFrame:
    """Aligned subtrees: ``tree, pos, n`` and ``kids``, the stored descendants in order; written, as both passes read it."""
    kids = F.array_sort(F.collect_list(F.struct(F.col("pos").alias("at"), "hash", "load"))).alias("kids")
    return cut(nodes.groupBy("tree", F.expr(f"pos div {FANOUT**STRIDE}").alias("block")).agg(F.first("n").alias("n"), kids).withColumnRenamed("block", "pos"))


def _levels(blocks: DataFrame) -> DataFrame:
    """Columns ``l0 .. l<STRIDE>``: the subtree's nodes level by level; a level that the tree doesn't have is like the one below."""
    made = blocks.withColumn("l0", F.transform("kids", lambda x: x["hash"]))
    for j in range(STRIDE):
        up = F.expr(f"transform(sequence(0, cast((size(l{j}) - 1) div {FANOUT} as int)), r -> sha2(array_join(slice(l{j}, r * {FANOUT} + 1, {FANOUT}), ''), 256))")
        made = made.withColumn(f"l{j + 1}", F.when(F.col("n") > FANOUT**j, up).otherwise(F.col(f"l{j}")))
    return made


def _parents(blocks: DataFrame) -> DataFrame:
    """The next stored level: a node for each subtree."""
    size = F.expr(f"(n + {FANOUT**STRIDE - 1}) div {FANOUT**STRIDE}")
    return _levels(blocks).select("tree", "pos", F.col(f"l{STRIDE}")[0].alias("hash"), size.alias("n"))


def checkpoints(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Stored levels of all trees, from the leaves (``tree, pos, n, hash, load``) up, as subtrees; and ``tree, hash``, the roots."""
    stored, most = [], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        stored.append(_blocks(nodes))
        nodes = _parents(stored[-1]).withColumn("load", F.lit(None).cast("string"))
        most = -(-most // FANOUT**STRIDE)
    if not stored:  # trees of one leaf: the leaf is the root
        stored.append(_blocks(nodes))
    return stored, cut(nodes.select("tree", "hash"))


def _siblings(level: Column, i: Column) -> Column:
    first = i - i % FANOUT
    return F.struct(F.array_join(F.slice(level, first + 1, i % FANOUT), "").alias("left"), F.array_join(F.slice(level, i + 2, FANOUT - 1 - i % FANOUT), "").alias("right"))


def extract(stored: list[DataFrame], above: DataFrame) -> DataFrame:
    """``load`` of every leaf with its ``hash``, its ``path`` and the columns of ``above``.

    ``above`` has one row for each tree with the path that goes on at its root.
    """
    carried = [c for c in above.columns if c not in ("tree", "path")]
    paths = above.withColumn("pos", F.lit(0).cast("long"))
    for k, blocks in enumerate(reversed(stored)):
        joined = _levels(blocks).join(paths.select("tree", "pos", *carried, F.col("path").alias("_up")), ["tree", "pos"])

        def own(x: Column, i: Column) -> Column:
            place, path = i, F.array().cast(NOTHING)
            for j in range(STRIDE):
                path = F.concat(path, F.when(F.col("n") > FANOUT**j, F.array(_siblings(F.col(f"l{j}"), place))).otherwise(F.array().cast(NOTHING)))
                place = F.floor(place / FANOUT).cast("int")
            return F.struct(x["at"].alias("at"), x["hash"].alias("hash"), x["load"].alias("load"), path.alias("path"))

        made = joined.select("tree", *carried, "_up", F.explode(F.transform("kids", own)).alias("x"))
        paths = made.select("tree", F.col("x.at").alias("pos"), F.col("x.hash").alias("hash"), F.col("x.load").alias("load"), *carried, F.concat("x.path", "_up").alias("path"))
        if k + 1 < len(stored):
            paths = small(cut(paths.drop("hash", "load")))
    return paths


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), carry: Column | None = None) -> DataFrame:
    """Leaf, subroot, root and proof of every row: ``doc_id, source, leaf, subroot, root, path, carried``.

    ``path`` holds, level by level from the leaf to the root, the siblings left
    and right of the node as joined hexadecimal digests, as ``fold`` takes them.
    ``carry`` is a column of ``docs`` that goes along as a string.

    A null value is a field of its own kind, so null and empty texts differ; a
    null group is a group, the first; very long texts are hashed in the scan and
    move nowhere. Rows whose id repeats are ordered by their digests, and rows
    that repeat in full each have a leaf. Other columns, clashing names
    included, play no part. An empty table gives no rows.
    """
    c = lambda name: F.col(f"`{name}`")
    leaves = cut(docs.select(c(id_col).alias("doc_id"), c(group_col).cast("string").alias("source"), group_key(c(group_col)).alias("tree"), leaf_digest(*map(c, columns)).alias("hash"), (F.lit(None) if carry is None else carry).cast("string").alias("carried")))
    nodes = ranked(leaves, "tree", ["doc_id", "hash"])
    nodes = nodes.select("tree", "pos", "n", "hash", F.struct("doc_id", "source", "carried").alias("load"))
    stored, subroots = checkpoints(nodes)
    tops = ranked(subroots.select(F.lit("").alias("all"), "tree", "hash"), "all", ["tree"])
    upper, root = checkpoints(tops.select(F.col("all").alias("tree"), "pos", "n", "hash", F.col("tree").alias("load")))
    above = root.select("tree", F.col("hash").alias("root"), F.array().cast(NOTHING).alias("path"))
    above = cut(extract(upper, above).select(F.col("load").alias("tree"), F.col("hash").alias("subroot"), "root", "path"))
    made = extract(stored, small(above))
    return made.select("load.doc_id", "load.source", F.col("hash").alias("leaf"), "subroot", "root", "path", "load.carried")


def tampered(docs: DataFrame) -> Column:
    """The leaf digest of a row of which, where 5 divides the id's CRC-32, the text's A-Z are lower-cased."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return F.when(hit, leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), lower))


def audit(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every document, some of them tampered with."""
    made = manifest(docs, carry=tampered(docs))
    folded = made.withColumns({"folded_root": fold(F.col("path"), F.coalesce("carried", "leaf")), "proof_sha256": proof_digest(F.col("path"))})
    return folded.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
