"""Ortholog groups and families: which genes belong together and how many proteomes they span."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospark.functions.numbers import pick_max, pick_min
from phylospark.operators.components import connected_components
from phylospark.shared import cut


def orthogroup_containing(groups: DataFrame, member: str) -> DataFrame:
    """Members of the group that holds ``member``, an id or the beginning of one.

    An exact id counts before longer ones that begin with it. An id that no
    group holds and a beginning of several ids are errors.
    """
    found = [r["member"] for r in groups.where(F.col("member").startswith(member)).select("member").distinct().orderBy(F.col("member") != member, "member").limit(2).collect()]
    if not found:
        raise ValueError(f"no group holds {member}")
    if found[0] != member and len(found) > 1:
        raise ValueError(f"{member} is the beginning of several ids: {found[0]}, {found[1]}")
    return orthogroups_containing(groups, groups.sparkSession.createDataFrame([(found[0],)], "value string"))


def orthogroups_containing(groups: DataFrame, ids: DataFrame) -> DataFrame:
    """Groups that hold at least one of ``ids`` (column ``value``)."""
    found = groups.join(ids.select(F.col("value").alias("member")).distinct(), "member", "left_semi").select("group_id").distinct()
    return groups.join(found, "group_id", "left_semi").select("group_id", "member")


def group_spans(groups: DataFrame, proteomes: DataFrame) -> DataFrame:
    """``group_id, span``: in how many proteomes (``list_id, value``) a group has a member; 0 is kept."""
    ids = proteomes.select("list_id", F.col("value").alias("member")).distinct()
    sums = groups.select("group_id", "member").distinct().join(ids, "member").select("group_id", "list_id").distinct().groupBy("group_id").agg(F.count(F.lit(1)).alias("span"))
    return groups.select("group_id").distinct().join(sums, "group_id", "left").select("group_id", F.coalesce("span", F.lit(0).cast("long")).alias("span"))


def _total(proteomes: DataFrame) -> int:
    return proteomes.select("list_id").distinct().count()


def _kept(groups: DataFrame, spans: DataFrame, condition) -> DataFrame:
    return groups.join(spans.where(condition), "group_id", "left_semi").select("group_id", "member")


def ortholog_in_min(n: float, groups: DataFrame, proteomes: DataFrame) -> DataFrame:
    """Groups with members in at least ``pick_min(n, N)`` of the N proteomes."""
    total = _total(proteomes)
    if not total:
        return groups.limit(0).select("group_id", "member")
    return _kept(groups, group_spans(groups, proteomes), F.col("span") >= pick_min(n, total))


def ortholog_in_max(n: float, groups: DataFrame, proteomes: DataFrame) -> DataFrame:
    """Groups with members in at most ``pick_max(n, N)`` of the N proteomes."""
    total = _total(proteomes)
    if not total:
        return groups.select("group_id", "member")
    return _kept(groups, group_spans(groups, proteomes), F.col("span") <= pick_max(n, total))


def ortholog_in_any(groups: DataFrame, proteomes: DataFrame) -> DataFrame:
    return ortholog_in_min(1, groups, proteomes)


def ortholog_in_all(groups: DataFrame, proteomes: DataFrame) -> DataFrame:
    return ortholog_in_min(_total(proteomes), groups, proteomes)


def greencut2_families(rb_hits: DataFrame, more_hits: DataFrame, most_evalue: float = 10.0) -> DataFrame:
    """Families of genes around reference ids, the queries of ``rb_hits``.

    A reference and its subjects in either table are one family (hits of other
    queries in ``more_hits`` are ignored); families that share a reference id
    are one, over any number of steps. Returns ``family, member, is_ref`` for
    families of two members or more; ``family`` is its least reference. A
    non-reference that several families hit is in each. What later steps read
    more than once is written to the shared folder: else one task holds the
    sorts of all steps at once.
    """
    clean = lambda h: (h.where(F.col("evalue") <= most_evalue) if "evalue" in h.columns else h).select("queryid", "subjectid")
    first = clean(rb_hits)
    refs = cut(first.select(F.col("queryid").alias("ref")).distinct())
    edges = first.unionByName(clean(more_hits)).join(refs, F.col("queryid") == F.col("ref"), "left_semi").distinct()
    is_ref = refs.select(F.col("ref").alias("subjectid"), F.lit(True).alias("is_ref"))
    marked = cut(edges.join(is_ref, "subjectid", "left").withColumn("is_ref", F.coalesce("is_ref", F.lit(False))))
    links = connected_components(marked.where("is_ref"), "queryid", "subjectid")
    labels = cut(refs.join(links, F.col("ref") == F.col("node"), "left").select("ref", F.coalesce("component", "ref").alias("family")))
    rest = marked.where("not is_ref").join(labels, F.col("queryid") == F.col("ref")).select("family", F.col("subjectid").alias("member"), "is_ref").distinct()
    members = cut(labels.select("family", F.col("ref").alias("member"), F.lit(True).alias("is_ref")).unionByName(rest))
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return members.join(sizes, "family", "left_semi").select("family", "member", "is_ref")
