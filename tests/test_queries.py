"""Every registered query against DuckDB on the driver's tables."""

import pytest

import phylospark.plans.files  # noqa: F401
from phylospark.plans import queries

WITH_SQL = sorted(queries.ORACLES)
ROWS_ONLY = sorted(set(queries.QUERIES) - set(WITH_SQL))


def compare(df, con, sql):
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    wanted = sorted(map(repr, got.fetchall()))
    found = sorted(repr(tuple(r)) for r in df.select(*[f"`{n}`" for n in names]).collect())
    assert found == wanted


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_sql(spark, sf_dir, duck, name):
    compare(queries.QUERIES[name](spark, sf_dir), duck, queries.ORACLES[name])


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs(spark, sf_dir, name):
    queries.QUERIES[name](spark, sf_dir).count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_have_no_cartesian_product(spark, sf_dir):
    for name in ("w1_shared_genes", "reciprocal_best", "ortholog_in_min", "seed_pairs", "w3_cutoff_stability", "lookup_ids", "extract_seqs"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_set_queries_tell_operators_apart(spark):
    """On the given tables no two of these have the same rows, and only the one with an empty list has none."""
    made = {name: sorted(map(repr, queries.QUERIES[name](spark, "/root/testdata/sf0.01").collect())) for name in ("union", "intersection", "difference", "any", "all", "some", "diff", "set_regions", "sets_table")}
    assert all(made.values()) and len({tuple(rows) for rows in made.values()}) == len(made)
    assert len(made["set_regions"]) > 20
    assert not queries.QUERIES["all_with_an_empty_list"](spark, "/root/testdata/sf0.01").head(1)
