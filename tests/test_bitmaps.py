"""Set algebra on bitmaps against the groupings of ``sets`` and against Python sets."""

import random
from collections import Counter

import pytest

from phylospark.operators import bitmaps, sets


def made(spark, lists):
    rows = [(name, v) for name, values in lists.items() for v in values]
    data = spark.createDataFrame(rows, "list_id string, value string").repartition(5)
    return data, spark.createDataFrame([(name, i) for i, name in enumerate(lists)], "list_id string, pos long")


def values(df):
    return sorted((r["value"] for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_folds_and_regions_are_those_of_sets(spark, seed):
    """Lists in any order of names, repeated elements, a null element, and in one case an empty list."""
    rng = random.Random(seed)
    names = [f"l{rng.randrange(1000)}-{i}" for i in range(3 + 8 * seed)]
    pool = [str(v) for v in range(300)] + [None]
    lists = {n: rng.choices(pool, k=rng.randint(400, 900)) for n in names}
    if seed == 1:
        lists[names[1]] = []
    data, given = made(spark, lists)
    held = {n: set(v) for n, v in lists.items()}
    every, whole = set().union(*held.values()), set.intersection(*held.values())
    fold = set()
    for n in reversed(names):
        fold = held[n] - fold
    assert values(bitmaps.any_of(data, given)) == sorted(every, key=repr)
    assert values(bitmaps.all_of(data, given)) == sorted(whole, key=repr) == values(sets.all_of(data, given))
    assert values(bitmaps.some_of(data, given)) == sorted(every - whole, key=repr)
    assert values(bitmaps.diff_of(data, given)) == sorted(fold, key=repr) == values(sets.diff_of(data, given))
    want = Counter(",".join(sorted(n for n in names if v in held[n])) for v in every)
    assert {r["lists"]: r["n"] for r in bitmaps.set_regions(data).collect()} == want


def test_empty_tables_and_too_many_lists(spark, monkeypatch):
    data, given = made(spark, {"a": ["x"], "b": ["y"], "c": ["x"]})
    for op in (bitmaps.any_of, bitmaps.all_of, bitmaps.some_of, bitmaps.diff_of):
        assert op(data.limit(0), given).count() == 0
    assert bitmaps.set_regions(data.limit(0)).count() == 0
    monkeypatch.setattr(bitmaps, "MOST_LISTS", 2)
    with pytest.raises(ValueError, match="at most 2"):
        bitmaps.diff_of(data, given)
