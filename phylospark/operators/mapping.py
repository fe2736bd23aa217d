"""User functions over lists, and operators made of operators."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups that a list's partial states are merged in before they meet.
SALTS = 64


def map_each(df: DataFrame, by: list[str], function: Callable, schema: str) -> DataFrame:
    """Apply a function of a pandas DataFrame to each list. A list must fit in a task's memory; see ``map_each_in_parts``."""
    return df.groupBy(*by).applyInPandas(function, schema)


def map_each_in_parts(df: DataFrame, by: list[str], partial: Callable, merge: Callable, finish: Callable, state: str, schema: str, salts: int = SALTS) -> DataFrame:
    """Apply a function to each list in three parts, so that a list of any length is many small calls.

    ``partial`` makes a state of some rows of a list, ``merge`` one state of
    some states, in any order, and ``finish`` the result of the last state. Each
    gets and gives a pandas DataFrame without the columns ``by``; states have
    the columns of ``state``, results those of ``schema``. States are made of
    the batches of a task's rows, merged in ``salts`` groups for each list and
    then once more. Null keys are lists.
    """
    keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)

    def keyed(made: pd.DataFrame, key: tuple) -> pd.DataFrame:
        for at, (name, value) in enumerate(zip(by, key)):
            made.insert(at, name, [value] * len(made))
        return made

    def first(batches):
        for pdf in batches:
            for key, rows in pdf.groupby(by, dropna=False, sort=False):
                yield keyed(partial(rows.drop(columns=by)), tuple(None if pd.isna(k) else k for k in key))

    def merged(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return keyed(merge(pdf.drop(columns=[*by, "_salt"], errors="ignore")), key[: len(by)])

    def last(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return keyed(finish(merge(pdf.drop(columns=by))), key)

    states = df.mapInPandas(first, f"{keys}, {state}").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    some = states.groupBy(*by, "_salt").applyInPandas(merged, f"{keys}, {state}")
    return some.groupBy(*by).applyInPandas(last, f"{keys}, {schema}")


def compose(*functions: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """One operator from several, the first applied first."""

    def composed(df: DataFrame) -> DataFrame:
        for f in functions:
            df = df.transform(f)
        return df

    return composed
