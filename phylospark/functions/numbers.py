"""Arithmetic, ranges and the rules that pick how many proteomes a group must span."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def plus(a: Column, b: Column) -> Column:
    return a + b


def minus(a: Column, b: Column) -> Column:
    return a - b


def times(a: Column, b: Column) -> Column:
    return a * b


def divide(a: Column, b: Column) -> Column:
    """Null where ``b`` is zero."""
    return F.try_divide(a, b)


def _numbers(spark: SparkSession, count: int) -> DataFrame:
    return spark.range(max(0, count)).withColumnRenamed("id", "pos")


def range_add(spark: SparkSession, start: float, stop: float, step: float) -> DataFrame:
    """``pos, value``: start, start + step, ... up to stop."""
    if step == 0 or (stop - start) * step < 0:
        raise ValueError("the step does not lead from start to stop")
    count = math.floor((stop - start) / step + 1e-10) + 1
    return _numbers(spark, count).select("pos", (F.lit(float(start)) + F.col("pos") * F.lit(float(step))).alias("value"))


def range_exponent(spark: SparkSession, base: float, start: float, stop: float, step: float) -> DataFrame:
    """base to the power of each number of ``range_add(start, stop, step)``."""
    return range_add(spark, start, stop, step).select("pos", F.pow(F.lit(float(base)), F.col("value")).alias("value"))


def range_integers(spark: SparkSession, start: int, stop: int) -> DataFrame:
    """Whole numbers from start to stop, both included; downwards if start is greater."""
    sign = 1 if stop >= start else -1
    return _numbers(spark, abs(stop - start) + 1).select("pos", (F.lit(start) + F.col("pos") * sign).alias("value"))


def range_length(spark: SparkSession, start: float, stop: float, count: int) -> DataFrame:
    """``count`` evenly spaced numbers, both ends included."""
    gap = (stop - start) / (count - 1) if count > 1 else 0.0
    return _numbers(spark, count).select("pos", (F.lit(float(start)) + F.col("pos") * F.lit(gap)).alias("value"))


def range_multiply(spark: SparkSession, start: float, stop: float, factor: float) -> DataFrame:
    """start, start * factor, ... while the size stays within that of stop."""
    if start == stop:
        return _numbers(spark, 1).select("pos", F.lit(float(start)).alias("value"))
    if start == 0 or stop == 0:
        raise ValueError("a multiplied range has no end at zero")
    if start * stop < 0:
        raise ValueError("the ends of a multiplied range have one sign")
    if factor <= 0:
        raise ValueError("the factor of a multiplied range is greater than zero")
    if factor == 1 or (abs(stop) > abs(start)) != (factor > 1):
        raise ValueError("the factor does not lead from start to stop")
    # How many steps there are, then one more or less where the logarithm was rounded the other way.
    within = (lambda n: abs(start * factor**n) <= abs(stop)) if factor > 1 else (lambda n: abs(start * factor**n) >= abs(stop))
    steps = max(0, math.floor(math.log(stop / start) / math.log1p(factor - 1)))
    while within(steps + 1):
        steps += 1
    while steps and not within(steps):
        steps -= 1
    return _numbers(spark, steps + 1).select("pos", (F.lit(float(start)) * F.pow(F.lit(float(factor)), F.col("pos").cast("double"))).alias("value"))


def _asked(x: float, total: int) -> float:
    """How many of ``total`` a rule asks for, before rounding: a share of them, a number, or a number counted from the end.

    A share lies strictly between -1 and 1; counting from the end repeats until
    the number is a share or not below zero any more.
    """
    while x <= -1 and total > 0:
        x += total
    return x * total if abs(x) < 1 else x


def pick_min(x: float, total: int) -> int:
    """At least how many of ``total`` proteomes ``x`` asks for; further from the end than there are counts as none."""
    return 0 if x < -total else math.ceil(_asked(x, total))


def pick_max(x: float, total: int) -> int:
    """At most how many of ``total`` proteomes ``x`` allows, all of them at most."""
    return min(math.floor(_asked(x, total)), total)
