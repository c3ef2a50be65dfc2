"""Distinct counts that roll up (E71 on E28).

A count of distinct values is not additive, but the set itself is: it is kept as
bitmaps.  Values get dense numbers; a cube row holds, for its group and one bucket
of 32,768 numbers, the bitmap of the numbers that occur.  A roll-up ORs the bitmaps
of a coarser group and counts bits: exact, whatever was counted twice below.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surv.operators.ranking import with_position


def value_numbers(df: DataFrame, value: Column) -> DataFrame:
    """``value, number``: every distinct value with a number from 1 on, in order.
    Null is no value."""
    v = df.select(value.alias("value")).where("value IS NOT NULL").distinct()
    return with_position(v, [(F.col("value"), False)], "number")


def distinct_cube(df: DataFrame, keys: Sequence[Column], value: Column, numbers: DataFrame) -> DataFrame:
    """Per group of ``keys`` and bucket the bitmap of the values that occur."""
    x = df.select(*keys, value.alias("value")).join(numbers, "value")
    names = [c for c in x.columns if c not in ("value", "number")]
    return (x.groupBy(*names, F.bitmap_bucket_number("number").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")))


def distinct_rollup(cube: DataFrame, keys: Sequence[str], name: str = "distinct_values") -> DataFrame:
    """Distinct values per group of ``keys``, any subset of the cube's."""
    fine = cube.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return fine.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias(name))
