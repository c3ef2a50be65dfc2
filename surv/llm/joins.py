"""A join that shuffles few of the left rows, and keys that tell rows apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surv.session import materialize

ROW = "_row_key"
FILTER_BITS = 25   # 1,024 rows of 4 KB


def maybe_in(rows: DataFrame, key: Column, some: DataFrame, some_key: Column) -> DataFrame:
    """The ``rows`` whose key is, up to hash collisions, one of ``some``: a bitmap of
    hashed keys, of fixed size, is broadcast.  Once it is full all rows pass."""
    bit = lambda c: F.pmod(F.xxhash64(c, F.lit(3)), F.lit(1 << FILTER_BITS))
    maps = (some.select(bit(some_key).alias("bit")).groupBy(F.shiftright("bit", 15).alias("_bucket"))
            .agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(32767))).alias("_map")))
    low = rows.withColumn("_bit", bit(key)).withColumn("_bucket", F.shiftright("_bit", 15))
    byte = F.conv(F.hex(F.substring("_map", F.shiftright(F.col("_bit").bitwiseAND(F.lit(32767)), 3).cast("int") + F.lit(1), F.lit(1))), 16, 10).cast("long")
    mask = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (F.col("_bit").bitwiseAND(F.lit(7)) + 1).cast("int"))
    return low.join(F.broadcast(maps), "_bucket").where(byte.bitwiseAND(mask) != 0).drop("_bit", "_bucket", "_map")


def with_ids(docs: DataFrame, some: DataFrame) -> DataFrame:
    """``docs`` joined with ``some`` on ``id``, after a bitmap of the ids, so that few
    other texts are shuffled; the join alone decides."""
    return maybe_in(docs, F.col("id"), some, F.col("id")).join(some, "id")


def with_row_keys(docs: DataFrame, name: str = "keyed") -> DataFrame:
    """``docs`` plus ``ROW``, a number of its own for every row.  Written before
    use, so that every later read sees the same numbers."""
    return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), name)
