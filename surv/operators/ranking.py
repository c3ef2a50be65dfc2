"""Global ranks (F01-F03) without a single-task sort of the rows.

Rows are first reduced to their distinct sort keys with a count, so a tie of any
size is one key.  The keys are dealt to buckets by range: Spark draws a sample of
them for the bounds, so buckets are even wherever the keys lie -- close together,
with a common beginning, of any type.  The keys with their buckets are written (the
bounds are drawn once), and three plain steps give each key its place: rows per
bucket, a running sum over buckets (one row each), and a running sum inside each
bucket.  The result is joined back null-safe, since NULL is a key like any other
(first when ascending, last when descending).

Positions also number the rows of a tie.  They are numbered in the parts of a
written table, a tie in all parts that have rows of it at once, and the parts' counts
are added up, so a tie of a third of all rows is no task of its own.

The steps are the same at every size; only the number of ranges differs.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surv.session import leaf_bytes, materialize

SMALL_BYTES = 256 * 1024 * 1024
BUCKETS_PER_PARTITION = 8     # buckets are dealt to tasks by hash: several each even out


def _direction(cols: Sequence[str], desc: Sequence[bool]) -> list[Column]:
    return [F.col(c).desc() if d else F.col(c).asc() for c, d in zip(cols, desc)]


def key_buckets(g: DataFrame, keys: Sequence[str], desc: Sequence[bool]) -> DataFrame:
    """Distinct keys (``_same`` rows each) with ``_bucket``: buckets of like size, in
    the order of the keys; written."""
    by = _direction(keys, desc)
    n = BUCKETS_PER_PARTITION * int(g.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = leaf_bytes(g)
    # what fits a few partitions is left to AQE, which merges small ranges
    parts = g.repartitionByRange(*by) if known is not None and known <= SMALL_BYTES else g.repartitionByRange(n, *by)
    return materialize(parts.withColumn("_bucket", F.spark_partition_id()), "rank-keys")


def _places(df: DataFrame, order: Sequence[tuple[Column, bool]]) -> tuple[DataFrame, DataFrame, list[str]]:
    """``df`` with its keys as columns, and per distinct key: rows strictly
    before it (``_before``), rows with it (``_same``), rows in all (``_all``)."""
    keys, desc = [f"_rk{i}" for i in range(len(order))], [d for _, d in order]
    x = df.select("*", *[c.alias(k) for k, (c, _) in zip(keys, order)])
    g = key_buckets(x.groupBy(*keys).agg(F.count(F.lit(1)).alias("_same")), keys, desc)
    per = g.groupBy("_bucket").agg(F.sum("_same").alias("_n"))
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)      # one row per bucket
    per = per.select(F.col("_bucket").alias("_bucketp"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_off"),
                     F.sum("_n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    inside = Window.partitionBy("_bucket").orderBy(*_direction(keys, desc)).rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("_in", F.coalesce(F.sum("_same").over(inside), F.lit(0)))
    g = (g.join(per, F.col("_bucket") == F.col("_bucketp"))
         .select(*[F.col(k).alias(f"{k}p") for k in keys], "_same", (F.col("_off") + F.col("_in")).alias("_before"), "_all"))
    return x, g, keys


def _joined(df: DataFrame, order: Sequence[tuple[Column, bool]]) -> tuple[DataFrame, list[str]]:
    x, g, keys = _places(df, order)
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{k}p"))
    return x.join(g, cond), keys


def with_position(df: DataFrame, order: Sequence[tuple[Column, bool]], name: str = "position") -> DataFrame:
    """1-based position of each row in the total order ``order``, a list
    of (key, descending) pairs.  Rows with equal keys get consecutive
    positions in no particular order; end the list with a unique key for a
    deterministic result."""
    j, keys = _joined(df, order)
    j = materialize(j.withColumn("_row", F.monotonically_increasing_id()), "positions").withColumn("_part", F.shiftright("_row", 33))
    ties = j.filter("_same > 1")
    # rows of a tie in the parts before this one: a row for each part that has any
    key = Window.partitionBy("_before").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ties.groupBy("_before", "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_skip", F.coalesce(F.sum("_n").over(key), F.lit(0)))
    ties = ties.join(parts.drop("_n"), ["_before", "_part"])
    nth = F.col("_skip") + F.row_number().over(Window.partitionBy("_before", "_part").orderBy("_row"))
    cols = [F.col(f"`{c}`") for c in df.columns]
    one = j.filter("_same = 1").select(*cols, (F.col("_before") + 1).cast("bigint").alias(name))
    return one.union(ties.withColumn("_nth", nth).select(*cols, (F.col("_before") + F.col("_nth")).cast("bigint").alias(name)))


def with_rank(df: DataFrame, value: str, descending: bool = False, name: str = "rank") -> DataFrame:
    """competition rank (``method='min'``): 1 + rows strictly before."""
    j, _ = _joined(df, [(F.col(value), descending)])
    return j.withColumn(name, (F.col("_before") + 1).cast("int")).select(*[F.col(f"`{c}`") for c in df.columns], name)


def with_pct_rank_average(df: DataFrame, value: str, name: str = "pct_rank") -> DataFrame:
    """pandas ``rank(pct=True, method='average')`` = (rows before the tie
    group + (ties + 1) / 2) / row count.  (``percent_rank`` and ``cume_dist``
    give other numbers.)"""
    j, _ = _joined(df, [(F.col(value), False)])
    return (j.withColumn(name, (F.col("_before") + (F.col("_same") + 1) / 2.0) / F.col("_all"))
             .select(*[F.col(f"`{c}`") for c in df.columns], name))
