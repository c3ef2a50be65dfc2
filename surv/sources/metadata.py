"""Answers from metadata (A09, C11, E29, E72): row counts, first and last values
from Parquet footers, the greatest partition from the folder names.  No row is read.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surv.sources import writers as W


def footer_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose Parquet reader pushes aggregates
    into the scan, where they are answered from the footers' statistics."""
    s = spark.newSession()
    for k, v in (("spark.sql.sources.useV1SourceList", "avro,csv,json,kafka,orc,text"), ("spark.sql.parquet.aggregatePushdown", "true"),
                 ("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))):
        s.conf.set(k, v)
    return s


def pushed(spark: SparkSession, path: str, *aggregates, part_col: str | None = None) -> DataFrame:
    """Aggregates of a table by the session that pushes them into its footers; with
    ``part_col`` without the partition of nulls."""
    t = footer_session(spark).read.parquet(path)
    return (t.filter(F.col(part_col).isNotNull()) if part_col else t).agg(*aggregates)


def footer_aggregates(spark: SparkSession, path: str, greatest: Sequence[str] = (), least: Sequence[str] = (),
                      part_of: dict[str, str] | None = None) -> dict:
    """``total`` rows, ``max_<c>`` and ``min_<c>`` of columns that footers have
    statistics of (numbers, dates, booleans).  ``part_of`` names the partition column
    that is made of a column (a year of a date): the partition of nulls has none of it.
    Where another file's footer lacks statistics -- a column of nulls only -- Spark
    refuses; then that one column is read."""
    out = {"total": pushed(spark, path, F.count(F.lit(1)).alias("total")).first().total}
    for name, fn, cols in (("max", F.max, greatest), ("min", F.min, least)):
        for c in cols:
            try:
                out[f"{name}_{c}"] = pushed(spark, path, fn(c), part_col=(part_of or {}).get(c)).first()[0]
            except Exception as e:  # noqa: BLE001 - only the refusal is handled
                if "No min/max found" not in str(e):
                    raise
                out[f"{name}_{c}"] = spark.read.parquet(path).agg(fn(c)).first()[0]
    return out


def table_root(df: DataFrame, part_col: str) -> str:
    """Folder of a table partitioned by ``part_col``, from its file listing."""
    return df.inputFiles()[0].split(f"/{part_col}=")[0]


def greatest_partition(spark: SparkSession, base: str, col: str) -> str | None:
    """Greatest value among the ``col=`` folders, numbers as numbers."""
    values = [v for v in W.partition_dirs(spark, base, col) if v != "__HIVE_DEFAULT_PARTITION__"]
    if all(v.lstrip("-").isdigit() for v in values):
        return max(values, key=int, default=None)
    return max(values, default=None)


def latest_value(spark: SparkSession, base: str, col: str, part_col: str):
    """Greatest ``col`` of a table partitioned by a part of it (a date by its
    year): from the footers of the greatest partition."""
    part = greatest_partition(spark, base, part_col)
    if part is None:
        return None
    return footer_aggregates(spark, f"{base.rstrip('/')}/{part_col}={part}", [col])[f"max_{col}"]
