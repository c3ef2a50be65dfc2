"""Sinks.

Writes go to Parquet; replacing data is done by writing a new path (or
dynamic partition overwrite) so a job never overwrites what it is reading,
and a lost executor only re-runs its tasks -- the output is committed
atomically per job by Spark's file committer.
"""

from __future__ import annotations

import datetime as _dt
import os
import uuid
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surv.session import checkpoint_dir

WRITE_MODES = {"append": "append", "replace": "overwrite", "fail": "errorifexists"}


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def save_raw_snapshot(df: DataFrame, base: str, kind: str, name: str, ts: str | None = None) -> str:
    """Persist a raw batch under ``<base>/<kind>/<name>_<timestamp>``."""
    ts = ts or _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%d%H%M%S")
    path = f"{base.rstrip('/')}/{kind}/{name}_{ts}"
    df.write.mode("errorifexists").parquet(path)
    return path


def write_table(df: DataFrame, path: str, if_exists: str = "append",
                partition_by: Sequence[str] = ()) -> bool:
    """Append / replace / fail; an empty frame is a no-op (returns False)."""
    if if_exists not in WRITE_MODES:
        raise ValueError(f"if_exists must be one of {sorted(WRITE_MODES)}")
    if df.isEmpty():
        return False
    w = df.write.mode(WRITE_MODES[if_exists])
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return True


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str],
               if_exists: str = "append", batchsize: int = 1000) -> None:
    """A11 (database form): JDBC write in batches of ``batchsize`` rows."""
    df.write.option("batchsize", batchsize).jdbc(url, table, mode=WRITE_MODES[if_exists], properties=properties)


def replace_table(spark: SparkSession, df: DataFrame, path: str, partition_by: str | None = None) -> str:
    """Truncate-then-load as one published version (read it with
    ``published.read_table``): there is no moment without a table, and ``df``
    may read the rows it replaces."""
    from surv.sources.published import ROWS, Change, TableGroup
    TableGroup(spark, path).publish({ROWS: Change(df, partition_by)})
    return path


def refresh_dimension(spark: SparkSession, df: DataFrame, path: str) -> int:
    """Full refresh of a dimension; returns its row count."""
    from surv.sources.published import read_table
    replace_table(spark, df, path)
    return read_table(spark, path).count()


def write_report_csv(df: DataFrame, path: str, single_file: bool = True) -> str:
    """Report as CSV with a UTF-8 byte-order mark (the mark is written as
    the first character of the header).  Reports are aggregates of a few rows,
    so they are one file unless ``single_file`` is False; then every part file
    starts with the marked header."""
    first = df.columns[0]
    out = df.withColumnRenamed(first, "\ufeff" + first)
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)
    return path


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location."""
    return os.path.join(checkpoint_dir(spark).rstrip("/"), f"{name}-{uuid.uuid4().hex}")


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    if fs.exists(p):
        fs.delete(p, True)


def partition_dirs(spark: SparkSession, path: str, col: str) -> list[str]:
    """Values of ``col=`` partition directories under ``path`` (metadata)."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        n = st.getPath().getName()
        if st.isDirectory() and n.startswith(f"{col}="):
            out.append(n.split("=", 1)[1])
    return out
