"""Structured Streaming forms of the incremental steps.

* J10 -- poll a landing folder and load only new files: a file-source stream
  with ``trigger(availableNow=True)``; the stream checkpoint replaces the
  downloader's manifest.
* J03 -- late records inside the overlap window replace earlier ones: the
  days of a delivery are replaced in the body of ``foreachBatch``.
* J03 by key -- ``stream_upsert``: records of one key in any order, the newest
  version wins; records older than the mark minus the lateness are kept apart.
* J12 -- extension: events per day and type with an event-time watermark, whole
  (complete mode) or closed days only (append mode, bounded state).

Results of the last two are published tables whose pointer also names the epoch
they hold, so an epoch that runs again after a loss changes nothing.

Checkpoints go under the shared ``spark.checkpoint.dir`` so a restarted
driver resumes where it stopped.
"""

from __future__ import annotations

import os
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surv.session import checkpoint_dir, materialize
from surv.sources.published import Change, TableGroup
from surv.streaming import incremental as INC


def _ckpt(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark).rstrip("/"), "streams", name)


def sync_new_files(spark: SparkSession, landing: str, schema: T.StructType | str, table_path: str,
                   fmt: str = "parquet", name: str = "sync", part_col: str | None = None) -> None:
    """Append every file that arrived since the last run, then stop."""
    src = spark.readStream.format(fmt).schema(schema).load(landing)
    w = (src.writeStream.format("parquet").option("path", table_path)
         .option("checkpointLocation", _ckpt(spark, name)).trigger(availableNow=True))
    if part_col:
        w = w.partitionBy(part_col)
    w.start().awaitTermination()


def stream_window_replace(spark: SparkSession, landing: str, schema: T.StructType | str, table_path: str,
                          date_col: str, fmt: str = "parquet", name: str = "window-replace",
                          part_col: str = "year", since: str | None = None) -> None:
    """Each micro-batch re-delivers whole days; those days (on or after
    ``since``, the stored mark minus the overlap) are replaced inside
    ``foreachBatch``, all other days stay.  A late file therefore never
    removes newer rows; days before ``since`` wait for a full reload."""
    def body(batch: DataFrame, epoch_id: int) -> None:
        if not batch.isEmpty():
            INC.replace_days(batch.sparkSession, batch, table_path, date_col, since, part_col)

    src = spark.readStream.format(fmt).schema(schema).load(landing)
    (src.writeStream.foreachBatch(body).option("checkpointLocation", _ckpt(spark, name))
        .trigger(availableNow=True).start().awaitTermination())


def daily_event_counts(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """J12 body: events per day x type with an event-time watermark (works on
    a batch or a streaming frame).

    The watermark needs a zoned TIMESTAMP, so wall-clock (NTZ) event time is
    read as UTC (``unix_timestamp`` of NTZ is zone-free); the day start is
    rebuilt from the epoch day, so the result does not depend on the
    session time zone."""
    e = events.withColumn("_t", F.timestamp_seconds(F.unix_timestamp("ts")))
    if e.isStreaming:
        e = e.withWatermark("_t", watermark)
    day = F.date_from_unix_date(F.floor(F.unix_seconds(F.col("w.start")) / 86400).cast("int"))
    return (e.groupBy(F.window("_t", "1 day").alias("w"), "event_type")
            # exact decimal sum: the total does not depend on summation order
            .agg(F.count(F.lit(1)).alias("events"),
                 F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value_sum"))
            .select(day.cast("timestamp_ntz").alias("day"), "event_type", "events", "value_sum"))


def run_daily_event_counts(spark: SparkSession, source_dir: str, out_path: str, name: str = "daily-events",
                           file_glob: str | None = None) -> DataFrame:
    """Stream the ``events`` files (availableNow) and keep the daily
    table current.  Complete mode with a ``foreachBatch`` overwrite: state is
    one row per (day, type), so it stays small, and the last open day is
    emitted too (append mode would hold it back until the watermark passes)."""
    rd = spark.read.option("pathGlobFilter", file_glob) if file_glob else spark.read
    schema = rd.parquet(source_dir).schema
    rs = spark.readStream.schema(schema)
    if file_glob:
        rs = rs.option("pathGlobFilter", file_glob)
    src = rs.parquet(source_dir)

    def body(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out_path)

    q = (daily_event_counts(src).writeStream.outputMode("complete").foreachBatch(body)
         .option("checkpointLocation", _ckpt(spark, name)).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out_path)


# ---- J03 by key: late records, newest version wins ---------------------------------------------
OPEN, LATE = "rows", "too_late"


def upsert_batch(group: TableGroup, batch: DataFrame, key: Sequence[str], day_col: str, version_col: str, part_col: str,
                 lateness_days: int, epoch: int, source: str) -> int | None:
    """One epoch of ``stream_upsert``; the version it published, or None where the
    epoch is already in the table.

    The state is the table: a key's row lies in the partition of its day (a key
    keeps its day), and only the partitions of the days that arrive are read and
    written again.  The mark is the last day of earlier epochs; days before it by
    more than ``lateness_days`` are closed, and their records go to ``too_late``."""
    spark, facts = group.spark, group.facts(OPEN)
    if facts.get("source") == source and facts.get("epoch", -1) >= epoch:
        return None
    batch = materialize(batch, "epoch")
    mark = facts.get("mark")
    day = F.col(day_col)
    late = F.coalesce(day < F.date_sub(F.lit(mark).cast("date"), lateness_days), F.lit(False)) if mark else F.lit(False)
    fresh = batch.filter(~late)
    parts = [r[0] for r in fresh.select(part_col).distinct().collect()]         # calendar values
    known = [group.read(OPEN).filter(INC._any_value(part_col, parts))] if group.has(OPEN) else []
    rows = fresh
    for old in known:
        rows = rows.unionByName(old.select(*fresh.columns))
    cols = fresh.columns
    # newest version of each key; equal versions: the greatest row, whatever the order of arrival
    best = rows.groupBy(*key).agg(F.max(F.struct(F.col(version_col).alias("_v"), *[F.col(c) for c in cols])).alias("_best"))
    best = best.select("_best.*").drop("_v").select(*cols)
    newest = batch.agg(F.max(day).cast("string")).first()[0]
    mark = max(x for x in (mark, newest, "") if x is not None) or None
    changes = {OPEN: Change(best, part_col, parts if known else None, facts={"epoch": epoch, "source": source, "mark": mark})}
    old_late = batch.filter(late)
    if not group.has(LATE) or not old_late.isEmpty():
        changes[LATE] = Change(old_late, part_col, append=group.has(LATE))
    return group.publish(changes)


def stream_upsert(spark: SparkSession, landing: str, schema: T.StructType | str, path: str, key: Sequence[str], day_col: str,
                  version_col: str, part_col: str, lateness_days: int = 2, fmt: str = "parquet", name: str = "upsert",
                  files_per_epoch: int | None = None) -> TableGroup:
    """J03 by key: reads the files that arrived since the last run and keeps, for
    each key, its newest version (``rows`` of the group at ``path``); records of
    closed days are in ``too_late``.  A restarted run goes on where the last
    published epoch ended."""
    group = TableGroup(spark, path)
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_epoch:
        reader = reader.option("maxFilesPerTrigger", files_per_epoch)

    def body(batch: DataFrame, epoch_id: int) -> None:
        upsert_batch(group, batch, key, day_col, version_col, part_col, lateness_days, epoch_id, name)

    (reader.load(landing).writeStream.foreachBatch(body).option("checkpointLocation", _ckpt(spark, name))
     .trigger(availableNow=True).start().awaitTermination())
    return group


# ---- J12, closed days only ------------------------------------------------------------------
def run_closed_days(spark: SparkSession, source_dir: str, path: str, name: str = "closed-days", watermark: str = "1 day",
                    file_glob: str | None = None, files_per_epoch: int | None = None):
    """J12 in append mode: a day is written once, when the watermark has passed its
    end, and leaves the state; so the state holds the open days only, however long
    the stream runs.  Each epoch's days are appended to the published table at
    ``path`` (partitioned by month); an epoch that runs again is skipped.  Returns
    the table's rows and the state's row count after each epoch."""
    rd = spark.read.option("pathGlobFilter", file_glob) if file_glob else spark.read
    rs = spark.readStream.schema(rd.parquet(source_dir).schema)
    if file_glob:
        rs = rs.option("pathGlobFilter", file_glob)
    if files_per_epoch:
        rs = rs.option("maxFilesPerTrigger", files_per_epoch)
    group = TableGroup(spark, path)

    def body(batch: DataFrame, epoch_id: int) -> None:
        facts = group.facts()
        if facts.get("source") == name and facts.get("epoch", -1) >= epoch_id:
            return
        rows = batch.withColumn("month", F.date_format("day", "yyyy-MM"))
        group.publish({OPEN: Change(rows, "month", append=True, facts={"epoch": epoch_id, "source": name})})

    q = (daily_event_counts(rs.parquet(source_dir), watermark).writeStream.outputMode("append").foreachBatch(body)
         .option("checkpointLocation", _ckpt(spark, name)).trigger(availableNow=True).start())
    q.awaitTermination()
    held = [op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"]]
    return group.read().drop("month"), held
