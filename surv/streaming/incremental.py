"""Incremental processing.

State (high-water marks, run log) lives in small tables.  Data replacement is
idempotent: the affected year partitions are written beside the table and
published as one version (``sources.published``), so a retried task or job
converges to the same table, a reader sees the old rows or the new ones, and a
driver lost on the way has changed nothing.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surv.sources import writers as W
from surv.sources.published import ROWS, Change, TableGroup, part_key

STATE_SCHEMA = "pipeline string, source string, last_success_date date, updated_at timestamp"
RUN_LOG_SCHEMA = ("run_id string, pipeline string, source string, status string, started_at timestamp, "
                  "finished_at timestamp, rows_loaded bigint, max_date date, message string")
RUN_RUNNING, RUN_SUCCESS, RUN_FAILED = "running", "success", "failed"


# ---- A13 window replacement --------------------------------------------------------------
def _window(date_col: str, d0: str, d1: str | None) -> Column:
    c = F.col(date_col)
    cond = c >= F.lit(d0).cast("date")
    if d1:
        cond = cond & (c <= F.lit(d1).cast("date"))
    return F.coalesce(cond, F.lit(False))   # NULL dates are never in the window


def _any_value(col: str, values: Sequence) -> Column:
    """Null-safe membership: NULL is a partition value like any other."""
    cond = F.lit(False)
    for v in values:
        cond = cond | F.col(col).eqNullSafe(F.lit(v))
    return cond


def window_hit(date_col: str, d0: str, d1: str | None = None):
    """The rows that a window replacement drops, as a test on the old table."""
    return lambda old: _window(date_col, d0, d1)


def day_hit(new: DataFrame, date_col: str):
    """The rows that a delivery of whole days drops: the days it carries
    (bounded by the calendar, not by its rows)."""
    days = [r[0] for r in new.select(F.col(date_col).cast("date")).distinct().collect() if r[0] is not None]
    return lambda old: F.coalesce(F.col(date_col).cast("date").isin(days), F.lit(False)) if days else F.lit(False)


def replaced_parts(old: DataFrame, new: DataFrame, part_col: str, hit: Column) -> list:
    """Partition values (a handful of years) that lose or gain rows."""
    touched = old.filter(hit).select(part_col).unionByName(new.select(part_col)).distinct()
    return sorted((r[0] for r in touched.collect()), key=lambda v: (v is not None, v))


def row_change(old: DataFrame, new: DataFrame, part_col: str, hit: Column, parts: list) -> Change:
    """The rows of the partitions ``parts`` after dropping ``hit`` and adding
    ``new``.  A delivery with extra fields widens the table (B17)."""
    keep = old.filter(_any_value(part_col, parts) & ~hit)
    return Change(keep.unionByName(new, allowMissingColumns=True), part_col, parts)


def _replace_rows(spark: SparkSession, new: DataFrame, table_path: str, part_col: str, drop) -> dict[str, int]:
    """Drop the rows of the table for which ``drop`` holds, then add ``new``, as
    one published version that rewrites only the partitions it touches."""
    table = TableGroup(spark, table_path)
    if not table.has():
        if not new.isEmpty():
            table.publish({ROWS: Change(new, part_col)})
        return {"rewritten_partitions": 0}
    old = table.read()
    hit = drop(old)
    parts = replaced_parts(old, new, part_col, hit)
    if parts:
        table.publish({ROWS: row_change(old, new, part_col, hit, parts)})
    return {"rewritten_partitions": len(parts)}


def replace_date_window(spark: SparkSession, new: DataFrame, table_path: str, date_col: str,
                        d0: str, d1: str | None = None, part_col: str = "year") -> dict[str, int]:
    """Delete rows whose ``date_col`` falls in [d0, d1] (open-ended when
    ``d1`` is None), then append ``new``.  Rows with a NULL date are never
    deleted (reference semantics, T27), whatever their partition.  The table
    is partitioned by ``part_col`` (the source year, T28)."""
    return _replace_rows(spark, new, table_path, part_col, window_hit(date_col, d0, d1))


def replace_days(spark: SparkSession, new: DataFrame, table_path: str, date_col: str,
                 since: str | None = None, part_col: str = "year") -> dict[str, int]:
    """A late delivery replaces exactly the days it carries (on or after
    ``since``, the stored mark minus the overlap); other days stay, newer ones
    too.  Rows of the delivery without a date are added."""
    if since:
        new = new.filter(F.col(date_col).isNull() | (F.col(date_col) >= F.lit(since).cast("date")))
    return _replace_rows(spark, new, table_path, part_col, day_hit(new, date_col))


def reload_years(spark: SparkSession, new: DataFrame, table_path: str, part_col: str = "year",
                 required: Sequence[str] = ()) -> list:
    """Validate first (non-empty, required columns), then replace the
    years present in ``new`` as one published version: no moment without the
    year, and no compensating delete."""
    from surv.operators.quality import require_columns, require_not_empty
    require_not_empty(new)
    require_columns(new, [part_col, *required])
    staging = W.staging_path(spark, "year-reload")
    new.write.mode("errorifexists").parquet(staging)     # the source is read once
    new = spark.read.parquet(staging)
    years = [r[0] for r in new.select(part_col).distinct().collect()]
    table = TableGroup(spark, table_path)
    table.publish({ROWS: Change(new, part_col, years if table.has() else None)})
    W.delete_path(spark, staging)
    return sorted(part_key(y) for y in years)


def year_batches(y0: int, y1: int, size: int = 3) -> list[tuple[int, int]]:
    """Consecutive year ranges of at most ``size`` years, in order."""
    if size < 1:
        raise ValueError("a batch needs at least one year")
    return [(y, min(y + size - 1, y1)) for y in range(y0, y1 + 1, size)]


def historical_load(spark: SparkSession, batches: Sequence[DataFrame], table_path: str,
                    part_col: str = "year") -> int:
    """Historical load, one partitioned write for each non-empty batch.
    The batches are written beside the table and published together at the end:
    readers see the old history until the new one is whole, and a load that
    fails half-way has changed nothing."""
    from surv.sources.published import step
    table, staged, written = TableGroup(spark, table_path), None, 0
    for b in batches:
        if b.isEmpty():
            continue
        staged = table.stage(ROWS, Change(b, part_col, append=staged is not None), staged)
        written += 1
        step(f"batch {written} written")
    if staged:
        table.commit({ROWS: staged})
    return written


def historical_load_years(spark: SparkSession, read_years, table_path: str, y0: int, y1: int, size: int = 3,
                          part_col: str = "year") -> int:
    """J06 with its planning: ``read_years(a, b)`` gives the frame of the years
    a..b; batches of ``size`` years are loaded in order."""
    return historical_load(spark, [read_years(a, b) for a, b in year_batches(y0, y1, size)], table_path, part_col)


# ---- J01 / J02 / J05 / J11 high-water mark ----------------------------------------------------
def read_mark(state: DataFrame, pipeline: str, source: str) -> DataFrame:
    """The mark row(s) of a (pipeline, source)."""
    return state.filter((F.col("pipeline") == pipeline) & (F.col("source") == source))


def overlap_start(mark: _dt.date | None, overlap_days: int = 2, fallback_year: int | None = None) -> _dt.date:
    """Restart at mark minus ``overlap_days`` (default 2), or Jan 1 of
    ``fallback_year`` when there is no mark (parameter, driver side)."""
    if mark is not None:
        return mark - _dt.timedelta(days=overlap_days)
    return _dt.date(fallback_year or _dt.date.today().year, 1, 1)


def mark_value(state: DataFrame, pipeline: str, source: str) -> _dt.date | None:
    """J01 as a value: one row at most, so a ``first()`` is a bounded read."""
    row = read_mark(state, pipeline, source).select("last_success_date").first()
    return row[0] if row else None


def upsert_mark(state: DataFrame, update: DataFrame) -> DataFrame:
    """J05 via D13: full-outer join on (pipeline, source); the old date is
    kept when the run failed or brought none (``update.status`` /
    ``update.last_success_date``)."""
    u = update.select("pipeline", "source", F.col("status").alias("_st"),
                      F.col("last_success_date").alias("_new_d"), F.col("updated_at").alias("_new_t"))
    j = state.join(u, ["pipeline", "source"], "full")
    ok = (F.col("_st") == RUN_SUCCESS) & F.col("_new_d").isNotNull()
    return j.select("pipeline", "source",
                    F.when(ok, F.col("_new_d")).otherwise(F.col("last_success_date")).alias("last_success_date"),
                    F.coalesce("_new_t", "updated_at").alias("updated_at"))


def due_for_check(state: DataFrame, every_days: int, now: Column | None = None) -> DataFrame:
    """Rows whose last check is at least ``every_days`` old (or never)."""
    now = now if now is not None else F.current_timestamp()
    last = F.col("updated_at")
    return state.filter(last.isNull() | (now >= last + F.make_interval(days=F.lit(every_days))))


# ---- J04 run log --------------------------------------------------------------------------------
def run_log_row(spark: SparkSession, pipeline: str, source: str, status: str, run_id: str | None = None,
                rows: int | None = None, max_date: _dt.date | None = None, message: str | None = None,
                started_at: _dt.datetime | None = None) -> DataFrame:
    """One run-log event (start or finish) as a one-row frame."""
    now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    finished = None if status == RUN_RUNNING else now
    return spark.createDataFrame(
        [(run_id or uuid.uuid4().hex, pipeline, source, status, started_at or now, finished, rows, max_date, message)],
        RUN_LOG_SCHEMA)


def append_run_log(row: DataFrame, log_path: str) -> None:
    row.write.mode("append").parquet(log_path)


def run_status(log: DataFrame) -> DataFrame:
    """Latest status of each run (by event time)."""
    ev = F.coalesce("finished_at", "started_at")
    return log.groupBy("run_id").agg(F.max_by("status", ev).alias("status"),
                                     F.min("started_at").alias("started_at"),
                                     F.max("finished_at").alias("finished_at"),
                                     F.max_by("rows_loaded", ev).alias("rows_loaded"))


# ---- D10 / D13 table diffs --------------------------------------------------------------------------
DIGEST_BUCKETS = 4096


def _bucket(key: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(c) for c in key]), F.lit(buckets)).cast("int")


def snapshot_digest(df: DataFrame, key: Sequence[str], stamp: str, buckets: int = DIGEST_BUCKETS) -> DataFrame:
    """Order-free digest of a snapshot by bucket of its keys: rows, and sum and
    exclusive or of a hash of key and stamp.  A small table, to be kept beside the
    snapshot, that says which buckets another snapshot changes."""
    h = F.xxhash64(*[F.col(c) for c in key], F.col(stamp), F.col(stamp).isNull())
    return df.groupBy(_bucket(key, buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: Sequence[str], stamp: str, old_digest: DataFrame | None = None,
                  new_digest: DataFrame | None = None, buckets: int = DIGEST_BUCKETS) -> DataFrame:
    """Which entries are new (key absent before), changed (stamp differs)
    or removed (key absent now), in one full outer join on the key.  With the kept
    digests of both snapshots only the buckets that differ are read and joined."""
    k = list(key)
    if old_digest is not None and new_digest is not None:
        o = old_digest.select("bucket", F.struct("n", "x", "s").alias("o"))
        differ = (o.join(new_digest.select("bucket", F.struct("n", "x", "s").alias("w")), "bucket", "full")
                  .filter(~F.col("o").eqNullSafe(F.col("w"))).select("bucket"))
        changed = [r.bucket for r in differ.collect()]          # at most ``buckets`` numbers
        if not changed:
            return new.limit(0).select(*k).withColumn("change", F.lit(""))
        if len(changed) < buckets:
            old, new = (d.filter(_bucket(k, buckets).isin(changed)) for d in (old, new))
    a = old.select(*k, F.col(stamp).alias("_o"), F.lit(True).alias("_old"))
    b = new.select(*k, F.col(stamp).alias("_n"), F.lit(True).alias("_new"))
    kind = (F.when(F.col("_old").isNull(), F.lit("new")).when(F.col("_new").isNull(), F.lit("removed"))
            .when(~F.col("_n").eqNullSafe(F.col("_o")), F.lit("changed")))
    return a.join(b, k, "full").withColumn("change", kind).filter("change IS NOT NULL").select(*k, "change")


def upsert_keep_old(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Upsert by key; a NULL in the new row keeps the old value
    (``INSERT .. ON CONFLICT DO UPDATE SET c = COALESCE(new.c, old.c)``)."""
    k = list(key)
    cols = [c for c in old.columns if c not in k]
    o = old.select(*k, *[F.col(c).alias(f"_o_{c}") for c in cols])
    n = new.select(*k, *[F.col(c).alias(f"_n_{c}") for c in cols if c in new.columns])
    j = o.join(n, k, "full")
    return j.select(*k, *[F.coalesce(F.col(f"_n_{c}") if c in new.columns else F.lit(None),
                                     F.col(f"_o_{c}")).alias(c) for c in cols])
