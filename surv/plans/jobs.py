"""The reference's two load jobs as Spark jobs.

``incremental_run``: mark -> overlap window -> read -> raw snapshot -> clean
-> conform -> checks -> window replace -> run log -> mark.  Only the mark
(one value) and the run-log rows touch the driver; everything else runs on
executors.

``backfill_years``: per source year, read + validate, then replace that year
as one published version, then rebuild the derived tables
from one fact scan and reconcile rows per year.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surv.operators import conform as B
from surv.operators import counts as C
from surv.operators import cubes as CU
from surv.operators import quality as Q
from surv.operators import scope as S
from surv.roles import NATIVE_ROLES, Roles
from surv.sources import readers as R
from surv.sources import writers as W
from surv.sources.published import read_table, table_exists
from surv.streaming import incremental as INC

REQUIRED_FACT_COLUMNS = ("municipio", "data_notificacao", "classificacao_final")


def _state(spark: SparkSession, path: str) -> DataFrame:
    if table_exists(spark, path):
        return read_table(spark, path)
    return spark.createDataFrame([], INC.STATE_SCHEMA)


def read_raw(spark: SparkSession, kind: str, path: str, **read_opts) -> DataFrame:
    """A07 + A05: the records of an extract; a JSON document is cut into records
    by block, whatever its size."""
    if kind == "json" and read_opts.get("multiline", True):
        raw = R.read_json_records(spark, path, schema=read_opts.get("schema"))
        return R.flatten(raw) if read_opts.get("normalize", True) else raw
    raw = R.read_source(spark, kind, path, **read_opts)
    return R.json_records(raw) if kind == "json" else raw


def conform_batch(raw: DataFrame, source_year: int | None = None) -> DataFrame:
    """Clean (B09) and conform (B10) a raw batch; the partition column is the
    source year when given (T28), else the notification year."""
    fact = B.conform_fact(B.default_clean(raw))
    year = F.lit(source_year) if source_year is not None else F.year("data_notificacao")
    return S.with_stored_keys(fact, NATIVE_ROLES).withColumn("year", year.cast("int"))


def incremental_run(spark: SparkSession, kind: str, path: str, warehouse: str, pipeline: str = "notifications",
                    source: str = "extract", overlap_days: int = 2, fallback_year: int | None = None,
                    roles: Roles = NATIVE_ROLES, **read_opts) -> dict:
    """SURVEY 3.1 incremental pipeline over one delivered extract."""
    state_path, log_path = f"{warehouse}/_state", f"{warehouse}/_runs"
    fact_path = f"{warehouse}/fact"
    run_id = uuid.uuid4().hex
    INC.append_run_log(INC.run_log_row(spark, pipeline, source, INC.RUN_RUNNING, run_id=run_id), log_path)
    started = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    try:
        mark = INC.mark_value(_state(spark, state_path), pipeline, source)              # J01
        start = INC.overlap_start(mark, overlap_days, fallback_year)                      # J02
        raw = read_raw(spark, kind, path, **read_opts)                                    # A07, A05
        snap = W.save_raw_snapshot(raw, f"{warehouse}/_raw", kind, f"{source}-{run_id}")  # A08
        fact = conform_batch(spark.read.parquet(snap))       # the source is parsed once
        fact = fact.filter(F.col("data_notificacao") >= F.lit(start))                     # C13
        Q.require_columns(fact, REQUIRED_FACT_COLUMNS)                                    # K02
        if fact.isEmpty():                                                                # K01 (soft)
            rows, max_date = 0, None
        else:
            staged = W.staging_path(spark, "incremental-batch")
            fact.write.parquet(staged)                                                    # lineage cut
            fact = spark.read.parquet(staged)
            stats = fact.agg(F.count(F.lit(1)).alias("n"), F.max("data_notificacao").alias("m")).first()
            rows, max_date = stats.n, stats.m
            INC.replace_date_window(spark, fact, fact_path, "data_notificacao", start.isoformat())  # A13
        status = INC.RUN_SUCCESS
        msg = None
    except Exception as e:  # noqa: BLE001 - recorded in the run log, then re-raised
        status, rows, max_date, msg = INC.RUN_FAILED, None, None, str(e)
    INC.append_run_log(INC.run_log_row(spark, pipeline, source, status, run_id=run_id, rows=rows,
                                       max_date=max_date, message=msg, started_at=started), log_path)  # J04
    upd = spark.createDataFrame([(pipeline, source, status, max_date,
                                  _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None))],
                                "pipeline string, source string, status string, last_success_date date, "
                                "updated_at timestamp")
    new_state = INC.upsert_mark(_state(spark, state_path), upd)                           # J05
    W.replace_table(spark, new_state, state_path)
    if status == INC.RUN_FAILED:
        raise RuntimeError(f"run {run_id} failed: {msg}")
    return {"run_id": run_id, "rows": rows, "window_start": start.isoformat(), "max_date": max_date}


def backfill_years(spark: SparkSession, files: Sequence[tuple[int, str]], kind: str, warehouse: str,
                   territory: DataFrame | None = None, roles: Roles = NATIVE_ROLES,
                   continue_on_error: bool = False, **read_opts) -> dict:
    """SURVEY 3.2: reload each source year (J07), then rebuild the derived
    tables (J08) and reconcile rows per year (J09) against the loaded counts.

    All files of a year are loaded together, so a year is replaced once.  Each
    file is parsed once, into a raw snapshot (A08) that the rest reads.  With
    ``continue_on_error`` a year that fails keeps its old rows and is listed
    under ``failed``; otherwise the first failure is raised."""
    fact_path = f"{warehouse}/fact"
    by_year: dict[int, list[str]] = {}
    for year, path in sorted(files):                                                      # A10 order
        by_year.setdefault(year, []).append(path)
    loaded, failed = [], {}
    for year, paths in by_year.items():
        try:
            snaps = []
            for path in paths:
                raw = read_raw(spark, kind, path, **read_opts)
                snaps.append(spark.read.parquet(W.save_raw_snapshot(raw, f"{warehouse}/_raw", kind, f"{year}-{uuid.uuid4().hex}")))
            batch = conform_batch(B.union_widening(snaps), source_year=year)
            INC.reload_years(spark, batch, fact_path, required=REQUIRED_FACT_COLUMNS)
            loaded.append((year, read_table(spark, fact_path).filter(F.col("year") == year).count()))
        except Exception as e:  # noqa: BLE001 - listed for the caller, or raised
            if not continue_on_error:
                raise
            failed[year] = str(e)
    out: dict = {"years": [y for y, _ in loaded], "failed": failed}
    if not loaded:
        return out
    fact = read_table(spark, fact_path)
    if territory is not None:
        out["analytics"] = CU.build_analytics(fact, roles, territory, f"{warehouse}/analytics")
    log_rows = spark.createDataFrame(loaded, "year int, loaded_rows bigint")
    y0, y1 = min(out["years"]), max(out["years"])
    out["reconciliation"] = Q.reconcile_years(log_rows, C.rows_per_year_by_date(fact, roles),
                                              C.rows_per_year_by_text(fact, roles), y0, y1)
    return out


# ---- maintenance jobs (dimension loads and reports) ---------------------------------
def load_municipality_dimension(spark: SparkSession, csv_path: str, out_path: str) -> int:
    """A01 + B23 + A14: census CSV -> municipality dimension, full refresh."""
    dim = B.conform_municipalities(R.read_csv(spark, csv_path))
    return W.refresh_dimension(spark, dim, out_path)


def load_facility_dimension(spark: SparkSession, snapshots_base: str, out_path: str) -> int:
    """A09 + A02 + B24 + A14: latest period's facility file -> dimension.
    The period folder is chosen on the listing (metadata), then the file is
    read with the dialect fallback."""
    periods = sorted(W.partition_dirs(spark, snapshots_base, "period"))
    if not periods:
        raise ValueError(f"no period=... folders under {snapshots_base}")
    raw = R.read_csv_dialect(spark, f"{snapshots_base.rstrip('/')}/period={periods[-1]}",
                             B.FACILITY_ALIASES["cnes"])
    return W.refresh_dimension(spark, B.conform_facilities(R.with_file_order(raw)), out_path)


def field_validity_report(spark: SparkSession, fact: DataFrame, territory: DataFrame, place: str,
                          out_csv: str, roles: Roles = NATIVE_ROLES, state_codes=None) -> DataFrame:
    """E35-E37 + A15: field validity of the place scope, written as CSV."""
    from surv.functions import codes as K
    from surv.operators import scope as S
    g = S.place_scope(S.notified(fact, roles), roles, territory, place, state_codes or K.FOCUS_STATE_CODES)
    rep = Q.field_validity(g, roles.bind(fact)).orderBy("group", "field")
    W.write_report_csv(rep, out_csv)
    return rep


def reconciliation_report(spark: SparkSession, fact: DataFrame, load_log: str, y0: int, y1: int,
                          out_csv: str, roles: Roles = NATIVE_ROLES,
                          tolerance_abs: int = 7000, tolerance_pct: float = 0.5) -> DataFrame:
    """A16 + D11 + J09 + A15: loaded rows from the load log vs the table."""
    rep = Q.reconcile_years(R.read_load_log(spark, load_log), C.rows_per_year_by_date(fact, roles, y0, y1),
                            C.rows_per_year_by_text(fact, roles, y0, y1), y0, y1,
                            tolerance_abs, tolerance_pct).orderBy("year")
    W.write_report_csv(rep, out_csv)
    return rep


def schema_audit_report(spark: SparkSession, raw: DataFrame, table: DataFrame, out_csv: str) -> DataFrame:
    """K07 + A15: source fields (after B09) vs the conform spec's inputs vs
    its outputs vs the stored table."""
    cleaned = B.default_clean(raw)
    mapper_inputs = sorted({s for _, srcs, _, _ in B.FACT_TYPED for s in srcs}
                           | set(B.RAW_DATE_COLUMNS) | set(B.RAW_TEXT_COLUMNS) | {"municipio", "id_municip",
                                                                                   "sg_uf_not", "sg_uf"})
    out_cols = B.conform_fact(cleaned).columns
    rep = Q.schema_coverage(spark, cleaned.columns, mapper_inputs, out_cols, table,
                            aliases={"resul_pcr_": ["resul_pcr"]}).orderBy("name")
    W.write_report_csv(rep, out_csv)
    return rep
