"""Test projections of the driver tables into the reference's shapes.

The definitions are SQL expression text that runs unchanged on Spark SQL and
DuckDB (FIXTURES.md section 3), so the Spark operators and the DuckDB oracle
see identical input.  In Spark each projection is a lazy DataFrame: the fact
is ``orders JOIN customer`` (shuffle join on the customer key) with the
25-row ``nation`` table broadcast.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surv.session import broadcast_if_bounded, split_methods

_K = "o_orderkey"
_D = "CAST(o_orderdate AS DATE)"
_CODE6 = "lpad(CAST(33000 + 1001 * n_nationkey AS STRING), 6, '0')"

# column -> expression over orders x customer x nation
CASES_COLUMNS: dict[str, str] = {
    "case_id": f"{_K}",
    "notified_on": f"CASE WHEN {_K} % 97 = 0 THEN NULL ELSE {_D} END",
    "onset_on": (f"CASE WHEN {_K} % 11 = 0 THEN NULL WHEN {_K} % 59 = 1 THEN {_D} + 3 "
                 f"WHEN {_K} % 53 = 1 THEN {_D} - 400 ELSE {_D} - CAST({_K} % 23 AS INT) END"),
    "closed_on": (f"CASE WHEN {_K} % 5 = 0 THEN NULL WHEN {_K} % 67 = 1 THEN {_D} + 500 "
                  f"ELSE {_D} + CAST(({_K} * 7) % 61 AS INT) END"),
    "place_raw": (f"CASE WHEN {_K} % 89 = 0 THEN '  ' WHEN {_K} % 4 = 0 THEN {_CODE6} "
                  f"WHEN {_K} % 4 = 1 THEN concat({_CODE6}, '9') WHEN {_K} % 4 = 2 THEN n_name "
                  f"ELSE CAST(33000 + 1001 * n_nationkey AS STRING) END"),
    "state_raw": (f"CASE WHEN n_regionkey = 0 THEN CASE WHEN {_K} % 2 = 0 THEN 'RJ' ELSE '33' END "
                  f"WHEN n_regionkey = 1 THEN 'SP' WHEN n_regionkey = 2 THEN ' 31 ' "
                  f"WHEN n_regionkey = 3 THEN '' ELSE NULL END"),
    "class_raw": (f"CASE {_K} % 13 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '8' WHEN 3 THEN '10' "
                  f"WHEN 4 THEN '11' WHEN 5 THEN '12' WHEN 6 THEN ' 5 ' WHEN 7 THEN '' WHEN 8 THEN NULL "
                  f"WHEN 9 THEN '9' WHEN 10 THEN '0' WHEN 11 THEN '01' ELSE '6' END"),
    "outcome_raw": (f"CASE {_K} % 17 WHEN 0 THEN '2' WHEN 1 THEN '3' WHEN 2 THEN '4' WHEN 3 THEN '' "
                    f"WHEN 4 THEN NULL WHEN 5 THEN ' 9 ' WHEN 6 THEN 'Obito em investigacao' ELSE '1' END"),
    "hosp_raw": f"CASE {_K} % 7 WHEN 0 THEN '1' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE '2' END",
    "sex_raw": (f"CASE WHEN {_K} % 9 = 0 THEN NULL WHEN {_K} % 9 = 1 THEN 'I' WHEN {_K} % 9 = 2 THEN ' ' "
                f"WHEN {_K} % 2 = 0 THEN 'F' ELSE 'M' END"),
    "age_raw": (f"CASE {_K} % 19 WHEN 0 THEN '' WHEN 1 THEN '4' WHEN 2 THEN 'x12' WHEN 3 THEN '3018' "
                f"WHEN 4 THEN '2010' WHEN 5 THEN '1005' WHEN 6 THEN '9001' "
                f"ELSE concat('4', lpad(CAST(o_custkey % 97 AS STRING), 3, '0')) END"),
    "race_raw": (f"CASE WHEN {_K} % 10 = 0 THEN NULL WHEN {_K} % 10 = 7 THEN '' "
                 f"ELSE CAST({_K} % 10 AS STRING) END"),
    "school_raw": f"CASE WHEN {_K} % 12 = 11 THEN NULL ELSE lpad(CAST({_K} % 12 AS STRING), 2, '0') END",
    "pregnant_raw": f"CASE WHEN {_K} % 8 = 7 THEN '' ELSE CAST({_K} % 8 AS STRING) END",
    "week_raw": (f"CASE WHEN {_K} % 29 = 0 THEN NULL WHEN {_K} % 31 = 0 THEN '' "
                 f"ELSE concat(CAST(year(o_orderdate) AS STRING), lpad(CAST({_K} % 56 AS STRING), 2, '0')) END"),
    "facility_raw": (f"CASE WHEN {_K} % 41 = 0 THEN NULL WHEN {_K} % 43 = 0 THEN ' ' "
                     f"ELSE concat('U-', CAST({_K} % 40 AS STRING)) END"),
    "fever": f"CASE {_K} % 3 WHEN 0 THEN '1' WHEN 1 THEN '2' ELSE ' 1 ' END",
    "headache": f"CASE {_K} % 5 WHEN 0 THEN '1' WHEN 1 THEN NULL WHEN 2 THEN 'S' ELSE '2' END",
    "myalgia": f"CASE {_K} % 4 WHEN 0 THEN '1' WHEN 1 THEN '' ELSE '2' END",
    "diabetes": f"CASE {_K} % 14 WHEN 0 THEN '1' WHEN 1 THEN NULL ELSE '2' END",
    "hypertension": f"CASE {_K} % 6 WHEN 0 THEN '1' WHEN 1 THEN '' ELSE '2' END",
    "renal": f"CASE {_K} % 25 WHEN 0 THEN '1' ELSE '2' END",
    "ns1_result": (f"CASE {_K} % 16 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '3' WHEN 3 THEN '4' "
                   f"WHEN 4 THEN '' ELSE NULL END"),
    "ns1_on": f"CASE WHEN {_K} % 16 IN (0, 1, 5) THEN {_D} + 2 ELSE NULL END",
    "pcr_result": f"CASE {_K} % 18 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '4' ELSE NULL END",
    "pcr_on": f"CASE WHEN {_K} % 18 IN (0, 7) THEN {_D} + 4 ELSE NULL END",
    "serotype_raw": f"CASE WHEN {_K} % 21 < 6 THEN CAST({_K} % 21 AS STRING) ELSE NULL END",
    "year_text": (f"CASE WHEN {_K} % 61 = 0 THEN 'abcd' WHEN {_K} % 71 = 0 THEN NULL "
                  f"ELSE CAST(year(o_orderdate) AS STRING) END"),
}

TERRITORY_COLUMNS: dict[str, str] = {
    "code7": f"concat({_CODE6}, '9')",
    "code6": _CODE6,
    "place_name": "n_name",
    "state_name": "CASE WHEN n_regionkey = 0 THEN 'RIO DE JANEIRO' ELSE r_name END",
    "region_name": "r_name",
    "rgi": "concat('RGI ', n_nationkey % 7)",
    "rgint": "concat('RGINT ', n_regionkey)",
    "population": ("CASE WHEN n_nationkey = 7 THEN 0 WHEN n_nationkey = 8 THEN NULL "
                   "ELSE 50000 + 1777 * n_nationkey END"),
    "area_km2": "100.5 + n_nationkey",
}

FACILITY_COLUMNS: dict[str, str] = {
    "facility_id": ("CASE WHEN s_suppkey % 3 = 0 THEN concat('000', CAST(s_suppkey % 30 AS STRING)) "
                    "ELSE CAST(s_suppkey % 30 AS STRING) END"),
    "trade_name": "CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE s_name END",
    "company_name": "CASE WHEN s_suppkey % 8 = 0 THEN NULL ELSE concat('Co ', s_name) END",
    "legal_name": "CASE WHEN s_suppkey % 16 = 0 THEN ' ' ELSE concat('Legal ', s_name) END",
}

# Focus municipality used by tests and registered queries.
FOCUS_PLACE = "NATION_0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _typed(exprs: dict[str, str]) -> list[str]:
    # population is BIGINT, area DOUBLE in both engines
    out = []
    for k, e in exprs.items():
        if k == "population":
            e = f"CAST({e} AS BIGINT)"
        elif k == "area_km2":
            e = f"CAST({e} AS DOUBLE)"
        out.append(f"{e} AS {k}")
    return out


def case_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The few source columns that the fact projection is made of, one row per
    order."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return (o.join(c, o.o_custkey == c.c_custkey)
             .join(broadcast_if_bounded(n), F.col("c_nationkey") == F.col("n_nationkey"))
             .drop("c_custkey", "c_nationkey"))


def cases_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact projection (one row per order), as a lazy plan over the
    driver tables."""
    return case_rows(spark, sf_dir).selectExpr(*_typed(CASES_COLUMNS))


# order of the fact's rows: clustered by (state, place code) inside the year; the
# id spreads rows that share all of them, also those without a date
CASES_ORDER = ("notified_year", "state_norm", "code6_norm", "notified_on", "case_id")
CASES_BYTES = 2 * 1024 * 1024         # source file bytes per task: its rows become 35 columns of text


def clustered_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact with its stored keys, range-partitioned and sorted by
    ``CASES_ORDER``.  Rows are sampled, shuffled and sorted as source columns with
    the order's keys; the wide projection is made after that, once per row."""
    from surv.operators.scope import with_stored_keys
    from surv.roles import FIXTURE_ROLES
    from surv.session import leaf_bytes
    rows = case_rows(spark, sf_dir)
    needed = {k: CASES_COLUMNS[k] for k in ("case_id", "notified_on", "place_raw", "state_raw", "class_raw")}
    keyed = with_stored_keys(rows.selectExpr("*", *_typed(needed)), FIXTURE_ROLES).withColumn("notified_year", F.year("notified_on"))
    narrow, size = keyed.select(*rows.columns, *CASES_ORDER), leaf_bytes(rows)
    parts = narrow.repartitionByRange(*CASES_ORDER) if size is None else narrow.repartitionByRange(-(-size // CASES_BYTES) or 1, *CASES_ORDER)
    placed = parts.sortWithinPartitions(*CASES_ORDER)
    return with_stored_keys(placed.selectExpr(*_typed(CASES_COLUMNS), "notified_year"), FIXTURE_ROLES)


_MATERIALIZED: dict[tuple, str] = {}
_LOCK = __import__("threading").RLock()


def source_key(spark: SparkSession, sf_dir: str) -> tuple:
    """Size and modification time of the fact's source tables, from whatever
    file system holds them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for t in ("orders", "customer", "nation"):
        p = jvm.org.apache.hadoop.fs.Path(os.path.join(sf_dir, f"{t}.parquet"))
        fs = p.getFileSystem(conf)
        sm = fs.getContentSummary(p)
        newest = max([st.getModificationTime() for st in fs.listStatus(p)], default=0)
        out.append((t, sm.getLength(), sm.getFileCount(), newest))
    return tuple(out)


def cases(spark: SparkSession, sf_dir: str, materialize: bool = True) -> DataFrame:
    """The conformed fact the panels read.

    Built once per session and source version as a Parquet table in the
    shared checkpoint folder (a lineage cut, like the reference's loaded fact
    table), partitioned by notification year and clustered by stored state and
    place code within it, so date windows prune directories and place filters
    skip row groups.
    ``materialize=False`` returns the lazy plan instead."""
    if not materialize:
        return cases_plan(spark, sf_dir)
    import hashlib
    import uuid
    from surv.session import checkpoint_dir
    key = (sf_dir, source_key(spark, sf_dir), "by-year-state-v3", hashlib.sha1(repr(sorted(CASES_COLUMNS.items())).encode()).hexdigest())
    with _LOCK:
        path = _MATERIALIZED.get(key)
        if path is None:
            digest = hashlib.sha1(repr(key).encode()).hexdigest()[:16]
            path = os.path.join(checkpoint_dir(spark).rstrip("/"), "facts", f"cases-{digest}")
            from surv.operators.cubes import path_exists
            if not path_exists(spark, path + "/_SUCCESS"):
                # write under a unique name, then rename into place: concurrent
                # builders (threads or processes) never write the same files,
                # and a half-written table is never visible
                tmp = f"{path}.tmp-{uuid.uuid4().hex}"
                with split_methods(spark):
                    clustered_cases(spark, sf_dir).write.mode("overwrite").partitionBy("notified_year").parquet(tmp)
                jvm = spark.sparkContext._jvm
                src, dst = jvm.org.apache.hadoop.fs.Path(tmp), jvm.org.apache.hadoop.fs.Path(path)
                fs = dst.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
                done = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
                if fs.exists(dst) and not fs.exists(done):
                    fs.delete(dst, True)      # leftover of a crashed writer
                if fs.exists(dst) or not fs.rename(src, dst):
                    fs.delete(src, True)      # another builder won: use its table
            _MATERIALIZED[key] = path
    return spark.read.parquet(path)


def territory(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return n.join(broadcast_if_bounded(r), n.n_regionkey == r.r_regionkey).selectExpr(*_typed(TERRITORY_COLUMNS))


def facility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(*_typed(FACILITY_COLUMNS))


def oracle_prelude() -> str:
    """DuckDB ``WITH`` clause defining the same three projections."""
    def body(exprs):
        return ",\n  ".join(_typed(exprs))
    return (
        "WITH cases AS (SELECT\n  " + body(CASES_COLUMNS) +
        "\nFROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),\n"
        "territory AS (SELECT\n  " + body(TERRITORY_COLUMNS) +
        "\nFROM nation JOIN region ON n_regionkey = r_regionkey),\n"
        "facility AS (SELECT\n  " + body(FACILITY_COLUMNS) + "\nFROM supplier)\n"
    )


# fixture column -> raw source field name of the notification extract
NATIVE_RAW_FIELDS = {
    "notified_on": "DT_NOTIFIC", "onset_on": "DT_SIN_PRI", "closed_on": "DT_ENCERRA",
    "place_raw": "MUNICIPIO", "state_raw": "SG_UF_NOT", "class_raw": "CLASSI_FIN",
    "outcome_raw": "EVOLUCAO", "hosp_raw": "HOSPITALIZ", "sex_raw": "CS_SEXO", "age_raw": "NU_IDADE_N",
    "race_raw": "CS_RACA", "school_raw": "CS_ESCOL_N", "pregnant_raw": "CS_GESTANT", "week_raw": "SEM_NOT",
    "facility_raw": "ID_UNIDADE", "fever": "FEBRE", "headache": "CEFALEIA", "myalgia": "MIALGIA",
    "diabetes": "DIABETES", "hypertension": "HIPERTENSA", "renal": "RENAL", "ns1_result": "RESUL_NS1",
    "ns1_on": "DT_NS1", "pcr_result": "RESUL_PCR_", "pcr_on": "DT_PCR", "serotype_raw": "SOROTIPO",
    "year_text": "NU_ANO",
}


def native_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact projection re-shaped as a raw notification extract: every
    field as text under its upper-case source name (dates as ISO text), as
    the JSON/CSV/XML readers deliver it."""
    f = cases(spark, sf_dir)
    cols = []
    for src, raw in NATIVE_RAW_FIELDS.items():
        c = F.col(src)
        if dict(f.dtypes)[src] == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.cast("string").alias(raw))
    return f.select(*cols)
