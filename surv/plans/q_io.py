"""Registered source/sink round trips (2A) and window replacement.

Each query writes driver-table rows to a fresh folder under the shared
checkpoint location with Spark, reads them back with the engine's readers
and returns the result; the oracle is the same rows from DuckDB (as text
where the format carries text)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from surv.operators import conform as B
from surv.plans import fixtures as FX
from surv.plans.registry import register
from surv.sources import readers as R
from surv.sources import writers as W
from surv.sources.published import read_table
from surv.streaming import incremental as INC

_CUST = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def _text_sql(table: str, cols) -> str:
    return "SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in cols) + f" FROM {table}"


@register("a01_a07_csv_round_trip", _text_sql("customer", _CUST), raw_sql=True)
def a01(spark, sf):
    p = W.staging_path(spark, "a01-csv")
    FX.table(spark, sf, "customer").select(*_CUST).write.option("header", True).csv(p)
    return R.read_source(spark, "csv", p)


@register("a02_csv_dialect_fallback", _text_sql("nation", ("n_nationkey", "n_name", "n_regionkey")), raw_sql=True)
def a02(spark, sf):
    p = W.staging_path(spark, "a02-csv")
    (FX.table(spark, sf, "nation").write.option("header", True).option("sep", ";")
     .option("encoding", "iso-8859-1").csv(p))
    return R.read_csv_dialect(spark, p, ["n_nationkey"])


@register("a03_a07_json_round_trip", """
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders""",
          raw_sql=True)
def a03(spark, sf):
    p = W.staging_path(spark, "a03-json")
    FX.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority") \
        .write.json(p)
    return R.read_source(spark, "json", p, multiline=False).select("o_orderkey", "o_orderstatus", "o_totalprice",
                                                                   "o_orderpriority")


@register("a06_a07_xml_round_trip", _text_sql("supplier", ("s_suppkey", "s_name", "s_nationkey")), raw_sql=True)
def a06(spark, sf):
    p = W.staging_path(spark, "a06-xml")
    (FX.table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
     .write.format("xml").option("rowTag", "s").option("rootTag", "suppliers").save(p))
    return R.read_source(spark, "xml", p, row_tag="s").select("s_suppkey", "s_name", "s_nationkey")


@register("a10_year_range_pruned", """
SELECT o_orderkey, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders
WHERE year(o_orderdate) BETWEEN 1996 AND 1997""", raw_sql=True)
def a10(spark, sf):
    p = W.staging_path(spark, "a10-years")
    (FX.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year"))
     .write.partitionBy("year").parquet(p))
    return R.read_year_range(spark, p, 1996, 1997).select("o_orderkey", "o_totalprice", "year")


@register("a09_latest_snapshot", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(c_acctbal + 1 AS VARCHAR) AS c_acctbal,
       CAST(202402 AS INTEGER) AS period FROM customer""", raw_sql=True)
def a09(spark, sf):
    p = W.staging_path(spark, "a09-snap")
    cu = FX.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    cu.withColumn("period", F.lit("202401")).write.partitionBy("period").option("header", True).csv(p)
    (cu.withColumn("c_acctbal", F.col("c_acctbal") + 1).withColumn("period", F.lit("202402"))
     .write.mode("append").partitionBy("period").option("header", True).csv(p))
    return R.latest_snapshot(spark, p)


_WIN_SQL = """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(year(o_orderdate) AS INTEGER) AS year,
  CASE WHEN CAST(o_orderdate AS DATE) >= DATE '1998-01-01' AND o_orderstatus <> 'F' THEN o_totalprice + 1
       ELSE o_totalprice END AS price
FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '1998-01-01' OR o_orderstatus <> 'F'"""


@register("a13_window_replace", _WIN_SQL, raw_sql=True)
def a13(spark, sf):
    """Load all orders, then re-deliver the window from 1998-01-01 with new
    prices and without the orders of status 'F' (withdrawn in the new
    extract): the window is replaced, everything before it is kept."""
    t = W.staging_path(spark, "a13-table")
    o = FX.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"),
                                             F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("price"),
                                             "o_orderstatus")
    INC.replace_date_window(spark, o.drop("o_orderstatus"), t, "d", "1900-01-01")
    new = o.filter((F.col("d") >= "1998-01-01") & (F.col("o_orderstatus") != "F")) \
           .withColumn("price", F.col("price") + 1).drop("o_orderstatus")
    INC.replace_date_window(spark, new, t, "d", "1998-01-01")
    return read_table(spark, t).select("o_orderkey", "d", "year", "price")


@register("j07_reload_years", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year,
  CASE WHEN year(o_orderdate) = 1997 THEN o_totalprice * 2 ELSE o_totalprice END AS price
FROM orders WHERE year(o_orderdate) <> 1997 OR o_orderpriority IN ('1-URGENT', '2-HIGH')""", raw_sql=True)
def j07(spark, sf):
    """Load every year, then reload 1997 from a corrected extract (urgent and
    high-priority orders only, doubled prices): only that year's partition
    changes."""
    t = W.staging_path(spark, "j07-table")
    o = FX.table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"),
                                             F.col("o_totalprice").alias("price"), "o_orderpriority")
    INC.reload_years(spark, o.drop("o_orderpriority"), t)
    fix = (o.filter((F.col("year") == 1997) & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
            .withColumn("price", F.col("price") * 2).drop("o_orderpriority"))
    INC.reload_years(spark, fix, t)
    return read_table(spark, t).select("o_orderkey", "year", "price")


@register("a19_year_from_file_name", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS source_year, COUNT(*) AS n FROM orders GROUP BY 1""", raw_sql=True)
def a19(spark, sf):
    """Orders written as one folder per year named like a portal resource
    ('dengue-<year>'); the year comes back from each row's file path."""
    base = W.staging_path(spark, "a19-files")
    o = FX.table(spark, sf, "orders").select("o_orderkey",
                                             F.concat(F.lit("dengue-"), F.year("o_orderdate")).alias("resource"))
    o.write.partitionBy("resource").parquet(base)          # folders resource=dengue-<year>
    back = R.with_source_file(spark.read.parquet(base).drop("resource"))
    return (back.groupBy(R.year_from_name(F.col("source_file")).alias("source_year"))
            .agg(F.count(F.lit(1)).alias("n")))


@register("a08_raw_snapshot", "SELECT * FROM nation", raw_sql=True)
def a08(spark, sf):
    """A raw batch persisted under <base>/<kind>/<name>_<timestamp> and read back."""
    base = W.staging_path(spark, "a08-raw")
    path = W.save_raw_snapshot(FX.table(spark, sf, "nation"), base, "json", "nation")
    return spark.read.parquet(path)


@register("a11_write_modes", "SELECT * FROM region UNION ALL SELECT * FROM region UNION ALL SELECT * FROM region",
          raw_sql=True)
def a11(spark, sf):
    """append twice on top of an initial replace; an empty frame is a no-op."""
    t = W.staging_path(spark, "a11-table")
    r = FX.table(spark, sf, "region")
    W.write_table(r, t, if_exists="replace")
    W.write_table(r, t, if_exists="append")
    W.write_table(r.limit(0), t, if_exists="append")
    W.write_table(r, t, if_exists="append")
    return spark.read.parquet(t)


@register("a12_a14_truncate_and_load", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'", raw_sql=True)
def a12(spark, sf):
    """Full refresh of a table from a subset: the earlier rows are gone,
    the path was never read and written by the same job."""
    t = W.staging_path(spark, "a12-table")
    cu = FX.table(spark, sf, "customer")
    W.refresh_dimension(spark, cu, t)
    W.refresh_dimension(spark, cu.filter(F.col("c_mktsegment") == "BUILDING"), t)
    return read_table(spark, t)


# ---- loads that must not lose rows -------------------------------------------------------
@register("a13_null_partition_kept", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d FROM orders
WHERE o_orderkey % 5 = 0 OR CAST(o_orderdate AS DATE) < DATE '1998-01-01' OR o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey + 100000000, NULL FROM orders WHERE o_orderstatus = 'P'""", raw_sql=True)
def a13_null(spark, sf):
    """A fifth of the rows has no date and so no partition value.  A window
    replacement whose delivery also has such rows keeps the old ones."""
    t = W.staging_path(spark, "a13-null")
    day = F.when(F.col("o_orderkey") % 5 != 0, F.to_date("o_orderdate"))
    o = FX.table(spark, sf, "orders").select("o_orderkey", day.alias("d"), F.year(day).alias("year"), "o_orderstatus")
    INC.replace_date_window(spark, o.drop("o_orderstatus"), t, "d", "1900-01-01")
    undated = (o.filter("o_orderstatus = 'P'").select((F.col("o_orderkey") + 100_000_000).alias("o_orderkey"),
                                                       F.lit(None).cast("date").alias("d"), F.lit(None).cast("int").alias("year")))
    new = o.filter((F.col("d") >= "1998-01-01") & (F.col("o_orderkey") % 2 == 0)).drop("o_orderstatus").unionByName(undated)
    INC.replace_date_window(spark, new, t, "d", "1998-01-01")
    return read_table(spark, t).select("o_orderkey", "d")


LANDED_ROWS = 250_000        # rows of one landed file: a delivery is as many files as it takes


@register("j03_late_file_keeps_newer", """
SELECT event_id, CAST(ts AS DATE) AS d, CASE WHEN CAST(ts AS DATE) = (SELECT min(CAST(ts AS DATE)) + 1 FROM events) THEN 'late' ELSE event_type END AS kind
FROM events""", raw_sql=True)
def j03(spark, sf):
    """All events arrive; later a file re-delivers the second day only.  That
    day is replaced, the newer days stay."""
    import uuid
    from surv.streaming.stream import stream_window_replace
    base = W.staging_path(spark, "j03")
    ev = FX.table(spark, sf, "events").select("event_id", F.to_date("ts").alias("d"), F.year("ts").alias("year"), F.col("event_type").alias("kind"))
    second = ev.select(F.date_add(F.min("d"), 1)).scalar()
    name = f"j03-{uuid.uuid4().hex}"
    for k, batch in enumerate((ev, ev.filter(F.col("d") == second).withColumn("kind", F.lit("late")))):
        batch.write.option("maxRecordsPerFile", LANDED_ROWS).parquet(f"{base}/land/{k}")
        stream_window_replace(spark, f"{base}/land/*", ev.schema, f"{base}/table", "d", name=name)
    return read_table(spark, f"{base}/table").select("event_id", "d", "kind")


@register("j07_backfill_two_files_per_year", """
SELECT year(CAST(o_orderdate AS DATE)) AS year, COUNT(*) AS n, 'OK_FULL' AS status FROM orders GROUP BY 1""", raw_sql=True)
def j07_two_files(spark, sf):
    """Each year comes as two extracts; both are in the table after the
    backfill, and the reconciliation has one row per year."""
    from surv.plans.jobs import backfill_years
    base = W.staging_path(spark, "j07-two")
    o = FX.table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("DT_NOTIFIC"), F.lit("330001").alias("MUNICIPIO"), F.lit("1").alias("CLASSI_FIN"),
        F.year("o_orderdate").cast("string").alias("NU_ANO"), F.year("o_orderdate").alias("year"), (F.col("o_orderkey") % 2).alias("half"))
    o.write.partitionBy("year", "half").json(f"{base}/in")
    years = sorted(int(y) for y in W.partition_dirs(spark, f"{base}/in", "year"))
    out = backfill_years(spark, [(y, f"{base}/in/year={y}/half={h}") for y in years for h in (0, 1)], "json", f"{base}/wh", multiline=False)
    rec = out["reconciliation"].filter("loaded_rows IS NOT NULL")
    n = spark.read.parquet(f"{base}/wh/fact").groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    return n.join(rec.select("year", "status"), "year").select(F.col("year").cast("bigint").alias("year"), "n", "status")


@register("a04_schema_drift", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) END AS "j.k",
  CASE WHEN event_id % 7 = 1 AND event_id % 3 <> 0 THEN event_type END AS "j.late" FROM events""", raw_sql=True)
def a04_drift(spark, sf):
    """Fields that only some rows have: the schema comes from all of them."""
    ev = FX.table(spark, sf, "events")
    text = (F.when(F.col("event_id") % 3 == 0, F.col("props"))
             .when(F.col("event_id") % 7 == 1, F.to_json(F.struct(F.col("event_type").alias("late")))))
    return R.parse_json_column(ev.select("event_id", text.alias("j")), "j").select("event_id", F.col("`j.k`"), F.col("`j.late`"))


@register("a16_log_file_encodings", """
SELECT 2000 + CAST(year(o_orderdate) % 100 AS INTEGER) AS year, COUNT(*) AS loaded_rows FROM orders GROUP BY 1""", raw_sql=True)
def a16_files(spark, sf):
    """One log per year, UTF-16 with its mark for even years, UTF-8 for odd
    ones; the last line of a file counts."""
    base = W.staging_path(spark, "a16-logs")
    per = FX.table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    said = lambda n: F.format_string("Arquivo concluido: %d linhas carregadas (DENGBR%02d.json)", n, F.col("y") % 100)
    lines = per.select("y", F.posexplode(F.array(F.lit("Início"), said(F.col("n") - 1), said(F.col("n")))).alias("k", "value"))
    for rest, enc in ((0, "UTF-16"), (1, "UTF-8")):
        (lines.filter(F.col("y") % 2 == rest).repartition("y").sortWithinPartitions("y", "k").drop("k")
         .write.partitionBy("y").option("encoding", enc).csv(f"{base}/{enc}"))
    return R.read_load_log(spark, f"{base}/*/y=*/part-*")


@register("b24_facility_dimension", """
SELECT lpad(CAST(s_suppkey % 50 AS VARCHAR), 7, '0') AS cnes, min(s_name) AS nome_fantasia FROM supplier GROUP BY 1""", raw_sql=True)
def b24(spark, sf):
    """A facility file with repeated ids (unpadded and padded), read back from
    CSV: the first row of the file per id stays."""
    p = W.staging_path(spark, "b24-file")
    s = FX.table(spark, sf, "supplier").select(
        F.when(F.col("s_suppkey") % 2 == 0, F.lpad((F.col("s_suppkey") % 50).cast("string"), 7, "0")).otherwise((F.col("s_suppkey") % 50).cast("string")).alias("CO_CNES"),
        F.concat(F.lit("  "), "s_name").alias("NO_FANTASIA"))
    s.coalesce(1).sortWithinPartitions("NO_FANTASIA").write.option("header", True).option("sep", ";").option("ignoreLeadingWhiteSpace", False).csv(p)
    dim = B.conform_facilities(R.with_file_order(R.read_csv_dialect(spark, p, B.FACILITY_ALIASES["cnes"])))
    return dim.select("cnes", "nome_fantasia")


# ---- names and cleaning on the driver tables ----------------------------------------------
@register("b02_b03_b04_b08_names_and_case", """
SELECT c_custkey AS id, upper(c_name) AS nome_do_cliente, c_name AS nome_do_cliente_1, c_mktsegment AS segmento FROM customer""", raw_sql=True)
def b02(spark, sf):
    cu = FX.table(spark, sf, "customer").select("c_custkey", "c_name", "c_name", "c_mktsegment").toDF("Chave", "Nome do Cliente", " nome  do-cliente ", "Ségmento")
    d = B.rename(B.ascii_names(B.normalize_names(cu)), {"chave": "id", "absent": "x"})
    return d.withColumn("nome_do_cliente", F.upper("nome_do_cliente"))


@register("a05_envelope_records", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation", raw_sql=True)
def a05(spark, sf):
    """Records inside a ``parametros`` array, as the portal wraps them."""
    p = W.staging_path(spark, "a05-json")
    n = FX.table(spark, sf, "nation").select(F.struct("n_nationkey", "n_name").alias("r"), "n_regionkey")
    n.groupBy("n_regionkey").agg(F.collect_list("r").alias("parametros")).drop("n_regionkey").write.json(p)
    return R.json_records(spark.read.json(p))


DOCUMENT_BYTES = 256 * 1024 * 1024        # of rows in one document, about: two blocks of the reader or more


def _documents(spark, path, rows, head: str, tail: str, document_bytes: int = DOCUMENT_BYTES, before: str = ", ", sep: str = " ") -> str:
    """``rows`` (id, text) as JSON or XML documents of one file each, ``before`` ahead of
    every row and ``sep`` after it, in the order of the ids: one document up to
    ``document_bytes``, then as many as hold the rows, since a file is written by one task."""
    key, text = rows.columns
    size = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0

    def frame(batches):
        yield pa.RecordBatch.from_pydict({"value": [head]})
        for b in batches:
            yield b.select(["value"])
        yield pa.RecordBatch.from_pydict({"value": [tail]})

    lines = rows.select(key, F.concat(F.lit(before), text).alias("value")).repartitionByRange(-(-size // document_bytes) or 1, key).sortWithinPartitions(key)
    lines.mapInArrow(lambda batches: frame(batches), "value string").write.option("lineSep", sep).text(path)
    return path


@register("a03_a05_split_array_document", """
SELECT doc_id AS id, coalesce(text, '') || '"} ]{ \\ "parametros":[' AS t, lang FROM documents""", raw_sql=True)
def a05_array(spark, sf):
    """All documents as arrays in files without line ends, one array up to
    ``DOCUMENT_BYTES``; quotes, braces and backslashes in every text."""
    d = FX.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(F.coalesce("text", F.lit("")), F.lit('"} ]{ \\ "parametros":[')).alias("t"), "lang")
    p = _documents(spark, W.staging_path(spark, "a05-array"), d.select("id", F.to_json(F.struct("id", "t", "lang")).alias("json")), '[ 1', ', "}{"]')
    return R.read_json_records(spark, p, schema="id bigint, t string, lang string")


@register("a05_split_envelope_document", "SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderstatus AS s, 0 AS n FROM orders", raw_sql=True)
def a05_envelope(spark, sf):
    """All orders inside the envelope of a document (of several beyond
    ``DOCUMENT_BYTES``), between other keys that hold arrays of objects too."""
    o = FX.table(spark, sf, "orders").select(F.col("o_orderkey").cast("bigint").alias("id"), F.col("o_orderstatus").alias("s"))
    js = F.to_json(F.struct("id", "s", F.array(F.struct(F.lit("]}").alias("x"))).alias("l")))
    p = _documents(spark, W.staging_path(spark, "a05-envelope"), o.select("id", js.alias("json")),
                      '{"meta": [{"id": 0}], "parametros" : [ null', '], "after": {"parametros": [{"id": 5}]}}')
    return R.read_json_records(spark, p).select("id", "s", F.lit(0).alias("n"))


@register("a15_report_with_mark", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation", raw_sql=True)
def a15(spark, sf):
    """A report written with its byte-order mark; the CSV reader takes it off."""
    p = W.staging_path(spark, "a15-report")
    W.write_report_csv(FX.table(spark, sf, "nation").select("n_nationkey", "n_name"), p)
    d = R.read_csv(spark, p)
    return d.toDF(*[c.lstrip("\ufeff") for c in d.columns])


@register("j01_j02_j05_marks", """
SELECT 'p' || CAST(c_custkey % 7 AS VARCHAR) AS pipeline, CAST(c_custkey AS VARCHAR) AS source,
  CASE WHEN c_custkey % 3 = 0 AND c_custkey % 4 <> 0 THEN DATE '2024-03-01' WHEN c_custkey % 2 = 0 THEN DATE '2024-01-10' END AS last_success_date
FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""", raw_sql=True)
def j05(spark, sf):
    """Marks of many sources: a successful run with a date moves the mark, a
    failed or empty one keeps it."""
    cu = FX.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("p"), F.col("c_custkey") % 7).alias("pipeline"), F.col("c_custkey").cast("string").alias("source"))
    ts = F.lit("2024-03-02 00:00:00").cast("timestamp")
    state = cu.filter("c_custkey % 2 = 0").select("pipeline", "source", F.lit("2024-01-10").cast("date").alias("last_success_date"), ts.alias("updated_at"))
    upd = cu.filter("c_custkey % 3 = 0").select("pipeline", "source", F.when(F.col("c_custkey") % 4 == 0, INC.RUN_FAILED).otherwise(INC.RUN_SUCCESS).alias("status"),
                                                F.lit("2024-03-01").cast("date").alias("last_success_date"), ts.alias("updated_at"))
    return INC.upsert_mark(state, upd).select("pipeline", "source", "last_success_date")


@register("j06_historical_batches", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, COUNT(*) AS n FROM orders GROUP BY 1", raw_sql=True)
def j06(spark, sf):
    """The whole history in batches of three years on top of stale data."""
    t = W.staging_path(spark, "j06-table")
    o = FX.table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    INC.historical_load(spark, [o.limit(5)], t)
    lo, hi = o.agg(F.min("year"), F.max("year")).first()
    INC.historical_load_years(spark, lambda a, b: o.filter(F.col("year").between(a, b)), t, lo, hi)
    return read_table(spark, t).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@register("a06_xml_nodes_by_path", """
SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status FROM orders WHERE o_orderkey % 3 <> 0""", raw_sql=True)
def a06_path(spark, sf):
    """Orders two levels deep in a name space, in documents that bind it to
    different prefixes (several of each beyond ``DOCUMENT_BYTES``), between elements
    of the same local name that are not meant."""
    p = W.staging_path(spark, "a06-path")
    o = FX.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    pre = F.when(F.col("o_orderkey") % 2 == 0, F.lit("a")).otherwise(F.lit("bb"))
    ours = F.concat(F.lit("<"), pre, F.lit(":row><id> "), F.col("o_orderkey"), F.lit(" </id><status>"), F.col("o_orderstatus"), F.lit("</status></"), pre, F.lit(":row>"))
    other = F.concat(F.lit("<row><id>"), F.col("o_orderkey"), F.lit("</id></row>"))
    rows = o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, ours).otherwise(other).alias("x"), pre.alias("p")).where("x IS NOT NULL")
    files = [_documents(spark, f"{p}/{k}", rows.where(F.col("p") == k).select("o_orderkey", "x"), f'<root xmlns:{k}="urn:orders"><list>', "</list></root>",
                        DOCUMENT_BYTES, before="", sep="\n") for k in ("a", "bb")]
    return R.read_xml_nodes(spark, files, "//o:row", {"o": "urn:orders"}).select("id", "status")
