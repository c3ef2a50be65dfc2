"""Registered queries for scalar functions, filters, sources, set operations,
table diffs, reconciliation and the streaming extension (2A-2D, 2H-2J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from surv.functions import codes as K
from surv.functions import expr as X
from surv.operators import conform as B
from surv.operators import counts as C
from surv.operators import quality as Q
from surv.operators import scope as S
from surv.plans import fixtures as FX
from surv.plans.registry import AGE, BAND, CLASS_GROUP, CODE6, FACILITY_KEY, MONTH, NI, WEEK, YEAR, ctx, register
from surv.sources import readers as R
from surv.sources import writers as W
from surv.sources.writers import staging_path
from surv.streaming import incremental as INC


# ---- 2I scalar functions (row level over the whole fact) -----------------------------
@register("i01_i02_i03_i04_i16_i17_date_parts_and_codes", f"""
SELECT case_id, {YEAR('notified_on')} AS year, CAST(month(notified_on) AS INTEGER) AS month,
  {MONTH('notified_on')} AS month_start, {NI('state_raw')} AS state, ({CODE6('place_raw')}) AS code6,
  CAST(notified_on - INTERVAL 3 MONTH AS DATE) AS minus_3_months,
  CAST(date_diff('day', onset_on, notified_on) AS INTEGER) AS onset_days
FROM cases""")
def i01(spark, sf):
    c = ctx(spark, sf)
    d = c.r.c("notified_on")
    return c.f.select("case_id", X.year_of(d).alias("year"), X.month_of(d).alias("month"),
                      X.month_start(d).alias("month_start"), X.ni(c.r.c("state_raw")).alias("state"),
                      X.place_code6(c.r.c("place_raw")).alias("code6"),
                      X.shift_months(d, -3).alias("minus_3_months"),
                      X.days_between(d, c.r.c("onset_on")).alias("onset_days"))


@register("i05_i06_i07_facility_key_and_week", f"""
SELECT case_id, {FACILITY_KEY('facility_raw')} AS facility_key, {WEEK('week_raw')} AS epi_week,
  COALESCE(NULLIF(trim(facility_raw), ''), NULLIF(trim(place_raw), ''), '') AS first_name
FROM cases""")
def i05(spark, sf):
    c = ctx(spark, sf)
    return c.f.select("case_id", X.facility_key(c.r.c("facility_raw")).alias("facility_key"),
                      X.epi_week(c.r.c("week_raw")).alias("epi_week"),
                      X.first_nonblank(c.r.c("facility_raw"), c.r.c("place_raw"), default="").alias("first_name"))


@register("i08_i09_i10_i11_age_and_flags", f"""
, coded AS (SELECT case_id, {AGE('age_raw')} AS age, {NI('outcome_raw')} AS outcome, {NI('hosp_raw')} AS hosp, {NI('headache')} AS head FROM cases)
SELECT case_id, age, {BAND('age')} AS age_band, list_contains(['2', '3', '4'], outcome) OR contains(upper(outcome), 'OBITO') AS death,
  hosp = '1' AS hospitalised, list_contains(['1', 'S', 'SIM'], head) AS headache_yes FROM coded""")
def i08(spark, sf):
    c = ctx(spark, sf)
    age = X.age_years(c.r.c("age_raw"))
    return c.f.select("case_id", age.alias("age"), X.age_band(age).alias("age_band"),
                      X.death_flag(c.r.c("outcome_raw")).alias("death"),
                      X.yes_flag(c.r.c("hosp_raw")).alias("hospitalised"),
                      X.yes_flag(F.col("headache"), K.YES_SYMPTOM).alias("headache_yes"))


@register("i12_i13_class_group_and_exam", f"""
SELECT case_id,
  {CLASS_GROUP("CAST(CAST(trunc(COALESCE(TRY_CAST(trim(class_raw) AS DOUBLE), -1)) AS BIGINT) AS VARCHAR)")} AS group_numeric,
  {CLASS_GROUP('trim(class_raw)')} AS group_text,
  CASE WHEN (trim(ns1_result) = '1' OR trim(pcr_result) = '1') IS TRUE THEN 'Positivo'
   WHEN (trim(ns1_result) = '2' OR trim(pcr_result) = '2') IS TRUE THEN 'Negativo'
   WHEN (trim(ns1_result) = '3' OR trim(pcr_result) = '3') IS TRUE THEN 'Inconclusivo'
   WHEN ns1_on IS NOT NULL OR pcr_on IS NOT NULL THEN 'Com coleta (sem resultado)' ELSE 'Sem exame' END AS exam_result
FROM cases""")
def i12(spark, sf):
    c = ctx(spark, sf)
    return c.f.select("case_id", X.class_group(c.r.c("class_raw"), True).alias("group_numeric"),
                      X.class_group(c.r.c("class_raw"), False).alias("group_text"),
                      X.exam_overall([F.col("ns1_result"), F.col("pcr_result")],
                                     [F.col("ns1_on"), F.col("pcr_on")]).alias("exam_result"))


def _decode_sql(col: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    t = f"trim({col})"
    return (f"CASE WHEN {t} IS NULL OR {t} = '' OR {t} = 'NI' THEN 'Nao informado' "
            f"ELSE COALESCE(CASE {t} {whens} END, 'Codigo ' || {t}) END")


def _self_sql(col: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"COALESCE(CASE trim({col}) {whens} END, trim({col}))"


@register("i21_i22_i23_decoders", f"""
SELECT case_id, {_decode_sql('class_raw', K.CLASSIFICATION_LABELS)} AS class_label,
  {_decode_sql('outcome_raw', K.OUTCOME_LABELS)} AS outcome_label,
  {_self_sql('pregnant_raw', K.PREGNANCY_TEXT)} AS pregnancy_text,
  {_self_sql('race_raw', K.RACE_TEXT)} AS race_text,
  CASE WHEN length(regexp_replace(trim(age_raw), '[^0-9]', '', 'g')) >= 2
    THEN concat_ws(' ', CAST(CAST(COALESCE(NULLIF(substring(regexp_replace(trim(age_raw), '[^0-9]', '', 'g'), 2), ''), '0')
                                AS DECIMAL(38, 0)) AS VARCHAR),
                   COALESCE(CASE substring(regexp_replace(trim(age_raw), '[^0-9]', '', 'g'), 1, 1)
                     {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in K.AGE_UNIT_LABELS.items())} END, 'unidade'))
    ELSE trim(age_raw) END AS age_text,
  COALESCE(CASE CASE WHEN regexp_replace(trim(school_raw), '[^0-9]', '', 'g') <> ''
      THEN regexp_replace(trim(school_raw), '[^0-9]', '', 'g') ELSE trim(school_raw) END
    {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in K.SCHOOL_TEXT.items())} END, trim(school_raw)) AS school_text
FROM cases""")
def i21(spark, sf):
    c = ctx(spark, sf)
    r = c.r
    return c.f.select("case_id", X.decode_classification(r.c("class_raw")).alias("class_label"),
                      X.decode_outcome(r.c("outcome_raw")).alias("outcome_label"),
                      X.label_or_self(r.c("pregnant_raw"), K.PREGNANCY_TEXT).alias("pregnancy_text"),
                      X.label_or_self(r.c("race_raw"), K.RACE_TEXT).alias("race_text"),
                      X.age_display(r.c("age_raw")).alias("age_text"),
                      X.school_display(r.c("school_raw")).alias("school_text"))


_MONTHS = " ".join(f"WHEN {i + 1} THEN '{m}'" for i, m in enumerate(K.MONTH_NAMES_PT))


@register("i19_i20_i24_i25_i26_labels_and_widths", f"""
SELECT case_id, (CASE month(notified_on) {_MONTHS} END) || '/' || CAST(year(notified_on) AS VARCHAR) AS month_label,
  concat_ws(' + ', CASE WHEN trim(fever) = '1' THEN 'fever' END, CASE WHEN trim(headache) = '1' THEN 'headache' END)
    AS labels,
  substring(place_raw, 1, 4) AS place_4,
  CASE WHEN CAST(closed_on AS DATE) IS NULL THEN NULL ELSE upper(trim(state_raw)) = 'RJ' END AS state_rj,
  starts_with(place_raw, '0330') AS place_prefix
FROM cases""")
def i24(spark, sf):
    c = ctx(spark, sf)
    r = c.r
    return c.f.select("case_id", X.month_label(r.c("notified_on")).alias("month_label"),
                      X.join_labels([(F.trim("fever") == "1", "fever"), (F.trim("headache") == "1", "headache")])
                      .alias("labels"),
                      X.cut(r.c("place_raw"), 4).alias("place_4"),
                      F.when(r.c("closed_on").isNotNull(), X.ci_equals(F.trim(r.c("state_raw")), "rj")).alias("state_rj"),
                      X.starts_with(r.c("place_raw"), "0330").alias("place_prefix"))


@register("i14_i15_i18_ratios_and_rounding", """
, m AS (SELECT CAST(date_trunc('month', notified_on) AS DATE) AS month_start, COUNT(*) AS n,
   COUNT(*) FILTER (WHERE trim(outcome_raw) = '2') AS d FROM cases WHERE notified_on IS NOT NULL GROUP BY 1)
SELECT month_start, CASE WHEN n > 0 THEN CAST(d AS DOUBLE) / CAST(n AS DOUBLE) * 100.0 END AS lethality_pct,
  CAST(COALESCE(round_even(CAST(d AS DOUBLE) / 2.0, 0), 0) AS BIGINT) AS half_even,
  CAST(round(CAST(d AS DOUBLE) / 2.0, 0) AS INTEGER) AS half_up,
  CASE WHEN n IS NOT NULL AND n <> 0 THEN (CAST(d AS DOUBLE) - CAST(n AS DOUBLE)) / CAST(n AS DOUBLE) * 100.0 END
    AS delta_pct
FROM m""")
def i14(spark, sf):
    c = ctx(spark, sf)
    m = (S.notified(c.f, c.r).groupBy(X.month_start("notified_on").alias("month_start"))
         .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.trim("outcome_raw") == "2").alias("d")))
    return m.select("month_start", X.guarded_ratio("d", "n", 100).alias("lethality_pct"),
                    X.round_half_even_int(F.col("d") / 2.0).alias("half_even"),
                    X.round_half_up_int(F.col("d") / 2.0).alias("half_up"),
                    X.pct_delta("d", "n").alias("delta_pct"))


# ---- 2C filters --------------------------------------------------------------------------------
@register("c05_c10_state_mask_month_filter", f"""
SELECT {MONTH('notified_on')} AS month_start, COUNT(*) AS cases FROM cases
WHERE upper(trim(state_raw)) IN ('RJ', '33') AND month(notified_on) IN (1, 2, 12) GROUP BY 1""")
def c05(spark, sf):
    c = ctx(spark, sf)
    g = c.f.filter(S.state_mask(c.r.c("state_raw")))
    m = g.groupBy(X.month_start("notified_on").alias("month_start")).agg(F.count(F.lit(1)).alias("cases"))
    return S.month_filter(m, [1, 2, 12])


@register("c09_c11_year_list_last_months", f"""
, m AS (SELECT {YEAR('notified_on')} AS year, {MONTH('notified_on')} AS month_start, COUNT(*) AS cases
        FROM cases WHERE notified_on IS NOT NULL GROUP BY 1, 2),
y AS (SELECT * FROM m WHERE year IN (1996, 1997, 1998))
SELECT * FROM y WHERE month_start >= CAST((SELECT max(month_start) FROM y) - INTERVAL 5 MONTH AS DATE)""")
def c09(spark, sf):
    c = ctx(spark, sf)
    m = C.cases_month_state(c.f, c.r).groupBy("year", "month_start").agg(F.sum("cases").cast("bigint").alias("cases"))
    return S.last_months_window(S.year_filter(m, [1996, 1997, 1998]), 6)


@register("c11_year_to_date", f"""
, m AS (SELECT {MONTH('notified_on')} AS month_start, COUNT(*) AS cases FROM cases WHERE notified_on IS NOT NULL GROUP BY 1)
SELECT * FROM m WHERE year(month_start) = year((SELECT max(month_start) FROM m))""")
def c11(spark, sf):
    c = ctx(spark, sf)
    m = (S.notified(c.f, c.r).groupBy(X.month_start("notified_on").alias("month_start"))
         .agg(F.count(F.lit(1)).alias("cases")))
    return S.last_months_window(m, None)


@register("c13_since_valid_text_date", """
SELECT COUNT(*) AS cases FROM cases WHERE TRY_CAST(CAST(onset_on AS VARCHAR) AS DATE) >= DATE '1998-06-01'""")
def c13(spark, sf):
    c = ctx(spark, sf)
    return C.total_rows(S.since_valid(c.f, "onset_on", "1998-06-01")).withColumnRenamed("total", "cases")


@register("c16_duration_bounds", """
SELECT COUNT(*) FILTER (WHERE date_diff('day', onset_on, notified_on) BETWEEN 0 AND 180) AS onset_ok,
       COUNT(*) FILTER (WHERE date_diff('day', notified_on, closed_on) BETWEEN 0 AND 365) AS closure_ok FROM cases""")
def c16(spark, sf):
    c = ctx(spark, sf)
    return c.f.agg(F.count_if(X.days_between("notified_on", "onset_on").between(0, 180)).alias("onset_ok"),
                   F.count_if(X.days_between("closed_on", "notified_on").between(0, 365)).alias("closure_ok"))


# ---- 2B conform projections on driver tables ------------------------------------------------------
@register("b20_digits_or_null", """
, x AS (SELECT CASE WHEN trim(place_raw) IN ('', '.', 'nan', 'None') THEN NULL ELSE
   CASE WHEN length(NULLIF(regexp_replace(trim(place_raw), '\\D+', '', 'g'), '')) < 7
        THEN lpad(NULLIF(regexp_replace(trim(place_raw), '\\D+', '', 'g'), ''), 7, '0')
        ELSE NULLIF(regexp_replace(trim(place_raw), '\\D+', '', 'g'), '') END END AS code FROM cases)
SELECT code, COUNT(*) AS n FROM x GROUP BY 1""")
def b20(spark, sf):
    c = ctx(spark, sf)
    return c.f.groupBy(B.digits_or_null(c.r.c("place_raw"), 7).alias("code")).agg(F.count(F.lit(1)).alias("n"))


_BR_TEXT = ("CASE WHEN c_custkey % 3 = 0 THEN replace(CAST(c_acctbal AS VARCHAR), '.', ',') "
            "WHEN c_custkey % 3 = 1 THEN CAST(c_acctbal AS VARCHAR) ELSE '.' END")


@register("b21_b22_brazilian_numbers", f"""
, t AS (SELECT c_custkey, {_BR_TEXT} AS txt FROM customer)
SELECT c_custkey, TRY_CAST(replace(replace(trim(txt), '.', ''), ',', '.') AS DOUBLE) * (CASE WHEN trim(txt) IN ('', '.', 'nan', 'None') THEN NULL ELSE 1 END) AS value,
  CAST(round_even(TRY_CAST(replace(replace(trim(txt), '.', ''), ',', '.') AS DOUBLE) * (CASE WHEN trim(txt) IN ('', '.', 'nan', 'None') THEN NULL ELSE 1 END), 0) AS BIGINT) AS value_int
FROM t""")
def b21(spark, sf):
    cu = FX.table(spark, sf, "customer")
    txt = (F.when(F.col("c_custkey") % 3 == 0, F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(",")))
            .when(F.col("c_custkey") % 3 == 1, F.col("c_acctbal").cast("string")).otherwise(F.lit(".")))
    return cu.select("c_custkey", B.br_decimal(txt).alias("value"), B.br_int(txt).alias("value_int"))


@register("b26_keep_first_per_key", """
SELECT c_nationkey, c_custkey, c_name FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn
FROM customer) WHERE rn = 1""")
def b26(spark, sf):
    cu = FX.table(spark, sf, "customer")
    return B.keep_first(cu, ["c_nationkey"], [-F.col("c_acctbal"), "c_custkey"]).select("c_nationkey", "c_custkey", "c_name")


@register("b27_territory_projection", """
SELECT code7, code6, place_name, '33' AS state_code, state_name, region_name, rgi, rgint, population, area_km2 FROM territory""")
def b27(spark, sf):
    """The municipality dimension under its source names, projected back."""
    names = {"code7": "cd_mun", "code6": "cd_mun6", "place_name": "nm_mun", "state_name": "nm_uf", "region_name": "nm_regiao",
             "rgi": "nm_rgi", "rgint": "nm_rgint", "population": "total_pessoas"}
    return B.territory_from_municipalities(ctx(spark, sf).t.withColumnsRenamed(names).withColumn("cd_uf", F.lit("33")))


# ---- 2A sources over driver tables -----------------------------------------------------------------
@register("a04_flatten_json_props", """
SELECT event_id, event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS "props.k" FROM events""",
          raw_sql=True)
def a04(spark, sf):
    ev = FX.table(spark, sf, "events").select("event_id", "event_type", "props")
    return R.parse_json_column(ev, "props", "k bigint").drop("props")


@register("a16_parse_load_log", """
, per AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS y, COUNT(*) AS n FROM orders GROUP BY 1)
SELECT 2000 + (y % 100) AS year, n AS loaded_rows FROM per""")
def a16(spark, sf):
    o = FX.table(spark, sf, "orders")
    per = o.groupBy(F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    # two log lines per year-file; the later one (by line order) carries the final count
    lines = per.select(F.explode(F.array(
        F.struct(F.lit(0).alias("ord"), F.format_string("Arquivo concluido: %d linhas carregadas (DENGBR%02d.json)",
                                                         (F.col("n") - 1).cast("bigint"), F.col("y") % 100).alias("value")),
        F.struct(F.lit(1).alias("ord"), F.format_string("Arquivo concluido: %d linhas carregadas (DENGBR%02d.json)",
                                                         F.col("n"), F.col("y") % 100).alias("value")))).alias("x"),
        "y").select("x.value", (F.col("y") * 2 + F.col("x.ord")).alias("line_no"))
    return R.parse_load_log(lines, order_col="line_no")


@register("a18_parameterized_sql", """
SELECT CAST(year(notified_on) AS INTEGER) AS year, COUNT(*) AS cases FROM cases
WHERE notified_on >= DATE '1996-03-01' AND COALESCE(NULLIF(trim(class_raw), ''), 'NI') IN ('1', '2') GROUP BY 1""")
def a18(spark, sf):
    c = ctx(spark, sf)
    view = f"cases_{abs(hash(sf)) % 10**8}"
    c.f.createOrReplaceTempView(view)
    return R.run_sql(spark, f"SELECT year(notified_on) AS year, count(*) AS cases FROM {view} "
                            "WHERE notified_on >= CAST(:since AS DATE) AND "
                            "coalesce(nullif(trim(class_raw), ''), 'NI') IN (:c1, :c2) GROUP BY 1",
                     since="1996-03-01", c1="1", c2="2")


# ---- 2D / 2H joins and set operations -------------------------------------------------------------
# Two snapshots of the customer table: the old one lacks the MACHINERY
# segment (those rows are new later), the new one lacks HOUSEHOLD (removed)
# and carries updated balances for BUILDING (changed).
_OLD = "SELECT * FROM customer WHERE c_mktsegment <> 'MACHINERY'"
_NEW = ("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 1 "
        "ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'")


def _old_new(spark, sf):
    cu = FX.table(spark, sf, "customer")
    old = cu.filter(F.col("c_mktsegment") != "MACHINERY")
    new = cu.filter(F.col("c_mktsegment") != "HOUSEHOLD").withColumn(
        "c_acctbal", F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return old, new


@register("d10_snapshot_diff", f"""
WITH o AS ({_OLD}), n AS ({_NEW})
SELECT c_custkey, 'new' AS change FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM o)
UNION ALL SELECT n.c_custkey, 'changed' FROM n JOIN o USING (c_custkey) WHERE n.c_acctbal IS DISTINCT FROM o.c_acctbal
UNION ALL SELECT c_custkey, 'removed' FROM o WHERE c_custkey NOT IN (SELECT c_custkey FROM n)""", raw_sql=True)
def d10(spark, sf):
    old, new = _old_new(spark, sf)
    return INC.snapshot_diff(old, new, ["c_custkey"], "c_acctbal")


@register("d13_upsert_keep_old", f"""
WITH o AS ({_OLD}), n0 AS ({_NEW}),
n AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN NULL ELSE c_name END AS c_name, c_nationkey,
      c_acctbal, CASE WHEN c_mktsegment = 'FURNITURE' THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM n0)
SELECT COALESCE(n.c_custkey, o.c_custkey) AS c_custkey, COALESCE(n.c_name, o.c_name) AS c_name,
  COALESCE(n.c_nationkey, o.c_nationkey) AS c_nationkey, COALESCE(n.c_acctbal, o.c_acctbal) AS c_acctbal,
  COALESCE(n.c_mktsegment, o.c_mktsegment) AS c_mktsegment
FROM o FULL OUTER JOIN n ON o.c_custkey = n.c_custkey""", raw_sql=True)
def d13(spark, sf):
    old, new = _old_new(spark, sf)
    # the new extract misses some fields (NULL): the old values must survive
    new = (new.withColumn("c_name", F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.lit(None)).otherwise(F.col("c_name")))
              .withColumn("c_mktsegment", F.when(F.col("c_mktsegment") == "FURNITURE", F.lit(None))
                          .otherwise(F.col("c_mktsegment"))))
    return INC.upsert_keep_old(old, new, ["c_custkey"])


@register("h02_yearly_batches_tagged", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS collection_year, COUNT(*) AS n,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total, COUNT(CASE WHEN year(o_orderdate) % 2 = 0 THEN 1 END) AS noted
FROM orders GROUP BY 1""", raw_sql=True)
def h02(spark, sf):
    """Batches of all years, each tagged with its year; even years carry one
    more field.  Batches with equal columns are read together."""
    base = W.staging_path(spark, "h02-batches")
    o = FX.table(spark, sf, "orders").select("o_totalprice", F.year("o_orderdate").alias("collection_year"))
    even = F.col("collection_year") % 2 == 0
    o.filter(~even).write.partitionBy("collection_year").parquet(f"{base}/plain")
    o.filter(even).withColumn("note", F.lit("x")).write.partitionBy("collection_year").parquet(f"{base}/noted")
    u = B.union_widening([R.read_year_range(spark, f"{base}/{k}", 1900, 2100, year_col="collection_year") for k in ("plain", "noted")])
    return u.groupBy("collection_year").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"), F.count("note").alias("noted"))


@register("h03_union_of_name_sets", """
SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT c_mktsegment FROM customer""", raw_sql=True)
def h03(spark, sf):
    return Q.name_union([FX.table(spark, sf, "nation").select("n_name"), FX.table(spark, sf, "region").select("r_name"),
                         FX.table(spark, sf, "customer").select("c_mktsegment")])


@register("h04_set_difference", """
SELECT c_custkey AS name FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""", raw_sql=True)
def h04(spark, sf):
    o = FX.table(spark, sf, "orders").filter("o_orderstatus = 'P'").select("o_custkey")
    return Q.name_difference(FX.table(spark, sf, "customer").select("c_custkey"), o)


@register("d09_decode_counts", f"""
SELECT {_decode_sql('outcome_raw', K.OUTCOME_LABELS)} AS outcome_label, COUNT(*) AS cases FROM cases GROUP BY 1""")
def d09(spark, sf):
    c = ctx(spark, sf)
    return c.f.groupBy(X.decode_outcome(c.r.c("outcome_raw")).alias("outcome_label")).agg(F.count(F.lit(1)).alias("cases"))


# ---- 2J reconciliation and streaming extension ---------------------------------------------------
@register("j09_d11_reconcile_years", f"""
, lg AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, COUNT(*) AS loaded_rows FROM orders GROUP BY 1),
bd AS (SELECT {YEAR('notified_on')} AS year, COUNT(*) AS rows_by_date FROM cases WHERE notified_on IS NOT NULL GROUP BY 1),
bt AS (SELECT TRY_CAST(trim(year_text) AS INTEGER) AS year, COUNT(*) AS rows_by_text FROM cases
       WHERE regexp_matches(trim(year_text), '^[0-9]{{4}}$') GROUP BY 1),
sp AS (SELECT CAST(unnest(generate_series(1994, 2002)) AS INTEGER) AS year),
j AS (SELECT year, loaded_rows AS l, COALESCE(rows_by_date, 0) AS d, COALESCE(rows_by_text, 0) AS t,
      greatest(abs(COALESCE(rows_by_date, 0) - loaded_rows), abs(COALESCE(rows_by_text, 0) - loaded_rows)) AS gap
      FROM sp LEFT JOIN lg USING (year) LEFT JOIN bd USING (year) LEFT JOIN bt USING (year))
SELECT year, l AS loaded_rows, d AS rows_by_date, d - l AS diff_date_vs_log, t AS rows_by_text, t - l AS diff_text_vs_log,
  CASE WHEN l IS NULL THEN 'SEM_LOG' WHEN gap = 0 THEN 'OK_FULL' WHEN gap <= greatest(25, l * 0.01) OR l = 0 THEN 'OK_COM_TOLERANCIA'
   WHEN d = l THEN 'OK_DATA_NOTIFICACAO' WHEN t = l THEN 'OK_NU_ANO' ELSE 'DIVERGENTE' END AS status
FROM j""")
def j09(spark, sf):
    c = ctx(spark, sf)
    o = FX.table(spark, sf, "orders")
    lg = o.groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("loaded_rows"))
    bd = C.rows_per_year_by_date(c.f, c.r)
    bt = C.rows_per_year_by_text(c.f, c.r)
    return Q.reconcile_years(lg, bd, bt, 1994, 2002, tolerance_abs=25, tolerance_pct=1.0)


@register("j12_daily_event_counts", """
SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, COUNT(*) AS events,
  CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS value_sum
FROM events GROUP BY 1, 2""", raw_sql=True)
def j12(spark, sf):
    from surv.sources.writers import staging_path
    from surv.streaming.stream import run_daily_event_counts
    import uuid
    return run_daily_event_counts(spark, sf, staging_path(spark, "daily-events-out"),
                                  name=f"daily-events-{uuid.uuid4().hex}",
                                  file_glob="events.parquet")


@register("k07_d12_schema_coverage")
def k07(spark, sf):
    """Which source fields the fact projection maps, produces and
    stores, with the stored table's non-null counts (rows-only check)."""
    import re as _re
    c = ctx(spark, sf)
    src_cols = [B.snake_name(x) for t in ("orders", "customer", "nation") for x in FX.table(spark, sf, t).columns]
    used = sorted({w for e in FX.CASES_COLUMNS.values() for w in _re.findall(r"[a-z_]+", e) if w in src_cols})
    return Q.schema_coverage(spark, src_cols, used, list(FX.CASES_COLUMNS), c.f,
                             aliases={"o_orderdate": ["o_orderdate"]})


@register("j12_closed_days", """
SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS events, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS value_sum
FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1, 2""", raw_sql=True)
def j12_closed(spark, sf):
    """Days whose end the watermark (last event minus a day) has passed; days that
    are open stay in the stream's state."""
    import uuid
    from surv.streaming.stream import run_closed_days
    return run_closed_days(spark, sf, staging_path(spark, "closed-days"), name=f"closed-{uuid.uuid4().hex}", file_glob="events.parquet")[0]


@register("j03_late_records_by_key", """
WITH e AS (SELECT event_id, CAST(ts AS DATE) AS day, event_type, event_id % 4 AS file FROM events)
SELECT event_id, day, CASE WHEN file = 2 THEN 'third ' WHEN file = 3 AND event_id % 3 = 0 THEN 'older ' ELSE '' END || event_type AS kind, 'kept' AS place FROM e
WHERE NOT (file = 3 AND day < (SELECT max(day) FROM e WHERE file < 3) - 30)
UNION ALL SELECT event_id, day, CASE WHEN event_id % 3 = 0 THEN 'older ' ELSE '' END || event_type, 'too late' FROM e
WHERE file = 3 AND day < (SELECT max(day) FROM e WHERE file < 3) - 30""", raw_sql=True)
def j03_by_key(spark, sf):
    """Four deliveries, each a run of its own, in an order that is not that of the
    days: two thirds of the keys; the third part in two versions (the newer first);
    the last part, most of it from days that are closed by then."""
    import uuid
    from surv.streaming.stream import stream_upsert
    base = staging_path(spark, "j03-key")
    e = FX.table(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"), F.col("event_type").alias("kind"), F.date_format("ts", "yyyy-MM").alias("month"),
                                             (F.col("event_id") % 4).alias("file"))
    third = e.filter("file = 2")
    deliveries = [e.filter("file <= 1").withColumn("version", F.lit(1)),
                  third.withColumn("kind", F.concat(F.lit("third "), "kind")).withColumn("version", F.lit(2)),
                  third.withColumn("version", F.lit(1)).unionByName(e.filter("file = 0").withColumn("kind", F.lit("stale")).withColumn("version", F.lit(0))),
                  e.filter("file = 3").withColumn("kind", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("older "), "kind")).otherwise(F.col("kind")))
                  .withColumn("version", F.lit(1))]
    name, lateness = f"j03-{uuid.uuid4().hex}", [20000, 20000, 20000, 30]
    for k, (d, days) in enumerate(zip(deliveries, lateness)):
        d = d.drop("file")
        d.coalesce(2).write.parquet(f"{base}/land/{k}")
        group = stream_upsert(spark, f"{base}/land/*", d.schema, f"{base}/table", ["event_id", "day"], "day", "version", "month", days, name=name)
    cols = ["event_id", "day", "kind"]
    return group.read("rows").select(*cols, F.lit("kept").alias("place")).unionByName(group.read("too_late").select(*cols, F.lit("too late").alias("place")))


# ---- answers from metadata ---------------------------------------------------------------
@register("e29_e72_from_footers", """
SELECT count(*) AS total, max(notified_on) AS max_notified_on, min(notified_on) AS min_notified_on, min(case_id) AS min_case_id FROM cases""")
def e29_footers(spark, sf):
    """Rows, first and last day and first id of the fact, from its footers."""
    from surv.sources.metadata import footer_aggregates, table_root
    c = ctx(spark, sf)
    got = footer_aggregates(spark, table_root(c.f, "notified_year"), ["notified_on"], ["notified_on", "case_id"], {"notified_on": "notified_year"})
    return spark.createDataFrame([tuple(got.values())], "total long, max_notified_on date, min_notified_on date, min_case_id long")


@register("c11_last_months_from_metadata", """
SELECT date_trunc('month', notified_on)::DATE AS month_start, count(*) AS cases FROM cases
WHERE date_trunc('month', notified_on) >= date_trunc('month', (SELECT max(notified_on) FROM cases)) - INTERVAL 11 MONTH GROUP BY 1""")
def c11_metadata(spark, sf):
    """The last twelve months; the latest day comes from the footers of the
    greatest year, so the window is a constant that prunes years and row groups."""
    from surv.sources.metadata import latest_value, table_root
    c = ctx(spark, sf)
    latest = latest_value(spark, table_root(c.f, "notified_year"), "notified_on", "notified_year")
    f = S.last_months_window(c.f.filter(F.col("notified_year") >= (latest.year - 1)), 12, "notified_on", latest)
    return f.groupBy(F.trunc("notified_on", "MM").alias("month_start")).agg(F.count(F.lit(1)).alias("cases"))


# ---- digests and bitmaps -------------------------------------------------------------------
@register("d10_snapshot_diff_by_digests", """
SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'removed' WHEN o_orderkey % 13 = 0 THEN 'new' ELSE 'changed' END AS change FROM orders
WHERE o_orderkey % 11 = 0 OR (o_orderkey % 13 = 0) OR (o_orderkey % 17 = 0)""", raw_sql=True)
def d10_digests(spark, sf):
    """Orders of yesterday and of today: one in 11 is gone, one in 13 is new, one in
    17 has another price; the digests name the buckets to compare."""
    o = FX.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    old = o.filter("o_orderkey % 11 = 0 OR o_orderkey % 13 <> 0")
    new = o.filter("o_orderkey % 11 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 17 == 0, F.lit(-1.0)).otherwise(F.col("o_totalprice")))
    dig = lambda d: INC.snapshot_digest(d, ["o_orderkey"], "o_totalprice")
    return INC.snapshot_diff(old, new, ["o_orderkey"], "o_totalprice", dig(old), dig(new))


@register("e71_e28_distinct_rollups", f"""
SELECT 'facility' AS what, {YEAR('notified_on')} AS year, '' AS state, count(DISTINCT {NI('facility_raw')}) AS n FROM cases WHERE notified_on IS NOT NULL GROUP BY 2
UNION ALL SELECT 'facility', 0, {NI('state_raw')} AS s, count(DISTINCT {NI('facility_raw')}) FROM cases WHERE notified_on IS NOT NULL GROUP BY s
UNION ALL SELECT 'place', {YEAR('notified_on')} AS y, {NI('state_raw')} AS s, count(DISTINCT place_raw) FROM cases WHERE notified_on IS NOT NULL GROUP BY y, s
UNION ALL SELECT 'place', 0, '', count(DISTINCT place_raw) FROM cases WHERE notified_on IS NOT NULL""")
def e71_rollups(spark, sf):
    """Distinct facilities and places of months, states and classes, rolled up to
    years, to states, to both and to all."""
    from surv.operators.distinct import distinct_cube, distinct_rollup, value_numbers
    c = ctx(spark, sf)
    f = S.notified(c.f, c.r)
    keys = [X.year_of(F.col("notified_on")).alias("year"), X.month_start(F.col("notified_on")).alias("month_start"), X.ni(c.r.c("state_raw")).alias("state"),
            X.ni(c.r.c("class_raw")).alias("classification")]
    fac, place = X.ni(c.r.c("facility_raw")), c.r.c("place_raw")
    a, b = distinct_cube(f, keys, fac, value_numbers(f, fac)), distinct_cube(f, keys, place, value_numbers(f, place))

    def part(cube, what, *by):
        r = distinct_rollup(cube, list(by), "n")
        return r.select(F.lit(what).alias("what"), F.col("year") if "year" in by else F.lit(0).alias("year"), F.col("state") if "state" in by else F.lit("").alias("state"), "n")

    return part(a, "facility", "year").unionByName(part(a, "facility", "state")).unionByName(part(b, "place", "year", "state")).unionByName(part(b, "place"))
