"""Registered cube, indicator-table, router and quality queries
(E24-E28, K08, B28, E35-E36, E40, J09, K07)."""

from __future__ import annotations

from pyspark.sql import functions as F

from surv.functions import expr as X
from surv.operators import counts as C
from surv.operators import cubes as CU
from surv.operators import quality as Q
from surv.operators import scope as S
from surv.plans.registry import (AGE, BAND, BASE, CODE6, FOCUS_FROM, IN, MONTH, NI, PLACE, SINCE, WEEK, YEAR, ctx,
                                 register)

CONF = ("1", "3", "4", "5", "6", "10", "11", "12")


def _ratio(n, d, k):
    return f"CASE WHEN {d} > 0 THEN CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) * {k}.0 END"


_MONTH_PLACE = f"""{YEAR('f.notified_on')} AS year, CAST(month(f.notified_on) AS INTEGER) AS month, {NI('f.state_raw')} AS state,
  COALESCE(t.place_name, {NI('f.place_raw', 'Municipio nao informado')}) AS place, {CODE6('f.place_raw')} AS code6, region_name, rgi, rgint, population"""


# E24 by its definition: the six counts of a month and place, then the rates
@register("e24_d05_monthly_indicators", f"""
SELECT *, {_ratio('confirmed', 'population', 100000)} AS incidence_100k, {_ratio('deaths', 'confirmed', 100)} AS lethality_pct,
  {_ratio('hospitalisations', 'confirmed', 100)} AS hosp_rate_pct
FROM (SELECT {_MONTH_PLACE}, COUNT(*) AS cases_total,
    COUNT(*) FILTER (WHERE {NI('class_raw')} IN {IN(CONF)}) AS confirmed,
    COUNT(*) FILTER (WHERE {NI('class_raw')} = '2') AS discarded,
    COUNT(*) FILTER (WHERE {NI('class_raw')} IN ('0', '8', '9', 'NI')) AS investigating,
    COUNT(*) FILTER (WHERE {NI('outcome_raw')} = '2') AS deaths,
    COUNT(*) FILTER (WHERE {NI('hosp_raw')} = '1') AS hospitalisations
  FROM cases f LEFT JOIN territory t ON {CODE6('f.place_raw')} = t.code6 WHERE f.notified_on IS NOT NULL GROUP BY ALL)""")
def e24(spark, sf):
    c = ctx(spark, sf)
    return CU.monthly_indicators(c.f, c.r, c.t)


@register("e25_cube_month_state_class", f"""
SELECT {YEAR('notified_on')} AS year, {MONTH('notified_on')} AS month_start, {NI('state_raw')} AS state,
   {NI('class_raw')} AS classification, COUNT(*) AS cases FROM cases WHERE notified_on IS NOT NULL GROUP BY 1, 2, 3, 4""")
def e25(spark, sf):
    c = ctx(spark, sf)
    return CU.cube_month_state_class(c.f, c.r)


def _cube_sql(extra: str, name: str, attributes: bool) -> str:
    """Cases of the focus state by month, place, class and one more column."""
    place = NI('f.place_raw', 'Municipio nao informado')
    return f"""
SELECT {YEAR('f.notified_on')} AS year, {MONTH('f.notified_on')} AS month_start, {NI('f.state_raw')} AS state, {place} AS place_code,
  COALESCE(d.place_name, {place}) AS place_name, {CODE6(place)} AS code6, {'d.population, d.area_km2,' if attributes else ''}
  {NI('f.class_raw')} AS classification, {extra} AS {name}, COUNT(*) AS cases
FROM cases f LEFT JOIN territory d ON {CODE6(place)} = d.code6
WHERE f.notified_on IS NOT NULL AND {NI('f.state_raw')} IN ('RJ', '33') GROUP BY ALL"""


@register("e26_cube_month_place_class_outcome", _cube_sql(NI('f.outcome_raw'), "outcome", True))
def e26(spark, sf):
    c = ctx(spark, sf)
    return CU.cube_month_place_class_outcome(c.f, c.r, c.t)


@register("e27_cube_month_place_class_facility", _cube_sql(NI('f.facility_raw'), "facility", False))
def e27(spark, sf):
    c = ctx(spark, sf)
    return CU.cube_month_place_class_facility(c.f, c.r, c.t)


def _as_cte(text: str, name: str) -> str:
    return f", {name} AS ({text})\n"


@register("e28_cube_rollup_place_month", _as_cte(_cube_sql(NI('f.outcome_raw'), "outcome", True), "cube") + """
SELECT year, month_start, state, place_code, place_name, CAST(sum(cases) AS BIGINT) AS cases,
   max(population) AS population, max(area_km2) AS area_km2,
   CASE WHEN max(population) > 0 THEN CAST(sum(cases) AS DOUBLE) / CAST(max(population) AS DOUBLE) * 100000.0 END
     AS incidence_100k
FROM cube WHERE month_start >= DATE '1997-01-01' GROUP BY 1, 2, 3, 4, 5""")
def e28(spark, sf):
    c = ctx(spark, sf)
    cube = CU.cube_filter(CU.cube_month_place_class_outcome(c.f, c.r, c.t), since=SINCE)
    r = CU.rollup_cube(cube, ["year", "month_start", "state", "place_code", "place_name"],
                       maxes=["population", "area_km2"])
    return r.withColumn("incidence_100k", X.guarded_ratio("cases", "population", 100000))


_E02 = f"""
SELECT {YEAR('notified_on')} AS year, {MONTH('notified_on')} AS month_start,
       {NI('state_raw')} AS state, COUNT(*) AS cases
FROM cases f WHERE {BASE(('1', '2', '5'), SINCE)} GROUP BY 1, 2, 3"""


@register("k08_route_cube", _E02)
def k08(spark, sf):
    c = ctx(spark, sf)
    return CU.route_month_state(spark, c.f, c.r, ("1", "2", "5"), SINCE, cube=CU.cube_month_state_class(c.f, c.r))


@register("k08_route_fact", _E02)
def k08b(spark, sf):
    c = ctx(spark, sf)
    return CU.route_month_state(spark, c.f, c.r, ("1", "2", "5"), SINCE, cube=None)


@register("b28_d01_l05_analytic_fact", f"""
SELECT case_id, notified_on, onset_on, {YEAR('notified_on')} AS year, CAST(month(notified_on) AS INTEGER) AS month,
  {WEEK('week_raw')} AS epi_week,
  {NI('place_raw', 'Municipio nao informado')} AS place_raw, {NI('state_raw')} AS state, class_raw AS classification, outcome_raw AS outcome,
  hosp_raw AS hospitalisation, {AGE('age_raw')} AS age, sex_raw AS sex, race_raw AS race, school_raw AS schooling, closed_on,
  c.code6, fever AS symptom_fever, headache AS symptom_headache, myalgia AS symptom_myalgia, diabetes AS comorbidity_diabetes,
  hypertension AS comorbidity_hypertension, renal AS comorbidity_renal, ns1_result AS exam_ns1, pcr_result AS exam_pcr,
  ns1_on AS exam_ns1_on, pcr_on AS exam_pcr_on, CAST(NULL AS DATE) AS entered_on, {BAND(AGE('age_raw'))} AS age_band,
  region_name, rgi, rgint, population, COALESCE(place_name, {NI('place_raw', 'Municipio nao informado')}) AS place
FROM (SELECT *, {CODE6('place_raw')} AS code6 FROM cases) c
LEFT JOIN territory t ON c.code6 = t.code6""")
def b28(spark, sf):
    """Every column of the analytic fact, row by row."""
    c = ctx(spark, sf)
    return CU.analytic_fact(c.f, c.r, c.t)


# ---- quality -----------------------------------------------------------------------
def _validity_sql() -> str:
    fields = ([("symptoms", n, n, ('1', '2')) for n in ("fever", "headache", "myalgia")] +
              [("comorbidities", n, n, ('1', '2')) for n in ("diabetes", "hypertension", "renal")] +
              [("exams", "ns1", "ns1_result", ('1', '2', '3', '4')), ("exams", "pcr", "pcr_result", ('1', '2', '3', '4')),
               ("profile", "sex", "sex_raw", ('M', 'F', 'I')), ("profile", "age", "age_raw", None),
               ("profile", "pregnancy", "pregnant_raw", ('1', '2', '3', '4', '5', '6', '9')),
               ("profile", "race", "race_raw", ('1', '2', '3', '4', '5', '9')),
               ("profile", "schooling", "school_raw", ('0', '00', '1', '01', '2', '02', '3', '03', '4', '04', '5', '05',
                                                       '6', '06', '7', '07', '8', '08', '9', '09', '10', '99'))])
    aggs, rows = ["COUNT(*) AS total"], []
    for i, (g, n, col, vals) in enumerate(fields):
        v = NI(f"CAST({col} AS VARCHAR)")
        p = f"regexp_matches({v}, '^[1-4][0-9]+$')" if vals is None else f"{v} IN {IN(vals)}"
        aggs += [f"COUNT(*) FILTER (WHERE {v} <> 'NI') AS f{i}", f"COUNT(*) FILTER (WHERE {v} = 'NI') AS b{i}",
                 f"COUNT(*) FILTER (WHERE {p}) AS v{i}", f"COUNT(*) FILTER (WHERE {v} <> 'NI' AND NOT ({p})) AS x{i}"]
        rows.append(f"SELECT total, '{g}' AS \"group\", '{n}' AS field, 'SIM' AS column_exists, f{i} AS filled, "
                    f"b{i} AS blank_ni, v{i} AS valid, x{i} AS invalid FROM a")
    return f"""
, g AS (SELECT f.* {FOCUS_FROM()}),
a AS (SELECT {', '.join(aggs)} FROM g),
l AS ({' UNION ALL '.join(rows)})
SELECT *, CASE WHEN total > 0 THEN round_even(CAST(valid AS DOUBLE) / CAST(total AS DOUBLE) * 100.0, 2) ELSE 0.0 END AS pct_valid,
  CASE WHEN total = 0 THEN 'SEM_REGISTROS_NO_RECORTE' WHEN column_exists = 'NAO' THEN 'COLUNA_AUSENTE'
       WHEN valid = 0 AND filled = 0 THEN 'SEM_DADO_INFORMADO' WHEN valid = 0 AND filled > 0 THEN 'PREENCHIDO_INVALIDO'
       ELSE 'OK' END AS status
FROM l"""


@register("e35_e36_c14_field_validity", _validity_sql())
def e35(spark, sf):
    c = ctx(spark, sf)
    g = S.place_scope(S.notified(c.f, c.r), c.r, c.t, PLACE)
    return Q.field_validity(g, c.r)


_DOCS = ("SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic "
         "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
_DOC_COLS = ("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")


def _docs(spark, sf):
    from surv.plans import fixtures as FX
    return FX.table(spark, sf, "documents").join(FX.table(spark, sf, "labels"), "doc_id", "left")


@register("e40_non_null_counts", f"WITH x AS ({_DOCS})\n" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS non_null FROM x" for c in _DOC_COLS), raw_sql=True)
def e40(spark, sf):
    return Q.non_null_counts(_docs(spark, sf), list(_DOC_COLS))


@register("e65_null_rates_real", f"WITH x AS ({_DOCS})\n" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CASE WHEN count(*) > 0 THEN CAST(count(*) - count({c}) AS DOUBLE) / "
    f"CAST(count(*) AS DOUBLE) * 100.0 END AS null_pct FROM x" for c in _DOC_COLS), raw_sql=True)
def e65r(spark, sf):
    return Q.null_rates(_docs(spark, sf), list(_DOC_COLS))


# ---- K08: the place loaders answered from the cubes (oracle = fact route) ----------
from surv.plans.registry import CLS, ORACLE  # noqa: E402


def _cube26(c):
    return CU.cube_month_place_class_outcome(c.f, c.r, c.t)


def _cube27(c):
    return CU.cube_month_place_class_facility(c.f, c.r, c.t)


@register("k08_route_e07_cube", ORACLE["e07_c04_c06_d02_focus_monthly"], raw_sql=True)
def k08_e07(spark, sf):
    c = ctx(spark, sf)
    return CU.route_focus_monthly(spark, c.f, c.r, c.t, PLACE, since=SINCE, cube=_cube26(c))


@register("k08_route_e09_cube", ORACLE["e09_focus_status"], raw_sql=True)
def k08_e09(spark, sf):
    c = ctx(spark, sf)
    return CU.route_focus_status(spark, c.f, c.r, c.t, PLACE, CLS, cube=_cube26(c))


@register("k08_route_e12_cube", ORACLE["e12_d04_g04_top_facilities"], raw_sql=True)
def k08_e12(spark, sf):
    c = ctx(spark, sf)
    return CU.route_top_facilities(spark, c.f, c.r, c.t, c.fac, PLACE, CLS, top_n=10, cube=_cube27(c))


@register("k08_route_e13_cube", ORACLE["e13_g03_facilities_monthly"], raw_sql=True)
def k08_e13(spark, sf):
    c = ctx(spark, sf)
    return CU.route_facilities_monthly(spark, c.f, c.r, c.t, c.fac, PLACE, since=SINCE, cube=_cube27(c))


# The cube labels a blank place 'Municipio nao informado' while the fact route
# says 'Município não informado' (both as in the source system), so the cube
# route of E16 is checked against cube semantics, not the fact route.
@register("k08_route_e16_cube", _as_cte(_cube_sql(NI('f.outcome_raw'), "outcome", True), "cube") + f"""
SELECT year, month_start, state, place_code, place_name, CAST(sum(cases) AS BIGINT) AS cases,
   max(population) AS population, max(area_km2) AS area_km2,
   CASE WHEN max(population) > 0 THEN CAST(sum(cases) AS DOUBLE) / CAST(max(population) AS DOUBLE) * 100000.0 END
     AS incidence_100k
FROM cube WHERE classification IN {IN(CLS)} GROUP BY 1, 2, 3, 4, 5""")
def k08_e16(spark, sf):
    c = ctx(spark, sf)
    return CU.route_state_places(spark, c.f, c.r, c.t, CLS, cube=_cube26(c))


# ---- J08: the derived tables as roll-ups of the one-scan base aggregate --------------
def _base(c):
    return CU.analytics_base(c.f, c.r)


@register("j08_base_e24_monthly_indicators", ORACLE["e24_d05_monthly_indicators"], raw_sql=True)
def j08_e24(spark, sf):
    c = ctx(spark, sf)
    return CU.indicators_from_base(_base(c), c.t)


@register("j08_base_e25_cube", ORACLE["e25_cube_month_state_class"], raw_sql=True)
def j08_e25(spark, sf):
    c = ctx(spark, sf)
    return CU.cubes_from_base(_base(c), c.t)["month_state_class"]


@register("j08_base_e26_cube", ORACLE["e26_cube_month_place_class_outcome"], raw_sql=True)
def j08_e26(spark, sf):
    c = ctx(spark, sf)
    return CU.cubes_from_base(_base(c), c.t)["month_place_class_outcome"]


@register("j08_base_e27_cube", ORACLE["e27_cube_month_place_class_facility"], raw_sql=True)
def j08_e27(spark, sf):
    c = ctx(spark, sf)
    return CU.cubes_from_base(_base(c), c.t)["month_place_class_facility"]


# The analytic view carries a NULL hospitalisation column, so the
# reference's table always reports 0 hospitalisations; real_hosp=False mimics it.
@register("e24_monthly_indicators_null_hosp", ORACLE["e24_d05_monthly_indicators"]
          .replace(f"COUNT(*) FILTER (WHERE {NI('hosp_raw')} = '1') AS hospitalisations",
                   "CAST(0 AS BIGINT) AS hospitalisations"), raw_sql=True)
def e24_null_hosp(spark, sf):
    c = ctx(spark, sf)
    return CU.monthly_indicators(c.f, c.r, c.t, real_hosp=False)


# ---- K04 / K05 / J08 after A13 and J03: cubes that follow three deliveries ----------
def _union_of_tables(t: dict) -> object:
    """The four derived tables, one under the other."""
    text = lambda c: F.col(c).cast("string")
    e24 = t["monthly_indicators"].select(F.lit("e24").alias("cube"), "year", "month", "state", "place", text("confirmed").alias("a"),
                                         F.concat_ws("/", "deaths", "hospitalisations", "discarded", "investigating").alias("b"),
                                         F.col("cases_total").alias("cases"), F.col("incidence_100k").alias("rate"))
    none = F.lit(None).cast("double").alias("rate")
    m = F.month("month_start").alias("month")
    e25 = t["month_state_class"].select(F.lit("e25").alias("cube"), "year", m, "state", F.lit("").alias("place"), F.col("classification").alias("a"),
                                        F.lit("").alias("b"), "cases", none)
    e26 = t["month_place_class_outcome"].select(F.lit("e26").alias("cube"), "year", m, "state", F.col("place_name").alias("place"),
                                                F.col("classification").alias("a"), F.concat_ws("/", "outcome", "place_code").alias("b"), "cases", none)
    e27 = t["month_place_class_facility"].select(F.lit("e27").alias("cube"), "year", m, "state", F.col("place_name").alias("place"),
                                                 F.col("classification").alias("a"), F.concat_ws("/", "facility", "place_code").alias("b"), "cases", none)
    return e24.unionByName(e25).unionByName(e26).unionByName(e27)


_NAMED = f"COALESCE(t.place_name, {NI('f.place_raw', 'Municipio nao informado')})"
_DIMS = f"{YEAR('f.notified_on')} AS year, CAST(month(f.notified_on) AS INTEGER) AS month, {NI('f.state_raw')} AS state"
_DATED = f"FROM cases f LEFT JOIN territory t ON ({CODE6('f.place_raw')}) = t.code6 WHERE f.notified_on IS NOT NULL"


def _count_if(test: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {test}) AS VARCHAR)"


@register("k04_k05_j08_maintained_after_deliveries", f"""
SELECT 'e24' AS cube, {_DIMS}, {_NAMED} AS place, {_count_if(NI('class_raw') + ' IN ' + IN(CONF))} AS a,
  {_count_if(NI('outcome_raw') + " = '2'")} || '/' || {_count_if(NI('hosp_raw') + " = '1'")} || '/' || {_count_if(NI('class_raw') + " = '2'")} || '/' ||
  {_count_if(NI('class_raw') + " IN ('0', '8', '9', 'NI')")} AS b, count(*) AS cases,
  CASE WHEN any_value(t.population) > 0 THEN CAST(count(*) FILTER (WHERE {NI('class_raw')} IN {IN(CONF)}) AS DOUBLE) / any_value(t.population) * 100000.0 END AS rate
  {_DATED} GROUP BY year, month, state, place, {CODE6('f.place_raw')}
UNION ALL SELECT 'e25', {_DIMS}, '' AS place, {NI('class_raw')} AS a, '' AS b, count(*), NULL {_DATED} GROUP BY year, month, state, a
UNION ALL SELECT 'e26', {_DIMS}, {_NAMED} AS place, {NI('class_raw')} AS a, {NI('outcome_raw')} || '/' || {NI('f.place_raw', 'Municipio nao informado')} AS b, count(*), NULL
  {_DATED} AND {NI('f.state_raw')} IN ('RJ', '33') GROUP BY year, month, state, place, a, b
UNION ALL SELECT 'e27', {_DIMS}, {_NAMED} AS place, {NI('class_raw')} AS a, {NI('facility_raw')} || '/' || {NI('f.place_raw', 'Municipio nao informado')} AS b, count(*), NULL
  {_DATED} AND {NI('f.state_raw')} IN ('RJ', '33') GROUP BY year, month, state, place, a, b""")
def k05_maintained(spark, sf):
    """A first load with wrong classes since 1997 and without the second half of
    every month of 1996; then the window since 1997 again, the days of 1996 as
    late files, and at last a window of days that turn out empty."""
    from surv.sources.writers import staging_path
    from surv.streaming.maintained import Warehouse
    c = ctx(spark, sf)
    f = c.f.withColumn("year", F.year("notified_on"))
    w = Warehouse(spark, staging_path(spark, "k05"), c.r, c.t)
    late = (F.col("year") == 1996) & (F.dayofmonth("notified_on") > 15)
    ghost = f.filter("year = 1996").withColumn("notified_on", F.to_date(F.lit("2050-01-01"))).withColumn("year", F.lit(2050))
    first = f.filter(~F.coalesce(late, F.lit(False))).withColumn("class_raw", F.when(F.col("year") >= 1997, F.lit("10")).otherwise(F.col("class_raw")))
    w.replace_window(first.unionByName(ghost), "1900-01-01")
    w.replace_window(f.filter("notified_on >= '1997-01-01'"), "1997-01-01", "2049-12-31")
    w.replace_days(f.filter(late))
    w.empty_days("2050-01-01", "2050-12-31")
    return _union_of_tables({n: w.read(n) for n in ("monthly_indicators", "month_state_class", "month_place_class_outcome", "month_place_class_facility")})


@register("k08_lattice_requests", f"""
SELECT 'state_year' AS request, year, state, '' AS place, CAST(sum(cases) AS BIGINT) AS cases, CAST(sum(confirmed) AS BIGINT) AS confirmed
  FROM (SELECT {_DIMS}, 1 AS cases, CASE WHEN {NI('class_raw')} IN {IN(CONF)} THEN 1 ELSE 0 END AS confirmed {_DATED}) GROUP BY ALL
UNION ALL SELECT 'focus_place', 0, '', {_NAMED} AS p, count(*), count(*) FILTER (WHERE {NI('class_raw')} IN {IN(CONF)})
  {_DATED} AND {NI('f.state_raw')} IN ('RJ', '33') AND {NI('outcome_raw')} = '2' GROUP BY p
UNION ALL SELECT 'inside_a_month', 0, {NI('f.state_raw')} AS s, '', count(*), count(*) FILTER (WHERE {NI('class_raw')} IN {IN(CONF)})
  {_DATED} AND f.notified_on >= DATE '1997-01-15' GROUP BY s""")
def k08_lattice(spark, sf):
    """Three requests: the smallest cube, the one cube with outcomes of places,
    and one that only the fact can answer."""
    from surv.operators.lattice import Lattice, Request
    c = ctx(spark, sf)
    lat = Lattice(c.f, c.r, c.t, {"month_state_class": CU.cube_month_state_class(c.f, c.r), "month_place_class_outcome": _cube26(c),
                                  "month_place_class_facility": _cube27(c)})
    m = ("cases", "confirmed")
    a = lat.answer(Request(("year", "state"), m)).select(F.lit("state_year").alias("request"), "year", "state", F.lit("").alias("place"), *m)
    b = lat.answer(Request(("place_name",), m, {"state": ("RJ", "33"), "outcome": ("2",)})).select(
        F.lit("focus_place").alias("request"), F.lit(0).alias("year"), F.lit("").alias("state"), F.col("place_name").alias("place"), *m)
    d = lat.answer(Request(("state",), m, since="1997-01-15")).select(
        F.lit("inside_a_month").alias("request"), F.lit(0).alias("year"), "state", F.lit("").alias("place"), *m)
    return a.unionByName(b).unionByName(d)
