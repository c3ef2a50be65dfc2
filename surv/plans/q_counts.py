"""Registered counting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from surv.operators import counts as C
from surv.operators import scope as S
from surv.plans.registry import (BASE, CLS, CODE6, FACILITY_KEY, FOCUS_FROM, IN, MONTH, NI, PLACE, PLACE_CODE7,
                                 SINCE, WEEK, YEAR, ctx, register)


@register("e01_cases_per_year", f"""
SELECT {YEAR('notified_on')} AS year, COUNT(*) AS cases FROM cases f
WHERE {BASE(CLS)} GROUP BY 1""")
def e01(spark, sf):
    c = ctx(spark, sf)
    return C.cases_per_year(c.f, c.r, CLS)


@register("e02_c01_c02_c03_g01_cases_month_state", f"""
SELECT {YEAR('notified_on')} AS year, {MONTH('notified_on')} AS month_start,
       {NI('state_raw')} AS state, COUNT(*) AS cases
FROM cases f WHERE {BASE(None, SINCE)} GROUP BY 1, 2, 3""")
def e02(spark, sf):
    c = ctx(spark, sf)
    return C.cases_month_state(c.f, c.r, since=SINCE)


@register("e03_cases_place_year", f"""
SELECT {YEAR('notified_on')} AS year, {NI('state_raw')} AS state,
       {NI('place_raw', 'Municipio nao informado')} AS place, COUNT(*) AS cases
FROM cases f WHERE notified_on IS NOT NULL GROUP BY 1, 2, 3""")
def e03(spark, sf):
    c = ctx(spark, sf)
    return C.cases_place_year(c.f, c.r)


@register("e04_cases_place_month", f"""
SELECT place_raw AS place, {MONTH('notified_on')} AS month_start, COUNT(*) AS cases
FROM cases GROUP BY 1, 2""")
def e04(spark, sf):
    c = ctx(spark, sf)
    return C.cases_place_month(c.f, c.r)


@register("e05_place_kpi", """
SELECT place_raw AS place, COUNT(*) AS cases, min(notified_on) AS first_notified,
       max(notified_on) AS last_notified
FROM cases GROUP BY 1""")
def e05(spark, sf):
    c = ctx(spark, sf)
    return C.place_kpi(c.f, c.r)


_CODE_MASK = (f"(upper(trim(f.place_raw)) = '{PLACE_CODE7}' OR starts_with(upper(trim(f.place_raw)), "
              f"'{PLACE_CODE7[:6]}') OR upper(trim(f.place_raw)) = upper('{PLACE}'))")


@register("e06_c07_focus_monthly_by_code", f"""
SELECT {YEAR('notified_on')} AS year, {MONTH('notified_on')} AS month_start, COUNT(*) AS cases
FROM cases f WHERE {BASE(CLS)} AND {NI('f.state_raw')} IN ('RJ', '33') AND {_CODE_MASK}
GROUP BY 1, 2""")
def e06(spark, sf):
    c = ctx(spark, sf)
    return C.focus_monthly_by_code(c.f, c.r, PLACE_CODE7, PLACE, CLS)


@register("e07_c04_c06_d02_focus_monthly", f"""
SELECT {YEAR('f.notified_on')} AS year, {MONTH('f.notified_on')} AS month_start, COUNT(*) AS cases
{FOCUS_FROM(None, SINCE)} GROUP BY 1, 2""")
def e07(spark, sf):
    c = ctx(spark, sf)
    return C.focus_monthly(c.f, c.r, c.t, PLACE, since=SINCE)


@register("e08_c07_focus_status_by_code", f"""
SELECT {YEAR('notified_on')} AS year, {MONTH('notified_on')} AS month_start,
       {NI('class_raw')} AS classification, {NI('outcome_raw')} AS outcome, COUNT(*) AS cases
FROM cases f WHERE {BASE()} AND {NI('f.state_raw')} IN ('RJ', '33') AND {_CODE_MASK}
GROUP BY 1, 2, 3, 4""")
def e08(spark, sf):
    c = ctx(spark, sf)
    return C.focus_status_by_code(c.f, c.r, PLACE_CODE7, PLACE)


@register("e09_focus_status", f"""
SELECT {YEAR('f.notified_on')} AS year, {MONTH('f.notified_on')} AS month_start,
       {NI('f.class_raw')} AS classification, {NI('f.outcome_raw')} AS outcome, COUNT(*) AS cases
{FOCUS_FROM(CLS)} GROUP BY 1, 2, 3, 4""")
def e09(spark, sf):
    c = ctx(spark, sf)
    return C.focus_status(c.f, c.r, c.t, PLACE, CLS)


@register("e10_population_refs", f"""
SELECT CAST(sum(population) AS BIGINT) AS pop_country,
       CAST(sum(population) FILTER (WHERE upper(state_name) = 'RIO DE JANEIRO') AS BIGINT) AS pop_state,
       CAST(sum(population) FILTER (WHERE upper(place_name) = upper('{PLACE}')) AS BIGINT) AS pop_place
FROM territory""")
def e10(spark, sf):
    c = ctx(spark, sf)
    return C.population_refs(c.t, PLACE)


@register("e11_g02_cases_by_sex", f"""
SELECT {NI('f.sex_raw')} AS sex, COUNT(*) AS cases {FOCUS_FROM(None, SINCE)} GROUP BY 1""")
def e11(spark, sf):
    c = ctx(spark, sf)
    return C.cases_by_sex(c.f, c.r, c.t, PLACE, since=SINCE)


_FAC_DIM = f"""
, facility_labels AS (
  SELECT {FACILITY_KEY('facility_id')} AS label_key,
         COALESCE(max(NULLIF(trim(trade_name), '')), max(NULLIF(trim(company_name), '')), max(NULLIF(trim(legal_name), '')), '') AS label
  FROM facility GROUP BY 1)
"""
_FAC_JOIN = f"LEFT JOIN facility_labels ON label_key = {FACILITY_KEY('f.facility_raw')}"
_FAC_NAME = "COALESCE(label, '')"


def _focus_from_fac(cls=None, since=None):
    base = FOCUS_FROM(cls, since)
    frm, where = base.split(" WHERE ", 1)
    return f"{frm} {_FAC_JOIN} WHERE {where}"


@register("e12_d04_g04_top_facilities", _FAC_DIM + f"""
, agg AS (
SELECT {NI('f.facility_raw')} AS facility, {_FAC_NAME} AS facility_name, COUNT(*) AS cases
{_focus_from_fac(CLS)} GROUP BY 1, 2)
SELECT * FROM agg ORDER BY cases DESC, facility ASC LIMIT 10""")
def e12(spark, sf):
    c = ctx(spark, sf)
    return C.top_facilities(c.f, c.r, c.t, c.fac, PLACE, CLS, top_n=10)


@register("e13_g03_facilities_monthly", _FAC_DIM + f"""
SELECT {YEAR('f.notified_on')} AS year, {MONTH('f.notified_on')} AS month_start,
       {NI('f.facility_raw')} AS facility, {_FAC_NAME} AS facility_name, COUNT(*) AS cases
{_focus_from_fac(None, SINCE)} GROUP BY 1, 2, 3, 4""")
def e13(spark, sf):
    c = ctx(spark, sf)
    return C.facilities_monthly(c.f, c.r, c.t, c.fac, PLACE, since=SINCE)


@register("e14_c15_i07_mean_epi_week", f"""
, b AS (SELECT {WEEK('f.week_raw')} AS week {FOCUS_FROM(CLS)})
SELECT CAST(round(avg(week)) AS INTEGER) AS week_mean FROM b WHERE week BETWEEN 1 AND 53""")
def e14(spark, sf):
    c = ctx(spark, sf)
    return C.mean_epi_week(c.f, c.r, c.t, PLACE, CLS)


@register("e18_hospitalisations_monthly", f"""
SELECT {MONTH('f.notified_on')} AS month_start,
       COUNT(*) FILTER (WHERE {NI('f.hosp_raw')} = '1') AS hospitalisations
{FOCUS_FROM(None, SINCE)} GROUP BY 1""")
def e18(spark, sf):
    c = ctx(spark, sf)
    return C.hospitalisations_monthly(c.f, c.r, c.t, PLACE, since=SINCE)


def _enriched_sql(cls, since, state_scope):
    """Row by row first (place, code, month), then counted with its territory."""
    scope = f" AND list_contains(['RJ', '33'], {NI('f.state_raw')})" if state_scope else ""
    return f"""
, placed AS (SELECT f.notified_on AS day, {NI('f.state_raw')} AS state, {NI('f.place_raw', 'Município não informado')} AS place_code
             FROM cases f WHERE {BASE(cls, since)}{scope})
SELECT {YEAR('day')} AS year, {MONTH('day')} AS month_start, state, place_code, COALESCE(any_value(place_name), place_code) AS place_name,
       COUNT(*) AS cases, any_value(population) AS population, any_value(area_km2) AS area_km2,
       CAST(COUNT(*) AS DOUBLE) / NULLIF(greatest(any_value(population), 0), 0) * 100000.0 AS incidence_100k
FROM placed LEFT JOIN territory ON code6 = {CODE6('place_code')} GROUP BY 1, 2, 3, 4"""


@register("e16_d03_state_places_enriched", _enriched_sql(CLS, None, True))
def e16(spark, sf):
    c = ctx(spark, sf)
    return C.state_places_enriched(c.f, c.r, c.t, CLS)


@register("e17_country_places_enriched", _enriched_sql(None, SINCE, False))
def e17(spark, sf):
    c = ctx(spark, sf)
    return C.country_places_enriched(c.f, c.r, c.t, since=SINCE)


@register("e29_total_rows", "SELECT COUNT(*) AS total FROM cases")
def e29(spark, sf):
    c = ctx(spark, sf)
    return C.total_rows(c.f)


@register("e30_cases_by_period", """
SELECT strftime(onset_on, '%Y-%m') AS period, COUNT(*) AS cases FROM cases
WHERE onset_on IS NOT NULL GROUP BY 1""")
def e30(spark, sf):
    c = ctx(spark, sf)
    return C.cases_by_period(c.f, "onset_on")


@register("e31_compare_periods", """
, a AS (SELECT CAST(count(*) FILTER (WHERE year(notified_on) = 1998) AS DOUBLE) AS cur,
               CAST(count(*) FILTER (WHERE year(notified_on) = 1997) AS DOUBLE) AS ref FROM cases)
SELECT cur AS total_current, ref AS total_reference,
       CASE WHEN ref = 0 THEN 0.0 ELSE (cur - ref) / ref * 100 END AS change_pct FROM a""")
def e31(spark, sf):
    c = ctx(spark, sf)
    y = F.year(c.f.notified_on)
    return C.compare_periods(c.f.filter(y == 1998), c.f.filter(y == 1997))


_POP = f"(SELECT sum(population) FROM territory WHERE upper(place_name) = upper('{PLACE}'))"


@register("e32_h01_three_scope_series", f"""
, ms AS (SELECT {MONTH('notified_on')} AS month_start, {NI('state_raw')} AS state, COUNT(*) AS cases
         FROM cases f WHERE {BASE(CLS)} GROUP BY 1, 2),
mun AS (SELECT {MONTH('f.notified_on')} AS month_start, COUNT(*) AS cases {FOCUS_FROM(CLS)} GROUP BY 1),
pops AS (SELECT sum(population) AS pc,
         sum(population) FILTER (WHERE upper(state_name) = 'RIO DE JANEIRO') AS ps,
         sum(population) FILTER (WHERE upper(place_name) = upper('{PLACE}')) AS pp FROM territory),
u AS (
  SELECT 'BR' AS scope, month_start, CAST(sum(cases) AS BIGINT) AS cases, (SELECT pc FROM pops) AS pop
  FROM ms GROUP BY 2
  UNION ALL
  SELECT 'RJ', month_start, CAST(sum(cases) AS BIGINT), (SELECT ps FROM pops)
  FROM ms WHERE upper(trim(state)) IN ('RJ', '33') GROUP BY 2
  UNION ALL
  SELECT 'MUN', month_start, CAST(sum(cases) AS BIGINT), (SELECT pp FROM pops) FROM mun GROUP BY 2)
SELECT scope, month_start, cases,
       CASE WHEN pop > 0 THEN CAST(cases AS DOUBLE) / CAST(pop AS DOUBLE) * 100000.0 END AS incidence_100k
FROM u""")
def e32(spark, sf):
    c = ctx(spark, sf)
    return C.three_scope_series(c.f, c.r, c.t, PLACE, CLS)


_STATUS = f"""
, s AS (SELECT {MONTH('f.notified_on')} AS month_start, {NI('f.class_raw')} AS cl,
        {NI('f.outcome_raw')} AS oc, {NI('f.hosp_raw')} = '1' AS hosp {FOCUS_FROM(None, SINCE)})
"""


@register("e33_period_cards", _STATUS + f"""
, a AS (SELECT COUNT(*) AS notified,
        COUNT(*) FILTER (WHERE cl IN ('1', '3', '4', '5', '6', '10', '11', '12')) AS confirmed,
        COUNT(*) FILTER (WHERE cl = '2') AS discarded, COUNT(*) FILTER (WHERE cl = '8') AS inconclusive,
        COUNT(*) FILTER (WHERE oc = '2') AS deaths, COUNT(*) FILTER (WHERE hosp) AS hospitalisations FROM s)
SELECT confirmed, notified, deaths, hospitalisations,
  CASE WHEN {_POP} > 0 THEN CAST(confirmed AS DOUBLE) / CAST({_POP} AS DOUBLE) * 100000.0 END AS incidence_100k,
  CASE WHEN confirmed > 0 THEN CAST(deaths AS DOUBLE) / CAST(confirmed AS DOUBLE) * 100.0 END AS lethality_pct,
  CAST(greatest(notified - confirmed - discarded - inconclusive, 0) AS BIGINT) AS open_cases
FROM a""")
def e33(spark, sf):
    c = ctx(spark, sf)
    return C.period_cards(c.f, c.r, c.t, PLACE, since=SINCE)


@register("e34_last_month_cards", _STATUS + """
, m AS (SELECT max(month_start) AS ref, CAST(max(month_start) - INTERVAL 1 MONTH AS DATE) AS prev FROM s),
a AS (SELECT
  COUNT(*) FILTER (WHERE cl IN ('1','3','4','5','6','10','11','12') AND month_start = ref) AS confirmed_cur,
  COUNT(*) FILTER (WHERE cl IN ('1','3','4','5','6','10','11','12') AND month_start = prev) AS confirmed_prev,
  COUNT(*) FILTER (WHERE month_start = ref) AS notified_cur, COUNT(*) FILTER (WHERE month_start = prev) AS notified_prev,
  COUNT(*) FILTER (WHERE oc = '2' AND month_start = ref) AS deaths_cur,
  COUNT(*) FILTER (WHERE oc = '2' AND month_start = prev) AS deaths_prev,
  COUNT(*) FILTER (WHERE hosp AND month_start = ref) AS hosp_cur,
  COUNT(*) FILTER (WHERE hosp AND month_start = prev) AS hosp_prev,
  any_value(ref) AS ref
  FROM s, m),
l AS (
  SELECT 'confirmed' AS metric, confirmed_cur AS current, confirmed_prev AS previous, ref FROM a
  UNION ALL SELECT 'notified', notified_cur, notified_prev, ref FROM a
  UNION ALL SELECT 'deaths', deaths_cur, deaths_prev, ref FROM a
  UNION ALL SELECT 'hospitalisations', hosp_cur, hosp_prev, ref FROM a
  UNION ALL SELECT 'open', CAST(greatest(notified_cur - confirmed_cur, 0) AS BIGINT),
                   CAST(greatest(notified_prev - confirmed_prev, 0) AS BIGINT), ref FROM a)
SELECT metric, current, previous,
       CASE WHEN previous IS NOT NULL AND previous <> 0
            THEN (CAST(current AS DOUBLE) - CAST(previous AS DOUBLE)) / CAST(previous AS DOUBLE) * 100.0 END
         AS delta_pct,
       (SELECT ref FROM m) AS month_start
FROM l""")
def e34(spark, sf):
    c = ctx(spark, sf)
    return C.last_month_cards(c.f, c.r, c.t, PLACE, since=SINCE)


@register("e37_c06_rows_in_scope", f"""
SELECT COUNT(*) AS total {FOCUS_FROM()}""")
def e37(spark, sf):
    c = ctx(spark, sf)
    return C.total_rows(S.place_scope(S.notified(c.f, c.r), c.r, c.t, PLACE))


@register("e38_rows_per_year_by_date", f"""
SELECT {YEAR('notified_on')} AS year, COUNT(*) AS rows_by_date FROM cases
WHERE notified_on IS NOT NULL AND year(notified_on) BETWEEN 1996 AND 2000 GROUP BY 1""")
def e38(spark, sf):
    c = ctx(spark, sf)
    return C.rows_per_year_by_date(c.f, c.r, 1996, 2000)


@register("e39_c17_rows_per_year_by_text", """
SELECT TRY_CAST(trim(year_text) AS INTEGER) AS year, COUNT(*) AS rows_by_text FROM cases
WHERE regexp_matches(trim(year_text), '^[0-9]{4}$')
  AND TRY_CAST(trim(year_text) AS INTEGER) BETWEEN 1996 AND 2000 GROUP BY 1""")
def e39(spark, sf):
    c = ctx(spark, sf)
    return C.rows_per_year_by_text(c.f, c.r, 1996, 2000)


@register("e59_yearly_totals", f"""
, y AS (SELECT {YEAR('notified_on')} AS year, COUNT(*) AS cases FROM cases f WHERE {BASE()} GROUP BY 1)
SELECT * FROM y WHERE (SELECT count(*) FROM y) >= 2""")
def e59(spark, sf):
    c = ctx(spark, sf)
    return C.yearly_totals(c.f, c.r)


@register("e69_health_checks", f"""
SELECT {YEAR('notified_on')} AS year, COUNT(*) AS rows,
       COUNT(*) FILTER (WHERE notified_on IS NULL) AS null_dates FROM cases GROUP BY 1""")
def e69(spark, sf):
    c = ctx(spark, sf)
    return C.health_checks(c.f, c.r)


@register("e71_distinct_places", f"""
SELECT DISTINCT {NI('state_raw')} AS value FROM cases""")
def e71(spark, sf):
    c = ctx(spark, sf)
    from surv.functions import expr as X
    return C.distinct_values(c.f, X.ni(c.r.c("state_raw")))


@register("e71_distinct_count", """
SELECT COUNT(DISTINCT place_raw) AS n_distinct FROM cases""")
def e71b(spark, sf):
    c = ctx(spark, sf)
    return C.distinct_count(c.f, c.r.c("place_raw"))


@register("e72_latest_notification", """
SELECT max(notified_on) AS latest_notified FROM cases""")
def e72(spark, sf):
    c = ctx(spark, sf)
    return C.latest_notification(c.f, c.r)
