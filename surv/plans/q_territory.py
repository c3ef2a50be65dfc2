"""Registered territory / risk queries."""

from __future__ import annotations

from surv.operators import counts as C
from surv.operators import territory as T
from surv.plans.q_counts import _FAC_DIM, _FAC_NAME, _enriched_sql, _focus_from_fac
from surv.plans.registry import FOCUS_FROM, MONTH, NI, PLACE, SINCE, YEAR, ctx, register

OTHER_PLACE = "NATION_5"   # another municipality of the focus state


def _en_cte(state_scope=True) -> str:
    text = _enriched_sql(None, SINCE, state_scope)
    i = text.index("\nSELECT ", text.index("placed AS"))
    return text[:i] + ",\nen AS (" + text[i + 1:] + ")\n"


EN = _en_cte()


def _en(c):
    return C.state_places_enriched(c.f, c.r, c.t, since=SINCE)


def _rint(x):
    return f"CAST(COALESCE(round_even({x}, 0), 0) AS BIGINT)"


def PRANK(v):
    return (f"((rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0) "
            f"/ count(*) OVER ())")


@register("e41_place_rollup", EN + f"""
, a AS (SELECT place_name, sum(cases) AS c, avg(incidence_100k) AS i FROM en GROUP BY 1)
SELECT place_name, {_rint('c')} AS cases, {_rint('i')} AS incidence_100k FROM a WHERE c IS NOT NULL""")
def e41(spark, sf):
    return T.place_rollup(_en(ctx(spark, sf)))


@register("e41_place_rollup_total_over_pop", EN + f"""
, a AS (SELECT place_name, sum(cases) AS c,
   CASE WHEN max(population) > 0 THEN CAST(sum(cases) AS DOUBLE) / CAST(max(population) AS DOUBLE) * 100000.0 END AS i
   FROM en GROUP BY 1)
SELECT place_name, {_rint('c')} AS cases, {_rint('i')} AS incidence_100k FROM a WHERE c IS NOT NULL""")
def e41b(spark, sf):
    return T.place_rollup(_en(ctx(spark, sf)), mean_of_monthly=False)


@register("g04_top_places", EN + f"""
, a AS (SELECT place_name, sum(cases) AS c, avg(incidence_100k) AS i FROM en GROUP BY 1)
SELECT place_name, {_rint('c')} AS cases, {_rint('i')} AS incidence_100k FROM a WHERE c IS NOT NULL
ORDER BY cases DESC, place_name LIMIT 5""")
def g04(spark, sf):
    return T.top_places(T.place_rollup(_en(ctx(spark, sf))), n=5)


_FM = _FAC_DIM + f"""
, fm AS (SELECT {MONTH('f.notified_on')} AS month_start, {NI('f.facility_raw')} AS facility,
   {_FAC_NAME} AS facility_name, COUNT(*) AS cases {_focus_from_fac(None, SINCE)} GROUP BY 1, 2, 3),
lab AS (SELECT CASE WHEN trim(facility_name) IS NULL OR trim(facility_name) = '' THEN 'Unidade não identificada'
   ELSE trim(facility_name) END AS facility_label, month_start, cases FROM fm)
"""


def _growth_sql(src: str, key: str) -> str:
    return f"""
, gt AS (SELECT {key}, CAST(sum(cases) AS BIGINT) AS period_cases,
   CAST(COALESCE(sum(cases) FILTER (WHERE month_start = (SELECT min(month_start) FROM {src})), 0) AS BIGINT) AS first_cases,
   CAST(COALESCE(sum(cases) FILTER (WHERE month_start = (SELECT max(month_start) FROM {src})), 0) AS BIGINT) AS last_cases
   FROM {src} GROUP BY 1),
gr AS (SELECT *, CASE WHEN CAST(first_cases AS DOUBLE) <= 0 THEN CASE WHEN CAST(last_cases AS DOUBLE) > 0 THEN 100.0 ELSE 0.0 END
   ELSE (CAST(last_cases AS DOUBLE) - CAST(first_cases AS DOUBLE)) / CAST(first_cases AS DOUBLE) * 100.0 END AS growth_pct
   FROM gt)
"""


def _risk_ctes(key: str) -> str:
    return f"""
, rk AS (SELECT *, greatest(growth_pct, 0.0) AS g0 FROM gr),
rk2 AS (SELECT *, {PRANK('period_cases')} AS vr, {PRANK('g0')} AS grk FROM rk),
rs AS (SELECT {key}, period_cases, first_cases, last_cases, growth_pct,
   round_even(0.6 * vr + 0.4 * grk, 3) AS risk_score FROM rk2),
risk AS (SELECT *, CASE WHEN risk_score >= 0.75 THEN 'Critico' WHEN risk_score >= 0.55 THEN 'Alto'
   WHEN risk_score >= 0.35 THEN 'Moderado' ELSE 'Baixo' END AS risk_band FROM rs)
"""


def _risk_sql(key: str) -> str:
    return _risk_ctes(key) + "SELECT * FROM risk"


@register("f06_d06_facility_growth", _FM + _growth_sql("lab", "facility_label") + "SELECT * FROM gr")
def f06(spark, sf):
    c = ctx(spark, sf)
    fm = T.facility_labels(C.facilities_monthly(c.f, c.r, c.t, c.fac, PLACE, since=SINCE))
    return T.growth_table(fm, "facility_label")


@register("f07_g05_facility_risk", _FM + _growth_sql("lab", "facility_label") + _risk_sql("facility_label"))
def f07(spark, sf):
    c = ctx(spark, sf)
    return T.facility_risk(C.facilities_monthly(c.f, c.r, c.t, c.fac, PLACE, since=SINCE))


@register("f01_pct_rank_average", EN + f"""
, t AS (SELECT place_name, CAST(sum(cases) AS BIGINT) AS cases FROM en GROUP BY 1)
SELECT place_name, cases, {PRANK('cases')} AS pct_rank FROM t""")
def f01(spark, sf):
    c = ctx(spark, sf)
    from pyspark.sql import functions as F
    from surv.operators.ranking import with_pct_rank_average
    t = _en(c).groupBy("place_name").agg(F.sum("cases").cast("bigint").alias("cases"))
    return with_pct_rank_average(t, "cases")


@register("f02_place_ranks", EN + """
, t AS (SELECT place_name, CAST(sum(cases) AS BIGINT) AS cases FROM en GROUP BY 1)
SELECT place_name, cases, CAST(rank() OVER (ORDER BY cases DESC) AS INTEGER) AS rank FROM t""")
def f02(spark, sf):
    return T.place_ranks(_en(ctx(spark, sf)))


@register("f03_place_positions", EN + """
, t AS (SELECT place_name, CAST(sum(cases) AS BIGINT) AS cases FROM en GROUP BY 1)
SELECT place_name, cases, CAST(row_number() OVER (ORDER BY cases DESC, place_name) AS INTEGER) AS position FROM t""")
def f03(spark, sf):
    return T.place_positions(_en(ctx(spark, sf)))


_MUN = f"""
, mun AS (SELECT {MONTH('f.notified_on')} AS month_start, COUNT(*) AS cases {FOCUS_FROM()} GROUP BY 1)
"""


@register("f04_previous_month", _MUN + """
SELECT m.month_start, m.cases, CAST(COALESCE(p.cases, 0) AS BIGINT) AS previous,
  CASE WHEN COALESCE(p.cases, 0) <> 0 THEN (CAST(m.cases AS DOUBLE) - CAST(COALESCE(p.cases, 0) AS DOUBLE))
       / CAST(COALESCE(p.cases, 0) AS DOUBLE) * 100.0 END AS delta_pct
FROM mun m LEFT JOIN mun p ON CAST(p.month_start + INTERVAL 1 MONTH AS DATE) = m.month_start""")
def f04(spark, sf):
    c = ctx(spark, sf)
    s = C.focus_monthly(c.f, c.r, c.t, PLACE).select("month_start", "cases")
    return T.with_previous_month(s)


@register("f05_d07_place_share_of_state", EN + """
, t AS (SELECT state, place_name, CAST(sum(cases) AS BIGINT) AS cases FROM en GROUP BY 1, 2)
SELECT *, cases / sum(cases) OVER (PARTITION BY state) * 100.0 AS share_pct FROM t""")
def f05(spark, sf):
    return T.place_share_of_state(_en(ctx(spark, sf)))


@register("l01_place_growth", EN + _growth_sql("en", "place_name") + "SELECT * FROM gr")
def l01(spark, sf):
    return T.place_growth(_en(ctx(spark, sf)))


@register("l02_management_table", EN + f"""
, a AS (SELECT place_name, sum(cases) AS c, avg(incidence_100k) AS i FROM en GROUP BY 1),
roll AS (SELECT place_name, {_rint('c')} AS cases, {_rint('i')} AS incidence_100k FROM a WHERE c IS NOT NULL)
{_growth_sql("en", "place_name")}{_risk_ctes("place_name")}
SELECT roll.*, risk.growth_pct, risk.risk_score, risk.risk_band FROM roll LEFT JOIN risk USING (place_name)""")
def l02(spark, sf):
    return T.management_table(_en(ctx(spark, sf)))


@register("l03_window_acceleration", _MUN + """
, m AS (SELECT max(month_start) AS ref FROM mun),
a AS (SELECT
  CAST(COALESCE(sum(cases) FILTER (WHERE month_start > CAST(ref - INTERVAL 3 MONTH AS DATE) AND month_start <= ref), 0) AS BIGINT) AS current,
  CAST(COALESCE(sum(cases) FILTER (WHERE month_start > CAST(ref - INTERVAL 6 MONTH AS DATE)
       AND month_start <= CAST(ref - INTERVAL 3 MONTH AS DATE)), 0) AS BIGINT) AS previous FROM mun, m),
b AS (SELECT *, CASE WHEN previous = 0 THEN 0.0 ELSE (CAST(current AS DOUBLE) - CAST(previous AS DOUBLE))
  / CAST(previous AS DOUBLE) * 100.0 END AS change_pct FROM a)
SELECT *, CAST(sign(change_pct) AS INTEGER) AS acceleration FROM b""")
def l03(spark, sf):
    c = ctx(spark, sf)
    return T.window_acceleration(C.focus_monthly(c.f, c.r, c.t, PLACE), 3)


@register("l04_drill_down", EN + """
SELECT state, place_name, CAST(sum(cases) AS BIGINT) AS cases, CAST(GROUPING(state, place_name) AS INTEGER) AS level
FROM en GROUP BY ROLLUP (state, place_name)""")
def l04(spark, sf):
    return T.drill_down(_en(ctx(spark, sf)))


@register("e70_two_place_series", EN + f"""
SELECT month_start, place_name, CAST(sum(cases) AS BIGINT) AS cases FROM en
WHERE place_name IN ('{PLACE}', '{OTHER_PLACE}') GROUP BY 1, 2""")
def e70(spark, sf):
    return T.two_place_series(_en(ctx(spark, sf)), PLACE, OTHER_PLACE)


@register("e70_two_place_summary", EN + f"""
, s AS (SELECT month_start, place_name, CAST(sum(cases) AS BIGINT) AS cases FROM en
  WHERE place_name IN ('{PLACE}', '{OTHER_PLACE}') GROUP BY 1, 2),
p AS (SELECT place_name, CAST(sum(cases) AS BIGINT) AS total_cases, arg_min(cases, month_start) AS f,
  arg_max(cases, month_start) AS l FROM s GROUP BY 1),
g AS (SELECT *, CAST(COALESCE(round_even(CASE WHEN CAST(f AS DOUBLE) <= 0 THEN CASE WHEN CAST(l AS DOUBLE) > 0 THEN 100.0 ELSE 0.0 END
  ELSE (CAST(l AS DOUBLE) - CAST(f AS DOUBLE)) / CAST(f AS DOUBLE) * 100.0 END, 0), 0) AS BIGINT) AS growth_pct FROM p),
d AS (SELECT COALESCE((SELECT total_cases FROM p WHERE place_name = '{PLACE}'), 0)
           - COALESCE((SELECT total_cases FROM p WHERE place_name = '{OTHER_PLACE}'), 0) AS diff)
SELECT place_name, total_cases, growth_pct,
  CAST(CASE WHEN place_name = '{PLACE}' THEN diff ELSE -diff END AS BIGINT) AS diff_vs_other FROM g, d""")
def e70b(spark, sf):
    return T.two_place_summary(_en(ctx(spark, sf)), PLACE, OTHER_PLACE)


@register("d08_f08_last_n_months", f"""
, ms AS (SELECT {MONTH('notified_on')} AS month_start, {NI('state_raw')} AS state, COUNT(*) AS cases
         FROM cases f WHERE notified_on IS NOT NULL GROUP BY 1, 2),
ser AS (SELECT CASE WHEN state IN ('RJ', '33') THEN 'RJ' ELSE 'OTHER' END AS scope, month_start, cases FROM ms),
r AS (SELECT max(month_start) AS ref FROM ser),
spine AS (SELECT s.scope, CAST(unnest(generate_series(CAST(r.ref - INTERVAL 11 MONTH AS DATE), r.ref, INTERVAL 1 MONTH)) AS DATE)
  AS month_start FROM (SELECT DISTINCT scope FROM ser) s, r),
agg AS (SELECT scope, month_start, sum(cases) AS v FROM ser GROUP BY 1, 2)
SELECT spine.scope, spine.month_start, {_rint('agg.v')} AS cases
FROM spine LEFT JOIN agg USING (scope, month_start)""")
def d08(spark, sf):
    c = ctx(spark, sf)
    from pyspark.sql import functions as F
    ms = C.cases_month_state(c.f, c.r)
    ser = ms.select(F.when(F.col("state").isin("RJ", "33"), "RJ").otherwise("OTHER").alias("scope"),
                    "month_start", "cases")
    return T.last_n_months(ser, 12)
