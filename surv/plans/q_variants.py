"""Parameter variants of the main loaders: other class lists (with the 'NI'
sentinel), a mid-month lower bound, another municipality of the focus state.
Same operators, same oracle builders -- only the parameters differ."""

from __future__ import annotations

from surv.operators import counts as C
from surv.operators import profile as P
from surv.plans.q_profile import DEMO
from surv.plans.registry import FOCUS_FROM, MONTH, NI, YEAR, ctx, register

CLS2 = ("3", "4", "NI", "10")
SINCE2 = "1998-03-15"          # mid-month: the fact route filters by date (T13)
PLACE2 = "NATION_5"            # another municipality of the focus state


@register("e07_v_cls_since_focus_monthly", f"""
SELECT {YEAR('f.notified_on')} AS year, {MONTH('f.notified_on')} AS month_start, COUNT(*) AS cases
{FOCUS_FROM(CLS2, SINCE2)} GROUP BY 1, 2""")
def v07(spark, sf):
    c = ctx(spark, sf)
    return C.focus_monthly(c.f, c.r, c.t, "NATION_0", CLS2, SINCE2)


@register("e07_v_place2_focus_monthly", f"""
SELECT {YEAR('f.notified_on')} AS year, {MONTH('f.notified_on')} AS month_start, COUNT(*) AS cases
{FOCUS_FROM(None, None, PLACE2)} GROUP BY 1, 2""")
def v07b(spark, sf):
    c = ctx(spark, sf)
    return C.focus_monthly(c.f, c.r, c.t, PLACE2)


@register("e09_v_since_focus_status", f"""
SELECT {YEAR('f.notified_on')} AS year, {MONTH('f.notified_on')} AS month_start,
       {NI('f.class_raw')} AS classification, {NI('f.outcome_raw')} AS outcome, COUNT(*) AS cases
{FOCUS_FROM(None, SINCE2, PLACE2)} GROUP BY 1, 2, 3, 4""")
def v09(spark, sf):
    c = ctx(spark, sf)
    return C.focus_status(c.f, c.r, c.t, PLACE2, since=SINCE2)


@register("e18_v_cls_hospitalisations_monthly", f"""
SELECT {MONTH('f.notified_on')} AS month_start,
       COUNT(*) FILTER (WHERE {NI('f.hosp_raw')} = '1') AS hospitalisations
{FOCUS_FROM(CLS2)} GROUP BY 1""")
def v18(spark, sf):
    c = ctx(spark, sf)
    return C.hospitalisations_monthly(c.f, c.r, c.t, "NATION_0", CLS2)


@register("e19_v_place2_cls_demographic_monthly",
          "\n" + DEMO(FOCUS_FROM(CLS2, None, PLACE2)).replace("SELECT", ", x AS (SELECT", 1) + ") SELECT * FROM x")
def v19(spark, sf):
    c = ctx(spark, sf)
    return P.demographic_monthly(c.f, c.r, c.t, PLACE2, CLS2)


@register("e02_v_cls_cases_month_state", f"""
SELECT {YEAR('notified_on')} AS year, {MONTH('notified_on')} AS month_start,
       {NI('state_raw')} AS state, COUNT(*) AS cases
FROM cases f WHERE notified_on IS NOT NULL AND notified_on >= DATE '{SINCE2}'
  AND {NI('class_raw')} IN ('3', '4', 'NI', '10') GROUP BY 1, 2, 3""")
def v02(spark, sf):
    c = ctx(spark, sf)
    return C.cases_month_state(c.f, c.r, CLS2, SINCE2)
