"""End-to-end native path: raw text extract -> default clean (B09) ->
conform to the fact schema (B10-B16) -> panel operators with NATIVE_ROLES.
Oracles are the fixture-route SQL of the same panels: cleaning and conforming
must not change any panel result."""

from __future__ import annotations

from surv.operators import conform as B
from surv.operators import counts as C
from surv.operators import cubes as CU
from surv.operators import profile as P
from surv.plans import fixtures as FX
from surv.plans import q_counts, q_cubes, q_profile
from surv.plans.registry import ORACLE, PLACE, SINCE, ctx, register
from surv.roles import NATIVE_ROLES


def native_fact(spark, sf):
    return B.conform_fact(B.default_clean(FX.native_raw(spark, sf)))


@register("b10_native_e02_cases_month_state", ORACLE["e02_c01_c02_c03_g01_cases_month_state"], raw_sql=True)
def n02(spark, sf):
    return C.cases_month_state(native_fact(spark, sf), NATIVE_ROLES, since=SINCE)


@register("b10_native_e07_focus_monthly", ORACLE["e07_c04_c06_d02_focus_monthly"], raw_sql=True)
def n07(spark, sf):
    return C.focus_monthly(native_fact(spark, sf), NATIVE_ROLES, ctx(spark, sf).t, PLACE, since=SINCE)


@register("b10_native_e19_demographic_monthly", ORACLE["e19_demographic_monthly"], raw_sql=True)
def n19(spark, sf):
    return P.demographic_monthly(native_fact(spark, sf), NATIVE_ROLES, ctx(spark, sf).t, PLACE, since=SINCE)


@register("b10_native_e24_monthly_indicators", ORACLE["e24_d05_monthly_indicators"], raw_sql=True)
def n24(spark, sf):
    return CU.monthly_indicators(native_fact(spark, sf), NATIVE_ROLES, ctx(spark, sf).t)


@register("b10_native_e12_top_facilities", ORACLE["e12_d04_g04_top_facilities"], raw_sql=True)
def n12(spark, sf):
    from surv.plans.registry import CLS
    c = ctx(spark, sf)
    return C.top_facilities(native_fact(spark, sf), NATIVE_ROLES, c.t, c.fac, PLACE, CLS, top_n=10)


@register("b09_b01_b05_b06_b07_default_clean", """
SELECT CAST(notified_on AS TIMESTAMP) AS data_notific, COALESCE(trim(state_raw), '') AS sg_uf_not,
  COALESCE(trim(class_raw), '') AS classi_fin, COALESCE(trim(place_raw), '') AS municipio,
  COALESCE(trim(pcr_result), '') AS resul_pcr, COUNT(*) AS n
FROM cases GROUP BY 1, 2, 3, 4, 5""")
def b09(spark, sf):
    """Default clean (B09) of the raw extract: snake_case names (RESUL_PCR_
    becomes resul_pcr), stripped text, NULL text to '', and every column
    whose name contains 'data' parsed as a timestamp (the extract's
    notification date is exposed here under such a name)."""
    from pyspark.sql import functions as F
    raw = FX.native_raw(spark, sf).withColumnRenamed("DT_NOTIFIC", "DATA NOTIFIC")
    clean = B.default_clean(raw)
    return (clean.groupBy("data_notific", "sg_uf_not", "classi_fin", "municipio", "resul_pcr")
            .agg(F.count(F.lit(1)).alias("n")))
