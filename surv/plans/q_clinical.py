"""Registered clinical and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from surv.functions import expr as X
from surv.operators import clinical as CL
from surv.operators import evaluation as EV
from surv.plans.registry import CLS, FOCUS_FROM, MONTH, NI, PLACE, SINCE, ctx, register
from surv.plans.q_counts import _FAC_DIM, _FAC_JOIN, _FAC_NAME


def _clin(c):
    return CL.clinical_extract(c.f, c.r, c.t, PLACE, since=SINCE)


def _eval(c):
    return EV.evaluation_extract(c.f, c.r, c.t, c.fac, PLACE, since=SINCE)


_EXT = f"""
, ext AS (SELECT f.notified_on, f.class_raw, f.outcome_raw, f.hosp_raw, f.fever, f.headache, f.myalgia,
   f.diabetes, f.hypertension, f.renal, f.ns1_on, f.ns1_result, f.pcr_on, f.pcr_result, f.serotype_raw,
   {MONTH('f.notified_on')} AS month_start {FOCUS_FROM(None, SINCE)})
"""


@register("e22_b19_clinical_extract", _EXT + "SELECT * FROM ext")
def e22(spark, sf):
    return _clin(ctx(spark, sf))


def _yes(c):
    return f"trim({c}) IN ('1', 'S', 'SIM')"


def _pct(n, t):
    return f"CASE WHEN {t} > 0 THEN CAST({n} AS DOUBLE) / CAST({t} AS DOUBLE) * 100.0 ELSE 0.0 END"


_SYM = ("fever", "headache", "myalgia")


@register("e50_symptom_frequency", _EXT + f"""
, a AS (SELECT COUNT(*) AS t, {', '.join(f"COUNT(*) FILTER (WHERE {_yes(s)}) AS {s}" for s in _SYM)} FROM ext)
{' UNION ALL '.join(f"SELECT '{s}' AS symptom, {s} AS cases, {_pct(s, 't')} AS pct FROM a" for s in _SYM)}""")
def e50(spark, sf):
    c = ctx(spark, sf)
    return CL.symptom_frequency(_clin(c), c.r)


@register("e51_symptom_combinations", _EXT + """
, p AS (SELECT concat_ws(' + ', CASE WHEN trim(fever) = '1' THEN 'fever' END,
          CASE WHEN trim(headache) = '1' THEN 'headache' END,
          CASE WHEN trim(myalgia) = '1' THEN 'myalgia' END) AS pattern FROM ext)
SELECT CASE WHEN pattern = '' THEN 'Sem padrão clínico' ELSE pattern END AS pattern, COUNT(*) AS cases
FROM p GROUP BY 1""")
def e51(spark, sf):
    c = ctx(spark, sf)
    return CL.symptom_combinations(_clin(c), c.r)


_DONE = ("((trim(ns1_result) IN ('1','2','3')) IS TRUE OR ns1_on IS NOT NULL "
         "OR (trim(pcr_result) IN ('1','2','3')) IS TRUE OR pcr_on IS NOT NULL)")
_POS = "(trim(ns1_result) = '1' OR trim(pcr_result) = '1') IS TRUE"


@register("e52_exam_summary", _EXT + f"""
, a AS (SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE {_DONE}) AS tested,
   COUNT(*) FILTER (WHERE {_DONE} AND {_POS}) AS positives FROM ext)
SELECT total, tested, positives, {_pct('tested', 'total')} AS pct_tested,
  {_pct('positives', 'tested')} AS positivity_pct, 100.0 - {_pct('tested', 'total')} AS pct_untested FROM a""")
def e52(spark, sf):
    c = ctx(spark, sf)
    return CL.exam_summary(_clin(c), c.r)


_CONF = "trim(class_raw) IN ('1','3','4','5','6','10','11','12')"


@register("e53_symptom_by_status", _EXT + f"""
, a AS (SELECT {', '.join(f"COUNT(*) FILTER (WHERE {_yes(s)} AND {_CONF}) AS c_{s}, COUNT(*) FILTER (WHERE {_yes(s)} AND trim(class_raw) = '2') AS d_{s}" for s in _SYM)} FROM ext)
{' UNION ALL '.join(f"SELECT '{s}' AS symptom, 'Confirmados' AS status, c_{s} AS cases FROM a UNION ALL SELECT '{s}', 'Descartados', d_{s} FROM a" for s in _SYM)}""")
def e53(spark, sf):
    c = ctx(spark, sf)
    return CL.symptom_by_status(_clin(c), c.r)


_CM = ("diabetes", "hypertension", "renal")


@register("e54_comorbidity_frequency", _EXT + f"""
, a AS (SELECT COUNT(*) AS t, {', '.join(f"COUNT(*) FILTER (WHERE trim({m}) = '1') AS {m}" for m in _CM)} FROM ext)
{' UNION ALL '.join(f"SELECT '{m}' AS code, '{m}' AS label, {m} AS cases, {_pct(m, 't')} AS pct FROM a" for m in _CM)}""")
def e54(spark, sf):
    c = ctx(spark, sf)
    return CL.comorbidity_frequency(_clin(c), c.r)


def _exam_rows(incl: bool) -> str:
    parts = []
    for key, res, dte, lbl in (("ns1", "ns1_result", "ns1_on", "NS1"), ("pcr", "pcr_result", "pcr_on", "RT-PCR")):
        done = f"((trim({res}) IN ('1','2','3')) IS TRUE OR {dte} IS NOT NULL)"
        mets = [("Realizados", done), ("Positivos", f"trim({res}) = '1'"), ("Negativos", f"trim({res}) = '2'"),
                ("Não realizados", f"({res} IS NULL OR trim({res}) = '' OR trim({res}) = '4')")]
        if incl:
            mets.append(("Inconclusivos", f"trim({res}) = '3'"))
        for m, cond in mets:
            parts.append(f"SELECT '{lbl}' AS exam, '{m}' AS metric, COUNT(*) FILTER (WHERE {cond}) AS value FROM ext")
    return " UNION ALL ".join(parts)


@register("e55_exam_results", _EXT + _exam_rows(False))
def e55(spark, sf):
    c = ctx(spark, sf)
    return CL.exam_results(_clin(c), c.r)


@register("l06_exam_results_inconclusive", _EXT + _exam_rows(True))
def l06(spark, sf):
    c = ctx(spark, sf)
    return CL.exam_results(_clin(c), c.r, with_inconclusive=True)


@register("e56_tested_share_monthly", _EXT + f"""
, g AS (SELECT month_start, COUNT(*) AS total, COUNT(*) FILTER (WHERE {_DONE}) AS tested FROM ext GROUP BY 1)
SELECT *, {_pct('tested', 'total')} AS pct FROM g""")
def e56(spark, sf):
    c = ctx(spark, sf)
    return CL.tested_share_monthly(_clin(c), c.r)


@register("e57_c20_serotype_counts", _EXT + """
SELECT 'DEN ' || trim(serotype_raw) AS serotype, COUNT(*) AS cases FROM ext
WHERE trim(serotype_raw) IN ('1','2','3','4') GROUP BY 1""")
def e57(spark, sf):
    c = ctx(spark, sf)
    return CL.serotype_counts(_clin(c), c.r)


@register("e58_severity_by_exam_result", _EXT + """
, x AS (SELECT CASE WHEN (trim(ns1_result) = '1' OR trim(pcr_result) = '1') IS TRUE THEN 'Positivo'
   WHEN (trim(ns1_result) = '2' OR trim(pcr_result) = '2') IS TRUE THEN 'Negativo'
   WHEN (trim(ns1_result) = '3' OR trim(pcr_result) = '3') IS TRUE THEN 'Inconclusivo'
   WHEN ns1_on IS NOT NULL OR pcr_on IS NOT NULL THEN 'Com coleta (sem resultado)' ELSE 'Sem exame' END AS r,
   (trim(hosp_raw) = '1') IS TRUE AS h,
   (trim(outcome_raw) IN ('2','3','4') OR upper(trim(outcome_raw)) LIKE '%OBITO%') IS TRUE AS d FROM ext),
g AS (SELECT r, COUNT(*) FILTER (WHERE h) AS h, COUNT(*) FILTER (WHERE d) AS d FROM x GROUP BY 1)
SELECT r AS exam_result, 'Internações' AS metric, h AS value FROM g
UNION ALL SELECT r, 'Óbitos', d FROM g""")
def e58(spark, sf):
    c = ctx(spark, sf)
    return CL.severity_by_exam_result(_clin(c), c.r)


@register("e42_class_groups_text", _EXT + """
SELECT CASE WHEN trim(class_raw) IN ('1','3','4','5','6','10','11','12') THEN 'Confirmados'
            WHEN trim(class_raw) = '2' THEN 'Descartados' WHEN trim(class_raw) = '8' THEN 'Inconclusivos'
            ELSE 'Em investigação' END AS class_group, COUNT(*) AS cases FROM ext GROUP BY 1""")
def e42t(spark, sf):
    c = ctx(spark, sf)
    return CL.class_groups_text(_clin(c), c.r)


# ---- evaluation --------------------------------------------------------------
def _evfrom():
    base = FOCUS_FROM(None, SINCE)
    frm, where = base.split(" WHERE ", 1)
    return f"{frm} {_FAC_JOIN} WHERE {where}"


_EV = _FAC_DIM + f"""
, ev AS (SELECT f.notified_on, f.onset_on, f.closed_on, f.class_raw, f.outcome_raw, f.hosp_raw, f.facility_raw,
   f.sex_raw, f.age_raw, f.race_raw, f.school_raw, f.pregnant_raw, f.ns1_result, f.pcr_result, f.ns1_on, f.pcr_on,
   {_FAC_NAME} AS facility_name, {MONTH('f.notified_on')} AS month_start {_evfrom()})
"""
_OD = "date_diff('day', onset_on, notified_on)"
_CD = "date_diff('day', notified_on, closed_on)"


@register("e23_b18_b19_evaluation_extract", _EV + "SELECT * FROM ev")
def e23(spark, sf):
    return _eval(ctx(spark, sf))


@register("e60_mean_onset_delay", _EV + f"SELECT avg({_OD}) AS mean_days FROM ev WHERE {_OD} BETWEEN 0 AND 180")
def e60(spark, sf):
    c = ctx(spark, sf)
    return EV.mean_onset_delay(_eval(c), c.r)


@register("e60_mean_onset_delay_monthly", _EV + f"""
SELECT month_start, avg({_OD}) AS mean_days FROM ev WHERE {_OD} BETWEEN 0 AND 180 GROUP BY 1""")
def e60m(spark, sf):
    c = ctx(spark, sf)
    return EV.mean_onset_delay_monthly(_eval(c), c.r)


@register("e61_mean_closure_delay", _EV + f"SELECT avg({_CD}) AS mean_days FROM ev WHERE {_CD} BETWEEN 0 AND 365")
def e61(spark, sf):
    c = ctx(spark, sf)
    return EV.mean_closure_delay(_eval(c), c.r)


@register("e61_mean_closure_delay_monthly", _EV + f"""
SELECT month_start, avg({_CD}) AS mean_days FROM ev WHERE {_CD} BETWEEN 0 AND 365 GROUP BY 1""")
def e61m(spark, sf):
    c = ctx(spark, sf)
    return EV.mean_closure_delay_monthly(_eval(c), c.r)


@register("e62_closed_split", _EV + """
, a AS (SELECT COUNT(*) AS t, COUNT(closed_on) AS c FROM ev),
b AS (SELECT *, CASE WHEN t > 0 THEN CAST(c AS DOUBLE) / CAST(t AS DOUBLE) * 100.0 END AS pct_closed FROM a)
SELECT 'Encerrados' AS status, c AS cases, pct_closed FROM b
UNION ALL SELECT 'Em investigação', t - c, pct_closed FROM b""")
def e62(spark, sf):
    c = ctx(spark, sf)
    return EV.closed_split(_eval(c), c.r)


_HASX = ("((trim(ns1_result) IN ('1','2','3','4')) IS TRUE OR (trim(pcr_result) IN ('1','2','3','4')) IS TRUE "
         "OR ns1_on IS NOT NULL OR pcr_on IS NOT NULL)")


@register("e63_exam_share", _EV + f"""
SELECT CASE WHEN COUNT(*) > 0 THEN CAST(COUNT(*) FILTER (WHERE {_HASX}) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) * 100.0 END
  AS pct_with_exam FROM ev""")
def e63(spark, sf):
    c = ctx(spark, sf)
    return EV.exam_share(_eval(c), c.r)


def _filled(col, is_date):
    if is_date:
        return f"{col} IS NOT NULL"
    return f"(upper(trim({col})) NOT IN ('', 'NI', 'NULL', 'NONE')) IS TRUE"


_QF = (("onset_on", True), ("closed_on", True), ("class_raw", False), ("outcome_raw", False),
       ("hosp_raw", False), ("sex_raw", False), ("race_raw", False), ("school_raw", False))
_QL = {"hosp_raw": "Hospitalização", "outcome_raw": "Evolução do caso", "closed_on": "Data de encerramento",
       "class_raw": "Classificação final", "school_raw": "Escolaridade", "onset_on": "Data dos primeiros sintomas",
       "race_raw": "Raça/Cor", "sex_raw": "Sexo"}


@register("e64_completeness_score", _EV + f"""
SELECT avg(CAST({' + '.join(f"CASE WHEN {_filled(c, d)} THEN 1 ELSE 0 END" for c, d in _QF)} AS DOUBLE) / 8.0) * 100.0
  AS completeness_pct FROM ev""")
def e64(spark, sf):
    c = ctx(spark, sf)
    return EV.completeness_score(_eval(c), c.r)


@register("e65_missing_rates", _EV + f"""
, a AS (SELECT {', '.join(f"avg(CASE WHEN NOT ({_filled(c, d)}) THEN 1 ELSE 0 END) AS m_{c}" for c, d in _QF)} FROM ev),
l AS ({' UNION ALL '.join(f"SELECT '{c}' AS field, '{_QL[c]}' AS label, m_{c} * 100.0 AS missing_pct FROM a" for c, _ in _QF)})
SELECT * FROM l ORDER BY missing_pct DESC, field LIMIT 10""")
def e65(spark, sf):
    c = ctx(spark, sf)
    return EV.missing_rates(_eval(c), c.r)


_BANDS_SQL = f"""
, delay AS (SELECT {_CD} AS days FROM ev WHERE {_CD} BETWEEN 0 AND 365),
band AS (SELECT unnest(['0-3', '4-7', '8-15', '+15']) AS band, unnest([0, 4, 8, 16]) AS lo, unnest([3, 7, 15, 365]) AS hi, unnest([0, 1, 2, 3]) AS band_order)
SELECT band, COUNT(days) AS cases, CAST(band_order AS INTEGER) AS band_order FROM band LEFT JOIN delay ON days BETWEEN lo AND hi GROUP BY 1, 3"""


@register("e66_v_band_without_a_case", _EV + _BANDS_SQL.replace("BETWEEN 0 AND 365)", "BETWEEN 0 AND 365 AND NOT " + f"{_CD} BETWEEN 4 AND 7)", 1))
def e66v(spark, sf):
    """A scope in which one band has no case: it is a row with 0."""
    c = ctx(spark, sf)
    ext = _eval(c)
    return EV.delay_bands(ext.filter(~F.coalesce(X.days_between(c.r.c("closed_on"), c.r.c("notified_on")).between(4, 7), F.lit(False))), c.r)


@register("e66_g06_delay_bands", _EV + _BANDS_SQL)
def e66(spark, sf):
    c = ctx(spark, sf)
    return EV.delay_bands(_eval(c), c.r)


@register("e67_tested_monthly", _EV + f"""
, g AS (SELECT month_start, COUNT(*) AS t, COUNT(*) FILTER (WHERE {_HASX}) AS w FROM ev GROUP BY 1)
SELECT month_start, 'Com exame' AS status, w AS cases FROM g UNION ALL SELECT month_start, 'Sem exame', t - w FROM g""")
def e67(spark, sf):
    c = ctx(spark, sf)
    return EV.tested_monthly(_eval(c), c.r)


@register("e68_slowest_facilities", _EV + f"""
SELECT facility_name AS facility, round_even(avg({_CD}), 1) AS mean_days, COUNT(*) AS cases FROM ev
WHERE {_CD} BETWEEN 0 AND 365 GROUP BY 1 ORDER BY mean_days DESC, facility LIMIT 10""")
def e68(spark, sf):
    c = ctx(spark, sf)
    return EV.slowest_facilities(_eval(c), c.r, top_n=10)
