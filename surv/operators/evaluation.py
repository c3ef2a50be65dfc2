"""Evaluation / timeliness panel.

Works on a case-level extract (E23) carrying the facility's best name.  The
facility dimension is collapsed to one row per id before the (size-checked
broadcast) join; per-field loops are one aggregate plus an ``explode``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surv.functions import codes as K
from surv.functions import expr as X
from surv.operators import scope as S
from surv.roles import Roles


def evaluation_extract(f: DataFrame, r: Roles, territory: DataFrame, facility: DataFrame | None,
                       place: str, cls: Sequence[str] | None = None,
                       since: str | None = None) -> DataFrame:
    """Case-level evaluation columns for a place, the facility's best
    name (D04; '' when unknown) and ``month_start``."""
    r = r.bind(f)
    g = S.place_scope(S.base(f, r, cls, since), r, territory, place)
    wanted = [r.notified_on, r.onset_on, r.closed_on, r.class_raw, r.outcome_raw, r.hosp_raw,
              r.facility_raw, r.sex_raw, r.age_raw, r.race_raw, r.school_raw, r.pregnant_raw]
    ex = [(res, dte) for k, (res, dte) in r.exams.items() if k in _eval_exam_keys(r)]
    wanted += [res for res, _ in ex] + [dte for _, dte in ex if dte]
    seen, cols = set(), []
    for c in wanted:
        if c and c.lower() not in seen and c in g.columns:
            seen.add(c.lower())
            cols.append(F.col(c).alias(c.lower()))
    out = g.select(*cols)
    if facility is not None and r.facility_raw:
        out = S.join_facility_name(out, F.col(r.facility_raw.lower()), facility)
    else:
        out = out.withColumn("facility_name", F.lit(""))
    return out.withColumn("month_start", X.month_start(F.col(r.notified_on.lower())))


def _eval_exam_keys(r: Roles) -> tuple[str, ...]:
    keys = tuple(k for k in r.exams if k in K.EVALUATION_EXAMS)
    return keys if keys else tuple(r.exams)


def _c(r: Roles, role: str) -> Column:
    return F.col(getattr(r, role).lower())


def _onset_delay(r: Roles) -> Column:
    return X.days_between(_c(r, "notified_on"), _c(r, "onset_on"))


def _closure_delay(r: Roles) -> Column:
    return X.days_between(_c(r, "closed_on"), _c(r, "notified_on"))


def mean_onset_delay(ext: DataFrame, r: Roles) -> DataFrame:
    """E60 overall: mean days onset -> notification within 0..180."""
    d = _onset_delay(r)
    return ext.filter(d.between(0, K.ONSET_DELAY_MAX)).agg(F.avg(d).alias("mean_days"))


def mean_onset_delay_monthly(ext: DataFrame, r: Roles) -> DataFrame:
    """E60 monthly."""
    d = _onset_delay(r)
    return ext.filter(d.between(0, K.ONSET_DELAY_MAX)).groupBy("month_start").agg(F.avg(d).alias("mean_days"))


def mean_closure_delay(ext: DataFrame, r: Roles) -> DataFrame:
    """E61 overall: mean days notification -> closure within 0..365."""
    d = _closure_delay(r)
    return ext.filter(d.between(0, K.CLOSURE_DELAY_MAX)).agg(F.avg(d).alias("mean_days"))


def mean_closure_delay_monthly(ext: DataFrame, r: Roles) -> DataFrame:
    """E61 monthly."""
    d = _closure_delay(r)
    return ext.filter(d.between(0, K.CLOSURE_DELAY_MAX)).groupBy("month_start").agg(F.avg(d).alias("mean_days"))


def closed_split(ext: DataFrame, r: Roles) -> DataFrame:
    """Percent closed and the closed / open split (long form)."""
    a = ext.agg(F.count(F.lit(1)).alias("_t"), F.count(_c(r, "closed_on")).alias("_c"))
    a = a.withColumn("pct_closed", X.guarded_ratio("_c", "_t", 100))
    arr = F.array(F.struct(F.lit(K.CLOSED_LABELS[0]).alias("status"), F.col("_c").alias("cases")),
                  F.struct(F.lit(K.CLOSED_LABELS[1]).alias("status"), (F.col("_t") - F.col("_c")).alias("cases")))
    return a.select("pct_closed", F.explode(arr).alias("x")).select("x.status", "x.cases", "pct_closed")


def has_exam(ext: DataFrame, r: Roles) -> Column:
    """T11 evaluation rule: any of the 4 exams with result 1-4 or a date."""
    cond = F.lit(False)
    for k in _eval_exam_keys(r):
        res, dte = r.exams[k]
        if res.lower() in ext.columns:
            cond = cond | F.coalesce(F.trim(F.col(res.lower())).isin(*K.EXAM_DONE_EVALUATION), F.lit(False))
        if dte and dte.lower() in ext.columns:
            cond = cond | F.col(dte.lower()).isNotNull()
    return cond


def exam_share(ext: DataFrame, r: Roles) -> DataFrame:
    """Percent of cases with an exam."""
    return ext.agg(X.guarded_ratio(F.count_if(has_exam(ext, r)), F.count(F.lit(1)), 100).alias("pct_with_exam"))


def _filled(ext: DataFrame, col: str) -> Column:
    """Field filled: dates not NULL; text not blank / NI / NULL / NONE
    (a missing text reads as 'None' in the dashboard, so it is unfilled)."""
    if dict(ext.dtypes)[col] in ("date", "timestamp", "timestamp_ntz"):
        return F.col(col).isNotNull()
    t = F.upper(F.trim(F.col(col)))
    return F.coalesce(~t.isin(*K.MISSING_TOKENS), F.lit(False))


def _quality_fields(ext: DataFrame, r: Roles) -> list[tuple[str, str]]:
    out = []
    for role in K.QUALITY_FIELDS:
        c = getattr(r, role, None)
        if c and c.lower() in ext.columns:
            out.append((role, c.lower()))
    return out


def completeness_score(ext: DataFrame, r: Roles) -> DataFrame:
    """Mean share of filled critical fields, in percent (NULL where the
    extract has none of them)."""
    qf = _quality_fields(ext, r)
    if not qf:
        return ext.agg(F.max(F.lit(None).cast("double")).alias("completeness_pct"))
    score = sum((X.as_int_flag(_filled(ext, c)) for _, c in qf), F.lit(0)).cast("double") / float(len(qf))
    return ext.agg((F.avg(score) * 100.0).alias("completeness_pct"))


def missing_rates(ext: DataFrame, r: Roles, top_n: int = 10) -> DataFrame:
    """Missing rate per field, worst first, top ``top_n`` (no row where the
    extract has none of the critical fields)."""
    qf = _quality_fields(ext, r)
    if not qf:
        return ext.sparkSession.createDataFrame([], "field string, label string, missing_pct double")
    a = ext.agg(*[F.avg(X.as_int_flag(~_filled(ext, c))).alias(f"_m{i}") for i, (_, c) in enumerate(qf)])
    arr = F.array(*[F.struct(F.lit(c).alias("field"), F.lit(K.QUALITY_FIELD_LABELS.get(role, c)).alias("label"),
                             (F.col(f"_m{i}") * 100.0).alias("missing_pct"))
                    for i, (role, c) in enumerate(qf)])
    return (a.select(F.explode(arr).alias("x")).select("x.*")
            .orderBy(F.desc("missing_pct"), "field").limit(top_n))


def delay_bands(ext: DataFrame, r: Roles) -> DataFrame:
    """Closure delay (0..365) in bands 0-3, 4-7, 8-15, +15; a band without
    a case is a row with 0."""
    d = _closure_delay(r)
    low, per = 0, []
    for label, high in K.DELAY_BANDS:
        top = K.CLOSURE_DELAY_MAX if high is None else high
        per.append((label, F.count_if(d.between(low, top))))
        low = top + 1
    a = ext.agg(*[c.alias(f"_b{i}") for i, (_, c) in enumerate(per)])
    rows = F.array(*[F.struct(F.lit(label).alias("band"), F.col(f"_b{i}").alias("cases"), F.lit(i).alias("band_order")) for i, (label, _) in enumerate(per)])
    return a.select(F.explode(rows).alias("x")).select("x.band", "x.cases", "x.band_order").orderBy("band_order")


def tested_monthly(ext: DataFrame, r: Roles) -> DataFrame:
    """Tested and untested per month, long form."""
    g = ext.groupBy("month_start").agg(F.count(F.lit(1)).alias("_t"), F.count_if(has_exam(ext, r)).alias("_w"))
    arr = F.array(F.struct(F.lit(K.TESTED_LABELS[0]).alias("status"), F.col("_w").alias("cases")),
                  F.struct(F.lit(K.TESTED_LABELS[1]).alias("status"), (F.col("_t") - F.col("_w")).alias("cases")))
    return g.select("month_start", F.explode(arr).alias("x")).select("month_start", "x.status", "x.cases")


def slowest_facilities(ext: DataFrame, r: Roles, top_n: int = 10) -> DataFrame:
    """Mean closure delay per facility name (banker's rounding to one
    decimal, as pandas), case count, slowest ``max(5, top_n)`` first."""
    d = _closure_delay(r)
    key = "facility_name" if "facility_name" in ext.columns else r.facility_raw.lower()
    g = (ext.filter(d.between(0, K.CLOSURE_DELAY_MAX)).groupBy(F.col(key).alias("facility"))
         .agg(F.bround(F.avg(d), 1).alias("mean_days"), F.count(F.lit(1)).alias("cases")))
    return g.orderBy(F.desc("mean_days"), "facility").limit(max(5, int(top_n)))
