"""Clinical and exams panel.

The panel works on a case-level extract (E22).  Every per-symptom /
per-exam loop of the dashboard is one aggregate with one conditional count
per item, followed by an ``explode`` of a literal array to long form.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surv.functions import codes as K
from surv.functions import expr as X
from surv.operators import scope as S
from surv.roles import Roles


def clinical_extract(f: DataFrame, r: Roles, territory: DataFrame, place: str,
                     cls: Sequence[str] | None = None, since: str | None = None) -> DataFrame:
    """Case-level clinical columns for a place, plus ``month_start``.

    Only columns the fact has are selected (B19), with lower-case names."""
    r = r.bind(f)
    g = S.place_scope(S.base(f, r, cls, since), r, territory, place)
    wanted = [r.notified_on, r.class_raw, r.outcome_raw, r.hosp_raw]
    wanted += list(r.symptoms.values()) + list(r.comorbidities.values())
    for res, dte in r.exams.values():
        wanted += [dte, res] if dte else [res]
    wanted.append(r.serotype_raw)
    seen, cols = set(), []
    for c in wanted:
        if c and c.lower() not in seen and c in g.columns:
            seen.add(c.lower())
            cols.append(F.col(c).alias(c.lower()))
    return g.select(*cols, X.month_start(r.c("notified_on")).alias("month_start"))


def _yes(c: str, accepted=K.YES_SYMPTOM) -> Column:
    # dashboard test: stripped text in the accepted set (no case folding)
    return F.coalesce(F.trim(F.col(c)).isin(*accepted), F.lit(False))


def _explode(agg: DataFrame, items: list[tuple], names: Sequence[str]) -> DataFrame:
    """Long form from one aggregate row: ``items`` are tuples of columns."""
    arr = F.array(*[F.struct(*[v.alias(n) for v, n in zip(it, names)]) for it in items])
    return agg.select(F.explode(arr).alias("x")).select("x.*")


def symptom_frequency(ext: DataFrame, r: Roles) -> DataFrame:
    """Per symptom, cases answering yes (1/S/SIM) and percent of all cases."""
    sy = {k: v for k, v in r.symptoms.items() if v.lower() in ext.columns}
    agg = ext.agg(F.count(F.lit(1)).alias("_total"),
                  *[F.count_if(_yes(c.lower())).alias(f"_s{i}") for i, c in enumerate(sy.values())])
    items = [(F.lit(lbl), F.col(f"_s{i}"),
              X.guarded_ratio(F.col(f"_s{i}"), "_total", 100, zero=True))
             for i, lbl in enumerate(sy.keys())]
    return _explode(agg, items, ["symptom", "cases", "pct"])


def symptom_combinations(ext: DataFrame, r: Roles, top_n: int | None = None) -> DataFrame:
    """Pattern of the combo symptoms answered exactly '1', counted and
    ranked (ties by pattern text)."""
    combo = [(lbl, r.symptoms[lbl].lower()) for lbl in r.combo_symptoms
             if lbl in r.symptoms and r.symptoms[lbl].lower() in ext.columns]
    pat = X.join_labels([(_yes(c, K.YES_CODE), lbl) for lbl, c in combo], " + ", K.NO_PATTERN_LABEL)
    out = ext.groupBy(pat.alias("pattern")).agg(F.count(F.lit(1)).alias("cases"))
    out = out.orderBy(F.desc("cases"), "pattern")
    return out.limit(top_n) if top_n else out


def _exam_flags(ext: DataFrame, r: Roles, names=None, done_codes=K.EXAM_DONE_CLINICAL):
    """Per exam: (key, result col, done predicate, stripped result)."""
    out = []
    for key, (res, dte) in r.exams.items():
        if names is not None and key not in names:
            continue
        if res.lower() not in ext.columns:
            continue
        v = F.trim(F.col(res.lower()))
        done = F.coalesce(v.isin(*done_codes), F.lit(False))
        if dte and dte.lower() in ext.columns:
            done = done | F.col(dte.lower()).isNotNull()
        out.append((key, v, done))
    return out


def exam_summary(ext: DataFrame, r: Roles) -> DataFrame:
    """Any exam done (result 1-3 or a date, T11), positivity among those
    done, percent untested.  One row."""
    ex = _exam_flags(ext, r)
    done = F.lit(False)
    pos = F.lit(False)
    for _, v, d in ex:
        done = done | d
        pos = pos | F.coalesce(v == "1", F.lit(False))
    a = ext.agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("tested"),
                F.count_if(done & pos).alias("positives"))
    return a.select("total", "tested", "positives",
                    X.guarded_ratio("tested", "total", 100, zero=True).alias("pct_tested"),
                    X.guarded_ratio("positives", "tested", 100, zero=True).alias("positivity_pct"),
                    (F.lit(100.0) - X.guarded_ratio("tested", "total", 100, zero=True)).alias("pct_untested"))


def symptom_by_status(ext: DataFrame, r: Roles) -> DataFrame:
    """Symptom x (confirmed, discarded), long form."""
    sy = {k: v for k, v in r.symptoms.items() if v.lower() in ext.columns}
    cl = F.trim(F.col(r.class_raw.lower()))
    conf = F.coalesce(cl.isin(*K.CONFIRMED_CODES), F.lit(False))
    disc = F.coalesce(cl.isin(*K.DISCARDED_CODES), F.lit(False))
    aggs = []
    for i, c in enumerate(sy.values()):
        aggs += [F.count_if(_yes(c.lower()) & conf).alias(f"_c{i}"),
                 F.count_if(_yes(c.lower()) & disc).alias(f"_d{i}")]
    a = ext.agg(*aggs)
    items = []
    for i, lbl in enumerate(sy.keys()):
        items.append((F.lit(lbl), F.lit(K.STATUS_CONFIRMED), F.col(f"_c{i}")))
        items.append((F.lit(lbl), F.lit(K.STATUS_DISCARDED), F.col(f"_d{i}")))
    return _explode(a, items, ["symptom", "status", "cases"])


def comorbidity_frequency(ext: DataFrame, r: Roles) -> DataFrame:
    """Pre-existing conditions answered '1': code, label, cases, percent."""
    co = {k: v for k, v in r.comorbidities.items() if v.lower() in ext.columns}
    a = ext.agg(F.count(F.lit(1)).alias("_total"),
                *[F.count_if(_yes(c.lower(), K.YES_CODE)).alias(f"_m{i}") for i, c in enumerate(co.values())])
    items = [(F.lit(c.lower()), F.lit(lbl), F.col(f"_m{i}"),
              X.guarded_ratio(F.col(f"_m{i}"), "_total", 100, zero=True))
             for i, (lbl, c) in enumerate(co.items())]
    return _explode(a, items, ["code", "label", "cases", "pct"])


def exam_results(ext: DataFrame, r: Roles, with_inconclusive: bool = False) -> DataFrame:
    """E55 (and L06 with ``with_inconclusive``): per exam, done / positive /
    negative / not done (result '4', blank or missing), long form."""
    ex = _exam_flags(ext, r)
    aggs, items = [], []
    for i, (key, v, done) in enumerate(ex):
        nd = v.isNull() | (v == "") | (v == "4")
        aggs += [F.count_if(done).alias(f"_r{i}"), F.count_if(v == "1").alias(f"_p{i}"),
                 F.count_if(v == "2").alias(f"_n{i}"), F.count_if(nd).alias(f"_x{i}"),
                 F.count_if(v == "3").alias(f"_i{i}")]
        lbl = F.lit(K.EXAM_LABELS.get(key, key))
        names = list(K.EXAM_METRICS)
        cols = [f"_r{i}", f"_p{i}", f"_n{i}", f"_x{i}"]
        if with_inconclusive:
            names.append(K.EXAM_INCONCLUSIVE_METRIC)
            cols.append(f"_i{i}")
        items += [(lbl, F.lit(m), F.col(c)) for m, c in zip(names, cols)]
    return _explode(ext.agg(*aggs), items, ["exam", "metric", "value"])


def tested_share_monthly(ext: DataFrame, r: Roles) -> DataFrame:
    """Percent of cases with any exam done, per month."""
    done = F.lit(False)
    for _, _, d in _exam_flags(ext, r):
        done = done | d
    g = ext.groupBy("month_start").agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("tested"))
    return g.withColumn("pct", X.guarded_ratio("tested", "total", 100, zero=True))


def serotype_counts(ext: DataFrame, r: Roles) -> DataFrame:
    """Serotype 1-4 (C20) counts with DEN labels."""
    v = F.trim(F.col(r.serotype_raw.lower()))
    m = F.create_map(*[x for k, lbl in K.SEROTYPE_LABELS.items() for x in (F.lit(k), F.lit(lbl))])
    return (ext.filter(v.isin(*K.SEROTYPE_LABELS.keys()))
            .groupBy(m[v].alias("serotype")).agg(F.count(F.lit(1)).alias("cases")))


def severity_by_exam_result(ext: DataFrame, r: Roles) -> DataFrame:
    """Hospitalisations and deaths by overall exam result (I13), long."""
    ex = [(k, res, dte) for k, (res, dte) in r.exams.items() if res.lower() in ext.columns]
    overall = X.exam_overall([F.col(res.lower()) for _, res, _ in ex],
                             [F.col(d.lower()) for _, _, d in ex if d and d.lower() in ext.columns])
    oc = F.trim(F.col(r.outcome_raw.lower()))
    death = F.coalesce(oc.isin(*K.DEATH_CODES_PROFILE) | F.upper(oc).contains(K.DEATH_TEXT), F.lit(False))
    hosp = F.coalesce(F.trim(F.col(r.hosp_raw.lower())) == "1", F.lit(False))
    g = ext.groupBy(overall.alias("exam_result")).agg(F.count_if(hosp).alias("_h"), F.count_if(death).alias("_d"))
    arr = F.array(F.struct(F.lit(K.SEVERITY_METRICS["hosp"]).alias("metric"), F.col("_h").alias("value")),
                  F.struct(F.lit(K.SEVERITY_METRICS["death"]).alias("metric"), F.col("_d").alias("value")))
    return g.select("exam_result", F.explode(arr).alias("x")).select("exam_result", "x.metric", "x.value")


def class_groups_text(ext: DataFrame, r: Roles) -> DataFrame:
    """E42 clinical variant: text match of the stripped code."""
    return ext.groupBy(X.class_group(F.col(r.class_raw.lower()), numeric=False).alias("class_group")) \
              .agg(F.count(F.lit(1)).alias("cases"))
