"""Demographic profile panel.

Per-field loops of the dashboard become one scan: fields are unpivoted into
(field, value) rows and aggregated together.  Windows are only applied after
aggregation, on per-field / per-scope groups whose size is bounded by the
code domain (a few dozen rows), never on case-level rows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surv.functions import codes as K
from surv.functions import expr as X
from surv.operators import scope as S
from surv.roles import Roles


def _focus(f, r, territory, place, cls, since):
    return S.place_scope(S.base(f, r, cls, since), r, territory, place)


# ---- E15 / F09 modal category per profile field -----------------------------
def _profile_fields(r: Roles) -> list[tuple[str, Column, Column]]:
    """(field, normalised value, validity predicate) per profile field."""
    out = []
    if r.has("age_raw"):
        c = r.c("age_raw").cast("string")
        out.append(("age", X.ni(c), X.blank_to_null(c).isNotNull() & (F.trim(c) != K.NI)))
    if r.has("pregnant_raw"):
        v = X.ni(r.c("pregnant_raw").cast("string"))
        out.append(("pregnancy", v, v.isin(*K.PREGNANCY_VALID)))
    if r.has("race_raw"):
        v = X.ni(r.c("race_raw").cast("string"))
        out.append(("race", v, v.isin(*K.RACE_VALID)))
    if r.has("school_raw"):
        v = X.ni(r.c("school_raw").cast("string"))
        out.append(("schooling", v, v.isin(*K.SCHOOL_VALID)))
    return out


def top_profile(f: DataFrame, r: Roles, territory: DataFrame, place: str,
                cls: Sequence[str] | None = None, since: str | None = None) -> DataFrame:
    """Most frequent valid category per field, in one pass.

    Unpivot (field, value-if-valid), count per (field, value), keep the top
    row per field; ties go to the smallest value (T19).  A field with no
    valid value yields (field, NULL, NULL).
    """
    g = _focus(f, r, territory, place, cls, since)
    fields = _profile_fields(r)
    arr = F.array(*[F.struct(F.lit(n).alias("field"), F.when(ok, v).alias("value_raw"))
                    for n, v, ok in fields])
    u = g.select(F.explode(arr).alias("x")).select("x.*")
    agg = u.groupBy("field", "value_raw").agg(F.count(F.lit(1)).alias("cases"))
    w = Window.partitionBy("field").orderBy(F.col("value_raw").isNull(), F.desc("cases"),
                                            F.asc("value_raw"))
    top = agg.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    top = top.select("field", "value_raw", F.when(F.col("value_raw").isNotNull(), F.col("cases")).alias("cases"))
    # one row per field even when the scope is empty (field names: metadata)
    names = f.sparkSession.createDataFrame([(n,) for n, _, _ in fields], "field string")
    return names.join(F.broadcast(top), "field", "left")


# ---- E19 / E21 demographic series ------------------------------------------
def demographic_columns(r: Roles) -> list[Column]:
    """I08-I11 case-level columns of the profile panel."""
    age = X.age_years(r.c("age_raw")) if r.has("age_raw") else F.lit(None).cast("int")
    sex = X.ni(r.c("sex_raw")) if r.has("sex_raw") else F.lit(K.NI)
    race = X.ni(r.c("race_raw")) if r.has("race_raw") else F.lit(K.NI)
    hosp = X.as_int_flag(X.yes_flag(r.c("hosp_raw"))) if r.has("hosp_raw") else F.lit(0)
    death = X.as_int_flag(X.death_flag(r.c("outcome_raw"))) if r.has("outcome_raw") else F.lit(0)
    return [X.age_band(age).alias("age_band"), sex.alias("sex"), race.alias("race"),
            hosp.alias("_hosp"), death.alias("_death")]


def _demographic(g: DataFrame, r: Roles) -> DataFrame:
    d = r.c("notified_on")
    rows = g.select(X.year_of(d).alias("year"), X.month_start(d).alias("month_start"),
                    *demographic_columns(r))
    return (rows.groupBy("year", "month_start", "age_band", "sex", "race")
            .agg(F.count(F.lit(1)).alias("cases"),
                 F.sum("_hosp").cast("bigint").alias("hospitalisations"),
                 F.sum("_death").cast("bigint").alias("deaths")))


def demographic_monthly(f: DataFrame, r: Roles, territory: DataFrame, place: str,
                        cls: Sequence[str] | None = None, since: str | None = None) -> DataFrame:
    """Month x age band x sex x race with cases, hospitalisations, deaths."""
    return _demographic(_focus(f, r, territory, place, cls, since), r).orderBy("month_start")


def demographic_monthly_scope(f: DataFrame, r: Roles, scope: str,
                              cls: Sequence[str] | None = None, since: str | None = None) -> DataFrame:
    """The same for the focus state ('RJ') or the country ('BR')."""
    return _demographic(S.scope_switch(S.base(f, r, cls, since), r, scope), r).orderBy("month_start")


def demographic_scopes(f: DataFrame, r: Roles, territory: DataFrame, place: str,
                       cls: Sequence[str] | None = None, since: str | None = None,
                       scopes: Sequence[str] = ("MUN", "RJ", "BR")) -> DataFrame:
    """E19 + E21 in one scan: the demographic series of the focus place, the
    focus state and the country, keyed by ``scope``.  The state scope here is
    C04 (the loader's), not the C05 mask of the series panel."""
    g = S.with_place_flag(S.base(f, r, cls, since), r, territory, place)
    parts = []
    if "BR" in scopes:
        parts.append(F.lit("BR"))
    if "RJ" in scopes:
        parts.append(F.when(X.state_in_focus(r.c("state_raw")), F.lit("RJ")))
    if "MUN" in scopes:
        parts.append(F.when(F.col("_in_place"), F.lit("MUN")))
    d = r.c("notified_on")
    rows = g.select(F.explode(F.array_compact(F.array(*parts))).alias("scope"),
                    X.year_of(d).alias("year"), X.month_start(d).alias("month_start"),
                    *demographic_columns(r))
    return (rows.groupBy("scope", "year", "month_start", "age_band", "sex", "race")
            .agg(F.count(F.lit(1)).alias("cases"),
                 F.sum("_hosp").cast("bigint").alias("hospitalisations"),
                 F.sum("_death").cast("bigint").alias("deaths")))


def scope_shares_one_scan(demo_scopes: DataFrame, key: Column, key_name: str) -> DataFrame:
    """E49/F05 over ``demographic_scopes`` output."""
    x = demo_scopes.groupBy("scope", key.alias(key_name)).agg(F.sum("cases").cast("bigint").alias("cases"))
    tot = F.sum("cases").over(Window.partitionBy("scope"))
    return x.withColumn("pct", F.when(tot > 0, F.col("cases") / tot * 100.0).otherwise(F.lit(0.0)))


# ---- E20 comorbidities -------------------------------------------------------
def comorbidities_monthly(f: DataFrame, r: Roles, territory: DataFrame, place: str,
                          cls: Sequence[str] | None = None, since: str | None = None) -> DataFrame:
    """Per-month comorbidity counts, computed wide in one aggregate and
    returned long (month, comorbidity, cases); empty without any comorbidity
    column."""
    r = r.bind(f)
    if not r.comorbidities:
        from surv.operators.counts import empty
        return empty(f, "year int, month_start date, comorbidity string, cases bigint")
    g = _focus(f, r, territory, place, cls, since)
    d = r.c("notified_on")
    sums = [F.sum(X.as_int_flag(X.yes_flag(F.col(c)))).cast("bigint").alias(f"_c{i}")
            for i, c in enumerate(r.comorbidities.values())]
    wide = g.groupBy(X.year_of(d).alias("year"), X.month_start(d).alias("month_start")).agg(*sums)
    arr = F.array(*[F.struct(F.lit(lbl).alias("comorbidity"), F.col(f"_c{i}").alias("cases"))
                    for i, lbl in enumerate(r.comorbidities.keys())])
    return wide.select("year", "month_start", F.explode(arr).alias("x")).select(
        "year", "month_start", "x.comorbidity", "x.cases")


# ---- E42 classification groups -----------------------------------------------
def class_groups(status: DataFrame, numeric: bool = True, code_col: str = "classification",
                 count_col: str | None = "cases") -> DataFrame:
    """Cases by classification group (I12).  ``status`` is an E09-shaped
    frame (``count_col`` summed) or case-level rows (``count_col=None``)."""
    grp = X.class_group(F.col(code_col), numeric=numeric).alias("class_group")
    val = F.sum(count_col).cast("bigint") if count_col else F.count(F.lit(1))
    return status.groupBy(grp).agg(val.alias("cases"))


# ---- E43-E49 over the E19 frame ---------------------------------------------
def sex_label(c: Column) -> Column:
    return X.label_or(c, K.SEX_LABELS, K.NOT_INFORMED_LABEL)


def race_label(c: Column) -> Column:
    return X.label_or(c, K.RACE_LABELS, K.NOT_INFORMED_LABEL)


def band_totals(demo: DataFrame) -> DataFrame:
    """Per age band totals and hospitalisation rate, in band order."""
    t = demo.groupBy("age_band").agg(F.sum("cases").cast("bigint").alias("cases"),
                                     F.sum("hospitalisations").cast("bigint").alias("hospitalisations"),
                                     F.sum("deaths").cast("bigint").alias("deaths"))
    return (t.withColumn("hosp_rate", X.guarded_ratio("hospitalisations", "cases", 1, zero=True))
             .withColumn("band_order", X.age_band_order("age_band"))
             .orderBy("band_order"))


def profile_highlights(demo: DataFrame) -> DataFrame:
    """Most affected band, riskiest band (highest hospitalisation rate),
    predominant sex.  Ties go to the earlier band / smaller label."""
    bt = band_totals(demo)
    sx = demo.groupBy(sex_label(F.col("sex")).alias("sex_label")).agg(F.sum("cases").alias("n"))
    top_band = bt.select(F.min_by("age_band", F.struct(-F.col("cases"), "band_order"))).scalar()
    risk_band = bt.select(F.min_by("age_band", F.struct(-F.col("hosp_rate"), "band_order"))).scalar()
    risk_rate = bt.select(F.max("hosp_rate")).scalar()
    top_sex = sx.select(F.min_by("sex_label", F.struct(-F.col("n"), "sex_label"))).scalar()
    return bt.agg(F.sum("cases").cast("bigint").alias("total_cases")).select(
        "total_cases", top_band.alias("top_band"), risk_band.alias("riskiest_band"),
        risk_rate.alias("riskiest_hosp_rate"), top_sex.alias("top_sex"))


def mean_age_from_bands(demo: DataFrame) -> DataFrame:
    """Mean age from band midpoints, the unknown band excluded."""
    mid = X.age_band_midpoint("age_band")
    return demo.agg(
        (F.sum(F.when(mid.isNotNull(), mid * F.col("cases"))).cast("double") /
         F.nullif(F.sum(F.when(mid.isNotNull(), F.col("cases"))), F.lit(0)).cast("double")).alias("mean_age"))


def comorbidity_rate(comorb: DataFrame, demo: DataFrame) -> DataFrame:
    """Comorbidity events per 100 cases (scalar subqueries, one row)."""
    total = demo.select(F.sum("cases")).scalar()
    return comorb.agg(F.sum("cases").alias("_e")).select(
        F.when(total > 0, F.col("_e").cast("double") / total.cast("double") * 100.0).alias("per_100_cases"))


def top_k_with_others(df: DataFrame, cat: str, val: str, k: int = 5, more_than: int = 6,
                      others: str = "Outras") -> DataFrame:
    """Total per category; when there are more than ``more_than``
    categories keep the top ``k`` (ties by name) and fold the rest into
    ``others``.  The top ``k`` is a distributed top-k (``orderBy.limit``) and
    the category count a scalar subquery -- no global window."""
    t = df.groupBy(cat).agg(F.sum(val).cast("bigint").alias(val))
    n_cat = t.select(F.count(F.lit(1))).scalar()
    top = t.orderBy(F.desc(val), F.asc(cat)).limit(k).select(F.col(cat).alias("_top"))
    j = t.join(F.broadcast(top), F.col(cat).eqNullSafe(F.col("_top")), "left")   # k rows: bounded
    lab = F.when((n_cat > more_than) & F.col("_top").isNull(), F.lit(others)).otherwise(F.col(cat))
    return j.groupBy(lab.alias(cat)).agg(F.sum(val).cast("bigint").alias(val))


def top_band_series(demo: DataFrame, n: int = 4) -> DataFrame:
    """Monthly series of the ``n`` largest age bands (left-semi join)."""
    s = demo.groupBy("month_start", "age_band").agg(F.sum("cases").cast("bigint").alias("cases"))
    top = (s.groupBy("age_band").agg(F.sum("cases").alias("_t"))
           .orderBy(F.desc("_t"), X.age_band_order("age_band")).limit(n).select("age_band"))
    return s.join(F.broadcast(top), "age_band", "left_semi")


def sex_band_pivot(demo: DataFrame) -> DataFrame:
    """Sex label x age band matrix, gaps filled with 0.  Band values are
    listed, so the pivot needs no extra job to discover them."""
    p = (demo.groupBy(sex_label(F.col("sex")).alias("sex_label"))
         .pivot("age_band", list(K.AGE_BAND_ORDER)).agg(F.sum("cases").cast("bigint")))
    return p.fillna(0, subset=list(K.AGE_BAND_ORDER))


def scope_shares(parts: dict[str, DataFrame], key: Column, key_name: str) -> DataFrame:
    """Share of each category within its scope, in percent."""
    u = None
    for scope, d in parts.items():
        x = d.groupBy(key.alias(key_name)).agg(F.sum("cases").cast("bigint").alias("cases")) \
             .withColumn("scope", F.lit(scope))
        u = x if u is None else u.unionByName(x)
    tot = F.sum("cases").over(Window.partitionBy("scope"))  # per-scope groups of a few rows
    return u.withColumn("pct", F.when(tot > 0, F.col("cases") / tot * 100.0).otherwise(F.lit(0.0)))
