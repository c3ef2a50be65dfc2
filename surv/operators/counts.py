"""Counting panels.

Each operator is one lazy aggregation.  Group keys are low-cardinality
(month x state x code), so the partial (map-side) aggregate collapses a hot
key -- e.g. a state holding a third of all rows -- to one row per task before
the shuffle; no skew handling beyond that is needed.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surv.functions import codes as K
from surv.functions import expr as X
from surv.operators import scope as S
from surv.roles import Roles


def empty(f: DataFrame, schema: str) -> DataFrame:
    """A typed empty result (the reference returns an empty frame when an
    optional source column is absent).  Built from ``f`` with LIMIT 0, so it
    reads nothing."""
    from pyspark.sql.types import _parse_datatype_string
    st = _parse_datatype_string(schema)
    return f.limit(0).select(*[F.lit(None).cast(x.dataType).alias(x.name) for x in st.fields])


def _ym(r: Roles) -> list[Column]:
    d = r.c("notified_on")
    return [X.year_of(d).alias("year"), X.month_start(d).alias("month_start")]


def cases_per_year(f: DataFrame, r: Roles, cls: Sequence[str] | None = None) -> DataFrame:
    """Cases per notification year."""
    return (S.base(f, r, cls).groupBy(X.year_of(r.c("notified_on")).alias("year"))
            .agg(F.count(F.lit(1)).alias("cases")).orderBy("year"))


def cases_month_state(f: DataFrame, r: Roles, cls: Sequence[str] | None = None,
                      since: str | None = None) -> DataFrame:
    """Cases per month x normalised state."""
    return (S.base(f, r, cls, since)
            .groupBy(*_ym(r), X.ni(r.c("state_raw")).alias("state"))
            .agg(F.count(F.lit(1)).alias("cases"))
            .orderBy("month_start", "state"))


def cases_place_year(f: DataFrame, r: Roles) -> DataFrame:
    """Cases per municipality x year (view form)."""
    return (S.notified(f, r)
            .groupBy(X.year_of(r.c("notified_on")).alias("year"),
                     X.ni(r.c("state_raw")).alias("state"),
                     X.ni(r.c("place_raw"), K.PLACE_NOT_INFORMED_VIEW).alias("place"))
            .agg(F.count(F.lit(1)).alias("cases")))


def cases_place_month(f: DataFrame, r: Roles) -> DataFrame:
    """Cases per raw place x month; rows without a date are kept
    (their month is NULL)."""
    return (f.groupBy(r.c("place_raw").alias("place"),
                      X.month_start(r.c("notified_on")).alias("month_start"))
            .agg(F.count(F.lit(1)).alias("cases")))


def place_kpi(f: DataFrame, r: Roles) -> DataFrame:
    """Per-place count, first and last notification, busiest first."""
    return (f.groupBy(r.c("place_raw").alias("place"))
            .agg(F.count(F.lit(1)).alias("cases"),
                 F.min(r.c("notified_on")).alias("first_notified"),
                 F.max(r.c("notified_on")).alias("last_notified"))
            .orderBy(F.desc("cases"), F.asc_nulls_last("place")))


def focus_monthly_by_code(f: DataFrame, r: Roles, code7: str, name: str,
                          cls: Sequence[str] | None = None) -> DataFrame:
    """Focus place by month, matched by code (C04 + C07)."""
    return (S.place_by_code(S.base(f, r, cls), r, code7, name)
            .groupBy(*_ym(r)).agg(F.count(F.lit(1)).alias("cases")).orderBy("month_start"))


def focus_monthly(f: DataFrame, r: Roles, territory: DataFrame, place: str,
                  cls: Sequence[str] | None = None, since: str | None = None) -> DataFrame:
    """Focus place by month, matched by resolved name (D02 + C06)."""
    return (S.place_scope(S.base(f, r, cls, since), r, territory, place)
            .groupBy(*_ym(r)).agg(F.count(F.lit(1)).alias("cases")).orderBy("month_start"))


def _status_keys(r: Roles) -> list[Column]:
    return [X.ni(r.c("class_raw")).alias("classification"),
            X.ni(r.c("outcome_raw")).alias("outcome")]


def focus_status_by_code(f: DataFrame, r: Roles, code7: str, name: str,
                         cls: Sequence[str] | None = None) -> DataFrame:
    """Month x classification x outcome for the focus place, by code."""
    return (S.place_by_code(S.base(f, r, cls), r, code7, name)
            .groupBy(*_ym(r), *_status_keys(r)).agg(F.count(F.lit(1)).alias("cases")))


def focus_status(f: DataFrame, r: Roles, territory: DataFrame, place: str,
                 cls: Sequence[str] | None = None, since: str | None = None) -> DataFrame:
    """Same, matched by name."""
    return (S.place_scope(S.base(f, r, cls, since), r, territory, place)
            .groupBy(*_ym(r), *_status_keys(r)).agg(F.count(F.lit(1)).alias("cases"))
            .orderBy("month_start"))


def population_refs(territory: DataFrame, place: str,
                    state_name: str = K.FOCUS_STATE_NAME) -> DataFrame:
    """Country, state and place population in one pass."""
    pop = F.col("population")
    return territory.agg(
        F.sum(pop).cast("bigint").alias("pop_country"),
        F.sum(F.when(F.upper("state_name") == state_name.upper(), pop)).cast("bigint").alias("pop_state"),
        F.sum(F.when(F.upper("place_name") == F.upper(F.lit(place)), pop)).cast("bigint").alias("pop_place"))


def _focus(f, r, territory, place, cls, since):
    return S.place_scope(S.base(f, r, cls, since), r, territory, place)


def cases_by_sex(f: DataFrame, r: Roles, territory: DataFrame, place: str,
                 cls: Sequence[str] | None = None, since: str | None = None) -> DataFrame:
    """Cases by normalised sex, most frequent first (empty when the fact
    has no sex column)."""
    r = r.bind(f)
    if not r.has("sex_raw"):
        return empty(f, "sex string, cases bigint")
    return (_focus(f, r, territory, place, cls, since)
            .groupBy(X.ni(r.c("sex_raw")).alias("sex"))
            .agg(F.count(F.lit(1)).alias("cases"))
            .orderBy(F.desc("cases"), "sex"))


def _facility_counts(f: DataFrame, r: Roles, facility: DataFrame | None, keys: list[Column]) -> DataFrame:
    """Aggregate by the facility code first, then attach names (D03 order):
    the dimension join runs on the aggregated rows, so a hot facility (e.g.
    the blank id holding a third of all rows) is one row by then."""
    agg = (f.groupBy(*keys, X.ni(r.c("facility_raw")).alias("facility"))
           .agg(F.count(F.lit(1)).alias("cases")))
    if facility is None:
        return agg.withColumn("facility_name", F.lit(""))
    return S.join_facility_name(agg, F.col("facility"), facility)


def top_facilities(f: DataFrame, r: Roles, territory: DataFrame, facility: DataFrame | None,
                   place: str, cls: Sequence[str] | None = None, top_n: int = 10,
                   since: str | None = None) -> DataFrame:
    """Top-N notifying facilities with their best name.

    Ties are broken by facility code (T19) so the cut is deterministic.
    Empty when the fact has no facility column.
    """
    r = r.bind(f)
    if not r.has("facility_raw"):
        return empty(f, "facility string, facility_name string, cases bigint")
    agg = _facility_counts(_focus(f, r, territory, place, cls, since), r, facility, [])
    agg = agg.groupBy("facility", "facility_name").agg(F.sum("cases").cast("bigint").alias("cases"))
    return agg.orderBy(F.desc("cases"), F.asc("facility")).limit(top_n)


def facilities_monthly(f: DataFrame, r: Roles, territory: DataFrame, facility: DataFrame | None,
                       place: str, cls: Sequence[str] | None = None,
                       since: str | None = None) -> DataFrame:
    """Facilities by month (month ascending, cases descending)."""
    r = r.bind(f)
    if not r.has("facility_raw"):
        return empty(f, "year int, month_start date, facility string, facility_name string, cases bigint")
    agg = _facility_counts(_focus(f, r, territory, place, cls, since), r, facility, _ym(r))
    agg = (agg.groupBy("year", "month_start", "facility", "facility_name")
              .agg(F.sum("cases").cast("bigint").alias("cases")))
    return agg.orderBy("month_start", F.desc("cases"), "facility")


def mean_epi_week(f: DataFrame, r: Roles, territory: DataFrame, place: str,
                  cls: Sequence[str] | None = None, since: str | None = None) -> DataFrame:
    """Mean epidemiological week in 1..53, rounded half-up to int
    (empty when the fact has no week column)."""
    r = r.bind(f)
    if not r.has("week_raw"):
        return empty(f, "week_mean int")
    wk = X.epi_week(r.c("week_raw"))
    return (_focus(f, r, territory, place, cls, since)
            .select(wk.alias("week")).filter(F.col("week").between(1, 53))  # C15
            .agg(F.round(F.avg("week"), 0).cast("int").alias("week_mean")))


def hospitalisations_monthly(f: DataFrame, r: Roles, territory: DataFrame, place: str,
                             cls: Sequence[str] | None = None, since: str | None = None) -> DataFrame:
    """Hospitalisations per month; months with zero are kept (empty when
    the fact has no hospitalisation column)."""
    r = r.bind(f)
    if not r.has("hosp_raw"):
        return empty(f, "month_start date, hospitalisations bigint")
    return (_focus(f, r, territory, place, cls, since)
            .groupBy(X.month_start(r.c("notified_on")).alias("month_start"))
            .agg(F.count_if(X.yes_flag(r.c("hosp_raw"))).alias("hospitalisations"))
            .orderBy("month_start"))


def _enriched(f: DataFrame, r: Roles, territory: DataFrame) -> DataFrame:
    """Aggregate to municipality x month first, then join the dimension."""
    agg = (f.groupBy(*_ym(r), X.ni(r.c("state_raw")).alias("state"),
                     X.ni(r.c("place_raw"), K.PLACE_NOT_INFORMED_LOADER).alias("place_code"))
           .agg(F.count(F.lit(1)).alias("cases")))
    agg = agg.withColumn("code6", X.place_code6("place_code"))
    j = S.join_territory(agg, territory, cols=("place_name", "population", "area_km2"))
    return j.select("year", "month_start", "state", "place_code",
                    F.coalesce("place_name", "place_code").alias("place_name"),
                    "cases", "population", "area_km2",
                    X.guarded_ratio("cases", "population", K.PER_100K).alias("incidence_100k"))


def state_places_enriched(f: DataFrame, r: Roles, territory: DataFrame,
                          cls: Sequence[str] | None = None, since: str | None = None) -> DataFrame:
    """Focus state, municipality x month with population and incidence."""
    return _enriched(S.state_scope(S.base(f, r, cls, since), r), r, territory)


def country_places_enriched(f: DataFrame, r: Roles, territory: DataFrame,
                            cls: Sequence[str] | None = None, since: str | None = None) -> DataFrame:
    """Same without the state scope."""
    return _enriched(S.base(f, r, cls, since), r, territory)


def total_rows(f: DataFrame) -> DataFrame:
    """Number of rows."""
    return f.agg(F.count(F.lit(1)).alias("total"))


def cases_by_period(f: DataFrame, date_col: str) -> DataFrame:
    """Count by 'yyyy-MM' of any date column; NULL dates dropped."""
    p = F.date_format(F.col(date_col), "yyyy-MM")
    return (f.filter(F.col(date_col).isNotNull()).groupBy(p.alias("period"))
            .agg(F.count(F.lit(1)).alias("cases")))


def compare_periods(current: DataFrame, reference: DataFrame) -> DataFrame:
    """Totals of two frames and percent change (0 when the base is 0)."""
    a = current.select(F.lit(1).alias("_cur"))
    b = reference.select(F.lit(0).alias("_cur"))
    u = a.unionByName(b)
    cur = F.sum("_cur").cast("double")
    ref = F.sum(1 - F.col("_cur")).cast("double")
    return u.agg(F.coalesce(cur, F.lit(0.0)).alias("total_current"),
                 F.coalesce(ref, F.lit(0.0)).alias("total_reference")).select(
        "total_current", "total_reference",
        F.when(F.col("total_reference") == 0, F.lit(0.0))
         .otherwise((F.col("total_current") - F.col("total_reference")) / F.col("total_reference") * 100)
         .alias("change_pct"))


def three_scope_series(f: DataFrame, r: Roles, territory: DataFrame, place: str,
                       cls: Sequence[str] | None = None, since: str | None = None) -> DataFrame:
    """Monthly cases for country, focus state and focus place, with
    incidence per 100k of each scope's population (all notified, T29).

    One scan: each row is tagged with the scopes it belongs to and exploded
    before the (partial) aggregate; populations are scalar subqueries."""
    pops = population_refs(territory, place)
    g = S.with_place_flag(S.base(f, r, cls, since), r, territory, place)
    u = (g.select(X.month_start(r.c("notified_on")).alias("month_start"),
                  F.explode(S.scope_labels(g, r, territory, place)).alias("scope"))
         .groupBy("scope", "month_start").agg(F.count(F.lit(1)).alias("cases")))
    pop = (F.when(F.col("scope") == "BR", pops.select("pop_country").scalar())
            .when(F.col("scope") == "RJ", pops.select("pop_state").scalar())
            .otherwise(pops.select("pop_place").scalar()))
    return u.select("scope", "month_start", "cases",
                    X.guarded_ratio("cases", pop, K.PER_100K).alias("incidence_100k"))


def _status_frame(f, r, territory, place, cls, since):
    """Case-level columns behind the period and last-month cards."""
    r = r.bind(f)
    g = _focus(f, r, territory, place, cls, since)
    # no hospitalisation column: the card is NULL, not 0 (count_if of NULL)
    hosp = X.yes_flag(r.c("hosp_raw")) if r.has("hosp_raw") else F.lit(None).cast("boolean")
    outcome = X.ni(r.c("outcome_raw")) if r.has("outcome_raw") else F.lit(None).cast("string")
    return g.select(X.month_start(r.c("notified_on")).alias("month_start"),
                    X.ni(r.c("class_raw")).alias("classification"),
                    outcome.alias("outcome"), hosp.alias("hosp"))


def period_cards(f: DataFrame, r: Roles, territory: DataFrame, place: str,
                 cls: Sequence[str] | None = None, since: str | None = None) -> DataFrame:
    """Period card metrics in one global aggregate.

    Confirmed = confirmed codes; deaths = outcome '2' (T9); incidence uses
    confirmed over the place population; open = notified minus confirmed,
    discarded and inconclusive, floored at 0 (T10)."""
    s = _status_frame(f, r, territory, place, cls, since)
    pop = population_refs(territory, place).select("pop_place").scalar()
    cls_c = F.col("classification")
    a = s.agg(F.count(F.lit(1)).alias("notified"),
              F.count_if(cls_c.isin(*K.CONFIRMED_CODES)).alias("confirmed"),
              F.count_if(cls_c.isin(*K.DISCARDED_CODES)).alias("discarded"),
              F.count_if(cls_c.isin(*K.INCONCLUSIVE_CODES)).alias("inconclusive"),
              F.count_if(F.col("outcome").isin(*K.DEATH_CODES_CARDS)).alias("deaths"),
              F.when(F.count("hosp") > 0, F.count_if("hosp")).alias("hospitalisations"))
    return a.select(
        "confirmed", "notified", "deaths", "hospitalisations",
        X.guarded_ratio("confirmed", pop, K.PER_100K).alias("incidence_100k"),
        X.guarded_ratio("deaths", "confirmed", K.PER_100).alias("lethality_pct"),
        F.greatest(F.col("notified") - F.col("confirmed") - F.col("discarded") - F.col("inconclusive"),
                   F.lit(0)).cast("bigint").alias("open_cases"))


def last_month_cards(f: DataFrame, r: Roles, territory: DataFrame, place: str,
                     cls: Sequence[str] | None = None, since: str | None = None) -> DataFrame:
    """Latest month vs the previous *calendar* month (a missing month
    counts as 0, so this is not ``lag``), five metrics in long form with the
    percent delta (NULL when the previous value is 0)."""
    s = _status_frame(f, r, territory, place, cls, since)
    ref = s.select(F.max("month_start")).scalar()
    prev = F.add_months(ref, -1)
    m = F.col("month_start")
    conf = F.col("classification").isin(*K.CONFIRMED_CODES)
    death = F.col("outcome").isin(*K.DEATH_CODES_CARDS)
    a = s.filter((m == ref) | (m == prev)).agg(
        F.count_if(conf & (m == ref)).alias("confirmed_cur"),
        F.count_if(conf & (m == prev)).alias("confirmed_prev"),
        F.count_if(m == ref).alias("notified_cur"),
        F.count_if(m == prev).alias("notified_prev"),
        F.count_if(death & (m == ref)).alias("deaths_cur"),
        F.count_if(death & (m == prev)).alias("deaths_prev"),
        # no hospitalisation column: NULL, not 0 (as the period card)
        F.when(F.count("hosp") > 0, F.count_if(F.col("hosp") & (m == ref))).alias("hospitalisations_cur"),
        F.when(F.count("hosp") > 0, F.count_if(F.col("hosp") & (m == prev))).alias("hospitalisations_prev"))
    a = a.withColumn("open_cur", F.greatest(F.col("notified_cur") - F.col("confirmed_cur"), F.lit(0)).cast("bigint")) \
         .withColumn("open_prev", F.greatest(F.col("notified_prev") - F.col("confirmed_prev"), F.lit(0)).cast("bigint"))
    metrics = ["confirmed", "notified", "deaths", "hospitalisations", "open"]
    longf = a.select(F.explode(F.array(*[
        F.struct(F.lit(mname).alias("metric"), F.col(f"{mname}_cur").alias("current"),
                 F.col(f"{mname}_prev").alias("previous")) for mname in metrics])).alias("x")).select("x.*")
    return longf.withColumn("delta_pct", X.pct_delta("current", "previous")) \
                .withColumn("month_start", ref)


def rows_per_year_by_date(f: DataFrame, r: Roles, y0: int | None = None, y1: int | None = None) -> DataFrame:
    """Rows per year of the notification date."""
    y = X.year_of(r.c("notified_on"))
    g = f.filter(r.c("notified_on").isNotNull())
    if y0 is not None:
        g = g.filter(y >= y0)
    if y1 is not None:
        g = g.filter(y <= y1)
    return g.groupBy(y.alias("year")).agg(F.count(F.lit(1)).alias("rows_by_date"))


def year_text_valid(c: Column, y0: int | None = None, y1: int | None = None) -> Column:
    """C17: four-digit year text, optionally in range."""
    t = F.trim(c)
    cond = t.rlike(r"^[0-9]{4}\z")
    yi = t.try_cast("int")
    if y0 is not None:
        cond = cond & (yi >= y0)
    if y1 is not None:
        cond = cond & (yi <= y1)
    return cond


def rows_per_year_by_text(f: DataFrame, r: Roles, y0: int | None = None, y1: int | None = None) -> DataFrame:
    """Rows per year text (C17 filtered)."""
    c = r.c("year_text")
    return (f.filter(year_text_valid(c, y0, y1))
            .groupBy(F.trim(c).try_cast("int").alias("year"))
            .agg(F.count(F.lit(1)).alias("rows_by_text")))


def yearly_totals(f: DataFrame, r: Roles, cls: Sequence[str] | None = None, min_years: int = 2) -> DataFrame:
    """Yearly totals, only when at least ``min_years`` years are present
    (decided by a scalar subquery, not on the driver)."""
    y = cases_per_year(f, r, cls)
    n_years = y.select(F.count(F.lit(1))).scalar()
    return y.filter(n_years >= min_years)


def health_checks(f: DataFrame, r: Roles) -> DataFrame:
    """Rows per year and rows without a notification date."""
    return (f.groupBy(X.year_of(r.c("notified_on")).alias("year"))
            .agg(F.count(F.lit(1)).alias("rows"),
                 F.count_if(r.c("notified_on").isNull()).alias("null_dates")))


def distinct_values(f: DataFrame, col: Column, name: str = "value") -> DataFrame:
    """Distinct list of a column."""
    return f.select(col.alias(name)).distinct()


def distinct_count(f: DataFrame, col: Column, name: str = "n_distinct") -> DataFrame:
    """Distinct count (exact; two-phase aggregate, no single group)."""
    return f.agg(F.count_distinct(col).alias(name))


def latest_notification(f: DataFrame, r: Roles) -> DataFrame:
    """Latest notification date of a batch."""
    return f.agg(F.max(r.c("notified_on")).alias("latest_notified"))
