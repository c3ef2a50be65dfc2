"""Territory and risk panel.

Inputs are already aggregated to municipality/facility x month grain.  The
global ranks (F01-F03) come from ``surv.operators.ranking``: a single-task
window only behind a checked size bound, a distributed rank beyond it.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surv.functions import codes as K
from surv.functions import expr as X
from surv.session import materialize


# ---- F01 / F02 / F03 ranks: see surv.operators.ranking ----------------------------


# ---- E41 rollup ---------------------------------------------------------------
def place_rollup(enriched: DataFrame, mean_of_monthly: bool = True) -> DataFrame:
    """Per municipality, total cases and incidence, rounded to int
    (banker's rounding, NULL to 0 after, as the dashboard does).

    ``mean_of_monthly=True`` averages the monthly incidences (T26);
    ``False`` uses total cases over population."""
    g = enriched.groupBy("place_name")
    if mean_of_monthly:
        a = g.agg(F.sum("cases").alias("_c"), F.avg("incidence_100k").alias("_i"))
    else:
        a = g.agg(F.sum("cases").alias("_c"),
                  X.guarded_ratio(F.sum("cases"), F.max("population"), K.PER_100K).alias("_i"))
    return a.filter(F.col("_c").isNotNull()).select(
        "place_name", X.round_half_even_int("_c").alias("cases"),
        X.round_half_even_int("_i").alias("incidence_100k"))


def top_places(rollup: DataFrame, by: str = "cases", n: int = 10) -> DataFrame:
    """G04 over E41: top ``n`` municipalities (ties by name)."""
    return rollup.orderBy(F.desc(by), "place_name").limit(n)


# ---- D06 / F06 / F07 risk --------------------------------------------------------
def growth_table(monthly: DataFrame, key: str, value: str = "cases") -> DataFrame:
    """D06 + F06 in one pass: per key, total over the period, value in the
    first and last month *of the whole input*, growth percent.

    The first/last months are scalar subqueries; the three-way join of the
    dashboard becomes conditional sums of a single aggregate."""
    # one scalar subquery for both ends (reused, evaluated once)
    mm = monthly.select(F.struct(F.min("month_start").alias("lo"), F.max("month_start").alias("hi"))).scalar()
    m0, m1 = mm.getField("lo"), mm.getField("hi")
    m = F.col("month_start")
    t = monthly.groupBy(key).agg(
        F.sum(value).cast("bigint").alias("period_cases"),
        F.coalesce(F.sum(F.when(m == m0, F.col(value))), F.lit(0)).cast("bigint").alias("first_cases"),
        F.coalesce(F.sum(F.when(m == m1, F.col(value))), F.lit(0)).cast("bigint").alias("last_cases"))
    return t.withColumn("growth_pct", X.growth_pct("first_cases", "last_cases"))


def risk_band(score: Column) -> Column:
    """F07 bands."""
    out = None
    for lim, lbl in K.RISK_BANDS:
        out = F.when(score >= lim, F.lit(lbl)) if out is None else out.when(score >= lim, F.lit(lbl))
    return out.otherwise(F.lit(K.RISK_BAND_DEFAULT))


def risk_score(growth: DataFrame, key: str) -> DataFrame:
    """0.6 x volume percentile + 0.4 x growth percentile (growth floored
    at 0), rounded to 3 decimals (half-even), banded; sorted score then volume."""
    from surv.operators.ranking import with_pct_rank_average
    # one row per key, read by both ranks: computed once
    g = materialize(growth.withColumn("_g0", F.greatest(F.col("growth_pct"), F.lit(0.0))), "growth")
    g = with_pct_rank_average(with_pct_rank_average(g, "period_cases", "_vr"), "_g0", "_gr")
    score = F.bround(F.lit(K.RISK_VOLUME_WEIGHT) * F.col("_vr") + F.lit(K.RISK_GROWTH_WEIGHT) * F.col("_gr"), 3)
    g = g.withColumn("risk_score", score).withColumn("risk_band", risk_band(F.col("risk_score")))
    return g.drop("_g0", "_vr", "_gr").orderBy(F.desc("risk_score"), F.desc("period_cases"), F.asc(key))


def facility_labels(fm: DataFrame) -> DataFrame:
    """Facility label: best name, or 'unit not identified' when blank."""
    nm = F.trim(F.col("facility_name"))
    return fm.withColumn("facility_label",
                         F.when(nm.isNull() | (nm == ""), F.lit(K.UNIT_NOT_IDENTIFIED)).otherwise(nm))


def facility_risk(facilities_monthly: DataFrame) -> DataFrame:
    """D06/F06/F07 on E13 output: pressure, growth and risk per facility."""
    fm = facility_labels(facilities_monthly)
    return risk_score(growth_table(fm, "facility_label"), "facility_label")


def place_growth(enriched: DataFrame) -> DataFrame:
    """F06 grouped by municipality."""
    return growth_table(enriched, "place_name")


def management_table(enriched: DataFrame) -> DataFrame:
    """Municipality, cases, incidence (mean of monthly), growth, risk."""
    roll = place_rollup(enriched)
    risk = risk_score(place_growth(enriched), "place_name")
    return (roll.join(risk.select("place_name", "growth_pct", "risk_score", "risk_band"), "place_name", "left")
            .orderBy(F.desc("risk_score"), F.desc("cases"), "place_name"))


# ---- D08 / F08 month spine ----------------------------------------------------
def last_n_months(series: DataFrame, n: int, scope: str = "scope", value: str = "cases") -> DataFrame:
    """Exactly the last ``n`` months per scope, gaps as 0.

    The spine is built per scope with ``explode(sequence(...))`` from the
    scalar latest month -- no cross join -- then left-joined to the sums."""
    ref = series.select(F.max(F.trunc("month_start", "MM"))).scalar()
    start = F.add_months(ref, -(n - 1))
    spine = (series.select(scope).distinct()
             .select(scope, F.explode(F.sequence(start, ref, F.expr("INTERVAL 1 MONTH"))).alias("month_start")))
    agg = (series.groupBy(scope, F.trunc("month_start", "MM").alias("month_start"))
           .agg(F.sum(value).alias("_v")))
    j = spine.join(agg, [scope, "month_start"], "left")
    return j.select(scope, "month_start", X.round_half_even_int("_v").alias(value))


# ---- F04 previous calendar month ---------------------------------------------
def with_previous_month(series: DataFrame, keys: Sequence[str] = (), value: str = "cases") -> DataFrame:
    """value of the previous *calendar* month (0 when that month is
    absent) by an equi-join on ``add_months(month, -1)`` -- not ``lag``."""
    prev = series.select(*keys, F.add_months("month_start", 1).alias("month_start"),
                         F.col(value).alias("previous"))
    j = series.join(prev, [*keys, "month_start"], "left")
    return j.withColumn("previous", F.coalesce("previous", F.lit(0)).cast("bigint")) \
            .withColumn("delta_pct", X.pct_delta(value, "previous"))


# ---- E70 two-place comparison --------------------------------------------------
def two_place_series(enriched: DataFrame, a: str, b: str) -> DataFrame:
    """Monthly cases of two municipalities."""
    return (enriched.filter(F.col("place_name").isin(a, b))
            .groupBy("month_start", "place_name").agg(F.sum("cases").cast("bigint").alias("cases")))


def two_place_summary(enriched: DataFrame, a: str, b: str) -> DataFrame:
    """Per place total, growth first->last of its own series (Python
    rounding to int), and the difference to the other place."""
    s = two_place_series(enriched, a, b)
    per = s.groupBy("place_name").agg(
        F.sum("cases").cast("bigint").alias("total_cases"),
        F.min_by("cases", "month_start").alias("_first"),
        F.max_by("cases", "month_start").alias("_last"))
    per = per.withColumn("growth_pct", X.round_half_even_int(X.growth_pct("_first", "_last")))
    tot_a = per.filter(F.col("place_name") == a).select("total_cases").scalar()
    tot_b = per.filter(F.col("place_name") == b).select("total_cases").scalar()
    diff = F.coalesce(tot_a, F.lit(0)) - F.coalesce(tot_b, F.lit(0))
    return per.select("place_name", "total_cases", "growth_pct",
                      F.when(F.col("place_name") == a, diff).otherwise(-diff).cast("bigint").alias("diff_vs_other"))


def place_positions(enriched: DataFrame) -> DataFrame:
    """F03 context ranking: municipalities by total cases with their position
    (ties by name)."""
    from surv.operators.ranking import with_position
    t = enriched.groupBy("place_name").agg(F.sum("cases").cast("bigint").alias("cases"))
    return with_position(t, [(F.col("cases"), True), (F.col("place_name"), False)], "position") \
        .withColumn("position", F.col("position").cast("int"))


def place_ranks(enriched: DataFrame) -> DataFrame:
    """competition rank of municipalities by total cases (descending)."""
    from surv.operators.ranking import with_rank
    t = enriched.groupBy("place_name").agg(F.sum("cases").cast("bigint").alias("cases"))
    return with_rank(t, "cases", descending=True, name="rank")


def place_share_of_state(enriched: DataFrame) -> DataFrame:
    """each municipality's share of its state's cases, in percent."""
    t = enriched.groupBy("state", "place_name").agg(F.sum("cases").cast("bigint").alias("cases"))
    tot = F.sum("cases").over(Window.partitionBy("state"))
    return t.withColumn("share_pct", F.col("cases") / tot * 100.0)


# ---- L03 window vs previous window ---------------------------------------------
def window_acceleration(monthly: DataFrame, n: int, value: str = "cases") -> DataFrame:
    """Last ``n`` months (counted back from the latest month present)
    against the ``n`` months before them; change percent (0 when the base is
    0) and acceleration sign (-1, 0, 1)."""
    ref = monthly.select(F.max("month_start")).scalar()
    m = F.col("month_start")
    cur = (m > F.add_months(ref, -n)) & (m <= ref)
    prev = (m > F.add_months(ref, -2 * n)) & (m <= F.add_months(ref, -n))
    a = monthly.agg(F.coalesce(F.sum(F.when(cur, F.col(value))), F.lit(0)).cast("bigint").alias("current"),
                    F.coalesce(F.sum(F.when(prev, F.col(value))), F.lit(0)).cast("bigint").alias("previous"))
    chg = F.when(F.col("previous") == 0, F.lit(0.0)).otherwise(
        (F.col("current") - F.col("previous")).cast("double") / F.col("previous").cast("double") * 100.0)
    return a.withColumn("change_pct", chg).withColumn("acceleration", F.signum("change_pct").cast("int"))


# ---- L04 drill-down -------------------------------------------------------------
def drill_down(enriched: DataFrame) -> DataFrame:
    """Country / state / municipality totals via ``rollup`` with the
    grouping id telling the level (3 = country, 1 = state, 0 = municipality)."""
    r = enriched.rollup("state", "place_name").agg(F.sum("cases").cast("bigint").alias("cases"),
                                                   F.grouping_id().alias("level"))
    return r.withColumn("level", F.col("level").cast("int"))
