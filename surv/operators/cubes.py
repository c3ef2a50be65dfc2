"""Monthly indicator table, pre-aggregated cubes, roll-up and router
(E24-E28, B28, K04, K05, K08).

Cubes are ordinary aggregates written as Parquet partitioned by year; the
router reads a cube when it exists and falls back to the fact otherwise.
Aggregation always happens before the dimension join (D03): the group keys
include the raw place text, which determines the join key, so joining after
aggregating gives the same rows while the join sees one row per group.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surv.functions import codes as K
from surv.functions import expr as X
from surv.operators import scope as S
from surv.roles import Roles


def territory_attributes(territory: DataFrame) -> tuple[str, ...]:
    """Attributes that indicator rows take from the territory; a dimension
    without the immediate or intermediate region leaves that one out."""
    return ("region_name", *[c for c in ("rgi", "rgint") if c in territory.columns], "population")


def analytic_fact(f: DataFrame, r: Roles, territory: DataFrame, real_hosp: bool = True) -> DataFrame:
    """B28 (+L05): the analytic fact -- date parts, normalised place code,
    territory enrichment, and the profile columns the reference left as typed
    NULL placeholders, now computed (I08-I13).  ``real_hosp=False`` mimics the
    NULL hospitalisation column (T15)."""
    d = r.c("notified_on")
    g = f.select(
        (r.c("case_id") if r.has("case_id") else F.monotonically_increasing_id()).alias("case_id"),
        d.alias("notified_on"),
        (r.c("onset_on") if r.has("onset_on") else F.lit(None).cast("date")).alias("onset_on"),
        X.year_of(d).alias("year"), X.month_of(d).alias("month"),
        (X.epi_week(r.c("week_raw")) if r.has("week_raw") else F.lit(None).cast("int")).alias("epi_week"),
        X.ni(r.c("place_raw"), K.PLACE_NOT_INFORMED_VIEW).alias("place_raw"),
        X.ni(r.c("state_raw")).alias("state"),
        r.c("class_raw").alias("classification"),
        (r.c("outcome_raw") if r.has("outcome_raw") else F.lit(None).cast("string")).alias("outcome"),
        (r.c("hosp_raw") if (real_hosp and r.has("hosp_raw")) else F.lit(None).cast("string")).alias("hospitalisation"),
        (X.age_years(r.c("age_raw")) if r.has("age_raw") else F.lit(None).cast("int")).alias("age"),
        (r.c("sex_raw") if r.has("sex_raw") else F.lit(None).cast("string")).alias("sex"),
        (r.c("race_raw") if r.has("race_raw") else F.lit(None).cast("string")).alias("race"),
        (r.c("school_raw") if r.has("school_raw") else F.lit(None).cast("string")).alias("schooling"),
        (r.c("closed_on") if r.has("closed_on") else F.lit(None).cast("date")).alias("closed_on"),
        X.place_code6(r.c("place_raw")).alias("code6"),
        *[F.col(c).alias(f"symptom_{c}") for c in r.symptoms.values() if c in f.columns],
        *[F.col(c).alias(f"comorbidity_{c}") for c in r.comorbidities.values() if c in f.columns],
        *[F.col(result).alias(f"exam_{label}") for label, (result, _) in r.exams.items() if result in f.columns],
        *[F.col(on).alias(f"exam_{label}_on") for label, (_, on) in r.exams.items() if on and on in f.columns],
        (F.col("dt_digita") if "dt_digita" in f.columns else F.lit(None).cast("date")).alias("entered_on"),
    ).withColumn("age_band", X.age_band("age"))
    j = S.join_territory(g, territory, cols=("place_name", *territory_attributes(territory)))
    return j.withColumn("place", F.coalesce("place_name", "place_raw")).drop("place_name")


def monthly_indicators(f: DataFrame, r: Roles, territory: DataFrame, real_hosp: bool = True) -> DataFrame:
    """Monthly indicator table per municipality.

    Counts: total, confirmed, discarded, under investigation (0/8/9/NI, T10),
    deaths (outcome 2), hospitalisations; incidence per 100k of confirmed
    (T29), lethality and hospitalisation rate per confirmed.  Key = all group
    columns (T16).  Plan: aggregate by the raw place text, join the
    dimension once on the aggregated rows, re-aggregate by resolved name."""
    d = r.c("notified_on")
    cl = X.ni(r.c("class_raw"))
    oc = X.ni(r.c("outcome_raw")) if r.has("outcome_raw") else F.lit(K.NI)
    hp = X.ni(r.c("hosp_raw")) if (real_hosp and r.has("hosp_raw")) else F.lit(K.NI)
    agg1 = (S.notified(f, r)
            .groupBy(X.year_of(d).alias("year"), X.month_of(d).alias("month"),
                     X.ni(r.c("state_raw")).alias("state"),
                     X.ni(r.c("place_raw"), K.PLACE_NOT_INFORMED_VIEW).alias("place_raw"),
                     X.place_code6(r.c("place_raw")).alias("code6"))
            .agg(F.count(F.lit(1)).alias("cases_total"),
                 F.count_if(cl.isin(*K.CONFIRMED_CODES)).alias("confirmed"),
                 F.count_if(cl.isin(*K.DISCARDED_CODES)).alias("discarded"),
                 F.count_if(cl.isin(*K.INVESTIGATION_CODES)).alias("investigating"),
                 F.count_if(oc.isin(*K.DEATH_CODES_CARDS)).alias("deaths"),
                 F.count_if(hp.isin(*K.YES_CODE)).alias("hospitalisations")))
    attrs = territory_attributes(territory)
    j = S.join_territory(agg1, territory, cols=("place_name", *attrs))
    sums = [F.sum(c).cast("bigint").alias(c) for c in
            ("cases_total", "confirmed", "discarded", "investigating", "deaths", "hospitalisations")]
    g = (j.groupBy("year", "month", "state", F.coalesce("place_name", "place_raw").alias("place"),
                   "code6", *attrs).agg(*sums))
    return g.select(
        "year", "month", "state", "place", "code6", *attrs,
        "cases_total", "confirmed", "discarded", "investigating", "deaths", "hospitalisations",
        X.guarded_ratio("confirmed", "population", K.PER_100K).alias("incidence_100k"),
        X.guarded_ratio("deaths", "confirmed", K.PER_100).alias("lethality_pct"),
        X.guarded_ratio("hospitalisations", "confirmed", K.PER_100).alias("hosp_rate_pct"))


def cube_month_state_class(f: DataFrame, r: Roles) -> DataFrame:
    """Month x state x classification."""
    d = r.c("notified_on")
    return (S.notified(f, r)
            .groupBy(X.year_of(d).alias("year"), X.month_start(d).alias("month_start"),
                     X.ni(r.c("state_raw")).alias("state"), X.ni(r.c("class_raw")).alias("classification"))
            .agg(F.count(F.lit(1)).alias("cases")))


def _place_cube(f: DataFrame, r: Roles, territory: DataFrame, extra: list, with_dim_attrs: bool) -> DataFrame:
    d = r.c("notified_on")
    keys = [X.year_of(d).alias("year"), X.month_start(d).alias("month_start"),
            X.ni(r.c("state_raw")).alias("state"),
            X.ni(r.c("place_raw"), K.PLACE_NOT_INFORMED_VIEW).alias("place_code"),
            X.ni(r.c("class_raw")).alias("classification")] + extra
    agg = S.state_scope(S.notified(f, r), r).groupBy(*keys).agg(F.count(F.lit(1)).alias("cases"))
    agg = agg.withColumn("code6", X.place_code6("place_code"))   # trimmed text (T13)
    cols = ("place_name", "population", "area_km2") if with_dim_attrs else ("place_name",)
    j = S.join_territory(agg, territory, cols=cols)
    return j.withColumn("place_name", F.coalesce("place_name", "place_code"))


def cube_month_place_class_outcome(f: DataFrame, r: Roles, territory: DataFrame) -> DataFrame:
    """Focus state, month x municipality x classification x outcome,
    with population and area."""
    c = _place_cube(f, r, territory, [X.ni(r.c("outcome_raw")).alias("outcome")], True)
    return c.select("year", "month_start", "state", "place_code", "place_name", "code6", "population",
                    "area_km2", "classification", "outcome", "cases")


def cube_month_place_class_facility(f: DataFrame, r: Roles, territory: DataFrame) -> DataFrame:
    """Focus state, month x municipality x classification x facility."""
    c = _place_cube(f, r, territory, [X.ni(r.c("facility_raw")).alias("facility")], False)
    return c.select("year", "month_start", "state", "place_code", "place_name", "code6",
                    "classification", "facility", "cases")


def rollup_cube(cube: DataFrame, keys: Sequence[str], sums: Sequence[str] = ("cases",),
                maxes: Sequence[str] = ()) -> DataFrame:
    """Re-aggregate a cube to a coarser grain: SUM of counts, MAX of
    dimension attributes (partial + final hash aggregate)."""
    return cube.groupBy(*keys).agg(*[F.sum(c).cast("bigint").alias(c) for c in sums],
                                   *[F.max(c).alias(c) for c in maxes])


def cube_filter(cube: DataFrame, cls: Sequence[str] | None = None, since: str | None = None,
                place: str | None = None) -> DataFrame:
    """Filters of the cube route: month >= since (T13), normalised class in
    list, place by resolved name only (T14)."""
    if since:
        cube = cube.filter(F.col("month_start") >= F.lit(since).cast("date"))
    cls = S.norm_list(cls)
    if cls:
        cube = cube.filter(F.col("classification").isin(*cls))
    if place:
        cube = cube.filter(F.upper("place_name") == F.upper(F.lit(place)))
    return cube


# ---- K04 / K05 / J08 jobs -----------------------------------------------------
def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ("year",)) -> int:
    """Full overwrite of a Parquet table; returns the row count."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path).count()


def refresh_monthly_indicators(f: DataFrame, r: Roles, territory: DataFrame, path: str) -> int:
    """Rebuild the monthly indicator table (full overwrite)."""
    return write_table(monthly_indicators(f, r, territory), path)


def refresh_cubes(f: DataFrame, r: Roles, territory: DataFrame, base_path: str) -> dict[str, int]:
    """Rebuild the three cubes."""
    return {
        "month_state_class": write_table(cube_month_state_class(f, r), f"{base_path}/month_state_class"),
        "month_place_class_outcome": write_table(cube_month_place_class_outcome(f, r, territory),
                                                 f"{base_path}/month_place_class_outcome"),
        "month_place_class_facility": write_table(cube_month_place_class_facility(f, r, territory),
                                                  f"{base_path}/month_place_class_facility"),
    }


def analytics_base(f: DataFrame, r: Roles) -> DataFrame:
    """One aggregate of the fact at the finest grain the derived tables need
    (month x state x place text x raw-place code x classification x outcome x
    facility x hospitalised).  The three cubes and the indicator table are all
    roll-ups of it, so the build scans the fact once instead of four times."""
    d = r.c("notified_on")
    hp = X.yes_flag(r.c("hosp_raw")) if r.has("hosp_raw") else F.lit(False)
    return (S.notified(f, r)
            .groupBy(X.year_of(d).alias("year"), X.month_of(d).alias("month"),
                     X.month_start(d).alias("month_start"),
                     X.ni(r.c("state_raw")).alias("state"),
                     X.ni(r.c("place_raw"), K.PLACE_NOT_INFORMED_VIEW).alias("place_code"),
                     X.place_code6(r.c("place_raw")).alias("code6_fact"),
                     X.ni(r.c("class_raw")).alias("classification"),
                     (X.ni(r.c("outcome_raw")) if r.has("outcome_raw") else F.lit(K.NI)).alias("outcome"),
                     (X.ni(r.c("facility_raw")) if r.has("facility_raw") else F.lit(K.NI)).alias("facility"),
                     hp.alias("hospitalised"))
            .agg(F.count(F.lit(1)).alias("cases")))


INDICATOR_SUMS = ("cases_total", "confirmed", "discarded", "investigating", "deaths", "hospitalisations")


def indicator_sums(base: DataFrame, territory: DataFrame) -> DataFrame:
    """The additive part of E24 from the shared base aggregate."""
    cl, n = F.col("classification"), F.col("cases")
    cond = lambda p: F.sum(F.when(p, n).otherwise(0)).cast("bigint")
    agg1 = (base.groupBy("year", "month", "state", F.col("place_code").alias("place_raw"),
                         F.col("code6_fact").alias("code6"))
            .agg(F.sum(n).cast("bigint").alias("cases_total"),
                 cond(cl.isin(*K.CONFIRMED_CODES)).alias("confirmed"),
                 cond(cl.isin(*K.DISCARDED_CODES)).alias("discarded"),
                 cond(cl.isin(*K.INVESTIGATION_CODES)).alias("investigating"),
                 cond(F.col("outcome").isin(*K.DEATH_CODES_CARDS)).alias("deaths"),
                 cond(F.col("hospitalised")).alias("hospitalisations")))
    attrs = territory_attributes(territory)
    j = S.join_territory(agg1, territory, cols=("place_name", *attrs))
    return (j.groupBy("year", "month", "state", F.coalesce("place_name", "place_raw").alias("place"), "code6", *attrs)
            .agg(*[F.sum(c).cast("bigint").alias(c) for c in INDICATOR_SUMS]))


def with_indicator_rates(sums: DataFrame) -> DataFrame:
    """E24's rates, which are not additive, from its sums."""
    return sums.select(
        "*", X.guarded_ratio("confirmed", "population", K.PER_100K).alias("incidence_100k"),
        X.guarded_ratio("deaths", "confirmed", K.PER_100).alias("lethality_pct"),
        X.guarded_ratio("hospitalisations", "confirmed", K.PER_100).alias("hosp_rate_pct"))


def indicators_from_base(base: DataFrame, territory: DataFrame) -> DataFrame:
    """E24 from the shared base aggregate (same rows as ``monthly_indicators``)."""
    return with_indicator_rates(indicator_sums(base, territory))


def cubes_from_base(base: DataFrame, territory: DataFrame) -> dict[str, DataFrame]:
    """E25-E27 as roll-ups of the shared base aggregate."""
    n = F.sum("cases").cast("bigint").alias("cases")
    e25 = base.groupBy("year", "month_start", "state", "classification").agg(n)
    rj = base.filter(F.col("state").isin(*K.FOCUS_STATE_CODES))

    def placed(keys, attrs):
        a = rj.groupBy("year", "month_start", "state", "place_code", "classification", *keys).agg(n)
        a = a.withColumn("code6", X.place_code6("place_code"))
        j = S.join_territory(a, territory, cols=("place_name",) + attrs)
        return j.withColumn("place_name", F.coalesce("place_name", "place_code"))

    e26 = placed(["outcome"], ("population", "area_km2")).select(
        "year", "month_start", "state", "place_code", "place_name", "code6", "population", "area_km2",
        "classification", "outcome", "cases")
    e27 = placed(["facility"], ()).select(
        "year", "month_start", "state", "place_code", "place_name", "code6", "classification", "facility",
        "cases")
    return {"month_state_class": e25, "month_place_class_outcome": e26, "month_place_class_facility": e27}


def build_analytics(f: DataFrame, r: Roles, territory: DataFrame, base_path: str) -> dict[str, object]:
    """Rebuild all derived tables.  The fact is scanned once into the
    shared base aggregate, written under ``base_path`` (a lineage cut that
    survives executor loss); the indicator table (allowed to fail without
    blocking the cubes) and the three cubes are roll-ups of it."""
    from surv.operators.quality import assert_unique
    assert_unique(territory, ["code6"])   # T17: a repeated 6-digit code would fan the joins out
    bpath = f"{base_path}/base"
    analytics_base(f, r).write.mode("overwrite").partitionBy("year").parquet(bpath)
    base = f.sparkSession.read.parquet(bpath)
    out: dict[str, object] = {}
    try:
        out["monthly_indicators"] = write_table(indicators_from_base(base, territory),
                                                f"{base_path}/monthly_indicators")
    except Exception as e:  # noqa: BLE001 - tolerated, reported
        out["monthly_indicators"] = f"failed: {e}"
    for name, df in cubes_from_base(base, territory).items():
        out[name] = write_table(df, f"{base_path}/cubes/{name}")
    return out


# ---- K08 router -------------------------------------------------------------------
def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a table path exists (Hadoop FileSystem, works on any store)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _lattice(spark: SparkSession, f: DataFrame, r: Roles, territory: DataFrame | None, cubes, name: str | None = None):
    """The cubes of a loader: a mapping by name, one cube (a frame or a path that
    may not exist) under ``name``, or none."""
    from surv.operators.lattice import Lattice
    if isinstance(cubes, str):
        cubes = {name: spark.read.parquet(cubes)} if path_exists(spark, cubes) else {}
    elif isinstance(cubes, DataFrame):
        cubes = {name: cubes}
    return Lattice(f, r, territory, cubes or {})


def _request(by, cls=None, since=None, place=None, focus=False, measures=("cases",)):
    from surv.operators.lattice import Request
    where = {"classification": S.norm_list(cls), "state": K.FOCUS_STATE_CODES if focus or place else ()}
    return Request(tuple(by), tuple(measures), where, since, place)


# The loaders below ask the lattice; where no cube can answer they read the fact
# through the loader itself.  ``cube`` is a mapping of cubes, one frame or path, or
# None.
def route_cases_per_year(spark: SparkSession, f: DataFrame, r: Roles, cls: Sequence[str] | None = None, cube=None) -> DataFrame:
    """K08 for E01."""
    from surv.operators import counts as C
    lat, q = _lattice(spark, f, r, None, cube), _request(["year"], cls)
    return lat.answer(q).orderBy("year") if lat.choose(q) else C.cases_per_year(f, r, cls)


def route_month_state(spark: SparkSession, f: DataFrame, r: Roles, cls: Sequence[str] | None = None,
                      since: str | None = None, cube=None) -> DataFrame:
    """K08 for E02."""
    from surv.operators import counts as C
    lat, q = _lattice(spark, f, r, None, cube, "month_state_class"), _request(["year", "month_start", "state"], cls, since)
    return lat.answer(q).orderBy("month_start", "state") if lat.choose(q) else C.cases_month_state(f, r, cls, since)


def route_focus_monthly(spark: SparkSession, f: DataFrame, r: Roles, territory: DataFrame, place: str,
                        cls: Sequence[str] | None = None, since: str | None = None, cube=None) -> DataFrame:
    """K08 for E07."""
    from surv.operators import counts as C
    lat, q = _lattice(spark, f, r, territory, cube, "month_place_class_outcome"), _request(["year", "month_start"], cls, since, place)
    return lat.answer(q).orderBy("month_start") if lat.choose(q) else C.focus_monthly(f, r, territory, place, cls, since)


def route_focus_status(spark: SparkSession, f: DataFrame, r: Roles, territory: DataFrame, place: str,
                       cls: Sequence[str] | None = None, since: str | None = None, cube=None) -> DataFrame:
    """K08 for E09 (month x classification x outcome)."""
    from surv.operators import counts as C
    lat = _lattice(spark, f, r, territory, cube, "month_place_class_outcome")
    q = _request(["year", "month_start", "classification", "outcome"], cls, since, place)
    return lat.answer(q).orderBy("month_start") if lat.choose(q) else C.focus_status(f, r, territory, place, cls, since)


def route_hospitalisations_monthly(spark: SparkSession, f: DataFrame, r: Roles, territory: DataFrame, place: str,
                                   cls: Sequence[str] | None = None, since: str | None = None, cube=None) -> DataFrame:
    """K08 for E18; only the base aggregate knows hospitalisations."""
    from surv.operators import counts as C
    lat, q = _lattice(spark, f, r, territory, cube, "base"), _request(["month_start"], cls, since, place, measures=["hospitalisations"])
    return lat.answer(q).orderBy("month_start") if lat.choose(q) else C.hospitalisations_monthly(f, r, territory, place, cls, since)


def _named(agg: DataFrame, facility: DataFrame | None) -> DataFrame:
    return S.join_facility_name(agg, F.col("facility"), facility) if facility is not None else agg.withColumn("facility_name", F.lit(""))


def route_top_facilities(spark: SparkSession, f: DataFrame, r: Roles, territory: DataFrame,
                         facility: DataFrame | None, place: str, cls: Sequence[str] | None = None,
                         top_n: int = 10, since: str | None = None, cube=None) -> DataFrame:
    """K08 for E12: the cube by facility, then names."""
    from surv.operators import counts as C
    lat, q = _lattice(spark, f, r, territory, cube, "month_place_class_facility"), _request(["facility"], cls, since, place)
    if not lat.choose(q):
        return C.top_facilities(f, r, territory, facility, place, cls, top_n, since)
    out = _named(lat.answer(q), facility).groupBy("facility", "facility_name").agg(F.sum("cases").cast("bigint").alias("cases"))
    return out.orderBy(F.desc("cases"), F.asc("facility")).limit(top_n)


def route_facilities_monthly(spark: SparkSession, f: DataFrame, r: Roles, territory: DataFrame,
                             facility: DataFrame | None, place: str, cls: Sequence[str] | None = None,
                             since: str | None = None, cube=None) -> DataFrame:
    """K08 for E13."""
    from surv.operators import counts as C
    lat = _lattice(spark, f, r, territory, cube, "month_place_class_facility")
    q = _request(["year", "month_start", "facility"], cls, since, place)
    if not lat.choose(q):
        return C.facilities_monthly(f, r, territory, facility, place, cls, since)
    out = (_named(lat.answer(q), facility).groupBy("year", "month_start", "facility", "facility_name")
           .agg(F.sum("cases").cast("bigint").alias("cases")))
    return out.orderBy("month_start", F.desc("cases"), "facility")


def route_state_places(spark: SparkSession, f: DataFrame, r: Roles, territory: DataFrame,
                       cls: Sequence[str] | None = None, since: str | None = None, cube=None) -> DataFrame:
    """K08 for E16, with population, area and incidence."""
    from surv.operators import counts as C
    lat = _lattice(spark, f, r, territory, cube, "month_place_class_outcome")
    q = _request(["year", "month_start", "state", "place_code", "place_name", "population", "area_km2"], cls, since, focus=True)
    if not lat.choose(q):
        return C.state_places_enriched(f, r, territory, cls, since)
    return lat.answer(q).select("year", "month_start", "state", "place_code", "place_name", "cases", "population", "area_km2",
                                X.guarded_ratio("cases", "population", K.PER_100K).alias("incidence_100k"))
