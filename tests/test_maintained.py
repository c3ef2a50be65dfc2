"""Maintained cubes equal a rebuild; requests answered by cubes equal the fact."""

import glob
import itertools
import os

import pytest
from pyspark.sql import functions as F

from surv.operators import cubes as CU
from surv.operators import lattice as LT
from surv.plans import fixtures as FX
from surv.plans.panels import Panels
from surv.roles import FIXTURE_ROLES as R
from surv.streaming import maintained as M
from tests.conftest import SF_SMALL


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def fact(spark):
    return FX.cases(spark, SF_SMALL).withColumn("year", F.col("notified_year")).drop("notified_year")


def want(f, t):
    return {"month_state_class": CU.cube_month_state_class(f, R), "month_place_class_outcome": CU.cube_month_place_class_outcome(f, R, t),
            "month_place_class_facility": CU.cube_month_place_class_facility(f, R, t), "monthly_indicators": CU.monthly_indicators(f, R, t),
            "base": CU.analytics_base(f, R)}


def test_three_deliveries_with_late_and_emptied_days(spark, tmp):
    f, t = fact(spark).filter("notified_on < '1999-01-01' OR notified_on IS NULL"), FX.territory(spark, SF_SMALL)
    w = M.Warehouse(spark, f"{tmp}/wh", R, t)
    first = f.filter("notified_on < '1997-07-01' OR notified_on IS NULL")
    w.replace_window(first, "1900-01-01")

    def check(expected):
        assert rows(w.read()) == rows(expected)
        for name, df in want(expected, t).items():
            assert rows(w.read(name)) == rows(df), name

    check(first)
    # the overlap window again, with newer days, one class changed, some rows withdrawn
    new = f.filter("notified_on >= '1997-06-01' AND case_id % 3 <> 0").withColumn("class_raw", F.lit("10"))
    got = w.replace_window(new, "1997-06-01")
    assert got["years"] == [1997, 1998] and set(got["partitions"]) == {"1997", "1998"}
    state = first.filter("notified_on IS NULL OR notified_on < '1997-06-01'").unionByName(new)
    check(state)
    # late days of one year, and rows without a day
    late = (f.filter("(notified_on BETWEEN '1995-03-01' AND '1995-05-20' AND case_id % 5 <> 0) OR (notified_on IS NULL AND case_id % 5 = 1)")
            .withColumn("outcome_raw", F.lit("2")))
    days = {r[0] for r in late.select("notified_on").distinct().collect() if r[0]}
    got = w.replace_days(late)
    assert got["years"] == [1995]
    state = state.filter(F.col("notified_on").isNull() | ~F.col("notified_on").isin(list(days))).unionByName(late)
    check(state)
    # emptied days, a whole year among them
    got = w.empty_days("1996-01-01", "1997-02-10")
    assert got["years"] == [1996, 1997] and "1996" not in w.group.state()["tables"]["fact"]["parts"]
    state = state.filter("notified_on IS NULL OR notified_on NOT BETWEEN '1996-01-01' AND '1997-02-10'")
    assert w.latest_day() == str(state.agg(F.max("notified_on")).first()[0])
    # only the files of the year that changes are read: the others are unreadable meanwhile
    others = [p for p in glob.glob(f"{w.group.base}/*/year=*/gen=*/*.parquet") if "year=1995" not in p]
    kept = {p: open(p, "rb").read() for p in others}
    for p in others:
        open(p, "wb").write(b"no parquet")
        os.path.exists(crc := os.path.join(os.path.dirname(p), f".{os.path.basename(p)}.crc")) and os.remove(crc)
    again = late.filter("notified_on IS NOT NULL").withColumn("class_raw", F.lit("8"))
    assert w.replace_days(again) == {"version": 5, "partitions": ["1995"], "years": [1995]}
    for p, data in kept.items():
        open(p, "wb").write(data)
    late = again
    state = state.filter(F.col("notified_on").isNull() | ~F.col("notified_on").isin(list(days))).unionByName(again)
    check(state)
    # the same days once more change nothing but the version
    before = {n: rows(w.read(n)) for n in want(f, t)}
    assert w.replace_days(late)["years"] == []
    assert before == {n: rows(w.read(n)) for n in want(f, t)}


def test_a_changed_dimension_rebuilds_the_cubes(spark, tmp):
    f, t = fact(spark).filter("year IN (1996, 1997)"), FX.territory(spark, SF_SMALL)
    M.Warehouse(spark, f"{tmp}/dim", R, t).replace_window(f.filter("year = 1996"), "1900-01-01")
    t2 = t.withColumn("population", F.col("population") + 1).withColumn("place_name", F.concat("place_name", F.lit(" NEW")))
    w = M.Warehouse(spark, f"{tmp}/dim", R, t2)
    w.replace_window(f.filter("year = 1997"), "1997-01-01")
    for name, df in want(f, t2).items():
        assert rows(w.read(name)) == rows(df), name


def test_a_foreign_cube_is_an_error(spark, tmp):
    f, t = fact(spark).filter("year = 1996"), FX.territory(spark, SF_SMALL)
    w = M.Warehouse(spark, f"{tmp}/bad", R, t)
    w.replace_window(f, "1900-01-01")
    w.group.publish({"base": M.Change(w.read("base").limit(3), "year")})
    version = w.group.state()["version"]
    with pytest.raises(Exception, match="below zero"):
        w.empty_days("1996-01-01", "1996-12-31")
    assert w.group.state()["version"] == version


@pytest.fixture(scope="module")
def lattice(spark, tmp_path_factory):
    f, t = fact(spark), FX.territory(spark, SF_SMALL)
    w = M.Warehouse(spark, str(tmp_path_factory.mktemp("lat")), R, t)
    w.replace_window(f, "1900-01-01")
    return LT.Lattice(f, R, t, LT.stored_cubes(spark, w.group.base)), w


def test_any_subset_of_the_grains(lattice):
    lat, _ = lattice
    plain = LT.Lattice(lat.fact, R, lat.territory, {})
    subsets = [c for k in range(4) for c in itertools.combinations(LT.ALL_DIMS + ("place_name", "year"), k)]
    for i, by in enumerate(subsets[::5]):
        q = LT.Request(by, ("cases", "confirmed", "deaths")[: 1 + i % 3], {"state": LT.K.FOCUS_STATE_CODES} if i % 2 else {},
                       [None, "1996-01-01", "1996-01-15"][i % 3], FX.FOCUS_PLACE if i % 4 == 3 else None)
        name = lat.choose(q)
        assert (name is None) == (q.since == "1996-01-15")
        assert rows(lat.answer(q)) == rows(plain.answer(q)), (q, name)


@pytest.mark.parametrize("q,name", [
    (LT.Request(("year",)), "month_state_class"),
    (LT.Request(("month_start", "classification"), ("confirmed",)), "month_state_class"),
    (LT.Request(("state",), ("deaths",)), "base"),
    (LT.Request(("outcome",), ("deaths",), {"state": ("RJ",)}), "month_place_class_outcome"),
    (LT.Request(("place_name", "facility"), where={"state": ("RJ", "33")}), "month_place_class_facility"),
    (LT.Request(("place_name",), where={"state": ("SP",)}), "base"),
    (LT.Request(("year",), since="1996-01-02"), None),
])
def test_the_plan_reads_the_chosen_table(lattice, q, name):
    lat, w = lattice
    assert lat.choose(q) == name
    files = [p for p in lat.answer(q).inputFiles() if SF_SMALL not in p]      # without the dimension
    assert files and all((f"{w.group.base}/{name}/" in p) if name else ("/facts/" in p) for p in files)


def test_panels_over_a_published_warehouse(lattice, spark):
    lat, w = lattice
    fac = FX.facility(spark, SF_SMALL)
    cubed, plain = (Panels(lat.fact, R, lat.territory, fac, cube_base=b) for b in (w.group.base, None))
    for call in ("cases_per_year", "cases_month_state"):
        assert rows(getattr(cubed, call)()) == rows(getattr(plain, call)())
    for call in ("focus_monthly", "focus_status", "hospitalisations_monthly", "top_facilities", "facilities_monthly"):
        a, b = (getattr(p, call)(FX.FOCUS_PLACE, ("1", "2", "5")) for p in (cubed, plain))
        assert rows(a) == rows(b) and not any("/facts/" in p for p in a.inputFiles()), call
