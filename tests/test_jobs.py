"""End-to-end jobs on JSON extracts derived from the driver tables."""

import os

from pyspark.sql import functions as F

from surv.operators import counts as C
from surv.plans import fixtures as FX
from surv.plans import jobs as J
from surv.sources.published import read_table
from surv.roles import FIXTURE_ROLES, NATIVE_ROLES
from tests.conftest import SF_SMALL


def _extract(spark, tmp, name, cond):
    raw = FX.native_raw(spark, SF_SMALL).filter(cond)
    p = f"{tmp}/{name}"
    raw.coalesce(1).write.json(p)   # JSON lines, one record per row
    return p


def test_backfill_then_panels_equal_fixture(spark, tmp):
    files = []
    for y in (1995, 1996, 1997, 1998):
        files.append((y, _extract(spark, tmp, f"y{y}", F.substring("DT_NOTIFIC", 1, 4) == str(y))))
    out = J.backfill_years(spark, files, "json", f"{tmp}/wh", territory=FX.territory(spark, SF_SMALL),
                           multiline=False, normalize=False)
    assert out["years"] == [1995, 1996, 1997, 1998]
    fact = read_table(spark, f"{tmp}/wh/fact")
    got = C.cases_month_state(fact, NATIVE_ROLES)
    f = FX.cases(spark, SF_SMALL).filter(F.year("notified_on").between(1995, 1998))
    want = C.cases_month_state(f, FIXTURE_ROLES)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    rec = {r.year: r.status for r in out["reconciliation"].collect()}
    assert set(rec) == {1995, 1996, 1997, 1998} and all(s for s in rec.values())
    assert out["analytics"]["month_state_class"] > 0


def test_incremental_runs_overlap_and_marks(spark, tmp):
    wh = f"{tmp}/wh2"
    p1 = _extract(spark, tmp, "d1", F.col("DT_NOTIFIC") < "1996-01-01")
    r1 = J.incremental_run(spark, "json", p1, wh, fallback_year=1990, multiline=False, normalize=False)
    assert r1["rows"] > 0
    # second delivery: everything from the first mark minus the overlap, with one more year
    p2 = _extract(spark, tmp, "d2", (F.col("DT_NOTIFIC") >= "1995-12-01") & (F.col("DT_NOTIFIC") < "1997-01-01"))
    r2 = J.incremental_run(spark, "json", p2, wh, multiline=False, normalize=False)
    assert r2["window_start"] < str(r1["max_date"])
    fact = read_table(spark, f"{wh}/fact")
    n_want = FX.cases(spark, SF_SMALL).filter(F.col("notified_on") < "1997-01-01").count()
    assert fact.count() == n_want
    runs = spark.read.parquet(f"{wh}/_runs")
    assert runs.filter("status = 'success'").count() == 2
    assert read_table(spark, f"{wh}/_state").first().last_success_date == r2["max_date"]
    assert os.path.isdir(f"{wh}/_raw/json")


def test_incremental_failure_keeps_mark(spark, tmp):
    import pytest
    wh = f"{tmp}/wh3"
    p1 = _extract(spark, tmp, "f1", F.col("DT_NOTIFIC") < "1995-06-01")
    r1 = J.incremental_run(spark, "json", p1, wh, fallback_year=1990, multiline=False, normalize=False)
    with pytest.raises(RuntimeError):
        J.incremental_run(spark, "xml-ish", p1, wh)          # unknown source kind -> failed run
    runs = spark.read.parquet(f"{wh}/_runs")
    assert runs.filter("status = 'failed'").count() == 1
    assert read_table(spark, f"{wh}/_state").first().last_success_date == r1["max_date"]
    assert read_table(spark, f"{wh}/fact").count() == r1["rows"]


def test_panels_facade_routes_to_cubes(spark, tmp):
    from surv.operators import cubes as CU
    from surv.plans.panels import Panels
    f, t, fac = FX.cases(spark, SF_SMALL), FX.territory(spark, SF_SMALL), FX.facility(spark, SF_SMALL)
    plain = Panels(f, FIXTURE_ROLES, t, fac)
    CU.refresh_cubes(f, FIXTURE_ROLES, t, f"{tmp}/cubes")
    cubed = Panels(f, FIXTURE_ROLES, t, fac, cube_base=f"{tmp}/cubes")
    rows = lambda d: sorted(map(tuple, d.collect()), key=repr)
    assert rows(plain.cases_month_state(since="1996-01-01")) == rows(cubed.cases_month_state(since="1996-01-01"))
    assert rows(plain.focus_monthly(FX.FOCUS_PLACE)) == rows(cubed.focus_monthly(FX.FOCUS_PLACE))
    assert rows(plain.top_facilities(FX.FOCUS_PLACE)) == rows(cubed.top_facilities(FX.FOCUS_PLACE))
    assert plain.facility_risk(FX.FOCUS_PLACE).count() > 0
    assert plain.clinical_extract(FX.FOCUS_PLACE).count() == plain.evaluation_extract(FX.FOCUS_PLACE).count()


def test_maintenance_reports(spark, tmp):
    p = _extract(spark, tmp, "rep", F.col("DT_NOTIFIC") < "1997-01-01")
    raw = spark.read.json(p)
    fact = J.conform_batch(raw)
    t = FX.territory(spark, SF_SMALL)
    v = J.field_validity_report(spark, fact, t, FX.FOCUS_PLACE, f"{tmp}/validity.csv")
    assert v.filter("status = 'COLUNA_AUSENTE'").count() == 0 and v.count() > 10
    log = f"{tmp}/load.log"
    n95 = fact.filter(F.year("data_notificacao") == 1995).count()
    open(log, "w").write(f"Arquivo concluido: {n95} linhas carregadas (DENGBR95.json)\n")
    rec = {r.year: r.status for r in J.reconciliation_report(spark, fact, log, 2095, 2095, f"{tmp}/rec.csv",
                                                             tolerance_abs=0, tolerance_pct=0).collect()}
    assert rec == {2095: "DIVERGENTE"}   # the log's 2-digit year maps to 20yy
    a = J.schema_audit_report(spark, raw, fact, f"{tmp}/audit.csv")
    st = {r.name: r.status for r in a.collect()}
    assert st["dt_notific"] == "OK" and st["data_notificacao"] == "OK"


def test_dimension_load_jobs(spark, tmp):
    csv = f"{tmp}/mun.csv"
    open(csv, "w", encoding="utf-8").write(
        "Código do Município,Nome do Município,Código do Estado,Nome do Estado,Total de pessoas\n"
        "3300159,Vila Nova,33,Rio de Janeiro,\"1.234\"\n3300209,Outra,33,Rio de Janeiro,10\n")
    assert J.load_municipality_dimension(spark, csv, f"{tmp}/dim_mun") == 2
    base = f"{tmp}/cnes"
    os.makedirs(f"{base}/period=202401")
    os.makedirs(f"{base}/period=202403")
    open(f"{base}/period=202401/a.csv", "wb").write("CNES;NOME\n1;Old\n".encode("latin1"))
    open(f"{base}/period=202403/b.csv", "wb").write("CO_CNES;NO_FANTASIA\n1;Nova Unidade\n2;Posto\n".encode("latin1"))
    assert J.load_facility_dimension(spark, base, f"{tmp}/dim_fac") == 2
    got = {r.cnes: r.nome_fantasia for r in read_table(spark, f"{tmp}/dim_fac").collect()}
    assert got == {"0000001": "Nova Unidade", "0000002": "Posto"}
