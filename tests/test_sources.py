"""Source/sink round trips through fresh temp dirs (2A)."""

import json
import os

import pytest
from pyspark.sql import functions as F

from surv.sources import readers as R
from surv.sources import writers as W
from surv.sources.published import read_table
from tests.conftest import SF_SMALL


def test_csv_json_xml_round_trips(spark, tmp):
    nation = spark.read.parquet(f"{SF_SMALL}/nation.parquet")
    nation.write.option("header", True).csv(f"{tmp}/csv")
    back = R.read_csv(spark, f"{tmp}/csv")
    assert back.count() == 25 and back.columns == nation.columns
    nation.write.json(f"{tmp}/json")
    assert R.read_json(spark, f"{tmp}/json", multiline=False).count() == 25
    nation.write.format("xml").option("rowTag", "n").option("rootTag", "ns").save(f"{tmp}/xml")
    x = R.read_xml(spark, f"{tmp}/xml", row_tag="n")
    assert x.count() == 25 and dict(x.dtypes)["n_nationkey"] == "string"


def test_json_envelope_and_array(spark, tmp):
    recs = [{"id": 1, "a": {"b": 2, "c": {"d": "x"}}}, {"id": 2, "a": {"b": 3, "c": {"d": "y"}}}]
    open(f"{tmp}/arr.json", "w").write(json.dumps(recs))
    open(f"{tmp}/env.json", "w").write(json.dumps({"parametros": recs}))
    a = R.read_json_records(spark, f"{tmp}/arr.json")
    e = R.read_json_records(spark, f"{tmp}/env.json")
    assert a.count() == 2 and e.count() == 2
    flat = R.flatten(e)
    assert set(flat.columns) == {"id", "a.b", "a.c.d"}
    assert sorted(r["a.c.d"] for r in flat.collect()) == ["x", "y"]


def test_read_source_dispatch(spark, tmp):
    with pytest.raises(ValueError):
        R.read_source(spark, "parquetish", tmp)
    with pytest.raises(NotImplementedError):
        R.read_source(spark, "api", tmp)


def test_latest_snapshot_and_year_range(spark, tmp):
    cu = spark.read.parquet(f"{SF_SMALL}/customer.parquet")
    cu.limit(5).withColumn("period", F.lit("202401")).write.partitionBy("period").option("header", True).csv(f"{tmp}/snap")
    cu.limit(7).withColumn("period", F.lit("202403")).write.mode("append").partitionBy("period").option("header", True).csv(f"{tmp}/snap")
    assert R.latest_snapshot(spark, f"{tmp}/snap").count() == 7
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet").withColumn("year", F.year("o_orderdate"))
    o.write.partitionBy("year").parquet(f"{tmp}/years")
    got = R.read_year_range(spark, f"{tmp}/years", 1996, 1997)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "year" in plan
    assert got.count() == o.filter(F.col("year").between(1996, 1997)).count()


def test_load_log_last_line_wins(spark, tmp):
    p = f"{tmp}/load.log"
    open(p, "w").write("x\nArquivo concluido: 10 linhas carregadas (DENGBR23.json)\n"
                       "Arquivo concluido: 12 linhas carregadas (DENGBR23.json)\n"
                       "Arquivo concluido: 5 linhas carregadas (DENGBR24.json)\n")
    got = {r.year: r.loaded_rows for r in R.read_load_log(spark, p).collect()}
    assert got == {2023: 12, 2024: 5}


def test_load_log_encodings_and_file_order(spark, tmp):
    line = "Arquivo concluido: {} linhas carregadas (DENGBR{}.json)\n"
    for name, enc, mark, year in (("a.log", "utf-16-le", b"\xff\xfe", 21), ("b.log", "utf-16-be", b"\xfe\xff", 22), ("c.log", "utf-8", b"\xef\xbb\xbf", 23),
                                  ("d.log", "latin-1", b"", 24), ("e.log", "utf-8", b"", 25)):
        open(f"{tmp}/{name}", "wb").write(mark + ("Início às 3\n" + line.format(1, year) + "x\r\n" + line.format(year, year)).encode(enc))
        os.utime(f"{tmp}/{name}", (1_700_000_000, 1_700_000_000))
    # a later file says it again
    open(f"{tmp}/0.log", "w").write(line.format(99, 25))
    os.utime(f"{tmp}/0.log", (1_700_000_100, 1_700_000_100))
    got = {r.year: r.loaded_rows for r in R.read_load_log(spark, f"{tmp}/*.log").collect()}
    assert got == {2021: 21, 2022: 22, 2023: 23, 2024: 24, 2025: 99}


def test_json_column_schema_from_all_rows(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, None), (3, '{"a": 2, "b": "x"}'), (4, "no json"), (5, '{"c": {"d": true}, "e": null}')], "k int, j string")
    got = {r.k: r for r in R.parse_json_column(df, "j").collect()}
    assert got[1]["j.a"] == 1 and got[3]["j.b"] == "x" and got[5]["j.c"].d is True and got[5]["j.e"] is None and got[2]["j.a"] is None
    assert R.parse_json_column(df.filter("k = 2"), "j").columns == ["k", "j"]


def test_year_from_name(spark):
    df = spark.createDataFrame([("Dengue - 2023",), ("DENGBR24",), ("BASE_DE_DADOS_CNES_202401.ZIP",)], "n string")
    got = [r[0] for r in df.select(R.year_from_name(F.col("n"))).collect()]
    assert got == [2023, None, None]
    per = [r[0] for r in df.select(R.year_from_name(F.col("n"), R.FACILITY_FILE_PATTERN)).collect()]
    assert per == [None, None, 202401]


def test_writers(spark, tmp):
    df = spark.read.parquet(f"{SF_SMALL}/region.parquet")
    assert W.write_table(df.limit(0), f"{tmp}/t") is False
    assert W.write_table(df, f"{tmp}/t") is True
    with pytest.raises(Exception):
        W.write_table(df, f"{tmp}/t", if_exists="fail")
    W.write_table(df, f"{tmp}/t", if_exists="append")
    assert spark.read.parquet(f"{tmp}/t").count() == 10
    W.replace_table(spark, df, f"{tmp}/u")
    W.replace_table(spark, read_table(spark, f"{tmp}/u").filter("r_regionkey < 2"), f"{tmp}/u")
    assert read_table(spark, f"{tmp}/u").count() == 2
    assert W.refresh_dimension(spark, df, f"{tmp}/dim") == 5
    snap = W.save_raw_snapshot(df, f"{tmp}/raw", "json", "dengbr24", ts="20240101")
    assert snap.endswith("json/dengbr24_20240101") and spark.read.parquet(snap).count() == 5
    W.write_report_csv(df, f"{tmp}/rep")
    f = [x for x in os.listdir(f"{tmp}/rep") if x.endswith(".csv")][0]
    assert open(f"{tmp}/rep/{f}", "rb").read().startswith(b"\xef\xbb\xbf")


def test_parameterized_sql_and_existence(spark):
    df = spark.read.parquet(f"{SF_SMALL}/nation.parquet")
    df.createOrReplaceTempView("nation_t")
    got = R.run_sql(spark, "SELECT count(*) AS n FROM nation_t WHERE n_regionkey = :r", r=0).first().n
    assert got == 5
    assert R.table_exists(spark, "nation_t") and not R.table_exists(spark, "nope_t")
    assert R.column_set(df) == set(df.columns)



def test_answers_from_metadata(spark, tmp):
    """The plan shows the pushed aggregate; the latest snapshot opens one folder."""
    import datetime as dt
    from surv.operators import scope as S
    from surv.sources import metadata as MD
    df = spark.range(1000).selectExpr("id", "date_add(DATE'2020-01-01', CAST(id AS INT)) AS d").withColumn("y", F.year("d"))
    df.unionByName(spark.createDataFrame([(5000, None, None)], "id long, d date, y int")).write.partitionBy("y").parquet(f"{tmp}/t")
    plan = MD.pushed(spark, f"{tmp}/t", F.count(F.lit(1)), F.max("d"), F.min("id"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MAX(d), MIN(id)]" in plan.replace("`", "")
    assert MD.footer_aggregates(spark, f"{tmp}/t", ["d"], ["id"]) == {"total": 1001, "max_d": dt.date(2022, 9, 26), "min_id": 0}
    assert MD.footer_aggregates(spark, f"{tmp}/t", ["d"], ["d"], {"d": "y"}) == {"total": 1001, "max_d": dt.date(2022, 9, 26), "min_d": dt.date(2020, 1, 1)}
    assert "PushedAggregation: [MAX(d)]" in MD.pushed(spark, f"{tmp}/t", F.max("d"), part_col="y")._jdf.queryExecution().executedPlan().toString()
    assert MD.footer_aggregates(spark, f"{tmp}/t/y=2021", ["d"], ["d"]) == {"total": 365, "max_d": dt.date(2021, 12, 31), "min_d": dt.date(2021, 1, 1)}
    assert MD.latest_value(spark, f"{tmp}/t", "d", "y") == dt.date(2022, 9, 26)
    t = spark.read.parquet(f"{tmp}/t")
    for n in (1, 3, 12, None):
        a, b = (sorted(r.id for r in S.last_months_window(t, n, "d", latest).collect()) for latest in (None, dt.date(2022, 9, 26)))
        assert a == b and a
    for p in (9, 10):
        os.makedirs(f"{tmp}/s/period={p}")
        open(f"{tmp}/s/period={p}/f.csv", "w").write(f"a,b\n{p},x\n")
    open(f"{tmp}/s/period=9/f.csv", "wb").write(b"\xff\x00")
    os.chmod(f"{tmp}/s/period=9/f.csv", 0)
    snap = R.latest_snapshot(spark, f"{tmp}/s")
    assert [tuple(r) for r in snap.collect()] == [("10", "x", 10)] and all("period=10" in f for f in snap.inputFiles())
    with pytest.raises(ValueError):
        R.latest_snapshot(spark, f"{tmp}/nothing")


def test_xml_nodes_by_path(spark, tmp):
    doc = """<?xml version="1.0"?><root xmlns:{p}="urn:x" xmlns:o="urn:other"><meta><row><id>0</id></row></meta>
<{p}:data><{p}:group name="g1"><{p}:row k="7"><id> 1 </id><v>a</v></{p}:row><{p}:row><id>2</id></{p}:row></{p}:group>
<{p}:group><{p}:row><id>3</id><v>c</v></{p}:row><o:row><id>9</id></o:row></{p}:group></{p}:data></root>"""
    for i, p in enumerate(("d", "other")):
        open(f"{tmp}/{i}.xml", "w").write(doc.format(p=p))
    ids = lambda *a, **k: sorted(r.id for r in R.read_xml_nodes(spark, [f"{tmp}/0.xml", f"{tmp}/1.xml"], *a, **k).collect())
    ns = {"x": "urn:x", "q": "urn:other"}
    assert R.namespace_prefixes(spark, [f"{tmp}/0.xml", f"{tmp}/1.xml"], "urn:x") == ["d", "other"]
    assert ids("//row") == sorted("01239" * 2)
    assert ids(".//x:row", namespaces=ns) == sorted("123" * 2) and ids("//q:row", namespaces=ns) == ["9", "9"]
    assert ids("//group/row") == sorted("1239" * 2) and ids("root/meta/row") == ["0", "0"] and ids("root/data/group/row") == sorted("1239" * 2)
    assert ids("root/x:data/x:group/x:row", namespaces=ns) == sorted("123" * 2)
    got = {r.id: r.v for r in R.read_xml_nodes(spark, f"{tmp}/0.xml", "//x:row", ns).collect()}
    assert got == {"1": "a", "2": None, "3": "c"}
    assert R.read_xml_nodes(spark, f"{tmp}/0.xml", "root/nothing/row").count() == 0
