"""Building steps that one task or one interpreted method used to carry."""
import datetime as dt
import os

from pyspark.sql import functions as F

from surv.operators import conform as B
from surv.plans import fixtures as FX
from surv.session import split_methods


def _tables(spark, path, n=300):
    (spark.range(n).select(F.col("id").alias("o_orderkey"), (F.col("id") % 40).alias("o_custkey"),
                           F.expr("timestamp_ntz '1996-01-01' + make_dt_interval(CAST(id % 900 AS INT))").alias("o_orderdate"))
     .write.parquet(f"{path}/orders.parquet"))
    spark.range(40).select(F.col("id").alias("c_custkey"), (F.col("id") % 5).cast("int").alias("c_nationkey")).write.parquet(f"{path}/customer.parquet")
    (spark.range(5).select(F.col("id").cast("int").alias("n_nationkey"), F.concat(F.lit("NATION_"), "id").alias("n_name"), (F.col("id") % 5).cast("int").alias("n_regionkey"))
     .write.parquet(f"{path}/nation.parquet"))


def test_the_fact_is_shuffled_as_source_columns(spark, tmp):
    _tables(spark, tmp)
    fact = FX.clustered_cases(spark, tmp)
    want = FX.cases_plan(spark, tmp)
    cols = want.columns
    key = lambda rows: sorted(tuple(str(v) for v in r) for r in rows)
    assert key(fact.select(cols).collect()) == key(want.collect())
    plan = fact._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression"):]
    assert "serotype_raw" not in below and "pregnant_raw" not in below


def test_the_method_limit_is_put_back(spark):
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    with split_methods(spark):
        assert spark.conf.get(name) == "8000"
    assert spark.conf.get(name) == before


def test_only_the_fitting_date_format_is_tried(spark):
    texts = ["2024-01-02", " 2024-1-2 3:4 ", "2024-01-02T10:30", "2024-01-02T10:30:05Z", "2024-01-02 10:30:05.123", "2024-01-02 junk", "2024-02-30 1:2:3", "2024-01-02 25:00", ":", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[1] for r in df.select("i", B.parse_date(F.col("t"))).orderBy("i").collect()]
    d = dt.date(2024, 1, 2)
    assert got == [d, d, None, d, d, d, None, None, None, None]
    plan = df.select(B.parse_timestamp(F.col("t")))._jdf.queryExecution().analyzed().toString()
    assert "coalesce(try_to_timestamp" not in plan


def test_digits_of_text_with_space_and_tokens(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([" 33\t", "nan", "None", "", ".", None, "12345678", "a1b2"])], "i int, t string")
    assert [r[1] for r in df.select("i", B.digits_or_null(F.col("t"), 7)).orderBy("i").collect()] == ["0000033", None, None, None, None, None, "12345678", "0000012"]
    plain = [r[1] for r in df.select("i", B.digits_or_null(F.col("t"))).orderBy("i").collect()]
    assert plain == ["33", None, None, None, None, None, "12345678", "12"]
    assert [r[1] for r in df.select("i", B.strip_all(F.col("t"))).orderBy("i").collect()][:2] == ["33", "nan"]
    assert "rlike" not in df.select(B.digits_or_null(F.col("t"), 7))._jdf.queryExecution().optimizedPlan().toString().lower()


def test_a_large_array_is_several_documents(spark, tmp):
    from surv.plans import q_io as Q
    from surv.sources import readers as R
    rows = spark.range(2000).select("id", F.to_json(F.struct("id", F.lit('"} ]{ "parametros":[').alias("t"))).alias("json"))
    for size, files in ((1 << 30, 1), (20_000, 5)):
        p = Q._documents(spark, f"{tmp}/{size}", rows, '{"meta": [{"id": 0}], "parametros" : [ null', '], "after": {"parametros": [{"id": 5}]}}', size)
        got = [x for x in os.listdir(p) if x.startswith("part-")]
        assert len(got) >= files and (files > 1 or len(got) == 1)
        assert max(os.path.getsize(f"{p}/{x}") for x in got) < max(size, 200_000) and (files == 1 or max(os.path.getsize(f"{p}/{x}") for x in got) < 60_000)
        assert sorted(r.id for r in R.read_json_records(spark, p).select("id").collect()) == list(range(2000))


def test_a_delivery_lands_in_files_of_bounded_rows(spark, tmp, monkeypatch):
    from surv.plans import q_io as Q
    seen = {}
    stage = Q.W.staging_path
    monkeypatch.setattr(Q.W, "staging_path", lambda s, n: seen.setdefault(n, stage(s, n)))
    monkeypatch.setattr(Q, "LANDED_ROWS", 50, raising=False)
    (spark.range(400).select(F.col("id").alias("event_id"), F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(CAST(id % 5 AS INT))").alias("ts"), F.lit("a").alias("event_type"))
     .coalesce(1).write.parquet(f"{tmp}/events.parquet"))
    got = Q.j03(spark, tmp).groupBy("kind").count().collect()
    assert {r[0]: r[1] for r in got} == {"late": 80, "a": 320}
    landed = [len(spark.read.parquet(f"{seen['j03']}/land/0/{x}").collect()) for x in os.listdir(f"{seen['j03']}/land/0") if x.startswith("part-")]
    assert sum(landed) == 400 and max(landed) <= 50


def _orders_by_path(spark, path, keys, monkeypatch, document_bytes):
    from surv.plans import q_io as Q
    seen = {}
    stage = Q.W.staging_path
    monkeypatch.setattr(Q.W, "staging_path", lambda s, n: seen.setdefault(n, stage(s, n)))
    monkeypatch.setattr(Q, "DOCUMENT_BYTES", document_bytes)
    keys.select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.lit("F")).alias("o_orderstatus")).write.parquet(f"{path}/orders.parquet")
    got = sorted((int(r.id), r.status) for r in Q.a06_path(spark, path).collect())
    texts = [open(os.path.join(d, x)).read() for d, _, names in os.walk(seen["a06-path"]) for x in names if x.startswith("part-")]
    return got, texts


def test_xml_documents_are_written_by_several_tasks(spark, tmp, monkeypatch):
    ids = spark.range(4000).select(F.col("id").alias("o_orderkey"))
    keys = ids.union(ids.where("o_orderkey < 100")).union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    got, texts = _orders_by_path(spark, tmp, keys, monkeypatch, 20_000)
    want = [i for i in [*range(4000), *range(100)] if i % 3 and i % 5]
    assert got == sorted((i, "F") for i in want)
    assert len(texts) >= 8 and max(map(len, texts)) < 60_000
    for p in ("a", "bb"):
        assert sum(t.startswith(f'<root xmlns:{p}="urn:orders"><list>') for t in texts) >= 4
    assert all(t.count("<root") == t.count("</root>") == 1 for t in texts)   # one document in a file


def test_xml_documents_of_one_prefix_only(spark, tmp, monkeypatch):
    got, texts = _orders_by_path(spark, tmp, spark.range(0, 400, 2).select(F.col("id").alias("o_orderkey")), monkeypatch, 1 << 30)
    assert got == [(i, "F") for i in range(0, 400, 2) if i % 3 and i % 5]
    assert len(texts) == 2 and sorted(t.count("<id>") for t in texts)[0] == 0
