"""Invariants from the test strategy: cube roll-up equals the direct
aggregate, filled + blank = total, valid + invalid = filled, shares sum to
100, the indicator table keeps every notified row."""

import os
import re

import pytest
from pyspark.sql import functions as F

from surv.operators import counts as C
from surv.operators import cubes as CU
from surv.operators import profile as P
from surv.operators import quality as Q
from surv.operators import scope as S
from surv.plans import fixtures as FX
from surv.roles import FIXTURE_ROLES as R
from tests.conftest import SF_SMALL


def data(spark):
    return FX.cases(spark, SF_SMALL), FX.territory(spark, SF_SMALL)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_cube_route_equals_fact_route(spark, tmp):
    f, t = data(spark)
    for cls, since in [((), None), (("1", "2"), "1996-01-01"), (("NI",), "1998-03-01")]:
        fact = C.cases_month_state(f, R, cls, since)
        cube = CU.route_month_state(spark, f, R, cls, since, cube=CU.cube_month_state_class(f, R))
        assert rows(fact) == rows(cube)
    # from a written cube path (K05 then K08); missing path falls back to the fact
    paths = CU.refresh_cubes(f, R, t, f"{tmp}/cubes")
    assert paths["month_state_class"] > 0
    via_path = CU.route_month_state(spark, f, R, cube=f"{tmp}/cubes/month_state_class")
    assert rows(via_path) == rows(C.cases_month_state(f, R))
    assert rows(CU.route_month_state(spark, f, R, cube=f"{tmp}/nope")) == rows(C.cases_month_state(f, R))


def test_field_validity_identities(spark):
    f, t = data(spark)
    v = Q.field_validity(S.place_scope(S.notified(f, R), R, t, FX.FOCUS_PLACE), R).collect()
    assert v
    for r in v:
        assert r.filled + r.blank_ni == r.total
        assert r.valid + r.invalid == r.filled


def test_shares_sum_to_100(spark):
    f, t = data(spark)
    parts = {"MUN": P.demographic_monthly(f, R, t, FX.FOCUS_PLACE),
             "BR": P.demographic_monthly_scope(f, R, "BR")}
    s = P.scope_shares(parts, F.col("age_band"), "age_band").groupBy("scope").agg(F.sum("pct").alias("p"))
    for r in s.collect():
        assert abs(r.p - 100.0) < 1e-9


def test_indicator_table_keeps_all_notified_rows(spark):
    f, t = data(spark)
    total = CU.monthly_indicators(f, R, t).agg(F.sum("cases_total")).first()[0]
    assert total == S.notified(f, R).count()
    e24 = CU.monthly_indicators(f, R, t)
    bad = e24.filter(F.col("confirmed") + F.col("discarded") > F.col("cases_total")).count()
    assert bad == 0


def test_build_analytics_job(spark, tmp):
    f, t = data(spark)
    out = CU.build_analytics(f, R, t, f"{tmp}/analytics")
    assert out["monthly_indicators"] > 0 and out["month_place_class_outcome"] > 0
    assert spark.read.parquet(f"{tmp}/analytics/cubes/month_state_class").count() == out["month_state_class"]


def test_build_from_base_equals_direct_operators(spark, tmp):
    f, t = data(spark)
    base = CU.analytics_base(f, R)
    assert rows(CU.indicators_from_base(base, t)) == rows(CU.monthly_indicators(f, R, t))
    cubes = CU.cubes_from_base(base, t)
    assert rows(cubes["month_state_class"]) == rows(CU.cube_month_state_class(f, R))
    assert rows(cubes["month_place_class_outcome"]) == rows(CU.cube_month_place_class_outcome(f, R, t))
    assert rows(cubes["month_place_class_facility"]) == rows(CU.cube_month_place_class_facility(f, R, t))


def test_shuffle_join_equals_broadcast_join(spark):
    """Past the broadcast bound the join by key returns the same rows, also
    when one key holds most of the fact, and reads only the columns used."""
    from surv import session as SS
    f, t = data(spark)
    hot = f.withColumn("k", F.when(F.col("case_id") % 3 != 0, F.lit("000000")).otherwise(F.col("place_raw")))
    dim = t.select(F.col("code6"), "place_name").union(spark.createDataFrame([("000000", "HOT")], "code6 string, place_name string"))
    b = SS.bounded_join(hot, dim, "k", "code6", "left", max_bytes=1 << 40)
    s = SS.bounded_join(hot, dim, "k", "code6", "left", max_bytes=0)
    cols = ["case_id", "k", "place_name"]
    assert rows(b.select(*cols)) == rows(s.select(*cols))
    assert s.count() == hot.count()
    plan = SS.bounded_join(f, t, "place_raw", "code6", "left", max_bytes=0).groupBy("place_name").count()._jdf.queryExecution().executedPlan().toString()
    assert all(len(x.split(",")) <= 4 for x in re.findall(r"ReadSchema: struct<([^>]*)>", plan))


def test_size_bound_follows_a_growing_table(spark, tmp):
    from surv import session as SS
    spark.range(5).write.parquet(f"{tmp}/t")
    small = SS.leaf_bytes(spark.read.parquet(f"{tmp}/t")) * SS.MEMORY_FACTOR
    assert SS.within_bytes(spark.read.parquet(f"{tmp}/t"), small)
    spark.range(100_000).write.mode("append").parquet(f"{tmp}/t")
    assert not SS.within_bytes(spark.read.parquet(f"{tmp}/t"), small)


def test_partition_count_adds_up_what_the_plan_reads(spark):
    """A join's inputs count once each, not multiplied; the fact at sf0.01 is
    few tasks and files."""
    from surv import session as SS
    from surv.plans import fixtures as FX
    plan = FX.cases_plan(spark, "/root/testdata/sf0.01")
    sizes = sum(os.path.getsize(f"/root/testdata/sf0.01/{t}.parquet") for t in ("orders", "customer", "nation"))
    assert 0 < SS.leaf_bytes(plan) <= sizes
    assert SS.target_partitions(plan) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert SS.target_partitions(plan, sizes // 50) <= 60
    assert SS.target_partitions(spark.createDataFrame([(1,)], "a int").crossJoin(plan)) < 100
    f = FX.cases(spark, "/root/testdata/sf0.01")
    assert f.rdd.getNumPartitions() < 100 and len(f.inputFiles()) < 100


def test_missing_checkpoint_folder_is_an_error_on_a_cluster(spark, monkeypatch):
    from surv import session as SS

    class Ctx:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *a):
            return None

    class Session:
        sparkContext, conf = Ctx(), Conf()

    with pytest.raises(RuntimeError):
        SS.checkpoint_dir(Session())


def test_ranks_equal_windows_with_ties_nulls_and_payload(spark):
    """Three million rows, many ties, NULLs, negative and huge values: the same
    ranks as DuckDB's windows."""
    import duckdb
    from surv.operators import ranking as RK
    n = 3_000_000
    v = ("CASE WHEN id % 97 = 0 THEN NULL WHEN id % 3 = 0 THEN 5.0 WHEN id % 7 = 0 THEN -CAST((id * 31) % 1000 AS DOUBLE) "
         "ELSE CAST((id * 7919) % 200003 AS DOUBLE) / 8 END")
    df = spark.range(0, n, numPartitions=16).selectExpr("id", f"{v} AS v", "repeat('x', 20) AS payload")
    pos = RK.with_position(df, [(F.col("v"), True), (F.col("id"), False)], "p")
    rk = RK.with_rank(df, "v", descending=True, name="r")
    pct = RK.with_pct_rank_average(df, "v", "q")
    got = (pos.agg(F.count(F.lit(1)), F.countDistinct("p"), F.max("p"), F.sum((F.col("p") * (F.col("id") % 1009)).cast("decimal(38,0)"))).first(),
           rk.agg(F.sum((F.col("r").cast("long") * (F.col("id") % 1009)).cast("decimal(38,0)"))).first()[0], pct.agg(F.sum(F.col("q") * (F.col("id") % 1009))).first()[0])
    sql = f"WITH t AS (SELECT id, {v} AS v FROM range({n}) r(id)), w AS (SELECT id, row_number() OVER (ORDER BY v DESC NULLS LAST, id) p, rank() OVER (ORDER BY v DESC NULLS LAST) r, " \
          f"rank() OVER (ORDER BY v ASC NULLS FIRST) lo, count(*) OVER (PARTITION BY v) k FROM t) " \
          f"SELECT sum(p::HUGEINT * (id % 1009)), sum(r::HUGEINT * (id % 1009)), sum((lo + (k - 1) / 2.0) / {n} * (id % 1009)) FROM w"
    want = duckdb.sql(sql).fetchall()[0]
    assert got[0][:3] == (n, n, n) and int(got[0][3]) == want[0] and int(got[1]) == want[1]
    assert abs(got[2] - want[2]) < 1e-6 * want[2]


def test_ranks_are_even_over_close_keys_and_a_hot_tie(spark, tmp, monkeypatch):
    """Three million rows, one tie of a third of them, the other keys within one
    per cent of each other: no bucket of keys and no part of the tie is four times
    the median; stamps and texts with a common beginning alike."""
    import statistics
    from surv.operators import ranking as RK
    monkeypatch.setattr(RK, "SMALL_BYTES", 0)
    n = 3_000_000
    num = "CASE WHEN id % 3 = 0 THEN 1000000.0 ELSE 1000000 + CAST((id * 7919) % 1000003 AS DOUBLE) / 100 END"
    df = spark.range(0, n, numPartitions=16).selectExpr("id", f"{num} AS v", f"concat('http://host/common/beginning/', lpad(CAST(({num}) * 100 AS BIGINT), 12, '0')) AS s")
    for col in ("v", "s"):
        g = df.groupBy(col).agg(F.count(F.lit(1)).alias("_same"))
        sizes = [r[0] for r in RK.key_buckets(g, [col], [True]).groupBy("_bucket").count().select("count").collect()]
        assert len(sizes) >= 32 and max(sizes) < 4 * statistics.median(sizes)
    pos = RK.with_position(df, [(F.col("v"), False)], "p")
    assert pos.agg(F.count(F.lit(1)), F.countDistinct("p"), F.min("p"), F.max("p")).first() == (n, n, 1, n)
    top = pos.filter("v = 1000000.0").agg(F.count(F.lit(1)), F.min("p"), F.max("p")).first()
    assert top == (top[0], 1, top[0]) and top[0] >= n // 3
    # positions follow the values
    w = pos.select("v", F.col("p")).filter("p % 1000 = 1").orderBy("p").collect()
    assert [r.v for r in w] == sorted(r.v for r in w)
    parts = [r[0] for r in df.filter("id % 3 = 0").groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(parts) < 4 * statistics.median(parts)
