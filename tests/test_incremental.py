"""Incremental loading, marks, run log, streaming (2J, A13, D10, D13)."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from surv.operators import quality as Q
from surv.sources import published as PB
from surv.sources.published import read_table
from surv.streaming import incremental as INC
from surv.streaming import stream as STR
from tests.conftest import SF_SMALL


def rows(spark, data):
    return spark.createDataFrame(data, "id int, d date, year int, v string")


def D(s):
    return dt.date.fromisoformat(s) if s else None


def test_window_replace_idempotent_and_null_dates_kept(spark, tmp):
    t = f"{tmp}/fact"
    base = rows(spark, [(1, D("2024-01-01"), 2024, "a"), (2, D("2024-01-10"), 2024, "b"),
                        (3, None, 2024, "null-date"), (4, D("2023-12-30"), 2023, "old")])
    INC.replace_date_window(spark, base, t, "d", "2024-01-01")
    new = rows(spark, [(5, D("2024-01-09"), 2024, "late"), (6, D("2024-01-12"), 2024, "new")])
    INC.replace_date_window(spark, new, t, "d", "2024-01-08")
    first = sorted((r.id, r.v) for r in read_table(spark, t).collect())
    assert first == [(1, "a"), (3, "null-date"), (4, "old"), (5, "late"), (6, "new")]
    INC.replace_date_window(spark, new, t, "d", "2024-01-08")   # re-run: same table
    assert sorted((r.id, r.v) for r in read_table(spark, t).collect()) == first


def test_window_replace_closed_window_and_emptied_partition(spark, tmp):
    t = f"{tmp}/fact2"
    base = rows(spark, [(1, D("2022-05-01"), 2022, "x"), (2, D("2023-05-01"), 2023, "y")])
    INC.replace_date_window(spark, base, t, "d", "2000-01-01")
    INC.replace_date_window(spark, rows(spark, []), t, "d", "2022-01-01", "2022-12-31")
    got = read_table(spark, t).collect()
    assert [r.id for r in got] == [2]
    assert set(PB.TableGroup(spark, t).state()["tables"]["rows"]["parts"]) == {"2023"}


def test_window_replace_keeps_null_partitions(spark, tmp):
    t = f"{tmp}/fact_null"
    base = rows(spark, [(1, None, None, "keep"), (3, D("2024-01-01"), 2024, "a"), (4, D("2024-02-01"), 2024, "b")])
    INC.replace_date_window(spark, base, t, "d", "2024-01-01")
    INC.replace_date_window(spark, rows(spark, [(2, None, None, "new"), (5, D("2024-02-02"), 2024, "c")]), t, "d", "2024-02-01")
    assert sorted(r.id for r in read_table(spark, t).collect()) == [1, 2, 3, 5]


class Lost(Exception):
    """A driver lost between two steps."""


def stop_at(monkeypatch, k):
    """Lose the driver at the k-th step from now; the list says which came."""
    seen = []

    def step(name):
        seen.append(name)
        if len(seen) == k:
            raise Lost(name)

    monkeypatch.setattr(PB, "step", step)
    return seen


WRITES = {
    "window": lambda s, t: INC.replace_date_window(s, rows(s, [(3, D("2023-06-01"), 2023, "z")]), t, "d", "2022-03-01"),
    "days": lambda s, t: INC.replace_days(s, rows(s, [(4, D("2022-05-01"), 2022, "y")]), t, "d"),
    "reload": lambda s, t: INC.reload_years(s, rows(s, [(5, D("2023-05-01"), 2023, "r")]), t),
    "history": lambda s, t: INC.historical_load(s, [rows(s, [(6, D("2020-05-01"), 2020, "h")]), rows(s, [(7, D("2021-05-01"), 2021, "i")])], t),
    "truncate": lambda s, t: PB.TableGroup(s, t).publish({PB.ROWS: PB.Change(rows(s, [(8, D("2020-01-01"), 2020, "t")]), "year")}),
}


@pytest.mark.parametrize("kind", list(WRITES))
def test_a_reader_sees_the_old_or_the_new_state_wherever_a_writer_stops(spark, tmp, monkeypatch, kind):
    first = rows(spark, [(1, D("2022-05-01"), 2022, "x"), (2, D("2023-05-01"), 2023, "y")])
    ids = lambda t: sorted(r.id for r in read_table(spark, t).collect())
    INC.replace_date_window(spark, first, f"{tmp}/whole", "d", "2000-01-01")
    steps = stop_at(monkeypatch, 0)
    WRITES[kind](spark, f"{tmp}/whole")
    want = ids(f"{tmp}/whole")
    assert want != [1, 2] and len(steps) >= 3
    for k in range(1, len(steps) + 1):
        t = f"{tmp}/cut{k}"
        stop_at(monkeypatch, 0)
        INC.replace_date_window(spark, first, t, "d", "2000-01-01")
        stop_at(monkeypatch, k)
        with pytest.raises(Lost):
            WRITES[kind](spark, t)
        assert ids(t) == (want if steps[k - 1] == "pointer renamed" else [1, 2])
        stop_at(monkeypatch, 0)
        WRITES[kind](spark, t)               # the run is repeated
        assert ids(t) == want
        PB.TableGroup(spark, t).clean(keep=1)
        assert ids(t) == want
        files = sum(f.endswith(".parquet") for _, _, names in os.walk(t) for f in names)
        state = PB.TableGroup(spark, t).state()
        assert files and sum(len(g) for g in state["tables"]["rows"]["parts"].values()) == sum("gen=" in os.path.basename(d) for d, _, _ in os.walk(t))


def test_tables_of_a_group_change_together(spark, tmp, monkeypatch):
    g = PB.TableGroup(spark, f"{tmp}/group")
    a, b = rows(spark, [(1, None, None, "a")]), spark.createDataFrame([(1, "x")], "k int, w string")
    g.publish({"a": PB.Change(a, "year"), "b": PB.Change(b, facts={"n": 1})})
    see = lambda: (g.read("a").count(), [r.w for r in g.read("b").collect()], g.facts("b"))
    for k in (1, 2, 3):
        stop_at(monkeypatch, k)
        with pytest.raises(Lost):
            g.publish({"a": PB.Change(a, "year", append=True), "b": PB.Change(b.withColumn("w", F.lit("new")), facts={"n": 2})})
        assert see() == (1, ["x"], {"n": 1})
    stop_at(monkeypatch, 0)
    assert g.publish({"a": PB.Change(a, "year", append=True), "b": PB.Change(b.withColumn("w", F.lit("new")), facts={"n": 2})}) == 2
    assert see() == (2, ["new"], {"n": 2}) and g.read("a", version=1).count() == 1
    # a writer that read version 1 is told that there is a second one
    with pytest.raises(PB.ConcurrentPublish):
        g.commit({}, g.state(1))
    g.publish({"a": PB.Change(a.limit(0), "year")})
    assert g.read("a").columns == a.columns and g.read("a").count() == 0
    with pytest.raises(ValueError):
        g.publish({"a": PB.Change(rows(spark, [(1, None, 2020, "")]), "year", [2021])})


def test_late_file_keeps_newer_rows(spark, tmp):
    land, t = f"{tmp}/late_land", f"{tmp}/late_tbl"
    schema = "id int, d date, year int, v string"
    for k, data in enumerate(([(1, D("2024-01-01"), 2024, "a"), (2, D("2024-03-01"), 2024, "b")], [(3, D("2024-02-01"), 2024, "late")],
                              [(4, D("2024-01-01"), 2024, "again"), (5, None, None, "no date"), (6, D("2020-01-01"), 2020, "too old")])):
        rows(spark, data).write.parquet(f"{land}/{k}")
        STR.stream_window_replace(spark, f"{land}/*", schema, t, "d", name=f"late-{os.getpid()}-{id(tmp)}", since="2023-12-30")
    assert sorted(r.id for r in read_table(spark, t).collect()) == [2, 3, 4, 5]


def test_year_batches():
    assert INC.year_batches(2015, 2021) == [(2015, 2017), (2018, 2020), (2021, 2021)]
    assert INC.year_batches(2020, 2019) == [] and INC.year_batches(2020, 2021, 1) == [(2020, 2020), (2021, 2021)]


def test_reload_years_validates_first(spark, tmp):
    t = f"{tmp}/fact3"
    INC.reload_years(spark, rows(spark, [(1, D("2022-01-01"), 2022, "a"), (2, D("2023-01-01"), 2023, "b")]), t)
    INC.reload_years(spark, rows(spark, [(3, D("2023-02-01"), 2023, "c")]), t)
    assert sorted(r.id for r in read_table(spark, t).collect()) == [1, 3]
    with pytest.raises(Q.ValidationError):
        INC.reload_years(spark, rows(spark, []), t)
    assert sorted(r.id for r in read_table(spark, t).collect()) == [1, 3]


def test_historical_load_truncates_on_first_batch(spark, tmp):
    t = f"{tmp}/fact4"
    INC.historical_load(spark, [rows(spark, [(9, D("2020-01-01"), 2020, "z")])], t)
    n = INC.historical_load(spark, [rows(spark, []), rows(spark, [(1, D("2021-01-01"), 2021, "a")]),
                                    rows(spark, [(2, D("2022-01-01"), 2022, "b")])], t)
    assert n == 2 and sorted(r.id for r in read_table(spark, t).collect()) == [1, 2]


def test_marks_and_run_log(spark, tmp):
    state = spark.createDataFrame([("p", "api", D("2024-01-10"), None)], INC.STATE_SCHEMA)
    assert INC.mark_value(state, "p", "api") == D("2024-01-10")
    assert INC.overlap_start(D("2024-01-10")) == D("2024-01-08")
    assert INC.overlap_start(None, fallback_year=2020) == D("2020-01-01")
    upd = spark.createDataFrame([("p", "api", "failed", D("2024-02-01"), dt.datetime(2024, 2, 1)),
                                 ("q", "csv", "success", D("2024-02-02"), dt.datetime(2024, 2, 2))],
                                "pipeline string, source string, status string, last_success_date date, updated_at timestamp")
    got = {(r.pipeline, r.source): r.last_success_date for r in INC.upsert_mark(state, upd).collect()}
    assert got == {("p", "api"): D("2024-01-10"), ("q", "csv"): D("2024-02-02")}
    due = INC.due_for_check(INC.upsert_mark(state, upd), 7, F.lit(dt.datetime(2024, 2, 8, 12)).cast("timestamp"))
    assert sorted(r.pipeline for r in due.collect()) == ["p"]
    log = f"{tmp}/runlog"
    INC.append_run_log(INC.run_log_row(spark, "p", "api", INC.RUN_RUNNING, run_id="r1"), log)
    INC.append_run_log(INC.run_log_row(spark, "p", "api", INC.RUN_SUCCESS, run_id="r1", rows=10), log)
    st = INC.run_status(spark.read.parquet(log)).first()
    assert st.status == "success" and st.rows_loaded == 10


def test_snapshot_diff_and_upsert(spark):
    old = spark.createDataFrame([(1, 10.0, "a"), (2, 20.0, "b"), (3, 30.0, "c")], "k int, m double, t string")
    new = spark.createDataFrame([(2, 21.0, None), (3, 30.0, "c2"), (4, 40.0, "d")], "k int, m double, t string")
    diff = sorted((r.k, r.change) for r in INC.snapshot_diff(old, new, ["k"], "m").collect())
    assert diff == [(1, "removed"), (2, "changed"), (4, "new")]
    up = {r.k: (r.m, r.t) for r in INC.upsert_keep_old(old, new, ["k"]).collect()}
    assert up == {1: (10.0, "a"), 2: (21.0, "b"), 3: (30.0, "c2"), 4: (40.0, "d")}


def test_stream_sync_new_files_only(spark, tmp):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    days = ev.select(F.to_date("ts").alias("day")).distinct().orderBy("day").limit(3).collect()
    land, out = f"{tmp}/landing", f"{tmp}/events_table"
    schema = ev.schema
    ev.filter(F.to_date("ts") == days[0].day).write.parquet(f"{land}/d0")
    STR.sync_new_files(spark, f"{land}/*", schema, out, name=f"sync-{os.getpid()}-{id(tmp)}")
    n0 = spark.read.parquet(out).count()
    ev.filter(F.to_date("ts") == days[1].day).write.parquet(f"{land}/d1")
    STR.sync_new_files(spark, f"{land}/*", schema, out, name=f"sync-{os.getpid()}-{id(tmp)}")
    n1 = spark.read.parquet(out).count()
    assert n0 == ev.filter(F.to_date("ts") == days[0].day).count()
    assert n1 == n0 + ev.filter(F.to_date("ts") == days[1].day).count()


def test_stream_window_replace(spark, tmp):
    ev = (spark.read.parquet(f"{SF_SMALL}/events.parquet")
          .select("event_id", F.to_date("ts").alias("d"), F.year("ts").alias("year"), "event_type"))
    land, t = f"{tmp}/land2", f"{tmp}/tbl2"
    ev.filter("d < '2024-01-03'").write.parquet(f"{land}/a")
    STR.stream_window_replace(spark, f"{land}/*", ev.schema, t, "d", name=f"wr-{os.getpid()}-{id(tmp)}")
    ev.filter("d >= '2024-01-02'").write.parquet(f"{land}/b")   # overlaps one day
    STR.stream_window_replace(spark, f"{land}/*", ev.schema, t, "d", name=f"wr-{os.getpid()}-{id(tmp)}")
    got = read_table(spark, t)
    assert got.count() == ev.count()
    assert got.groupBy("event_id").count().filter("count > 1").count() == 0


def test_daily_event_counts_batch_equals_stream(spark, tmp):
    batch = STR.daily_event_counts(spark.read.parquet(f"{SF_SMALL}/events.parquet"))
    streamed = STR.run_daily_event_counts(spark, SF_SMALL, f"{tmp}/daily", name=f"daily-{id(tmp)}",
                                          file_glob="events.parquet")
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, streamed.collect()))


def test_validators(spark):
    df = spark.read.parquet(f"{SF_SMALL}/region.parquet")
    Q.require_not_empty(df)
    with pytest.raises(Q.ValidationError):
        Q.require_not_empty(df.limit(0))
    with pytest.raises(Q.ValidationError):
        Q.require_columns(df, ["r_name", "nope"])
    with pytest.raises(Q.ValidationError) as e:
        Q.require_types(df, {"r_name": "int", "r_regionkey": "string", "x": "int"})
    assert "r_name" in str(e.value) and "x: missing" in str(e.value)
    Q.assert_unique(df, ["r_regionkey"])
    with pytest.raises(Q.ValidationError):
        Q.assert_unique(df.union(df), ["r_regionkey"])


def test_window_replace_widens_schema(spark, tmp):
    t = f"{tmp}/wide"
    INC.replace_date_window(spark, rows(spark, [(1, D("2023-01-01"), 2023, "a"), (2, D("2024-01-05"), 2024, "b")]),
                            t, "d", "2000-01-01")
    new = spark.createDataFrame([(3, D("2024-01-06"), 2024, "c", "extra")],
                                "id int, d date, year int, v string, new_field string")
    INC.replace_date_window(spark, new, t, "d", "2024-01-01")
    got = {r.id: r.new_field for r in read_table(spark, t).collect()}
    assert got == {1: None, 3: "extra"}


def versions(seed, n=300):
    """(id, day, month, version, v): several versions of each key, out of order."""
    import random
    r = random.Random(seed)
    out = []
    for i in range(n):
        d = dt.date(2024, 1, 1) + dt.timedelta(days=r.randrange(60))
        out += [(i, d, d.strftime("%Y-%m"), k, f"v{i}.{k}") for k in range(r.randint(1, 4))]
    r.shuffle(out)
    return out


UPSERT = "id int, day date, month string, version int, v string"


def test_out_of_order_versions_over_restarts_equal_one_batch(spark, tmp, monkeypatch):
    data = versions(3)
    newest = {}
    for x in data:
        newest[x[0]] = max(newest.get(x[0], x), x, key=lambda y: y[3])
    want = sorted(newest.values())
    got = {}
    for runs in (1, 5):
        land, t, name = f"{tmp}/land{runs}", f"{tmp}/up{runs}", f"up-{os.getpid()}-{id(tmp)}-{runs}"
        for k in range(runs):
            spark.createDataFrame(data[k::runs], UPSERT).coalesce(1).write.parquet(f"{land}/{k}")
            args = (spark, f"{land}/*", UPSERT, t, ["id"], "day", "version", "month", 400)
            if k == 2:                       # the driver is lost after the rows, before the pointer; the run starts again
                stop_at(monkeypatch, 1)
                with pytest.raises(Exception):
                    STR.stream_upsert(*args, name=name)
                stop_at(monkeypatch, 0)
            if k == 3:                       # lost after the pointer: the epoch is not applied twice
                steps = stop_at(monkeypatch, 3)
                with pytest.raises(Exception):
                    STR.stream_upsert(*args, name=name)
                stop_at(monkeypatch, 0)
                assert steps[-1] in ("pointer renamed", "pointer written")
            g = STR.stream_upsert(*args, name=name)
        got[runs] = sorted(map(tuple, g.read("rows").select("id", "day", "month", "version", "v").collect()))
        assert g.read("too_late").count() == 0
    assert got[1] == got[5] == want


def test_records_of_closed_days_are_kept_apart(spark, tmp):
    land, t, name = f"{tmp}/lc", f"{tmp}/lct", f"lc-{os.getpid()}-{id(tmp)}"
    for k, rows_ in enumerate(([(1, D("2024-02-10"), "2024-02", 1, "a")], [(2, D("2024-02-08"), "2024-02", 1, "in time"), (3, D("2024-02-07"), "2024-02", 1, "late"), (4, None, None, 1, "no day")],
                               [(1, D("2024-02-10"), "2024-02", 0, "older version"), (3, D("2024-02-07"), "2024-02", 9, "late too")])):
        spark.createDataFrame(rows_, UPSERT).write.parquet(f"{land}/{k}")
        g = STR.stream_upsert(spark, f"{land}/*", UPSERT, t, ["id"], "day", "version", "month", 2, name=name)
    assert sorted((r.id, r.v) for r in g.read("rows").collect()) == [(1, "a"), (2, "in time"), (4, "no day")]
    assert sorted((r.id, r.v) for r in g.read("too_late").collect()) == [(3, "late"), (3, "late too")]


def test_state_of_closed_days_is_bounded(spark, tmp):
    src = f"{tmp}/ev"
    days, kinds = 40, 3
    for k in range(days):                      # one file a day, each also with a late event of the day before
        d = dt.datetime(2024, 1, 1) + dt.timedelta(days=k)
        data = [(d + dt.timedelta(hours=h), f"k{h % kinds}", 1.5) for h in range(0, 24, 2)] + [(d - dt.timedelta(hours=1), "k0", 2.0)]
        spark.createDataFrame(data, "ts timestamp_ntz, event_type string, value double").coalesce(1).write.mode("append").parquet(src)
        os.utime(max((os.path.join(src, f) for f in os.listdir(src) if f.endswith(".parquet")), key=os.path.getmtime), (1_700_000_000 + k, 1_700_000_000 + k))
    out, held = STR.run_closed_days(spark, src, f"{tmp}/closed", name=f"cd-{os.getpid()}-{id(tmp)}", files_per_epoch=1)
    assert len(held) >= days and max(held) <= 4 * kinds                  # two or three open days, whatever came before
    batch = STR.daily_event_counts(spark.read.parquet(src))
    last = spark.read.parquet(src).agg(F.max("ts")).first()[0] - dt.timedelta(days=1)
    want = [tuple(r) for r in batch.collect() if r.day + dt.timedelta(days=1) <= last]
    assert sorted(map(tuple, out.select("day", "event_type", "events", "value_sum").collect())) == sorted(want) and len(want) >= (days - 2) * kinds
    again, _ = STR.run_closed_days(spark, src, f"{tmp}/closed", name=f"cd-{os.getpid()}-{id(tmp)}", files_per_epoch=1)
    assert again.count() == len(want)


def test_snapshot_digests(spark, tmp):
    """Digests do not depend on order or parts; an unchanged snapshot is not read."""
    old = spark.createDataFrame([(i, f"s{i % 7}" if i % 5 else None) for i in range(3000)] + [(None, "x")], "k int, s string")
    new = old.filter("k % 50 <> 3 OR k IS NULL").withColumn("s", F.when(F.col("k") % 40 == 1, F.lit("zz")).when(F.col("k") == 10, F.lit("now")).otherwise(F.col("s"))).unionByName(
        spark.createDataFrame([(5000, None)], "k int, s string"))
    dig = lambda d: INC.snapshot_digest(d, ["k"], "s", 64)
    assert sorted(map(tuple, dig(old).collect())) == sorted(map(tuple, dig(old.repartition(5, "s")).collect()))
    plain = sorted(map(tuple, INC.snapshot_diff(old, new, ["k"], "s").collect()), key=repr)
    few = sorted(map(tuple, INC.snapshot_diff(old, new, ["k"], "s", dig(old), dig(new), 64).collect()), key=repr)
    kinds = {k: sum(x[1] == k for x in plain) for k in ("new", "removed", "changed")}
    assert [x for x in plain if x[0] is not None] == [x for x in few if x[0] is not None] and kinds["removed"] > 50 and kinds["changed"] > 50
    old.write.parquet(f"{tmp}/snap")
    kept = spark.read.parquet(f"{tmp}/snap")
    d = spark.createDataFrame(dig(kept).collect(), dig(kept).schema)
    for f in os.listdir(f"{tmp}/snap"):
        if f.endswith(".parquet"):
            open(f"{tmp}/snap/{f}", "wb").write(b"unreadable")
    assert INC.snapshot_diff(kept, kept, ["k"], "s", d, d, 64).count() == 0
