"""A huge JSON document read by many tasks equals the multiLine reader."""

import json
import random

import pytest

from surv.sources import json_split as JS
from surv.sources import readers as R


@pytest.fixture()
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "2500", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "10",
             "spark.sql.execution.arrow.maxRecordsPerBatch": "3"}
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def records(n, seed):
    r = random.Random(seed)
    bits = ["}", "{", "]", "[", '"', "\\", '\\"', "parametros", '"parametros":[', "é", "\n", ",", "}" * 9, "x" * 40, "中", ""]
    out = []
    for i in range(n):
        x = {"id": i, "t": "".join(r.choice(bits) for _ in range(r.randint(0, 12)))}
        if r.random() < 0.3:
            x["in"] = {"parametros": [{"a": 1}, {"b}": "]"}], "l": [[{"z": r.choice(bits)}]]}
        if r.random() < 0.05:
            x["t"] += "{}" * 1500                # longer than blocks
        out.append(x)
    return out


def texts(df):
    return sorted(json.dumps(json.loads(x.value), sort_keys=True) for x in df.collect())


def want(rows):
    return sorted(json.dumps(x, sort_keys=True) for x in rows)


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("shape", ["array", "envelope", "object", "array_of_mixed", "empty_array", "empty_envelope"])
def test_records_equal_the_document(spark, tmp, small_blocks, shape, indent):
    rows = records(150, 7)
    other = [{"id": -1, "t": "not a record"}, {"parametros": [{"id": -2}]}]
    doc = {"array": rows, "envelope": {"meta": other, "n}": '"parametros":[{', "parametros": rows, "after": other}, "object": {"a": rows, "b": 1},
           "array_of_mixed": [1, "}{", [rows[0]], None, *rows, [[{"q": 1}]], True], "empty_array": [], "empty_envelope": {"parametros": [], "x": other}}[shape]
    expected = {"object": [doc], "empty_array": [], "empty_envelope": []}.get(shape, rows)
    for ascii_only in (True, False):
        with open(f"{tmp}/d.json", "w", encoding="utf-8") as f:
            f.write("\n " * (not ascii_only) + json.dumps(doc, indent=indent, ensure_ascii=ascii_only) + "\n" * (not ascii_only))
        got = JS.read_json_texts(spark, f"{tmp}/d.json", "parametros")
        assert texts(got) == want(expected)
    assert spark.read.option("lineSep", "}").text(f"{tmp}/d.json").rdd.getNumPartitions() > 1 or not expected


def test_rows_equal_multiline(spark, tmp, small_blocks):
    rows = records(120, 3)
    for shape, doc in (("array", rows), ("envelope", {"m": 1, "parametros": rows})):
        with open(f"{tmp}/{shape}.json", "w") as f:
            json.dump(doc, f)
        whole = R.json_records(spark.read.option("multiLine", True).json(f"{tmp}/{shape}.json"))
        split = R.read_json_records(spark, f"{tmp}/{shape}.json")
        assert split.schema == whole.schema
        assert sorted(map(str, split.collect())) == sorted(map(str, whole.collect()))


def test_several_files_of_different_shapes(spark, tmp, small_blocks):
    rows = records(90, 5)
    for i, doc in enumerate((rows[:40], {"parametros": rows[40:70], "z": {}}, rows[70:])):
        with open(f"{tmp}/{i}.json", "w") as f:
            json.dump(doc, f)
    assert texts(JS.read_json_texts(spark, [f"{tmp}/{i}.json" for i in range(3)], "parametros")) == want(rows)
    joined = JS.MANY_BLOCKS
    try:
        JS.MANY_BLOCKS = 0                      # states joined instead of broadcast
        assert texts(JS.read_json_texts(spark, tmp, "parametros")) == want(rows)
    finally:
        JS.MANY_BLOCKS = joined
