"""Driver-contract guards that need no Spark job."""

import importlib.util
import os

import __spark_entry__ as E

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_headline_queries_are_registered():
    spec = importlib.util.spec_from_file_location("bench", os.path.join(ROOT, "bench.py"))
    bench = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(bench)
    missing = [n for n in bench.HEADLINE if n not in E.queries()]
    assert not missing, missing
    assert len(bench.PANEL1) == 8


def test_oracle_keys_are_queries_and_sql_is_text():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert all(isinstance(v, str) and "SELECT" in v.upper() for v in o.values())
