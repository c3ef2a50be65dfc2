"""The pipeline's stages on the small tables, each against its own input."""

import pytest

import __spark_entry__ as E
import corpus_pipeline as P
from surv.llm import decontam, ngram_join
from surv.session import materialize
from tests.conftest import SF_SMALL


def test_registered():
    names = set(E.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names} >= {f"op{k}" for k in range(1, 11)}
    assert [n for n, _ in P.STAGES] == ["quality", "language", "near_duplicates", "decontaminate", "pack"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    cols, seen = docs.columns, {}
    for name, stage in P.STAGES[:-1]:
        before = docs
        docs = materialize(stage(spark, docs, SF_SMALL), name)
        assert docs.columns == cols
        seen[name] = (before, docs)
        gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in docs.collect()}
        assert before.exceptAll(docs).count() == len(gone) and docs.exceptAll(before).count() == 0
    before, after = seen["quality"]
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet").join(before, "doc_id")
    kept = after.select("doc_id")
    good, bad = labels.where("quality = 1"), labels.where("quality = 0")
    assert good.join(kept, "doc_id").count() >= 0.97 * good.count() and bad.join(kept, "doc_id").count() <= 0.1 * bad.count()
    before, after = seen["language"]
    assert after.count() >= 0.97 * before.count()
    before, after = seen["near_duplicates"]
    assert after.count() == ngram_join.similarity_classes(before).select("component_id").distinct().count()
    before, after = seen["decontaminate"]
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    assert before.count() - after.count() == decontam.find(before, bench).select("doc_id").distinct().count()
    packed = P.STAGES[-1][1](spark, docs, SF_SMALL)
    assert packed.select("doc_id").distinct().count() == docs.count()


@pytest.mark.parametrize("name", ["documents"])
def test_run(spark, name):
    out = P.run(spark, SF_SMALL)
    assert out.count() > 0 and "batch" in out.columns
