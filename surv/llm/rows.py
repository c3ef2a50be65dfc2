"""Adding columns computed from whole texts, a few MB of rows at a time."""

from __future__ import annotations

from typing import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surv.llm.words import buffers, slices

ARROW = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
SPARK = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType()}


def restore(cls, state: dict):
    """An object of ``cls`` from its attributes (broadcasts carry plain data)."""
    x = cls.__new__(cls)
    x.__dict__.update(state)
    return x


BATCH_ROWS = 1_000


def bounded_batches(spark) -> None:
    """Batches between Spark and Python are bounded by rows, not bytes: with whole
    texts in them the default of 10,000 holds tens of MB several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def add_columns(docs: DataFrame, text_col: str, new: dict[str, str], task: Callable[[], Callable[[list], tuple]]) -> DataFrame:
    """``docs`` plus the columns ``new`` (name: type).  ``task()`` is called once
    in each task and gives a function from a list of texts (None for null) to
    one list per new column.  A column of ``docs`` with a new column's name is
    replaced; the others are kept as they are."""
    bounded_batches(docs.sparkSession)
    cols = [c for c in docs.columns if c not in new]
    kept = docs.select(*[F.col(f"`{c}`") for c in cols])
    at, types = cols.index(text_col), [ARROW[t] for t in new.values()]
    # plain names inside, as a name may hold dots
    fields = [f.dataType for f in kept.schema.fields] + [SPARK[t] for t in new.values()]
    plain = [f"c{i}" for i in range(len(fields))]

    def run(batches):
        f = task()
        for b in batches:
            _, off = buffers(b.column(at))
            for i, j in slices(off):
                part = b.slice(i, j - i)
                out = f(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(list(part.columns) + [pa.array(x, t) for x, t in zip(out, types)], plain)

    schema = T.StructType([T.StructField(n, t) for n, t in zip(plain, fields)])
    return kept.toDF(*plain[: len(cols)]).mapInArrow(run, schema).toDF(*cols, *new)
