"""Connected components and keyed array sums as Spark jobs."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surv.session import materialize


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component
    is its smallest node.  Alternating large-star / small-star rounds: each is
    two aggregations and two joins by key; hubs are aggregated on the map side
    and a round's edges are written, so no node's neighbours are gathered.
    Null ends and loops are ignored; an empty input gives an empty result."""
    e = materialize(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
                    .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def mark(d):
        r = d.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r.n, r.h

    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    last = mark(e)
    for _ in range(max_rounds):
        if not last[0]:
            break
        sym = e.union(e.select("v", "u"))
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        big = sym.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = big.groupBy("u").agg(F.min("v").alias("m"))
        small = (big.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low2.select("u", F.col("m").alias("v"))).distinct())
        e = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
        now = mark(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    root = e.groupBy("u").agg(F.min("v").alias("v"))
    return nodes.join(root, nodes.node == root.u, "left").select("node", F.coalesce("v", "node").alias("component"))


CHUNK = 1 << 16


def array_rows(arrays: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Non-zero chunks of float32 arrays as rows ``(which, chunk, data)``."""
    w, c, d = [], [], []
    for k, a in arrays.items():
        for i in range(0, len(a), CHUNK):
            part = a[i: i + CHUNK]
            if part.any():
                w.append(k), c.append(i // CHUNK), d.append(part.astype("<f4").tobytes())
    yield pa.RecordBatch.from_pydict({"which": pa.array(w, pa.int32()), "chunk": pa.array(c, pa.int32()), "data": pa.array(d, pa.binary())})


ARRAY_SCHEMA = "which int, chunk int, data binary"


def sum_arrays(parts: DataFrame, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """Sum of the arrays that tasks emitted by ``array_rows``, as a tree: a chunk's
    parts are added up in as many tasks as there are shuffle partitions, each of
    them taking the parts of some map tasks, then those sums.  Parts are added one
    by one as they stream in; the result, of fixed size (``sizes``), comes to the
    driver."""
    n = sum(-(-s // CHUNK) for s in sizes.values())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for w, c, d in zip(b["which"].to_pylist(), b["chunk"].to_pylist(), b["data"]):
                x = np.frombuffer(d.as_buffer(), "<f4")
                if (w, c) in acc:
                    acc[w, c] += x
                else:
                    acc[w, c] = x.astype(np.float64)
        for (w, c), v in acc.items():
            yield pa.RecordBatch.from_pydict({"which": pa.array([w], pa.int32()), "chunk": pa.array([c], pa.int32()), "data": pa.array([v.astype("<f4").tobytes()], pa.binary())})

    out = {k: np.zeros(s, np.float32) for k, s in sizes.items()}
    branches = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = (parts.withColumn("_branch", F.pmod(F.spark_partition_id(), F.lit(branches)))
             .repartition(branches, "which", "chunk", "_branch").drop("_branch").mapInArrow(add, ARRAY_SCHEMA))
    # few partitions at the end, after the sums: the iterator is one job for each of them
    for r in first.repartition(min(n, 12), "which", "chunk").mapInArrow(add, ARRAY_SCHEMA).repartition(4).toLocalIterator():
        x = np.frombuffer(r.data, "<f4")
        out[r.which][r.chunk * CHUNK: r.chunk * CHUNK + len(x)] += x
    return out
