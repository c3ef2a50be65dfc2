"""Session construction, checkpoint location and size-checked broadcast."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job relies on.  AQE re-plans joins and coalesces shuffle
# partitions at run time; skew-join splits a hot key's partition.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # AQE coalesces/splits shuffle partitions towards this size
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # coalesce by size, not by core count: small results become few tasks
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "surv",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's base settings.

    ``master`` is only set when given, so on a cluster the launcher decides.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and staged writes: the session's
    ``spark.checkpoint.dir``, or the context's checkpoint directory.

    Where neither is set, a local session (one machine, as in tests) gets a
    scratch folder of its own; a cluster session is an error, since executors
    could not see a folder of the driver's machine."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="surv-ckpt-")
        spark.sparkContext.setCheckpointDir(d)
    return d


def materialize(df: DataFrame, name: str = "cut") -> DataFrame:
    """Cut lineage: write ``df`` as a Parquet table in the shared checkpoint
    folder and continue from the written copy (computed once; survives
    executor loss).  Used before operators that read their input several
    times."""
    import uuid
    path = os.path.join(checkpoint_dir(df.sparkSession).rstrip("/"), "cuts", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


# HotSpot never compiles a method above this size; it interprets it, for every row
COMPILED_METHOD_BYTES = 8000


@contextlib.contextmanager
def split_methods(spark: SparkSession):
    """Inside, a projection too wide for one compiled method runs as many small
    ones, by the setting that Spark names for HotSpot."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, str(COMPILED_METHOD_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


TARGET_PARTITION_BYTES = 256 * 1024 * 1024


def leaf_bytes(df: DataFrame) -> int | None:
    """Bytes that the plan of ``df`` reads: the sizes of its leaf relations
    added up (no job runs; for files, as they are listed now).  None where a
    leaf has no known size.

    Catalyst's estimate of a whole plan is no use here: without column
    statistics that of a join is the product of its inputs."""
    unknown = df.sparkSession._jsparkSession.sessionState().conf().defaultSizeInBytes()
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return None if any(x >= unknown for x in sizes) else sum(sizes)


def target_partitions(df: DataFrame, bytes_per_partition: int = TARGET_PARTITION_BYTES) -> int:
    """Partition count for an explicit repartition: about
    ``bytes_per_partition`` of what the plan reads each, never fewer than
    ``spark.sql.shuffle.partitions``."""
    floor_n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    est = leaf_bytes(df)
    return floor_n if est is None else max(floor_n, -(-est // bytes_per_partition))


def range_partitioned(df: DataFrame, *order, bytes_per_partition: int = TARGET_PARTITION_BYTES) -> DataFrame:
    """``df`` range-partitioned by ``order`` and sorted inside.  The session's
    number of shuffle partitions holds, without a fixed count, so that AQE
    merges small ones; only where the plan reads more than they should hold is
    a larger count asked for."""
    n, floor_n = target_partitions(df, bytes_per_partition), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    parts = df.repartitionByRange(n, *order) if n > floor_n else df.repartitionByRange(*order)
    return parts.sortWithinPartitions(*order)


# bound on a broadcast side in memory, and how much larger rows are there than
# in compressed column files
BROADCAST_BYTES = 256 * 1024 * 1024
MEMORY_FACTOR = 4


def within_bytes(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when what the source ``df`` reads takes at most ``max_bytes`` in
    memory.  Asked anew at every call: a table that has grown since is seen as
    it is; a source of unknown size is not within any bound."""
    est = leaf_bytes(df)
    return est is not None and est * MEMORY_FACTOR <= max_bytes


def broadcast_if_bounded(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast-hint ``df`` only when its size is bounded.

    Past the bound the frame is returned unhinted: the join shuffles on its
    key, and AQE splits skewed partitions."""
    return F.broadcast(df) if within_bytes(df, max_bytes) else df


def bounded_join(fact: DataFrame, dim: DataFrame, fact_key, dim_key: str, how: str = "left",
                 max_bytes: int = BROADCAST_BYTES, size_of: DataFrame | None = None) -> DataFrame:
    """Join a (possibly huge, possibly skewed) fact to a dimension with one row
    per key.

    * dimension within ``max_bytes`` (checked): broadcast hash join, no shuffle;
    * otherwise: a join by key.  A key with a third of all rows makes one large
      partition of the fact, which AQE's skew-join rule splits (the
      dimension's single row is read by every part).

    ``size_of`` is the source frame whose size bounds ``dim`` (a projection,
    filter or aggregate of it)."""
    fk = F.col(fact_key) if isinstance(fact_key, str) else fact_key
    small = within_bytes(size_of if size_of is not None else dim, max_bytes)
    return fact.join(F.broadcast(dim) if small else dim, fk == F.col(dim_key), how)
