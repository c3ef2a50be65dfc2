"""Packing with optimal length buckets.

Every text has a length in tokens; lengths over ``max_tokens`` are cut into
pieces of that size and a rest, so nothing is dropped.  The histogram of piece
lengths (at most ``max_tokens`` rows, whatever the input) comes to the driver,
where dynamic programming chooses ``buckets`` upper bounds that make the total
padding least.  Inside a bucket, pieces are numbered and fill batches of
``budget // bound`` pieces each, so no batch exceeds its token budget.

Pieces are numbered by ``positioned``: a range partitioning by (bucket, id) of any
type, written, and running sums over counts per partition, so a bucket with most of
the rows is many tasks.

Null and empty texts have length 0 and form no piece: they appear once with
null bucket, batch and position.  Ties: equal ids are ordered by text hash,
then by piece; repeated rows are all packed.  Extra columns are ignored.
Without any piece the result has only the unpacked rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surv.llm.merkle import positioned
from surv.session import materialize

MAX_TOKENS = 8192
BUCKETS = 16
BUDGET = 65_536


def token_count(text: str = "text"):
    """Words outside ``[\\x20\\x09-\\x0D]``, and one end token if there are any."""
    t = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    t = F.trim(t)
    n = F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1
    return F.when(F.length(t) == 0, F.lit(0)).otherwise(n + 1).cast("long")


def bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds (ascending, the last the greatest length) of at most
    ``buckets`` buckets with the least padding.  ``lengths`` ascending."""
    m = len(lengths)
    if not m:
        return []
    c = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    k = min(buckets, m)
    # cost of a bucket over items i..j-1 is lengths[j-1] * (c[j] - c[i]), less the constant sum
    best = lengths * c[1:]
    best = np.concatenate([[0.0], best])
    choice = [np.zeros(m + 1, np.int64)]
    for _ in range(1, k):
        new, frm = best.copy(), np.zeros(m + 1, np.int64)
        for j in range(1, m + 1):
            cost = best[:j] + lengths[j - 1] * (c[j] - c[:j])
            i = int(np.argmin(cost))
            new[j], frm[j] = cost[i], i
        best = new
        choice.append(frm)
    out, j = [], m
    for frm in reversed(choice):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(frm[j])
    return out[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS,
         budget: int = BUDGET) -> DataFrame:
    """One row per piece: id, piece number, first token, tokens, bucket bound,
    batch number inside the bucket, position in the batch, padding."""
    if budget < max_tokens:
        raise ValueError("the token budget must hold the longest piece")
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    lens = d.select("id", F.xxhash64("text").alias("h"), token_count().alias("n"))
    last = (F.col("n") - 1).cast("double")
    pieces = materialize(lens.select("id", "h", F.explode_outer(F.when(F.col("n") > 0, F.sequence(F.lit(0), F.floor(last / max_tokens).cast("int")))).alias("piece"), "n")
                         .select("id", "h", "piece", F.when(F.col("n") > 0, F.least(F.lit(max_tokens), F.col("n") - F.col("piece").cast("long") * max_tokens))
                                 .otherwise(0).cast("int").alias("tokens")), "pieces")
    hist = sorted((r.tokens, r.n) for r in pieces.where("tokens > 0").groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect())
    ends = bounds(np.array([x for x, _ in hist], np.int64), np.array([n for _, n in hist], np.int64), buckets)
    real = pieces.where("tokens > 0")
    if not ends:
        real = real.withColumn("bound", F.lit(None).cast("int"))
    else:
        bound = F.lit(ends[-1])
        for e in reversed(ends[:-1]):
            bound = F.when(F.col("tokens") <= e, F.lit(e)).otherwise(bound)
        real = real.withColumn("bound", bound.cast("int"))
    num = (positioned(real.withColumn("g", F.col("bound").cast("string")), ["id", "h", "piece"], "packing")
           .withColumnRenamed("pos", "rank").withColumn("size", F.floor(F.lit(budget) / F.col("bound"))))
    packed = num.select("id", "piece", (F.col("piece").cast("long") * max_tokens).alias("first_token"), "tokens", "bound",
                        F.floor(F.col("rank") / F.col("size")).cast("long").alias("batch"), F.pmod("rank", "size").cast("int").alias("position"),
                        (F.col("bound") - F.col("tokens")).cast("int").alias("padding"))
    null = lambda t: F.lit(None).cast(t)
    rest = pieces.where("tokens = 0").select("id", null("int").alias("piece"), null("long").alias("first_token"), "tokens", null("int").alias("bound"),
                                             null("long").alias("batch"), null("int").alias("position"), null("int").alias("padding"))
    return packed.unionByName(rest).withColumnRenamed("id", id_col)
