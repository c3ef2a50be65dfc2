"""Benchmark decontamination by SimHash windows, with DataFrame operations only.

Words are runs of letters and digits after lower-casing; shingles are 5 words
(a shorter sequence is one shingle).  A shingle weighs 1 + log2(items / items
that have it), rounded down, at most 8; a shingle of no item weighs most.

1. Shingle hashes of all texts are joined with those of the benchmark; places
   that meet none end there.  To reach weighted similarity 0.8 with an item, a
   window must share 80 % of the item's weight, so it holds at least ``need``
   places that meet the item: that share over the item's heaviest shingle.
   For every item length and ``need``, all windows of that many words with so
   many met places inside are taken, wherever they start: their first met place
   says between which starts they lie.  A text shorter than the item is one
   window, as a whole.
2. Each window and each item of that length gets a 64-bit weighted SimHash.
3. Fingerprints are cut into ``RADIUS + 1`` blocks; two within Hamming distance
   ``RADIUS`` agree in one block at least, so a join on (length, block, bits)
   finds all pairs within the radius, and the distance is then checked.
4. Pairs are verified by the exact weighted Jaccard similarity of their shingle
   sets, written with step 2's windows, so texts are read twice in all.  Of each
   (text, item) the best window is returned.

The benchmark's grams are broadcast up to ``BROADCAST_GRAMS`` rows, beyond that
they are joined by key.  Null or empty texts and items match nothing; an item
of fewer than 5 words matches only a text of the same words.  Equal items each
match; repeated texts (same id and text) give one row per item.  Extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surv.llm.joins import ROW, maybe_in, with_ids, with_row_keys
from surv.llm.sqlwords import kgrams, words
from surv.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 15
HEAVIEST = 8
BROADCAST_GRAMS = 200_000
LANE_WORDS = 4_000    # up to this length of an item, times HEAVIEST under 2**15, a long holds four 16-bit counters; beyond it one


def n_shingles(length: Column) -> Column:
    return F.greatest(length - (SHINGLE - 1), F.lit(1))


def _votes(h: Column, weight: Column, lane: int, each: int) -> Column:
    """Weight in each of a lane's ``each`` counters whose bit of ``h`` is set."""
    wide = 64 // each
    spread = F.array(*[F.lit(sum(((v >> b) & 1) << (wide * b) for b in range(each))) for v in range(1 << each)])
    return F.element_at(spread, (F.shiftrightunsigned(h, each * lane).bitwiseAND(F.lit((1 << each) - 1)) + 1).cast("int")) * weight


def simhash(rows: DataFrame, keys: list[str], each: int = 4) -> DataFrame:
    """Fingerprint ``fp`` and total weight ``total`` of rows ``(keys, h, weight)``;
    ``each`` counters share a long."""
    wide = 64 // each
    full = F.lit((1 << wide) - 1 if each > 1 else -1)
    s = rows.groupBy(*keys).agg(F.sum("weight").alias("total"), *[F.sum(_votes(F.col("h"), F.col("weight"), i, each)).alias(f"v{i}") for i in range(64 // each)])
    fp = F.lit(0).cast("long")
    for i in range(64 // each):
        for b in range(each):
            count = F.shiftrightunsigned(F.col(f"v{i}"), wide * b).bitwiseAND(full)
            fp = fp.bitwiseOR(F.shiftleft((2 * count > F.col("total")).cast("long"), each * i + b))
    return s.select(*keys, "total", fp.alias("fp"))


def _blocks(fp: Column, radius: int) -> Column:
    n = radius + 1
    cut = [64 * i // n for i in range(n + 1)]
    return F.array(*[F.shiftrightunsigned(fp, cut[i]).bitwiseAND(F.lit((1 << (cut[i + 1] - cut[i])) - 1)) for i in range(n)])


def item_grams(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per (item, distinct shingle): item, words, hash, weight."""
    it = (benchmark.select(F.col(f"`{item_col}`").alias("item"), words(F.col(f"`{text_col}`").cast("string")).alias("w")).where(F.size("w") > 0)
          .withColumn("text_hash", F.xxhash64("w")))
    it = it.select("item", "text_hash", F.size("w").alias("len"), F.explode(F.array_distinct(kgrams(F.col("w"), SHINGLE, whole=True))).alias("h"))
    total = benchmark.count()
    df = it.select("item", "text_hash", "h").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    weight = F.least(F.lit(HEAVIEST), 1 + F.floor(F.log2(F.lit(float(max(total, 1))) / F.col("df")))).cast("long")
    return it.join(df, "h").select("item", "text_hash", "len", "h", F.greatest(weight, F.lit(1)).alias("weight")).distinct()


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """Rows ``(id, item, similarity, start, words, hamming)``, the best window
    of each text and item that reaches ``similarity``."""
    whole = Window.partitionBy("item", "text_hash")
    fewest = F.ceil(F.lit(similarity) * F.sum("weight").over(whole) / F.max("weight").over(whole) - 1e-9)
    items = materialize(item_grams(benchmark, item_col, item_text).withColumn("need", F.greatest(fewest, F.lit(1)).cast("int")), "items")
    size = items.agg(F.count(F.lit(1)).alias("n"), F.max("len").alias("longest")).first()
    each = 4 if (size.longest or 0) <= LANE_WORDS else 1
    small = F.broadcast if size.n <= BROADCAST_GRAMS else (lambda x: x)
    grams = items.groupBy("h").agg(F.max("weight").alias("weight"))
    # inside a struct a null id equals itself, so such rows are searched like all others
    d = docs.select(F.struct(F.col(f"`{id_col}`").alias("v")).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text IS NOT NULL")

    g = d.select("id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("w"))
    g = g.select("id", "th", F.size("w").alias("nw"), F.posexplode(kgrams(F.col("w"), SHINGLE, whole=True)).alias("p", "h"))
    if size.n > BROADCAST_GRAMS:          # then the join is a shuffle: few shingles of other texts should reach it
        g = maybe_in(g, F.col("h"), items, F.col("h"))
    met = g.join(small(items.select("h", "len", "need").distinct()), "h").where("len >= " + str(SHINGLE) + " OR nw = len").select("id", "th", "nw", "len", "need", "p")
    # met places of one text, item length and need; bounded by the text's words
    at = met.groupBy("id", "th", "nw", "len", "need").agg(F.sort_array(F.collect_set("p")).alias("ps"))

    def windows(i: Column) -> Column:
        """Windows whose first met place is the i-th, if enough met places lie in them."""
        before = F.coalesce(F.get(F.col("ps"), i - 1), F.lit(-1))
        end = F.get(F.col("ps"), i + F.col("need") - 1)
        lo = F.greatest(before + 1, end - n_shingles(F.col("len")) + 1)
        hi = F.least(F.get(F.col("ps"), i), F.greatest(F.col("nw") - F.col("len"), F.lit(0)))
        some = F.transform(F.sequence(lo, hi), lambda p: F.struct(p.alias("p"), F.col("len").alias("len"), F.least("len", "nw").alias("n")))
        return F.when(end.isNotNull() & (lo <= hi), some).otherwise(F.expr("cast(array() as array<struct<p:int,len:int,n:int>>)"))

    starts = F.flatten(F.transform(F.sequence(F.lit(0), F.size("ps") - F.col("need")), windows))
    wins = at.where(F.size("ps") >= F.col("need")).select("id", "th", starts.alias("wins")).where(F.size("wins") > 0)
    wins = materialize(wins.groupBy("id", "th").agg(F.array_distinct(F.flatten(F.collect_list("wins"))).alias("wins")), "windows")

    # shingles of the windows, made again from the few texts that have any
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    again = with_ids(d, wins).where(F.xxhash64("text") == F.col("th")).repartition(parts, "id", "th")
    # the words are a column of their own: inside a lambda an expression would be evaluated for every element
    ws = (again.select("id", "th", "wins", words(F.col("text")).alias("w")).dropDuplicates(["id", "th"])
          .select("id", "th", "wins", kgrams(F.col("w"), SHINGLE, whole=True).alias("hs"))
          .select("id", "th", "hs", F.explode("wins").alias("win"))
          .select("id", "th", "win.p", "win.len", "win.n", F.array_distinct(F.slice("hs", F.col("win.p") + 1, n_shingles(F.col("win.len")))).alias("hs")))
    # written once: fingerprints and the exact check below both read them
    ws = materialize(ws, "shingles")
    rows = ws.select("id", "th", "p", "len", "n", F.explode("hs").alias("h"))
    heavy = max(1, min(HEAVIEST, 1 + (max(benchmark.count(), 1)).bit_length() - 1))
    weighed = rows.join(small(grams), "h", "left").select("id", "th", "p", "len", "n", "h", F.coalesce("weight", F.lit(heavy).cast("long")).alias("weight"))
    prints = simhash(weighed, ["id", "th", "p", "len", "n"], each)
    iprints = simhash(items, ["item", "text_hash", "len"], each)

    wb = prints.select("id", "th", "p", "len", "n", "total", "fp", F.posexplode(_blocks(F.col("fp"), radius)).alias("blk", "bits"))
    ib = iprints.select("item", "text_hash", "len", F.col("total").alias("item_total"), F.col("fp").alias("item_fp"), F.posexplode(_blocks(F.col("fp"), radius)).alias("blk", "bits"))
    dist = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    pairs = (wb.join(small(ib), ["len", "blk", "bits"]).withColumn("hamming", dist).where(F.col("hamming") <= radius)
             .select("id", "th", "p", "len", "n", "item", "text_hash", "total", "item_total", "hamming").distinct())
    # exact weighted Jaccard
    shared = (pairs.join(ws, ["id", "th", "p", "len", "n"])
              .select("id", "th", "p", "len", "n", "item", "text_hash", "total", "item_total", "hamming", F.explode("hs").alias("h"))
              .join(small(items.select("item", "text_hash", "h", "weight")), ["item", "text_hash", "h"])
              .groupBy("id", "th", "p", "len", "n", "item", "text_hash", "total", "item_total", "hamming").agg(F.sum("weight").alias("common")))
    # a shingle's weight is the same on both sides
    sim = F.col("common") / (F.col("total") + F.col("item_total") - F.col("common"))
    good = shared.withColumn("similarity", sim).where(F.col("similarity") >= similarity)
    w = Window.partitionBy("id", "th", "item").orderBy(F.desc("similarity"), "p", "text_hash")
    best = good.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return best.select(F.col("id.v").alias(id_col), F.col("item").alias(item_col), F.col("similarity").cast("double").alias("similarity"),
                       F.col("p").cast("long").alias("start_word"), F.col("n").cast("long").alias("n_words"), F.col("hamming").cast("int").alias("hamming"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item, whatever
    their ids."""
    keyed = with_row_keys(docs)
    bad = find(keyed, benchmark, id_col=ROW, text_col=text_col, **kw).select(ROW).distinct()
    return keyed.join(bad, ROW, "left_anti").drop(ROW)
