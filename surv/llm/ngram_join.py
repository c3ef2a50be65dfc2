"""Exact Jaccard self-join of word n-gram sets by prefix trees.

1. Every text becomes the set of its 5-word shingle hashes.  Equal sets (a
   128-bit signature) form a class; its smallest id represents it.
2. A global order of shingles, rare ones first, comes from counts over the
   whole corpus in ``2**bucket_bits`` hash buckets (a table of fixed size).
3. Two sets that reach the threshold share one of their first
   ``n - ceil(t*n) + 1`` shingles in that order and their sizes differ by a
   factor of at most ``1/t``.  Sizes fall into classes of that factor; a set
   offers its prefix in its own class, and a shorter prefix (the overlap that a
   larger set asks for is higher) in the next one.  Rows ``(shingle and class,
   set)``, dealt by that key, bring together all sets that can link.
4. A set's sketch counts its shingles in hash ranges (a quarter as many as
   shingles).  The distance of two sketches never exceeds the number of
   shingles that only one set has, so pairs further apart than the threshold
   allows are no links.  Inside each key's group (one of those with equal
   members; large ones in pairs of blocks) the other pairs are connected; the
   connected groups of this graph are closed under links.
5. Each group, cut by hash into blocks when it is large, is joined by tasks
   that hold one block, or a pair of blocks: the sets of a block are stored in
   a prefix tree in the global order, every set is matched against the whole
   tree level by level, nodes carry the overlap of their path, and a subtree
   is left as soon as the shingles that remain cannot lift any set in it to
   the threshold.  All links are found exactly; tasks return a spanning forest
   of them and each set's number of links, never all pairs.
6. Components of the forests are components of the links.

Nulls, empty texts and texts without a word have an empty set, linked with
nothing.  Repeated ids: rows are told apart by their text class; a repeated
(id, text) row appears as often as it came.  Extra columns are ignored.  Rows
with a null id are kept out of the join and returned alone.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surv.llm.graph import ARRAY_SCHEMA, array_rows, components, sum_arrays
from surv.llm.joins import ROW, with_ids, with_row_keys
from surv.llm.rows import bounded_batches
from surv.llm.words import SHINGLE, mix, shingle_sets
from surv.session import materialize

THRESHOLD = 80                 # percent
BUCKET_BITS = 20               # 4 MB table of shingle counts
BLOCK_SETS = 2048              # a task's block: so many sets
BLOCK_SHINGLES = 1_500_000     # and so many shingles at most, on average
SEGMENT = 24                   # shingles of one tree edge at most


def required(a, b, t: int = THRESHOLD):
    """Smallest overlap of sets of ``a`` and ``b`` items with 100*|A&B| >= t*|A|B|."""
    return -(-(t * (a + b)) // (100 + t))


def prefix_len(n: int, t: int = THRESHOLD) -> int:
    return n - -(-t * n // 100) + 1 if n else 0


def size_class(n: int, t: int = THRESHOLD) -> int:
    """Sizes within a factor of 100/t are in the same or in adjacent classes."""
    return int(math.log(n) / math.log(100 / t + 1e-7))


def _keys(h: np.ndarray, t: int) -> np.ndarray:
    """Keys that a set (in the global order) offers."""
    n = len(h)
    if not n:
        return h
    g = size_class(n, t)
    larger = max(n, math.ceil((100 / t + 1e-7) ** (g + 1) - 1e-6))
    with np.errstate(over="ignore"):
        own = mix(h[: prefix_len(n, t)] + np.uint64(g) * np.uint64(0x9E3779B97F4A7C15))
        nxt = mix(h[: max(0, n - required(n, larger, t) + 1)] + np.uint64(g + 1) * np.uint64(0x9E3779B97F4A7C15))
    return np.concatenate([own, nxt])


def _as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


class PrefixTree:
    """Sets (rows of dense item numbers, each in the global order) as a tree
    with edges of at most ``SEGMENT`` items; sets with a common beginning share
    its edges."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        lcp = [0]
        for x, y in zip(order, order[1:]):
            a, b = sets[x], sets[y]
            m = min(len(a), len(b))
            d = np.flatnonzero(a[:m] != b[:m])
            lcp.append(int(d[0]) if len(d) else m)
        # node: parent, items [start, end) of its edge, depth after it
        parent, chunks, depth, leaf_of = [-1], [np.zeros(0, np.uint32)], [0], np.zeros(len(sets), np.int64)
        path: list[int] = [0]
        for rank, i in enumerate(order):
            s, nxt = sets[i], (lcp[rank + 1] if rank + 1 < len(order) else 0)
            keep = lcp[rank]
            while depth[path[-1]] > keep:
                path.pop()
            at = depth[path[-1]]
            while at < len(s):
                # an edge ends where the next set, or a later one, may turn off
                stop = min(at + SEGMENT, len(s))
                if at < nxt < stop:
                    stop = nxt
                parent.append(path[-1]), chunks.append(s[at:stop]), depth.append(stop)
                path.append(len(parent) - 1)
                at = stop
            leaf_of[i] = path[-1]
        # A later set may turn off inside an edge made before: it then starts at
        # the last whole edge, so shared items of a cut edge are stored again.
        self.parent, self.depth = np.array(parent), np.array(depth, np.int64)
        self.start = np.concatenate([[0], np.cumsum([len(c) for c in chunks])])
        self.items = np.concatenate(chunks) if chunks else np.zeros(0, np.uint32)
        n = len(parent)
        kids = np.argsort(self.parent[1:], kind="stable") + 1
        self.kids, self.kid_at = kids, np.searchsorted(self.parent[kids], np.arange(n + 1))
        least, most = np.full(n, 1 << 60, np.int64), np.zeros(n, np.int64)
        np.minimum.at(least, leaf_of, self.size)
        np.maximum.at(most, leaf_of, self.size)
        for v in range(n - 1, 0, -1):
            p = parent[v]
            if least[v] < least[p]:
                least[p] = least[v]
            if most[v] > most[p]:
                most[p] = most[v]
        self.least, self.most = least, most
        by = np.argsort(leaf_of, kind="stable")
        self.ends, self.end_at = by, np.searchsorted(leaf_of[by], np.arange(n + 1))

    def match(self, probe: np.ndarray, member: np.ndarray, t: int) -> np.ndarray:
        """Numbers of the sets that reach the threshold with ``probe``.
        ``member`` is a zeroed scratch array over all items."""
        a = len(probe)
        member[probe] = 1
        node, over, seen = np.zeros(1, np.int64), np.zeros(1, np.int64), []
        while len(node):
            has = self.end_at[node + 1] > self.end_at[node]
            for v, o in zip(node[has], over[has]):
                sets = self.ends[self.end_at[v]: self.end_at[v + 1]]
                seen.append(sets[o >= required(a, self.size[sets], t)])
            lo, hi = self.kid_at[node], self.kid_at[node + 1]
            cnt = hi - lo
            tot = int(cnt.sum())
            if not tot:
                break
            base = np.repeat(over, cnt)
            node = self.kids[np.repeat(lo - np.concatenate([[0], np.cumsum(cnt)[:-1]]), cnt) + np.arange(tot)]
            # sizes out of range are left before their edge is read
            ok = (100 * self.most[node] >= t * a) & (100 * a >= t * self.least[node])
            node, base = node[ok], base[ok]
            if not len(node):
                break
            s, e = self.start[node], self.start[node + 1]
            ln = e - s
            idx = np.repeat(s - np.concatenate([[0], np.cumsum(ln)[:-1]]), ln) + np.arange(int(ln.sum()))
            hit = member[self.items[idx]]
            over = base + np.add.reduceat(hit, np.concatenate([[0], np.cumsum(ln)[:-1]]))
            left = np.minimum(a - over, self.most[node] - self.depth[node])
            ok = over + left >= required(a, np.maximum(self.least[node], -(-t * a // 100)), t)
            node, over = node[ok], over[ok]
        member[probe] = 0
        return np.concatenate(seen) if seen else np.zeros(0, np.int64)


def _ordered(h: np.ndarray, freq: np.ndarray, bits: int) -> np.ndarray:
    """Set in the global order: by bucket count, then by hash."""
    return h[np.argsort(freq[(h >> np.uint64(64 - bits)).astype(np.int64)], kind="stable")]


def join_block(left: list, right: list | None, freq: np.ndarray, bits: int, t: int):
    """Links inside ``left`` (``right`` None) or between ``left`` and ``right``.
    Items are ``(id, copies, hashes)``.  Returns a spanning forest as pairs of
    ids, and the number of linked rows per id."""
    rows = left + (right or [])
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    forest, links = [], {}
    copies = np.array([r[1] for r in rows], np.int64)

    def add(i, found):
        links[rows[i][0]] = links.get(rows[i][0], 0) + int(copies[found].sum())
        a = find(i)
        for j in found:
            b = find(int(j))
            if a != b:
                root[b] = a
                forest.append((rows[i][0], rows[int(j)][0]))

    if right is None and len(rows) == 2:
        a, b = rows[0][2], rows[1][2]
        n = len(np.intersect1d(a, b, assume_unique=True))
        if n >= required(len(a), len(b), t):
            add(0, np.array([1])), add(1, np.array([0]))
        return forest, links
    items, dense = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True)
    rank = np.empty(len(items), np.uint32)
    rank[np.argsort(freq[(items >> np.uint64(64 - bits)).astype(np.int64)], kind="stable")] = np.arange(len(items), dtype=np.uint32)
    cut = np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])])
    sets = [np.sort(rank[dense[cut[i]: cut[i + 1]]]) for i in range(len(rows))]
    member = np.zeros(len(items) + 1, np.int32)
    n = len(left)
    if right is None:
        tree = PrefixTree(sets)
        for i in range(n):
            found = tree.match(sets[i], member, t)
            add(i, found[found != i])
    else:
        there, here = PrefixTree(sets[n:]), PrefixTree(sets[:n])
        for i in range(n):
            add(i, there.match(sets[i], member, t) + n)
        for j in range(n, len(rows)):
            add(j, here.match(sets[j], member, t))
    return forest, links


def sketch(h: np.ndarray) -> np.ndarray:
    """Counts (at most 255) of a set's shingles in equal ranges of the hash."""
    m = 1 << max(5, (max(len(h), 1) // 4 - 1).bit_length())
    return np.minimum(np.bincount((h >> np.uint64(64 - m.bit_length() + 1)).astype(np.int64), minlength=m), 255).astype(np.uint8)


def _folded(sk: np.ndarray, m: int) -> np.ndarray:
    return np.minimum(sk.reshape(m, -1).sum(1, dtype=np.int64), 255) if len(sk) > m else sk


def near_pairs(left: list, right: list | None, t: int) -> list[tuple[int, int]]:
    """Spanning forest of the pairs whose sketches do not exclude a link.
    Items are ``(node, n, sketch)``."""
    rows = left + (right or [])
    m = min(len(r[2]) for r in rows)
    x = np.stack([_folded(r[2], m) for r in rows]).astype(np.int16)
    n = np.array([r[1] for r in rows], np.int64)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out, cut = [], len(left)
    step = max(1, 4_000_000 // (len(rows) * m))
    for a in range(0, cut if right is not None else len(rows), step):
        z = min(a + step, cut if right is not None else len(rows))
        lo = cut if right is not None else a
        gap = np.abs(x[a:z, None, :] - x[None, lo:, :]).sum(2, dtype=np.int64)
        # |A ^ B| <= (100 - t) / (100 + t) * (|A| + |B|) for a link
        ok = (100 + t) * gap <= (100 - t) * (n[a:z, None] + n[None, lo:])
        for i, j in zip(*np.nonzero(ok)):
            i, j = int(i) + a, int(j) + lo
            if right is not None or i < j:
                p, q = find(i), find(j)
                if p != q:
                    root[q] = p
                    out.append((rows[i][0], rows[j][0]))
    return out


def _pairs_of_blocks(rows: DataFrame, keys: list[str], salt: str, payload: list) -> DataFrame:
    """Rows of each group dealt to the pairs of its ``nb`` hash blocks, a row to
    ``nb`` of them, sorted so that a pair's rows follow each other."""
    b = rows.withColumn("blk", F.when(F.col("nb") > 1, F.pmod(F.xxhash64(salt, F.lit(7)), F.col("nb"))).otherwise(0).cast("int"))
    d = (b.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
         .select(*keys, F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", *payload))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return d.repartition(parts, *keys, "i", "j").sortWithinPartitions(*keys, "i", "j")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]):
    """Consecutive rows with equal keys as ``(key, table)``; a run may span
    batches."""
    last, run = None, []
    for b in batches:
        k = list(zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in keys)))
        at = 0
        for i in range(len(k)):
            if k[i] != (k[i - 1] if i else last):
                if i > at:
                    run.append(b.slice(at, i - at))
                if run:
                    yield last, pa.Table.from_batches(run)
                run, last, at = [], k[i], i
        if len(k) > at:
            run.append(b.slice(at))
    if run:
        yield last, pa.Table.from_batches(run)


def signature(h: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set of hashes."""
    if not len(h):
        return 0, 0
    s = np.add.reduce(h * np.uint64(0x9FB21C651E98DF25), keepdims=True)
    x = np.bitwise_xor.reduce((h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93), keepdims=True)
    return int(_as_long(s)[0]), int(_as_long(x)[0])


def similarity_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD,
                       shingle: int = SHINGLE, bucket_bits: int = BUCKET_BITS, block_sets: int = BLOCK_SETS,
                       block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Per row of ``docs``: id, ``n_shingles``, ``component_id`` (smallest id
    reachable by links) and ``n_links`` (rows it links with, copies included).
    The id column must be integral."""
    spark = docs.sparkSession
    bounded_batches(spark)
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def count(batches):
        acc = np.zeros(1 << bucket_bits, np.float32)
        for b in batches:
            hs, held = [], 0
            for _, h in shingle_sets(b.column(0), shingle):
                hs.append(h)
                held += len(h)
                if held > 1 << 20:
                    acc += np.bincount((np.concatenate(hs) >> np.uint64(64 - bucket_bits)).astype(np.int64), minlength=1 << bucket_bits)
                    hs, held = [], 0
            if held:
                acc += np.bincount((np.concatenate(hs) >> np.uint64(64 - bucket_bits)).astype(np.int64), minlength=1 << bucket_bits)
        yield from array_rows({0: acc})

    freq = sum_arrays(d.select("text").mapInArrow(count, ARRAY_SCHEMA), {0: 1 << bucket_bits})[0]
    table = spark.sparkContext.broadcast(freq)

    def describe(batches):
        seen: set[int] = set()   # classes this task has given prefixes for; only saves rows
        for b in batches:
            n, s1, s2, pre, sk = [], [], [], [], []
            for words, h in shingle_sets(b.column(1), shingle):
                n.append(len(h))
                x, y = signature(h)
                s1.append(x), s2.append(y)
                if x in seen:
                    pre.append(np.zeros(0, np.int64)), sk.append(None)
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(x)
                pre.append(_as_long(_keys(_ordered(h, table.value, bucket_bits), threshold)))
                sk.append(sketch(h).tobytes())
            cut = np.concatenate([[0], np.cumsum([len(p) for p in pre])]).astype(np.int32)
            flat = np.concatenate(pre) if pre else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()),
                                              pa.ListArray.from_arrays(pa.array(cut), pa.array(flat, pa.int64())), pa.array(sk, pa.binary())], ["id", "n", "s1", "s2", "pre", "sk"])

    sets = materialize(d.mapInArrow(describe, "id long, n long, s1 long, s2 long, pre array<long>, sk binary"), "sets")
    sig = ["n", "s1", "s2"]
    real = sets.where("n > 0 AND id IS NOT NULL")
    classes = materialize(real.groupBy(*sig).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    # Half of the signature names a class in the candidate graph; where two
    # classes should share it, their groups merge and the join tells them apart.
    tokens = real.select(F.explode("pre").alias("token"), F.col("s1").alias("node"))
    by_token = Window.partitionBy("token")
    shared = tokens.select("token", "node", F.min("node").over(by_token).alias("lo"), F.max("node").over(by_token).alias("hi"))
    shared = materialize(shared.where("lo <> hi").select("token", "node").distinct(), "shared")
    # keys with the same members say the same: one of them is enough
    member_sig = shared.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    one = member_sig.groupBy("k", "x", "y").agg(F.min("token").alias("token")).select("token", F.ceil(F.col("k") / block_sets).cast("int").alias("nb"))
    sketches = sets.where("sk IS NOT NULL").select(F.col("s1").alias("node"), F.col("n"), "sk").dropDuplicates(["node"])
    grouped = _pairs_of_blocks(shared.join(one, "token").join(sketches, "node"), ["token"], "node", ["node", "n", "sk"])
    pair_schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def refine(batches):
        a, b = [], []
        for (_, i, j), tab in _runs(batches, ["token", "i", "j"]):
            rows = [(bl, (x, n, np.frombuffer(k, np.uint8))) for bl, x, n, k in zip(*(tab[c].to_pylist() for c in ("blk", "node", "n", "sk")))]
            left, right = [r for bl, r in rows if bl == i], [r for bl, r in rows if bl == j]
            if len(rows) > 1 and left and right:
                for x, y in near_pairs(left, None if i == j else right, threshold):
                    a.append(x), b.append(y)
            if len(a) > 50_000:
                yield pa.RecordBatch.from_pydict({"a": a, "b": b}, pair_schema)
                a, b = [], []
        yield pa.RecordBatch.from_pydict({"a": a, "b": b}, pair_schema)

    cand = materialize(components(grouped.mapInArrow(refine, "a long, b long")), "groups")
    group = classes.join(cand, classes.s1 == cand.node).drop("node")
    stat = group.groupBy("component").agg(F.count(F.lit(1)).alias("_c"), F.sum("n").alias("_n"))
    blocks = stat.select("component", F.greatest(F.ceil(F.col("_c") / block_sets), F.ceil(F.col("_n") / block_shingles)).cast("int").alias("nb"))
    member = materialize(group.join(blocks, "component"), "members")

    # The representatives' texts; their sets are made again where they are joined.
    texts = with_ids(d.where("id IS NOT NULL"), member.select(F.col("rep").alias("id"), *sig, "copies", "component", "nb"))
    dealt = _pairs_of_blocks(texts, ["component"], "id", ["id", "copies", "s1", "s2", "text"])

    def solve(batches):
        out = {"kind": [], "a": [], "b": []}
        for key_, tab in _runs(batches, ["component", "i", "j"]):
            blk, node, copies, s1, s2 = (tab[c].to_pylist() for c in ("blk", "id", "copies", "s1", "s2"))
            got = {}
            for r, (_, h) in enumerate(shingle_sets(tab["text"], shingle)):
                name = (node[r], s1[r], s2[r])
                if name not in got and signature(h) == name[1:]:
                    got[name] = (blk[r], (s1[r], copies[r], h))
            if len(got) < 2:
                continue
            _, i, j = key_
            left = [x for bl, x in got.values() if bl == i]
            forest, links = join_block(left, None if i == j else [x for bl, x in got.values() if bl == j], table.value, bucket_bits, threshold)
            for a, b in forest:
                out["kind"].append(0), out["a"].append(a), out["b"].append(b)
            for a, b in links.items():
                out["kind"].append(1), out["a"].append(a), out["b"].append(b)
            if len(out["a"]) > 50_000:
                yield pa.RecordBatch.from_pydict(out, pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())]))
                out = {"kind": [], "a": [], "b": []}
        yield pa.RecordBatch.from_pydict(out, pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())]))

    found = materialize(dealt.mapInArrow(solve, "kind int, a long, b long"), "links")
    comp = components(found.where("kind = 0").select("a", "b")).select(F.col("node").alias("s1"), F.col("component").alias("root"))
    degree = found.where("kind = 1").groupBy(F.col("a").alias("s1")).agg(F.sum("b").alias("others"))
    whole = classes.join(comp, "s1", "left").join(degree, "s1", "left").withColumn("root", F.coalesce("root", "s1"))
    least = whole.groupBy("root").agg(F.min("rep").alias("component_id"))
    label = whole.join(least, "root").select(*sig, "component_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return (sets.select("id", *sig).join(label, sig, "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
                    F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row of each component of ``docs``: that with the smallest id, of rows
    that share it the one with the smallest text hash, of equal rows the first
    as written.  Rows with a null id take part and come last."""
    keyed = with_row_keys(docs)
    cls = similarity_classes(keyed, ROW, text_col, **kw).select(ROW, "component_id")
    order = F.struct(F.col(f"`{id_col}`").isNull().alias("no_id"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"), F.col(ROW).alias("row"))
    first = keyed.select(ROW, order.alias("_first")).join(cls, ROW).groupBy("component_id").agg(F.min("_first").alias("_first"))
    return keyed.join(first.select(F.col("_first.row").alias(ROW)), ROW, "left_semi").drop(ROW)
