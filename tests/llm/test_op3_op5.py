"""Similarity join and decontamination against brute force."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from surv.llm import decontam, graph, ngram_join as J
from tests.llm.fixtures import SCHEMA, clash, make_docs, words


def sets_of(rows):
    out = []
    for i, t in rows:
        w = words(t)
        out.append((i, {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    return out


def brute(rows):
    s = sets_of(rows)
    root = list(range(len(s)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    deg = collections.Counter()
    for i in range(len(s)):
        for j in range(i):
            a, b = s[i][1], s[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                deg[i] += 1
                deg[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i in range(len(s)):
        least[find(i)] = min(least.get(find(i), s[i][0]), s[i][0])
    return sorted((s[i][0], len(s[i][1]), least[find(i)], deg[i]) for i in range(len(s)))


@pytest.mark.parametrize("blocks", [2048, 3])
def test_join_is_exact(spark, blocks):
    rows = make_docs()
    df = clash(spark.createDataFrame(rows, SCHEMA))
    got = sorted(tuple(r) for r in J.similarity_classes(df, block_sets=blocks, block_shingles=blocks * 100).select("doc_id", "n_shingles", "component_id", "n_links").collect())
    assert got == brute([(i, t) for i, t, _, _ in rows])


def test_join_of_an_empty_table_and_deduplication(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert J.similarity_classes(empty).count() == 0
    rows = make_docs()
    df = spark.createDataFrame(rows, SCHEMA)
    keep = {i for i, _, c, _ in brute([(i, t) for i, t, _, _ in rows]) if i == c}
    assert {r.doc_id for r in J.deduplicate(df).collect()} == keep


def test_prefix_tree_matches_all_pairs():
    r = random.Random(4)
    base = [sorted(r.sample(range(400), r.randint(1, 60))) for _ in range(12)]
    sets = []
    for _ in range(150):
        s = set(r.choice(base))
        for _ in range(r.randint(0, 5)):
            s.add(r.randrange(400))
            s.discard(r.choice(list(s)))
        if s:
            sets.append(np.array(sorted(s), np.uint32))
    tree, member = J.PrefixTree(sets), np.zeros(401, np.int32)
    for i, a in enumerate(sets):
        want = {j for j, b in enumerate(sets) if 100 * len(set(a) & set(b)) >= 80 * len(set(a) | set(b))}
        assert set(tree.match(a, member, 80).tolist()) == want
    # sketches never exclude a pair that links
    rnd = np.random.RandomState(1)
    pool = rnd.randint(0, 1 << 62, 500).astype(np.uint64) * np.uint64(4)
    for _ in range(300):
        a = np.unique(rnd.choice(pool, rnd.randint(1, 300)))
        b = np.unique(np.concatenate([a[: int(len(a) * rnd.uniform(.7, 1))], rnd.choice(pool, rnd.randint(0, 40))]))
        inter = len(np.intersect1d(a, b))
        if len(b) and 100 * inter >= 80 * (len(a) + len(b) - inter):
            assert J.near_pairs([(0, len(a), J.sketch(a)), (1, len(b), J.sketch(b))], None, 80)


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5), (None, 4)], "a long, b long")
    got = {r.node: r.component for r in graph.components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20}


def norm(t):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())


def grams(w):
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_decontamination_against_all_windows(spark):
    r = random.Random(8)
    items = [(k, " ".join(f"w{r.randrange(500)}" for _ in range(r.randint(12, 40)))) for k in range(25)] + [(90, "a b c"), (91, None), (92, ""), (93, "the, END?")]
    docs = []
    for i in range(40):
        w = [f"v{r.randrange(900)}" for _ in range(r.randint(0, 80))]
        if i % 2:
            q = items[r.randrange(25)][1].split()
            if i % 3 == 0:
                q = q[r.randint(0, 2):]                 # edge words missing
            if i % 7 == 0:
                q[r.randrange(len(q))] = "zz"          # an inner word changed
            k = r.randint(0, len(w))
            w = w[:k] + [x.upper() + "," for x in q] + w[k:]
        docs.append((i, " ".join(w)))
    docs += [(50, None), (51, ""), (52, "A b... C"), (53, "x a b c"), (54, "the end"), (1, docs[1][1])]
    total = len(items)
    df = collections.Counter(g for _, t in items for g in grams(norm(t)))
    weight = lambda g: max(1, min(8, 1 + int(np.floor(np.log2(total / df[g]))))) if g in df else min(8, total.bit_length())
    want = {}
    for i, t in docs:
        w = norm(t)
        for k, q in items:
            iw = norm(q)
            if not iw or (len(iw) < 5 and len(w) != len(iw)):
                continue
            gi, best = grams(iw), 0
            for p in range(len(w) - len(iw) + 1):
                gw = grams(w[p:p + len(iw)])
                best = max(best, sum(map(weight, gw & gi)) / sum(map(weight, gw | gi)))
            if best >= 0.8:
                want[i, k] = best
    d = clash(spark.createDataFrame(docs, "doc_id long, text string"))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x for x in decontam.find(d, b).collect()}
    assert set(got) <= set(want) and len(want) > 10
    assert all(abs(got[k].similarity - want[k]) < 1e-9 for k in got if want[k] > 0.99)
    # the radius may miss a pair near the threshold, never a close one
    assert {k for k, v in want.items() if v >= 0.87} <= set(got)
    left = {x.doc_id for x in decontam.clean(d, b).collect()}
    assert left == {i for i, _ in docs} - {i for i, _ in got}


def test_exact_check_reads_written_shingles(spark, tmp):
    """The texts are read before the result is asked for; the result itself
    comes from the written shingles and items, not from the texts again."""
    item = " ".join(f"w{k}" for k in range(20))
    spark.createDataFrame([(1, "x y " + item + " z"), (2, "nothing of it is here today"), (None, item), (4, None)],
                          "doc_id long, text string").write.parquet(f"{tmp}/documents.parquet")
    found = decontam.find(spark.read.parquet(f"{tmp}/documents.parquet"), spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert not [f for f in found.inputFiles() if f"{tmp}/documents.parquet" in f]
    got = {(x.doc_id, x.item_id, x.similarity, x.start_word, x.n_words) for x in found.collect()}
    assert got == {(1, 7, 1.0, 2, 20), (None, 7, 1.0, 0, 20)}


def weighted_similarity(items, docs):
    """(document, item): similarity of the best window, by all windows."""
    total = len(items)
    df = collections.Counter(g for _, t in items for g in grams(norm(t)))
    weight = lambda g: max(1, min(8, 1 + int(np.floor(np.log2(total / df[g]))))) if g in df else min(8, total.bit_length())
    sets = {k: grams(norm(t)) for k, t in items}
    out = {}
    for i, k, t in docs:
        w, n = norm(t), len(norm(dict(items)[k]))
        for p in range(max(len(w) - n, 0) + 1):
            gw = grams(w[p:p + n])
            out[i, k] = max(out.get((i, k), 0), sum(map(weight, gw & sets[k])) / sum(map(weight, gw | sets[k])))
    return out


def test_recall_near_the_threshold(spark):
    """Planted pairs from 0.80 on, items of 12 to 90 words, whose shingles are
    light (shared by many items) and heavy: at least 99 of 100 are found, and all
    found are right."""
    r = random.Random(21)
    common = [[f"c{r.randrange(300)}" for _ in range(60)] for _ in range(6)]
    items = []
    for k in range(160):
        n = r.choice([12, 16, 24, 40, 60, 90])
        w = [f"w{r.randrange(4000)}" for _ in range(n)]
        if k % 2:                                  # half of the item is a passage that many items share
            c = common[k % 6][: n // 2]
            w[: len(c)] = c
        items.append((k, " ".join(w)))
    docs = []
    for i in range(900):
        k = r.randrange(160)
        w = dict(items)[k].split()
        for _ in range(r.choice([1, 1, 2]) if len(w) >= 60 else 1 if len(w) >= 24 else 0):
            w[r.choice([r.randrange(len(w)), 0, len(w) - 1, 1])] = "zz"
        w = w[r.choice([0, 0, 1, 2]): len(w) - r.choice([0, 0, 1, 2])]
        pre, post = ([f"v{r.randrange(900)}" for _ in range(r.choice([0, 3, 15]))] for _ in range(2))
        docs.append((i, k, " ".join(pre + w + post)))
    sim = weighted_similarity(items, docs)
    want = {x for x, v in sim.items() if v >= 0.8}
    near = {x for x in want if sim[x] < 0.87}
    d = spark.createDataFrame([(i, t) for i, _, t in docs], "doc_id long, text string")
    found = {(x.doc_id, x.item_id): x.similarity for x in decontam.find(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    planted = {(i, k) for i, k, _ in docs}
    got = {x for x in found if x in planted}
    assert len(near) > 60 and len(want) > 300 and got <= want
    assert len(got & want) >= 0.99 * len(want) and len(got & near) >= 0.97 * len(near)
    assert all(found[x] <= sim[x] + 1e-9 for x in got)


@pytest.mark.parametrize("broadcast", [200_000, 1])
def test_long_items_and_many_grams(spark, monkeypatch, broadcast):
    """An item beyond the small counters, and the way without a broadcast."""
    monkeypatch.setattr(decontam, "BROADCAST_GRAMS", broadcast)
    r = random.Random(2)
    long = [f"w{r.randrange(5000)}" for _ in range(6_000)]
    short = [f"s{r.randrange(500)}" for _ in range(30)]
    items = [(1, " ".join(long)), (2, " ".join(short))]
    changed = list(long)
    for k in range(0, 6_000, 150):
        changed[k] = "zz"
    docs = [(1, " ".join(["a"] * 7 + long + ["b"] * 9)), (2, " ".join(changed)), (3, " ".join(long[:3_000])), (4, " ".join(["q"] + short)), (5, "x y z a b c")]
    got = {(x.doc_id, x.item_id): x.similarity for x in decontam.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    sim = weighted_similarity(items, [(i, k, t) for i, t in docs for k in (1, 2) if i != 5])
    assert set(got) == {x for x, v in sim.items() if v >= 0.8} and (2, 1) in got and all(abs(v - sim[x]) < 1e-9 for x, v in got.items())


def test_decontamination_of_empty_tables(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert decontam.find(d, one.selectExpr("doc_id AS item_id", "text")).count() == 0
    assert decontam.find(one, b).count() == 0 and decontam.clean(one, b).count() == 1


def test_multi_index_finds_all_within_radius(spark):
    r = random.Random(2)
    n, radius = 64, 15
    a = [(k, r.getrandbits(64) - (1 << 63)) for k in range(n)]
    b = []
    for k, v in a:
        u = v & ((1 << 64) - 1)
        for x in r.sample(range(64), r.randint(0, 18)):
            u ^= 1 << x
        b.append((k, u - (1 << 64) if u >> 63 else u))
    left = spark.createDataFrame(a, "k long, fp long").select("k", "fp", F.posexplode(decontam._blocks(F.col("fp"), radius)))
    right = spark.createDataFrame(b, "k2 long, fp2 long").select("k2", "fp2", F.posexplode(decontam._blocks(F.col("fp2"), radius)))
    met = {(x.k, x.k2) for x in left.join(right, ["pos", "col"]).where("k = k2").select("k", "k2").distinct().collect()}
    near = {(k, k) for (k, v), (_, u) in zip(a, b) if bin((v ^ u) & ((1 << 64) - 1)).count("1") <= radius}
    assert near <= met


def test_stages_decide_by_row_not_by_id(spark):
    a, b, q = (" ".join(f"{c}{i}" for i in range(40)) for c in "abq")
    c = "something else that has nothing to do with any of the others here"
    rows = [(1, a), (1, a), (2, a), (2, c), (None, a), (None, b), (None, b), (4, None), (4, None)]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = J.deduplicate(df)
    assert kept.columns == df.columns
    assert collections.Counter((x.doc_id, x.text) for x in kept.collect()) == {(1, a): 1, (2, c): 1, (None, b): 1, (4, None): 2}
    rows = [(1, "x " + q + " y"), (1, c), (None, q), (None, c), (None, None)]
    left = decontam.clean(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, q)], "item_id long, text string"))
    assert {(x.doc_id, x.text) for x in left.collect()} == {(1, c), (None, c), (None, None)}


def test_item_cut_at_the_end_of_a_text_and_as_the_whole_text(spark):
    q = [f"q{i}" for i in range(37)]
    f = [f"f{i}" for i in range(60)]
    # items that share a light beginning; a text with another light beginning keeps
    # 20 of their 26 shingles, but 100 of the 124 of the weight
    pre = [f"p{i}" for i in range(10)]
    alt = [f"a{i}" for i in range(6)] + pre[6:]
    items = ([(1, " ".join(q))] + [(10 + k, " ".join(pre + [f"own{k}x{i}" for i in range(20)])) for k in range(8)]
             + [(20 + k, " ".join(alt + [f"other{k}x{i}" for i in range(25)])) for k in range(8)])
    docs = [(1, f + q[:36]), (2, q[:36]), (3, q[1:]), (4, f + q[:35]), (5, q[1:] + f), (6, f + q[1:]), (7, q[:25]), (8, f + q[:36] + f), (9, f + alt + items[1][1].split()[10:] + f)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in docs] + [(None, " ".join(q))], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.find(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {i for i, k in got if k == 1} == {1, 2, 3, 4, 5, 6, 8, None}
    assert abs(got[9, 10].similarity - 100 / 124) < 1e-9 and got[9, 10].start_word == 60
    assert abs(got[1, 1].similarity - 32 / 34) < 1e-9 and (got[1, 1].start_word, got[1, 1].n_words) == (59, 37)
    assert abs(got[2, 1].similarity - 32 / 33) < 1e-9 and (got[2, 1].start_word, got[2, 1].n_words) == (0, 36)
