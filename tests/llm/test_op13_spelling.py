"""Near words, forms and roots against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from surv.llm import spelling as S
from tests.llm.fixtures import SCHEMA, clash, lower, make_docs


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def near_words(count):
    out = {}
    for w in count:
        near = [x for x in count if one_edit(w, x)]
        if near:
            top = min(near, key=lambda x: (-count[x], x))
            out[w] = (len(near), count[top], top)
    return out


def words_of(rows, least, drop_every):
    out = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", lower(t)):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if drop_every and h % drop_every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= least:
                out[w] += 1
    return out


def expected(count, times):
    near, form = near_words(count), {}
    for w, (_, n, x) in near.items():
        if n >= times * count[w]:
            form[w] = x

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, n, near.get(w, (0,))[0], form.get(w) or "", count[form[w]] if w in form else 0, root(w)) for w, n in count.items())


def rows(df):
    return sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or 0, r.root) for r in df.collect())


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abé", max_size=6), max_size=40), st.integers(0, 9))
def test_composition_of_any_words(words, seed):
    r = random.Random(seed)
    count = {w: r.randint(1, 4) for w in sorted(words)}
    assert S.compose(list(count), list(count.values())) == near_words(count)


def test_acceptor_is_minimal():
    a = S.Acceptor(sorted(["tap", "taps", "top", "tops"]))
    assert sum(1 for x in a.next if x) + 1 == 5      # t, a/o, p, s, end


def test_very_long_words():
    w = ["x" + "ab" * 30_000 + "y", "x" + "ab" * 29_999 + "cby", "x" + "ab" * 30_000]
    assert {k: v[0] for k, v in S.compose(w, [1, 2, 3]).items()} == {w[0]: 2, w[1]: 1, w[2]: 1}


@pytest.mark.parametrize("limit", [3, 40, 20_000])
def test_forms_equal_brute_force_at_every_cut(spark, limit):
    r = random.Random(limit)
    count = Counter()
    base = ["".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(60)]
    base += ["con" + "".join(r.choice("ab") for _ in range(r.randint(0, 8))) for _ in range(150)]      # a hot beginning
    for w in base:
        count[w] += r.choice([1, 2, 12, 150, 2000])
    for w in base[::3]:
        i = r.randrange(len(w))
        for v in (w[:i] + w[i + 1:], w[:i] + "é" + w[i:], w[:i] + "z" + w[i + 1:], w + "z", "z" + w):
            count[v or "q"] += 1
    df = spark.createDataFrame(list(count.items()), "word string, n long")
    cuts = {x.depth for x in S.partitions(df, limit).select("depth").distinct().collect()}
    assert (len(cuts) > 1) == (limit < 100)
    assert rows(S.forms(df, 10, limit)) == expected(count, 10)


@pytest.mark.parametrize("limit,drop", [(30, 3), (20_000, 31), (20_000, None)])
def test_documents(spark, limit, drop, monkeypatch):
    monkeypatch.setattr(S, "HELD", 50)
    data = make_docs(50) + [(700, "Naïveté NAÏVETÉ naïveté ×÷ÿabcdefg ÿabcdefg", None, None), (None, "tarimone tarimone TARIMONE", None, None),
                            (701, ("tarimones " * 400 + "tarimonés tarimonés tarimonéss tarimonéss " + "tarimons" * 2000 + " ") * 2, None, None)]
    docs = clash(spark.createDataFrame(data, SCHEMA)).selectExpr("*", "1 AS t", "2 AS key")
    got = rows(S.variants(docs, least_length=4, drop_every=drop, limit=limit))
    count = words_of([(x[0], x[1]) for x in data], 4, drop)
    assert got == expected({w: n for w, n in count.items() if n >= 2}, 10) and got


def test_roots_follow_chains(spark):
    count = {"aaaaaaa" + "b" * k: 2 * 10 ** k for k in range(7)}
    df = spark.createDataFrame(list(count.items()), "word string, n long")
    assert {r.root for r in S.forms(df).collect()} == {"aaaaaaabbbbbb"}


def test_empty_table(spark):
    assert S.variants(spark.createDataFrame([], SCHEMA)).count() == 0
