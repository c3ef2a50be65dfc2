"""The manifest against a tree built in one process, and its SQL."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from surv.llm import merkle as M
from tests.llm.fixtures import clash

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, i):
    out = []
    for nodes in levels[:-1]:
        a = i // 3 * 3
        out.append((nodes[a:i], nodes[i + 1:a + 3]))
        i //= 3
    return out


def expected(rows):
    """(id, leaf, subroot, root, proof, folded) of every row."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    keys = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for k in keys:
        groups[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[k] = tree([leaf(r) for r in groups[k]])
    upper = tree([trees[k][-1][0] for k in keys])
    out = []
    for j, k in enumerate(keys):
        for i, r in enumerate(groups[k]):
            path = way(trees[k], i) + way(upper, j)
            new = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                new = leaf((*r[:4], r[4].replace("\n", "")))
            for a, b in path:
                new = sha(*a, new, *b)
            out.append((r[0], leaf(r), trees[k][-1][0], upper[-1][0], "".join(x for a, b in path for x in a + b), new))
    return out


def rows_of(n, seed):
    r = random.Random(seed)
    names = ["a", "ä", "b", None, "Z", "", "\U0001F600", "�"]
    out = [(i, "hot" if i % 3 == 0 else r.choice(names), r.choice([None, "en"]), r.choice([None, 7]),
            r.choice([None, "", "x\ny\n", "plain", "é\n" * 5])) for i in range(n)]
    out += [out[4], out[4], (4, out[4][1], "zz", None, None), (None, "a", None, None, "t\n"), (None, None, None, None, None), (10**6, "b", None, 1, "w\n" * 300_000)]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("levels,n", [(6, 60), (1, 200), (2, 200), (2, 0), (2, 1)])
def test_manifest_equals_brute_force(spark, monkeypatch, levels, n):
    monkeypatch.setattr(M, "BLOCK_LEVELS", levels)
    monkeypatch.setattr(M, "BLOCK", 3 ** levels)
    rows = rows_of(n, n) if n > 1 else [(5, None, None, None, "a\nb")][:n]
    docs = clash(spark.createDataFrame(rows, SCHEMA)).withColumn("g", F.lit(1)).withColumn("pos", F.lit("x"))
    m = M.documents_manifest(docs)
    got = [tuple(r) for r in m.audit().select("id", "leaf", "subroot", "root", "proof", "folded_root").collect()]
    assert sorted(got, key=repr) == sorted(expected(rows), key=repr)
    assert m.root() == (got[0][3] if rows else None)


def test_versions_share_all_but_the_ancestors(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_LEVELS", 2)
    monkeypatch.setattr(M, "BLOCK", 9)
    rows = [(i, "s", None, None, "a\nb") for i in range(100)]
    out = M.documents_manifest(spark.createDataFrame(rows, SCHEMA)).audit(versions=True).collect()
    for r in out:
        changed = zlib.crc32(str(r.id).encode()) % 2 == 0
        assert len(r.copies) == (5 if changed else 0) and (r.folded_root != r.root) == changed
        assert not changed or r.copies[-1] == r.folded_root


def test_root_does_not_depend_on_partitions(spark):
    rows = rows_of(300, 9)
    a = spark.createDataFrame(rows, SCHEMA)
    roots = {M.documents_manifest(x).root() for x in (a, a.repartition(7, "text"), a.coalesce(1))}
    assert len(roots) == 1
