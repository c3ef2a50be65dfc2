"""Small texts with the awkward cases, and brute-force helpers."""

import random
import re

WS = "[^\x20\x09-\x0D]+"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))


def words(t):
    return re.findall(WS, lower(t))


def make_docs(n=60, seed=3):
    """(doc_id, text, lang, source): random texts, exact and near copies, null,
    empty, wordless, one-word, repeated and very long texts."""
    r = random.Random(seed)
    vocab = ["".join(r.choice(["ta", "ri", "mo", "ne", "lu", "sé"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    rows = []
    for i in range(n):
        t = [r.choice(vocab) for _ in range(r.choice([3, 8, 30, 60, 120]))]
        rows.append((i, " ".join(t)))
    for i in range(n, n + 25):           # near copies: a few words changed
        t = rows[r.randrange(8)][1].split()
        for _ in range(r.randint(0, 3)):
            t[r.randrange(len(t))] = r.choice(vocab)
        rows.append((i, ("\n" if i % 2 else " ").join(t).upper() if i % 5 == 0 else " ".join(t)))
    k = n + 25
    rows += [(k, None), (k + 1, ""), (k + 2, " \t\n "), (k + 3, "One"), (k + 4, "one"), (k + 5, "a b c d"), (k + 6, "A  b\tc d"),
             (k + 7, " ".join(r.choice(vocab) for _ in range(30_000))), (k + 8, "!!! ??? 123"), (k + 9, "x " * 40), (k + 9, "x " * 40)]
    return [(i, t, [None, "en", "fr"][i % 3], ["s", None][i % 2]) for i, t in rows]


SCHEMA = "doc_id long, text string, lang string, source string"


def clash(df):
    """Extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F
    for c in ("id", "h", "n", "row", "token", "score", "_id", "_t", "rep", "bound", "w", "a.b"):
        df = df.withColumn(c, F.lit("extra"))
    return df
