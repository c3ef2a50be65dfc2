"""Toxicity by a classifier chain.

Categories are predicted one after the other.  The model of a category is a
logistic regression over indicators (distinct words, and beginnings of words of
4 to 6 letters) and the probabilities of the categories before it.  In training
those probabilities are out of fold: each row's come from chains fitted without
its fold, so later models see inputs as good or bad as those they get when
predicting.  A first category that has no labels of its own is left out.

The fit uses at most about ``sample`` labelled rows; indicators are hashed, and
the ``features`` with the largest chi-square over the categories are used.
Rows with a null label teach nothing for that category.  Null, empty and
wordless texts have no indicator and get the intercept's probabilities.  With
one class only, a category's probability is that class's share.  Repeated rows
count as they come; extra columns are kept.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surv.llm.linear import HASH_BITS, Rows, logistic, sample_rows, sigmoid, slot
from surv.llm.rows import add_columns, restore

SAMPLE = 10_000
FEATURES = 5_000
FOLDS = 4
MIN_DF = 3
LEAST_CHI2 = 10.83   # one in a thousand by chance
L2 = 0.3
CACHE_WORDS = 600_000
_WORD = re.compile(r"[^\W_]+")


def features_of(word: str) -> list[str]:
    return [word] + [f"{word[:n]}~" for n in (4, 5, 6) if len(word) >= n]


def distinct_words(text: str | None) -> set:
    return set(_WORD.findall((text or "").lower()))


class Chain:
    """Slots in use, and per category weights, chain weights and intercept."""

    def __init__(self, names: list[str], number: dict[int, int], models: list):
        self.names, self.number, self.models = names, number, models

    def probabilities(self, hits: list[int]) -> list[float]:
        out: list[float] = []
        idx = np.fromiter(hits, np.int64, len(hits))
        for w, d, b in self.models:
            z = b + (w[idx].sum() if len(idx) else 0.0) + sum(x * y for x, y in zip(d, out))
            out.append(float(sigmoid(z)))
        return out


def _fit_one(x: Rows, dense: np.ndarray, y: np.ndarray, width: int):
    if y.min() == y.max() if len(y) else True:
        p = float(y.mean()) if len(y) else 0.5
        return np.zeros(width), np.zeros(dense.shape[1]), float(np.log((p + 1e-4) / (1 - p + 1e-4)))
    return logistic(x, dense, y, width, L2)


def fit_chain(rows: list[np.ndarray], y: np.ndarray, width: int, folds: int = FOLDS) -> list:
    """Models of the chain.  ``y`` has a column per category, NaN: unlabelled."""
    n, k = y.shape
    fold = np.arange(n) % folds
    dense = np.zeros((n, 0))
    models = []
    for c in range(k):
        known = ~np.isnan(y[:, c])
        oof = np.zeros(n)
        for f in range(folds):
            tr, te = np.flatnonzero(known & (fold != f)), np.flatnonzero(fold == f)
            w, d, b = _fit_one(Rows([rows[i] for i in tr]), dense[tr], y[tr, c], width)
            if len(te):
                oof[te] = sigmoid(Rows([rows[i] for i in te]).dot(w) + dense[te] @ d + b)
        tr = np.flatnonzero(known)
        models.append(_fit_one(Rows([rows[i] for i in tr]), dense[tr], y[tr, c], width))
        dense = np.column_stack([dense, oof])
    return models


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text",
        sample: int = SAMPLE, features: int = FEATURES) -> Chain:
    """Chain over ``categories`` (name: expression over ``labels`` that is 0, 1
    or null), in their order."""
    names = list(categories)
    lab = labels.select(id_col, *[e.cast("int").alias(f"y{i}") for i, e in enumerate(categories.values())])
    lab = lab.where(" OR ".join(f"y{i} IS NOT NULL" for i in range(len(names))))

    def run(batches):
        for b in batches:
            xs = [np.unique(np.fromiter((slot(f) for w in distinct_words(t) for f in features_of(w)), np.int32)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[b.column(2 + i) for i in range(len(names))], pa.array(xs, pa.list_(pa.int32()))],
                                             ["id", *[f"y{i}" for i in range(len(names))], "x"])

    got = (sample_rows(docs, lab, sample, id_col, text_col)
           .select(F.col("_id").cast("string").alias("id"), "_text", *[F.col(f"_y{i}").alias(f"y{i}") for i in range(len(names))])
           .mapInArrow(run, "id string, " + ", ".join(f"y{i} int" for i in range(len(names))) + ", x array<int>").toArrow().sort_by([("id", "ascending")]))
    n = got.num_rows
    y = np.column_stack([got[f"y{i}"].to_pandas().astype("float64").to_numpy() for i in range(len(names))]) if n else np.zeros((0, len(names)))
    col = got["x"].combine_chunks()
    flat, at = col.flatten().to_numpy(), col.offsets.to_numpy() - (col.offsets[0].as_py() if n else 0)
    row = np.repeat(np.arange(n), np.diff(at)) if n else np.zeros(0, np.int64)
    size = 1 << HASH_BITS
    df = np.bincount(flat, minlength=size).astype(np.float64)
    best = np.zeros(size)
    for c in range(len(names)):
        pos, known = y[:, c] == 1, ~np.isnan(y[:, c])
        p, m = pos.sum(), known.sum()
        if 0 < p < m:
            a = np.bincount(flat[pos[row]], minlength=size)
            d = np.bincount(flat[known[row]], minlength=size)
            e = d * p / m
            best = np.maximum(best, (a - e) ** 2 / np.maximum(e * (1 - p / m) * (1 - d / m), 1e-3) * (d > 0))
    best[df < min(MIN_DF, max(1, n // 50))] = 0
    keep = np.sort(np.argsort(-best, kind="stable")[:features])
    keep = keep[best[keep] >= LEAST_CHI2]
    number = np.full(size, -1, np.int64)
    number[keep] = np.arange(len(keep))
    rows = [(lambda z: z[z >= 0])(number[flat[at[i]: at[i + 1]]]) for i in range(n)]
    return Chain(names, {int(s): i for i, s in enumerate(keep)}, fit_chain(rows, y, len(keep)))


def classify(docs: DataFrame, chain: Chain, text_col: str = "text", prefix: str = "p_") -> DataFrame:
    """``docs`` with a probability per category, ``p_<category>``."""
    sent = docs.sparkSession.sparkContext.broadcast(vars(chain))

    def task():
        c, cache = restore(Chain, sent.value), {}

        def hits_of(word):
            return [c.number[s] for s in (slot(f) for f in features_of(word)) if s in c.number]

        def run(texts):
            out = []
            for t in texts:
                hits: set = set()
                for w in distinct_words(t):
                    h = cache.get(w)
                    if h is None:
                        if len(cache) > CACHE_WORDS:
                            cache.clear()
                        h = cache[w] = hits_of(w)
                    if h:
                        hits.update(h)
                out.append(c.probabilities(sorted(hits)))
            return tuple([p[i] for p in out] for i in range(len(c.names)))
        return run

    return add_columns(docs, text_col, {f"{prefix}{n}": "double" for n in chain.names}, task)
