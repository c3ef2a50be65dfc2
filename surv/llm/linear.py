"""Small linear models for bounded training samples: hashed sparse indicator
rows, logistic regression, a hinge-loss model by dual coordinate descent, and
the drawing of a bounded labelled sample with Spark."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HASH_BITS = 22


def slot(feature: str, bits: int = HASH_BITS) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & ((1 << bits) - 1)


def sample_rows(docs: DataFrame, labels: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, text, label columns)`` for at most about ``limit`` labelled
    ids, chosen by a hash of the id.  The ids of the sample, bounded by
    ``limit`` plus a few standard deviations, are broadcast to the documents.
    One label row per id is used (repeated ids: the smallest labels)."""
    cols = [c for c in labels.columns if c != id_col]
    lab = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(*[F.min(c).alias(f"_{c}") for c in cols])
    total = lab.count()
    share = min(1.0, limit / total) if total else 1.0
    top = min((1 << 63) - 1, int(-(1 << 63) + share * ((1 << 64) - 1)))
    lab = lab.where(F.xxhash64(F.col("_id"), F.lit(11)) <= F.lit(top))
    d = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    return d.join(F.broadcast(lab), "_id")


class Rows:
    """Sparse binary rows: sorted feature numbers and row bounds."""

    def __init__(self, rows: list[np.ndarray]):
        self.n = len(rows)
        self.at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        self.idx = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.at))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.idx], minlength=self.n)

    def dot_t(self, g: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.idx, weights=g[self.row], minlength=width)

    def df(self, mask: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.idx[mask[self.row]], minlength=width).astype(np.float64)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logistic(x: Rows, dense: np.ndarray, y: np.ndarray, width: int, l2: float = 1.0, steps: int = 60):
    """Weights of indicator features, of ``dense`` columns, and the intercept:
    regularised logistic regression by accelerated gradient steps with a
    diagonal curvature bound."""
    k = dense.shape[1]
    curve = 0.25 * (np.bincount(x.idx, weights=np.diff(x.at)[x.row] + 1.0 + k, minlength=width)) + l2
    cd = 0.25 * (np.abs(dense) * (np.diff(x.at)[:, None] + 1.0 + k)).sum(0) + l2
    cb = 0.25 * (np.diff(x.at) + 1.0 + k).sum() + 1e-6
    # the bound is very loose for long rows; scaled up, with a check of the loss
    w, d, b = np.zeros(width), np.zeros(k), float(np.log((y.mean() + 1e-4) / (1 - y.mean() + 1e-4)))
    vw, vd, vb, t, speed, last = w.copy(), d.copy(), b, 1.0, 40.0, np.inf
    for _ in range(steps):
        z = x.dot(vw) + dense @ vd + vb
        g = sigmoid(z) - y
        nw, nd, nb = vw - speed * (x.dot_t(g, width) + l2 * vw) / curve, vd - speed * (dense.T @ g + l2 * vd) / cd, vb - speed * g.sum() / cb
        zz = x.dot(nw) + dense @ nd + nb
        loss = np.logaddexp(0, np.where(y > 0, -zz, zz)).sum() + l2 / 2 * ((nw ** 2).sum() + (nd ** 2).sum())
        if loss > last and speed > 1:
            speed, t, vw, vd, vb = max(1.0, speed / 3), 1.0, w.copy(), d.copy(), b
            continue
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        m = (t - 1) / t2
        vw, vd, vb = nw + m * (nw - w), nd + m * (nd - d), nb + m * (nb - b)
        w, d, b, t, last = nw, nd, nb, t2, loss
    return w, d, b


def dual_descent(x: Rows, value: np.ndarray, scale: np.ndarray, y: np.ndarray, c: float, epochs: int = 12, seed: int = 5):
    """Linear hinge-loss model by dual coordinate descent.  A row's entries are
    ``value[feature] * scale[row]``, with one constant entry as intercept;
    ``y`` is -1 or 1, ``c`` the penalty per row."""
    w, b = np.zeros(len(value)), 0.0
    v = (value[x.idx] * scale[x.row]).astype(np.float32)
    diag = np.bincount(x.row, weights=v * v, minlength=x.n) + 1.0
    alpha = np.zeros(x.n)
    cs = np.broadcast_to(np.asarray(c, float), (x.n,))
    rng = np.random.RandomState(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(x.n):
            s, e = x.at[i], x.at[i + 1]
            f, u = x.idx[s:e], v[s:e]
            g = y[i] * (w[f] @ u + b) - 1
            a = min(max(alpha[i] - g / diag[i], 0.0), cs[i])
            step = (a - alpha[i]) * y[i]
            if step:
                moved = max(moved, abs(a - alpha[i]))
                alpha[i] = a
                w[f] += step * u
                b += step
        if moved < 1e-3:
            break
    return w, b


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a sigmoid from margins to the labels (0 or 1)."""
    a, b, l2 = 1.0, 0.0, 1e-3
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(50):
        p = sigmoid(a * margin + b)
        g = np.array([((p - t) * margin).sum() + l2 * (a - 1), (p - t).sum()])
        s = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * margin * margin).sum() + l2, (s * margin).sum()], [(s * margin).sum(), s.sum() + l2]])
        step = np.linalg.solve(h, g)
        step = np.clip(step, -2, 2)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)
