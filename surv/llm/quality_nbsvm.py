"""Quality classifier: naive Bayes support vectors.

A text's indicators are its distinct lower-cased words and the 1- to 3-grams of
word shapes (runs of capitals, letters, digits; other characters as they are; a
word equal to the one before is marked).  Each indicator is scaled by the log
ratio of its smoothed class counts, rows are brought to unit length, and a
linear hinge-loss model is fitted by dual coordinate descent; weights are then
drawn towards their mean size.  Margins of folds left out fix the sigmoid that
turns a margin into a score.

The fit uses at most about ``sample`` labelled rows.  Rows with a null label
teach nothing.  Null, empty and wordless texts have no indicator and get the
score of the intercept.  With no labelled rows, or one class only, every score
is that class's share (0.5 without any).  Repeated rows count as they come;
extra columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surv.llm.linear import HASH_BITS, Rows, dual_descent, platt, sample_rows, sigmoid, slot
from surv.llm.rows import add_columns, restore

SAMPLE = 9_000
MIN_DF = 4
PENALTY = 1.0
BLEND = 0.25
FOLDS = 3
CACHE_WORDS = 150_000      # remembered by a task, twice; no result depends on it



def shape(word: str) -> str:
    out = []
    for ch in word:
        c = "0" if ch.isdigit() else ("A" if ch.isupper() else "a") if ch.isalpha() else ch
        if not out or out[-1] != c:
            out.append(c)
    return "".join(out[:8])


def indicators(text: str | None, cache: dict) -> set:
    """Distinct n-grams of a text: ``cache`` maps a word to its shape."""
    words = (text or "").split()
    shapes = []
    before = None
    for w in words:
        s = cache.get(w)
        if s is None:
            if len(cache) > CACHE_WORDS:
                cache.clear()
            s = cache[w] = shape(w)
        shapes.append("=" + s if w == before else s)
        before = w
    found = {("w", w.lower()) for w in set(words)}
    found.update(("s", s) for s in set(shapes))
    found.update(zip(shapes, shapes[1:]))
    found.update(zip(shapes, shapes[1:], shapes[2:]))
    return found


def slots(found: set) -> np.ndarray:
    return np.unique(np.fromiter((slot("\x1f".join(f)) for f in found), np.int64, len(found)))


class Model:
    """Slots in ascending order with their weight times scale and squared scale,
    intercept, and the sigmoid's two numbers."""

    def __init__(self, slots: np.ndarray, dots: np.ndarray, norms: np.ndarray, bias: float, a: float, b: float):
        self.slots, self.dots, self.norms, self.bias, self.a, self.b = slots, dots, norms, bias, a, b

    def table(self) -> dict[int, tuple[float, float]]:
        return dict(zip(self.slots.tolist(), zip(self.dots.tolist(), self.norms.tolist())))

    def score(self, weight: dict, found_slots) -> float:
        dot = norm = 0.0
        for s in found_slots:
            x = weight.get(s)
            if x:
                dot += x[0]
                norm += x[1]
        return float(sigmoid(self.a * (dot / max(norm, 1e-9) ** 0.5 + self.bias) + self.b))


def _solve(x: Rows, y: np.ndarray, width: int):
    """Scaled values, weights and intercept."""
    pos, neg = x.df(y > 0, width) + 1, x.df(y <= 0, width) + 1
    r = np.log(pos / (y > 0).sum().clip(1)) - np.log(neg / (y <= 0).sum().clip(1))
    norm = np.sqrt(np.maximum(x.dot(r * r), 1e-9))
    n1 = max((y > 0).sum(), 1)
    n0 = max((y <= 0).sum(), 1)
    c = np.where(y > 0, PENALTY * len(y) / (2 * n1), PENALTY * len(y) / (2 * n0))
    w, b = dual_descent(x, r, 1 / norm, np.where(y > 0, 1.0, -1.0), c)
    w = (1 - BLEND) * np.abs(w).mean() + BLEND * w
    return r, w, b


def constant(p: float) -> Model:
    none = np.zeros(0)
    return Model(none.astype(np.int64), none, none, 0.0, 1.0, float(np.log((p + 1e-6) / (1 - p + 1e-6))))


def fit_rows(y: np.ndarray, flat: np.ndarray, at: np.ndarray) -> Model:
    """The model of labels ``y`` and of the rows' slots ``flat``, row i from
    ``at[i]`` to ``at[i + 1]``."""
    if len(y) == 0 or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    df = np.bincount(flat, minlength=1 << HASH_BITS)
    keep = np.flatnonzero((df >= min(MIN_DF, max(1, len(y) // 50))) & (df < len(y)))
    number = np.full(1 << HASH_BITS, -1, np.int32)
    number[keep] = np.arange(len(keep), dtype=np.int32)
    rows = [(lambda n: n[n >= 0])(number[flat[at[i] - at[0]: at[i + 1] - at[0]]]) for i in range(len(y))]
    fold, margin = np.arange(len(y)) % FOLDS, np.zeros(len(y))
    for f in range(FOLDS):
        tr, te = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        if y[tr].min() == y[tr].max():
            continue
        r, w, b = _solve(Rows([rows[i] for i in tr]), y[tr], len(keep))
        x = Rows([rows[i] for i in te])
        margin[te] = x.dot(r * w) / np.sqrt(np.maximum(x.dot(r * r), 1e-9)) + b
    a, off = platt(margin, y)
    r, w, b = _solve(Rows(rows), y, len(keep))
    use = np.flatnonzero(r != 0)
    return Model(keep[use].astype(np.int64), (r * w)[use], (r * r)[use], float(b), float(a), float(off))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """The sample's slots are made where its texts are read, and the model is
    solved in one task of an executor (the sample is bounded); the driver gets the
    finished arrays."""
    lab = labels.select(id_col, label_col).where(F.col(label_col).isin(0, 1))

    def run(batches):
        cache: dict = {}
        for b in batches:
            rows = [slots(indicators(t, cache)).astype(np.int32) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(rows, pa.list_(pa.int32()))], ["id", "y", "x"])

    def solve(batches):
        got = pa.Table.from_batches(list(batches), pa.schema([("id", pa.string()), ("y", pa.int32()), ("x", pa.list_(pa.int32()))])).sort_by([("id", "ascending")])
        col = got["x"].combine_chunks()
        m = fit_rows(got["y"].to_numpy().astype(np.float64), col.flatten().to_numpy(), col.offsets.to_numpy())
        yield pa.RecordBatch.from_pydict({"slots": [m.slots.astype("<i8").tobytes()], "dots": [m.dots.astype("<f8").tobytes()],
                                          "norms": [m.norms.astype("<f8").tobytes()], "rest": [[m.bias, m.a, m.b]]})

    rows = (sample_rows(docs, lab, sample, id_col, text_col).select(F.col("_id").cast("string").alias("id"), "_text", F.col(f"_{label_col}").cast("int").alias("y"))
            .mapInArrow(run, "id string, y int, x array<int>"))
    got = rows.repartition(1).mapInArrow(solve, "slots binary, dots binary, norms binary, rest array<double>").toArrow()
    if not got.num_rows:
        return constant(0.5)
    array = lambda name, kind: np.frombuffer(got[name][0].as_buffer(), kind)
    return Model(array("slots", "<i8"), array("dots", "<f8"), array("norms", "<f8"), *got["rest"][0].as_py())


def classify(docs: DataFrame, model: Model, text_col: str = "text", score_out: str = "score") -> DataFrame:
    """``docs`` with a score in [0, 1]: higher, label 1 likelier."""
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))

    def task():
        shapes, known, m = {}, {}, restore(Model, sent.value)
        weight = m.table()

        def score(texts):
            out = []
            for t in texts:
                hits = set()
                for f in indicators(t, shapes):
                    s = known.get(f)
                    if s is None:
                        if len(known) > CACHE_WORDS:
                            known.clear()
                        s = slot("\x1f".join(f))
                        s = known[f] = s if s in weight else -1
                    if s >= 0:
                        hits.add(s)
                out.append(m.score(weight, hits))
            return (out,)

        return score

    return add_columns(docs, text_col, {score_out: "double"}, task)
