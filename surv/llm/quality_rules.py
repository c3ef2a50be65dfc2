"""Quality rules with thresholds learnt from the data.

Each text gives counts (words, characters, symbols, repeated lines, words in
repeated 8-word windows).  Ratios of them go into KLL quantile sketches per
(language, source); sketches merge into one per language.  A group's quantiles are
those of its own sketch and of its language's, weighed by the number of its texts
against ``PRIOR``, so a small group leans on its language and none is a case of its
own.  A fence stands where the tail opens: in the middle of the widest step between
neighbouring quantiles of the upper quarter (for short words also of the lower
one), up to the ``FARTHEST`` quantile.  No value of a fence is fixed: where the tail
is a second heap of texts, the step is the gap before it; where it thins out evenly,
the steps grow outwards and the fence is far out.  The fences are written before
they are joined with the texts, so a task that runs again sees the same ones.

Two fixed base rules hold besides: fewer than 20 words, or more than 30 % of
the words in repeated windows, fail.  Null text counts as empty.  Null language
or source form groups of their own.  Repeated rows count as they come, extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surv.llm.words import BYTE_EXACT, IS_WORD, buffers, slices, span_hash, spans, windows_of
from surv.session import materialize

WINDOW = 8
PRIOR = 50                    # texts that the language's quantiles count for
FARTHEST, STEP, STEPS = 0.995, 0.005, 49      # quantiles 0.75, 0.755, ... 0.995
ROUNDING = 1e-9               # of the weighed quantiles
SKETCH_K = 2000               # rank error about 0.2 %
# ratio: (its expression, sides)
RATIOS = {
    "symbol_rate": ("n_symbols / n_words", "upper"),
    "dup_line_rate": ("n_dup_lines / n_lines", "upper"),
    "repeat_rate": ("n_repeat_words / n_words", "upper"),
    "word_length": ("word_chars / n_words", "both"),
}
LEVELS = [round(FARTHEST - STEP * (STEPS - i), 3) for i in range(STEPS + 1)]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NOT_NL = np.ones(256, bool)
_NOT_NL[10] = False
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _per_doc(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return c[offs[1:]] - c[offs[:-1]]


def measure(column) -> dict[str, np.ndarray]:
    """Counts of every row of an Arrow string column."""
    buf, offs = buffers(column)
    out = {c: [] for c in COUNTS}
    for i, j in slices(offs):
        b, o = buf[offs[i]: offs[j]], offs[i: j + 1] - offs[i]
        st, en, first = spans(b, o)
        out["n_words"].append(np.diff(first))
        out["word_chars"].append(_per_doc(IS_WORD[b] & ((b & 0xC0) != 0x80), o))
        out["n_symbols"].append(_per_doc(_SYMBOL[b], o))
        ls, le, lfirst = spans(b, o, _NOT_NL)
        real = np.searchsorted(st, le) > np.searchsorted(st, ls)   # lines with a word
        lh = span_hash(b, ls, le, BYTE_EXACT) if len(ls) else np.zeros(0, np.uint64)
        wh = span_hash(b, st, en, BYTE_EXACT) if len(st) else np.zeros(0, np.uint64)
        win = windows_of(wh, WINDOW)
        lines, dups, reps = [], [], []
        for r in range(j - i):
            h = lh[lfirst[r]: lfirst[r + 1]][real[lfirst[r]: lfirst[r + 1]]]
            lines.append(len(h))
            dups.append(len(h) - len(np.unique(h)))
            a, z = int(first[r]), int(first[r + 1])
            n = 0
            if z - a > WINDOW:
                w = win[a: z - WINDOW + 1]
                o_ = np.argsort(w, kind="stable")
                same = w[o_][1:] == w[o_][:-1]
                if same.any():
                    hit = np.zeros(len(w), bool)
                    hit[o_[1:][same]] = True
                    hit[o_[:-1][same]] = True
                    edge = np.zeros(z - a + 1, np.int64)
                    p = np.flatnonzero(hit)
                    np.add.at(edge, p, 1)
                    np.add.at(edge, p + WINDOW, -1)
                    n = int((np.cumsum(edge) > 0).sum())
            reps.append(n)
        out["n_lines"].append(lines), out["n_dup_lines"].append(dups), out["n_repeat_words"].append(reps)
    return {c: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for c, v in out.items()}


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: tuple = ("lang", "source")) -> DataFrame:
    d = docs.select(F.col(f"`{id_col}`").alias("_id"), *[F.col(f"`{c}`").cast("string").alias(f"_g{i}") for i, c in enumerate(by)], F.col(f"`{text_col}`").alias("_t"))
    k = len(by) + 1

    def run(batches):
        for b in batches:
            m = measure(b.column(k))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(k)] + [pa.array(m[c]) for c in COUNTS], b.schema.names[:k] + COUNTS)

    return d.mapInArrow(run, f"_id {d.schema['_id'].dataType.simpleString()}, " + ", ".join(f"_g{i} string" for i in range(len(by))) + ", " + ", ".join(f"{c} long" for c in COUNTS))


def opening(q: Column) -> Column:
    """The middle of the widest step of an ascending array (of equals the last)."""
    steps = F.transform(F.sequence(F.lit(0), F.size(q) - 2), lambda i: F.struct((F.get(q, i + 1) - F.get(q, i)).alias("d"), i.alias("i")))
    i = F.array_max(steps)["i"]
    return (F.get(q, i) + F.get(q, i + 1)) / 2


def fences(c: DataFrame, groups: list[str]) -> DataFrame:
    """Bounds per group: one row for each combination of the group columns."""
    ok = c.where("n_words > 0").select(*groups, *[F.expr(e).cast("double").alias(n) for n, (e, _) in RATIOS.items()])
    fine = ok.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"), *[F.kll_sketch_agg_double(n, SKETCH_K).alias(n) for n in RATIOS])
    fine = materialize(fine, "sketches")
    mid = fine.groupBy(groups[0]).agg(*[F.kll_merge_agg_double(n, SKETCH_K).alias(f"{n}_1") for n in RATIOS])
    j = fine.join(mid.withColumnRenamed(groups[0], "_m"), F.col(groups[0]).eqNullSafe(F.col("_m")))

    def quantiles(name: str, levels: list[float]) -> Column:
        own, wide = (F.kll_sketch_get_quantile_double(F.col(x), F.array(*[F.lit(v) for v in levels])) for x in (name, f"{name}_1"))
        return F.zip_with(own, wide, lambda a, b: (F.col("_n") * a + PRIOR * b) / (F.col("_n") + PRIOR))

    low = [round(1 - v, 3) for v in LEVELS]
    qs = [quantiles(n, LEVELS).alias(f"{n}_up") for n in RATIOS] + [F.transform(quantiles(n, low), lambda v: -v).alias(f"{n}_low") for n, (_, side) in RATIOS.items() if side == "both"]
    j = j.select(*groups, "_n", *qs)
    return j.select(*groups, "_n", *[opening(F.col(f"{n}_up")).alias(f"{n}_max") for n in RATIOS],
                    *[(-opening(F.col(f"{n}_low")) if side == "both" else F.lit(None).cast("double")).alias(f"{n}_min") for n, (_, side) in RATIOS.items()])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: tuple = ("lang", "source")) -> DataFrame:
    """Per row: id, counts, ratios, ``base_failed``, ``kept`` and the list of
    rules that failed."""
    c = materialize(counts(docs, id_col, text_col, by), "counts")
    groups = [f"_g{i}" for i in range(len(by))]
    f = materialize(fences(c, groups), "fences")
    keyed = f.select(*[F.col(g).alias(f"_f{g}") for g in groups], *[x for x in f.columns if x not in groups])
    cond = None
    for g in groups:
        e = F.col(g).eqNullSafe(F.col(f"_f{g}"))
        cond = e if cond is None else cond & e
    j = c.join(keyed, cond, "left")
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rules = [F.when(base, F.lit("base"))]
    for n, (e, _) in RATIOS.items():
        v = F.when(F.col("n_words") > 0, F.expr(e).cast("double"))
        j = j.withColumn(n, v)
        rules.append(F.when((F.col(n) > F.col(f"{n}_max") + ROUNDING) | (F.col(n) < F.col(f"{n}_min") - ROUNDING), F.lit(n)))
    failed = F.array_compact(F.array(*rules))
    return j.select(F.col("_id").alias(id_col), *COUNTS, *RATIOS, base.alias("base_failed"), (F.size(failed) == 0).alias("kept"), failed.alias("failed_rules"))
