"""Language-model scores by logistic mixing of hashed-context bit predictors.

Tokens are words (outside ``[\\x20\\x09-\\x0D]``, A-Z lower-cased) and one end per
text.  A word is coded as its bytes and a space, the end as a line feed, each
byte as eight binary decisions, so the product of the bit probabilities is a
probability of the token sequence.

1. All tokens of the training texts are counted (``vocabulary``); the other
   texts' tokens are listed with count 0.
2. Predictors: for the contexts position, last 1, 2, 3 and 5 bytes and the whole
   beginning of the token, bit counts sit in hashed tables of fixed size, added
   up over the whole vocabulary with its counts.
3. Mixing: predictions are stretched and added with weights that a gate picks
   (how many contexts have been seen, how often the longest one, which bit).
   The weights learn online, in small steps over all training tokens with their
   whole counts, each with its own occurrence taken out of the counts.  Tokens are
   dealt by hash to mixers of a bounded number of distinct tokens each, which learn
   side by side; their weights are averaged per gate, by the decisions each has
   seen there.  A final table per gate, of all mixers' occurrences counted in the
   same pass, corrects the mixed probability.
4. Every distinct token is scored once by these spelling predictors.  The ``HOT``
   most frequent tokens go to all tasks (a fixed bound); the rest of each text's
   tokens are joined by token.  So no frequent token is shuffled and no vocabulary
   is broadcast.
5. Across words, one more decision comes before the spelling: whether the token is
   the one that followed when the last two words (else the last word) stood in this
   text before.  Its context is the number of words that said so, whether both
   agree, and how many such decisions came true in a row; the counts of each
   context come from all training texts.  If it is true, the token is coded; if
   not, the token is spelt, without the one ruled out.  The predictions are made of
   the text as it is read, so they adapt from word to word, and the order of the
   words matters.

Null texts count as empty: one end.  Repeated rows count as they come.  Without
training texts all counts are 0 and the model is the untrained predictor's.
Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surv.llm.graph import ARRAY_SCHEMA, array_rows, sum_arrays
from surv.llm.rows import restore
from surv.llm.words import buffers, mix, slices
from surv.session import materialize

END = b"\n"
ORDERS = (0, 1, 2, 3, 5, -1)            # bytes of context; -1: the whole beginning
BITS = (12, 16, 19, 20, 21, 22)            # slots of each predictor, as powers of two
HOT = 200_000                           # tokens sent to all tasks
SAMPLE = 100_000                        # distinct tokens that one mixer learns from, about; there are as many mixers as that takes
STEP_TOKENS = 256
STEP = 2.0                              # length of a step
FLUSH = 400_000
LEVELS = 33                             # columns of the final table
REACH = 12.0                            # stretched probabilities are kept within
OFTEN = np.array([1, 2, 3, 6, 16, 64, 255])   # evidence of the longest context, in classes
GATES = 6 * 8 * 8
RUNS = 16                               # decisions in a row that came true, in classes
FOLLOW = 4 * RUNS                       # contexts of the decision across words


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()         # for bytes: ASCII letters and white space only


def stretch(p):
    return np.log(p / (1 - p))


def squash(x):
    return 1 / (1 + np.exp(-np.clip(x, -REACH, REACH)))


def coded(toks: list[bytes]):
    """Bytes of all tokens with their ends, start of the token of each byte,
    and number of the token of each byte."""
    parts = [t if t == END else t + b" " for t in toks]
    b = np.frombuffer(b"".join(parts), np.uint8)
    n = np.array([len(p) for p in parts], np.int64)
    at = np.concatenate([[0], np.cumsum(n)[:-1]])
    return b, np.repeat(at, n), np.repeat(np.arange(len(parts)), n)


def contexts(b: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """One 64-bit context per byte and predictor."""
    i = np.arange(len(b))
    last = []
    for k in range(1, 6):
        j = i - k
        last.append(np.where(j >= start, b[np.maximum(j, 0)], 0).astype(np.uint64))
    out = [np.minimum(i - start, 15).astype(np.uint64)]
    acc = np.zeros(len(b), np.uint64)
    for k in range(1, 6):
        acc = (acc << np.uint64(8)) | last[k - 1]
        if k in (1, 2, 3, 5):
            out.append(acc)
    # the whole beginning: a running hash that starts anew at each token
    h = np.zeros(len(b), np.uint64)
    run = i - start
    for k in range(1, int(run.max()) + 1 if len(b) else 0):
        j = np.flatnonzero(run == k) if k < 24 else None
        if j is None:
            break
        h[j] = mix(h[j - 1] + b[j - 1].astype(np.uint64) + np.uint64(1))
    far = np.flatnonzero(run >= 24)     # long tokens: one by one, in order
    for x in far.tolist():
        h[x] = mix(h[x - 1: x] + np.uint64(int(b[x - 1]) + 1))[0]
    out.append(h)
    return out


def slots(ctx: list[np.ndarray], b: np.ndarray, j: int) -> list[np.ndarray]:
    """Table slots of bit ``j`` of every byte."""
    node = ((1 << j) | (b.astype(np.int64) >> (8 - j))).astype(np.uint64)
    out = [(ctx[0] << np.uint64(8)) | node, (ctx[1] << np.uint64(8)) | node]
    for c, bits in zip(ctx[2:], BITS[2:]):
        out.append(((c + node) * np.uint64(0x9E3779B97F4A7C15) ^ (c >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - bits))
    return [s.astype(np.int64) for s in out]


def bit(b: np.ndarray, j: int) -> np.ndarray:
    return (b >> (7 - j)) & 1


def predict(n0, n1, order):
    """Stretched prediction and evidence of counts; sharper for longer contexts."""
    d = 0.05 if order in (5, -1) else 0.1 if order in (2, 3) else 0.4
    return np.clip(np.log((n1 + d) / (n0 + d)), -REACH, REACH).astype(np.float32)


def gate(seen: list[np.ndarray], total: np.ndarray, j: int) -> np.ndarray:
    level = sum((s > 0).astype(np.int64) for s in seen)
    often = np.searchsorted(OFTEN, total, side="right")
    return (level.clip(0, 5) * 8 + often) * 8 + j


class Mixer:
    def __init__(self):
        self.w = np.full((GATES, len(ORDERS)), 0.25)
        self.w[:, -1] = 0.5
        self.t = np.tile(squash(np.linspace(-REACH, REACH, LEVELS)), (GATES, 1))
        self.seen = np.zeros(GATES)          # bits learnt from
        self.came = np.zeros((2, GATES * LEVELS))     # occurrences of the final table's cells, and of bit 1 among them

    def mixed(self, st, g):
        return np.clip((self.w[g] * st).sum(1), -REACH, REACH)

    def refined(self, x, g):
        """Probability after the final table."""
        pos = (x + REACH) / (2 * REACH) * (LEVELS - 1)
        lo = np.minimum(pos.astype(np.int64), LEVELS - 2)
        f = pos - lo
        p = 0.5 * squash(x) + 0.5 * ((1 - f) * self.t[g, lo] + f * self.t[g, lo + 1])
        return np.clip(p, 1e-6, 1 - 1e-6), lo, f

    def learn(self, st, g, y, weight, rate):
        """One online step over a few bits; the counts weigh the bits of a gate against
        each other, so that a frequent token makes no longer step."""
        x = self.mixed(st, g)
        err = (y - squash(x)) * weight
        n = np.bincount(g, minlength=GATES)
        k = n[:, None] + 1.0
        mean = (n / np.maximum(np.bincount(g, weights=weight, minlength=GATES), 1e-9))[:, None]
        step = np.column_stack([np.bincount(g, weights=err * st[:, i], minlength=GATES) for i in range(st.shape[1])])
        self.w += rate * STEP * step * mean / np.sqrt(k)
        self.seen += n
        _, lo, f = self.refined(x, g)
        for at, part in ((lo, 1 - f), (lo + 1, f)):
            cell = g * LEVELS + at
            n = np.bincount(cell, weights=part * weight, minlength=GATES * LEVELS)
            s = np.bincount(cell, weights=part * weight * y, minlength=GATES * LEVELS)
            self.came += n, s

    def settle(self):
        """The final table by the occurrences of its cells."""
        n, s = self.came.reshape(2, GATES, LEVELS)
        self.t = (s + 200.0 * self.t) / (n + 200.0)
        return self


class Model:
    """Tables as stretched predictions and evidence, and the mixer's arrays."""

    def __init__(self, st, ev, w, t):
        self.st, self.ev, self.w, self.t = st, ev, w, t

    def log10(self, toks: list[bytes]) -> np.ndarray:
        """log10 probability of each token."""
        m = Mixer.__new__(Mixer)
        m.w, m.t = self.w, self.t
        b, start, who = coded(toks)
        ctx = contexts(b, start)
        out = np.zeros(len(toks))
        for j in range(8):
            s = slots(ctx, b, j)
            st = np.stack([t[i] for t, i in zip(self.st, s)], 1).astype(np.float64)
            ev = [e[i] for e, i in zip(self.ev, s)]
            g = gate(ev[1:], ev[-1], j)
            p, _, _ = m.refined(m.mixed(st, g), g)
            y = bit(b, j)
            out += np.bincount(who, weights=np.log10(np.where(y == 1, p, 1 - p)), minlength=len(toks))
        return out


def train_mixer(tables: list[tuple[np.ndarray, np.ndarray]], toks: list[bytes], draws: np.ndarray) -> Mixer:
    m = Mixer()
    order = np.random.RandomState(17).permutation(len(toks))
    steps = -(-len(toks) // STEP_TOKENS)
    for k in range(steps):
        part = order[k * STEP_TOKENS: (k + 1) * STEP_TOKENS]
        b, start, who = coded([toks[i] for i in part])
        weight = draws[part].astype(np.float64)[who]
        ctx = contexts(b, start)
        rate = 0.01 / (1 + 4.0 * k / steps)
        sts, gs, ys = [], [], []
        for j in range(8):
            y = bit(b, j)
            st, ev = [], []
            for (n0, n1), i, o in zip(tables, slots(ctx, b, j), ORDERS):
                a0 = np.maximum(n0[i] - (y == 0), 0)     # without the occurrence itself
                a1 = np.maximum(n1[i] - (y == 1), 0)
                st.append(predict(a0, a1, o)), ev.append(a0 + a1)
            sts.append(np.stack(st, 1).astype(np.float64)), gs.append(gate(ev[1:], ev[-1], j)), ys.append(y)
        m.learn(np.concatenate(sts), np.concatenate(gs), np.concatenate(ys), np.tile(weight, 8), rate)
    return m.settle()


def last_with(key: np.ndarray) -> np.ndarray:
    """Position of the last earlier equal element of each element, or -1."""
    order = np.argsort(key, kind="stable")
    out = np.full(len(key), -1, np.int64)
    same = key[order[1:]] == key[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def follow(ids: np.ndarray):
    """For each token of a text: the token that the words before it foretell (position
    of its last occurrence after the same words, -1: none), whether it came, and the
    context of the decision."""
    n = len(ids)
    one = np.full(n, -1, np.int64)
    two = one.copy()
    if n > 1:
        at = last_with(ids[:-1])                       # token i follows word i - 1
        one[1:] = np.where(at >= 0, at + 1, -1)
    if n > 2:
        with np.errstate(over="ignore"):
            pair = ids[1:-1] * np.int64(-7046029254386353131) + ids[:-2]
        at = last_with(pair)
        two[2:] = np.where(at >= 0, at + 2, -1)
    told = np.where(two >= 0, two, one)
    came = (told >= 0) & (ids[told] == ids)
    agree = (two >= 0) & (one >= 0) & (ids[one] == ids[two])
    i = np.arange(n)
    broken = np.maximum.accumulate(np.where(came, -1, i)) if n else i      # last decision that did not come true
    run = np.concatenate([[0], (i - broken)[:-1]]) if n else i
    return told, came, ((two >= 0) * 2 + agree) * RUNS + np.minimum(run, RUNS - 1)


def follow_chances(counts: np.ndarray) -> np.ndarray:
    """Probability that a foretold token comes, per context, of counts (came, not)."""
    return (counts[:, 0] + 0.4) / (counts.sum(1) + 2.0)


def vocabulary(docs: DataFrame, training: str, text_col: str = "text") -> DataFrame:
    """``(gate, token, c)``: occurrences of every token in the training rows (gate
    null), and how often foretold tokens came or not: context times 2, plus 1 for not
    (token null)."""
    d = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{training}`").alias("train"))

    def rows(c: Counter, other: set):
        toks = list(c) + [t for t in other if t not in c]
        return pa.RecordBatch.from_pydict({"gate": pa.nulls(len(toks), pa.int32()), "token": pa.array(toks, pa.binary()), "c": pa.array([c.get(t, 0) for t in toks], pa.int64())})

    def run(batches):
        c, other, told = Counter(), set(), np.zeros(2 * FOLLOW, np.int64)
        for b in batches:
            buf, off = buffers(b.column(0))
            for train, lo, hi in zip(b.column(1).to_pylist(), off[:-1], off[1:]):
                t = tokens(buf[lo:hi].tobytes())
                if train:
                    c.update(t)
                    c[END] += 1
                    at, came, ctx = follow(np.fromiter(map(hash, [*t, END]), np.int64, len(t) + 1))
                    told += np.bincount((2 * ctx + ~came)[at >= 0], minlength=2 * FOLLOW)
                else:
                    other.update(t)
                if len(c) + len(other) > FLUSH:
                    yield rows(c, other)
                    c, other = Counter(), set()
        other.add(END)
        yield rows(c, other)
        some = np.flatnonzero(told)
        yield pa.RecordBatch.from_pydict({"gate": pa.array(some, pa.int32()), "token": pa.nulls(len(some), pa.binary()), "c": pa.array(told[some], pa.int64())})

    return d.mapInArrow(run, "gate int, token binary, c long").groupBy("gate", "token").agg(F.sum("c").alias("c"))


def learn_all(vocab: DataFrame, tables: list[tuple[np.ndarray, np.ndarray]], distinct: int, sample: int = SAMPLE) -> Mixer:
    """Mixer learnt from all training tokens of ``vocab``: mixers of about ``sample``
    distinct tokens each, dealt and ordered by the tokens alone, then averaged."""
    spark, first = vocab.sparkSession, Mixer()
    sent = spark.sparkContext.broadcast(tables)

    def one(t: pa.Table) -> pa.Table:
        got = sorted(zip(t.column("token").to_pylist(), t.column("c").to_pylist()))
        m = train_mixer(sent.value, [x for x, _ in got], np.array([c for _, c in got], np.int64))
        parts = {0: m.w * m.seen[:, None], 1: m.came, 2: m.seen}
        return pa.Table.from_batches(list(array_rows({k: v.astype(np.float32).ravel() for k, v in parts.items()})))

    groups = -(-distinct // sample) or 1
    dealt = vocab.where("c > 0").withColumn("g", F.pmod(F.xxhash64("token"), F.lit(groups))).groupBy("g")
    sums = sum_arrays(dealt.applyInArrow(lambda t: one(t), ARRAY_SCHEMA), {0: first.w.size, 1: first.came.size, 2: GATES})
    sent.destroy()
    n = sums[2].astype(np.float64)[:, None]
    first.w = np.where(n > 0, sums[0].reshape(first.w.shape) / np.maximum(n, 1), first.w)
    first.came = sums[1].reshape(first.came.shape).astype(np.float64)
    return first.settle()


def fit(vocab: DataFrame, distinct: int, sample: int = SAMPLE) -> Model:
    """Predictor tables and mixer over all of ``vocab``."""

    def count(batches):
        acc = {i: np.zeros(2 << k, np.float32) for i, k in enumerate(BITS)}
        for b in batches:
            tk, cs = b.column(0).to_pylist(), b.column(1).to_numpy()
            for a in range(0, len(tk), 20_000):
                use = [i for i in range(a, min(a + 20_000, len(tk))) if cs[i] > 0]
                if not use:
                    continue
                by, start, who = coded([tk[i] for i in use])
                weight = cs[use].astype(np.float32)[who]
                ctx = contexts(by, start)
                for j in range(8):
                    y = bit(by, j).astype(np.int64)
                    for i, s in enumerate(slots(ctx, by, j)):
                        at = 2 * s + y
                        np.add.at(acc[i], at, weight)
        yield from array_rows(acc)

    sums = sum_arrays(vocab.mapInArrow(count, ARRAY_SCHEMA), {i: 2 << k for i, k in enumerate(BITS)})
    tables = [(sums[i][0::2], sums[i][1::2]) for i in range(len(BITS))]
    m = learn_all(vocab, tables, distinct, sample)
    st = [predict(a, b, o) for (a, b), o in zip(tables, ORDERS)]
    ev = [np.minimum(a + b, 255).astype(np.uint8) for a, b in tables]
    return Model(st, ev, m.w, m.t)


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, sample: int = SAMPLE) -> DataFrame:
    """Per row: id, ``trained`` (whether the row was learnt from), ``n_bytes``,
    ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` and
    ``bits_per_byte`` of the coded tokens."""
    spark = docs.sparkSession
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    counted = materialize(vocabulary(d, "train"), "vocabulary")
    vocab = counted.where("gate IS NULL").select("token", "c")
    told = np.zeros(2 * FOLLOW, np.int64)
    for x in counted.where("gate IS NOT NULL").select("gate", "c").collect():      # at most 2 * FOLLOW numbers
        told[x.gate] = x.c
    chance = follow_chances(told.reshape(-1, 2))
    r = vocab.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    total, distinct = int(r.n or 0), int(r.v or 0)
    model = fit(vocab, distinct, sample)
    sent = spark.sparkContext.broadcast(vars(model))

    def score_tokens(batches):
        m = restore(Model, sent.value)
        for b in batches:
            tk, lp = b.column(0).to_pylist(), []
            for a in range(0, len(tk), 8_000):
                lp.append(m.log10(tk[a: a + 8_000]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(lp) if lp else np.zeros(0))], ["token", "c", "lp"])

    base = F.log10((F.col("c") + 0.5) / F.lit(total + 0.5 * (distinct + 1)))
    scored = materialize(vocab.mapInArrow(score_tokens, "token binary, c long, lp double").withColumn("base", base), "scored")
    top = scored.orderBy(F.desc("c"), "token").limit(hot).toArrow()
    known = spark.sparkContext.broadcast((top["token"].to_pylist(), top["c"].to_numpy(), top["base"].to_numpy(), top["lp"].to_numpy()))

    def read(batches):
        names, c, bs, lp = known.value
        number = {t: i for i, t in enumerate(names)}
        get = number.get
        yes, no = np.log10(chance), np.log10(1 - chance)
        ruled = -np.log10(1 - 10.0 ** np.append(lp, -np.inf))         # by index; -1, a rare token: nothing to speak of
        for b in batches:
            buf, off = buffers(b.column(1))
            for i, j in slices(off):
                out = {k: [] for k in ("n", "size", "seen", "base", "lp", "rare", "tf", "spelt")}
                for k in range(i, j):
                    tk = tokens(buf[off[k]: off[k + 1]].tobytes())
                    tk.append(END)
                    idx = np.fromiter((get(t, -1) for t in tk), np.int64, len(tk))
                    ids = idx
                    some = np.flatnonzero(idx < 0)
                    if len(some):
                        ids = idx.copy()
                        ids[some] = np.fromiter((hash(tk[x]) | -(1 << 62) for x in some), np.int64, len(some))
                    at, came, ctx = follow(ids)
                    tried = at >= 0
                    across = float(yes[ctx[came]].sum())
                    failed = tried & ~came
                    across += float(no[ctx[failed]].sum() + ruled[idx[at[failed]]].sum())
                    rare, spelt = Counter(), Counter()
                    for x in some.tolist():
                        rare[tk[x]] += 1
                        spelt[tk[x]] += not came[x]
                    hot_ones = idx >= 0
                    out["n"].append(len(tk)), out["size"].append(sum(map(len, tk)) + len(tk) - 1)
                    out["seen"].append(int((c[idx[hot_ones]] > 0).sum())), out["base"].append(float(bs[idx[hot_ones]].sum()))
                    out["lp"].append(across + float(lp[idx[hot_ones & ~came]].sum()))
                    out["rare"].append(list(rare)), out["tf"].append(list(rare.values())), out["spelt"].append([spelt[t] for t in rare])
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(3), pa.array(out["n"], pa.int64()), pa.array(out["size"], pa.int64()), pa.array(out["seen"], pa.int64()),
                     pa.array(out["base"], pa.float64()), pa.array(out["lp"], pa.float64()), pa.array(out["rare"], pa.list_(pa.binary())), pa.array(out["tf"], pa.list_(pa.int64())),
                     pa.array(out["spelt"], pa.list_(pa.int64()))],
                    ["id", "train", "row", "n", "size", "seen", "base", "lp", "rare", "tf", "spelt"])

    kind = d.schema["id"].dataType.simpleString()
    texts = materialize(d.withColumn("row", F.monotonically_increasing_id()).select("id", "text", "train", "row")
                        .mapInArrow(read, f"id {kind}, train boolean, row long, n long, size long, seen long, base double, lp double, rare array<binary>, tf array<bigint>, spelt array<bigint>"), "texts")
    rare = (texts.select("row", F.explode(F.arrays_zip("rare", "tf", "spelt")).alias("x"))
            .select("row", F.col("x.rare").alias("token"), F.col("x.tf").alias("tf"), F.col("x.spelt").alias("spelt")))
    rest = (rare.join(scored, "token").groupBy("row")
            .agg(F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("seen2"), F.sum(F.col("tf") * F.col("base")).alias("base2"), F.sum(F.col("spelt") * F.col("lp")).alias("lp2")))
    j = texts.drop("rare", "tf", "spelt").join(rest, "row", "left")
    total_lp = F.col("lp") + F.coalesce("lp2", F.lit(0.0))
    return j.select(F.col("id").alias(id_col), F.col("train").alias("trained"), F.col("size").alias("n_bytes"), F.col("n").alias("n_tokens"),
                    (F.col("seen") + F.coalesce("seen2", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
                    (F.col("base") + F.coalesce("base2", F.lit(0.0))).alias("base_score"), total_lp.alias("score"),
                    (-total_lp * F.lit(float(np.log2(10))) / F.col("size")).alias("bits_per_byte"))
