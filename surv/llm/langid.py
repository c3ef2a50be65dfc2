"""Language identification by cross-parsing entropy.

Per language a suffix automaton is built over a bounded sample of labelled
text.  A text is parsed from left to right into the longest phrases that occur
in the sample (a letter that never occurs is a phrase alone); with ``c``
phrases over ``n`` symbols and a sample of ``N`` symbols the text costs about
``c * log2(N) / n`` bits a symbol.  The language with the lowest cost wins.

The automata become transition tables, so that thousands of texts are parsed
side by side with array operations: on a missing transition the phrase count
goes up and the parse starts again with the same symbol.  Texts are parsed in
blocks of ``BLOCK`` symbols (the parse starts anew at each), so a very long
text is many rows of that array, not one.

Symbols: lower-cased letters; every run of other characters is one space.
Null or letterless texts give ``und`` with score 0.  Rows with a null language
teach nothing.  Without any labelled text every text is ``und``.  Ties go to
the first language in alphabetical order.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surv.llm.rows import add_columns, restore
from surv.llm.words import Cache

SAMPLE_CHARS = 24_000    # labelled text per language (the fit's bound)
PIECE = 400              # characters of a piece of labelled text
BLOCK = 400              # symbols parsed from one start
LANES = 16_384           # blocks parsed side by side
_SEEN = Cache()


def _letters() -> np.ndarray:
    if "l" not in _SEEN:
        _SEEN["l"] = np.array([chr(i).isalpha() for i in range(0x110000)], bool)
    return _SEEN["l"]


def symbols(text: str) -> np.ndarray:
    """Code points of the lower-cased text; each run of non-letters is one 32."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    let = _letters()[cp]
    keep = let.copy()
    keep[1:] |= let[:-1]  # the first of a run of non-letters
    out = np.where(let, cp, np.uint32(32))
    return out[keep]


class Automaton:
    """Suffix automaton of a symbol sequence."""

    def __init__(self, seq):
        nxt, link, length, last = [{}], [-1], [0], 0
        for c in seq:
            cur = len(nxt)
            nxt.append({}), link.append(0), length.append(length[last] + 1)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    cl = len(nxt)
                    nxt.append(dict(nxt[q])), link.append(link[q]), length.append(length[p] + 1)
                    while p != -1 and nxt[p].get(c) == q:
                        nxt[p][c] = cl
                        p = link[p]
                    link[q] = link[cur] = cl
            last = cur
        self.nxt = nxt

    def phrases(self, seq) -> int:
        """Number of phrases of the greedy longest-match parse."""
        state, n = 0, 0
        for c in seq:
            to = self.nxt[state].get(c)
            if to is None:
                n += state != 0
                to = self.nxt[0].get(c)
                if to is None:
                    n += 1
                    to = 0
            state = to
        return n + (state != 0)

    def edges(self) -> np.ndarray:
        return np.array([(s, c, t) for s, d in enumerate(self.nxt) for c, t in d.items()], np.int32).reshape(-1, 3)


class Model:
    """Languages, their automata as edge lists, and the alphabet."""

    def __init__(self, samples: dict[str, np.ndarray]):
        self.langs = sorted(samples)
        self.bits = np.array([np.log2(max(len(samples[k]), 2)) for k in self.langs])
        self.alphabet = np.unique(np.concatenate([samples[k] for k in self.langs])) if samples else np.zeros(0, np.uint32)
        self.edges = []
        for k in self.langs:
            self.edges.append(Automaton(np.searchsorted(self.alphabet, samples[k]).tolist()).edges())

    def tables(self):
        """Per language a flat table ``state * width + symbol``.  Entries: the
        next state times width; a phrase that ends is marked by the sign, its
        restart state encoded as ``~value``.  Two extra symbols: unknown letter
        and padding; the padding symbol ends an open phrase and rests in the
        root."""
        out, a = [], len(self.alphabet) + 2
        for e in self.edges:
            n = int(e[:, [0, 2]].max()) + 1 if len(e) else 1
            root = np.zeros(a, np.int32)            # state after restarting with the symbol
            e0 = e[e[:, 0] == 0]
            root[e0[:, 1]] = e0[:, 2] * a
            t = np.repeat(~root[None, :], n, axis=0)  # missing: end of a phrase, restart
            t[e[:, 0], e[:, 1]] = e[:, 2] * a
            # from the root a missing symbol is a phrase alone (counted once);
            # from elsewhere it also ends the open phrase: counted below
            t[0, a - 1] = 0
            out.append((t.reshape(-1), a, (root == 0)))
        return out


def parse_counts(model: Model, tables, texts: list[np.ndarray]) -> np.ndarray:
    """Phrases of each text (symbol codes) under each language."""
    a = len(model.alphabet) + 2
    owner, rows = [], []
    for i, s in enumerate(texts):
        for k in range(0, len(s), BLOCK):
            owner.append(i), rows.append(s[k: k + BLOCK])
    out = np.zeros((len(texts), len(model.langs)), np.int64)
    order = sorted(range(len(rows)), key=lambda r: -len(rows[r]))
    for g in range(0, len(order), LANES):
        part = order[g: g + LANES]
        width = len(rows[part[0]])
        grid = np.full((width + 1, len(part)), a - 1, np.int32)   # a padding symbol ends the last phrase
        for c, r in enumerate(part):
            grid[: len(rows[r]), c] = rows[r]
        lens = np.array([len(rows[r]) for r in part])
        live = np.searchsorted(-lens, -np.arange(1, width + 1), side="right")  # lanes longer than the step
        who = np.array([owner[r] for r in part])
        for li, (t, _, alone) in enumerate(tables):
            state, count = np.zeros(len(part), np.int32), np.zeros(len(part), np.int32)
            for step in range(width + 1):
                m = live[step - 1] if step else len(part)
                sym = grid[step, :m]
                was = state[:m]
                v = t[was + sym]
                end = v < 0
                # an open phrase ends; a symbol unknown to the sample is one more
                count[:m] += end & (was != 0)
                count[:m] += end & alone[sym] & (sym != a - 1)
                state[:m] = np.where(end, ~v, v)
            np.add.at(out[:, li], who, count)
    return out


def predict(model: Model, tables, texts: list[str | None]) -> tuple[list[str], list[float]]:
    known = model.alphabet
    codes = []
    for t in texts:
        s = symbols(t) if t else np.zeros(0, np.uint32)
        if len(s) and (s != 32).any() and len(known):
            i = np.minimum(np.searchsorted(known, s), len(known) - 1)
            codes.append(np.where(known[i] == s, i, len(known)).astype(np.int32))
        else:
            codes.append(np.zeros(0, np.int32))
    counts = parse_counts(model, tables, codes)
    lang, score = [], []
    for c, row in zip(codes, counts):
        if not len(c):
            lang.append("und"), score.append(0.0)
            continue
        bits = row * model.bits
        k = int(np.argmin(bits))
        # posterior of the winner if each text cost is a code length, tempered
        # by half for dependent phrases
        lang.append(model.langs[k]), score.append(float(1 / np.exp2(np.clip((bits[k] - bits) / 2, -60, 0)).sum()))
    return lang, score


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample_chars: int = SAMPLE_CHARS) -> Model:
    """Learn from ``labelled``.  Texts are cut into pieces of ``PIECE`` characters;
    per language these are taken in the order of a hash of (id, text, place)
    until ``sample_chars`` symbols are reached.  Only pieces under a hash bound
    that holds about four times that amount come to the driver, runs without a
    letter as one space; for a language that comes short the bound widens until
    the sample is full or all its pieces are read."""
    d = labelled.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"),
                        F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("h")).where("lang IS NOT NULL AND length(text) > 0")
    sums = {r.lang: r.n for r in d.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()}
    share = {k: min(1.0, 4.0 * sample_chars / n) for k, n in sums.items()}
    picked = {}
    while share:
        # pieces under a hash bound per language, in one pass
        top = {k: min((1 << 63) - 1, int(-(1 << 63) + x * ((1 << 64) - 1))) for k, x in share.items()}
        bound = F.create_map(*[F.lit(x) for kv in top.items() for x in kv])
        some = d.select("lang", "text", "h", F.floor((F.length("text") - 1) / PIECE).cast("int").alias("last"), bound[F.col("lang")].alias("top")).where("top IS NOT NULL")
        places = F.filter(F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.struct(i.alias("i"), F.xxhash64("h", i).alias("k"))), lambda x: x["k"] <= F.col("top"))
        some = some.select("lang", "text", F.explode(places).alias("x"))
        piece = F.regexp_replace(F.substring("text", F.col("x.i") * PIECE + 1, F.lit(PIECE)), r"[\s\p{N}\p{P}\p{S}]+", " ")
        by: dict[str, list] = {}
        for r in some.select("lang", F.col("x.k").alias("k"), piece.alias("piece")).where("piece <> ' '").distinct().coalesce(4).toLocalIterator():      # a job for each partition
            by.setdefault(r.lang, []).append((r.k, r.piece))
        wider = {}
        for lang, x in share.items():
            got, have = [], 0
            for _, text in sorted(by.get(lang, [])):
                got.append(symbols(text))
                have += len(got[-1])
                if have >= sample_chars:
                    break
            if have < sample_chars and x < 1:
                wider[lang] = min(1.0, 8 * x)
            elif any((s != 32).any() for s in got):
                picked[lang] = np.concatenate(got)[:sample_chars]
        share = wider
    return Model(picked)


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score."""
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))

    def task():
        m = restore(Model, sent.value)
        tables = m.tables()
        return lambda texts: predict(m, tables, texts)

    return add_columns(docs, text_col, {lang_out: "string", score_out: "double"}, task)
