"""Operator 13: spelling variants by composition of finite-state machines.

Two words are near if one inserted, deleted or replaced code point turns one into
the other; that is, if the composition of the vocabulary's acceptor, a one-edit
transducer and the acceptor again accepts the pair.

1. ``count_words``: words of whole texts, counted in each task and then by key.
2. ``partitions``: the composition's initial state is taken apart by the words'
   first symbols.  A partition is the set of words below one prefix; a prefix with
   more than ``LIMIT`` words is cut deeper, so no partition is large, whatever
   share of the vocabulary begins alike.
3. ``compose`` (one task a partition): the minimal acceptor of the partition's
   words and the composition's states ``(q, no edit, q)``, from which an edit leads
   to ``(q1, edited, q2)`` and on along equal symbols.  Pairs of states without a
   common word are remembered as dead, pairs of words are enumerated from the rest.
   It finds all pairs whose edit lies below the cut.
4. ``above_the_cut``: an edit above the cut leads to ``(q1, edited, q2)`` in two
   partitions, and what is left is equality of the remaining words: a join by the
   word without its symbol at that place.  Such a group has at most one word for
   each symbol of the alphabet and place above the cut.
5. Each word's near words are counted and the best is kept per partition before
   anything is shuffled; then forms, and roots by doubling the steps.

Every pair is found once: by its first differing place, which lies above or below
the cut for both words alike.

Defined results: null and empty texts have no words; equal texts and repeated rows
count each; a null id is written as nothing before the colon; a word without a near
word has count 0, no form and is its own root; an empty table has no rows.  Other
columns are not read.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surv.session import materialize

LETTERS = "A-Za-zÀ-ÿ"
LIMIT = 20_000                 # words of a partition
FIRST_DEPTH = 2
HELD = 200_000                 # counted words that a task holds before it hands them on


def count_words(docs: DataFrame, id_col: str, text_col: str, least_length: int, drop_every: int | None) -> DataFrame:
    """``word, n`` over all texts: maximal runs of ``LETTERS``, only A-Z lower-cased,
    of ``least_length`` code points or more.  Where ``drop_every`` divides the crc32
    of ``<id>:<run>``, the run loses its code point crc32 mod length."""
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text_col}`").alias("t")).where("t IS NOT NULL")
    runs = f"[{LETTERS}]{{{least_length},}}"

    def count(batches):
        find, held = re.compile(runs).findall, Counter()

        def out():
            r = pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return r

        for b in batches:
            for key, text in zip(b["id"], b["t"]):
                # lower-casing bytes changes A-Z alone
                words = Counter(find(text.as_buffer().to_pybytes().lower().decode()))
                if drop_every:
                    start = zlib.crc32(key.as_py().encode() + b":")
                    for w, n in words.items():
                        h = zlib.crc32(w.encode(), start)
                        if h % drop_every == 0:
                            i = h % len(w)
                            w = w[:i] + w[i + 1:]
                            if len(w) < least_length:
                                continue
                        held[w] += n
                else:
                    held.update(words)
                if len(held) >= HELD:
                    yield out()
        if held:
            yield out()

    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def partitions(words: DataFrame, limit: int) -> DataFrame:
    """``words`` plus ``cut``, the prefix of the word's partition, and ``depth``, the
    length it was cut at (more than the word's, if the word ends above)."""
    done, rest, depth = [], words, FIRST_DEPTH
    while True:
        rest = rest.withColumn("cut", F.substring("word", 1, depth))
        hot = materialize(rest.groupBy("cut").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select("cut"), "hot-prefixes")
        if hot.isEmpty():
            done.append(rest.withColumn("depth", F.lit(depth)))
            break
        # at most one prefix for each LIMIT words
        done.append(rest.join(F.broadcast(hot), "cut", "left_anti").select(*rest.columns, F.lit(depth).alias("depth")))
        rest = materialize(rest.join(F.broadcast(hot), "cut", "left_semi").select(*words.columns), "hot-words")
        depth = max(depth + 1, depth * 3 // 2)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


class Acceptor:
    """The minimal acyclic automaton of a sorted list of distinct words; states are
    numbers, ``next[q]`` maps symbols to states, ``final`` are accepting states."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.final: set[int] = set()
        known: dict[tuple, int] = {}
        path = [0]                         # states of the last word, not yet settled

        def settle(keep: int) -> None:
            while len(path) > keep + 1:
                q = path.pop()
                key = (q in self.final, *self.next[q].items())
                same = known.setdefault(key, q)
                if same != q:
                    parent = self.next[path[-1]]
                    parent[next(reversed(parent))] = same
                    self.next[q] = {}
                    self.final.discard(q)

        last = ""
        for w in words:
            same = 0
            while same < len(last) and same < len(w) and last[same] == w[same]:
                same += 1
            settle(same)
            for c in w[same:]:
                self.next.append({})
                self.next[path[-1]][c] = len(self.next) - 1
                path.append(len(self.next) - 1)
            self.final.add(path[-1])
            last = w
        settle(0)


class Composition:
    """Acceptor, one-edit transducer, acceptor; ``pairs`` are the accepted pairs."""

    def __init__(self, words: list[str]):
        self.a = Acceptor(words)
        self.live: dict[tuple[int, int], bool] = {}
        self.edits: dict[int, list[tuple]] = {}

    def common(self, p: int, q: int) -> bool:
        """Whether the state (p, edited, q) accepts anything."""
        if p == q:
            return True
        key = (p, q) if p < q else (q, p)
        known = self.live.get(key)
        if known is None:
            known = p in self.a.final and q in self.a.final
            if not known:
                x, y = self.a.next[p], self.a.next[q]
                if len(x) > len(y):
                    x, y = y, x
                for c, r in x.items():
                    if c in y and self.common(r, y[c]):
                        known = True
                        break
            self.live[key] = known
        return known

    def edits_at(self, q: int) -> list[tuple]:
        """Edits from (q, no edit, q) that lead to an accepted pair, as
        ``(symbol, state, other symbol or '', other state)``.  An inserted symbol
        may not be followed by itself, so that each pair has one place."""
        known = self.edits.get(q)
        if known is None:
            known, out = [], list(self.a.next[q].items())
            for i, (c, r) in enumerate(out):
                if self.starts(r, q, c):
                    known.append((c, r, "", q))
                for d, s in out[i + 1:]:
                    if self.common(r, s):
                        known.append((c, r, d, s))
            self.edits[q] = known
        return known

    def starts(self, r: int, q: int, banned: str) -> bool:
        if r in self.a.final and q in self.a.final:
            return True
        x, y = self.a.next[r], self.a.next[q]
        for c, s in x.items():
            if c != banned and c in y and self.common(s, y[c]):
                return True
        return False

    def fruitful(self, q: int, known: dict[int, bool]) -> bool:
        """Whether any pair is accepted from (q, no edit, q)."""
        if q not in known:
            known[q] = bool(self.edits_at(q))
            for r in self.a.next[q].values():
                known[q] |= self.fruitful(r, known)
        return known[q]

    def rests(self, p: int, q: int, banned: str, tail: list[str], found) -> None:
        """Calls ``found`` with every word that (p, edited, q) accepts."""
        if p in self.a.final and q in self.a.final:
            found("".join(tail))
        y = self.a.next[q]
        for c, r in self.a.next[p].items():
            if c != banned and c in y and self.common(r, y[c]):
                tail.append(c)
                self.rests(r, y[c], "", tail, found)
                tail.pop()

    def pairs(self, found) -> None:
        """Calls ``found`` with every accepted pair, once."""
        known: dict[int, bool] = {}
        path: list[str] = []

        def visit(q: int) -> None:
            if not self.fruitful(q, known):
                return
            head = "".join(path) if self.edits_at(q) else ""
            for c, r, d, s in self.edits_at(q):
                x, y = head + c, head + d
                self.rests(r, s, "" if d else c, [], lambda t, x=x, y=y: found(x + t, y + t))
            for c, r in self.a.next[q].items():
                path.append(c)
                visit(r)
                path.pop()

        visit(0)


def compose(words: list[str], counts: list[int]) -> dict[str, tuple[int, int, str]]:
    """Per word with a near word in this list: how many, and the most frequent
    (the smallest of equals) with its count."""
    count, out = dict(zip(words, counts)), {}

    def better(x: str, y: str) -> None:
        n, top, form = out.get(x, (0, 0, ""))
        k = count[y]
        out[x] = (n + 1, k, y) if k > top or (k == top and y < form) else (n + 1, top, form)

    def found(x: str, y: str) -> None:
        better(x, y)
        better(y, x)

    # the machines are walked by recursion, one frame a symbol
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 3 * max(map(len, words), default=0) + 1000))
    try:
        Composition(sorted(words)).pairs(found)
    finally:
        sys.setrecursionlimit(limit)
    return out


NEAR = "word string, near long, form_n long, form string"


def below_the_cut(parts: DataFrame) -> DataFrame:
    """Near words of each partition by composition."""
    def task(t: pa.Table) -> pa.Table:
        cut = t["cut"][0].as_py()
        out = compose([w[len(cut):] for w in t["word"].to_pylist()], t["n"].to_pylist()) if t.num_rows > 1 else {}
        return pa.table({"word": pa.array([cut + w for w in out], pa.string()), "near": pa.array([x[0] for x in out.values()], pa.int64()),
                         "form_n": pa.array([x[1] for x in out.values()], pa.int64()), "form": pa.array([cut + x[2] for x in out.values()], pa.string())})

    return parts.where("char_length(word) >= depth").select("cut", "word", "n").groupBy("cut").applyInArrow(lambda t: task(t), NEAR)


def above_the_cut(parts: DataFrame) -> DataFrame:
    """Near words whose edit lies above the cut, by the word without that symbol.

    ``at`` is the place of the missing symbol, -1 for the whole word; ``last`` says
    that the symbol is not followed by itself (the one place of an insertion)."""
    places = F.expr("sequence(0, least(depth, char_length(word)) - 1)")
    less = F.transform(places, lambda i: F.struct(
        F.concat(F.substring(F.col("word"), F.lit(1), i), F.substring(F.col("word"), i + 2, F.char_length("word"))).alias("key"), i.alias("at"),
        (F.substring(F.col("word"), i + 1, F.lit(1)) != F.substring(F.col("word"), i + 2, F.lit(1))).alias("last")))
    whole = F.array(F.struct(F.col("word").alias("key"), F.lit(-1).alias("at"), F.lit(True).alias("last")))
    keys = parts.select("word", "n", F.explode(F.concat(whole, less)).alias("k")).select("k.*", (-F.col("n")).alias("neg"), "word")
    groups = keys.groupBy("key").agg(F.collect_list(F.struct("at", "last", "neg", "word")).alias("all")).where("size(all) > 1")
    each = groups.select("all", F.explode("all").alias("x"))
    near = F.expr("""filter(all, y -> y.word <> x.word AND ((x.at >= 0 AND y.at = x.at) OR (x.at = -1 AND y.at >= 0 AND y.last)
                                                              OR (x.at >= 0 AND x.last AND y.at = -1)))""")
    each = each.select(F.col("x.word").alias("word"), F.transform(near, lambda y: F.struct(y.neg, y.word)).alias("near")).where("size(near) > 0")
    return each.select("word", F.size("near").cast("long").alias("near"), F.array_min("near").alias("best")).select(
        "word", "near", (-F.col("best.neg")).alias("form_n"), F.col("best.word").alias("form"))


def forms(words: DataFrame, times: int = 10, limit: int = LIMIT) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for every row of ``words(word, n)``."""
    words = materialize(words, "words")
    parts = materialize(partitions(words, limit), "parts")
    near = (below_the_cut(parts).unionByName(above_the_cut(parts)).groupBy("word")
            .agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("neg"), "form")).alias("best")))
    enough = -F.col("best.neg") >= times * F.col("n")
    out = materialize(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.form")).alias("form"),
        F.when(enough, -F.col("best.neg")).alias("form_n")), "forms")
    # each round doubles the steps taken; counts grow times-fold a step, so rounds are few
    steps = out.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        longer = materialize(steps.join(steps.select(F.col("word").alias("root"), F.col("root").alias("_next")), "root", "left")
                             .select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_more")), "roots")
        steps = longer.select("word", "root")
        if longer.where("_more").isEmpty():
            break
    return out.join(steps, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_count: int = 2, times: int = 10,
             drop_every: int | None = None, limit: int = LIMIT) -> DataFrame:
    """Variants of the words of all texts, see ``forms``."""
    return forms(count_words(docs, id_col, text_col, least_length, drop_every).where(F.col("n") >= least_count), times, limit)
