"""Operator 12: byte-level BPE encoding and decoding as a monoid tree reduction.

Encodings of byte strings form a monoid: the product of enc(A) and enc(B) is
enc(AB).  A piece (one match of the pattern) is encoded by halves:

* ``merge``: at most ``LEAF`` bytes are merged directly, the pair of lowest rank
  first, the leftmost of equals;
* ``join``: the tokens of two neighbours are put side by side.  If the two tokens
  at the seam stay apart when encoded alone, the whole is the encoding.  Else a
  window around the seam is encoded anew and doubles, on the sides that are not
  yet stable, until its first and last token stay apart from the tokens outside
  (or no token is left there).

Why that is exact: take tokens whose neighbours stay apart pairwise, and the first
merge of the whole run that would cross a seam between two of them.  Before it, the
merges inside these two tokens are, in the same order, those of the run on the two
alone, so that run would make the crossing merge too; but there they stay apart.
Hence no merge crosses a seam, and each token is what its own bytes merge to.

A text is the product of its pieces.  A piece that is a token as a whole takes that
token's id, as the reference library does.  Decoding is the product of the tokens'
bytes, joined by halves in the same way.

Workers remember the encodings of short pieces (a bounded memory, emptied when full);
long pieces, of any length, cost n log n.  Texts are whole and never leave their
row; nothing is shuffled.

Defined results: a null or empty text has no tokens and decodes to no bytes; equal
texts get equal ids; lone surrogates cannot occur in Spark's strings.  Other columns
pass through, also with clashing names.
"""

from __future__ import annotations

import base64
import heapq
import sys
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surv.llm.rows import bounded_batches
from surv.llm.words import buffers, slices

LEAF = 16
NEVER = 1 << 62                # rank of a pair that is no token
REMEMBERED_BYTES = 48          # longer pieces are not remembered
REMEMBERED = 1 << 19           # pieces, in each Python worker


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Encoding and decoding of byte strings by one table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.apart: dict[tuple[int, int], bool] = {}
        self.pieces = Pieces(self)

    def __reduce__(self):
        return Encoder, (self.ranks,)      # what it remembers stays behind

    def merge(self, data: bytes) -> list[int]:
        """Ids of a short byte string by merging its lowest-ranked pair, over and over."""
        get = self.ranks.get
        parts = [data[i: i + 1] for i in range(len(data))]
        pairs = [get(data[i: i + 2], NEVER) for i in range(len(data) - 1)]
        while pairs and (best := min(pairs)) < NEVER:
            i = pairs.index(best)
            del pairs[i]
            parts[i] += parts.pop(i + 1)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], NEVER)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], NEVER)
        return [self.ranks[p] for p in parts]

    def merge_long(self, data: bytes) -> list[int]:
        """``merge`` of a long byte string: a heap of pairs over linked parts."""
        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))        # a part is data[i:end[i]]; 0: merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i: i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue                    # one of the two has changed since
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i: end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            p = before[i]
            if p >= 0 and (r := ranks.get(data[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i: end[i]]])
            i = end[i]
        return out

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether two tokens side by side are encoded as these two."""
        known = self.apart.get((a, b))
        if known is None:
            if len(self.apart) >= REMEMBERED:
                self.apart.clear()
            known = self.apart[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def join(self, left: array, right: array) -> array:
        """The encoding of two neighbours' bytes together."""
        if not left or not right:
            return left + right
        if self.stay_apart(left[-1], right[0]):
            left.extend(right)
            return left
        i, j = min(2, len(left)), min(2, len(right))
        while True:
            window = b"".join([self.bytes_of[t] for t in left[len(left) - i:]] + [self.bytes_of[t] for t in right[:j]])
            tokens = self.merge(window) if len(window) <= 64 else self.merge_long(window)
            left_ok = i == len(left) or self.stay_apart(left[len(left) - i - 1], tokens[0])
            right_ok = j == len(right) or self.stay_apart(tokens[-1], right[j])
            if left_ok and right_ok:
                break
            i = i if left_ok else min(2 * i, len(left))
            j = j if right_ok else min(2 * j, len(right))
        out = left[: len(left) - i]
        out.extend(tokens)
        out.extend(right[j:])
        return out

    def encode(self, data: bytes) -> array:
        """Ids of a byte string, by halves (the first a power of two of leaves,
        so that seams of long runs fall on their period more often)."""
        if len(data) <= LEAF:
            return array("I", self.merge(data))
        half = LEAF << (((len(data) - 1) // LEAF).bit_length() - 1)
        return self.join(self.encode(data[:half]), self.encode(data[half:]))

    def encode_piece(self, piece: bytes) -> array:
        whole = self.ranks.get(piece)
        return self.encode(piece) if whole is None else array("I", [whole])

    def decode(self, ids) -> bytes:
        """Bytes of a token sequence, joined by halves."""
        if len(ids) <= 4096:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class Pieces(dict):
    """Little-endian ids of pieces, encoded when first met."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        ids = self.encoder.encode_piece(data)
        if sys.byteorder != "little":
            ids.byteswap()
        ids = ids.tobytes()
        if len(data) <= REMEMBERED_BYTES:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


def _task(docs: DataFrame, read: list[str], new: list[str], make):
    """``docs`` plus binary columns ``new`` from the columns ``read``, a few MB of
    rows at a time; ``make()`` gives the function of a task."""
    bounded_batches(docs.sparkSession)
    cols = [c for c in docs.columns if c not in new]
    kept = docs.select(*[F.col(f"`{c}`") for c in cols])
    at = [cols.index(c) for c in read]
    plain = [f"c{i}" for i in range(len(cols) + len(new))]

    def run(batches):
        f = make()
        for b in batches:
            size = b.column(at[0])
            _, off = buffers(size)
            for i, j in slices(off):
                part = b.slice(i, j - i)
                out = f(*[part.column(k).to_pylist() for k in at])
                yield pa.RecordBatch.from_arrays(list(part.columns) + [pa.array(x, pa.binary()) for x in out], plain)

    types = [f.dataType for f in kept.schema.fields] + [T.BinaryType()] * len(new)
    schema = T.StructType([T.StructField(n, t) for n, t in zip(plain, types)])
    return kept.toDF(*plain[: len(cols)]).mapInArrow(run, schema).toDF(*cols, *new)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", ids_out: str = "ids") -> DataFrame:
    """``docs`` plus the token ids of its texts as little-endian unsigned 32-bit
    integers (binary: four bytes a token)."""
    encoder = docs.sparkSession.sparkContext.broadcast(Encoder(ranks))

    def make():
        find, pieces = regex.compile(pattern).findall, encoder.value.pieces
        return lambda texts: ([b"".join(map(pieces.__getitem__, find(t))) if t else b"" for t in texts],)

    return _task(docs, [text_col], [ids_out], make)


def decode(docs: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", bytes_out: str = "decoded") -> DataFrame:
    """``docs`` plus the bytes that its token ids stand for (null ids: none)."""
    encoder = docs.sparkSession.sparkContext.broadcast(Encoder(ranks))

    def make():
        return lambda ids: ([encoder.value.decode(np.frombuffer(x, "<u4").tolist()) if x else b"" for x in ids],)

    return _task(docs, [ids_col], [bytes_out], make)
