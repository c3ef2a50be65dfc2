"""Words and k-gram hashes as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_KELVIN = "K"   # the one other character whose lower case is an ASCII letter


def words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text after lower-casing
    (A-Z decide; other letters' case plays no part in an ASCII phrase).
    Null text has no words."""
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(_KELVIN), F.lit("一")))
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def kgrams(w: Column, k: int, whole: bool = False) -> Column:
    """Hash of the ``k`` words from each position of the array column ``w``;
    with fewer words none, or the whole sequence as one (``whole``)."""
    n = F.size(w)
    grams = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    out = F.when(n >= k, grams)
    if whole:
        for m in range(1, k):
            out = out.when(n == m, F.array(F.xxhash64(*[F.get(w, F.lit(j)) for j in range(m)])))
    return out.otherwise(F.expr("cast(array() as array<bigint>)"))
