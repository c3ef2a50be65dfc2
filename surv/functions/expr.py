"""Scalar functions as pure ``Column -> Column`` builders.

All are built-in Spark expressions, so they stay inside whole-stage codegen
and are evaluated on executors; no Python runs per row.
"""

from __future__ import annotations

from typing import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from surv.functions import codes as K

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- I01 / I02 / I17 date parts -------------------------------------------
def year_of(d: ColumnOrName) -> Column:
    """Calendar year as int."""
    return F.year(_c(d))


def month_of(d: ColumnOrName) -> Column:
    """Calendar month as int."""
    return F.month(_c(d))


def month_start(d: ColumnOrName) -> Column:
    """First day of the month, as a DATE (``trunc``, not ``date_trunc``)."""
    return F.trunc(_c(d), "MM")


def shift_months(d: ColumnOrName, n: int | Column) -> Column:
    """Month arithmetic."""
    return F.add_months(_c(d), n)


def days_between(later: ColumnOrName, earlier: ColumnOrName) -> Column:
    """I16: whole days from ``earlier`` to ``later``."""
    return F.datediff(_c(later), _c(earlier))


# ---- I03 blank-to-sentinel --------------------------------------------------
def blank_to_null(x: ColumnOrName) -> Column:
    """``NULLIF(TRIM(x), '')`` (SQL trim: spaces only)."""
    return F.nullif(F.trim(_c(x)), F.lit(""))


def ni(x: ColumnOrName, default: str = K.NI) -> Column:
    """``COALESCE(NULLIF(TRIM(x), ''), 'NI')``."""
    return F.coalesce(blank_to_null(x), F.lit(default))


# ---- I04 place code ---------------------------------------------------------
def is_all_digits(x: ColumnOrName) -> Column:
    # \z, not $: Java's $ also matches before a trailing newline (trap T6)
    return _c(x).rlike(r"^[0-9]+\z")


def place_code6(x: ColumnOrName) -> Column:
    """All-digit text to a 6-digit code; 7+ digits cut, shorter padded;
    anything else NULL."""
    x = _c(x)
    return (F.when(is_all_digits(x),
                   F.when(F.length(x) >= 7, F.substring(x, 1, 6))
                    .when(F.length(x) == 6, x)
                    .otherwise(F.lpad(x, 6, "0"))))


# ---- I05 / I06 facility -----------------------------------------------------
def facility_key(x: ColumnOrName) -> Column:
    """Blank to '0', keep digits, pad/cut to 7 (lpad cuts, trap T7)."""
    base = F.coalesce(blank_to_null(x), F.lit("0"))
    return F.lpad(F.regexp_replace(base, "[^0-9]", ""), 7, "0")


def first_nonblank(*cols: ColumnOrName, default: str | None = "") -> Column:
    """First non-blank (trimmed) text, else ``default``."""
    parts = [blank_to_null(c) for c in cols]
    if default is not None:
        parts.append(F.lit(default))
    return F.coalesce(*parts)


# ---- I07 epidemiological week ----------------------------------------------
def epi_week(x: ColumnOrName) -> Column:
    """Digits only, pad/cut to 6, last two digits as int (NULL stays NULL)."""
    x = _c(x)
    digits = F.regexp_replace(x.cast("string"), "[^0-9]", "")
    return F.when(x.isNotNull(), F.right(F.lpad(digits, 6, "0"), F.lit(2)).cast("int"))


# ---- I08 / I09 age ----------------------------------------------------------
def age_years(x: ColumnOrName) -> Column:
    """Coded age to years.  Unit digit first: 4 = years, 3 = months
    (floor /12), 1-2 (hours, days) = 0; anything else NULL."""
    x = _c(x).cast("string")
    rest = F.nullif(F.substring(x, 2, 1 << 20), F.lit(""))
    unit = F.substring(x, 1, 1)
    return (F.when(blank_to_null(x).isNull(), F.lit(None).cast("int"))
             .when(~is_all_digits(x), F.lit(None).cast("int"))
             .when(unit == "4", rest.try_cast("int"))
             .when(unit == "3", F.floor(rest.try_cast("double") / 12).cast("int"))
             .when(unit.isin("1", "2"), F.lit(0))
             .otherwise(F.lit(None).cast("int")))


def age_band(age: ColumnOrName) -> Column:
    """Band label of an age in years; NULL -> not informed."""
    a = _c(age)
    out = F.when(a.isNull(), F.lit(K.NOT_INFORMED_LABEL))
    for label, lo, hi in K.AGE_BANDS:
        if lo is None:
            out = out.when(a <= hi, F.lit(label))
        elif hi is None:
            out = out.otherwise(F.lit(label))
        else:
            out = out.when(a.between(lo, hi), F.lit(label))
    return out


def age_band_order(band: ColumnOrName) -> Column:
    """Explicit band order as an int sort key."""
    m = F.create_map(*[x for i, b in enumerate(K.AGE_BAND_ORDER) for x in (F.lit(b), F.lit(i))])
    return F.coalesce(m[_c(band)], F.lit(len(K.AGE_BAND_ORDER)))


def age_band_midpoint(band: ColumnOrName) -> Column:
    """Band midpoint, NULL for the unknown band."""
    m = F.create_map(*[x for b, v in K.AGE_BAND_MIDPOINT.items() for x in (F.lit(b), F.lit(v))])
    return m[_c(band)]


# ---- I10 / I11 flags --------------------------------------------------------
def death_flag(outcome: ColumnOrName, codes: Sequence[str] = K.DEATH_CODES_PROFILE,
               text_match: bool = True) -> Column:
    """Outcome code in ``codes`` or (optionally) text containing OBITO."""
    v = ni(outcome)
    cond = v.isin(*codes)
    if text_match:
        cond = cond | F.upper(v).contains(K.DEATH_TEXT)
    return cond


def yes_flag(x: ColumnOrName, accepted: Sequence[str] = K.YES_CODE) -> Column:
    """``NI(x) IN accepted`` (never NULL)."""
    return ni(x).isin(*accepted)


def as_int_flag(cond: Column) -> Column:
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


# ---- I12 classification group ----------------------------------------------
def _code_map(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])


def class_group_map() -> dict[str, str]:
    m = {c: K.CLASS_GROUP_CONFIRMED for c in K.CONFIRMED_CODES}
    m.update({c: K.CLASS_GROUP_DISCARDED for c in K.DISCARDED_CODES})
    m.update({c: K.CLASS_GROUP_INCONCLUSIVE for c in K.INCONCLUSIVE_CODES})
    return m


def class_group(code: ColumnOrName, numeric: bool = True) -> Column:
    """Classification group.

    ``numeric=True`` parses the code as a number first, so ``'01'`` and
    ``' 5 '`` count as confirmed (donut variant).  ``numeric=False`` matches
    the trimmed text (clinical-panel variant).  Trap T8.
    """
    x = _c(code)
    if numeric:
        key = F.coalesce(F.trim(x).try_cast("double"), F.lit(-1.0)).cast("bigint").cast("string")
    else:
        key = F.trim(x)
    return F.coalesce(_code_map(class_group_map())[key], F.lit(K.CLASS_GROUP_INVESTIGATION))


# ---- I13 overall exam result ------------------------------------------------
def exam_overall(results: Iterable[ColumnOrName], dates: Iterable[ColumnOrName]) -> Column:
    """Positivo > Negativo > Inconclusivo > sample only > none."""
    vals = [F.trim(_c(r)) for r in results]
    ds = [_c(d).isNotNull() for d in dates]

    def any_eq(v):
        cond = F.lit(False)
        for x in vals:
            cond = cond | F.coalesce(x == v, F.lit(False))
        return cond

    any_date = F.lit(False)
    for d in ds:
        any_date = any_date | d
    return (F.when(any_eq("1"), "Positivo")
             .when(any_eq("2"), "Negativo")
             .when(any_eq("3"), "Inconclusivo")
             .when(any_date, "Com coleta (sem resultado)")
             .otherwise("Sem exame"))


# ---- I14 / I15 ratios -------------------------------------------------------
def guarded_ratio(num: ColumnOrName, den: ColumnOrName, k: float = 1, zero: bool = False) -> Column:
    """``num / den * k`` when ``den > 0``; else NULL (SQL form) or 0.0
    (``zero=True``, the scalar-function form).  Always DOUBLE."""
    n, d = _c(num).cast("double"), _c(den).cast("double")
    r = F.when(d > 0, n / d * F.lit(float(k)))
    return F.coalesce(r, F.lit(0.0)) if zero else r


def pct_delta(cur: ColumnOrName, prev: ColumnOrName) -> Column:
    """Percent change, NULL when previous is 0 or NULL."""
    c, p = _c(cur).cast("double"), _c(prev).cast("double")
    return F.when(p.isNotNull() & (p != 0), (c - p) / p * 100.0)


def growth_pct(first: ColumnOrName, last: ColumnOrName) -> Column:
    """first-to-last growth in percent; base <= 0 gives 100 if last > 0 else 0."""
    a, b = _c(first).cast("double"), _c(last).cast("double")
    return F.when(a <= 0, F.when(b > 0, F.lit(100.0)).otherwise(F.lit(0.0))).otherwise((b - a) / a * 100.0)


# ---- I18 rounding -----------------------------------------------------------
def round_half_even_int(x: ColumnOrName) -> Column:
    """Python/pandas rounding (banker's), NULL to 0, as bigint."""
    return F.coalesce(F.bround(_c(x), 0), F.lit(0)).cast("bigint")


def round_half_up_int(x: ColumnOrName) -> Column:
    """SQL ``ROUND(x, 0)`` (half away from zero), as int."""
    return F.round(_c(x), 0).cast("int")


# ---- I19 / I20 text matching ------------------------------------------------
def starts_with(x: ColumnOrName, prefix: str) -> Column:
    return _c(x).startswith(prefix)


def ci_equals(x: ColumnOrName, value: str) -> Column:
    """Case-insensitive equality (``UPPER(a) = UPPER(b)``)."""
    return F.upper(_c(x)) == F.upper(F.lit(value))


# ---- I21 / I22 / I23 / I24 decoding ----------------------------------------
def decode(code: ColumnOrName, mapping: Mapping[str, str],
           not_informed: str = K.DECODE_NOT_INFORMED,
           fallback_prefix: str | None = K.DECODE_FALLBACK_PREFIX,
           default: str | None = None) -> Column:
    """Code to label; blank/NI to ``not_informed``; unknown code to
    ``fallback_prefix + code`` (or ``default``)."""
    t = F.trim(_c(code))
    miss = t.isNull() | (t == "") | (t == K.NI)
    fb = F.concat(F.lit(fallback_prefix), t) if fallback_prefix is not None else (
        F.lit(default) if default is not None else t)
    return F.when(miss, F.lit(not_informed)).otherwise(F.coalesce(_code_map(mapping)[t], fb))


def decode_classification(code: ColumnOrName) -> Column:
    return decode(code, K.CLASSIFICATION_LABELS)


def decode_outcome(code: ColumnOrName) -> Column:
    return decode(code, K.OUTCOME_LABELS)


def label_or(code: ColumnOrName, mapping: Mapping[str, str], default: str) -> Column:
    """Map the trimmed code, unknown -> ``default`` (sex/race labels, E43)."""
    return F.coalesce(_code_map(mapping)[F.trim(_c(code))], F.lit(default))


def label_or_self(code: ColumnOrName, mapping: Mapping[str, str]) -> Column:
    """Map the trimmed code, unknown -> the code itself."""
    t = F.trim(_c(code))
    return F.coalesce(_code_map(mapping)[t], t)


def age_display(code: ColumnOrName) -> Column:
    """Coded age to 'N unit' text; fewer than two digits -> the raw text."""
    raw = F.trim(_c(code))
    digits = F.regexp_replace(raw, "[^0-9]", "")
    unit = F.substring(digits, 1, 1)
    number = F.coalesce(F.nullif(F.substring(digits, 2, 1 << 20), F.lit("")), F.lit("0")).cast("decimal(38,0)").cast("string")
    unit_lbl = F.coalesce(_code_map(K.AGE_UNIT_LABELS)[unit], F.lit(K.AGE_UNIT_DEFAULT))
    return F.when(F.length(digits) >= 2, F.concat_ws(" ", number, unit_lbl)).otherwise(raw)


def school_display(code: ColumnOrName) -> Column:
    """Schooling text; looked up by its digits, else by the raw text."""
    raw = F.trim(_c(code))
    d = F.regexp_replace(raw, "[^0-9]", "")
    key = F.when(d != "", d).otherwise(raw)
    return F.coalesce(_code_map(K.SCHOOL_TEXT)[key], raw)


def month_label(d: ColumnOrName) -> Column:
    """I24: 'monthname/yyyy' in Portuguese."""
    names = F.array(*[F.lit(n) for n in K.MONTH_NAMES_PT])
    return F.concat(F.element_at(names, F.month(_c(d))), F.lit("/"), F.year(_c(d)).cast("string"))


# ---- I25 / I26 --------------------------------------------------------------
def join_labels(pairs: Sequence[tuple[Column, str]], sep: str = " + ",
                empty: str | None = None) -> Column:
    """Labels whose condition holds, joined by ``sep``."""
    out = F.concat_ws(sep, *[F.when(cond, F.lit(lbl)) for cond, lbl in pairs])
    return F.when(out == "", F.lit(empty)).otherwise(out) if empty is not None else out


def cut(x: ColumnOrName, width: int) -> Column:
    """Text cast and cut to ``width`` characters."""
    return F.substring(_c(x).cast("string"), 1, width)


def state_in_focus(state: ColumnOrName, codes: Sequence[str] = K.FOCUS_STATE_CODES) -> Column:
    """Normalised state in the focus set."""
    return ni(state).isin(*codes)
