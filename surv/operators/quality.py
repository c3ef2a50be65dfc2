"""Data quality, reconciliation and validation (E35-E40, J09, K01-K03, K07,
D11-D12, H03-H04).

Checks that touch data run as single-pass aggregates; checks on schemas
(column names, types) work on ``df.schema`` metadata only.
"""

from __future__ import annotations

from typing import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surv.functions import codes as K
from surv.functions import expr as X
from surv.roles import Roles, resolve_column


# ---- K01-K03 validators ---------------------------------------------------------
class ValidationError(ValueError):
    pass


def require_not_empty(df: DataFrame) -> DataFrame:
    """Fail on an empty frame (``isEmpty`` reads one row, not a count)."""
    if df.isEmpty():
        raise ValidationError("empty DataFrame")
    return df


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    """Required minus present (metadata only)."""
    have = set(df.columns)
    return [c for c in required if c not in have]


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """Fail on missing required columns."""
    miss = missing_columns(df, required)
    if miss:
        raise ValidationError(f"missing required columns: {miss}")
    return df


def require_types(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """Type of each column must start with the expected prefix; all
    mismatches are collected before failing."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    errors = []
    for c, prefix in expected.items():
        if c not in types:
            errors.append(f"{c}: missing")
        elif not types[c].startswith(prefix):
            errors.append(f"{c}: {types[c]} is not {prefix}")
    if errors:
        raise ValidationError("; ".join(errors))
    return df


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """T17 guard: fail when ``keys`` repeat (one aggregate, a LIMIT 1 read)."""
    dup = df.groupBy(*keys).count().filter("count > 1").limit(1)
    if not dup.isEmpty():
        raise ValidationError(f"key {list(keys)} is not unique")
    return df


# ---- C14 / E35 / E36 field validity -----------------------------------------------
def validity_rules(r: Roles) -> list[tuple[str, str, str | None, Column | None]]:
    """C14: (group, field, column, predicate on the NI-normalised value)."""
    def isin(vals):
        return lambda v: v.isin(*vals)
    rules = []
    for lbl, c in r.symptoms.items():
        rules.append(("symptoms", lbl, c, isin(K.YES_NO_SET)))
    for lbl, c in r.comorbidities.items():
        rules.append(("comorbidities", lbl, c, isin(K.YES_NO_SET)))
    for key, (res, _) in r.exams.items():
        if key in K.EVALUATION_EXAMS:
            rules.append(("exams", key, res, isin(K.EXAM_RESULT_SET)))
    rules += [("profile", "sex", r.sex_raw, isin(K.SEX_SET)),
              ("profile", "age", r.age_raw, lambda v: v.rlike(K.AGE_CODE_PATTERN)),
              ("profile", "pregnancy", r.pregnant_raw, isin(K.PREGNANCY_SET)),
              ("profile", "race", r.race_raw, isin(K.RACE_SET)),
              ("profile", "schooling", r.school_raw, isin(K.SCHOOL_SET))]
    return rules


def field_validity(scope_rows: DataFrame, r: Roles) -> DataFrame:
    """E35 + E36: filled / blank / valid / invalid per field in ONE aggregate,
    unpivoted, then status and percent valid (banker's rounding, 2 places).
    A field whose column is absent reports blank = total."""
    rules = validity_rules(r)
    present = [(g, n, resolve_column(scope_rows.columns, [c]) if c else None, p) for g, n, c, p in rules]
    # normalise each field once (projection), then four counts per field
    vals = scope_rows.select(*[X.ni(F.col(c).cast("string")).alias(f"_v{i}")
                               for i, (_, _, c, _) in enumerate(present) if c is not None])
    aggs = [F.count(F.lit(1)).alias("_total")]
    for i, (_, _, c, p) in enumerate(present):
        if c is None:
            continue
        v = F.col(f"_v{i}")
        ok = p(v)
        aggs += [F.count_if(v != K.NI).alias(f"_f{i}"), F.count_if(v == K.NI).alias(f"_b{i}"),
                 F.count_if(ok).alias(f"_v{i}c"), F.count_if((v != K.NI) & ~ok).alias(f"_x{i}")]
    a = vals.agg(*aggs)
    items = []
    for i, (g, n, c, _) in enumerate(present):
        if c is None:
            z = F.lit(0).cast("bigint")
            vals = (z, F.col("_total"), z, z)
        else:
            vals = (F.col(f"_f{i}"), F.col(f"_b{i}"), F.col(f"_v{i}c"), F.col(f"_x{i}"))
        items.append(F.struct(F.lit(g).alias("group"), F.lit(n).alias("field"),
                              F.lit(K.YES_NO[0] if c else K.YES_NO[1]).alias("column_exists"),
                              vals[0].alias("filled"), vals[1].alias("blank_ni"),
                              vals[2].alias("valid"), vals[3].alias("invalid")))
    long = a.select("_total", F.explode(F.array(*items)).alias("x")).select(
        F.col("_total").alias("total"), "x.*")
    t = F.col("total")
    status = (F.when(t == 0, K.VALIDITY_STATUS_NO_ROWS)
               .when(F.col("column_exists") == K.YES_NO[1], K.VALIDITY_STATUS_NO_COLUMN)
               .when((F.col("valid") == 0) & (F.col("filled") == 0), K.VALIDITY_STATUS_NO_DATA)
               .when((F.col("valid") == 0) & (F.col("filled") > 0), K.VALIDITY_STATUS_INVALID)
               .otherwise(K.VALIDITY_STATUS_OK))
    pct = F.when(t > 0, F.bround(F.col("valid") / t * 100.0, 2)).otherwise(F.lit(0.0))
    return long.withColumn("pct_valid", pct).withColumn("status", status)


# ---- E40 non-null counts -----------------------------------------------------------
def non_null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Non-null count of every column in one aggregate, long form."""
    cols = list(cols or df.columns)
    a = df.agg(*[F.count(F.col(c)).alias(f"_n{i}") for i, c in enumerate(cols)])
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("non_null"))
                    for i, c in enumerate(cols)])
    return a.select(F.explode(arr).alias("x")).select("x.*")


def null_rates(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing-field rate per column (E65 on real NULLs)."""
    cols = list(cols or df.columns)
    a = df.agg(F.count(F.lit(1)).alias("_t"), *[F.count(F.col(c)).alias(f"_n{i}") for i, c in enumerate(cols)])
    arr = F.array(*[F.struct(F.lit(c).alias("column"),
                             X.guarded_ratio(F.col("_t") - F.col(f"_n{i}"), "_t", 100).alias("null_pct"))
                    for i, c in enumerate(cols)])
    return a.select(F.explode(arr).alias("x")).select("x.*")


# ---- H03 / H04 name sets ---------------------------------------------------------------
def name_union(sets: Sequence[DataFrame]) -> DataFrame:
    """The distinct values of one-column frames, as ``name``."""
    out = sets[0].toDF("name")
    for s in sets[1:]:
        out = out.union(s.toDF("name"))
    return out.distinct()


def name_difference(required: DataFrame, present: DataFrame) -> DataFrame:
    """Distinct values required but not present, as ``name``."""
    return required.toDF("name").distinct().join(present.toDF("name").distinct(), "name", "left_anti")


# ---- D11 / J09 reconciliation --------------------------------------------------------
def reconcile_years(log_rows: DataFrame, by_date: DataFrame, by_text: DataFrame, y0: int, y1: int,
                    tolerance_abs: int = K.RECON_TOLERANCE_ABS,
                    tolerance_pct: float = K.RECON_TOLERANCE_PCT) -> DataFrame:
    """D11 + J09: per year of ``y0..y1``, loaded rows (log) vs rows by date vs
    rows by year text, and the reconciliation status.

    Inputs are (year, loaded_rows), (year, rows_by_date), (year, rows_by_text);
    a year with several log rows counts their sum.  A count agrees when it
    equals the log; the year is tolerated when the larger of both gaps is
    within the absolute or the relative limit (0 switches a limit off)."""
    log = log_rows.groupBy("year").agg(F.sum("loaded_rows").cast("bigint").alias("loaded_rows"))
    years = log_rows.sparkSession.range(y0, y1 + 1).select(F.col("id").cast("int").alias("year"))
    whole = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    t = (years.join(log, "year", "left").join(by_date, "year", "left").join(by_text, "year", "left")
         .select("year", "loaded_rows", whole("rows_by_date"), whole("rows_by_text"))
         .withColumn("diff_date_vs_log", F.col("rows_by_date") - F.col("loaded_rows"))
         .withColumn("diff_text_vs_log", F.col("rows_by_text") - F.col("loaded_rows")))
    gap = F.greatest(F.abs("diff_date_vs_log"), F.abs("diff_text_vs_log"))
    limits = []
    if tolerance_abs > 0:
        limits.append(gap <= tolerance_abs)
    if tolerance_pct > 0:   # an empty log year has no relative gap
        limits.append((F.col("loaded_rows") <= 0) | (100.0 * gap <= tolerance_pct * F.col("loaded_rows")))
    tolerated = F.lit(False)
    for c in limits:
        tolerated = tolerated | c
    date_ok, text_ok = F.col("diff_date_vs_log") == 0, F.col("diff_text_vs_log") == 0
    status = F.when(F.col("loaded_rows").isNull(), K.RECON_NO_LOG)
    for cond, name in ((date_ok & text_ok, K.RECON_FULL), (tolerated, K.RECON_TOLERANCE), (date_ok, K.RECON_DATE_ONLY), (text_ok, K.RECON_YEAR_ONLY)):
        status = status.when(cond, name)
    return t.select("year", "loaded_rows", "rows_by_date", "diff_date_vs_log", "rows_by_text", "diff_text_vs_log",
                    status.otherwise(K.RECON_DIVERGENT).alias("status"))


# ---- D12 / H03 / K07 schema coverage -------------------------------------------------
def names_frame(spark: SparkSession, names: Iterable[str], flag: str) -> DataFrame:
    """Column names as rows (metadata, at most a few hundred)."""
    rows = [(n,) for n in sorted(set(names))]
    return spark.createDataFrame(rows, f"name string").withColumn(flag, F.lit(True))


def schema_coverage(spark: SparkSession, source_cols: Iterable[str], mapper_cols: Iterable[str],
                    output_cols: Iterable[str], table: DataFrame,
                    aliases: Mapping[str, Iterable[str]] | None = None) -> DataFrame:
    """D12 + E40 + K07: which fields are in the source, referenced by the
    mapping, produced by the conform step, present in the table; non-null
    counts of the table; one of five statuses."""
    aliases = aliases or {}
    src = names_frame(spark, source_cols, "in_source")
    mp = names_frame(spark, mapper_cols, "in_mapper")
    out = names_frame(spark, output_cols, "in_output")
    tb = names_frame(spark, table.columns, "in_table")
    u = src.join(mp, "name", "full").join(out, "name", "full").join(tb, "name", "full")  # H03 union
    nn = non_null_counts(table).withColumnRenamed("column", "name")
    u = u.join(nn, "name", "left")
    al = [(k, a) for k, vs in aliases.items() for a in vs]
    src_names = set(source_cols)
    alias_hit = F.lit(False)
    for k, a in al:
        if a in src_names:
            alias_hit = alias_hit | (F.col("name") == k)
    b = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("in_source", "in_mapper", "in_output", "in_table")}
    status = (F.when(b["in_source"] & ~b["in_mapper"], K.AUDIT_SOURCE_UNMAPPED)
               .when(b["in_mapper"] & ~b["in_source"] & ~alias_hit, K.AUDIT_MAPPER_MISSING)
               .when(b["in_output"] & ~b["in_table"], K.AUDIT_OUTPUT_NO_COLUMN)
               .when(b["in_table"] & ~b["in_output"] & ~F.col("name").isin(*K.AUDIT_TECHNICAL_COLUMNS),
                     K.AUDIT_COLUMN_NO_OUTPUT)
               .otherwise(K.AUDIT_OK))
    yn = lambda c: F.when(c, K.YES_NO[0]).otherwise(K.YES_NO[1])
    return u.select("name", yn(b["in_source"]).alias("in_source"), yn(b["in_mapper"]).alias("in_mapper"),
                    yn(b["in_output"]).alias("in_output"), yn(b["in_table"]).alias("in_table"),
                    "non_null", status.alias("status"))
