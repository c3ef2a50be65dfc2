"""Scalar functions (2I) and name/text helpers (B01-B08, B20-B22) on inline edge rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from surv.functions import expr as X
from surv.operators import conform as B


def one(spark, col, values, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(col(F.col("x")).alias("y")).collect()]


def test_ni_trims_spaces_only(spark):
    assert one(spark, X.ni, [None, "", "  ", " 5 ", "RJ", "\t"]) == ["NI", "NI", "NI", "5", "RJ", "\t"]


def test_place_code6(spark):
    vals = ["3304524", "330452", "33045", "RIO", None, "", "123\n", "12345678"]
    assert one(spark, X.place_code6, vals) == ["330452", "330452", "033045", None, None, None, None, "123456"]


def test_facility_key_pads_and_cuts(spark):
    vals = [None, " ", "U-5", "0003", "12345678", "abc"]
    assert one(spark, X.facility_key, vals) == ["0000000", "0000000", "0000005", "0000003", "1234567", "0000000"]


def test_epi_week(spark):
    assert one(spark, X.epi_week, [None, "", "202405", "2024-05", "7", "1234567"]) == [None, 0, 5, 5, 7, 56]  # lpad cuts to 6 first (T7)


def test_age_years_and_band(spark):
    vals = ["", "4", "x12", "3018", "2010", "1005", "9001", "4035", "4100", " 4035"]
    ages = one(spark, X.age_years, vals)
    assert ages == [None, None, None, 1, 0, 0, None, 35, 100, None]
    df = spark.createDataFrame([(a,) for a in [None, 0, 9, 10, 19, 20, 39, 40, 59, 60, 120]], "a int")
    bands = [r[0] for r in df.select(X.age_band("a")).collect()]
    assert bands == ["Não informado", "0 a 9", "0 a 9", "10 a 19", "10 a 19", "20 a 39", "20 a 39",
                     "40 a 59", "40 a 59", "60+", "60+"]


def test_class_group_variants(spark):
    vals = ["1", "01", " 5 ", "2", "8", "9", None, "NI", "12"]
    num = one(spark, lambda c: X.class_group(c, True), vals)
    txt = one(spark, lambda c: X.class_group(c, False), vals)
    assert num == ["Confirmados", "Confirmados", "Confirmados", "Descartados", "Inconclusivos",
                   "Em investigação", "Em investigação", "Em investigação", "Confirmados"]
    assert txt[1] == "Em investigação" and txt[2] == "Confirmados" and txt[0] == "Confirmados"


def test_death_and_yes_flags(spark):
    assert one(spark, X.death_flag, ["2", " 3 ", "Obito em investigacao", "1", None]) == [True, True, True, False, False]
    assert one(spark, lambda c: X.yes_flag(c, ("1", "S", "SIM")), ["S", "sim", " 1 ", None]) == [True, False, True, False]


def test_guarded_ratio_and_deltas(spark):
    df = spark.createDataFrame([(1, 0), (1, 4), (None, 2), (3, None)], "n int, d int")
    r = df.select(X.guarded_ratio("n", "d", 100).alias("a"), X.guarded_ratio("n", "d", 100, zero=True).alias("b"),
                  X.pct_delta("n", "d").alias("c"), X.growth_pct("d", "n").alias("g")).collect()
    assert [x.a for x in r] == [None, 25.0, None, None]
    assert [x.b for x in r] == [0.0, 25.0, 0.0, 0.0]
    assert r[1].c == -75.0 and r[0].c is None
    assert r[0].g == 100.0 and r[1].g == -75.0


def test_rounding_modes(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "x double")
    assert [r[0] for r in df.select(X.round_half_even_int("x")).collect()] == [0, 2, 2, 0]
    assert [r[0] for r in df.select(X.round_half_up_int("x")).collect()] == [1, 2, 3, -1]


def test_decoders(spark):
    assert one(spark, X.decode_classification, ["1", "", None, "NI", "77"]) == [
        "Dengue", "Nao informado", "Nao informado", "Nao informado", "Codigo 77"]
    assert one(spark, X.age_display, ["4035", "3002", "9", "x", "5003"]) == [
        "35 ano(s)", "2 mes(es)", "9", "x", "3 unidade"]
    assert one(spark, X.school_display, ["01", "1", "10", "99", "NI", "zz"]) == [
        "1a a 4a serie incompleta EF", "1a a 4a serie incompleta EF", "no se aplica", "ignorado",
        "no informado", "zz"]


def test_month_label(spark):
    df = spark.createDataFrame([(dt.date(2024, 3, 5),)], "d date")
    assert df.select(X.month_label("d")).first()[0] == "março/2024"


def test_name_helpers():
    assert B.snake_name(" Código do Município ") == "código_do_município"
    assert B.snake_name("RESUL_PCR_") == "resul_pcr"
    assert B.snake_name("***") == "coluna"
    assert B.unique_names(["a", "a", "b", "a"]) == ["a", "a_1", "b", "a_2"]
    assert B.ascii_snake("Código do Município") == "codigo_do_municipio"


def test_numeric_text(spark):
    vals = ["1.234,56", "75.5", ".", "", "nan", "None", None, " 12 ", "abc"]
    assert one(spark, B.br_decimal, vals) == [1234.56, 755.0, None, None, None, None, None, 12.0, None]
    assert one(spark, B.br_int, ["2,5", "3,5", "1.000"]) == [2, 4, 1000]
    assert one(spark, lambda c: B.digits_or_null(c, 7), ["330452", "33-04-524", "12345678", ".", "x"]) == [
        "0330452", "3304524", "12345678", None, None]


def test_strip_matches_python_on_real_text(spark):
    from tests.conftest import SF_SMALL
    docs = spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("text")
    got = docs.select("text", B.strip_all(F.col("text")).alias("s")).collect()
    for r in got:
        if r.text is not None:
            assert r.s == r.text.strip("".join(chr(c) for c in range(0x110000) if chr(c).isspace())) or r.s == r.text.strip()


def test_title_case_matches_python(spark):
    vals = ["hello world", "o'neil-smith 3rd", "ÁGUA viva", "x", "", None, "vila nova do sul"]
    got = one(spark, B.title_case, vals)
    assert got == [v.title() if v is not None else None for v in vals]


@pytest.mark.parametrize("txt,expected", [
    ("2024-01-05", dt.date(2024, 1, 5)), ("2024-1-5", dt.date(2024, 1, 5)), ("2024-13-01", None),
    ("01/02/2024", None), ("2024", None), ("", None), (None, None), ("2024-02-30", None),
    ("2024-03-04 10:11:12", dt.date(2024, 3, 4)), ("2024-03-04T10:11:12.123Z", dt.date(2024, 3, 4)),
])
def test_parse_date(spark, txt, expected):
    assert one(spark, B.parse_date, [txt]) == [expected]
