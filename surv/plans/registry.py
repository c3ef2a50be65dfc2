"""Registry of named queries: a Spark callable and its DuckDB oracle SQL.

Each entry reads the driver tables (through the ``surv.plans.fixtures``
projections) so its work grows with the data.  ``oracle`` is DuckDB SQL over
the same tables; the shared ``WITH`` prelude defines the projections.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from surv.plans import fixtures as FX
from surv.roles import FIXTURE_ROLES

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

PRELUDE = FX.oracle_prelude()


def register(name: str, sql: str | None = None, raw_sql: bool = False):
    """Decorator: register ``fn(spark, sf_dir)`` under ``name``.

    ``sql`` is appended to the fixture prelude (it either starts with
    ``SELECT`` or continues the ``WITH`` list with ``, name AS (...)``);
    ``raw_sql=True`` uses it as is.
    """
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql if raw_sql else PRELUDE + sql
        return fn
    return deco


@dataclass
class Ctx:
    f: DataFrame
    t: DataFrame
    fac: DataFrame
    spark: SparkSession
    sf: str
    r = FIXTURE_ROLES


def ctx(spark: SparkSession, sf: str) -> Ctx:
    """Base frames of a data directory, as its files are now."""
    return Ctx(FX.cases(spark, sf), FX.territory(spark, sf), FX.facility(spark, sf), spark, sf)


# ---- shared oracle snippets (DuckDB dialect) --------------------------------
PLACE = FX.FOCUS_PLACE            # 'NATION_0'
PLACE_CODE7 = "0330009"           # its 7-digit code in the territory projection
CLS = ("1", "2", "5", "01", "NI")  # a classification filter list used by tests
SINCE = "1997-01-01"


def NI(x: str, d: str = "NI") -> str:
    return f"COALESCE(NULLIF(TRIM({x}), ''), '{d}')"


def DIGITS(x: str) -> str:
    """The text if it is all digits, else NULL."""
    return f"CASE WHEN regexp_full_match({x}, '[0-9]+') THEN {x} END"


def CODE6(x: str) -> str:
    """All-digit text padded or cut to six."""
    return f"lpad({DIGITS(x)}, 6, '0')"


def AGE(x: str) -> str:
    """Whole years of a coded age: a unit, then how many of it."""
    count = f"TRY_CAST(substring({x}, 2) AS INTEGER)"
    return f"""CASE left({DIGITS(x)}, 1)
  WHEN '4' THEN {count}
  WHEN '3' THEN {count} // 12
  WHEN '2' THEN 0
  WHEN '1' THEN 0 END"""


def BAND(age: str) -> str:
    """Age band."""
    return f"""CASE WHEN ({age}) < 10 THEN '0 a 9' WHEN ({age}) < 20 THEN '10 a 19' WHEN ({age}) < 40 THEN '20 a 39'
  WHEN ({age}) < 60 THEN '40 a 59' WHEN ({age}) >= 60 THEN '60+' ELSE 'Não informado' END"""


def ONLY_DIGITS(x: str) -> str:
    return f"array_to_string(regexp_extract_all({x}, '[0-9]'), '')"


def FACILITY_KEY(x: str) -> str:
    """The digits of an id (a blank id is 0), padded or cut to seven."""
    return f"lpad({ONLY_DIGITS(NI(x, '0'))}, 7, '0')"


def WEEK(x: str) -> str:
    """Week of a year-and-week text: its digits padded or cut to six, the last two."""
    return f"TRY_CAST(right(lpad({ONLY_DIGITS(x)}, 6, '0'), 2) AS INTEGER)"


CONFIRMED = ("1", "3", "4", "5", "6", "10", "11", "12")


def CLASS_GROUP(x: str) -> str:
    """Group of a class code given as text."""
    return f"""CASE WHEN {x} IN {IN(CONFIRMED)} THEN 'Confirmados' WHEN {x} = '2' THEN 'Descartados'
  WHEN {x} = '8' THEN 'Inconclusivos' ELSE 'Em investigação' END"""


def YEAR(d: str) -> str:
    return f"CAST(year({d}) AS INTEGER)"


def MONTH(d: str) -> str:
    return f"CAST(date_trunc('month', {d}) AS DATE)"


def IN(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def BASE(cls=None, since=None, alias="f") -> str:
    """C01 + C03 + C02 predicate text."""
    p = f"{alias}.notified_on IS NOT NULL"
    if since:
        p += f" AND {alias}.notified_on >= DATE '{since}'"
    if cls:
        p += f" AND {NI(alias + '.class_raw')} IN {IN(cls)}"
    return p


def FOCUS_FROM(cls=None, since=None, place=PLACE) -> str:
    """D02 + C04 + C06: fact route of the place-scoped loaders."""
    return (f"FROM cases f LEFT JOIN territory d ON ({CODE6('f.place_raw')}) = d.code6 "
            f"WHERE {BASE(cls, since)} AND {NI('f.state_raw')} IN ('RJ', '33') "
            f"AND (upper(COALESCE(d.place_name, trim(f.place_raw), '')) = upper('{place}') "
            f"OR upper(trim(f.place_raw)) = upper('{place}'))")
