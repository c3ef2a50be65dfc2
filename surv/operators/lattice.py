"""Which cube can answer a request.

A cube is described by its grain (dimensions), the measures it stores and the
filter it was built with.  A request names the dimensions to group by, measures,
and filters.  A cube can answer it if every dimension of the request is one of the
cube's or follows from one (a year from a month, a place's name from its code),
every measure is stored or is a sum over the cube's counts, and the request asks
for no rows outside the cube's filter.  Of those, the smallest is read; if there
is none, the fact.  Every table, the fact included, is evaluated by one plan, so
the choice never changes the rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surv.functions import codes as K
from surv.functions import expr as X
from surv.operators import scope as S
from surv.roles import Roles
from surv.session import leaf_bytes

# dimension -> the dimension it follows from
FOLLOWS = {"year": "month_start", "month": "month_start", "place_name": "place_code", "code6": "place_code", "population": "place_code",
           "area_km2": "place_code"}
PLACE_DIMS = ("place_name", "code6", "population", "area_km2")


@dataclass(frozen=True)
class Measure:
    """Cases for which ``test`` holds, over the dimensions ``needs``."""
    needs: tuple[str, ...]
    test: Callable[[], Column]


MEASURES: Mapping[str, Measure] = {
    "cases": Measure((), lambda: F.lit(True)),
    "confirmed": Measure(("classification",), lambda: F.col("classification").isin(*K.CONFIRMED_CODES)),
    "discarded": Measure(("classification",), lambda: F.col("classification").isin(*K.DISCARDED_CODES)),
    "investigating": Measure(("classification",), lambda: F.col("classification").isin(*K.INVESTIGATION_CODES)),
    "deaths": Measure(("outcome",), lambda: F.col("outcome").isin(*K.DEATH_CODES_CARDS)),
    "hospitalisations": Measure(("hospitalised",), lambda: F.col("hospitalised")),
}


@dataclass(frozen=True)
class Cube:
    """Grain, stored measures, and the states that the cube was filtered to."""
    dims: tuple[str, ...]
    measures: tuple[str, ...] = ("cases",)
    states: tuple[str, ...] | None = None


_MONTH_STATE = ("month_start", "state")
CUBES: Mapping[str, Cube] = {
    "month_state_class": Cube((*_MONTH_STATE, "classification")),
    "month_place_class_outcome": Cube((*_MONTH_STATE, "place_code", "classification", "outcome"), states=K.FOCUS_STATE_CODES),
    "month_place_class_facility": Cube((*_MONTH_STATE, "place_code", "classification", "facility"), states=K.FOCUS_STATE_CODES),
    "base": Cube((*_MONTH_STATE, "place_code", "classification", "outcome", "facility", "hospitalised")),
}
ALL_DIMS = CUBES["base"].dims


@dataclass(frozen=True)
class Request:
    by: tuple[str, ...] = ()
    measures: tuple[str, ...] = ("cases",)
    where: Mapping[str, Sequence] = field(default_factory=dict)     # dimension -> values; empty: no filter
    since: str | None = None                                        # first notification day
    place: str | None = None                                        # resolved name of a place

    def filters(self) -> dict[str, tuple]:
        return {d: tuple(v) for d, v in self.where.items() if v}

    def dims(self) -> set[str]:
        used = {*self.by, *self.filters()}
        return used | {"place_name"} if self.place else used


def _has(cube: Cube, dim: str) -> bool:
    return dim in cube.dims or FOLLOWS.get(dim) in cube.dims


def can_answer(cube: Cube, q: Request) -> bool:
    if not all(_has(cube, d) for d in q.dims()):
        return False
    for m in q.measures:
        if m not in cube.measures and not ("cases" in cube.measures and set(MEASURES[m].needs) <= set(cube.dims)):
            return False
    if cube.states is not None:
        asked = q.filters().get("state")
        if not asked or not set(asked) <= set(cube.states):
            return False
    # a cube knows months: a bound inside one needs the days of the fact
    return not q.since or bool(re.fullmatch(r"\d{4}-\d{2}-01", q.since))


def fact_rows(f: DataFrame, r: Roles) -> DataFrame:
    """The fact with the dimensions as columns, each row one case."""
    ni = lambda role: X.ni(r.c(role)) if r.has(role) else F.lit(K.NI)
    d = r.c("notified_on")
    return S.notified(f, r).select(
        d.alias("day"), X.month_start(d).alias("month_start"), S._stored(f, "state_norm", X.ni(r.c("state_raw"))).alias("state"),
        X.ni(r.c("place_raw"), K.PLACE_NOT_INFORMED_VIEW).alias("place_code"), S._stored(f, "class_norm", X.ni(r.c("class_raw"))).alias("classification"),
        ni("outcome_raw").alias("outcome"), ni("facility_raw").alias("facility"),
        (X.yes_flag(r.c("hosp_raw")) if r.has("hosp_raw") else F.lit(False)).alias("hospitalised"), F.lit(1).cast("long").alias("cases"))


def evaluate(rows: DataFrame, q: Request, territory: DataFrame | None, stored: Sequence[str] = ("cases",)) -> DataFrame:
    """The request over rows that have its dimensions: filters, one aggregate by
    the dimensions that the rows hold, and only then the join that names places."""
    start = F.lit(q.since).cast("date") if q.since else None
    if q.since:
        rows = rows.filter((F.col("day") if "day" in rows.columns else F.col("month_start")) >= start)
    for dim, values in q.filters().items():
        if dim not in PLACE_DIMS:
            rows = rows.filter(_value(dim).isin(*values))
    placed = [d for d in PLACE_DIMS if d in q.dims()]
    plain = [d for d in q.by if d not in PLACE_DIMS]
    keys = [_value(d).alias(d) for d in plain] + ([F.col("place_code")] if placed and "place_code" not in plain else [])
    sums = [(F.sum(m) if m in stored else F.sum(F.when(MEASURES[m].test(), F.col("cases")).otherwise(0))).cast("bigint").alias(m) for m in q.measures]
    out = rows.groupBy(*keys).agg(*sums) if keys else rows.agg(*[F.coalesce(s, F.lit(0).cast("bigint")).alias(m) for s, m in zip(sums, q.measures)])
    if not placed:
        return out.select(*q.by, *q.measures)
    out = S.join_territory(out.withColumn("code6", X.place_code6("place_code")), territory, cols=("place_name", "population", "area_km2"))
    out = out.withColumn("place_name", F.coalesce("place_name", "place_code"))
    if q.place:
        out = out.filter(F.upper("place_name") == F.upper(F.lit(q.place)))
    for dim, values in q.filters().items():
        if dim in PLACE_DIMS:
            out = out.filter(F.col(dim).isin(*values))
    sums = [F.sum(m).cast("bigint").alias(m) for m in q.measures]
    out = out.groupBy(*q.by).agg(*sums) if q.by else out.agg(*[F.coalesce(s, F.lit(0).cast("bigint")).alias(m) for s, m in zip(sums, q.measures)])
    return out.select(*q.by, *q.measures)


def _value(dim: str) -> Column:
    if dim == "year":
        return X.year_of(F.col("month_start"))
    if dim == "month":
        return X.month_of(F.col("month_start"))
    return F.col(dim)


class Lattice:
    """The fact, its dimension and the cubes that exist, by their name in ``CUBES``."""

    def __init__(self, fact: DataFrame, roles: Roles, territory: DataFrame | None, cubes: Mapping[str, DataFrame]):
        self.fact, self.roles, self.territory, self.cubes = fact, roles, territory, dict(cubes)

    def choose(self, q: Request) -> str | None:
        """The smallest cube that can answer (by the bytes of its files now; those
        of an unknown size last), or None for the fact."""
        def size(name: str) -> tuple:
            known = leaf_bytes(self.cubes[name])
            return known is None, known or 0, len(CUBES[name].dims)

        return min((n for n in self.cubes if can_answer(CUBES[n], q)), key=size, default=None)

    def answer(self, q: Request) -> DataFrame:
        name = self.choose(q)
        if name is None:
            return evaluate(fact_rows(self.fact, self.roles), q, self.territory)
        rows = self.cubes[name]
        # names and attributes of places come from the dimension as it is now
        rows = rows.drop(*[c for c in ("year", "month", "code6_fact", *PLACE_DIMS) if c in rows.columns])
        return evaluate(rows, q, self.territory, CUBES[name].measures)


def stored_cubes(spark: SparkSession, base: str | None) -> dict[str, DataFrame]:
    """The cubes that exist under ``base``: tables of a published group, or plain
    Parquet folders."""
    from surv.operators.cubes import path_exists
    from surv.sources.published import TableGroup
    if not base:
        return {}
    group = TableGroup(spark, base)
    published = group.state()["tables"]
    if published:
        return {n: group.read(n) for n in CUBES if n in published}
    return {n: spark.read.parquet(f"{base.rstrip('/')}/{n}") for n in CUBES if path_exists(spark, f"{base.rstrip('/')}/{n}")}
