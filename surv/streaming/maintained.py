"""A warehouse whose cubes follow its fact (K04, K05, J08 after A13, J02, J03).

Counts are additive, so a delivery changes a cube by a signed aggregate: plus the
rows it brings, minus the rows it takes away.  One pass over these rows gives the
change of the base aggregate; the cubes and the indicator table are roll-ups of the
base, so their changes are the same roll-ups of its change.  Only the years that the
change names are read and written again: each old group plus its change, groups
without a case left out, rates (which are not additive) computed from the sums.

The fact, the base, the cubes and the indicator table are published as one version
(``sources.published``): a reader never sees a cube of another fact.  Each
partition's first and last day is kept with the pointer, so a window finds the
partitions it touches without reading the others.  Names and attributes of places
are part of the cubes; when the territory dimension changes, its digest differs and
the tables are rebuilt from the base.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surv.operators import cubes as CU
from surv.operators.quality import assert_unique
from surv.roles import Roles
from surv.session import materialize
from surv.sources.published import Change, TableGroup, part_key
from surv.streaming import incremental as INC


@dataclass(frozen=True)
class Derived:
    """A table that rolls up from the base: its keys, its sums (the first counts
    cases), and how a change of the base becomes a change of it."""
    keys: tuple[str, ...]
    sums: tuple[str, ...] = ("cases",)


_PLACE = ("year", "month_start", "state", "place_code", "place_name", "code6")
BASE_KEYS = ("year", "month", "month_start", "state", "place_code", "code6_fact", "classification", "outcome", "facility", "hospitalised")
CUBES = {
    "month_state_class": Derived(("year", "month_start", "state", "classification")),
    "month_place_class_outcome": Derived((*_PLACE, "population", "area_km2", "classification", "outcome")),
    "month_place_class_facility": Derived((*_PLACE, "classification", "facility")),
}
INDICATORS = "monthly_indicators"


def indicator_table(territory: DataFrame) -> Derived:
    return Derived(("year", "month", "state", "place", "code6", *CU.territory_attributes(territory)), CU.INDICATOR_SUMS)


def rollups(base: DataFrame, territory: DataFrame) -> dict[str, DataFrame]:
    """The additive columns of every derived table, from a base or a change of one."""
    return {**CU.cubes_from_base(base, territory), INDICATORS: CU.indicator_sums(base, territory)}


def signed_base(added: DataFrame, removed: DataFrame | None, r: Roles) -> DataFrame:
    """Change of the base aggregate: rows added count up, rows removed count down;
    groups that end where they were are left out."""
    parts = CU.analytics_base(added, r)
    if removed is not None:
        gone = CU.analytics_base(removed, r)
        parts = parts.unionByName(gone.withColumn("cases", -F.col("cases")))
    return parts.groupBy(*BASE_KEYS).agg(F.sum("cases").cast("bigint").alias("cases")).filter("cases <> 0")


def merged(old: DataFrame, change: DataFrame, table: Derived, years: Sequence[int]) -> DataFrame:
    """The groups of ``years`` after a change.  A count below zero means that the
    table does not belong to the fact it is maintained with: an error, not a row."""
    n = table.sums[0]
    cols = [*table.keys, *table.sums]
    both = old.filter(F.col("year").isin(list(years))).select(*cols).unionByName(change.select(*cols))
    g = both.groupBy(*table.keys).agg(*[F.sum(c).cast("bigint").alias(c) for c in table.sums])
    wrong = F.raise_error(F.lit("a maintained count fell below zero: rebuild the cubes")).cast("bigint")
    return g.withColumn(n, F.when(F.col(n) < 0, wrong).otherwise(F.col(n))).filter(F.col(n) > 0)


def dimension_digest(territory: DataFrame) -> str:
    """Order-free digest of a dimension's rows."""
    cols = sorted(territory.columns)
    h = F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in cols])
    return str(territory.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("h")).first().asDict())


class Warehouse:
    """The fact and what is derived from it, under one folder."""

    FACT, BASE = "fact", "base"

    def __init__(self, spark: SparkSession, path: str, roles: Roles, territory: DataFrame, part_col: str = "year"):
        self.spark, self.roles, self.territory, self.part_col = spark, roles, territory, part_col
        self.group = TableGroup(spark, path)

    def read(self, table: str = FACT, version: int | None = None) -> DataFrame:
        return self.group.read(table, version)

    def latest_day(self):
        """The last notification day (E72), from the kept spans: no row is read."""
        spans = self.group.facts(self.FACT).get("spans", {})
        return max((hi for _, hi in spans.values() if hi), default=None)

    # ---- deliveries ------------------------------------------------------------
    def replace_window(self, new: DataFrame, d0: str, d1: str | None = None) -> dict:
        """Drop the rows with a day in [d0, d1], add ``new``."""
        return self._deliver(new, INC.window_hit(self.roles.notified_on, d0, d1), d0, d1)

    def replace_days(self, new: DataFrame, since: str | None = None) -> dict:
        """Replace exactly the days that the delivery carries (on or after
        ``since``); rows without a day are added."""
        day = self.roles.notified_on
        if since:
            new = new.filter(F.col(day).isNull() | (F.col(day) >= F.lit(since).cast("date")))
        lo, hi = new.agg(F.min(day).cast("string"), F.max(day).cast("string")).first()
        return self._deliver(new, INC.day_hit(new, day), lo, hi)

    def empty_days(self, d0: str, d1: str) -> dict:
        """Withdraw the rows of [d0, d1]."""
        return self.replace_window(self.read().limit(0), d0, d1)

    def _touched(self, new: DataFrame, d0: str | None, d1: str | None) -> list[str]:
        """Keys of the partitions that a window may touch, by their kept spans."""
        spans = self.group.facts(self.FACT).get("spans", {})
        hit = {v for v, (lo, hi) in spans.items() if d0 and hi and hi >= d0 and (not d1 or lo <= d1)}
        return sorted(hit | {part_key(r[0]) for r in new.select(self.part_col).distinct().collect()})

    def _deliver(self, new: DataFrame, drop, d0: str | None, d1: str | None) -> dict:
        new = materialize(new, "delivery")            # read once; the plans below use it three times
        state = self.group.state()["tables"]
        if self.FACT not in state:
            return self.rebuild(new)
        keys = self._touched(new, d0, d1)
        if not keys:
            return {"version": self.group.state()["version"], "partitions": [], "years": []}
        values = [None if k == part_key(None) else k for k in keys]
        old = self.read().filter(INC._any_value(self.part_col, values))
        hit: Column = drop(old)
        change = materialize(signed_base(new, old.filter(hit), self.roles), "change")
        years = sorted(r.year for r in change.select("year").distinct().collect())      # calendar years
        rows = INC.row_change(old, new, self.part_col, hit, values)
        changes = {self.FACT: self._with_spans(rows, keys)}
        if years:
            changes |= self._derived_changes(change, years)
        return {"version": self.group.publish(changes), "partitions": keys, "years": years}

    def _with_spans(self, rows: Change, keys: Sequence[str]) -> Change:
        """First and last day of each rewritten partition, kept with the pointer."""
        rows.rows = materialize(rows.rows, "partitions")
        day = self.roles.notified_on
        got = {part_key(r[0]): [r[1], r[2]] for r in rows.rows.groupBy(self.part_col).agg(F.min(day).cast("string"), F.max(day).cast("string")).collect()}
        spans = self.group.facts(self.FACT).get("spans", {}) if rows.parts is not None else {}
        rows.facts["spans"] = {k: v for k, v in {**spans, **{k: None for k in keys}, **got}.items() if v is not None}
        return rows

    def _derived_changes(self, change: DataFrame, years: Sequence[int]) -> dict[str, Change]:
        digest = dimension_digest(self.territory)
        base = merged(self.read(self.BASE), change, Derived(BASE_KEYS), years)
        out = {self.BASE: Change(base, "year", years)}
        if self.group.facts(INDICATORS).get("territory") != digest:
            whole = self.read(self.BASE).filter(~F.col("year").isin(list(years))).unionByName(base)
            return out | self._rebuilt(whole, digest)
        for name, delta in rollups(change, self.territory).items():
            table = CUBES.get(name) or indicator_table(self.territory)
            rows = merged(self.read(name), delta, table, years)
            out[name] = Change(CU.with_indicator_rates(rows) if name == INDICATORS else rows, "year", years)
        return out

    def _rebuilt(self, base: DataFrame, digest: str) -> dict[str, Change]:
        assert_unique(self.territory, ["code6"])       # T17
        out = {name: Change(CU.with_indicator_rates(df) if name == INDICATORS else df, "year") for name, df in rollups(base, self.territory).items()}
        out[INDICATORS].facts = {"territory": digest}
        return out

    def rebuild(self, fact: DataFrame | None = None) -> dict:
        """Everything from the fact (a new one, or the one that is there)."""
        changes: dict[str, Change] = {}
        if fact is not None:
            changes[self.FACT] = self._with_spans(Change(fact, self.part_col), [])
            fact = changes[self.FACT].rows
        else:
            fact = self.read()
        base = materialize(CU.analytics_base(fact, self.roles), "base")
        changes[self.BASE] = Change(base, "year")
        changes |= self._rebuilt(base, dimension_digest(self.territory))
        return {"version": self.group.publish(changes), "partitions": None, "years": None}
