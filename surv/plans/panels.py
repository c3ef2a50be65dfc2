"""The dashboard's data loaders as one object.

``Panels`` binds a fact, its role map and the two dimensions, and exposes one
method per loader of the five panels.  When ``cube_base`` points at cubes (a
published warehouse, or the folders that ``cubes.refresh_cubes`` writes), a loader
reads the smallest cube that can answer it (K08), otherwise the fact.  Every method
returns a lazy DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import DataFrame

from surv.operators import clinical as CL
from surv.operators import counts as C
from surv.operators import cubes as CU
from surv.operators import evaluation as EV
from surv.operators import profile as P
from surv.operators import territory as T
from surv.roles import Roles


@dataclass
class Panels:
    fact: DataFrame
    roles: Roles
    territory: DataFrame
    facility: DataFrame | None = None
    cube_base: str | None = None      # a published warehouse, or a folder of cube tables

    @property
    def _cubes(self):
        """The cubes that exist now."""
        from surv.operators.lattice import stored_cubes
        return stored_cubes(self._spark, self.cube_base)

    @property
    def lattice(self):
        """Any request over the cubes' dimensions, answered by the smallest cube that can."""
        from surv.operators.lattice import Lattice
        return Lattice(self.fact, self.roles, self.territory, self._cubes)

    @property
    def _spark(self):
        return self.fact.sparkSession

    # ---- panel 1: situation ------------------------------------------------
    def cases_per_year(self, cls: Sequence[str] = ()) -> DataFrame:
        return CU.route_cases_per_year(self._spark, self.fact, self.roles, cls, cube=self._cubes)

    def cases_month_state(self, cls: Sequence[str] = (), since: str | None = None) -> DataFrame:
        return CU.route_month_state(self._spark, self.fact, self.roles, cls, since, cube=self._cubes)

    def focus_monthly(self, place: str, cls: Sequence[str] = (), since: str | None = None) -> DataFrame:
        return CU.route_focus_monthly(self._spark, self.fact, self.roles, self.territory, place, cls, since,
                                      cube=self._cubes)

    def focus_status(self, place: str, cls: Sequence[str] = (), since: str | None = None) -> DataFrame:
        return CU.route_focus_status(self._spark, self.fact, self.roles, self.territory, place, cls, since,
                                     cube=self._cubes)

    def hospitalisations_monthly(self, place: str, cls: Sequence[str] = (), since: str | None = None) -> DataFrame:
        return CU.route_hospitalisations_monthly(self._spark, self.fact, self.roles, self.territory, place, cls, since,
                                                 cube=self._cubes)

    def population_refs(self, place: str) -> DataFrame:
        return C.population_refs(self.territory, place)

    def three_scope_series(self, place: str, cls: Sequence[str] = (), since: str | None = None) -> DataFrame:
        return C.three_scope_series(self.fact, self.roles, self.territory, place, cls, since)

    def period_cards(self, place: str, cls: Sequence[str] = (), since: str | None = None) -> DataFrame:
        return C.period_cards(self.fact, self.roles, self.territory, place, cls, since)

    def last_month_cards(self, place: str, cls: Sequence[str] = (), since: str | None = None) -> DataFrame:
        return C.last_month_cards(self.fact, self.roles, self.territory, place, cls, since)

    # ---- panel 2: territory and risk ---------------------------------------
    def state_places(self, cls: Sequence[str] = (), since: str | None = None) -> DataFrame:
        return CU.route_state_places(self._spark, self.fact, self.roles, self.territory, cls, since,
                                     cube=self._cubes)

    def country_places(self, cls: Sequence[str] = (), since: str | None = None) -> DataFrame:
        return C.country_places_enriched(self.fact, self.roles, self.territory, cls, since)

    def top_facilities(self, place: str, cls: Sequence[str] = (), top_n: int = 10,
                       since: str | None = None) -> DataFrame:
        return CU.route_top_facilities(self._spark, self.fact, self.roles, self.territory, self.facility, place,
                                       cls, top_n, since, cube=self._cubes)

    def facilities_monthly(self, place: str, cls: Sequence[str] = (), since: str | None = None) -> DataFrame:
        return CU.route_facilities_monthly(self._spark, self.fact, self.roles, self.territory, self.facility,
                                           place, cls, since, cube=self._cubes)

    def facility_risk(self, place: str, cls: Sequence[str] = (), since: str | None = None) -> DataFrame:
        return T.facility_risk(self.facilities_monthly(place, cls, since))

    def place_rollup(self, cls: Sequence[str] = (), since: str | None = None) -> DataFrame:
        return T.place_rollup(self.state_places(cls, since))

    def management_table(self, cls: Sequence[str] = (), since: str | None = None) -> DataFrame:
        return T.management_table(self.state_places(cls, since))

    # ---- panel 3: profile ------------------------------------------------------
    def cases_by_sex(self, place: str, cls: Sequence[str] = (), since: str | None = None) -> DataFrame:
        return C.cases_by_sex(self.fact, self.roles, self.territory, place, cls, since)

    def mean_epi_week(self, place: str, cls: Sequence[str] = (), since: str | None = None) -> DataFrame:
        return C.mean_epi_week(self.fact, self.roles, self.territory, place, cls, since)

    def top_profile(self, place: str, cls: Sequence[str] = (), since: str | None = None) -> DataFrame:
        return P.top_profile(self.fact, self.roles, self.territory, place, cls, since)

    def demographic_monthly(self, place: str, cls: Sequence[str] = (), since: str | None = None) -> DataFrame:
        return P.demographic_monthly(self.fact, self.roles, self.territory, place, cls, since)

    def demographic_scope(self, scope: str, cls: Sequence[str] = (), since: str | None = None) -> DataFrame:
        return P.demographic_monthly_scope(self.fact, self.roles, scope, cls, since)

    def comorbidities_monthly(self, place: str, cls: Sequence[str] = (), since: str | None = None) -> DataFrame:
        return P.comorbidities_monthly(self.fact, self.roles, self.territory, place, cls, since)

    # ---- panels 4 and 5: clinical, evaluation -----------------------------
    def clinical_extract(self, place: str, cls: Sequence[str] = (), since: str | None = None) -> DataFrame:
        return CL.clinical_extract(self.fact, self.roles, self.territory, place, cls, since)

    def evaluation_extract(self, place: str, cls: Sequence[str] = (), since: str | None = None) -> DataFrame:
        return EV.evaluation_extract(self.fact, self.roles, self.territory, self.facility, place, cls, since)
