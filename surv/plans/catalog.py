"""Imports every query module so the registry is complete."""

from __future__ import annotations

from surv.plans import q_clinical, q_counts, q_cubes, q_io, q_misc, q_profile, q_territory  # noqa: F401
from surv.plans import q_native  # noqa: F401  (after the modules whose oracles it reuses)
from surv.plans import q_variants  # noqa: F401
from surv.plans.registry import ORACLE, QUERIES  # noqa: F401


def flagship(spark, sf_dir):
    """E24, the monthly indicator table: scan, dirty-code normalisation,
    multi-metric aggregate, size-checked broadcast join, guarded ratios."""
    return QUERIES["e24_d05_monthly_indicators"](spark, sf_dir)
