"""Comparing two cohorts of play sessions on Spark."""

from cohortlens.model import CompareParams
from cohortlens.operators.cleaning import clean
from cohortlens.operators.selection import select_cohorts
from cohortlens.plans.report import Comparison, compare, compare_and_write

__all__ = [
    "CompareParams",
    "Comparison",
    "clean",
    "compare",
    "compare_and_write",
    "select_cohorts",
]
