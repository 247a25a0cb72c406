"""Region-and-quarter analytics for digital payments, insurance and app use, on Spark."""

from paylens.plans.cases import CASES, QUERIES, CaseYears, run_case
from paylens.plans.explorer import explore
from paylens.plans.model import FactModel

__all__ = ["CASES", "QUERIES", "CaseYears", "FactModel", "explore", "run_case"]
