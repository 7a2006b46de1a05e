"""All registered queries of the numerical operators."""

from gridflux.plans import grids, programs, signals, solvers, specials, statistics, streams  # noqa: F401  (importing registers)
from gridflux.plans.base import QUERIES, SQL  # noqa: F401
