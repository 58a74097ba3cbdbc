"""All registered queries."""

from workload import annotation, draws, formats, population, results, schedules  # noqa: F401
from workload.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
