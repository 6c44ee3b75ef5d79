"""All queries. Importing the modules fills the registry."""

from workload import indexed, live, searching, texts, upkeep  # noqa: F401
from workload.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
