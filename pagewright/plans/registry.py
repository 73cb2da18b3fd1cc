"""Every query of the library and, where SQL can express it, the same in DuckDB SQL."""

from pagewright.plans import run_queries, table_queries  # noqa: F401 - register their queries
from pagewright.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
