"""Where query modules register a Spark callable and, if SQL can say it, its oracle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


def rd(col, n: int = 6, name: str | None = None) -> Column:
    """Rounded output column that keeps its name."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, n).alias(name or col)
