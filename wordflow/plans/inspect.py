"""What a query's physical plan holds, for tests and reviews."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

#: Operators that compare all rows with all others.
QUADRATIC = ("BroadcastNestedLoopJoin", "CartesianProduct")


def physical(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def quadratic_nodes(df: DataFrame) -> list[str]:
    """Names of nested-loop operators in the plan."""
    return [n for n in QUADRATIC if n in physical(df)]


def exchanges(df: DataFrame) -> int:
    """Shuffles in the plan before adaptive execution."""
    return len(re.findall(r"\bExchange (?:hash|range|single|rebalance|round)", physical(df), re.IGNORECASE))


def read_columns(df: DataFrame) -> list[str]:
    """Columns of all scans, as the readers get them."""
    return sorted({c.split(":")[0] for part in re.findall(r"ReadSchema: struct<([^>]*)", physical(df)) for c in part.split(",") if c})
