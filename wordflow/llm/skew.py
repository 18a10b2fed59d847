"""Joins of a table to a side of one row a key, where a few keys may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot above LEAST rows and a SHARE-th of all: at most SHARE keys are.
LEAST, SHARE = 200, 500


def join_keyed(rows: DataFrame, side: DataFrame, key: str, weight: str, total: int, how: str = "inner", least: int = LEAST) -> DataFrame:
    """``rows`` joined (inner or left) to ``side`` on ``key``; ``weight``: rows of each key, in ``side``.

    The keys of more than max(least, total / SHARE) rows are broadcast, so their rows stay
    where they are; there are at most SHARE of them, since weights add up to ``total``.
    All other keys meet by shuffle. Rows with a null key match nothing. ``weight`` goes.
    """
    limit = max(least, total // SHARE)
    hot = F.broadcast(side.where(F.col(weight) > limit).drop(weight))
    cold = side.where(F.col(weight) <= limit).drop(weight)
    rest = rows.join(F.broadcast(side.where(F.col(weight) > limit).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(cold, key, how))
