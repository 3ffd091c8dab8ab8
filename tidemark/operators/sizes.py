"""Broadcasting behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: Rows that a broadcast side may have.
BROADCAST_ROWS = 20_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, else df: the planner then shuffles both sides.
    The check reads rows + 1 rows at most."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> list[Row] | None:
    """The rows of df if there are at most `rows`, else None; no more than rows + 1 are read."""
    got = df.limit(rows + 1).collect()
    return got if len(got) <= rows else None
