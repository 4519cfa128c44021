"""Maintenance as differences: what would change, as a frame; applying it is a write of the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rewrite_diff(df: DataFrame, key: str, column: str, new: Column) -> DataFrame:
    """key, old, new where the rewritten value differs; nulls count as values."""
    return df.select(key, F.col(column).alias("old"), new.alias("new")).where(~F.col("old").eqNullSafe(F.col("new")))


def date_outcomes(df: DataFrame, stored: str, exact: str, approximate: str) -> Column:
    """What becomes of a stored date, given an exact and an approximate other one."""
    s, e, a = F.col(stored), F.col(exact), F.col(approximate)
    return F.when(e.isNotNull() & s.eqNullSafe(e), "unchanged").when(e.isNotNull(), "exact").when(a.isNotNull() & ~(F.trunc(s, "month").eqNullSafe(a)), "approximate").when(a.isNotNull(), "unchanged").otherwise("manual")


def cascade(parents: DataFrame, children: dict[str, tuple[DataFrame, str]], key: str, gone: DataFrame) -> dict[str, DataFrame]:
    """All frames without the rows that refer to gone parents; rows with a null reference stay."""
    out = {"parents": parents.join(gone.select(key), key, "left_anti")}
    for name, (df, reference) in children.items():
        out[name] = df.join(gone.select(F.col(key).alias(reference)), reference, "left_anti")
    return out
