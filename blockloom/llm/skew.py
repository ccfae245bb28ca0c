"""Joins on keys that may hold a third of all rows: hot keys are looked up by broadcast, all others by a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than one in so many rows, so there are at most as many hot keys.
SHARE = 1000
LEAST_ROWS = 100


def lookup_join(rows: DataFrame, table: DataFrame, key: str, n: str, keep_all: bool = False) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each ``key`` and in ``n`` how many of ``rows`` have it.

    ``table`` is read three times, so it should be written. The rows of a hot key stay where they are; at most SHARE keys are
    broadcast. With ``keep_all`` rows without a key in the table stay, with nulls. Null keys match nothing.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    limit = max(LEAST_ROWS, total // SHARE)
    added = [c for c in table.columns if c not in (key, n)]
    hot = table.where(F.col(n) > limit).select(key, F.lit(True).alias("__hot"), *(F.col(c).alias(f"__{c}") for c in added))
    marked = rows.join(F.broadcast(hot), key, "left")
    near = marked.where("__hot").select(*rows.columns, *(F.col(f"__{c}").alias(c) for c in added))
    far = marked.where("__hot is null").select(*rows.columns).join(table.where(F.col(n) <= limit).select(key, *added).hint("merge"), key, "left" if keep_all else "inner")
    return near.unionByName(far.select(*rows.columns, *added))
