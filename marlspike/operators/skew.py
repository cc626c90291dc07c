"""Joins of a large table with a keyed dictionary when one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the rows on; so there are at most 1/share hot keys to broadcast.
HOT_SHARE = 0.001


def join_dictionary(rows: DataFrame, dictionary: DataFrame, keys: list[str], count: str, share: float = HOT_SHARE) -> DataFrame:
    """Inner join of `rows` with `dictionary` (one row per key, `count` = rows that have the key).

    Keys with at least `share` of all counted rows (at most 1/share keys, whatever the data) are joined
    by broadcast and never shuffled; the others by Catalyst's own choice, whose hottest key then
    holds less than `share` of the rows. `dictionary` must be a stored table, as it is read three times.
    Null keys match nothing.
    """
    total = dictionary.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n")).first()["n"]
    limit = max(1.0, total * share)
    hot = dictionary.filter(F.col(count) >= limit).drop(count)
    cold = dictionary.filter(F.col(count) < limit).drop(count)
    if hot.isEmpty():
        return rows.join(cold, keys, "inner")
    hot_keys = hot.select(*keys)
    of_hot = rows.join(F.broadcast(hot), keys, "inner")
    of_cold = rows.join(F.broadcast(hot_keys), keys, "left_anti").join(cold, keys, "inner")
    return of_hot.unionByName(of_cold)

