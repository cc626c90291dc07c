"""Bounded samples for fitting classifiers: distinct rows of least hash, without shuffling the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_RANGE = 1 << 40


def least_hashed(rows: DataFrame, keys: list[str], bound: int, label: str | None = None) -> DataFrame:
    """At most `bound` rows (of each value of `label`), one for each of the least-hashed distinct `keys`.

    An approximate distinct count (fixed-size sketches, combined map-side) tells which share of the hash
    range holds several times the bound; only rows in it are made distinct and ordered. The same rows come
    out of any partitioning, and a larger corpus gives a sample of the same size. Labels are few.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(_RANGE))
    by = F.col(label) if label else F.lit(0)
    distinct = {r["label"]: r["n"] for r in rows.groupBy(by.alias("label")).agg(F.approx_count_distinct(place).alias("n")).collect()}
    within = F.lit(False)
    for value, n in distinct.items():
        limit = _RANGE if n <= 4 * bound else int(_RANGE * 4 * bound / n)
        within = within | ((by == F.lit(value)) & (place < limit))
    few = rows.filter(within).dropDuplicates(keys + ([label] if label else []))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.xxhash64(*keys), *keys))
    return few.withColumn("_rank", rank).filter(F.col("_rank") <= bound).drop("_rank")
