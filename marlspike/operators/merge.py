"""Merging and ranking rows of many channels. Row order is a column (`ord`), never the order of a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspike.functions import url as U
from marlspike.functions.text import rank_terms


def union_channels(*channels: DataFrame) -> DataFrame:
    """UNION ALL in the order given; `src_ord` numbers the channels."""
    out = None
    for number, channel in enumerate(channels):
        part = channel.withColumn("src_ord", F.lit(number))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def keep_first(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key. Ties of the order need a unique last column."""
    place = "_place" if "_place" not in rows.columns else "_place_"
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(place) == 1).drop(place)


def top_per_group(rows: DataFrame, group: list[Column], order: list[Column], limit: int, rank: str = "rank") -> DataFrame:
    """The first `limit` rows of each group, with their rank. Spark limits the groups before it shuffles."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= limit)


def merge_results(rows: DataFrame, group: str = "query") -> DataFrame:
    """One row per query and normalised address: first title, longest snippet, set of engines, first place.

    A plain aggregation with map-side combine, so a query that holds a third of all rows spreads over its
    addresses. Null urls are left out.
    """
    keyed = rows.filter("url IS NOT NULL").withColumn("key", U.normalize_url(F.col("url")))
    place = F.struct("ord", "result_id")
    return keyed.groupBy(group, "key").agg(
        F.min_by("title", F.when(F.col("title").isNotNull(), place)).alias("title"),
        F.max_by("snippet", F.struct(F.length("snippet"), -F.col("ord"), -F.col("result_id"))).alias("snippet"),
        F.array_sort(F.collect_set("source")).alias("engines"),
        F.min(place).alias("place"),
    )


def relevance(engines: Column, snippet: Column, title: Column, query: Column) -> Column:
    """Ten for each engine, up to three for a long snippet, three for each word of the question that title or snippet holds."""
    text = F.lower(F.concat_ws(" ", title, snippet))
    hits = F.size(F.filter(rank_terms(query), lambda t: text.contains(t)))
    return F.size(engines) * 10 + F.least(F.lit(3), F.floor(F.coalesce(F.length(snippet), F.lit(0)) / 200)) + 3 * hits


def ranked_with_domain_cap(merged: DataFrame, per_domain: int = 2, want: int = 10) -> DataFrame:
    """Per query the best `want` addresses with at most `per_domain` of one domain. The cap does not depend
    on later picks, so it is a window; it runs first, which leaves little for the second."""
    scored = merged.withColumn("score", relevance(F.col("engines"), F.col("snippet"), F.col("title"), F.col("query"))).withColumn("domain", U.domain_of(F.col("key")))
    order = [F.col("score").desc(), F.col("place").asc()]
    capped = top_per_group(scored, [F.col("query"), F.col("domain")], order, per_domain, "of_domain")
    return top_per_group(capped, [F.col("query")], order, want).drop("of_domain")


def merge_discovered(rows: DataFrame) -> DataFrame:
    """One row per discovered address (url, source, ord; mime, status, ts where there are): first source, set of sources, first
    type, status and time that is not empty."""
    later = [F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("ord"))).alias(c) for c in ("status", "ts") if c in rows.columns]
    return rows.filter("url IS NOT NULL").groupBy(U.discovered_key(F.col("url")).alias("key")).agg(
        *later,
        F.min_by("source", F.when(F.col("source").isNotNull(), F.col("ord"))).alias("source"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.min_by("mime", F.when(F.coalesce(F.col("mime"), F.lit("")) != "", F.col("ord"))).alias("mime"),
        F.min("ord").alias("ord"),
    )


def channel_contribution(merged: DataFrame) -> DataFrame:
    """engine, results: to how many merged rows each engine contributed."""
    return merged.select(F.explode("engines").alias("engine")).groupBy("engine").agg(F.count(F.lit(1)).alias("results"))


def fallback(*channels: DataFrame, key: str = "query") -> DataFrame:
    """For each query the rows of the first channel that has any for it; null is a query of its own."""
    rows = union_channels(*channels)
    first = rows.groupBy(F.col(key).alias("_of")).agg(F.min("src_ord").alias("_first"))
    return rows.join(first, F.col(key).eqNullSafe(F.col("_of")) & (F.col("src_ord") == F.col("_first")), "left_semi").drop("src_ord")
