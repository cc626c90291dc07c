"""Bounded breadth-first walks over a link graph, one join per level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlspike.functions import url as U
from marlspike.session import staged


def crawl(edges: DataFrame, seeds: DataFrame, max_depth: int = 3) -> DataFrame:
    """node, depth of everything reachable from `seeds` (node) over `edges` (src, dst) in at most `max_depth` steps.

    Each level joins only the newest nodes and drops what was seen; levels are stored, so the plan stays
    one join deep and a lost executor repeats nothing.
    """
    seen = staged(seeds.filter("node IS NOT NULL").select("node").distinct().withColumn("depth", F.lit(0)), "crawl")
    frontier = seen
    for depth in range(1, max_depth + 1):
        found = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).filter("node IS NOT NULL").distinct()
        frontier = staged(found.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)), "crawl")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def column_budget(pages: DataFrame, per_column: int = 3, columns: int = 12) -> DataFrame:
    """Of list pages (url, host, ord) of each host the first `columns` columns and of each the first `per_column` pages."""
    keyed = pages.withColumn("column", U.column_key(F.col("url")))
    first = keyed.groupBy("host", "column").agg(F.min("ord").alias("first"))
    chosen = first.withColumn("n", F.row_number().over(Window.partitionBy("host").orderBy("first"))).filter(F.col("n") <= columns).select("host", "column")
    placed = keyed.withColumn("place", F.row_number().over(Window.partitionBy("host", "column").orderBy("ord"))).filter(F.col("place") <= per_column)
    return placed.join(chosen, ["host", "column"]).select("host", "column", "url", "ord", "place")


def coverage(sites: DataFrame) -> DataFrame:
    """`sites` (fetched, failed, sitemap, robots, depth, max_depth, queued) with fail_rate, gaps and confidence."""
    rate = F.coalesce(F.try_divide(F.col("failed"), F.col("fetched") + F.col("failed")), F.lit(0.0))
    gaps = F.array_compact(F.array(F.when(~F.col("sitemap"), "no sitemap"), F.when(~F.col("robots"), "no robots"), F.when(F.col("queued") > 0, "queue not empty"), F.when(rate > 0.3, "many failures")))
    sure = (F.col("sitemap") & F.col("robots")) | ((F.col("depth") >= F.col("max_depth")) & (F.col("queued") == 0))
    return sites.withColumn("fail_rate", rate).withColumn("gaps", gaps).withColumn("confidence", F.when((F.col("fetched") == 0) | (rate > 0.3), "low").when(sure, "high").otherwise("medium"))


def as_discovered(pages: DataFrame, attachments: DataFrame, feeds: DataFrame) -> DataFrame:
    """A walk's addresses (url, ord) as discovered ones, of the sources crawl, crawl-attachment and crawl-feed, merged."""
    from marlspike.operators.merge import merge_discovered

    sources = ((pages, "crawl"), (attachments, "crawl-attachment"), (feeds, "crawl-feed"))
    parts = [d.select("url", F.struct(F.lit(n).alias("part"), "ord").alias("ord"), F.lit(s).alias("source"), F.lit(None).cast("string").alias("mime")) for n, (d, s) in enumerate(sources)]
    return merge_discovered(parts[0].unionByName(parts[1]).unionByName(parts[2]))
