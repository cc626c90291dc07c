"""Declarative mapping of JSON responses to items: a path to the items, names of their fields, an address template."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspike.functions.instants import with_instants
from marlspike.functions.url import render_template
from marlspike.operators.instants import json_path


@dataclass(frozen=True)
class ApiSpec:
    items_path: str
    id_path: str = "id"
    title_path: str = "title"
    time_path: str | None = None
    url_template: str | None = None
    max_items: int | None = None
    zone: str = "UTC"
    month_first: bool = False


def _field(item: Column, name: str) -> Column:
    return F.nullif(F.try_variant_get(item, json_path(F.lit(name)), "string"), F.lit(""))


def map_items(responses: DataFrame, spec: ApiSpec) -> tuple[DataFrame, DataFrame]:
    """(items, notes) of responses (query, body).

    items: query, url, title, published_at, source, ord. notes: query, raw (items in the response), skipped (no
    object, or no id or template field), no_time, truncated, error (path missing or no list). The bound on
    items cuts after mapping, in order, and is reported; 0 is a bound like any other.
    """
    doc = F.try_parse_json("body")
    listed = F.try_variant_get(doc, json_path(F.lit(spec.items_path)), "array<variant>")
    found = F.try_variant_get(doc, json_path(F.lit(spec.items_path)), "variant")
    bodies = responses.select("query", F.when(doc.isNull(), "no JSON").when(found.isNull(), "no such path").when(listed.isNull(), "no list").alias("error"), listed.alias("items"))
    rows = bodies.filter("error IS NULL").select("query", F.posexplode("items").alias("ord", "item"))
    item = F.col("item")
    names = re.findall(r"\{(\w+)\}", spec.url_template or "")
    url = render_template(spec.url_template, {n: _field(item, n) for n in names}) if spec.url_template else _field(item, spec.id_path)
    is_object = F.coalesce(F.schema_of_variant(item).startswith("OBJECT"), F.lit(False))
    raw_time = _field(item, spec.time_path) if spec.time_path else F.lit(None).cast("string")
    mapped = rows.select("query", "ord", F.when(is_object, url).alias("url"), _field(item, spec.title_path).alias("title"), raw_time.alias("raw"), F.lit(spec.zone).alias("zone"), F.lit(spec.month_first).alias("month_first"))
    # publishing times from 1990 to a day from now are plausible
    timed = with_instants(mapped, "raw", "zone", "month_first", "published_at", (1990, 2261), F.current_timestamp() + F.expr("INTERVAL 1 DAY"))
    usable = timed.filter("url IS NOT NULL").withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("ord")))
    kept = usable if spec.max_items is None else usable.filter(F.col("n") <= spec.max_items)
    counts = timed.groupBy("query").agg(F.count(F.lit(1)).alias("raw"), F.count_if(F.col("url").isNull()).alias("skipped"), F.count_if(F.col("url").isNotNull() & F.col("published_at").isNull() & F.lit(spec.time_path is not None)).alias("no_time"))
    mapped_n = F.col("raw") - F.col("skipped")
    cut = F.greatest(mapped_n - spec.max_items, F.lit(0)) if spec.max_items is not None else F.lit(0)
    notes = bodies.select("query", "error").join(counts.withColumn("truncated", cut.cast("bigint")), "query", "left")
    return kept.select("query", "url", "title", "published_at", F.lit("api").alias("source"), "ord"), notes


def relative_dates(template: str, today) -> str:
    """`{days:N}` as the UTC date N days ago; more than 3650 days or another form stays as it is. For settings, on the driver."""
    from datetime import timedelta

    def put(match: re.Match) -> str:
        days = int(match[1])
        return (today - timedelta(days=days)).isoformat() if days <= 3650 else match[0]

    return re.sub(r"\{days:(\d{1,9})\}", put, template)


def age_hours(published: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(published)) / 3_600_000_000


def age_label(published: Column, now: Column, origin: Column | None = None) -> Column:
    """unknown, future, hours below 48, else days; `≈` marks a time taken from the page, `~` one from the address."""
    h = age_hours(published, now)
    label = F.when(h.isNull(), "unknown").when(h < 0, F.format_string("in %.1fh", -h)).when(h < 48, F.format_string("%.1fh ago", h)).otherwise(F.format_string("%.1fd ago", h / 24))
    if origin is None:
        return label
    return F.when(h.isNull(), label).otherwise(F.concat(F.when(origin == "page", "≈").when(origin == "url", "~").otherwise(""), label))


def inherit_times(attachments: DataFrame, pages: DataFrame) -> DataFrame:
    """`attachments` (url, page, own_date) with at and origin: the date in their own address, else their page's time (page, at)."""
    joined = attachments.join(pages.select("page", F.col("at").alias("page_at")), "page", "left")
    return joined.withColumn("at", F.coalesce("own_date", "page_at")).withColumn("origin", F.when(F.col("own_date").isNotNull(), "url").when(F.col("page_at").isNotNull(), "page")).drop("page_at")


def resolve_redirects(results: DataFrame, redirects: DataFrame, first: int = 6) -> DataFrame:
    """The first `first` results of each query with the target of their redirect (url, target), where known."""
    targets = redirects.groupBy("url").agg(F.min("target").alias("target"))
    joined = results.join(targets, "url", "left")
    return joined.withColumn("url", F.when(F.col("ord") <= first, F.coalesce("target", "url")).otherwise(F.col("url"))).drop("target")


def probe_endpoint(candidates: DataFrame, responses: DataFrame) -> DataFrame:
    """Of each site's search candidates (host, request_url, prio) the best whose captured response answers (answers boolean):
    host, request_url, state (found, none, untried)."""
    joined = candidates.join(responses.select("request_url", "answers"), "request_url", "left")
    best = joined.groupBy("host").agg(F.min_by("request_url", F.when(F.col("answers"), F.col("prio"))).alias("request_url"), F.count("answers").alias("tried"))
    return best.select("host", "request_url", F.when(F.col("request_url").isNotNull(), "found").when(F.col("tried") > 0, "none").otherwise("untried").alias("state"))
