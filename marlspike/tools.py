"""The public surface: one function a tool, each `tool(spark, tables, **args) -> DataFrame`.

`tables` maps names to DataFrames. Tools that would call a remote service read its captured responses
from `tables["responses"]` (request_url, query, status, body, and `source`, the parser's name); nothing
here opens a connection. `tables["store"]` is a folder for the monitoring tools.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.functions import html as H
from marlspike.functions import text as T
from marlspike.functions import url as U
from marlspike.operators import classify, crawl, evaluate, merge, monitor
from marlspike.sources import responses as R
from marlspike.sources.documents import read_documents
from marlspike.sources.store import Store, cached
from marlspike.streaming.scans import scan_batch

Tables = dict[str, DataFrame]
TOOLS: dict[str, Callable[..., DataFrame]] = {}

#: Channels by tool, in the order their rows are joined.
WEB = ("parallel", "searxng", "duckduckgo", "bing")
ACADEMIC = ("semantic-scholar", "arxiv", "crossref", "openalex")


def tool(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    TOOLS[function.__name__] = function
    return function


def _channel(tables: Tables, name: str, query: str | None, limit: int = 0) -> DataFrame:
    captured = tables["responses"].filter(F.col("source") == name)
    if query is not None:
        captured = captured.filter(F.col("query") == query)
    return R.parse_json(captured, name, limit) if name in R.JSON_SOURCES else R.parse_blocks(captured, name, limit)


def _channels(tables: Tables, names: tuple[str, ...], query: str | None, limit: int = 0) -> DataFrame:
    return merge.union_channels(*[_channel(tables, n, query, limit) for n in names])


def _distinct(rows: DataFrame) -> DataFrame:
    keyed = rows.withColumn("_key", U.normalize_url(F.col("url")))
    return merge.keep_first(keyed, [F.col("query"), F.col("_key")], [F.col("src_ord"), F.col("ord")]).drop("_key")


@tool
def search_web(spark: SparkSession, tables: Tables, query: str | None = None, engines: tuple[str, ...] = WEB, per_engine: int = 10) -> DataFrame:
    """All channels, first of each address; a channel that failed gives no rows and one in `channel_errors`."""
    return _distinct(_channels(tables, engines, query, per_engine))


def meta_with_retry(tables: Tables, query: str | None = None, limit: int = 10) -> DataFrame:
    """Results of the meta search; for a query without any, those of the captured search for its simplified form (source `searxng-simple`)."""
    first = _channel(tables, "searxng", query, limit)
    again = tables["responses"].filter("source = 'searxng-simple'")
    return merge.fallback(first, R.parse_json(again if query is None else again.filter(F.col("query") == query), "searxng", limit))


@tool
def channel_errors(spark: SparkSession, tables: Tables) -> DataFrame:
    return tables["responses"].select("source", "query", R.error_class(F.col("status"), F.col("body")).alias("error")).filter("error IS NOT NULL")


@tool
def search_build_query(spark: SparkSession, tables: Tables) -> DataFrame:
    q = F.col("query")
    return tables["queries"].select("query", T.query_variants(q).alias("variants"), T.fan_out(q).alias("fan_out"), T.route(q).alias("route"))


@tool
def search_serp(spark: SparkSession, tables: Tables, query: str | None = None, limit: int = 10) -> DataFrame:
    return merge.fallback(_channel(tables, "serper-google", query, limit), _channel(tables, "tavily", query, limit))


@tool
def search_deep(spark: SparkSession, tables: Tables, query: str | None = None, sources: int = 5, per_domain: int = 2, engines: tuple[str, ...] = WEB) -> DataFrame:
    """Ranked sources with the text of their page (`tables["pages"]`: url, text) cut to 1500 characters."""
    rows = _channels(tables, engines, query).withColumn("result_id", F.monotonically_increasing_id()).withColumn("ord", F.col("src_ord") * 1000 + F.col("ord"))
    ranked = merge.ranked_with_domain_cap(merge.merge_results(rows), max(1, per_domain), min(10, max(1, sources)))
    pages = tables["pages"].select(U.normalize_url(F.col("url")).alias("key"), F.left("text", F.lit(1500)).alias("content"))
    return ranked.join(pages, "key", "left").select("query", "rank", "title", F.col("key").alias("url"), "domain", "engines", F.left("snippet", F.lit(400)).alias("excerpt"), "content")


@tool
def search_site(spark: SparkSession, tables: Tables, site: str, query: str | None = None, engines: tuple[str, ...] = WEB) -> DataFrame:
    return search_web(spark, tables, query, engines).filter(F.col("url").contains(site))


@tool
def search_academic(spark: SparkSession, tables: Tables, query: str | None = None, source: str | None = None, limit: int = 8) -> DataFrame:
    return _channels(tables, (source,) if source else ACADEMIC, query, limit)


@tool
def search_patent(spark: SparkSession, tables: Tables, query: str | None = None) -> DataFrame:
    return merge.fallback(*[_channel(tables, n, query) for n in ("serper-google", "duckduckgo", "bing")])


@tool
def search_github(spark: SparkSession, tables: Tables, query: str | None = None, kind: str = "repo", limit: int = 8) -> DataFrame:
    return _channel(tables, f"github-{kind}", query, limit)


@tool
def search_community(spark: SparkSession, tables: Tables, query: str | None = None, limit: int = 10) -> DataFrame:
    return _channels(tables, ("hackernews", "telegram"), query, limit)


@tool
def lookup_whois(spark: SparkSession, tables: Tables) -> DataFrame:
    return R.parse_registration(tables["responses"].filter("source = 'rdap'"))


@tool
def enum_subdomains(spark: SparkSession, tables: Tables, limit: int = 30) -> DataFrame:
    found = merge.fallback(*[R.parse_certificates(tables["responses"].filter(F.col("source") == s)) for s in ("crt.sh", "certspotter")])
    return merge.top_per_group(found, [F.col("query")], [F.col("ord")], limit).select("query", "host", "rank")


@tool
def lookup_dns_history(spark: SparkSession, tables: Tables, limit: int = 8) -> DataFrame:
    rows = R.usable(tables["responses"].filter("source = 'dns-history'")).select("query", F.posexplode(F.slice(F.try_variant_get(F.try_parse_json("body"), "$.records", "array<variant>"), 1, limit)).alias("n", "r"))
    return rows.select("query", "n", F.try_variant_get("r", "$.first_seen", "string").alias("first_seen"), F.try_variant_get("r", "$.values[0].ip", "string").alias("value"))


@tool
def search_shodan(spark: SparkSession, tables: Tables, query: str | None = None, limit: int = 8) -> DataFrame:
    return _channel(tables, "shodan", query, limit)


@tool
def archive_search(spark: SparkSession, tables: Tables, since: str = "", until: str = "~", limit: int = 20) -> DataFrame:
    rows = R.parse_archive_index(tables["responses"].filter("source = 'wayback'")).filter((F.col("status") == "200") & F.col("ts").between(since, until))
    return merge.top_per_group(rows, [F.col("query")], [F.col("ts")], limit)


@tool
def archive_restore(spark: SparkSession, tables: Tables) -> DataFrame:
    """The text of the snapshot to restore (`tables["pages"]`: url, ts, html)."""
    chosen = R.snapshot_to_restore(R.parse_archive_index(tables["responses"].filter("source = 'wayback'")))
    return chosen.join(tables["pages"], ["url", "ts"]).select("url", "ts", H.main_text(F.col("html")).alias("text"))


@tool
def fetch_page(spark: SparkSession, tables: Tables, limit: int = 20000) -> DataFrame:
    return R.page_text(tables["pages"], limit)


@tool
def fetch_tor(spark: SparkSession, tables: Tables) -> DataFrame:
    """The transport is not rebuilt; daemon and circuit of captured checks stay two facts."""
    return tables["checks"].select("url", F.col("daemon").alias("daemon_up"), F.col("circuit").alias("circuit_up"))


@tool
def fetch_robust(spark: SparkSession, tables: Tables) -> DataFrame:
    tried = tables["attempts"].withColumn("challenge", classify.challenge(F.col("content"), F.col("status")))
    return R.best_attempt(tried)


@tool
def search_share(spark: SparkSession, tables: Tables, query: str | None = None, limit: int = 15) -> DataFrame:
    rows = _channels(tables, ("torznab", "magnet-rows"), query).withColumn("key", R.share_key(F.col("extra")["magnet"], F.col("url")))
    first = merge.keep_first(rows, [F.col("query"), F.col("key")], [F.col("src_ord"), F.col("ord")])
    return merge.top_per_group(first, [F.col("query")], [F.col("src_ord"), F.col("ord")], limit).withColumn("size_bytes", R.size_bytes(F.col("extra")["size"]))


@tool
def search_code(spark: SparkSession, tables: Tables, limit: int = 15) -> DataFrame:
    return merge.top_per_group(R.parse_code_stream(tables["responses"].filter("source = 'code-stream'")), [F.col("query")], [F.col("ord")], limit)


@tool
def search_darkweb(spark: SparkSession, tables: Tables, query: str | None = None) -> DataFrame:
    return merge.keep_first(_channel(tables, "duckduckgo", query), [F.col("query"), F.col("url")], [F.col("ord")])


@tool
def search_leaks(spark: SparkSession, tables: Tables) -> DataFrame:
    """`tables["secrets"]`: id and SHA-1 in capitals; `tables["ranges"]`: prefix, suffix, n. No plain secret enters a table."""
    probe = tables["secrets"].select("id", F.substring("sha1", 1, 5).alias("prefix"), F.substring("sha1", 6, 35).alias("suffix"))
    return probe.join(tables["ranges"], ["prefix", "suffix"], "left").select("id", F.col("n").isNotNull().alias("leaked"), F.coalesce("n", F.lit(0)).alias("n"))


@tool
def search_quota(spark: SparkSession, tables: Tables) -> DataFrame:
    return evaluate.channel_counts(tables["responses"], "source")


@tool
def search_cache(spark: SparkSession, tables: Tables) -> DataFrame:
    return cached(tables["cache"], F.current_timestamp())


@tool
def discover_urls(spark: SparkSession, tables: Tables) -> DataFrame:
    captured = tables["responses"]
    index, _ = R.parse_crawl_index(captured.filter("source = 'commoncrawl'"))
    hosts = R.parse_certificates(captured.filter("source = 'crt.sh'"), drop_wildcards=True).select("query", F.lit("crtsh").alias("source"), F.concat(F.lit("https://"), "host", F.lit("/")).alias("url"))
    every = merge.union_channels(index, R.parse_archive_index(captured.filter("source = 'wayback'")), hosts).withColumn("ord", F.col("src_ord") * F.lit(1 << 40) + F.monotonically_increasing_id())
    merged = merge.merge_discovered(every)
    return merged.filter(~U.is_meta_file(F.col("key"))).withColumn("attachment", U.is_attachment(F.col("key"), F.col("mime")))


@tool
def discover_site(spark: SparkSession, tables: Tables, max_depth: int = 3) -> DataFrame:
    """Pages reachable over the links of captured pages (`tables["pages"]`: url, html) from `tables["seeds"]` (node)."""
    links = tables["pages"].select(F.col("url").alias("src"), F.explode(H.same_site_links(F.col("html"), F.col("url"))).alias("dst"))
    links = links.filter(~U.is_asset(F.col("dst"))).distinct()
    found = crawl.crawl(links, tables["seeds"], max_depth)
    return found.select(F.col("node").alias("url"), "depth", U.is_attachment(F.col("node")).alias("attachment"), U.is_content_page(F.col("node")).alias("content_page"))


@tool
def fetch_document(spark: SparkSession, tables: Tables, path: str, max_rows: int = 2000) -> DataFrame:
    return read_documents(spark, path, max_rows)


@tool
def intel_watch(spark: SparkSession, tables: Tables, store: str, target_id: str | None = None, at: int = 0, remove: bool = False, **fields: str) -> DataFrame:
    """List targets, or set fields of one, or remove one."""
    kept = Store(spark, store)
    if target_id and remove:
        kept.remove_target(target_id, at)
    elif target_id:
        kept.patch_target(target_id, at, **fields)
    return kept.targets()


@tool
def intel_scan(spark: SparkSession, tables: Tables, store: str) -> DataFrame:
    counts = scan_batch(Store(spark, store), tables["candidates"])
    return spark.createDataFrame([(k, v) for k, v in counts.items()], "name string, n bigint")


@tool
def intel_list(spark: SparkSession, tables: Tables, store: str, target_id: str | None = None, status: str | None = None, limit: int = 20) -> DataFrame:
    return monitor.list_items(Store(spark, store).items().withColumn("found_ts", F.col("found_at")), target_id, status, None, limit)


@tool
def intel_digest(spark: SparkSession, tables: Tables, store: str, per_target: int = 10) -> DataFrame:
    view = Store(spark, store).items().withColumn("found_ts", F.col("found_at")).withColumn("published_ts", F.col("published_at"))
    return monitor.digest_view(view.filter("status = 'new'"), per_target)


@tool
def intel_prune(spark: SparkSession, tables: Tables, store: str, dry_run: bool = True) -> DataFrame:
    """Unread structural pages; unless it is a dry run they are marked dropped."""
    kept = Store(spark, store)
    found = kept.items().filter("status = 'new'").filter(U.is_structural(F.col("url"))).select("id", "url")
    if not dry_run:
        kept.update_status(found, "dropped")
    return found
