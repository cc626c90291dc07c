"""Parsers of captured responses. The input is a table (request_url, query, status, body); the output of a
result parser is RESULT rows: query, source, ord, title, url, snippet, extra. Nothing here opens a connection.

JSON sources are declared as a path to their items and expressions over one item (a VARIANT); block
sources (markup, feeds) as a separator and expressions over one block. All run in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspike.functions import html as H
from marlspike.functions import url as U

RESULT = ["query", "source", "ord", "title", "url", "snippet", "extra"]


def error_class(status: Column, body: Column) -> Column:
    """null where the response is usable; else rate-limit, timeout, http-error or empty."""
    return F.when(status == 429, "rate-limit").when(status.isin(408, 504, 524), "timeout").when((status < 200) | (status >= 300), "http-error").when(body.isNull(), "empty")


def text(item: Column, path: str) -> Column:
    return F.try_variant_get(item, path, "string")


def string(item: Column, path: str) -> Column:
    """The value if it is a string; lists, objects and numbers are none."""
    return F.when(F.schema_of_variant(F.try_variant_get(item, path, "variant")) == "STRING", text(item, path))


def number(item: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(item, path, "double"), F.lit(0.0)).cast("bigint")


def texts(item: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(item, path, "array<string>"), F.array().cast("array<string>"))


def or_else(first: Column, second: Column) -> Column:
    return F.coalesce(F.nullif(first, F.lit("")), second)


def cut(value: Column, limit: int) -> Column:
    return F.left(value, F.lit(limit))


@dataclass(frozen=True)
class JsonSource:
    items: str
    title: Callable[[Column], Column]
    url: Callable[[Column], Column]
    snippet: Callable[[Column], Column]
    extra: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    #: Descending order of the items, where the source ranks by a value of its own.
    order: Callable[[Column], Column] | None = None
    source: Callable[[Column], Column] | None = None


@dataclass(frozen=True)
class BlockSource:
    separator: str
    title: Callable[[Column], Column]
    url: Callable[[Column], Column]
    snippet: Callable[[Column], Column]
    extra: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    keep: Callable[[Column], Column] | None = None


def _group(pattern: str) -> Callable[[Column], Column]:
    return lambda block: F.regexp_extract(block, pattern, 1)


def _label(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])


JSON_SOURCES: dict[str, JsonSource] = {
    "tavily": JsonSource("$.results", lambda i: text(i, "$.title"), lambda i: U.normalize_url(text(i, "$.url")), lambda i: text(i, "$.content")),
    "serper-google": JsonSource("$.organic", lambda i: text(i, "$.title"), lambda i: U.normalize_url(text(i, "$.link")), lambda i: text(i, "$.snippet")),
    "deepseek": JsonSource("$.results", lambda i: or_else(text(i, "$.title"), text(i, "$.url")), lambda i: U.normalize_url(text(i, "$.url")), lambda i: cut(or_else(text(i, "$.summary"), text(i, "$.snippet")), 600), order=lambda i: F.coalesce(F.try_variant_get(i, "$.rerank_score", "double"), F.lit(0.0))),
    "parallel": JsonSource("$.results", lambda i: or_else(text(i, "$.title"), text(i, "$.url")), lambda i: U.normalize_url(text(i, "$.url")), lambda i: cut(F.when(F.size(texts(i, "$.excerpts")) > 0, F.array_join(texts(i, "$.excerpts"), " … ")).otherwise(text(i, "$.snippet")), 600)),
    "searxng": JsonSource("$.results", lambda i: or_else(text(i, "$.title"), text(i, "$.url")), lambda i: U.normalize_url(text(i, "$.url")), lambda i: cut(F.regexp_replace(text(i, "$.content"), r"\s+", " "), 400), source=lambda i: F.when(F.size(texts(i, "$.engines")) > 0, F.concat(F.lit("searxng:"), F.array_join(texts(i, "$.engines"), "+"))).otherwise("searxng")),
    "semantic-scholar": JsonSource("$.data", lambda i: text(i, "$.title"), lambda i: or_else(text(i, "$.url"), _label("https://api.semanticscholar.org/paper/", text(i, "$.paperId"))), lambda i: or_else(cut(text(i, "$.abstract"), 300), _label("venue: ", text(i, "$.venue"), " · citations: ", number(i, "$.citationCount").cast("string"), " · year: ", text(i, "$.year"))), {"year": lambda i: text(i, "$.year"), "citations": lambda i: number(i, "$.citationCount").cast("string")}),
    "crossref": JsonSource("$.message.items", lambda i: F.coalesce(string(i, "$.title[0]"), string(i, "$.title")), lambda i: or_else(text(i, "$.URL"), _label("https://doi.org/", text(i, "$.DOI"))), lambda i: _label("DOI: ", text(i, "$.DOI"), " · year: ", text(i, "$.issued['date-parts'][0][0]"), " · container: ", string(i, "$['container-title'][0]")), {"doi": lambda i: text(i, "$.DOI")}),
    "openalex": JsonSource("$.results", lambda i: text(i, "$.display_name"), lambda i: F.coalesce(text(i, "$.primary_location.landing_page_url"), _label("https://openalex.org/", text(i, "$.id"))), lambda i: _label("cited_by: ", number(i, "$.cited_by_count").cast("string"), " · year: ", text(i, "$.publication_year")), {"cited_by": lambda i: number(i, "$.cited_by_count").cast("string")}),
    "github-repo": JsonSource("$.items", lambda i: text(i, "$.full_name"), lambda i: text(i, "$.html_url"), lambda i: _label("★", number(i, "$.stargazers_count").cast("string"), " · ", cut(text(i, "$.description"), 200)), {"stars": lambda i: number(i, "$.stargazers_count").cast("string"), "lang": lambda i: text(i, "$.language")}),
    "github-issue": JsonSource("$.items", lambda i: text(i, "$.title"), lambda i: text(i, "$.html_url"), lambda i: _label(text(i, "$.repository.full_name"), " · state: ", text(i, "$.state"))),
    "github-code": JsonSource("$.items", lambda i: _label(text(i, "$.repository.full_name"), ": ", text(i, "$.name")), lambda i: text(i, "$.html_url"), lambda i: text(i, "$.path")),
    "hackernews": JsonSource("$.hits", lambda i: or_else(text(i, "$.title"), text(i, "$.story_title")), lambda i: or_else(text(i, "$.url"), _label("https://news.ycombinator.com/item?id=", text(i, "$.objectID"))), lambda i: _label("points: ", number(i, "$.points").cast("string"), " · ", text(i, "$.author"), " · ", cut(text(i, "$.created_at"), 10)), {"author": lambda i: text(i, "$.author")}),
    "shodan": JsonSource("$.matches", lambda i: _label(text(i, "$.ip_str"), ":", text(i, "$.port")), lambda i: _label("https://www.shodan.io/host/", text(i, "$.ip_str")), lambda i: cut(text(i, "$.data"), 200), {"org": lambda i: text(i, "$.org")}),
}

BLOCK_SOURCES: dict[str, BlockSource] = {
    "duckduckgo": BlockSource(
        r'(?i)<div[^>]*class="[^"]*result[^"]*"', lambda b: H.strip_tags(F.regexp_extract(b, r'(?is)<a[^>]*class="result__a"[^>]*>(.*?)</a>', 1)),
        lambda b: U.normalize_url(F.coalesce(U.decode_redirect(_group(r'(?is)<a[^>]*class="result__a"[^>]*href="([^"]+)"')(b), "uddg"), _group(r'(?is)<a[^>]*class="result__a"[^>]*href="([^"]+)"')(b))),
        lambda b: H.strip_tags(_group(r'(?is)<a[^>]*class="result__snippet"[^>]*>(.*?)</a>')(b)), keep=lambda b: b.contains("result__a") & ~b.rlike(r"duckduckgo\.com/y\.js|ad_domain"),
    ),
    "bing": BlockSource(
        r'(?i)<li class="b_algo"', lambda b: H.strip_tags(_group(r"(?is)<h2[^>]*><a[^>]*>(.*?)</a></h2>")(b)),
        lambda b: U.normalize_url(F.coalesce(U.decode_base64_redirect(_group(r'(?is)<h2[^>]*><a[^>]*href="([^"]+)"')(b)), _group(r'(?is)<h2[^>]*><a[^>]*href="([^"]+)"')(b))),
        lambda b: H.strip_tags(or_else(_group(r'(?is)<(?:p|div)[^>]*class="[^"]*(?:b_caption|b_lineclamp)[^"]*"[^>]*>(.*?)</(?:p|div)>')(b), _group(r"(?is)<p[^>]*>(.*?)</p>")(b))),
    ),
    "brave": BlockSource(
        r'(?i)class="snippet svelte-', lambda b: or_else(H.strip_tags(F.regexp_extract(cut(b, 600), r"(?is)<a[^>]*>(.*?)</a>", 1)), U.normalize_url(_group(r'(?is)<a[^>]*href="(https?://[^"]+)"')(b))),
        lambda b: U.normalize_url(_group(r'(?is)<a[^>]*href="(https?://[^"]+)"')(b)), lambda b: H.strip_tags(_group(r"(?is)<p[^>]*>(.*?)</p>")(b)),
        keep=lambda b: ~cut(b, 60).contains('id="infobox') & ~_group(r'(?is)<a[^>]*href="(https?://[^"]+)"')(b).rlike(r"brave\.com|play\.google\.com|itunes\.apple\.com"),
    ),
    "arxiv": BlockSource(
        r"(?i)<entry>", lambda b: H.strip_tags(_group(r"(?is)<title[^>]*>(.*?)</title>")(b)), lambda b: F.trim(_group(r"(?is)<id[^>]*>(.*?)</id>")(b)), lambda b: cut(H.strip_tags(_group(r"(?is)<summary[^>]*>(.*?)</summary>")(b)), 300),
        {"published": lambda b: cut(_group(r"(?is)<published[^>]*>(.*?)</published>")(b), 10)},
    ),
    "telegram": BlockSource(
        r'(?=<[^<>]*\bdata-post=")', lambda b: cut(H.strip_tags(b), 80), lambda b: _label("https://t.me/", _group(r'^<[^<>]*\bdata-post="([^"]+)"')(b)), lambda b: cut(H.strip_tags(b), 400),
        keep=lambda b: b.rlike(r'^<[^<>]*\bdata-post="'),
    ),
    "torznab": BlockSource(
        r"(?i)<item>", lambda b: H.strip_tags(_group(r"(?is)<title>(.*?)</title>")(b)), lambda b: F.trim(_group(r"(?is)<link>(.*?)</link>")(b)),
        lambda b: F.when(_group(r'(?i)name="seeders"[^>]*value="([^"]*)"')(b) != "", _label("seeders ", _group(r'(?i)name="seeders"[^>]*value="([^"]*)"')(b), " · peers ", _group(r'(?i)name="peers"[^>]*value="([^"]*)"')(b))).otherwise(""),
        {"size": lambda b: or_else(_group(r"(?is)<size>(.*?)</size>")(b), _group(r'(?i)<enclosure[^>]*length="([^"]*)"')(b)), "magnet": lambda b: F.when(_group(r"(?is)<link>(.*?)</link>")(b).startswith("magnet:"), _group(r"(?is)<link>(.*?)</link>")(b))},
    ),
    "magnet-rows": BlockSource(
        r"(?i)<tr>", lambda b: H.strip_tags(_group(r'(?is)class="[^"]*detName[^"]*"[^>]*>(.*?)</a>')(b)), _group(r'(?i)href="(magnet:\?xt=[^"]+)"'), lambda b: H.strip_tags(_group(r'(?is)class="detDesc"[^>]*>(.*?)</font>')(b)),
        {"magnet": _group(r'(?i)href="(magnet:\?xt=[^"]+)"')},
    ),
}


def _extra(fields: dict[str, Callable[[Column], Column]], item: Column) -> Column:
    if not fields:
        return F.create_map().cast("map<string,string>")
    return F.map_filter(F.create_map(*[x for k, f in fields.items() for x in (F.lit(k), f(item))]), lambda k, v: v.isNotNull())


def usable(responses: DataFrame) -> DataFrame:
    return responses.filter(error_class(F.col("status"), F.col("body")).isNull())


def errors(responses: DataFrame) -> DataFrame:
    """request_url, query, error of the responses that cannot be parsed."""
    return responses.select("request_url", "query", error_class(F.col("status"), F.col("body")).alias("error")).filter("error IS NOT NULL")


def parse_json(responses: DataFrame, name: str, limit: int = 0) -> DataFrame:
    """RESULT rows of a JSON source. Bodies that are no JSON, or lack the items, give no row."""
    spec = JSON_SOURCES[name]
    body = F.try_parse_json("body")
    # one source answers inside a text node of an envelope
    if name == "parallel":
        body = F.coalesce(F.try_parse_json(F.try_variant_get(body, "$.result.content[0].text", "string")), body)
    rows = usable(responses).select("query", body.alias("doc")).select("query", F.posexplode(F.try_variant_get("doc", spec.items, "array<variant>")).alias("pos", "item"))
    item = F.col("item")
    label = spec.source(item) if spec.source else F.lit(name)
    out = rows.select("query", label.alias("source"), F.struct(*[(-spec.order(item)).alias("a")] if spec.order else [], F.col("pos").alias("b")).alias("ord"), F.coalesce(spec.title(item), F.lit("")).alias("title"), spec.url(item).alias("url"), F.coalesce(spec.snippet(item), F.lit("")).alias("snippet"), _extra(spec.extra, item).alias("extra"))
    return _numbered(out.filter("url IS NOT NULL AND url <> ''"), limit)


def parse_blocks(responses: DataFrame, name: str, limit: int = 0, keyword: str | None = None) -> DataFrame:
    """RESULT rows of a markup or feed source; what stands before the first separator is no block."""
    spec = BLOCK_SOURCES[name]
    rows = usable(responses).select("query", F.posexplode(F.split("body", spec.separator)).alias("pos", "block"))
    rows = rows.filter("pos > 0" if not spec.separator.startswith("(?=") else "true")
    if spec.keep:
        rows = rows.filter(spec.keep(F.col("block")))
    block = F.col("block")
    out = rows.select("query", F.lit(name).alias("source"), F.struct("pos").alias("ord"), spec.title(block).alias("title"), spec.url(block).alias("url"), spec.snippet(block).alias("snippet"), _extra(spec.extra, block).alias("extra"))
    if keyword:
        out = out.filter(F.lower("snippet").contains(keyword.lower()))
    return _numbered(out.filter("url IS NOT NULL AND url <> '' AND title <> ''"), limit)


def _numbered(rows: DataFrame, limit: int) -> DataFrame:
    from pyspark.sql import Window

    placed = rows.withColumn("ord", F.row_number().over(Window.partitionBy("query", "source").orderBy("ord")))
    return (placed.filter(F.col("ord") <= limit) if limit else placed).select(*RESULT)


def paper_total(body: Column) -> Column:
    """The total a paper feed states; null where it cannot be read, which is not 0."""
    return F.nullif(F.regexp_extract(body, r"(?i)<opensearch:totalResults[^>]*>\s*(\d+)", 1), F.lit("")).cast("bigint")


def parse_threads(responses: DataFrame, keyword: str, board: str) -> DataFrame:
    """Threads of a board's catalog whose subject or text holds the keyword."""
    pages = usable(responses).select("query", F.posexplode(F.try_variant_get(F.try_parse_json("body"), "$", "array<variant>")).alias("page", "p"))
    threads = pages.select("query", "page", F.posexplode(F.try_variant_get("p", "$.threads", "array<variant>")).alias("pos", "t"))
    t, q = F.col("t"), keyword.lower()
    hit = F.lower(F.coalesce(text(t, "$.sub"), F.lit(""))).contains(q) | F.lower(F.coalesce(text(t, "$.com"), F.lit(""))).contains(q)
    out = threads.filter(hit).select("query", F.lit("4chan").alias("source"), F.struct("page", "pos").alias("ord"), or_else(text(t, "$.sub"), _label("thread ", text(t, "$.no"))).alias("title"), _label(f"https://boards.4channel.org/{board}/thread/", text(t, "$.no")).alias("url"), cut(H.strip_tags(F.coalesce(text(t, "$.com"), F.lit(""))), 250).alias("snippet"), F.create_map(F.lit("board"), F.lit(board)).alias("extra"))
    return _numbered(out, 0)


def parse_registration(responses: DataFrame) -> DataFrame:
    """One row a domain record: status, name servers, events and registrant."""
    d = F.try_parse_json("body")
    names = F.transform(F.coalesce(F.try_variant_get(d, "$.nameservers", "array<variant>"), F.array().cast("array<variant>")), lambda n: F.try_variant_get(n, "$.ldhName", "string"))
    events = F.transform(F.coalesce(F.try_variant_get(d, "$.events", "array<variant>"), F.array().cast("array<variant>")), lambda e: _label(F.try_variant_get(e, "$.eventAction", "string"), ":", cut(F.try_variant_get(e, "$.eventDate", "string"), 10)))
    owners = F.filter(F.coalesce(F.try_variant_get(d, "$.entities", "array<variant>"), F.array().cast("array<variant>")), lambda e: F.array_contains(F.coalesce(F.try_variant_get(e, "$.roles", "array<string>"), F.array().cast("array<string>")), "registrant"))
    return usable(responses).select("query", F.array_join(texts(d, "$.status"), ", ").alias("status"), F.array_join(names, ", ").alias("nameservers"), F.array_join(events, "; ").alias("events"), F.coalesce(F.try_variant_get(F.get(owners, F.lit(0)), "$.handle", "string"), F.lit("")).alias("registrant"))


def parse_certificates(responses: DataFrame, drop_wildcards: bool = False) -> DataFrame:
    """query, host, ord: host names of certificate logs, first ones kept; a leading `*.` is cut, or its name left out."""
    items = usable(responses).select("query", F.posexplode(F.try_variant_get(F.try_parse_json("body"), "$", "array<variant>")).alias("pos", "c"))
    names = F.when(text(F.col("c"), "$.name_value").isNotNull(), F.split(text(F.col("c"), "$.name_value"), "\n")).otherwise(texts(F.col("c"), "$.dns_names"))
    rows = items.select("query", "pos", F.posexplode(names).alias("n", "name")).withColumn("name", F.trim("name"))
    if drop_wildcards:
        rows = rows.filter(~F.col("name").startswith("*"))
    rows = rows.withColumn("host", F.lower(F.regexp_replace("name", r"^\*\.", ""))).filter("host <> ''")
    return rows.groupBy("query", "host").agg(F.min(F.struct("pos", "n")).alias("ord"))


DISCOVERED = "query, source, url, status, mime, ts"


def parse_crawl_index(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of an index that answers in JSON lines. A page of markup in place of lines, or a line
    with an error, is an error; a blank body is an empty result; lines without url are left out."""
    ok = usable(responses)
    is_markup = F.col("body").rlike(r"(?is)^\s*<(!doctype|html)")
    lines = ok.filter(~is_markup).select("query", F.explode(F.split("body", r"\r?\n")).alias("line")).filter(F.trim("line") != "").select("query", F.try_parse_json("line").alias("j"))
    j = F.col("j")
    rows = lines.filter(text(j, "$.url").isNotNull()).select("query", F.lit("commoncrawl").alias("source"), text(j, "$.url").alias("url"), text(j, "$.status").alias("status"), text(j, "$.mime").alias("mime"), text(j, "$.timestamp").alias("ts"))
    bad = lines.filter(text(j, "$.error").isNotNull()).select("query", text(j, "$.error").alias("error"))
    masked = ok.filter(is_markup).select("query", F.lit("markup instead of lines").alias("error"))
    return rows, errors(responses).select("query", "error").unionByName(bad).unionByName(masked)


def parse_archive_index(responses: DataFrame) -> DataFrame:
    """Rows of an archive index: arrays of texts under a header row that names the columns, in any order."""
    table = usable(responses).select("query", F.from_json("body", "array<array<string>>").alias("t")).filter("size(t) > 1")
    rows = table.select("query", F.col("t")[0].alias("head"), F.explode(F.slice("t", F.lit(2), F.size("t") - 1)).alias("r"))
    cell = lambda name: F.when(F.array_position("head", name) > 0, F.try_element_at("r", F.array_position("head", name).cast("int")))
    return rows.select("query", F.lit("wayback").alias("source"), cell("original").alias("url"), cell("statuscode").alias("status"), cell("mimetype").alias("mime"), cell("timestamp").alias("ts")).filter("url IS NOT NULL")


def snapshot_to_restore(snapshots: DataFrame, first: int = 5) -> DataFrame:
    """query, url, ts: of each page's first `first` snapshots the latest."""
    from pyspark.sql import Window

    placed = snapshots.filter("status = '200'").withColumn("n", F.row_number().over(Window.partitionBy("query", "url").orderBy("ts"))).filter(F.col("n") <= first)
    return placed.groupBy("query", "url").agg(F.max("ts").alias("ts"))


def parse_hosts(responses: DataFrame) -> DataFrame:
    """Discovered hosts of a passive record list."""
    items = usable(responses).select("query", F.explode(F.try_variant_get(F.try_parse_json("body"), "$.passive_dns", "array<variant>")).alias("i"))
    return items.select("query", F.lit("otx").alias("source"), F.concat(F.lit("https://"), text(F.col("i"), "$.hostname"), F.lit("/")).alias("url")).filter("url IS NOT NULL").distinct()


def parse_robots(responses: DataFrame) -> DataFrame:
    """query, sitemaps, disallowed, error of robots files; comments go, markup in its place is an error."""
    markup = F.col("body").rlike(r"(?is)^\s*<")
    lines = F.transform(F.split("body", r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"#.*$", "")))
    value = lambda key: F.filter(F.transform(lines, lambda x: F.regexp_extract(x, rf"^(?i){key}\s*:\s*(\S+)", 1)), lambda v: v != "")
    none = F.array().cast("array<string>")
    return usable(responses).select("query", F.when(markup, none).otherwise(F.array_distinct(value("sitemap"))).alias("sitemaps"), F.when(markup, none).otherwise(F.array_distinct(value("disallow"))).alias("disallowed"), F.when(markup, "markup instead of robots").alias("error"))


def parse_sitemap(responses: DataFrame) -> DataFrame:
    """query, url: locations of a sitemap, or the lines that are addresses where it is plain text."""
    located = F.transform(F.regexp_extract_all("body", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), 1), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))
    plain = F.filter(F.transform(F.split("body", r"\r?\n"), F.trim), lambda x: x.rlike(r"^https?://\S+$"))
    return usable(responses).select("query", F.explode(F.array_distinct(F.when(F.size(located) > 0, located).otherwise(plain))).alias("url"))


def parse_code_stream(responses: DataFrame, per_file: int = 2) -> DataFrame:
    """Code hits of an event stream: at most `per_file` lines a file, each cut to 160 characters."""
    blocks = usable(responses).select("query", F.posexplode(F.split("body", r"\r?\n\r?\n")).alias("b", "block")).filter(F.col("block").rlike(r"(?i)event:\s*matches"))
    data = F.try_parse_json(F.regexp_extract("block", r"(?m)^data: (.*)$", 1))
    files = blocks.select("query", "b", F.posexplode(F.try_variant_get(data, "$", "array<variant>")).alias("f", "m"))
    m = F.col("m")
    hits = files.select("query", "b", "f", "m", F.posexplode(F.slice(F.try_variant_get(m, "$.lineMatches", "array<variant>"), 1, per_file)).alias("l", "h"))
    h = F.col("h")
    rows = hits.select("query", F.struct("b", "f", "l").alias("ord"), text(m, "$.repository").alias("repository"), text(m, "$.path").alias("path"), cut(F.trim(text(h, "$.line")), 160).alias("line"), number(h, "$.lineNumber").alias("line_number"), number(m, "$.repoStars").alias("stars"), text(m, "$.language").alias("language"))
    return rows.filter("repository <> '' AND path <> '' AND line <> ''")


def share_key(magnet: Column, url: Column) -> Column:
    """Identity of a shared file: its 40-digit hash in lower case, else its address."""
    return or_else(F.lower(F.regexp_extract(F.coalesce(magnet, F.lit("")), r"(?i)urn:btih:([0-9a-f]{40})", 1)), url)


def size_bytes(raw: Column) -> Column:
    return F.nullif(F.regexp_extract(raw, r"^\s*(\d+)\s*$", 1), F.lit("")).cast("bigint")


def page_text(pages: DataFrame, limit: int = 20000) -> DataFrame:
    """The reader's text, else the text of the markup, else cut markup (columns reader_text, html)."""
    return pages.withColumn("text", or_else(F.col("reader_text"), or_else(H.main_text(F.col("html"), limit), cut(F.col("html"), limit))))


def best_attempt(attempts: DataFrame) -> DataFrame:
    """Of each page's attempts (url, rung, channel, challenge, content) the first that met no challenge and has over 100 characters."""
    good = attempts.filter("challenge = 'none' AND length(content) > 100")
    best = good.groupBy("url").agg(F.min_by(F.struct("channel", "content"), "rung").alias("best"))
    trail = attempts.groupBy("url").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rung", "channel", "challenge"))), lambda a: F.concat(a["channel"], F.lit(":"), a["challenge"])), " > ").alias("trail"))
    return trail.join(best, "url", "left").select("url", F.coalesce("best.channel", F.lit("failed")).alias("channel"), "best.content", "trail")


def silent_engines(responses: DataFrame) -> DataFrame:
    """query, results, silent: how many results a meta search gave and which of its engines did not answer."""
    doc = F.try_parse_json("body")
    listed = F.coalesce(F.try_variant_get(doc, "$.unresponsive_engines", "array<variant>"), F.array().cast("array<variant>"))
    name = lambda e: F.coalesce(F.try_variant_get(e, "$[0]", "string"), F.try_variant_get(e, "$", "string"))
    return usable(responses).select("query", F.coalesce(F.size(F.try_variant_get(doc, "$.results", "array<variant>")), F.lit(0)).alias("results"), F.transform(listed, name).alias("silent"))


def format_bytes(raw: Column) -> Column:
    """A size in the largest unit below 1024 of it (B to TB), with a decimal below 100; what is no positive number stays."""
    n = raw.try_cast("double")
    step = F.when(n >= 2.0**40, 4).when(n >= 2.0**30, 3).when(n >= 2.0**20, 2).when(n >= 2.0**10, 1).otherwise(0)
    value = n / F.pow(F.lit(1024.0), step)
    shown = F.when(value >= 100, F.format_string("%.0f", value)).otherwise(F.format_string("%.1f", value))
    return F.when(F.coalesce(n > 0, F.lit(False)), F.concat_ws(" ", shown, F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB"))), step + 1))).otherwise(raw)


def first_usable(attempts: DataFrame) -> DataFrame:
    """request_url, body, attempts, error: of each request's attempts (request_url, attempt, status, body) the first usable one and how
    many it took; a gateway's page that came as a good response is a failure too; without any, the last error."""
    head = F.lower(F.left("body", F.lit(200)))
    gateway = F.coalesce(head.contains("gateway time-out") | head.contains("504 gateway"), F.lit(False))
    judged = attempts.withColumn("error", F.coalesce(error_class(F.col("status"), F.col("body")), F.when(gateway, "timeout")))
    best = judged.groupBy("request_url").agg(F.min_by(F.struct("attempt", "body"), F.when(F.col("error").isNull(), F.col("attempt"))).alias("best"), F.max("attempt").alias("last"), F.max_by("error", "attempt").alias("error"))
    return best.select("request_url", "best.body", F.coalesce("best.attempt", "last").alias("attempts"), F.when(F.col("best").isNull(), F.col("error")).alias("error"))


#: What the paper interface gives at most in one answer, and the hours by which its index lags (fixed values).
PAPER_CAP, PAPER_LAG_HOURS = 2000, 24


def paper_window(query: Column, since: Column, now: Column) -> Column:
    """The query restricted to what was submitted since the last scan, less the lag of the index; without a last scan the query."""
    stamp = lambda t: F.date_format(t, "yyyyMMddHHmm")
    window = F.concat(F.lit("("), query, F.lit(") AND submittedDate:["), stamp(since - F.expr(f"INTERVAL {PAPER_LAG_HOURS} HOUR")), F.lit(" TO "), stamp(now), F.lit("]"))
    return F.coalesce(window, query)


def paper_request(total: Column, got: Column) -> tuple[Column, Column]:
    """(how many to ask for in a second request, or null; whether the cap cuts): an unknown total is no reason to ask again."""
    return F.when(total > PAPER_CAP, PAPER_CAP).when(total > got, total), F.coalesce(total > PAPER_CAP, F.lit(False))


def paper_lookup(items: DataFrame, at_most: int = 50) -> DataFrame:
    """target_id, url: the request that looks up by id the papers (target_id, seq, url, published_at) without a time, the first `at_most`."""
    from pyspark.sql import Window

    ids = items.filter("published_at IS NULL").select("target_id", "seq", U.paper_id(F.col("url")).alias("paper")).filter("paper IS NOT NULL")
    first = ids.groupBy("target_id", "paper").agg(F.min("seq").alias("seq"))
    placed = first.withColumn("n", F.row_number().over(Window.partitionBy("target_id").orderBy("seq"))).filter(F.col("n") <= at_most)
    listed = placed.groupBy("target_id").agg(F.array_sort(F.collect_list(F.struct("n", "paper"))).alias("papers"))
    return listed.select("target_id", F.concat(F.lit("https://export.arxiv.org/api/query?id_list="), F.array_join("papers.paper", ","), F.lit("&max_results="), F.size("papers").cast("string")).alias("url"))
