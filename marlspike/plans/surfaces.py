"""Queries that run the parsers, classifiers and tools over captured responses composed from the test tables.

The responses are built from rows of `search_result` (one response a row, so none is large), in the form in which each
source answers; the SQL never sees them and says what must come out from the rows themselves.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike import tools
from marlspike.functions import url as U
from marlspike.operators import api, classify, crawl, merge, monitor
from marlspike.plans.search import _DOMAIN, _HOST, _NORMAL, _TRIMMED, _sql
from marlspike.session import table
from marlspike.sources import responses as R

_N = _sql(_NORMAL, u=_TRIMMED)
_ID = "cast(result_id AS varchar)"


def _captured(spark: SparkSession, sf_dir: str, source: str, body: str) -> DataFrame:
    """One usable response a row of `search_result`; `body` is a Spark expression over its columns."""
    return table(spark, sf_dir, "search_result").selectExpr("concat('https://api.example/', result_id) AS request_url", "cast(result_id AS string) AS query", "200 AS status", f"{body} AS body", f"'{source}' AS source")


def _item(fields: str) -> str:
    return f"to_json(named_struct({fields}))"


#: source -> (body as Spark SQL, title, address and snippet that must come out as DuckDB SQL).
_JSON = {
    "tavily": ("concat('{\"results\":[', " + _item("'title', title, 'url', url, 'content', snippet") + ", ',{\"title\":\"no address\"}]}')", "coalesce(title, '')", _N, "coalesce(snippet, '')"),
    "serper-google": ("concat('{\"organic\":[', " + _item("'title', title, 'link', url, 'snippet', snippet") + ", ']}')", "coalesce(title, '')", _N, "coalesce(snippet, '')"),
    "deepseek": ("concat('{\"results\":[', " + _item("'title', title, 'url', url, 'snippet', snippet, 'rerank_score', cast(ord AS double)") + ", ']}')", "coalesce(nullif(title, ''), url)", _N, "coalesce(snippet, '')[1:600]"),
    "parallel": ("to_json(named_struct('result', named_struct('content', array(named_struct('text', concat('{\"results\":[', " + _item("'title', title, 'url', url, 'excerpts', array_compact(array(title, snippet))") + ", ']}'))))))", "coalesce(nullif(title, ''), url)", _N, "array_to_string(list_filter([title, snippet], lambda x: x IS NOT NULL), ' … ')[1:600]"),
    "searxng": ("concat('{\"results\":[', " + _item("'title', title, 'url', url, 'content', snippet, 'engines', array_compact(array(source))") + ", ']}')", "coalesce(nullif(title, ''), url)", _N, r"coalesce(regexp_replace(snippet, '\s+', ' ', 'g')[1:400], '')"),
    "semantic-scholar": ("concat('{\"data\":[', " + _item("'paperId', cast(result_id AS string), 'title', title, 'abstract', snippet, 'citationCount', ord, 'year', 2000 + ord % 25, 'venue', source") + ", ']}')", "coalesce(title, '')", f"'https://api.semanticscholar.org/paper/' || {_ID}", "coalesce(nullif(snippet[1:300], ''), 'venue: ' || coalesce(source, '') || ' · citations: ' || ord || ' · year: ' || (2000 + ord % 25))"),
    "crossref": ("concat('{\"message\":{\"items\":[', " + _item("'title', if(title IS NULL, NULL, array(title)), 'DOI', concat('10.5555/', result_id), 'issued', named_struct('date-parts', array(array(1990 + ord % 30))), 'container-title', if(source IS NULL, NULL, array(source))") + ", ']}}')", "coalesce(title, '')", f"'https://doi.org/10.5555/' || {_ID}", f"'DOI: 10.5555/' || {_ID} || ' · year: ' || (1990 + ord % 30) || ' · container: ' || coalesce(source, '')"),
    "openalex": ("concat('{\"results\":[', " + _item("'id', concat('W', result_id), 'display_name', title, 'cited_by_count', ord, 'publication_year', 1999, 'primary_location', if(result_id % 2 = 0, named_struct('landing_page_url', url), NULL)") + ", ']}')", "coalesce(title, '')", f"CASE WHEN result_id % 2 = 0 THEN url ELSE 'https://openalex.org/W' || {_ID} END", "'cited_by: ' || ord || ' · year: 1999'"),
    "github-repo": ("concat('{\"items\":[', " + _item("'full_name', title, 'html_url', url, 'stargazers_count', ord, 'description', snippet, 'language', source") + ", ']}')", "coalesce(title, '')", "url", "'★' || ord || ' · ' || coalesce(snippet[1:200], '')"),
    "github-issue": ("concat('{\"items\":[', " + _item("'title', title, 'html_url', url, 'state', 'open', 'repository', named_struct('full_name', source)") + ", ']}')", "coalesce(title, '')", "url", "coalesce(source, '') || ' · state: open'"),
    "github-code": ("concat('{\"items\":[', " + _item("'name', title, 'path', snippet, 'html_url', url, 'repository', named_struct('full_name', source)") + ", ']}')", "coalesce(source, '') || ': ' || coalesce(title, '')", "url", "coalesce(snippet, '')"),
    "hackernews": ("concat('{\"hits\":[', " + _item("'objectID', cast(result_id AS string), 'title', title, 'url', if(result_id % 2 = 0, url, NULL), 'points', ord, 'author', source, 'created_at', '2026-03-04T05:06:07Z'") + ", ']}')", "coalesce(title, '')", f"CASE WHEN result_id % 2 = 0 THEN url ELSE 'https://news.ycombinator.com/item?id=' || {_ID} END", "'points: ' || ord || ' · ' || coalesce(source, '') || ' · 2026-03-04'"),
    "shodan": ("concat('{\"matches\":[', " + _item("'ip_str', concat('192.0.2.', result_id % 250), 'port', ord, 'data', snippet, 'org', source") + ", ']}')", "'192.0.2.' || (result_id % 250) || ':' || ord", "'https://www.shodan.io/host/192.0.2.' || (result_id % 250)", "coalesce(snippet[1:200], '')"),
}
_BLOCKS = {
    "duckduckgo": ("concat('<p>head</p><div class=\"result r\"><a class=\"result__a\" href=\"//r.test/l/?uddg=', replace(url_encode(url), '+', '%20'), '\">Result <b>', result_id, '</b></a><a class=\"result__snippet\">Note &amp; ', ord, '</a></div><div class=\"result\"><a class=\"result__a\" href=\"https://duckduckgo.com/y.js?ad_domain=z\">Ad</a></div>')", f"'Result ' || {_ID}", _N, "'Note & ' || ord"),
    "bing": ("concat('<ol><li class=\"b_algo\"><h2><a href=\"https://r.test/ck?u=a1', translate(base64(encode(url, 'UTF-8')), '+/=\\r\\n', '-_'), '&x=1\">Result ', result_id, '</a></h2><p>Note ', ord, '</p></li></ol>')", f"'Result ' || {_ID}", _N, "'Note ' || ord"),
    "brave": ("concat('<x class=\"snippet svelte-1\"><a href=\"https://b.test/', result_id, '\"><i>Result ', result_id, '</i></a><p>Note ', ord, '</p><x class=\"snippet svelte-2\"><a href=\"https://search.brave.com/x\">own</a>')", f"'Result ' || {_ID}", f"'https://b.test/' || {_ID}", "'Note ' || ord"),
    "arxiv": ("concat('<feed><opensearch:totalResults>7</opensearch:totalResults><entry><title>Paper\n ', result_id, '</title><id> http://p.test/abs/', result_id, 'v1 </id><summary>Note ', ord, '</summary><published>2024-05-06T00:00:00Z</published></entry></feed>')", f"'Paper ' || {_ID}", f"'http://p.test/abs/' || {_ID} || 'v1'", "'Note ' || ord"),
    "telegram": ("concat('<div data-post=\"c/', result_id, '\" class=\"m\">first <b>news</b> ', ord, '</div>')", "'first news ' || ord", f"'https://t.me/c/' || {_ID}", "'first news ' || ord"),
    "torznab": ("concat('<rss><item><title>File ', result_id, '</title><link>magnet:?xt=urn:btih:', sha1(cast(result_id AS string)), '</link><size>', ord, '</size><torznab:attr name=\"seeders\" value=\"', ord, '\"/><torznab:attr name=\"peers\" value=\"2\"/></item></rss>')", f"'File ' || {_ID}", f"'magnet:?xt=urn:btih:' || sha1({_ID})", "'seeders ' || ord || ' · peers 2'"),
    "magnet-rows": ("concat('<table><tr><td><a class=\"detLink detName\" href=\"/t\">File ', result_id, '</a><a href=\"magnet:?xt=urn:btih:', sha1(cast(result_id AS string)), '\">m</a><font class=\"detDesc\">Size ', ord, '</font></td></tr></table>')", f"'File ' || {_ID}", f"'magnet:?xt=urn:btih:' || sha1({_ID})", "'Size ' || ord"),
}


def _parsed(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    captured = _captured(spark, sf_dir, name, (_JSON | _BLOCKS)[name][0])
    rows = R.parse_json(captured, name) if name in _JSON else R.parse_blocks(captured, name)
    return rows.select(F.col("query").cast("bigint").alias("result_id"), "ord", "title", "url", "snippet")


def _expected(name: str) -> str:
    _, title, address, snippet = (_JSON | _BLOCKS)[name]
    keep = "" if name in _JSON else " AND title <> ''"
    return f"SELECT * FROM (SELECT result_id, 1 AS ord, {title} AS title, {address} AS url, {snippet} AS snippet FROM search_result) WHERE url IS NOT NULL AND url <> ''{keep}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"parsed_{n.replace('-', '_')}": partial(_parsed, n) for n in _JSON | _BLOCKS}
ORACLES: dict[str, str] = {f"parsed_{n.replace('-', '_')}": _expected(n) for n in _JSON | _BLOCKS}


def query(sql: str):
    def add(function):
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = sql
        return function

    return add


# responses


@query("SELECT result_id, CASE result_id % 6 WHEN 0 THEN 'rate-limit' WHEN 1 THEN 'timeout' WHEN 2 THEN 'http-error' WHEN 3 THEN 'http-error' ELSE 'empty' END AS error FROM search_result WHERE result_id % 6 < 4 OR snippet IS NULL")
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    captured = _captured(spark, sf_dir, "x", "snippet").withColumn("status", F.expr("element_at(array(429, 504, 500, 301, 200, 204), cast(cast(query AS bigint) % 6 AS int) + 1)"))
    return R.errors(captured).select(F.col("query").cast("bigint").alias("result_id"), "error")


@query("SELECT result_id, CASE WHEN result_id % 2 = 0 THEN 'serper-google' ELSE 'tavily' END AS source FROM search_result")
def fallback_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first channel answers every second query only; the second all of them."""
    first = R.parse_json(_captured(spark, sf_dir, "serper-google", _JSON["serper-google"][0]).filter("cast(query AS bigint) % 2 = 0"), "serper-google")
    second = R.parse_json(_captured(spark, sf_dir, "tavily", _JSON["tavily"][0]), "tavily")
    return merge.fallback(first, second).select(F.col("query").cast("bigint").alias("result_id"), "source")


@query("SELECT result_id, 7::BIGINT AS total FROM search_result WHERE result_id % 2 = 0 UNION ALL SELECT result_id, NULL FROM search_result WHERE result_id % 2 = 1")
def paper_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    captured = _captured(spark, sf_dir, "arxiv", f"if(result_id % 2 = 0, {_BLOCKS['arxiv'][0]}, '<feed></feed>')")
    return captured.select(F.col("query").cast("bigint").alias("result_id"), R.paper_total(F.col("body")).alias("total"))


@query(f"SELECT result_id, 'ok, held' AS status, 'ns1.' || {_sql(_DOMAIN, u='url')} || ', ns2.test' AS nameservers, 'registration:2020-01-02' AS events, 'H' || {_ID} AS registrant FROM search_result WHERE url IS NOT NULL")
def parsed_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = r"regexp_replace(lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/]*@)?([^/?#\\s]*)', 1), ':\\d*$', '')), '^www\\.', '')"
    body = "to_json(named_struct('status', array('ok', 'held'), 'nameservers', array(named_struct('ldhName', concat('ns1.', " + domain + ")), named_struct('ldhName', 'ns2.test')), 'events', array(named_struct('eventAction', 'registration', 'eventDate', '2020-01-02T00:00:00Z')), 'entities', array(named_struct('roles', array('abuse'), 'handle', 'x'), named_struct('roles', array('registrant'), 'handle', concat('H', result_id)))))"
    return R.parse_registration(_captured(spark, sf_dir, "rdap", f"if(url IS NULL, NULL, {body})")).withColumn("result_id", F.col("query").cast("bigint")).drop("query")


@query(f"SELECT result_id, 'h' || result_id || '.test' AS host FROM search_result UNION ALL SELECT result_id, 'w.test' FROM search_result")
def parsed_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "concat('[{\"name_value\":\"*.H', result_id, '.test\\nh', result_id, '.test\"},{\"dns_names\":[\"W.test\",\"w.test\"]}]')".replace("\\n", "\\\\n")
    return R.parse_certificates(_captured(spark, sf_dir, "crt.sh", body)).select(F.col("query").cast("bigint").alias("result_id"), "host")


@query("SELECT result_id, url, '200' AS status, 'text/html' AS mime, '2026' AS ts FROM search_result WHERE url IS NOT NULL")
def parsed_crawl_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "concat(" + _item("'url', url, 'status', '200', 'mime', 'text/html', 'timestamp', '2026'") + ", '\\n\\n{\"noturl\":1}\\n')"
    return R.parse_crawl_index(_captured(spark, sf_dir, "commoncrawl", body))[0].select(F.col("query").cast("bigint").alias("result_id"), "url", "status", "mime", "ts")


@query("SELECT result_id, CASE result_id % 3 WHEN 0 THEN 'No Captures' ELSE 'markup instead of lines' END AS error FROM search_result WHERE result_id % 3 < 2")
def crawl_index_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "CASE result_id % 3 WHEN 0 THEN '{\"error\":\"No Captures\"}' WHEN 1 THEN '<html>504</html>' ELSE '' END"
    return R.parse_crawl_index(_captured(spark, sf_dir, "commoncrawl", body))[1].select(F.col("query").cast("bigint").alias("result_id"), "error")


_SNAPSHOTS = "to_json(array(array('mimetype', 'original', 'timestamp', 'statuscode'), array('text/html', url, '2025', '200'), array('text/html', url, '2024', '200'), array('text/html', url, '2026', '404')))"


@query("SELECT result_id, url, t AS ts, CASE t WHEN '2026' THEN '404' ELSE '200' END AS status FROM search_result, (VALUES ('2024'), ('2025'), ('2026')) v(t) WHERE url IS NOT NULL")
def parsed_archive_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.parse_archive_index(_captured(spark, sf_dir, "wayback", _SNAPSHOTS)).select(F.col("query").cast("bigint").alias("result_id"), "url", "ts", "status")


@query("SELECT result_id, url, '2025' AS ts FROM search_result WHERE url IS NOT NULL")
def snapshot_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.snapshot_to_restore(R.parse_archive_index(_captured(spark, sf_dir, "wayback", _SNAPSHOTS))).select(F.col("query").cast("bigint").alias("result_id"), "url", "ts")


@query("SELECT result_id, 'https://h' || result_id || '.test/' AS url FROM search_result")
def parsed_passive_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "concat('{\"passive_dns\":[{\"hostname\":\"h', result_id, '.test\"},{\"hostname\":\"h', result_id, '.test\"},{\"x\":1}]}')"
    return R.parse_hosts(_captured(spark, sf_dir, "otx", body)).select(F.col("query").cast("bigint").alias("result_id"), "url")


@query("SELECT result_id, CASE WHEN result_id % 4 = 0 THEN '' ELSE 'https://s.test/' || result_id || '.xml' END AS sitemaps, CASE WHEN result_id % 4 = 0 THEN '' ELSE '/x' || ord END AS disallowed, CASE WHEN result_id % 4 = 0 THEN 'markup instead of robots' END AS error FROM search_result")
def parsed_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "if(result_id % 4 = 0, '<html>', concat('User-agent: *\\r\\nDisallow: /x', ord, ' # no\\nSitemap: https://s.test/', result_id, '.xml\\nsitemap: https://s.test/', result_id, '.xml\\n'))"
    return R.parse_robots(_captured(spark, sf_dir, "robots", body)).select(F.col("query").cast("bigint").alias("result_id"), F.array_join("sitemaps", ",").alias("sitemaps"), F.array_join("disallowed", ",").alias("disallowed"), "error")


@query("SELECT result_id, 'https://s.test/' || result_id || CASE WHEN result_id % 2 = 0 THEN '?x=1&y' ELSE '' END AS url FROM search_result")
def parsed_sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "if(result_id % 2 = 0, concat('<urlset><loc> https://s.test/', result_id, '?x=1&amp;y </loc></urlset>'), concat('https://s.test/', result_id, '\\nnoise\\n'))"
    return R.parse_sitemap(_captured(spark, sf_dir, "sitemap", body)).select(F.col("query").cast("bigint").alias("result_id"), "url")


@query("SELECT result_id, 'r' || result_id AS repository, 'p.py' AS path, line, stars FROM (SELECT result_id, ord AS stars, unnest(['a' || ord, 'b']) AS line FROM search_result)")
def parsed_code_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "concat('event: matches\\ndata: [{\"repository\":\"r', result_id, '\",\"path\":\"p.py\",\"repoStars\":', ord, ',\"lineMatches\":[{\"line\":\" a', ord, ' \"},{\"line\":\"b\"},{\"line\":\"c\"}]}]\\n\\nevent: done\\ndata: {}')"
    return R.parse_code_stream(_captured(spark, sf_dir, "code-stream", body)).select(F.col("query").cast("bigint").alias("result_id"), "repository", "path", "line", "stars")


@query("SELECT result_id, 'Spark ' || result_id AS title, 'https://boards.4channel.org/g/thread/' || result_id AS url, 'x ' || ord AS snippet FROM search_result")
def parsed_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "concat('[{\"threads\":[{\"no\":', result_id, ',\"sub\":\"Spark ', result_id, '\",\"com\":\"<b>x</b> ', ord, '\"},{\"no\":2,\"com\":\"other\"}]}]')"
    return R.parse_threads(_captured(spark, sf_dir, "board", body), "spark", "g").select(F.col("query").cast("bigint").alias("result_id"), "title", "url", "snippet")


@query("SELECT result_id, 2 AS results, 'a,b' AS silent FROM search_result")
def silent_engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "'{\"results\":[{},{}],\"unresponsive_engines\":[[\"a\",\"timeout\"],\"b\"]}'"
    return R.silent_engines(_captured(spark, sf_dir, "searxng", body)).select(F.col("query").cast("bigint").alias("result_id"), "results", F.array_join("silent", ",").alias("silent"))


# classifiers


@query(r"""SELECT robust_id, CASE WHEN regexp_matches(content, '(?i)anomaly\.js|anomaly-modal|cc=botnet|bots use duckduckgo too') THEN 'anomaly' WHEN regexp_matches(content, '(?i)no\s+results|did not match|没有找到|找不到|未找到') THEN 'no-results-text'
 WHEN NOT regexp_matches(content, '(?i)<div[^>]*class="[^"]*result[^"]*"') THEN 'no-blocks' WHEN NOT regexp_matches(content, '(?i)class="result__a"') THEN 'blocks-no-anchors' WHEN robust_id % 2 = 0 THEN 'all-ads-filtered' ELSE 'unknown' END AS shape
 FROM (SELECT robust_id, content || CASE robust_id % 5 WHEN 0 THEN '<div class="result">' WHEN 1 THEN '<div class="result"><a class="result__a">' WHEN 2 THEN ' No  results' WHEN 3 THEN ' anomaly-modal' ELSE '' END AS content FROM robust_result WHERE content IS NOT NULL)""")
def zero_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents with a sign of each shape added."""
    marks = F.expr("""element_at(array('<div class="result">', '<div class="result"><a class="result__a">', ' No  results', ' anomaly-modal', ''), cast(robust_id % 5 AS int) + 1)""")
    rows = table(spark, sf_dir, "robust_result").filter("content IS NOT NULL").select("robust_id", F.concat("content", marks).alias("markup"))
    return rows.select("robust_id", classify.zero_shape(F.col("markup"), F.col("robust_id") % 2).alias("shape"))


@query("SELECT result_id, CASE WHEN title IS NULL THEN 'no-text-node' WHEN snippet IS NULL THEN 'text-not-json' WHEN result_id % 3 = 0 THEN 'empty-results' WHEN result_id % 3 = 1 THEN 'all-filtered' ELSE 'unknown' END AS shape FROM search_result")
def tool_zero_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("result_id") % 3
    return table(spark, sf_dir, "search_result").select("result_id", classify.tool_zero_shape(F.col("title").isNotNull(), F.col("snippet").isNotNull(), k, F.when(k == 1, 0).otherwise(1)).alias("shape"))


@query(r"""SELECT robust_id, robust_id % 3 = 0 OR coalesce(regexp_matches(content, '(?i)rate.?limit|too many|1015'), false) AS limited FROM robust_result""")
def rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "robust_result").select("robust_id", classify.rate_limited(F.when(F.col("robust_id") % 3 == 0, 429).otherwise(200), F.col("content")).alias("limited"))


_SQUEEZED = r"trim(regexp_replace(title, '[\s\x0B ]+', ' ', 'g'))"


@query("SELECT result_id, CASE result_id % 5 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN true ELSE false END AS answers FROM search_result")
def search_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page without search again, an echo of the term, five list items, a count, and none of these."""
    page = F.expr("""element_at(array('<p>the front page of a portal with nothing to show</p>', concat('<p>hits for zq', result_id, '</p>'), repeat('<li>one</li>', 5), '<p>共 12 条</p>', repeat('<li>one</li>', 4)), cast(result_id % 5 AS int) + 1)""")
    base = F.lit("<div>the front page of a portal with nothing to show</div>")
    rows = table(spark, sf_dir, "search_result")
    return rows.select("result_id", classify.looks_like_results(page, F.concat(F.lit("zq"), F.col("result_id").cast("string")), base).alias("answers"))


@query("""SELECT robust_id, CASE robust_id % 5 WHEN 0 THEN 'rate-limit' WHEN 1 THEN 'waf' WHEN 2 THEN 'js-challenge' WHEN 3 THEN 'unknown' ELSE 'ip-block' END AS challenge FROM robust_result""")
def challenge_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The branches that only the status decides, on bodies that differ."""
    k = F.col("robust_id") % 5
    body = F.expr("element_at(array('slow down', '<title>403 Forbidden</title>', 'solve the hCaptcha', 'gone', '<title>Anomaly</title> duckduckgo'), cast(robust_id % 5 AS int) + 1)")
    status = F.expr("element_at(array(429, 403, 202, 404, 200), cast(robust_id % 5 AS int) + 1)")
    return table(spark, sf_dir, "robust_result").select("robust_id", k.alias("k"), body.alias("body"), status.alias("status")).select("robust_id", classify.challenge(F.col("body"), F.col("status")).alias("challenge"))


# addresses


@query(r"""SELECT doc_id, lower(regexp_replace(regexp_replace(regexp_replace(trim(url), '^(?i)[a-z][a-z0-9+.-]*://', ''), '[/?#].*$', ''), ':\d+$', '')) AS domain, regexp_replace(url, '(?i)/(list|index)\d*\.htm', '/\1.htm') AS column_key, nullif(regexp_extract(url, '/abs/([^/?#]+)$', 1), '') AS paper,
 coalesce(regexp_matches(url, '(?i)/(page|content|article|detail)\.htm|/c\d+a\d+/'), false) AS content_page, list_contains(['jpg','jpeg','png','gif','webp','svg','ico','bmp','tif','tiff','css','js','mjs','woff','woff2','ttf','eot','otf','map','mp3','mp4','avi','mov','wmv','flv','mkv','webm','ogg','wav'], lower(regexp_extract(string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1], '^.+\.([A-Za-z0-9]{1,8})$', 1))) AS asset FROM documents WHERE url IS NOT NULL""")
def address_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "documents").filter("url IS NOT NULL").select("doc_id", U.normalize_domain(u).alias("domain"), U.column_key(u).alias("column_key"), U.paper_id(u).alias("paper"), U.is_content_page(u).alias("content_page"), U.is_asset(u).alias("asset"))


@query("SELECT result_id, CASE WHEN nullif(title, '') IS NOT NULL AND source IS NOT NULL THEN 'https://t.test/' || source || '/' || title END AS url FROM search_result")
def rendered_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "search_result").select("result_id", U.render_template("https://t.test/{source}/{name}", {"source": F.nullif(F.col("source"), F.lit("")), "name": F.col("title")}).alias("url"))


@query("SELECT result_id, coalesce(nullif(sha1(cast(result_id AS varchar)), ''), url) AS share_key, ord::BIGINT AS size FROM search_result WHERE result_id % 2 = 0 UNION ALL SELECT result_id, url, NULL FROM search_result WHERE result_id % 2 = 1")
def share_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    magnet = F.expr("if(result_id % 2 = 0, concat('magnet:?xt=urn:BTIH:', upper(sha1(cast(result_id AS string)))), NULL)")
    size = F.expr("if(result_id % 2 = 0, concat(' ', ord, ' '), '1.5 GiB')")
    return table(spark, sf_dir, "search_result").select("result_id", R.share_key(magnet, F.col("url")).alias("share_key"), R.size_bytes(size).alias("size"))


# times


@query(r"""SELECT record_id, CASE WHEN h < 0 THEN printf('in %.1fh', -h) WHEN h < 48 THEN printf('%.1fh ago', h) ELSE printf('%.1fd ago', h / 24) END AS age FROM (SELECT record_id, (epoch_us(TIMESTAMP '2026-09-01 00:00:00') - epoch_us(received_at)) / 3600000000 AS h FROM api_record WHERE received_at IS NOT NULL)
 UNION ALL SELECT record_id, 'unknown' FROM api_record WHERE received_at IS NULL""")
def age_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "api_record").select("record_id", api.age_label(F.col("received_at").cast("timestamp"), F.lit("2026-09-01 00:00:00").cast("timestamp")).alias("age"))


@query(f"SELECT doc_id, coalesce(own, seen) AS at, CASE WHEN own IS NOT NULL THEN 'url' WHEN seen IS NOT NULL THEN 'page' END AS origin FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '2025-01-02 00:00:00' END AS own, first_seen AS seen FROM documents LEFT JOIN (SELECT source AS s, min(crawled_at) AS first_seen FROM documents WHERE source IS NOT NULL GROUP BY 1) ON source = s)")
def inherited_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    pages = documents.filter("source IS NOT NULL").groupBy(F.col("source").alias("page")).agg(F.min("crawled_at").cast("timestamp").alias("at"))
    files = documents.select("doc_id", F.col("source").alias("page"), F.expr("if(doc_id % 3 = 0, timestamp '2025-01-02 00:00:00', NULL)").alias("own_date"))
    return api.inherit_times(files, pages).select("doc_id", F.col("at").cast("timestamp_ntz").alias("at"), "origin")


# discovery


@query(f"""WITH p AS (SELECT {_sql(_HOST, u='url')} AS host, regexp_replace(url, '(?i)/(list|index)\\d*\\.htm', '/\\1.htm') AS col, url, min(fetch_id) AS ord FROM fetch_result WHERE url IS NOT NULL GROUP BY ALL), c AS (SELECT host, col, row_number() OVER (PARTITION BY host ORDER BY min(ord)) AS n FROM p GROUP BY 1, 2),
 q AS (SELECT *, row_number() OVER (PARTITION BY host, col ORDER BY ord) AS place FROM p) SELECT q.host, q.url, q.place FROM q JOIN c USING (host, col) WHERE n <= 12 AND place <= 3""")
def list_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "fetch_result").filter("url IS NOT NULL").groupBy(U.host(F.col("url")).alias("host"), "url").agg(F.min("fetch_id").alias("ord"))
    return crawl.column_budget(pages).select("host", "url", "place")


@query("""SELECT *, CASE WHEN fetched = 0 OR fail_rate > 0.3 THEN 'low' WHEN sitemap AND robots OR queued = 0 THEN 'high' ELSE 'medium' END AS confidence, concat_ws('; ', CASE WHEN NOT sitemap THEN 'no sitemap' END, CASE WHEN NOT robots THEN 'no robots' END, CASE WHEN queued > 0 THEN 'queue not empty' END, CASE WHEN fail_rate > 0.3 THEN 'many failures' END) AS gaps FROM
 (SELECT *, coalesce(failed / nullif(fetched + failed, 0), 0.0) AS fail_rate FROM (SELECT source, count(text) AS fetched, count(*) FILTER (WHERE text IS NULL OR lang IS NULL) AS failed, count(url) % 2 = 0 AS sitemap, count(lang) % 2 = 0 AS robots, count(*) % 3 AS queued FROM documents WHERE source IS NOT NULL GROUP BY 1))""")
def site_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = table(spark, sf_dir, "documents").filter("source IS NOT NULL").groupBy("source").agg(F.count("text").alias("fetched"), F.count_if(F.col("text").isNull() | F.col("lang").isNull()).alias("failed"), (F.count("url") % 2 == 0).alias("sitemap"), (F.count("lang") % 2 == 0).alias("robots"), (F.count(F.lit(1)) % 3).alias("queued"))
    out = crawl.coverage(sites.withColumn("depth", F.lit(3)).withColumn("max_depth", F.lit(3))).drop("depth", "max_depth")
    return out.withColumn("gaps", F.array_join("gaps", "; "))


@query("SELECT result_id, CASE WHEN ord <= 6 AND result_id % 2 = 0 THEN 'https://target.test/' || result_id ELSE url END AS url FROM search_result")
def resolved_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "search_result").select("result_id", "ord", F.col("url").alias("was"), F.expr("if(result_id % 2 = 0, concat('https://r.test/', result_id), url)").alias("url"))
    targets = rows.filter("result_id % 2 = 0").select("url", F.concat(F.lit("https://target.test/"), F.col("result_id").cast("string")).alias("target"))
    found = api.resolve_redirects(rows, targets)
    return found.select("result_id", F.when(F.col("url").startswith("https://r.test/"), F.col("was")).otherwise(F.col("url")).alias("url"))


@query("SELECT source AS host, CASE WHEN bool_or(ok) THEN 'found' WHEN bool_or(tried) THEN 'none' ELSE 'untried' END AS state, arg_min('https://' || source || '/s?n=' || ord, ord) FILTER (WHERE ok) AS request_url FROM (SELECT DISTINCT source, ord, ord % 3 = 1 AND length(source) % 2 = 0 AS ok, ord % 3 > 0 AS tried FROM search_result WHERE source IS NOT NULL) GROUP BY 1")
def probed_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "search_result").filter("source IS NOT NULL").select("source", "ord").distinct()
    rows = rows.select(F.col("source").alias("host"), F.format_string("https://%s/s?n=%d", "source", "ord").alias("request_url"), F.col("ord").alias("prio"))
    answers = rows.filter("prio % 3 > 0").select("request_url", F.expr("prio % 3 = 1 AND length(host) % 2 = 0").alias("answers"))
    return api.probe_endpoint(rows, answers)


@query(f"""SELECT key, arg_min(source, ord) AS source, list_sort(list(DISTINCT source))[1] AS first_source, arg_min(status, ord) FILTER (WHERE status <> '') AS status, arg_min(ts, ord) FILTER (WHERE ts <> '') AS ts FROM (SELECT regexp_replace(regexp_replace(url, '#.*$', ''), '^(?i)http://', 'https://') AS key, result_id AS ord, CASE WHEN result_id % 2 = 0 THEN 'commoncrawl' ELSE 'wayback' END AS source, CASE WHEN result_id % 3 = 0 THEN '200' WHEN result_id % 3 = 1 THEN '' END AS status, CASE WHEN result_id % 5 = 0 THEN cast(result_id AS varchar) END AS ts FROM search_result WHERE url IS NOT NULL) GROUP BY 1""")
def discovered_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merge of discovered addresses takes over the first status and time that a source knows."""
    rows = table(spark, sf_dir, "search_result").selectExpr("url", "result_id AS ord", "if(result_id % 2 = 0, 'commoncrawl', 'wayback') AS source", "CAST(NULL AS string) AS mime", "CASE WHEN result_id % 3 = 0 THEN '200' WHEN result_id % 3 = 1 THEN '' END AS status", "CASE WHEN result_id % 5 = 0 THEN cast(result_id AS string) END AS ts")
    return merge.merge_discovered(rows).select("key", "source", F.element_at("sources", 1).alias("first_source"), "status", "ts")


# tools


@query("SELECT source, count(*) AS n FROM search_result GROUP BY 1")
def tool_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.search_quota(spark, {"responses": table(spark, sf_dir, "search_result")})


def _responses(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    out = None
    for name in names:
        part = _captured(spark, sf_dir, name, (_JSON | _BLOCKS)[name][0])
        out = part if out is None else out.unionByName(part)
    return {"responses": out}


@query(f"""WITH c AS (SELECT result_id, 0 AS c, {_N} AS url, 'parallel' AS source FROM search_result UNION ALL SELECT result_id, 1, {_N}, 'searxng' || coalesce(':' || source, '') FROM search_result UNION ALL SELECT result_id, 2, {_N}, 'duckduckgo' FROM search_result UNION ALL SELECT result_id, 3, {_N}, 'bing' FROM search_result)
 SELECT result_id, url, arg_min(source, c) AS source FROM c WHERE url <> '' GROUP BY 1, 2""")
def tool_search_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tools.search_web(spark, _responses(spark, sf_dir, "parallel", "searxng", "duckduckgo", "bing"))
    return rows.select(F.col("query").cast("bigint").alias("result_id"), "url", "source")


@query(f"SELECT result_id, 'h' || result_id || '.test' AS host FROM search_result WHERE result_id % 2 = 0 UNION ALL SELECT result_id, 'spot.test' FROM search_result WHERE result_id % 2 = 1")
def tool_subdomains(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _captured(spark, sf_dir, "crt.sh", "concat('[{\"name_value\":\"h', result_id, '.test\"}]')").filter("cast(query AS bigint) % 2 = 0")
    second = _captured(spark, sf_dir, "certspotter", "'[{\"dns_names\":[\"spot.test\"]}]'")
    return tools.enum_subdomains(spark, {"responses": first.unionByName(second)}).select(F.col("query").cast("bigint").alias("result_id"), "host")


@query("SELECT result_id, source AS first_seen, '192.0.2.' || (ord % 250) AS value FROM search_result")
def tool_dns_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "concat('{\"records\":[', " + _item("'first_seen', source, 'values', array(named_struct('ip', concat('192.0.2.', ord % 250)))") + ", ']}')"
    return tools.lookup_dns_history(spark, {"responses": _captured(spark, sf_dir, "dns-history", body)}).select(F.col("query").cast("bigint").alias("result_id"), "first_seen", "value")


@query("SELECT result_id, 'File ' || result_id AS title, CASE WHEN result_id IS NOT NULL THEN ord::BIGINT END AS size_bytes FROM search_result")
def tool_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both share sources hold the same file; its hash makes it one, and the first source's size stays."""
    return tools.search_share(spark, _responses(spark, sf_dir, "torznab", "magnet-rows")).select(F.col("query").cast("bigint").alias("result_id"), "title", "size_bytes")


@query(f"SELECT result_id, url, source FROM (SELECT result_id, {_N} AS url, 'duckduckgo' AS source FROM search_result) WHERE url LIKE '%example%'")
def tool_search_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.search_site(spark, _responses(spark, sf_dir, "duckduckgo"), "example", engines=("duckduckgo",)).select(F.col("query").cast("bigint").alias("result_id"), "url", "source")


@query("SELECT result_id, s AS source FROM search_result, (VALUES ('semantic-scholar'), ('arxiv'), ('crossref'), ('openalex')) v(s)")
def tool_academic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.search_academic(spark, _responses(spark, sf_dir, "semantic-scholar", "arxiv", "crossref", "openalex")).select(F.col("query").cast("bigint").alias("result_id"), "source")


@query("SELECT result_id, s AS source FROM search_result, (VALUES ('hackernews'), ('telegram')) v(s)")
def tool_community(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.search_community(spark, _responses(spark, sf_dir, "hackernews", "telegram")).select(F.col("query").cast("bigint").alias("result_id"), "source")


@query("SELECT result_id AS id, result_id % 3 = 0 AS leaked, CASE WHEN result_id % 3 = 0 THEN ord::BIGINT ELSE 0 END AS n FROM search_result")
def tool_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "search_result").selectExpr("result_id AS id", "upper(sha1(cast(result_id AS string))) AS sha1", "cast(ord AS bigint) AS n")
    ranges = rows.filter("id % 3 = 0").selectExpr("substring(sha1, 1, 5) AS prefix", "substring(sha1, 6, 35) AS suffix", "n")
    return tools.search_leaks(spark, {"secrets": rows.select("id", "sha1"), "ranges": ranges})


@query("SELECT robust_id, CASE WHEN length(content) > 100 THEN 'reader' ELSE 'failed' END AS channel, 'plain:waf > reader:none' AS trail FROM robust_result WHERE content IS NOT NULL AND content <> ''")
def tool_robust_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "robust_result").filter("content IS NOT NULL AND content <> ''").select(F.col("robust_id").cast("string").alias("url"), F.length("content").alias("n"))
    filler = F.expr("repeat('a', n)")
    attempts = rows.select("url", F.lit(1).alias("rung"), F.lit("plain").alias("channel"), F.lit("waf").alias("challenge"), filler.alias("content")).unionByName(rows.select("url", F.lit(2).alias("rung"), F.lit("reader").alias("channel"), F.lit("none").alias("challenge"), filler.alias("content")))
    return R.best_attempt(attempts).select(F.col("url").cast("bigint").alias("robust_id"), "channel", "trail")


@query("SELECT result_id, 'https://s.test/find?k=' || url_encode(query) || '&p=1' AS site, 'https://m.test/search?q=' || replace(url_encode(query), '%20', '+') || '&format=json&safesearch=0' || coalesce('&language=' || nullif(source, ''), '') AS meta FROM search_result WHERE query IS NOT NULL AND NOT regexp_matches(query, '[!~*()'']')")
def search_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signs on which the two engines' encoders differ are tested apart."""
    q = F.col("query")
    rows = table(spark, sf_dir, "search_result").filter("query IS NOT NULL").filter(~q.rlike(r"[!~*()']"))
    return rows.select("result_id", U.search_url(F.lit("https://s.test//"), F.lit("/find?k={q}&p=1"), q).alias("site"), U.meta_search_url(F.lit("https://m.test/"), q, None, F.col("source")).alias("meta"))


@query("SELECT seq, CASE kind WHEN 'attachment' THEN '[附件]' WHEN 'paper' THEN '[论文]' WHEN 'api' THEN '[公告]' ELSE '[页面]' END AS tag FROM intel_item")
def kind_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "intel_item").select("seq", U.kind_tag(F.col("kind")).alias("tag"))


@query("""SELECT extract_id, CASE WHEN bytes IS NULL THEN 'about 1 MB' WHEN bytes <= 0 THEN bytes::VARCHAR WHEN v >= 100 THEN printf('%.0f', v) || ' ' || u ELSE printf('%.1f', v) || ' ' || u END AS size FROM
 (SELECT extract_id, bytes, CASE WHEN bytes < 1024 THEN bytes::DOUBLE WHEN bytes < 1048576 THEN bytes / 1024.0 WHEN bytes < 1073741824 THEN bytes / 1048576.0 ELSE bytes / 1073741824.0 END AS v, CASE WHEN bytes < 1024 THEN 'B' WHEN bytes < 1048576 THEN 'KB' WHEN bytes < 1073741824 THEN 'MB' ELSE 'GB' END AS u FROM (SELECT extract_id, bytes * (1 + extract_id % 3 * 997) AS bytes FROM doc_extract))""")
def file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce((F.col("bytes") * (1 + F.col("extract_id") % 3 * 997)).cast("string"), F.lit("about 1 MB"))
    return table(spark, sf_dir, "doc_extract").select("extract_id", R.format_bytes(raw).alias("size"))


@query("SELECT result_id, CASE result_id % 4 WHEN 0 THEN 'first' WHEN 1 THEN 'third' WHEN 2 THEN 'second' END AS body, CASE result_id % 4 WHEN 0 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS attempts, CASE WHEN result_id % 4 = 3 THEN 'http-error' END AS error FROM search_result")
def retried_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three attempts: good at once; a gateway's page and a limit first; a timeout first; never good."""
    attempts = table(spark, sf_dir, "search_result").selectExpr("cast(result_id AS string) AS request_url", "result_id % 4 AS k", "explode(sequence(1, 3)) AS attempt")
    status = F.expr("CASE WHEN k = 3 THEN 500 WHEN k = 1 AND attempt = 2 THEN 429 WHEN k = 2 AND attempt = 1 THEN 504 ELSE 200 END")
    body = F.expr("if(k = 1 AND attempt = 1, '<h1>504 Gateway Time-out</h1>', element_at(array('first', 'second', 'third'), attempt))")
    return R.first_usable(attempts.withColumn("status", status).withColumn("body", body)).select(F.col("request_url").cast("bigint").alias("result_id"), "body", "attempts", "error")


@query("SELECT id, coalesce('(' || (spec).query || ') AND submittedDate:[' || strftime(last_scan_at - INTERVAL 24 HOUR, '%Y%m%d%H%M') || ' TO 202609010000]', (spec).query) AS query FROM intel_target WHERE (spec).query IS NOT NULL")
def paper_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "intel_target").filter("spec.query IS NOT NULL")
    return rows.select("id", R.paper_window(F.col("spec.query"), F.col("last_scan_at").cast("timestamp"), F.lit("2026-09-01 00:00:00").cast("timestamp")).alias("query"))


@query("SELECT result_id, CASE WHEN ord * 500 > 2000 THEN 2000 WHEN ord * 500 > 900 THEN ord * 500 END AS more, ord * 500 > 2000 AS truncated FROM search_result WHERE result_id % 2 = 0 UNION ALL SELECT result_id, NULL, false FROM search_result WHERE result_id % 2 = 1")
def paper_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An odd row's total is unknown."""
    more, truncated = R.paper_request(F.expr("if(result_id % 2 = 0, ord * 500, NULL)"), F.lit(900))
    return table(spark, sf_dir, "search_result").select("result_id", more.alias("more"), truncated.alias("truncated"))


@query("""WITH ids AS (SELECT target_id, nullif(regexp_extract(u, '/abs/([^/?#]+)$', 1), '') AS paper, min(seq) AS seq FROM (SELECT target_id, seq, published_at, coalesce(url, id) AS u FROM intel_item) WHERE published_at IS NULL GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY seq) AS n FROM ids WHERE paper IS NOT NULL)
 SELECT target_id, 'https://export.arxiv.org/api/query?id_list=' || string_agg(paper, ',' ORDER BY n) || '&max_results=' || count(*) AS url FROM p WHERE n <= 50 GROUP BY 1""")
def paper_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.paper_lookup(table(spark, sf_dir, "intel_item").select("target_id", "seq", F.coalesce("url", "id").alias("url"), "published_at"))


@query(r"SELECT DISTINCT id, '2024-05-06' AS published_at FROM intel_item WHERE published_at IS NULL AND regexp_matches(id, '^https://[^/?#\s]+/abs/[^/?#]+$')")
def paper_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paper of the log is looked up; the answer names it by http and gives its day."""
    log = table(spark, sf_dir, "intel_item")
    papers = log.filter(F.col("id").rlike(r"^https://[^/?#\s]+/abs/[^/?#]+$")).select("id").distinct()
    body = F.concat(F.lit("<feed><entry><title>P</title><id>"), F.regexp_replace("id", "^https", "http"), F.lit("</id><summary>s</summary><published>2024-05-06T00:00:00Z</published></entry></feed>"))
    found = R.parse_blocks(papers.select(F.col("id").alias("query"), F.lit(200).alias("status"), body.alias("body")), "arxiv")
    return monitor.backfill_papers(log, found)


@query("""SELECT id, CASE WHEN e IS NULL THEN CASE kind WHEN 'site' THEN 'crawl' WHEN 'domain' THEN 'index' ELSE kind END END AS channel, CASE WHEN e IS NULL THEN CASE kind WHEN 'domain' THEN (spec).domain WHEN 'arxiv' THEN (spec).query ELSE (spec).url END END AS subject, e AS error FROM
 (SELECT *, CASE WHEN kind NOT IN ('site', 'domain', 'arxiv', 'api') THEN 'unknown kind ' || kind WHEN kind = 'site' AND (spec).url IS NULL THEN 'site target lacks spec.url' WHEN kind = 'domain' AND (spec).domain IS NULL THEN 'domain target lacks spec.domain' WHEN kind = 'arxiv' AND (spec).query IS NULL THEN 'arxiv target lacks spec.query' WHEN kind = 'api' AND (spec).url IS NULL THEN 'api target lacks spec.url' WHEN kind = 'api' AND (spec).items_path IS NULL THEN 'api target lacks spec.items_path' END AS e
 FROM (SELECT id, kind, spec FROM intel_target UNION ALL SELECT id || '#', CASE kind WHEN 'site' THEN 'domain' WHEN 'domain' THEN 'arxiv' WHEN 'arxiv' THEN 'api' ELSE 'feed' END, spec FROM intel_target))""")
def scan_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets, and each once more under a kind whose members it lacks."""
    targets = table(spark, sf_dir, "intel_target").select("id", "kind", "spec")
    wrong = targets.select(F.concat("id", F.lit("#")).alias("id"), F.expr("CASE kind WHEN 'site' THEN 'domain' WHEN 'domain' THEN 'arxiv' WHEN 'arxiv' THEN 'api' ELSE 'feed' END").alias("kind"), "spec")
    return monitor.scan_plan(targets.unionByName(wrong))


@query("SELECT id, CASE WHEN last_scan_error IS NULL THEN 'ok' WHEN found_total > 0 THEN 'partial' ELSE 'failed' END AS last_scan_state, CASE WHEN last_scan_error IS NOT NULL AND coalesce(found_total, 0) <= 0 THEN repeat(last_scan_error, 40)[1:200] END AS last_scan_error FROM (SELECT id, nullif(last_scan_error, '') AS last_scan_error, CASE WHEN length(id) % 2 = 0 THEN found_total ELSE 0 END AS found_total FROM intel_target)")
def scan_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "intel_target").selectExpr("id", "if(length(id) % 2 = 0, found_total, 0) AS found", "repeat(last_scan_error, 40) AS error")
    return monitor.result_state(results.withColumn("source_errors", F.array().cast("array<string>")))


@query("SELECT regexp_replace(regexp_replace(url, '#.*$', ''), '^(?i)http://', 'https://') AS key, arg_min(s, (n, o)) AS source FROM (SELECT url, 0 AS n, 'crawl' AS s, fetch_id AS o FROM fetch_result UNION ALL SELECT url, 1, 'crawl-attachment', source_id FROM deep_source UNION ALL SELECT url, 2, 'crawl-feed', doc_id FROM documents) WHERE url IS NOT NULL GROUP BY 1")
def walked_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select("url", F.col(c).alias("ord")) for t, c in (("fetch_result", "fetch_id"), ("deep_source", "source_id"), ("documents", "doc_id"))]
    return crawl.as_discovered(*parts).select("key", "source")


@query(f"SELECT result_id, {_N} AS url, CASE WHEN result_id % 2 = 0 THEN 'searxng' || coalesce(':' || source, '') ELSE 'searxng' END AS source FROM search_result WHERE {_N} <> ''")
def meta_search_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd rows' first search is empty; the search for the simplified query, which names no engine, answers."""
    first = _captured(spark, sf_dir, "searxng", f"if(result_id % 2 = 0, {_JSON['searxng'][0]}, '{{\"results\":[]}}')")
    again = _captured(spark, sf_dir, "searxng-simple", "concat('{\"results\":[', to_json(named_struct('title', title, 'url', url)), ']}')")
    return tools.meta_with_retry({"responses": first.unionByName(again)}).select(F.col("query").cast("bigint").alias("result_id"), "url", "source")
