"""Queries over search results, pages and documents, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.functions import html as H
from marlspike.functions import text as T
from marlspike.functions import url as U
from marlspike.operators import classify, crawl, evaluate, merge
from marlspike.session import table


def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "search_result").select("result_id", U.normalize_url(F.col("url")).alias("url"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "documents").filter("url IS NOT NULL").select("doc_id", U.host(u).alias("host"), U.domain_of(u).alias("domain"), U.site_root(u).alias("site"), U.extension(u).alias("ext"))


def host_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "fetch_result").groupBy(U.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("pages"), F.count("content").alias("with_content"))


def merge_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merge.merge_results(table(spark, sf_dir, "search_result"))
    return merged.select("query", "key", "title", "snippet", F.array_join("engines", "+").alias("engines"))


def rank_domain_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = merge.ranked_with_domain_cap(merge.merge_results(table(spark, sf_dir, "search_result")))
    return ranked.select("query", "rank", "key", F.col("score").cast("bigint").alias("score"), "domain")


def engine_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.channel_contribution(merge.merge_results(table(spark, sf_dir, "search_result")))


def cross_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merge.merge_results(table(spark, sf_dir, "search_result"))
    return merged.groupBy("query").agg(F.count(F.lit(1)).alias("results"), F.count_if(F.size("engines") >= 2).alias("cross_checked"))


def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "search_result").withColumn("key", U.normalize_url(F.col("url")))
    return merge.keep_first(rows, [F.col("key")], [F.col("ord"), F.col("result_id")]).select("result_id", "key")


def query_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("query")
    rows = table(spark, sf_dir, "search_result").select("query").distinct()
    return rows.select("query", F.array_join(T.query_variants(q), "|").alias("variants"), F.array_join(T.fan_out(q), "|").alias("fan_out"), T.simplify_query(q).alias("simple"), T.paper_query(q).alias("paper"), T.route(q).alias("route"), U.encode_paper_query(q).alias("encoded"))


def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the shapes that both engines' pattern languages share decide the row; see the SQL."""
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(T.redact(F.col("text"))).alias("redacted"))


def seed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host, term, score: the eight best terms of each site's titles, headings and links."""
    pages = table(spark, sf_dir, "fetch_result").filter("mode = 'raw' AND content IS NOT NULL")
    c = F.col("content")
    weighted = F.concat(
        F.transform(F.array(H.title(c)), lambda t: F.struct(t.alias("text"), F.lit(3).alias("weight"))),
        *[F.transform(H.tag_texts(c, tag), lambda t: F.struct(t.alias("text"), F.lit(2).alias("weight"))) for tag in ("h1", "h2", "h3")],
        F.transform(H.link_texts(c), lambda t: F.struct(t.alias("text"), F.lit(1).alias("weight"))),
    )
    rows = pages.select(U.host(F.col("url")).alias("host"), F.explode(weighted).alias("x")).select("host", F.explode(T.terms(F.col("x.text"))).alias("term"), F.col("x.weight").alias("weight"))
    scored = rows.groupBy("host", "term").agg(F.sum(F.col("weight") * F.least(F.length("term"), F.lit(6))).alias("score"))
    return merge.top_per_group(scored, [F.col("host")], [F.col("score").desc(), F.col("term")], 8).select("host", "term", "score", "rank")


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "fetch_result").filter("mode = 'raw' AND content IS NOT NULL")
    return pages.select("fetch_id", H.strip_tags(F.col("content")).alias("text"))


def html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "fetch_result").filter("mode = 'raw' AND content IS NOT NULL")
    return pages.select("fetch_id", H.title(F.col("content")).alias("title"), H.main_text(F.col("content")).alias("main"))


def link_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "fetch_result").filter("mode = 'raw' AND content IS NOT NULL")
    found = pages.select(U.host(F.col("url")).alias("host"), F.explode(H.links(F.col("content"), F.col("url"))).alias("x"))
    return found.groupBy("host", F.col("x.class").alias("class")).agg(F.count(F.lit(1)).alias("n"))


def challenge_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text alone classifies; the status is that of an answered request."""
    rows = table(spark, sf_dir, "robust_result").filter("content IS NOT NULL")
    return rows.groupBy(classify.challenge(F.col("content"), F.lit(200)).alias("found"), "challenge").agg(F.count(F.lit(1)).alias("n"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """channel, tries, successes over the attempts of all fetches."""
    tried = table(spark, sf_dir, "robust_result").select(F.explode("attempts").alias("a"))
    return tried.groupBy(F.col("a.channel").alias("channel")).agg(F.count(F.lit(1)).alias("tries"), F.count_if(F.col("a.ok")).alias("successes"))


def hit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with a site: restriction name the domain that should come."""
    rows = table(spark, sf_dir, "search_result")
    labels = rows.select("query").distinct().withColumn("expected", F.regexp_extract("query", r"site:(\S+)", 1)).filter("expected <> ''")
    ranked = merge.ranked_with_domain_cap(merge.merge_results(rows)).select("query", "domain", "rank")
    return evaluate.hit_metrics(ranked, labels)


def engine_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.engine_coverage(table(spark, sf_dir, "search_result").withColumn("domain", U.domain_of(F.trim("url"))))


def crawl_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites as nodes: two are linked if the engines name them for the same question in neighbouring places."""
    rows = table(spark, sf_dir, "search_result").filter("url IS NOT NULL").select("query", "ord", U.site_root(F.trim("url")).alias("site"))
    after = rows.select("query", (F.col("ord") - 1).alias("ord"), F.col("site").alias("dst"))
    edges = rows.join(after, ["query", "ord"]).select(F.col("site").alias("src"), "dst").filter("src <> dst").distinct()
    seeds = rows.agg(F.min("site").alias("node"))
    return crawl.crawl(edges, seeds, 3)


def sha1_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash-range lookup: texts whose SHA-1 is that of a row with an id divisible by 50, found by its five-letter range."""
    rows = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.upper(F.sha1("text")).alias("sha1"))
    wanted = rows.filter("doc_id % 50 = 0").select(F.substring("sha1", 1, 5).alias("prefix"), F.substring("sha1", 6, 35).alias("suffix")).distinct()
    probe = rows.select("doc_id", F.substring("sha1", 1, 5).alias("prefix"), F.substring("sha1", 6, 35).alias("suffix"))
    return probe.join(wanted, ["prefix", "suffix"], "left_semi").select("doc_id", "prefix")


def published_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, day: the full date in an item's address, where it exists. Few addresses of the log hold one, so every second gets
    a path of three numbers, some of which are no date."""
    dated = F.expr("if(seq % 2 = 0, concat('https://d.test', printf(element_at(array('/%04d/%02d/%02d/', '/%04d-%02d-%02d.html'), CAST(seq DIV 2 % 2 AS int) + 1), CAST(1995 + seq % 31 AS int), CAST(1 + seq % 13 AS int), CAST(1 + seq % 32 AS int)), 'x?d=20240506'), url)")
    p = U.path(dated)
    y, m, d = (F.regexp_extract(p, r"/(\d{4})[-/]?(\d{2})[-/]?(\d{2})(?:/|$|\.)", n) for n in (1, 2, 3))
    rows = table(spark, sf_dir, "intel_item").select("seq", F.try_to_timestamp(F.nullif(F.concat(y, m, d), F.lit("")), F.lit("yyyyMMdd")).cast("date").alias("day"))
    return rows.filter("day IS NOT NULL")


def discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "intel_item").select("url", "source", F.try_element_at("meta", F.lit("mime")).alias("mime"), F.col("seq").alias("ord"))
    merged = merge.merge_discovered(items)
    return merged.select("key", "source", F.array_join("sources", "+").alias("sources"), "mime", "ord")


def discover_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "intel_item").filter("url IS NOT NULL")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(U.is_attachment(F.col("url"))).alias("attachments"))


def extension_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "intel_item").filter("url IS NOT NULL").groupBy(U.extension(F.col("url")).alias("ext")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("target_id").alias("targets"))


def title_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """term, n: the terms of titles, Latin words and parts of Chinese runs, that are no stop words."""
    terms = table(spark, sf_dir, "search_result").filter("title IS NOT NULL").select(F.explode(T.terms(F.col("title"))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def shared_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains of search results by set operation: also among fetched pages, or not."""
    found = table(spark, sf_dir, "search_result").select(U.domain_of(F.trim("url")).alias("domain")).distinct()
    fetched = table(spark, sf_dir, "fetch_result").select(U.domain_of(F.col("url")).alias("domain"))
    both, only = found.intersect(fetched), found.subtract(fetched)
    return both.withColumn("fetched", F.lit(True)).unionByName(only.withColumn("fetched", F.lit(False)))


def sources_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters by source and language, with totals (grouping sets)."""
    return table(spark, sf_dir, "documents").cube("source", "lang").agg(F.grouping_id().cast("bigint").alias("level"), F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))


QUERIES = {f.__name__: f for f in (
    extension_counts, title_terms, shared_domains, sources_by_language, url_canonical, url_parts, host_counts, merge_channels, rank_domain_cap, engine_contribution, cross_checked, dedupe_first, query_forms, redacted, seed_terms, html_text, html_main,
    link_classes, challenge_classes, attempts, hit_metrics, engine_coverage, crawl_bfs, sha1_ranges, published_from_url, discovered, discover_stats,
)}

_ABSOLUTE = r"regexp_matches({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+')"
_NORMAL = r"""CASE WHEN regexp_matches({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+') THEN
 lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1))
 || CASE WHEN length(split_part(split_part({u}, '#', 1), '?', 1)) = length(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) THEN '/'
         ELSE substr(split_part(split_part({u}, '#', 1), '?', 1), length(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) + 1) END
 || coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract(split_part({u}, '#', 1), '\?((?s:.*))$', 1), '&'),
      lambda p: p <> '' AND NOT list_contains(['utm_source','utm_medium','utm_campaign','utm_term','utm_content','ref','spm','fbclid','gclid'], split_part(p, '=', 1))), '&'), ''), '')
 ELSE {u} END"""
_HOST = r"lower(regexp_replace(regexp_replace(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\s]*)', 1), '^[^@]*@', ''), ':\d*$', ''))"
_DOMAIN = f"regexp_replace({_HOST}, '^www\\.', '')"
_SITE = f"array_to_string(list_slice(string_split({_HOST}, '.'), -2, -1), '.')"


def _sql(template: str, **columns: str) -> str:
    return template.format(**columns)


_TRIMMED = r"regexp_replace(url, '^\s+|\s+$', '', 'g')"


_MERGED = f"""
WITH base AS (SELECT *, {_sql(_NORMAL, u=_TRIMMED)} AS key FROM search_result WHERE url IS NOT NULL),
merged AS (SELECT query, key,
  arg_min(title, (ord, result_id)) FILTER (WHERE title IS NOT NULL) AS title,
  arg_max(snippet, (length(snippet), -ord, -result_id)) FILTER (WHERE snippet IS NOT NULL) AS snippet,
  list_sort(list(DISTINCT source) FILTER (WHERE source IS NOT NULL)) AS engines, min((ord, result_id)) AS place
  FROM base GROUP BY query, key)
"""
_RANKED = (
    _MERGED
    + f""", scored AS (SELECT *, {_sql(_DOMAIN, u="key")} AS domain,
  coalesce(len(engines), 0) * 10 + least(3, coalesce(length(snippet), 0) // 200)
  + 3 * len(list_filter(string_split_regex(lower(query), '[^a-z0-9一-鿿]+'), lambda t: length(t) >= 3 AND contains(lower(concat_ws(' ', title, snippet)), t))) AS score FROM merged),
capped AS (SELECT *, row_number() OVER (PARTITION BY query, domain ORDER BY score DESC, place) AS of_domain FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, place) AS rank FROM capped WHERE of_domain <= 2)
"""
)
_TEXT = r"trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace({c}, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '[\s\x0B ]+', ' ', 'g'))".replace('\\"', '"')
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_MAIN = r"""(CASE WHEN regexp_extract(content, '(?is)<main\b[^>]*>(.*?)</main>', 1) <> '' THEN regexp_extract(content, '(?is)<main\b[^>]*>(.*?)</main>', 1) WHEN regexp_extract(content, '(?is)<article\b[^>]*>(.*?)</article>', 1) <> '' THEN regexp_extract(content, '(?is)<article\b[^>]*>(.*?)</article>', 1)
 WHEN regexp_extract(content, '(?is)<body\b[^>]*>(.*?)</body>', 1) <> '' THEN regexp_extract(content, '(?is)<body\b[^>]*>(.*?)</body>', 1) ELSE content END)"""
_LOOSE = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '(?i)&nbsp;', ' ', 'g'), '(?i)&amp;', '&', 'g'), '(?i)&lt;', '<', 'g'), '(?i)&gt;', '>', 'g'), '(?i)&quot;', '\"', 'g'), '[\s\x0B ]+', ' ', 'g'))".replace('\\"', '"')


def _tagged(tag: str) -> str:
    return f"SELECT host, 2 AS weight, unnest(list_filter(list_transform(regexp_extract_all(content, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}>', 1), lambda x: {_sql(_LOOSE, c='x')}), lambda x: x <> '')[1:20]) AS text FROM pages"


ORACLES = {
    "seed_terms": f"""WITH pages AS (SELECT {_sql(_HOST, u='url')} AS host, content FROM fetch_result WHERE mode = 'raw' AND content IS NOT NULL),
texts AS (SELECT host, 3 AS weight, trim(regexp_replace(regexp_extract(content, '(?is)<title[^>]*>(.*?)</title>', 1), '[\\s\\x0B ]+', ' ', 'g')) AS text FROM pages UNION ALL {_tagged('h1')} UNION ALL {_tagged('h2')} UNION ALL {_tagged('h3')}
 UNION ALL SELECT host, 1, unnest(list_filter(list_transform(regexp_extract_all(content, '(?is)<a\\b[^>]*>(.*?)</a>', 1), lambda x: {_sql(_LOOSE, c='x')}), lambda x: length(x) BETWEEN 2 AND 30)[1:60]) FROM pages),
runs AS (SELECT host, weight, unnest(regexp_extract_all(text, '[一-龥]{{2,}}')) AS run FROM texts),
terms AS (SELECT host, weight, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9-]{{2,}}')) AS term FROM texts
 UNION ALL SELECT host, weight, run[i:i + n - 1] FROM (SELECT host, weight, run, n, unnest(range(1, length(run) - n + 2)) AS i FROM runs, (VALUES (2), (3), (4)) AS sizes(n))),
scored AS (SELECT host, term, sum(weight * least(length(term), 6))::BIGINT AS score FROM terms WHERE lower(term) NOT IN ({_STOP}) GROUP BY 1, 2)
SELECT host, term, score, row_number() OVER (PARTITION BY host ORDER BY score DESC, term)::INTEGER AS rank FROM scored QUALIFY rank <= 8""",
    "link_classes": f"""WITH refs AS (SELECT {_sql(_HOST, u='url')} AS host, url AS base, trim(unnest(regexp_extract_all(content, '(?i)\\b(?:href|src)\\s*=\\s*["'']([^"''#][^"'']*)["'']', 1))) AS r FROM fetch_result WHERE mode = 'raw' AND content IS NOT NULL),
found AS (SELECT host, CASE WHEN r = '' OR starts_with(r, '#') THEN NULL WHEN regexp_matches(r, '(?i)^https?://') THEN r WHEN regexp_matches(r, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN starts_with(r, '//') THEN regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) || r
 WHEN starts_with(r, '/') THEN regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) || r ELSE regexp_replace(regexp_replace(base, '[?#].*$', ''), '[^/]*$', '') || regexp_replace(r, '^\\./', '') END AS u FROM refs)
SELECT host, CASE WHEN regexp_matches(u, '(?i)(rss|atom|feed)[^/]*(\\.xml)?$|/feed/?$') THEN 'feed' WHEN regexp_matches(u, '(?i)sitemap[^/]*\\.(xml|txt)') THEN 'sitemap'
 WHEN regexp_matches(lower(regexp_replace(u, '[?#].*$', '')), '/[^/]+\\.(pdf|doc|docx|xls|xlsx|ppt|pptx|csv|txt|rtf|odt|ods|odp|zip|rar|7z|epub|wps|et|dps)$') THEN 'attachment' ELSE 'page' END AS class, count(*) AS n FROM found WHERE u IS NOT NULL GROUP BY 1, 2""",
    "html_main": f"SELECT fetch_id, trim(regexp_replace(regexp_extract(content, '(?is)<title[^>]*>(.*?)</title>', 1), '[\\s\\x0B ]+', ' ', 'g')) AS title, CASE WHEN length(t) > 8000 THEN t[1:8000] || '…' ELSE t END AS main FROM (SELECT fetch_id, content, {_sql(_TEXT, c=_MAIN)} AS t FROM fetch_result WHERE mode = 'raw' AND content IS NOT NULL)",
    "extension_counts": "SELECT lower(regexp_extract(string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1], '^.+\\.([A-Za-z0-9]{1,8})$', 1)) AS ext, count(*) AS n, count(DISTINCT target_id) AS targets FROM intel_item WHERE url IS NOT NULL GROUP BY 1",
    "title_terms": f"""WITH runs AS (SELECT unnest(regexp_extract_all(title, '[一-龥]{{2,}}')) AS run FROM search_result WHERE title IS NOT NULL),
terms AS (SELECT unnest(regexp_extract_all(title, '[A-Za-z][A-Za-z0-9-]{{2,}}')) AS term FROM search_result WHERE title IS NOT NULL
 UNION ALL SELECT run[i:i + n - 1] FROM (SELECT run, n, unnest(range(1, length(run) - n + 2)) AS i FROM runs, (VALUES (2), (3), (4)) AS sizes(n)))
SELECT term, count(*) AS n FROM terms WHERE lower(term) NOT IN ({_STOP}) GROUP BY 1""",
    "shared_domains": f"SELECT domain, domain IN (SELECT {_sql(_DOMAIN, u='url')} FROM fetch_result WHERE url IS NOT NULL) AS fetched FROM (SELECT DISTINCT {_sql(_DOMAIN, u='trim(url)')} AS domain FROM search_result)",
    "sources_by_language": "SELECT source, lang, grouping_id(source, lang) AS level, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY CUBE (source, lang)",
    "url_canonical": f"SELECT result_id, {_sql(_NORMAL, u=_TRIMMED)} AS url FROM search_result",
    "url_parts": f"SELECT doc_id, {_sql(_HOST, u='url')} AS host, {_sql(_DOMAIN, u='url')} AS domain, {_sql(_SITE, u='url')} AS site, lower(regexp_extract(string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1], '^.+\\.([A-Za-z0-9]{{1,8}})$', 1)) AS ext FROM documents WHERE url IS NOT NULL",
    "host_counts": f"SELECT {_sql(_HOST, u='url')} AS host, count(*) AS pages, count(content) AS with_content FROM fetch_result GROUP BY 1",
    "merge_channels": _MERGED + "SELECT query, key, title, snippet, coalesce(array_to_string(engines, '+'), '') AS engines FROM merged",
    "rank_domain_cap": _RANKED + "SELECT query, rank::INTEGER AS rank, key, score::BIGINT AS score, domain FROM ranked WHERE rank <= 10",
    "engine_contribution": _MERGED + "SELECT engine, count(*) AS results FROM (SELECT unnest(engines) AS engine FROM merged) GROUP BY 1",
    "cross_checked": _MERGED + "SELECT query, count(*) AS results, count(*) FILTER (WHERE len(engines) >= 2) AS cross_checked FROM merged GROUP BY 1",
    "dedupe_first": f"SELECT result_id, key FROM (SELECT result_id, {_sql(_NORMAL, u=_TRIMMED)} AS key, ord FROM search_result) QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord, result_id) = 1",
    "query_forms": r"""
WITH q AS (SELECT DISTINCT query, trim(query) AS kw FROM search_result),
w AS (SELECT *, array_to_string(list_filter(string_split_regex(kw, '\s+'), lambda x: length(x) > 1 AND NOT regexp_matches(x, '^(?i)(的|了|是|在|与|和|及|how|to|the|a|an|for|of|in|on)$')), ' ') AS core,
  regexp_matches(kw, '^[a-zA-Z\s]+$') AS latin, array_to_string(list_filter(string_split_regex(trim(regexp_replace(kw, '[?!."''`]', '', 'g')), '\s+'), lambda x: length(x) > 3)[1:6], ' ') AS wide,
  list_filter(string_split_regex(trim(regexp_replace(query, '["''`?？!！。，,、：:；;()（）]+', ' ', 'g')), '\s+'), lambda x: x <> '') AS words FROM q),
v AS (SELECT *, [kw, '"' || kw || '"', CASE WHEN core <> '' AND core <> kw THEN core END, CASE WHEN latin THEN 'what is ' || kw ELSE '什么是 ' || kw END, CASE WHEN latin THEN kw || ' tutorial guide' ELSE kw || ' 教程 指南' END] AS forms,
  CASE WHEN regexp_matches(kw, '^[\x20-\x7E\s]*$') THEN [kw, wide, wide || ' best practices 2026', 'how to ' || wide, wide || ' implementation techniques'] ELSE [kw, kw || ' 教程 指南', kw || ' 最佳实践'] END AS fans,
  list_filter(string_split_regex(kw, '\s+'), lambda x: x <> '') AS tokens FROM w),
d AS (SELECT *, list_transform(list_filter(list_transform(forms, lambda f, i: {'f': f, 'i': i}), lambda s: s.f IS NOT NULL AND list_position(forms, s.f) = s.i), lambda s: s.f) AS uniq,
  list_transform(list_filter(list_transform(fans, lambda f, i: {'f': trim(f), 'i': i}), lambda s: s.f <> '' AND list_position(list_transform(fans, lambda y: trim(y)), s.f) = s.i), lambda s: s.f) AS fan_uniq,
  list_transform(list_filter(list_transform(tokens, lambda f, i: {'f': f, 'i': i}), lambda s: list_position(tokens, s.f) = s.i), lambda s: s.f) AS terms FROM v)
SELECT query, array_to_string(uniq[1:8], '|') AS variants, array_to_string(fan_uniq[1:4], '|') AS fan_out,
  CASE WHEN len(words) <= 4 THEN '' ELSE array_to_string(words[1:4], ' ') END AS simple,
  CASE WHEN regexp_matches(kw, '[:"()]|\b(?:AND|OR|ANDNOT)\b') OR len(terms) <= 1 THEN kw ELSE array_to_string(list_transform(terms, lambda t: 'all:' || t), ' AND ') END AS paper,
  CASE WHEN c AND a THEN 'code+academic' WHEN c THEN 'code' WHEN a THEN 'academic' ELSE 'general' END AS route,
  replace(replace(replace(replace(replace(query, '+', '%2B'), '"', '%22'), '&', '%26'), '#', '%23'), ' ', '+') AS encoded
FROM (SELECT *, regexp_matches(lower(query), '\b(github|gitlab|repo|repository|npm|pypi|crate|sdk|library|framework|api|implementation|source code|monorepo)\b|源码|源代码|代码库|仓库|插件|库|框架|实现方式|依赖') AS c,
  regexp_matches(lower(query), '\b(paper|papers|arxiv|preprint|study|studies|survey|literature|benchmark|dataset)\b|论文|文献|综述|研究进展|学术|数据集') AS a FROM d)""",
    "redacted": r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
 '(?i)\bBearer\s+\S+', 'Bearer [redacted]', 'g'), '(?i)(^|[^A-Za-z0-9])(api[_-]?key|token|secret|password|passwd|passphrase|authorization)\s*[:=]\s*\S+', '\1\2=[redacted]', 'g'),
 '\b(sk|rk|pk)-[A-Za-z0-9_-]{8,}', '[redacted]', 'g'), '\b(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{16,}', '[redacted]', 'g'), '\bgithub_pat_[A-Za-z0-9_]{16,}', '[redacted]', 'g'), '\bAKIA[0-9A-Z]{12,}', '[redacted]', 'g'), '[A-Za-z0-9+/=_-]{32,}', '[redacted]', 'g')) AS redacted FROM documents WHERE text IS NOT NULL""",
    "html_text": f"SELECT fetch_id, {_sql(_TEXT, c='content')} AS text FROM fetch_result WHERE mode = 'raw' AND content IS NOT NULL",
    "challenge_classes": """SELECT CASE WHEN regexp_matches(lower(content), 'verifying your browser|just a moment|checking your browser|attention required|challenge-platform|cf-chl|不是机器人|拖动滑块|slide to verify|drag the slider|are you a robot|robot check') THEN 'js-challenge'
 WHEN regexp_matches(lower(content), 'unusual traffic|automated access|access from your network|we have been receiving a large volume') THEN 'ip-block' WHEN contains(lower(content), 'security checkpoint') THEN 'waf'
 WHEN contains(regexp_extract(lower(content), '(?s)<title[^>]*>(.*?)</title>', 1), 'anomaly') AND contains(lower(content), 'duckduckgo') THEN 'ip-block' ELSE 'none' END AS found, challenge, count(*) AS n FROM robust_result WHERE content IS NOT NULL GROUP BY 1, 2""",
    "attempts": "SELECT a.channel AS channel, count(*) AS tries, count(*) FILTER (WHERE a.ok) AS successes FROM (SELECT unnest(attempts) AS a FROM robust_result) GROUP BY 1",
    "hit_metrics": _RANKED
    + r""", labels AS (SELECT DISTINCT query, regexp_extract(query, 'site:(\S+)', 1) AS expected FROM search_result WHERE regexp_matches(query, 'site:\S+')),
first AS (SELECT l.query, min(rank) AS rank FROM labels l JOIN ranked r ON l.query = r.query AND rank <= 10 AND (domain = expected OR ends_with(domain, '.' || expected)) GROUP BY 1)
SELECT count(*) AS queries, avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END) AS hit_at_3, avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END) AS hit_at_5, avg(coalesce(1.0 / rank, 0.0)) AS mrr FROM labels LEFT JOIN first USING (query)""",
    "engine_coverage": f"SELECT source, count(DISTINCT query) AS queries, count(*) AS results, count(DISTINCT {_sql(_DOMAIN, u='trim(url)')}) AS domains FROM search_result GROUP BY 1",
    "crawl_bfs": f"""
WITH RECURSIVE rows_of AS (SELECT query, ord, {_sql(_SITE, u='trim(url)')} AS site FROM search_result WHERE url IS NOT NULL),
edges AS (SELECT DISTINCT a.site AS src, b.site AS dst FROM rows_of a JOIN rows_of b ON a.query = b.query AND b.ord = a.ord + 1 WHERE a.site <> b.site),
walk AS (SELECT min(site) AS node, 0 AS depth FROM rows_of UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.depth < 3)
SELECT node, min(depth)::INTEGER AS depth FROM walk GROUP BY node""",
    "sha1_ranges": "WITH h AS (SELECT doc_id, upper(sha1(text)) AS h FROM documents WHERE text IS NOT NULL) SELECT doc_id, h[1:5] AS prefix FROM h WHERE h IN (SELECT h FROM h WHERE doc_id % 50 = 0)",
    "published_from_url": r"SELECT seq, day FROM (SELECT seq, try_strptime(regexp_extract(regexp_replace(u, '[?#].*$', ''), '/(\d{4})[-/]?(\d{2})[-/]?(\d{2})(?:/|$|\.)', 1) || regexp_extract(regexp_replace(u, '[?#].*$', ''), '/(\d{4})[-/]?(\d{2})[-/]?(\d{2})(?:/|$|\.)', 2) || regexp_extract(regexp_replace(u, '[?#].*$', ''), '/(\d{4})[-/]?(\d{2})[-/]?(\d{2})(?:/|$|\.)', 3), '%Y%m%d')::DATE AS day FROM (SELECT seq, CASE WHEN seq % 2 = 0 THEN 'https://d.test' || printf(CASE WHEN seq // 2 % 2 = 0 THEN '/%04d/%02d/%02d/' ELSE '/%04d-%02d-%02d.html' END, 1995 + seq % 31, 1 + seq % 13, 1 + seq % 32) || 'x' ELSE url END AS u FROM intel_item)) WHERE day IS NOT NULL",
    "discovered": """SELECT regexp_replace(regexp_replace(url, '#.*$', ''), '^(?i)http://', 'https://') AS key, arg_min(source, seq) AS source, coalesce(array_to_string(list_sort(list(DISTINCT source) FILTER (WHERE source IS NOT NULL)), '+'), '') AS sources,
 arg_min(meta['mime'], seq) FILTER (WHERE coalesce(meta['mime'], '') <> '') AS mime, min(seq) AS ord FROM intel_item WHERE url IS NOT NULL GROUP BY 1""",
    "discover_stats": r"""SELECT source, count(*) AS n, count(*) FILTER (WHERE regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '/[^/]+\.(pdf|doc|docx|xls|xlsx|ppt|pptx|csv|txt|rtf|odt|ods|odp|zip|rar|7z|epub|wps|et|dps)$')
 AND NOT regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '/(robots\.txt|sitemap\.txt|security\.txt|humans\.txt|ads\.txt|llms\.txt)$')) AS attachments FROM intel_item WHERE url IS NOT NULL GROUP BY 1""",
}
