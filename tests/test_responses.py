"""Parsers of captured responses, on small hand-made bodies."""

import base64
import json

from marlspike.sources import responses as R

SCHEMA = "request_url string, query string, status int, body string"


def captured(spark, *bodies, status=200, query="q"):
    return spark.createDataFrame([("u", query, status, b) for b in bodies], SCHEMA)


def rows(df):
    return [r.asDict(recursive=True) for r in df.orderBy("ord").collect()] if "ord" in df.columns else [r.asDict(recursive=True) for r in df.collect()]


def test_error_classes(spark):
    df = spark.createDataFrame([("a", "q", 429, "x"), ("b", "q", 504, "x"), ("c", "q", 500, "x"), ("d", "q", 200, None), ("e", "q", 200, "x")], SCHEMA)
    assert {r.request_url: r.error for r in R.errors(df).collect()} == {"a": "rate-limit", "b": "timeout", "c": "http-error", "d": "empty"}


def test_json_sources(spark):
    body = json.dumps({"results": [{"title": "A", "url": "https://A.test/x?utm_source=1", "content": "c"}, {"title": "no url"}]})
    assert [(r["title"], r["url"], r["snippet"]) for r in rows(R.parse_json(captured(spark, body), "tavily"))] == [("A", "https://a.test/x", "c")]
    ranked = json.dumps({"results": [{"url": "https://a.test/1", "rerank_score": 1}, {"url": "https://a.test/2", "rerank_score": 2.5, "summary": "s", "snippet": "t"}, {"url": "https://a.test/3", "rerank_score": 1}]})
    found = rows(R.parse_json(captured(spark, ranked), "deepseek"))
    assert [r["url"][-1] for r in found] == ["2", "1", "3"] and found[0]["snippet"] == "s" and found[0]["title"] == "https://a.test/2"
    inner = json.dumps({"results": [{"url": "https://p.test/", "excerpts": ["x", "y"]}]})
    envelope = json.dumps({"result": {"content": [{"text": inner}]}})
    assert rows(R.parse_json(captured(spark, envelope), "parallel"))[0]["snippet"] == "x … y"
    meta = json.dumps({"results": [{"url": "https://s.test/", "title": "", "engines": ["a", "b"], "content": "x  y"}]})
    assert rows(R.parse_json(captured(spark, meta), "searxng"))[0]["source"] == "searxng:a+b"
    assert rows(R.parse_json(captured(spark, "not json", "[]", ""), "tavily")) == []
    papers = json.dumps({"message": {"items": [{"title": ["T"], "DOI": "10.1/x", "issued": {"date-parts": [[2020]]}, "container-title": ["J"]}]}})
    assert rows(R.parse_json(captured(spark, papers), "crossref"))[0] | {"extra": 0} == {"query": "q", "source": "crossref", "ord": 1, "title": "T", "url": "https://doi.org/10.1/x", "snippet": "DOI: 10.1/x · year: 2020 · container: J", "extra": 0}


def test_a_list_of_an_empty_title_is_no_title(spark):
    items = [{"DOI": "1", "title": [""], "container-title": [""]}, {"DOI": "2", "title": [], "container-title": []}, {"DOI": "3", "title": "T", "container-title": ["J", "K"]}, {"DOI": "4", "title": [7]}, {"DOI": "5", "title": None}]
    found = rows(R.parse_json(captured(spark, json.dumps({"message": {"items": items}})), "crossref"))
    assert [r["title"] for r in found] == ["", "", "T", "", ""]
    assert [r["snippet"].split("container: ")[1] for r in found] == ["", "", "J", "", ""]


def test_block_sources(spark):
    page = '<div class="result r"><a class="result__a" href="//x.test/l/?uddg=https%3A%2F%2Fgood.test%2Fa%3Fref%3D1">A <b>t</b></a><a class="result__snippet">S &amp; t</a></div><div class="result ad"><a class="result__a" href="https://duckduckgo.com/y.js?ad_domain=z">Ad</a></div>'
    assert [(r["title"], r["url"], r["snippet"]) for r in rows(R.parse_blocks(captured(spark, page), "duckduckgo"))] == [("A t", "https://good.test/a", "S & t")]
    target = base64.urlsafe_b64encode(b"https://b.test/p").decode().rstrip("=")
    page = f'<ol><li class="b_algo"><h2><a href="https://r.test/ck/a?u=a1{target}&x=1">B</a></h2><p>text</p></li></ol>'
    assert [(r["title"], r["url"]) for r in rows(R.parse_blocks(captured(spark, page), "bing"))] == [("B", "https://b.test/p")]
    atom = "<feed><entry><title>T\n one</title><id> http://p.test/abs/1v1 </id><summary>s</summary><published>2024-05-06T00:00:00Z</published></entry></feed>"
    found = rows(R.parse_blocks(captured(spark, atom), "arxiv"))
    assert found[0]["title"] == "T one" and found[0]["url"] == "http://p.test/abs/1v1" and found[0]["extra"] == {"published": "2024-05-06"}
    posts = '<div data-post="c/1" class="m">first <b>news</b></div><div data-post="c/2">other</div>'
    assert [(r["url"], r["snippet"]) for r in rows(R.parse_blocks(captured(spark, posts), "telegram", keyword="NEWS"))] == [("https://t.me/c/1", "first news")]
    feed = '<item><title>F</title><link>magnet:?xt=urn:btih:ABC</link><size>10</size><torznab:attr name="seeders" value="3"/></item>'
    assert rows(R.parse_blocks(captured(spark, feed), "torznab"))[0]["extra"] == {"size": "10", "magnet": "magnet:?xt=urn:btih:ABC"}


def test_discovery(spark):
    index = '{"url":"https://a.test/1","status":"200","mime":"text/html","timestamp":"1"}\n\n{"noturl":1}\n{"error":"No Captures"}'
    found, bad = R.parse_crawl_index(captured(spark, index, "", "<html>504</html>"))
    assert [r.url for r in found.collect()] == ["https://a.test/1"] and sorted(r.error for r in bad.collect()) == ["No Captures", "markup instead of lines"]
    archive = json.dumps([["mimetype", "original", "timestamp", "statuscode"], ["t", "https://a.test/", "2", "200"], ["t", "https://a.test/", "1", "200"]])
    snapshots = R.parse_archive_index(captured(spark, archive))
    assert [(r.url, r.ts) for r in R.snapshot_to_restore(snapshots, 1).collect()] == [("https://a.test/", "1")]
    certs = json.dumps([{"name_value": "*.a.test\nb.a.test"}, {"name_value": "a.test"}])
    assert sorted(r.host for r in R.parse_certificates(captured(spark, certs)).collect()) == ["a.test", "b.a.test"]
    assert sorted(r.host for r in R.parse_certificates(captured(spark, certs), True).collect()) == ["a.test", "b.a.test"]
    robots = "User-agent: *\nDisallow: /x # no\nSitemap: https://a.test/s.xml\n"
    got = {r.sitemaps[0] if r.sitemaps else r.error: r.disallowed for r in R.parse_robots(captured(spark, robots, "<html>")).collect()}
    assert got == {"https://a.test/s.xml": ["/x"], "markup instead of robots": []}
    assert sorted(r.url for r in R.parse_sitemap(captured(spark, "<loc>https://a.test/1?x=1&amp;y</loc>", "https://a.test/2\nnoise")).collect()) == ["https://a.test/1?x=1&y", "https://a.test/2"]


def test_others(spark):
    rdap = json.dumps({"status": ["ok"], "nameservers": [{"ldhName": "n1"}], "events": [{"eventAction": "reg", "eventDate": "2020-01-02T"}], "entities": [{"roles": ["x"]}, {"roles": ["registrant"], "handle": "H"}]})
    assert R.parse_registration(captured(spark, rdap)).first().asDict() == {"query": "q", "status": "ok", "nameservers": "n1", "events": "reg:2020-01-02", "registrant": "H"}
    stream = "event: matches\ndata: " + json.dumps([{"repository": "r", "path": "p", "lineMatches": [{"line": " a ", "lineNumber": 1}, {"line": "b"}, {"line": "c"}]}]) + "\n\nevent: done\ndata: {}"
    assert [r.line for r in R.parse_code_stream(captured(spark, stream)).orderBy("ord").collect()] == ["a", "b"]
    catalog = json.dumps([{"threads": [{"no": 1, "sub": "Spark", "com": "<b>x</b>"}, {"no": 2, "com": "y"}]}])
    assert [r.title for r in R.parse_threads(captured(spark, catalog), "spark", "g").collect()] == ["Spark"]
    attempts = spark.createDataFrame([("u", 1, "a", "waf", "x" * 200), ("u", 2, "b", "none", "y" * 200), ("v", 1, "a", "none", "short")], "url string, rung int, channel string, challenge string, content string")
    assert {r.url: r.channel for r in R.best_attempt(attempts).collect()} == {"u": "b", "v": "failed"}
