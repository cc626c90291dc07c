"""The tool surface on captured responses."""

import json

from marlspike import tools


def test_every_tool_is_registered():
    assert len(tools.TOOLS) == 33  # 32 tools and the errors of channels


def test_search_tools(spark, tmp_path):
    web = json.dumps({"results": [{"title": "A", "url": "https://a.test/1", "content": "spark " * 50}, {"title": "B", "url": "https://a.test/2", "content": "x"}, {"title": "C", "url": "https://a.test/3", "content": "y"}]})
    bad = ("u", "spark", 429, "", "bing")
    responses = spark.createDataFrame([("u", "spark", 200, web, "searxng"), bad, ("u", "spark", 200, json.dumps({"result": {"content": [{"text": web}]}}), "parallel")], "request_url string, query string, status int, body string, source string")
    tables = {"responses": responses, "pages": spark.createDataFrame([("https://a.test/1", "text")], "url string, text string"), "queries": spark.createDataFrame([("spark library",)], "query string")}
    assert tools.search_web(spark, tables, "spark").count() == 3
    assert tools.channel_errors(spark, tables).first().error == "rate-limit"
    deep = tools.search_deep(spark, tables, "spark").orderBy("rank").collect()
    assert [r.url for r in deep] == ["https://a.test/1", "https://a.test/2"] and deep[0].content == "text" and sorted(deep[0].engines) == ["parallel", "searxng"]
    assert tools.search_build_query(spark, tables).first().route == "code"
    assert {r["source"]: r.n for r in tools.search_quota(spark, tables).collect()} == {"searxng": 1, "bing": 1, "parallel": 1}
    site = {"pages": spark.createDataFrame([("https://a.test/", '<a href="/p/page.htm">x</a><a href="x.png">i</a>'), ("https://a.test/p/page.htm", '<a href="f.pdf#z">d</a>')], "url string, html string"), "seeds": spark.createDataFrame([("https://a.test/",)], "node string")}
    assert {(r.url, r.depth, r.attachment) for r in tools.discover_site(spark, site).collect()} == {("https://a.test/", 0, False), ("https://a.test/p/page.htm", 1, False), ("https://a.test/p/f.pdf", 2, True)}
    folder = str(tmp_path / "s")
    assert tools.intel_watch(spark, {}, folder, "t", 1, url="x").count() == 1
    leaks = {"secrets": spark.createDataFrame([(1, "ABCDEF"), (2, "XXXXXX")], "id int, sha1 string"), "ranges": spark.createDataFrame([("ABCDE", "F", 3)], "prefix string, suffix string, n int")}
    assert {r.id: r.n for r in tools.search_leaks(spark, leaks).collect()} == {1: 3, 2: 0}
