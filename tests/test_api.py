"""Declarative mapping, ages and the captured-response source."""

import datetime as dt
import json

from pyspark.sql import functions as F

from marlspike.functions import html as H
from marlspike.operators import api
from marlspike.sources import responses as R
from marlspike.sources.captured import CapturedResponses


def test_map_items(spark):
    body = json.dumps({"data": {"list": [{"id": 7, "title": "A", "ts": 1740718029334}, {"id": "", "title": "B"}, "text", {"id": 8, "ts": "soon"}, {"id": 9, "ts": "2025-01-02T00:00:00Z"}]}})
    responses = spark.createDataFrame([("a", body), ("b", "{}"), ("c", '{"data":{"list":3}}'), ("d", "no"), ("e", None)], "query string, body string")
    spec = api.ApiSpec("data.list", time_path="ts", url_template="https://a.test/{id}", max_items=2)
    items, notes = api.map_items(responses, spec)
    assert [(r.url, r.title, r.published_at) for r in items.orderBy("ord").collect()] == [("https://a.test/7", "A", dt.datetime(2025, 2, 28, 4, 47, 9, 334000)), ("https://a.test/8", None, None)]
    got = {r.query: (r.error, r.raw, r.skipped, r.no_time, r.truncated) for r in notes.collect()}
    assert got == {"a": (None, 5, 2, 1, 1), "b": ("no such path", None, None, None, None), "c": ("no list", None, None, None, None), "d": ("no JSON", None, None, None, None), "e": ("no JSON", None, None, None, None)}
    assert api.map_items(responses, api.ApiSpec("data.list", max_items=0))[0].isEmpty()


def test_times(spark):
    now = F.lit(dt.datetime(2025, 1, 10))
    rows = spark.createDataFrame([(dt.datetime(2025, 1, 9), "page"), (dt.datetime(2025, 1, 1), "url"), (dt.datetime(2025, 1, 10, 1), None), (None, "page")], "t timestamp, o string")
    assert [r[0] for r in rows.select(api.age_label(F.col("t"), now, F.col("o"))).collect()] == ["≈24.0h ago", "~9.0d ago", "in 1.0h", "unknown"]
    assert api.relative_dates("since {days:1} {days:9999} {days:x}", dt.date(2025, 1, 2)) == "since 2025-01-01 {days:9999} {days:x}"
    a = spark.createDataFrame([("x", "p", None), ("y", "p", dt.date(2024, 1, 1)), ("z", "q", None)], "url string, page string, own_date date")
    p = spark.createDataFrame([("p", dt.date(2025, 1, 1))], "page string, at date")
    assert {r.url: (r.at, r.origin) for r in api.inherit_times(a, p).collect()} == {"x": (dt.date(2025, 1, 1), "page"), "y": (dt.date(2024, 1, 1), "url"), "z": (None, None)}


def test_lookups(spark):
    results = spark.createDataFrame([("r1", 1), ("r1", 9), ("u", 2)], "url string, ord int")
    redirects = spark.createDataFrame([("r1", "t"), ("r1", "t")], "url string, target string")
    assert sorted((r.url, r.ord) for r in api.resolve_redirects(results, redirects).collect()) == [("r1", 9), ("t", 1), ("u", 2)]
    c = spark.createDataFrame([("h", "a", 2), ("h", "b", 1), ("i", "c", 1), ("j", "d", 1)], "host string, request_url string, prio int")
    r = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "request_url string, answers boolean")
    assert {x.host: (x.request_url, x.state) for x in api.probe_endpoint(c, r).collect()} == {"h": ("b", "found"), "i": (None, "none"), "j": (None, "untried")}
    page = '<a href="list2.htm">2</a><a href="/n">Next <b>»</b></a><a href="x.htm">x</a>'
    df = spark.createDataFrame([(page,)], "p string")
    assert df.select(H.pagination_links(F.col("p"), F.lit("https://a.test/l/"))).first()[0] == ["https://a.test/l/list2.htm", "https://a.test/n"]
    meta = json.dumps({"results": [{}], "unresponsive_engines": [["bing", "timeout"], "brave"]})
    row = R.silent_engines(spark.createDataFrame([("u", "q", 200, meta)], "request_url string, query string, status int, body string")).first()
    assert (row.results, row.silent) == (1, ["bing", "brave"])


def test_captured_source(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"source":"bing","status":200,"body":"x"}\nbroken\n\n[1]\n')
    spark.dataSource.register(CapturedResponses)
    rows = spark.read.format("captured").load(str(tmp_path)).collect()
    assert [(r.source, r.status, r.error is None) for r in rows] == [("bing", 200, True), (None, None, False), (None, None, False)]
